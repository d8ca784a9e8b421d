"""Vectorised work on the UTF-8 bytes of whole batches of texts.

Window and word hashes are polynomials over the ring of 64-bit integers with
an odd base: with prefix sums of ``byte * base**-i`` every slice's hash is one
subtraction and one multiplication, so no text is walked in Python.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer single text is one block.
BLOCK = 1_000_000

_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_M64 = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b: int) -> np.ndarray:
        out = np.empty(n, np.uint64)
        out[0] = 1
        done, step = 1, b
        while done < n:
            more = min(done, n - done)
            np.multiply(out[:more], np.uint64(step), out=out[done : done + more])
            step = step * step & _M64
            done += more
        return out

    return run(base), run(pow(base, -1, 1 << 64))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n."""
    up, down = _powers(base, 1 << max(12, int(n - 1).bit_length()))
    return up[:n], down[:n]


class Rolling:
    """Hashes of any slices of one byte array."""

    def __init__(self, data: np.ndarray, base: int = _B1):
        self.up, down = powers(base, len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], out=self.prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        # base**-start * sum; multiplied by base**(len-start) the exponents no longer depend on the place
        return (self.prefix[end] - self.prefix[start]) * self.up[start]

    def windows(self, k: int, count: int) -> np.ndarray:
        """Hashes of the ``count`` slices [i, i+k)."""
        return (self.prefix[k : k + count] - self.prefix[:count]) * self.up[:count]


def second(data: np.ndarray) -> Rolling:
    return Rolling(data, _B2)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about ``most`` bytes together."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and, per text, where its words begin (n + 1 offsets).

    Words are maximal runs of bytes that are not ASCII white space, with A-Z
    in lower case; they never cross texts.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[cuts > 0]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = mix(Rolling(_LOWER[data])(starts, ends) + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, offsets)
