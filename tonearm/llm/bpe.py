"""Byte-level BPE with a vectorised pre-tokeniser.

Texts become arrays of code-point classes. Which state the splitter is in
after a character is a function of the state before it, and such functions
compose associatively: a table holds every composition that can occur, and a
blocked prefix scan over whole batches yields the state everywhere, hence all
boundaries, without a regular expression. The slices between them go through
a cache; only a slice not seen before is merged pair by pair.

Defined cases: null texts are empty; empty texts have no ids; special tokens'
strings are ordinary text; very long texts are scanned like any other.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

LETTER, NUMBER, OTHER, SPACE, END = 0, 1, 2, 3, 4
# what the scan reads: a class, sometimes with what follows it
S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_LEAD, S_LAST, S_CUT1, S_CUT2, S_END = range(9)
# states after a character: inside a run, after a leading blank, after a whole piece, inside a contraction
IN_LETTER, IN_NUMBER, IN_OTHER, IN_SPACE, LEAD, WHOLE, LEFT1, LEFT2 = range(8)
#: (next state, begins a piece) by symbol and state.
_STEP = {
    S_LETTER: lambda q: {IN_LETTER: (IN_LETTER, 0), LEAD: (IN_LETTER, 0), LEFT2: (LEFT1, 0), LEFT1: (WHOLE, 0)}.get(q, (IN_LETTER, 1)),
    S_NUMBER: lambda q: (IN_NUMBER, int(q not in (IN_NUMBER, LEAD))),
    S_OTHER: lambda q: (IN_OTHER, int(q not in (IN_OTHER, LEAD))),
    S_SPACE: lambda q: (IN_SPACE, int(q != IN_SPACE)),  # white space that more of it, or the end, follows
    S_LEAD: lambda q: (LEAD, 1),  # the blank before a run
    S_LAST: lambda q: (WHOLE, 1),  # other white space before a run
    S_CUT1: lambda q: (IN_OTHER, 0) if q in (IN_OTHER, LEAD) else (LEFT1, 1),  # 's 't 'm 'd
    S_CUT2: lambda q: (IN_OTHER, 0) if q in (IN_OTHER, LEAD) else (LEFT2, 1),  # 're 've 'll
    S_END: lambda q: (WHOLE, 1),
}
#: Length of the blocks of the scan.
_SPAN = 128


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point, in the Unicode version of the tiktoken library.

    With single bytes as ids, encoding all code points under the pattern of
    one class leaves the bytes of that class's members.
    """
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        only = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        members = bytes(only.encode_ordinary(every)).decode().encode("utf-32-le")
        out[np.frombuffer(members, "<u4")] = kind
    return out


@functools.lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Composition table, each function's values, id of each symbol's function, and piece starts by (symbol, state)."""
    step = np.array([[_STEP[s](q) for q in range(8)] for s in range(9)])
    gens = [tuple(step[s, :, 0]) for s in range(9)]
    ids: dict[tuple, int] = {}
    todo = [tuple(range(8)), *gens]
    while todo:
        f = todo.pop(0)
        if f not in ids:
            ids[f] = len(ids)
            todo += [tuple(g[q] for q in f) for g in gens]
    assert len(ids) <= 256
    table = np.zeros((len(ids), len(ids)), np.uint8)
    for f, i in ids.items():
        for g, j in ids.items():
            table[i, j] = ids[tuple(g[q] for q in f)]  # f first, then g
    return table, np.array(list(ids), np.uint8), np.array([ids[g] for g in gens], np.uint8), step[:, :, 1].astype(bool)


def _scan(f: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Prefix compositions of functions, by blocks and then over the blocks' totals."""
    n = len(f)
    if n <= _SPAN:
        for i in range(1, n):
            f[i] = table[f[i - 1], f[i]]
        return f
    size = len(table)
    flat = table.ravel()
    grid = np.zeros((-(-n // _SPAN), _SPAN), np.uint8)  # function 0 is the identity
    grid.ravel()[:n] = f
    grid = np.ascontiguousarray(grid.T)
    for i in range(1, _SPAN):
        grid[i] = flat[grid[i - 1].astype(np.int32) * size + grid[i]]
    before = np.concatenate(([0], _scan(grid[-1].copy(), table)[:-1])).astype(np.int32) * size
    for i in range(_SPAN):
        grid[i] = flat[before + grid[i]]
    return np.ascontiguousarray(grid.T).ravel()[:n]


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts in one, where pieces start in it, and the number of pieces of each text.

    The texts are joined by an end mark, which is a piece of its own.
    """
    joined = "\0".join([*texts, ""])
    code = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    kind = _classes()[code]
    kind[ends] = END
    nxt = np.append(kind[1:], END)
    symbol = np.array([S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_END], np.uint8)[kind]
    last = (kind == SPACE) & (nxt != SPACE) & (nxt != END)
    symbol[last] = np.where(code[last] == 32, S_LEAD, S_LAST)
    q = np.flatnonzero(code == 39)
    if len(q):
        far = np.append(code, [0, 0])
        a, b = far[q + 1], far[q + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        symbol[q[one]], symbol[q[two & ~one]] = S_CUT1, S_CUT2
    table, functions, gens, begins = _monoid()
    state = functions[_scan(gens[symbol], table), WHOLE]
    before = np.empty_like(state)
    before[0] = WHOLE
    before[1:] = state[:-1]
    starts = np.flatnonzero(begins[symbol, before])
    pieces = np.diff(np.searchsorted(starts, np.concatenate(([0], ends + 1)))) - 1
    return joined, starts, pieces


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As :func:`merge`, by scanning the few pairs for the least."""
    get, none = ranks.get, len(ranks) + 1
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the neighbouring pair of least rank is joined until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) <= 48:
        return _merge_short(piece, ranks)
    n = len(piece)
    end, prev = [*range(1, n + 1)], [*range(-1, n - 1)]  # of the part that starts at i
    alive = [True] * n

    def pair(i: int) -> int | None:
        j = end[i]
        return ranks.get(piece[i : end[j]]) if j < n else None

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := pair(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        alive[end[i]] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
            if (r := pair(i)) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := prev[i]) >= 0 and (r := pair(p)) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


@functools.lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Cache(dict):
    """What ``make`` gives for each piece, in two generations of at most ``most`` entries."""

    def __init__(self, make: Callable[[str], object], most: int = 400_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, piece: str) -> object:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if (value := self.old.get(piece)) is None:
            value = self.make(piece)
        if len(piece) <= 64:
            self[piece] = value
        return value


def encode(texts: Iterable[str | None], cache: Cache, most: int = 1_000_000) -> Iterator[list]:
    """Per text, what ``cache`` has for each of its pieces in order."""
    held: list[str] = []
    size = 0

    def done() -> Iterator[list]:
        joined, starts, counts = boundaries(held)
        at = starts.tolist()
        k = 0
        for n in counts.tolist():
            # the last boundary of a text is its end mark
            cut = at[k : k + n + 1]
            yield [cache[joined[a:b]] for a, b in zip(cut, cut[1:], strict=False)]
            k += n + 1

    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= most:
            yield from done()
            held, size = [], 0
    if held:
        yield from done()


def decode(ids: np.ndarray, vocabulary: list[bytes], offsets: bool = False) -> bytes | tuple[bytes, np.ndarray]:
    """The bytes of a sequence of ids and, if asked, where each id's bytes begin."""
    parts = [vocabulary[i] for i in ids.tolist()]
    data = b"".join(parts)
    if not offsets:
        return data
    return data, np.cumsum([0, *map(len, parts)])[:-1]


@functools.lru_cache(4)
def vocabulary(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for k, v in ranks.items():
        out[v] = k
    return out


@functools.lru_cache(4)
def digits_cache(path: str) -> Cache:
    """Pieces to their ids, as decimal numbers joined by commas."""
    ranks = load_ranks(path)
    return Cache(lambda piece: ",".join(map(str, merge(piece.encode(), ranks))))


@functools.lru_cache(4)
def ids_cache(path: str) -> Cache:
    """Pieces to their ids, as little-endian unsigned 32-bit integers."""
    ranks = load_ranks(path)
    return Cache(lambda piece: np.array(merge(piece.encode(), ranks), "<u4").tobytes())


def round_trip(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, vocab = digits_cache(path), vocabulary(path)
        for b in batches:
            rows = []
            for pieces in encode(b.column(1).to_pylist(), cache):
                text = ",".join(pieces)
                ids = np.array(text.split(","), np.int32) if text else np.zeros(0, np.int32)
                rows.append((len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(decode(ids, vocab)).hexdigest()))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, byte_offsets array<int> (of each id in the UTF-8 text) of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, vocab = ids_cache(path), vocabulary(path)
        for b in batches:
            ids = [np.frombuffer(b"".join(p), "<u4").astype(np.int32) for p in encode(b.column(1).to_pylist(), cache)]
            at = [decode(x, vocab, offsets=True)[1].astype(np.int32) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(at, pa.list_(pa.int32()))], ["doc_id", "ids", "byte_offsets"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, byte_offsets array<int>")


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of (doc_id, ids); null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            text = [decode(np.array(x or [], np.int64), vocab).decode(errors="replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    ship(rows.sparkSession)
    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return docs.mapInArrow(round_trip(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
