"""Collection Burrows-Wheeler transform with common prefixes, built column by column.

Round j inserts the j-th symbol from the end of every string at once. The
collection's sorted suffixes are kept as three columns - the symbol before
each suffix, its common prefix with the suffix above, and where it comes
from - and each round reads the columns of the round before once, from front
to back, and writes new ones.
"""

from __future__ import annotations

import numpy as np


def _range_min(lcp: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Least value of lcp[start:stop] for non-empty ranges."""
    if not len(start):
        return np.zeros(0, lcp.dtype)
    bounds = np.empty(2 * len(start), np.int64)
    bounds[0::2], bounds[1::2] = start, stop
    return np.minimum.reduceat(np.append(lcp, lcp[-1:]), bounds)[0::2]


def collection(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes of the strings text[offsets[i]:offsets[i+1]].

    Returns, in suffix order: string, suffix length, common prefix with the
    suffix above (at most 65,535). Ends of strings differ from each other.
    """
    m = len(offsets) - 1
    length = np.diff(offsets)
    sym = text.astype(np.int16) + 1  # 0: the string is used up

    def before(i: np.ndarray, depth: int) -> np.ndarray:
        at = offsets[i + 1] - depth - 1
        return np.where(length[i] > depth, sym[np.maximum(at, 0)] if len(sym) else 0, 0).astype(np.int16)

    who, depth, lcp = np.arange(m, dtype=np.int32), np.zeros(m, np.uint16), np.zeros(m, np.uint16)
    bwt = before(who, 0)
    pos = np.arange(m)  # of each string's newest suffix
    for j in range(1, int(length.max(initial=0)) + 1):
        live = np.flatnonzero(length >= j)
        order = np.argsort(bwt, kind="stable")
        ended = int(np.count_nonzero(bwt == 0))
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(bwt))
        p = np.sort(pos[live])
        live = who[p]
        k = rank[p]
        q = m + k - ended  # places among all suffixes, the new ones included
        q_order = np.argsort(q)
        p, live, k, q = p[q_order], live[q_order], k[q_order], q[q_order]
        up, down = order[np.maximum(k - 1, 0)], order[np.minimum(k + 1, len(order) - 1)]
        same_up = (k > 0) & (bwt[up] == bwt[p])
        same_down = (k + 1 < len(order)) & (bwt[down] == bwt[p])
        lcp_up, lcp_down = np.zeros(len(p), np.uint16), np.zeros(len(p), np.uint16)
        lcp_up[same_up] = _range_min(lcp, up[same_up] + 1, p[same_up] + 1) + np.uint16(1)
        lcp_down[same_down] = _range_min(lcp, p[same_down] + 1, down[same_down] + 1) + np.uint16(1)
        old = np.ones(len(bwt) + len(q), bool)
        old[q] = False

        def merged(column: np.ndarray, new: np.ndarray | int, old: np.ndarray = old, q: np.ndarray = q) -> np.ndarray:
            out = np.empty(len(old), column.dtype)
            out[old] = column
            out[q] = new
            return out

        bwt, lcp, depth, who = merged(bwt, before(live, j)), merged(lcp, lcp_up), merged(depth, j), merged(who, live)
        below = q + 1 < len(lcp)
        lcp[q[below] + 1] = lcp_down[below]
        pos[live] = q
    return who, depth, lcp
