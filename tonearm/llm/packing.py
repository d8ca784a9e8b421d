"""Packing of token sequences as a cutting-stock problem.

A document longer than the capacity is cut into full pieces, half a piece if
more than that is left, and a tail. The
histogram of piece lengths - at most ``capacity`` numbers, however large the
corpus is - defines a linear program: use as few sequences as possible, each
filled by a pattern of lengths. Its columns are generated: the current prices
of the lengths go into a knapsack by dynamic programming, the best pattern
joins the basis, until Farley's bound shows the solution is within
``TOLERANCE`` of the optimum. Whole multiples are kept, the few pieces left
over are packed first-fit decreasing, and the patterns' slots are given to
the pieces of each length by rank. Ranks are made in two levels (a bucket's
offset plus the rank in it), so that one very common length is not one task.

Defined cases: null and empty texts are the single id 0; repeated rows are
packed each; a null doc_id is packed like any other; an empty table gives no
rows; a special token's string in a text becomes its id, as in the tokenizers
library; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import SMALL_BYTES, lean, parallelism, save, ship
from .bpe import Cache, encode

CAPACITY = 1024
#: Id that ends every document.
END_ID = 0
#: Accepted gap between the linear program's solution and its lower bound.
TOLERANCE = 0.002
MAX_ROUNDS = 1000
#: Lengths are rounded up to multiples of this for the linear program.
UNIT = 8
#: Pieces up to this length are left out of the program and fill what it leaves open.
FILLER = 64


@functools.lru_cache(4)
def json_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ids of a byte-level BPE file of the ``tokenizers`` library.

    Its ids follow the order of merges, so they also rank the pairs.
    """
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    added = {t["content"] for t in data.get("added_tokens", [])}
    vocab = {w: i for w, i in data["model"]["vocab"].items() if w not in added}
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    return {bytes(byte[c] for c in word): i for word, i in vocab.items() if all(c in byte for c in word)}


@functools.lru_cache(4)
def json_cache(path: str) -> Cache:
    """Pieces to their ids as bytes; a piece not seen before is merged by the tiktoken library."""
    core = tiktoken.Encoding("byte_bpe", pat_str=r"\S+|\s+", mergeable_ranks=json_ranks(path), special_tokens={})._core_bpe
    return Cache(lambda piece: np.array(core.encode_single_piece(piece.encode()), "<u4").tobytes())


@functools.lru_cache(4)
def json_marks(path: str) -> tuple[re.Pattern | None, dict[str, bytes]]:
    """Pattern and ids (as bytes) of the strings that the file adds to its vocabulary.

    They are found in a text before it is split, the longest first.
    """
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("an added token takes or needs its surroundings")
    ids = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
    return (re.compile("|".join(map(re.escape, sorted(ids, key=len, reverse=True)))) if ids else None), ids


def document_ids(texts: list[str | None], path: str) -> Iterator[bytes]:
    """Each text's ids as the tokenizer gives them, with the end id, as little-endian unsigned 32-bit integers."""
    end = np.array([END_ID], "<u4").tobytes()
    pattern, ids = json_marks(path)
    runs: list[list[str]] = []  # what lies between the marks of each text
    marks: list[list[str]] = []
    for t in texts:
        found = pattern.findall(t) if pattern and t else []
        runs.append(pattern.split(t) if found else [t or ""])
        marks.append(found)
    made = encode((x for r in runs for x in r), json_cache(path))
    for found in marks:
        parts = list(next(made))
        for m in found:
            parts += [ids[m], *next(made)]
        parts.append(end)
        yield b"".join(parts)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Full pieces, half a piece if more than that is left, and the tail, so that tails combine well."""
    out = [(s, s + capacity) for s in range(0, n - capacity + 1, capacity)]
    s, half = len(out) * capacity, capacity // 2
    if n - s > half:
        out.append((s, s + half))
        s += half
    return [*out, (s, n)] if n > s else out


def cut(path: str, capacity: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            ids: list[bytes] = []
            for doc, data in zip(b.column(0).to_pylist(), document_ids(b.column(1).to_pylist(), path), strict=True):
                n = len(data) // 4
                for s, e in cuts(n, capacity):
                    part = data[4 * s : 4 * e]
                    rows.append((doc, s, e - s, zlib.crc32(part), n))
                    ids.append(part)
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            if with_ids:
                cols.append(pa.array(ids, pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(cols)])

    return lean(run)


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern of (sorted) lengths, with repetition, that fits."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    reach = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        k = reach[c]
        if k:
            v = best[c - lengths[:k]] + prices[:k]
            i = int(v.argmax())
            best[c], took[c] = v[i], i
        if best[c - 1] > best[c] or not k:
            best[c], took[c] = best[c - 1], -1
    pattern, c = np.zeros(len(lengths)), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= lengths[took[c]]
    return float(best[capacity]), pattern


def patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Near-optimal patterns (rows over lengths) and how often to use each, by column generation."""
    m = len(lengths)
    if not m:
        return np.zeros((0, 0)), np.zeros(0)
    basis = np.diag((capacity // lengths).astype(float))  # each column a pattern; first: one length alone
    inverse = np.diag(1 / np.diag(basis))
    use = inverse @ demand
    bound = lengths @ demand / capacity
    for _ in range(MAX_ROUNDS):
        prices = np.maximum(inverse.sum(0), 0)
        value, column = knapsack(lengths, prices, capacity)
        total = use.sum()
        bound = max(bound, prices @ demand / value)
        if value <= 1 + 1e-9 or total - bound <= TOLERANCE * total:
            break
        step = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, use / step, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        use -= ratio[out] * step
        use[out] = ratio[out]
        basis[:, out] = column
    return basis.T, np.maximum(use, 0)


def _exact(shape: np.ndarray, n: int, classes: np.ndarray, lengths: np.ndarray, kind: np.ndarray, left: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """``n`` uses of a pattern of classes as patterns of lengths, taken off ``left``.

    Each slot of the pattern runs through its class's lengths; wherever one of
    them is used up, a new pattern begins.
    """
    slots = np.repeat(np.flatnonzero(shape), shape[shape > 0])
    runs = []
    for c in slots:
        members = np.flatnonzero(kind == classes[c])[::-1]
        need, run = n, []
        for i in members.tolist():
            k = int(min(need, left[i]))
            if k:
                run.append((i, k))
                left[i] -= k
                need -= k
            if not need:
                break
        runs.append(run)
    out, done = [], 0
    at = [[i, k] for i, k in (r[0] for r in runs)]
    where = [0] * len(runs)
    while done < n:
        k = min(x[1] for x in at)
        pattern = np.zeros(len(lengths), np.int64)
        for x in at:
            pattern[x[0]] += 1
            x[1] -= k
        out.append((pattern, k))
        done += k
        for s, x in enumerate(at):
            if not x[1] and done < n:
                where[s] += 1
                x[0], x[1] = runs[s][where[s]]
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, unit: int = UNIT) -> tuple[list[tuple], int]:
    """Slots for the pieces of each length below ``capacity``.

    Rows (length, from_rank, to_rank, first sequence, pieces of that length
    per sequence), and the number of sequences.
    """
    lengths = np.array(sorted(k for k in histogram if k < capacity), np.int64)
    left = np.array([histogram[k] for k in lengths.tolist()], np.int64)
    # the program is over classes of lengths; a class's pieces are given out from the longest on
    kind = -(-lengths // unit)
    classes = np.unique(kind[lengths > FILLER])
    demand = np.array([left[kind == c].sum() for c in classes.tolist()], np.int64)
    shapes, use = patterns(classes, demand.astype(float), capacity // unit)
    chosen: list[tuple[np.ndarray, int]] = []
    for i in np.argsort(-use):
        shape = np.round(shapes[i]).astype(np.int64)
        has = shape > 0
        n = int(min(np.floor(use[i] + 1e-6), (demand[has] // shape[has]).min())) if has.any() else 0
        if n > 0:
            demand -= n * shape
            chosen += _exact(shape, n, classes, lengths, kind, left)
    open_ = [(capacity - int(shape @ lengths), shape, n) for shape, n in chosen]
    for i in range(len(lengths) - 1, -1, -1):
        while left[i]:
            size = lengths[i]
            fit = [k for k, x in enumerate(open_) if x[0] >= size]
            if fit:
                room, shape, n = open_.pop(min(fit, key=lambda k: open_[k][0]))  # the tightest
            else:
                room, shape, n = capacity, np.zeros(len(lengths), np.int64), int(left[i]) // int(capacity // size) or 1
            used = min(n, int(left[i]))
            times = max(1, min(room // size, int(left[i]) // used))
            more = shape.copy()
            more[i] += times
            left[i] -= used * times
            open_.append((room - int(size * times), more, used))
            if used < n and shape.any():
                open_.append((room, shape, n - used))
    chosen = [(shape, n) for _, shape, n in open_]
    rows, rank, sequence = [], np.zeros(len(lengths), np.int64), 0
    for shape, n in chosen:
        for i in np.flatnonzero(shape):
            rows.append((int(lengths[i]), int(rank[i]), int(rank[i] + n * shape[i]), sequence, int(shape[i])))
            rank[i] += n * shape[i]
        sequence += n
    return rows, sequence


def ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """Adds ``rank``, 0.. among the pieces of each length."""
    pieces = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    sizes = pieces.groupBy("length", "_b").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("length", "_b", before.alias("_o"))
    own = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "start", "ids_crc32")) - 1
    return pieces.withColumn("_n", own).join(offsets, ["length", "_b"]).withColumn("rank", F.col("_n") + F.col("_o")).drop("_b", "_n", "_o")


def pack(spark: SparkSession, docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) of every piece."""
    ship(spark, SMALL_BYTES)
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut(path, capacity, with_ids), kind)
    pieces, _ = save(spark, pieces, "op6-pieces")
    # at most ``capacity`` rows
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots, used = plan(histogram, capacity)
    table = spark.createDataFrame(slots or [(-1, 0, 0, 0, 1)], "length long, lo long, hi long, first long, per long")
    every = ranked(pieces, parallelism(spark))
    whole = every.where(F.col("length") == capacity).withColumn("sequence_id", F.col("rank") + used)
    fits = (F.col("p.length") == F.col("t.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    tails = every.where(F.col("length") < capacity).alias("p").join(F.broadcast(table).alias("t"), fits)
    tails = tails.select("p.*", (F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("per"))).alias("sequence_id"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
    out = whole.withColumn("offset", F.lit(0).cast("long")).unionByName(tails)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids, "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
