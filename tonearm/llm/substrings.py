"""Removal of repeated 100-byte strings across whole documents.

A byte goes if a 100-byte string over it also starts earlier (smaller doc_id,
or earlier in the same document). Three steps find those strings exactly:

1. Every text is cut into runs of neighbouring strings with one common anchor
   (``pieces``). Equal strings always have equal anchors, so only runs with
   equal anchors need comparing, and a run whose whole text came earlier is
   repeated in full. Here 128 bits of two independent hashes stand for the
   bytes; step 2 compares the bytes themselves.
2. What is left are first runs whose anchor also occurs in other text. They
   are dealt by anchor and each task builds the Burrows-Wheeler transform and
   common prefixes of its strings column by column (``bwt.collection``); its
   external files are Spark's sorted shuffle files, read once and in order.
   A common prefix of 100 is a repeated string. Anchors with more runs than
   ``HOT`` are not gathered: their strings are ranked by hash instead.
3. The spans go back to the documents and are cut out.

Defined cases: null and empty texts have no bytes; equal rows (id and text)
count as one document; a null doc_id comes first; rows that share an id but
not the text are ordered by the text's SHA-256; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import SMALL_BYTES, drop, lean, save, ship
from .bwt import collection
from .bytesops import Rolling, blocks, mix, second, text_bytes

#: Length of a repeated string in bytes, of the anchors inside it, and how many anchors start in one.
LENGTH, ANCHOR = 100, 32
WINDOW = LENGTH - ANCHOR + 1
#: Strings that one transform holds at least, before it ends with the anchor's last string.
COLLECTION = 2000
#: Bytes of text whose strings are hashed at once; each takes about 100 bytes meanwhile.
PART = 1 << 18
#: Anchors with more first runs than this are compared by window hashes.
HOT = 20_000
#: Largest estimated size of rows that are broadcast; beyond it joins shuffle.
BROADCAST_BYTES = 128 << 20


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least value of each ``w`` neighbours, by doubling."""
    have = 1
    while have * 2 <= w:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (w - have)], v[w - have :]) if w > have else v


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring 100-byte strings that share their anchor.

    The anchor of a string is the 32-byte slice in it with the least hash (the
    last of equals), so equal strings have equal anchors at equal places.
    Returns, per run: row, first and last start in the row, hash of the
    anchor, hash of the run's whole text.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    n = len(data)
    if n < LENGTH:
        return none
    one, two = Rolling(data), second(data)
    count = n - ANCHOR + 1
    order = mix(one.windows(ANCHOR, count)) & np.uint64(0xFFFFFFFF00000000)
    order |= np.uint64(0xFFFFFFFF) - np.arange(count, dtype=np.uint64)
    anchor = np.int64(0xFFFFFFFF) - (sliding_min(order, WINDOW) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    change = np.ones(len(anchor), bool)
    change[1:] = anchor[1:] != anchor[:-1]
    starts = offsets[:-1][sizes >= LENGTH]
    change[starts] = True
    first = np.flatnonzero(change)
    row = np.searchsorted(offsets, first, "right") - 1
    last = np.append(first[1:], len(anchor)) - 1
    last = np.minimum(last, offsets[row + 1] - LENGTH)
    fits = last >= first
    first, last, row = first[fits], last[fits], row[fits]
    at = anchor[first]
    base = offsets[row]
    return row, first - base, last - base, mix(one(at, at + ANCHOR)), mix(two(first, last + LENGTH) + (last - first).astype(np.uint64))


@lean
def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        ids = b.column(0).to_numpy(zero_copy_only=False)
        parts = [(lo, *pieces(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])) for lo, hi in blocks(offsets, PART)]
        if not parts:
            continue
        row, s, e, anchor, piece = (np.concatenate(x) for x in zip(*((p[1] + p[0], *p[2:]) for p in parts), strict=True))
        # of equal pieces in one batch only the first is sent on to be compared; a hot text costs one row a batch
        order = np.lexsort((s, ids[row], piece))
        again = np.zeros(len(row), bool)
        same = (piece[order][1:] == piece[order][:-1]) & (anchor[order][1:] == anchor[order][:-1])
        moved = (ids[row[order]][1:] != ids[row[order]][:-1]) | (s[order][1:] != s[order][:-1])
        run = np.concatenate(([0], np.cumsum(~same)))  # rows of one piece share a number
        lead = np.concatenate(([0], np.cumsum(~same | moved)))
        first = lead[np.searchsorted(run, run)]
        again[order] = lead != first
        # later rows need no comparing: a key of their own keeps them apart from all others
        piece[again] = mix(mix(ids[row][again].astype(np.uint64)) + s[again].astype(np.uint64))
        cols = (ids[row], s.astype(np.int32), (e - s).astype(np.int32), anchor.view(np.int64), piece.view(np.int64), again)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["ord", "s", "more", "anchor", "piece", "again"])


_PIECES = "ord long, s int, more int, anchor long, piece long, again boolean"


def numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with ``ord``, a number in the order of (doc_id, text).

    Where doc_id is unique it is that number. Otherwise distinct pairs of id
    and text are sorted and numbered; nulls come first, equal rows share one.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        return docs.withColumn("ord", F.col("doc_id"))
    keys = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_sha")).distinct().sort(F.asc_nulls_first("doc_id"), "_sha")
    pairs = keys.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    keys, _ = save(spark, spark.createDataFrame(pairs, "_id long, _sha string, ord long"), "op5-ord")
    docs = docs.withColumn("_h", F.sha2(F.coalesce("text", F.lit("")), 256))
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_sha"))).drop("_id", "_h", "_sha")


@lean
def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each asked piece, from rows of (ord, text, asked)."""
    for b in batches:
        out: list[tuple] = []
        for o, text, asked in zip(*(c.to_pylist() for c in b.columns), strict=True):
            data = text.encode()
            out += [(r["anchor"], o, r["s"], data[r["s"] : r["s"] + r["more"] + LENGTH]) for r in asked]
        for k in range(0, len(out), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 20_000], strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["anchor", "ord", "s", "text"])


def repeated_windows(text: np.ndarray, offsets: np.ndarray, ords: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ord, start) of 100-byte strings that also start earlier in this collection.

    A hash of each window screens out strings that share none and trims the
    others; what repeats is then read off the common prefixes of the
    collection's sorted suffixes.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = len(text) - LENGTH + 1
    if count < 1:
        return none
    h = Rolling(text).windows(LENGTH, count)
    owner = np.repeat(np.arange(len(ords)), np.diff(offsets))[:count]
    inside = np.flatnonzero(np.arange(count) + LENGTH <= offsets[owner + 1])
    order = inside[np.argsort(h[inside], kind="stable")]
    equal = h[order][1:] == h[order][:-1]
    shared = np.sort(order[np.concatenate((equal, [False])) | np.concatenate(([False], equal))])
    if not len(shared):
        return none
    own = owner[shared]
    cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    who, lo, hi = own[cut], shared[cut], shared[np.append(cut[1:], len(shared)) - 1] + LENGTH
    trimmed = np.concatenate([text[a:b] for a, b in zip(lo, hi, strict=True)])
    bounds = np.concatenate(([0], np.cumsum(hi - lo)))
    i, depth, lcp = collection(trimmed, bounds)
    key_ord, key_start = ords[who[i]], starts[who[i]] + (hi[i] - depth) - offsets[who[i]]
    group = np.cumsum(lcp < LENGTH)
    long = np.flatnonzero(depth >= LENGTH)
    group, key_ord, key_start = group[long], key_ord[long], key_start[long]
    order = np.lexsort((key_start, key_ord, group))
    group, key_ord, key_start = group[order], key_ord[order], key_start[order]
    lead = np.searchsorted(group, group)  # the earliest of each group
    later = (key_ord != key_ord[lead]) | (key_start != key_start[lead])
    return key_ord[later], key_start[later]


def _runs(o: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    """Neighbouring starts become runs."""
    order = np.lexsort((s, o))
    o, s = o[order], s[order].astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (s[1:] > s[:-1] + 1)))) if len(o) else np.zeros(0, np.int64)
    last = s[np.append(cut[1:], len(s)) - 1] if len(o) else s
    return pa.RecordBatch.from_arrays([pa.array(o[cut]), pa.array(s[cut].astype(np.int32)), pa.array((last - s[cut]).astype(np.int32))], ["ord", "s", "more"])


@lean
def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, taken in collections of whole anchor groups."""
    held: list[tuple] = []

    def done(rows: list[tuple]) -> pa.RecordBatch:
        o, s = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
        offsets = np.concatenate(([0], np.cumsum([len(r[3]) for r in rows])))
        return _runs(*repeated_windows(np.frombuffer(b"".join(r[3] for r in rows), np.uint8), offsets, o, s))

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if len(held) >= COLLECTION and row[0] != held[-1][0]:
                yield done(held)
                held = []
            held.append(row)
    if held:
        yield done(held)


def later_here(o: np.ndarray, s: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which rows have the hashes of a row before them in (o, s); rows of one place have none before each other."""
    order = np.lexsort((s, o, h2, h1))
    o, s, h1, h2 = o[order], s[order], h1[order], h2[order]
    start = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))) if len(o) else np.zeros(0, np.int64)
    lead = np.repeat(start, np.diff(np.append(start, len(o))))
    out = np.zeros(len(o), bool)
    out[order] = (o != o[lead]) | (s != s[lead])
    return out


@lean
def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each 100-byte string of each piece by two hashes, for anchors with very many pieces.

    Of equal strings in one batch only the first is still to be ranked; the
    others get keys of their own, so a string that is everywhere costs one row a batch.
    """
    for b in batches:
        o, s, text = b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.int64), b.column(3).to_pylist()
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in text])))
        data = np.frombuffer(b"".join(text), np.uint8)
        own = np.repeat(np.arange(len(text)), np.diff(offsets) - LENGTH + 1)
        at = np.arange(len(own)) + own * (LENGTH - 1)
        h1, h2, row, start = Rolling(data)(at, at + LENGTH).copy(), second(data)(at, at + LENGTH), o[own], s[own] + at - offsets[own]
        again = later_here(row, start, h1, h2)
        h1[again] = mix(mix(row[again].astype(np.uint64)) + start[again].astype(np.uint64))
        cols = (h1.view(np.int64), h2.view(np.int64), row, start.astype(np.int32), again)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h1", "h2", "ord", "s", "again"])


def _with(spark: SparkSession, docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Join rows that are at most one per document; broadcast when few, else by shuffle."""
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    small = 40 * size["n"] + size["b"] <= BROADCAST_BYTES
    rows = rows.drop("bytes")
    return docs.join(F.broadcast(rows) if small else rows, "ord", how)


def removed_runs(spark: SparkSession, docs: DataFrame, made: list[str]) -> DataFrame:
    """(ord, s, more): the strings starting in [s, s + more] also start earlier."""
    found = docs.where(F.octet_length("text") >= LENGTH).select("ord", "text").mapInArrow(_pieces, _PIECES)
    rank = F.rank().over(Window.partitionBy("piece", "anchor").orderBy("ord", "s"))
    ranked = found.withColumn("later", F.col("again") | (rank > 1))
    ranked, p = save(spark, ranked.select("ord", "s", "more", "anchor", "later"), "op5-pieces")
    made.append(p)
    whole = ranked.where("later").select("ord", "s", "more")
    heads = ranked.where("not later").drop("later")
    many, p = save(spark, heads.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "op5-anchors")
    made.append(p)
    few = many.count() * 16 <= BROADCAST_BYTES
    asked = heads.join(F.broadcast(many) if few else many, "anchor")
    asked = asked.groupBy("ord").agg(F.collect_list(F.struct("anchor", "s", "more")).alias("asked"))
    asked, p = save(spark, asked.withColumn("bytes", 40 * F.size("asked")), "op5-asked")
    made.append(p)
    texts = _with(spark, docs.select("ord", "text"), asked, "inner").select("ord", "text", "asked").mapInArrow(_contexts, "anchor long, ord long, s int, text binary")
    hot = many.where(F.col("n") > HOT)
    if hot.isEmpty():
        near, wide = texts, None
    else:
        texts, p = save(spark, texts, "op5-contexts")
        made.append(p)
        near, wide = texts.join(hot, "anchor", "left_anti"), texts.join(hot, "anchor", "left_semi")
    runs = near.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_repeats, "ord long, s int, more int")
    if wide is not None:
        w = wide.mapInArrow(_windows, "h1 long, h2 long, ord long, s int, again boolean").withColumn("later", F.col("again") | (F.rank().over(Window.partitionBy("h1", "h2").orderBy("ord", "s")) > 1))
        runs = runs.union(w.where("later").select("ord", "s", F.lit(0).alias("more")))
    return whole.union(runs)


@lean
def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge each document's runs into maximal removed spans, as pairs of 64-bit integers."""
    for b in batches:
        out = []
        for runs in b.column(1).to_pylist():
            x = np.array([(r["s"], r["s"] + r["more"] + LENGTH) for r in runs], np.int64)
            x = x[np.argsort(x[:, 0])]
            top = np.maximum.accumulate(x[:, 1])
            cut = np.flatnonzero(np.concatenate(([True], x[1:, 0] > top[:-1])))
            out.append(np.stack([x[cut, 0], top[np.append(cut[1:], len(x)) - 1]], 1).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array([len(x) for x in out], pa.int64())], ["ord", "spans", "bytes"])


@lean
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept, rows = [], []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            data = (text or "").encode()
            x = np.frombuffer(spans or b"", np.int64)
            if len(x):
                edges = [0, *x.tolist(), len(data)]
                data = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            gone = int((x[1::2] - x[::2]).sum())
            rows.append((len(data) + gone, gone, len(x) // 2))
            kept.append(data)
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
        digest = pa.array([hashlib.sha256(d).hexdigest() for d in kept], pa.string())
        text = pa.array([d.decode(errors="ignore") for d in kept], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), *cols, digest, text], ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


_CUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def remove_repeats(spark: SparkSession, docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: n_bytes, n_removed, n_spans, kept_sha256, kept, and its own columns under ``row``.

    ``row`` has the columns of ``carry`` (default: all but text).

    ``kept`` is the remaining text; where a removed run starts or ends inside
    a character, the cut character's leftover bytes are not in ``kept`` (they
    are in kept_sha256).
    """
    ship(spark, SMALL_BYTES)
    made: list[str] = []
    row = F.struct(*[F.col(f"`{c}`") for c in carry or [c for c in docs.columns if c != "text"]]).alias("row")
    kind = docs.select(row).schema["row"].dataType.simpleString()
    docs = numbered(spark, docs.select(row, "doc_id", "text"))
    runs = removed_runs(spark, docs.select("ord", "text"), made)
    spans = runs.groupBy("ord").agg(F.collect_list(F.struct("s", "more")).alias("runs")).mapInArrow(_spans, "ord long, spans binary, bytes long")
    spans, _ = save(spark, spans, "op5-spans")
    drop(spark, *made)
    return _with(spark, docs.select("ord", "row", "text"), spans, "left").select("row", "text", "spans").mapInArrow(_cut, f"row {kind}, {_CUT}")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
