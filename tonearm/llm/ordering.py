"""Training-order materialisation: token shards in a keyed random order.

Every document becomes sequences of at most ``LENGTH`` ids. A sequence's index
(document number times the most sequences a document can have, plus its place
in the document) goes through a keyed Feistel network; results outside the
domain are fed back until they fall inside (cycle-walking), which makes it a
permutation of exactly that domain. The result is the sequence's slot. One
range partitioning by slot deals the sequences, each range writes one shard of
records of fixed stride, and a sequence's place in the global order is its
shard's first place plus its record number. A reader seeks to
``record * stride`` and can stop and resume anywhere.

Shards appear under their final name only when complete, with contents that
depend on the data and the key alone, so a repeated task replaces equal bytes.

Defined cases: null and empty texts are one sequence with the end id only;
equal rows (id and text) share a slot and lie next to each other; null ids
come first in the numbering; ids far apart (hashed ones) are numbered without
gaps first; an empty table writes no shards; token ids must be below 65,535, the
padding; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import new_path, parallelism, save, ship
from .bytesops import mix
from .packing import document_ids
from .substrings import numbered

LENGTH, ROUNDS = 512, 6
#: Fills a record after its last id; no token has it, so a record alone tells its length.
PAD_ID = 0xFFFF
#: Largest number of positions that the permutation's 64-bit arithmetic holds.
MOST_POSITIONS = 1 << 62
#: Most records of a shard, nearly.
SHARD_RECORDS = 1 << 20


def permute(index: np.ndarray, domain: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..domain-1, applied to ``index``."""
    if domain > MOST_POSITIONS:
        raise ValueError(f"a domain of {domain} positions does not fit 64 bits")
    half = max(1, (max(domain - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.uint64(key & (1 << 64) - 1) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    outside = np.flatnonzero(out >= domain)
    while len(outside):
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= domain]
    return out.astype(np.int64)


def _sequences(path: str, length: int, most: int, first: int, domain: int, key: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for ordinal, doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), document_ids(b.column(2).to_pylist(), path), strict=True):
                ids = np.frombuffer(data, "<u4")
                short = ids.astype("<u2")
                if (ids >= PAD_ID).any():
                    raise ValueError("an id does not fit 16 bits, or is the padding's")
                for k, s in enumerate(range(0, len(ids), length)):
                    rows.append((doc, k, (ordinal - first) * most + k, short[s : s + length].tobytes()))
            slots = permute(np.array([r[2] for r in rows], np.int64), domain, key)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(slots), pa.array([r[3] for r in rows], pa.binary())],
                ["doc_id", "window", "slot", "ids"],
            )

    return run


def _write(folder: str, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        part, final = f"{base}/.{uuid.uuid4().hex}", f"{base}/shard-{shard:06d}.bin"
        record, out = 0, None
        pad = np.array([PAD_ID], "<u2").tobytes()
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(part)
            ids = b.column(3).to_pylist()
            out.write(b"".join(x + pad * (length - len(x) // 2) for x in ids))
            n = len(ids)
            cols = [pa.array(np.full(n, shard)), pa.array(np.arange(record, record + n)), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
            record += n
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], ["doc_id", "window", "slot", "shard", "record", "n_tokens", "ids_crc32"])
        if out is not None:
            out.close()
            store.move(part, final)

    return run


def dense(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` with ``ord`` replaced by 0, 1, ... in its order, equal ones sharing a number; and how many there are.

    Ranges of ``ord`` are counted (one row per range), and numbered inside.
    """
    keys = docs.select("ord").distinct()
    many = parallelism(spark)
    cuts = keys.agg(F.percentile_approx("ord", [i / many for i in range(1, many)], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(c).cast("bigint") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    keys = keys.withColumn("_r", F.size(F.filter(bounds, lambda b: b <= F.col("ord"))))
    start, before = 0, []
    for r in keys.groupBy("_r").count().orderBy("_r").collect():
        before.append((r["_r"], start))
        start += r["count"]
    table = F.broadcast(spark.createDataFrame(before or [(0, 0)], "_r int, _before long"))  # a row per range
    place = F.row_number().over(Window.partitionBy("_r").orderBy("ord")) - 1 + F.col("_before")
    keys, _ = save(spark, keys.join(table, "_r").select("ord", place.cast("long").alias("_place")), "op1-places")
    return docs.join(keys, "ord").withColumn("ord", F.col("_place")).drop("_place"), start


def materialise(spark: SparkSession, docs: DataFrame, path: str, folder: str, key: int = 0, length: int = LENGTH) -> DataFrame:
    """Write the shards under ``folder`` and return their manifest, a row per sequence.

    doc_id, window (its number in the document), slot, shard, record, n_tokens,
    ids_crc32 (of its ids as 16-bit integers), place (in the global order).
    """
    ship(spark)
    docs = numbered(spark, docs)
    size = docs.agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.max(F.octet_length("text")).alias("longest"), F.sum(F.octet_length("text")).alias("bytes")).first()
    # a document has at most one id for each byte, and the end id
    most = ((size["longest"] or 0) + length) // length + 1
    first, span = size["lo"] or 0, (size["hi"] or 0) - (size["lo"] or 0) + 1
    if span * most > MOST_POSITIONS:
        # numbers far apart, as hashed ids are: documents are numbered without gaps
        docs, span = dense(spark, docs)
        first = 0
    domain = span * most
    made = docs.select("ord", "doc_id", "text").mapInArrow(_sequences(path, length, most, first, domain, key), "doc_id long, window long, slot long, ids binary")
    # slots are uniform in the domain, so equal ranges need no sampling pass over the tokens
    n = max(parallelism(spark), (size["bytes"] or 0) // (length * SHARD_RECORDS))
    width = -(-domain // n)
    dealt = made.withColumn("_r", F.expr(f"cast(slot div {width} as int)")).repartitionById(n, "_r").drop("_r")
    kind = "doc_id long, window long, slot long, shard long, record long, n_tokens long, ids_crc32 long"
    rows, _ = save(spark, dealt.sortWithinPartitions("slot", "doc_id", "window").mapInArrow(_write(folder, length), kind), "op1-manifest")
    # one row per shard
    places, start = [], 0
    for r in rows.groupBy("shard").count().orderBy("shard").collect():
        places.append((r["shard"], start))
        start += r["count"]
    table = spark.createDataFrame(places or [(-1, 0)], "shard long, first long")
    return rows.join(F.broadcast(table), "shard").withColumn("place", F.col("first") + F.col("record")).drop("first")


def read_from(folder: str, manifest: list[tuple[int, int]], place: int, count: int, length: int = LENGTH) -> np.ndarray:
    """``count`` records in training order from ``place`` on; manifest: (shard, records) in order."""
    store, base = fs.FileSystem.from_uri(folder)
    stride, out = 2 * length, []
    for shard, n in manifest:
        if place < n and count:
            take = min(count, n - place)
            with store.open_input_file(f"{base}/shard-{shard:06d}.bin") as f:
                f.seek(place * stride)
                out.append(f.read(take * stride))
            count -= take
            place = 0
        else:
            place = max(0, place - n)
    return np.frombuffer(b"".join(out), "<u2").reshape(-1, length)


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = materialise(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "shards"))
    return out.select("doc_id", "window", "slot", "place", "shard", "record", "n_tokens", "ids_crc32")
