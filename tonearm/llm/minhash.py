"""SuperMinHash near-duplicate groups.

Every document becomes the set of its distinct 5-word shingles (64-bit
hashes). SuperMinHash gives it ``REGISTERS`` correlated minima: round ``j``
lets every element draw the ``j``-th entry of its own random permutation of
the registers with a value in [j, j+1), so a document stops as soon as each
of its registers is filled. Registers are cut into bands; documents that
share a band are candidates, candidates are confirmed on their full sets, and
the confirmed links go through a distributed union-find.

Nothing is compared within a group as all pairs: equal sets are one class
from the start, a small bucket compares its few members, a large one compares
each member with a few leaders, and only members that have not joined their
bucket's main component by then are looked up against the bucket in blocks.

Defined cases: null and empty texts have no shingles, are linked with nothing
and stay; fewer than five words are one shingle; rows with a null doc_id can
link others but have a null component unless a partner has an id; repeated
rows get equal answers; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import drop, save, ship
from .components import components

from .bytesops import blocks, mix, text_bytes, word_hashes

WORDS, REGISTERS, BANDS = 5, 128, 32
#: 100 * intersection >= PERCENT * union links two documents.
PERCENT = 75
#: Buckets up to this size compare all their members; larger ones use leaders.
SMALL = 8
#: A member meets the leaders of its so many largest buckets; what they leave open is compared in full.
LED = 6
#: Estimates below this similarity (five standard deviations under the
#: threshold with 128 registers) are not confirmed.
FLOOR = 0.56
#: Hashes in the sets of one side of two blocks that are compared at once.
SIDE = 100_000
#: Ids up to this many (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and n + 1 offsets."""
    w, at = word_hashes(data, offsets)
    n = len(offsets) - 1
    count = np.diff(at)
    if len(w) >= words:
        h = np.zeros(len(w) - words + 1, np.uint64)
        for j in range(words):
            h += mix(w[j : len(w) - words + 1 + j] * _C[j % 5] + np.uint64(j))
        h = mix(h)
    out, sizes = [], np.zeros(n + 1, np.int64)
    for i in range(n):
        c = count[i]
        if c >= words:
            s = np.sort(h[at[i] : at[i + 1] - words + 1])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif c:
            s = np.array([c], np.uint64)
            for x in w[at[i] : at[i + 1]]:
                s = mix(s * _C[0] + x)
        else:
            continue
        out.append(s)
        sizes[i + 1] = len(s)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.cumsum(sizes)


def signatures(h: np.ndarray, at: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """SuperMinHash of each set: (sets, m) of ``round * 2**31 + fraction``.

    All sets advance round by round; a set leaves when no register is empty,
    as later rounds only draw larger values.
    """
    sets = len(at) - 1
    sig = np.full(sets * m, _EMPTY)
    owner = np.repeat(np.arange(sets), np.diff(at))
    el = np.arange(len(h))
    moved: list[tuple[np.ndarray, np.ndarray]] = []  # swaps so far: position and what stands there now
    perm = None
    with np.errstate(over="ignore"):
        for j in range(m):
            if not len(el):
                break
            x = mix(h[el] + _C[1] * np.uint64(j + 1))
            k = (j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)).astype(np.int64)
            if perm is not None:
                rows = np.arange(len(el))
                register = perm[rows, k].astype(np.int64)
                perm[rows, k] = perm[:, j]
            else:
                register, front = k.copy(), np.full(len(el), j)
                for at_k, value in moved:
                    register = np.where(k == at_k, value, register)
                    front = np.where(j == at_k, value, front)
                moved.append((k, front))
            np.minimum.at(sig, owner[el] * m + register, (np.uint64(j) << np.uint64(31)) | (x >> np.uint64(33)))
            alive = (sig.reshape(sets, m) == _EMPTY).any(1)[owner[el]]
            el = el[alive]
            if perm is not None:
                perm = perm[alive]
            elif j < 3:
                moved = [(a[alive], b[alive]) for a, b in moved]
            else:
                perm = np.broadcast_to(np.arange(m, dtype=np.uint8), (len(el), m)).copy()
                for a, b in moved:
                    perm[np.arange(len(el)), a[alive]] = b[alive]
                moved = []
    return sig.reshape(sets, m)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        for lo, hi in blocks(offsets):
            h, at = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            sizes = np.diff(at)
            short = (mix(signatures(h, at)) & np.uint64(0xFFFF)).astype("<u2")
            sig = [short[i].tobytes() if sizes[i] else None for i in range(hi - lo)]
            ids = [b.column(c).slice(lo, hi - lo) for c in (0, 2)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(sizes), pa.array(class_ids(h, at)), pa.array(sig, pa.binary())], ["doc_id", "hash", "n_shingles", "cid", "sig"])


def class_ids(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit name per set, from two sums over its spread hashes; 0 for an empty set."""
    cid, full = np.zeros(len(at) - 1, np.int64), np.flatnonzero(np.diff(at))
    if len(h):
        sums = mix(np.add.reduceat(mix(h ^ _C[2]), at[:-1][full]) + _C[3] * np.add.reduceat(mix(h ^ _C[4]), at[:-1][full]))
        cid[full] = sums.view(np.int64)
    return cid


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, n_shingles, cid (class of equal sets; 0: none) and signature of every text."""
    return _hashed(docs).mapInArrow(_sign, "doc_id long, hash long, n_shingles long, cid long, sig binary")


def _like(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Share of equal registers for each pair of rows."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(len(c), -1) for c in (x, y))
    return (x == y).mean(1) if len(x) else np.zeros(0)


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.select([0, 1]).filter(pa.array(_like(b.column(2), b.column(3)) >= FLOOR, pa.bool_()))


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of distinct candidate pairs, those whose signatures agree enough to be worth confirming."""
    a = reps.select(F.col("cid").alias("a"), F.col("sig").alias("x"))
    b = reps.select(F.col("cid").alias("b"), F.col("sig").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(_estimate, "a long, b long")


def _grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two blocks of one bucket: the links between members of different components.

    A pair is looked at only in the first band that it shares, and no more
    once its components have met here; what is left is compared on full sets.
    """

    def side(rows: list[dict]) -> dict:
        sig = np.frombuffer(b"".join(r["sig"] for r in rows), "<u2").reshape(len(rows), -1)
        sets = [np.array(r["hashes"], np.int64) for r in rows]
        at = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
        bands = np.ascontiguousarray(sig).view(f"V{2 * REGISTERS // BANDS}").view("<u8").reshape(len(rows), -1)
        return {"cid": np.array([r["cid"] for r in rows], np.int64), "root": np.array([r["root"] for r in rows], np.int64), "sig": sig, "bands": bands, "sets": sets, "all": np.concatenate(sets), "at": at}

    for b in batches:
        for band, left, right in zip(*(c.to_pylist() for c in b.columns), strict=True):
            x, y = side(left), side(right)
            xr, yr = x["root"].copy(), y["root"].copy()
            out: list[tuple[int, int]] = []
            for i in range(len(left)):
                same = y["bands"] == x["bands"][i]
                near = np.flatnonzero((same.argmax(1) == band) & same[:, band] & (yr != xr[i]) & ((y["sig"] == x["sig"][i]).mean(1) >= FLOOR))
                if not len(near):
                    continue
                mine = x["sets"][i]
                took = np.concatenate([y["all"][y["at"][k] : y["at"][k + 1]] for k in near])
                found = np.searchsorted(mine, took)
                hit = mine[np.minimum(found, len(mine) - 1)] == took
                sizes = y["at"][near + 1] - y["at"][near]
                both = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
                for k in near[100 * both >= PERCENT * (len(mine) + sizes - both)]:
                    if yr[k] != xr[i]:
                        out.append((int(x["cid"][i]), int(y["cid"][k])))
                        old, new = yr[k], xr[i]
                        xr[xr == old] = new
                        yr[yr == old] = new
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in out], pa.int64()), pa.array([max(p) for p in out], pa.int64())], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = text_bytes(b.column(0))
        for lo, hi in blocks(offsets):
            h, at = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            sets = pa.LargeListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(class_ids(h, at)), sets.cast(pa.list_(pa.int64()))], ["cid", "hashes"])


def _sets_of(spark: SparkSession, docs: DataFrame, reps: DataFrame, ids: DataFrame, made: list[str]) -> DataFrame:
    """(cid, hashes): the sorted shingle sets of the classes named in ``ids``.

    They are made again from one text of each class; sets of all other
    documents are never stored.
    """
    wanted, p = save(spark, reps.join(ids.distinct(), "cid", "left_semi").select("one.*"), "op7-wanted")
    made.append(p)
    few = wanted.count() <= BROADCAST_ROWS
    w = (F.broadcast(wanted) if few else wanted).select(F.col("hash").alias("h"), F.col("doc_id").alias("d"))
    texts = _hashed(docs).alias("t")
    texts = texts.join(w, (F.col("h") == F.col("t.hash")) & F.col("d").eqNullSafe(F.col("t.doc_id")), "left_semi").select("text")
    # rows repeated with id and text give the same set more than once
    sets, p = save(spark, texts.distinct().mapInArrow(_sets, "cid long, hashes array<long>"), "op7-sets")
    made.append(p)
    return sets


def _confirmed(spark: SparkSession, docs: DataFrame, reps: DataFrame, pairs: DataFrame, made: list[str]) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    sets = _sets_of(spark, docs, reps, pairs.select(F.explode(F.array("a", "b")).alias("cid")), made)
    a = sets.select(F.col("cid").alias("a"), F.col("hashes").alias("x"))
    b = sets.select(F.col("cid").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    good = pairs.join(a, "a").join(b, "b").where(100 * both >= PERCENT * (F.size("x") + F.size("y") - both))
    good, p = save(spark, good.select("a", "b"), "op7-links")
    made.append(p)
    return good


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _small_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of buckets with at most ``SMALL`` members."""
    g = rows.groupBy("key").agg(F.sort_array(F.collect_set("cid")).alias("m"))
    g = g.select("m", F.posexplode("m").alias("i", "x"))
    return g.select("x", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("y")).select(*_pair("x", "y"))


def _rest(spark: SparkSession, docs: DataFrame, reps: DataFrame, large: DataFrame, roots: DataFrame, made: list[str]) -> DataFrame:
    """Links of large buckets that leaders left open.

    Members outside their bucket's main component meet all members of other
    components, block by block; each block's members are stored once, and only
    links that join two components come out.
    """
    members = large.select("cid", "buckets").join(roots.select(F.col("vertex").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    members = members.join(reps.select("cid", "n_shingles"), "cid")
    rows = members.select("cid", "root", "n_shingles", F.explode("buckets").alias("b")).select("cid", "root", "n_shingles", "b.key", "b.band")
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("parts"), F.sum("size").alias("size"))
    rows, p = save(spark, rows.join(main.where("parts > 1").drop("parts"), "key").join(reps.select("cid", "sig"), "cid"), "op7-open")
    made.append(p)
    if rows.isEmpty():
        return rows.select(F.col("cid").alias("a"), F.col("cid").alias("b")).limit(0)
    rows = rows.join(_sets_of(spark, docs, reps, rows.select("cid"), made), "cid")
    # as many blocks as keep the sets of each near SIDE hashes
    block = F.pmod(F.xxhash64("cid"), F.ceil(F.col("size") / SIDE))
    member = F.struct("cid", "root", "sig", "hashes")
    right = rows.groupBy("key", block.alias("r")).agg(F.collect_list(member).alias("right"))
    left = rows.where("root <> main").groupBy("key", "band", block.alias("l")).agg(F.collect_list(member).alias("left"))
    found, p = save(spark, left.join(right, "key").select("band", "left", "right").mapInArrow(_grid, "a long, b long").distinct(), "op7-rest")
    made.append(p)
    return found


def links(spark: SparkSession, docs: DataFrame, signed: DataFrame, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """Confirmed links (a, b) between classes of equal sets, and the classes (cid, sig, doc_id, one)."""
    reps = signed.where("n_shingles > 0").groupBy("cid").agg(F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"), F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "hash")).alias("one"))
    reps, p = save(spark, reps, "op7-classes")
    made.append(p)
    width = REGISTERS // BANDS * 2
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 1 + i * width, width)) for i in range(BANDS)])
    rows = reps.select("cid", F.posexplode(keys).alias("band", "key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("n > 1")
    shared, p = save(spark, rows.join(counts, "key"), "op7-buckets")
    made.append(p)
    # one row per class in large buckets, with its at most BANDS buckets, the largest first
    bucket = F.struct("n", "key", "band", "lo", "hi")
    large, p = save(spark, shared.where(F.col("n") > SMALL).groupBy("cid").agg(F.sum("n").alias("weight"), F.sort_array(F.collect_list(bucket), False).alias("buckets")), "op7-large")
    made.append(p)
    # the member that is in the most and largest buckets is near the middle of its group
    led = large.select("cid", "weight", F.explode(F.slice("buckets", 1, LED)).alias("b")).select("cid", "weight", "b.key", "b.lo", "b.hi")
    middle = led.groupBy("key").agg(F.max(F.struct("weight", "cid"))["cid"].alias("mid"))
    star = led.join(middle, "key").select("cid", F.explode(F.array("lo", "hi", "mid")).alias("y")).where("cid <> y")
    pairs = _small_pairs(shared.where(F.col("n") <= SMALL)).union(star.select(*_pair("cid", "y"))).distinct()
    likely, p = save(spark, _likely(pairs, reps), "op7-likely")
    made.append(p)
    good = _confirmed(spark, docs, reps, likely, made)
    if not large.isEmpty():
        roots, p = components(spark, good)
        made.extend(p)
        good = good.union(_rest(spark, docs, reps, large, roots, made))
    return good, reps


def groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, and its text's hash."""
    ship(spark)
    made: list[str] = []
    signed, _ = save(spark, sign(docs), "op7-signed")
    good, reps = links(spark, docs, signed, made)
    roots, p = components(spark, good)
    made.extend(p)
    tree = reps.select("cid", "doc_id").join(roots.select(F.col("vertex").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = tree.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found, _ = save(spark, tree.join(least, "root").select("cid", "component_id"), "op7-found")
    drop(spark, *made)
    full = signed.where("n_shingles > 0").join(found, "cid").select("doc_id", "n_shingles", "component_id", "hash")
    none = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "hash")
    out = full.union(none)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "hash")


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without all but one document of each group of near-duplicates.

    Documents without words all stay; of rows with equal id and text one
    stays; other columns keep whatever names they have.
    """
    found, _ = save(spark, groups(spark, docs).where("kept").groupBy("doc_id", "hash").agg(F.count("*").alias("n")), "op7-kept")
    size = found.agg(F.count("*").alias("rows"), F.max("n").alias("most")).first()
    keys = found.select("doc_id", "hash")
    keys = (F.broadcast(keys) if size["rows"] <= BROADCAST_ROWS else keys).alias("kept_keys")
    same = F.col("kept_docs.doc_id").cast("long").eqNullSafe(F.col("kept_keys.doc_id")) & (F.xxhash64(F.col("kept_docs.text").cast("string")) == F.col("kept_keys.hash"))
    out = docs.alias("kept_docs").join(keys, same, "left_semi")
    # only where whole rows repeat is there anything left to drop
    return out.dropDuplicates(["doc_id", "text"]) if (size["most"] or 0) > 1 else out


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("hash")
