"""Exact and near duplicates, versions and encodings, and which files to keep.

Defined cases: null contents, fingerprints and keys are in no group; equal
rows are members each; empty tables give no rows; other columns are carried
where a function returns its input's columns, else ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.music import version_key
from ..functions.text import path_depth
from ..runtime import drop, save, ship
from .graph import components, led

# Formats from best to worst, for the automatic choice and for the user's rules.
FORMAT_RANK = {"flac": 1, "wav": 2, "aiff": 3, "aif": 3, "m4a": 4, "mp3": 5, "ogg": 6, "aac": 7, "wma": 8}
CODEC_ORDER = ["flac", "wav", "aiff", "aif", "alac", "m4a", "opus", "mp3", "ogg", "aac", "wma"]
PROBES, LEAST_FRAMES, SHIFT, OVERLAP = 4, 8, 20, 8
#: Frames of two fingerprints that are compared at a time.
WINDOW = 64
#: Least similarity of copies, and the largest relative difference of their lengths.
THRESHOLD, LENGTH_TOLERANCE = 0.95, 0.12


def format_rank(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in FORMAT_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(ext)), F.lit(99))


def codec_rank(ext: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(x) for x in CODEC_ORDER]), F.lower(ext))
    return F.when(at > 0, at.cast("int")).otherwise(999)


def rank_keepers(members: DataFrame, group: str | list[str]) -> DataFrame:
    """``keeper_rank`` 1 is kept: a file with content, no alias, the best format, the largest, the shallowest, the shortest path."""
    alias = [F.coalesce("alias", F.lit(False))] if "alias" in members.columns else []
    order = [F.col("size_bytes") <= 0, *alias, format_rank(F.col("ext")), F.desc("size_bytes"), path_depth(F.col("path")), F.length("path"), F.col("path")]
    return members.withColumn("keeper_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def keepers(members: DataFrame, group: list[str]) -> DataFrame:
    """``keeper`` as by :func:`rank_keepers`, by one aggregate: groups are never gathered or sorted."""
    alias = F.coalesce("alias", F.lit(False)) if "alias" in members.columns else F.lit(False)
    order = F.struct(
        (F.col("size_bytes") <= 0).alias("a"), alias.alias("b"), format_rank(F.col("ext")).alias("c"), (-F.col("size_bytes")).alias("d"),
        path_depth(F.col("path")).alias("e"), F.length("path").alias("f"), F.col("path").alias("g"),
    )
    best = members.groupBy(*group).agg(F.min(order)["g"].alias("_best"))
    return members.join(best, group).withColumn("keeper", F.col("path") == F.col("_best")).drop("_best")


def exact_groups(docs: DataFrame, content: str, key: str) -> DataFrame:
    """Rows whose content occurs more than once, with a digest, the group's size and whether they are its first by ``key``."""
    g = docs.withColumn("digest", F.md5(content))
    many = g.groupBy("digest").agg(F.count("*").alias("n"), F.min(key).alias("_first")).where("n > 1")
    return g.join(many, "digest").withColumn("first", F.col(key) == F.col("_first")).drop("_first")


def group_sizes(members: DataFrame, group: list[str]) -> DataFrame:
    """Per group: files to remove, and megabytes they would free. The keeper counts for neither."""
    gone = ~F.col("keeper")
    return members.groupBy(*group).agg(F.count_if(gone).alias("files"), F.bround(F.sum(F.when(gone, F.col("size_bytes")).otherwise(0)) / 1048576, 2).alias("recoverable_mb"))


def summary(members: DataFrame) -> DataFrame:
    """Per method: groups, files to remove, megabytes."""
    gone = ~F.col("keeper")
    return members.groupBy("method").agg(F.count_distinct("group_id").alias("groups"), F.count_if(gone).alias("files"), F.bround(F.sum(F.when(gone, F.col("size_bytes")).otherwise(0)) / 1048576, 2).alias("recoverable_mb"))


def drop_aliases(files: DataFrame) -> DataFrame:
    """One path of each file: links go, and of equal (device, inode) all but the first path; inode 0 is no evidence."""
    real = files.where("not coalesce(is_link, false)")
    known = F.col("inode") != 0
    first = real.where(known).groupBy("device", "inode").agg(F.min("path").alias("path"))
    return real.where(~F.coalesce(known, F.lit(False))).unionByName(real.where(known).join(first, ["device", "inode", "path"], "left_semi"))


def frames(docs: DataFrame, words: int = 4) -> DataFrame:
    """A text's fingerprint: a 32-bit number of each run of four words; shorter texts than eight runs have none."""
    ship(docs.sparkSession)
    least = words * LEAST_FRAMES

    def numbers(texts: pa.Array) -> pa.Array:
        digests, ends = [], [0]
        for text in texts.cast(pa.binary()).to_pylist():
            w = [] if text is None else text.split(b" ")
            if len(w) >= least:
                digests += [hashlib.md5(b" ".join(w[i : i + words])).digest() for i in range(0, len(w) - words + 1, words)]
            ends.append(len(digests))
        values = np.frombuffer(b"".join(digests), ">u4")[::4].astype(np.int64)
        ends = np.array(ends, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array(ends[1:] == ends[:-1]))

    # a column expression would take several times as long, mostly to read the digits
    return docs.withColumn("fp", F.arrow_udf(numbers, "array<bigint>")(F.lower("text")))


def fingerprint_digest(fp: Column) -> Column:
    return F.md5(F.array_join(F.transform(fp, lambda x: x.cast("string")), ","))


def similarity(a: str | Column, b: str | Column) -> Column:
    """Share of equal bits in the best alignment of two fingerprints, shifted by up to ``SHIFT`` frames."""

    def at(shift: Column) -> Column:
        x = F.slice(a, F.greatest(shift, F.lit(0)) + 1, F.size(a))
        y = F.slice(b, F.greatest(-shift, F.lit(0)) + 1, F.size(b))
        n = F.least(F.size(x), F.size(y))
        bits = F.aggregate(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, v: s + v)
        return F.when((n >= OVERLAP) | ((shift == 0) & (n > 0)), 1 - bits / (32 * n))

    return F.coalesce(F.array_max(F.transform(F.sequence(F.lit(-SHIFT), F.lit(SHIFT)), at)), F.lit(0.0))


def alike_prints(threshold: float):
    """For ``graph.led``: which fingerprints (column fp) have a :func:`similarity` of ``threshold`` or more to one, each shift for all at once."""

    def among(rows: pd.DataFrame):
        known = _Windows.of(rows["fp"])
        table, sizes = known.table, known.sizes

        def ask(item: tuple, which: np.ndarray) -> np.ndarray:
            own = np.asarray(item[0], np.uint32)
            return _alike(own[None], np.array([len(own)]), table[which, : len(own) + SHIFT], sizes[which], threshold)

        def pairs(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out, i, j = np.zeros(len(i), bool), np.where(sizes[i] < sizes[j], i, j), np.where(sizes[i] < sizes[j], j, i)
            order = np.argsort(sizes[i], kind="stable")
            while len(order):  # the shorter of a pair bounds what is compared
                some = order[: 1 + int(np.searchsorted(sizes[i[order]] * np.arange(1, len(order) + 1), 1 << 20))]
                most = int(sizes[i[some]].max())
                out[some] = _alike(table[i[some], :most], sizes[i[some]], table[j[some], : most + SHIFT], sizes[j[some]], threshold)
                order = order[len(some) :]
            return out

        ask.pairs = pairs
        ask.maybe = lambda items, which: _maybe(_Windows.of(items["fp"]), np.arange(len(items)), known, which, threshold)
        return ask

    return among


def _alike(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``b`` are alike to those of ``a``, or to its one row; sizes tell how many frames of a row count."""
    found, left = np.zeros(len(b), bool), np.arange(len(b))
    # copies mostly are so without a shift, or with a small one
    for shift in sorted(range(-SHIFT, SHIFT + 1), key=abs):
        x, y = a[:, max(shift, 0) :], b[:, max(-shift, 0) :]
        n = np.maximum(np.minimum(size_a - max(shift, 0), size_b - max(-shift, 0)), 0)
        most = int(n.max(initial=0))
        if most < OVERLAP and (shift or not most):
            continue
        bits = np.bitwise_count(x[:, :most] ^ y[:, :most])
        if int(n.min()) < most:
            bits[np.arange(most) >= n[:, None]] = 0
        near = (1 - bits.sum(1, dtype=np.int64) / (32 * np.maximum(n, 1)) >= threshold) & ((n >= OVERLAP) | ((shift == 0) & (n > 0)))
        if near.any():
            found[left[near]] = True
            left, size_b, b = left[~near], size_b[~near], b[~near]
            if len(a) > 1:
                size_a, a = size_a[~near], a[~near]
            if not len(left):
                break
    return found


class _Windows:
    """Fingerprints as signs, in windows of ``WINDOW`` frames that are transformed when they are first asked for."""

    #: Least length at which shifts up to SHIFT of two windows don't run into each other.
    LENGTH = WINDOW + SHIFT

    def __init__(self, table: np.ndarray, sizes: np.ndarray):
        self.table, self.sizes, self.done = table, sizes, {}

    @classmethod
    def of(cls, prints: pd.Series) -> _Windows:
        sizes = prints.map(len).to_numpy()
        table = np.zeros((len(sizes), int(sizes.max())), np.uint32)
        for row, fp in zip(table, prints):
            row[: len(fp)] = fp
        return cls(table, sizes)

    def frames(self, which: np.ndarray, at: int) -> np.ndarray:
        """How many frames the window has of each."""
        return np.clip(self.sizes[which] - at * WINDOW, 0, WINDOW).astype(np.float32)

    def spectra(self, which: np.ndarray, at: int) -> np.ndarray:
        """(frequency, print, bit) of a window; what is not there counts as zero."""
        part = np.ascontiguousarray(self.table[which, at * WINDOW : (at + 1) * WINDOW])
        signs = np.unpackbits(part.view(np.uint8), axis=1).reshape(len(which), -1, 32).astype(np.float32) * 2 - 1
        signs[np.arange(signs.shape[1]) >= self.frames(which, at)[:, None]] = 0
        return np.ascontiguousarray(np.fft.rfft(signs, self.LENGTH, axis=1).transpose(1, 0, 2))

    def kept(self, which: np.ndarray, at: int) -> np.ndarray:
        """:meth:`spectra` of which, each print's worked out once for the first window."""
        if at:
            return self.spectra(which, at)
        if 0 not in self.done:
            self.done[0] = self.spectra(np.arange(len(self.sizes)), 0)
        return self.done[0][:, which]


#: Frames of a window, and prints that are compared at once.
_TILE = 64, 512


def _maybe(x: _Windows, own: np.ndarray, y: _Windows, which: np.ndarray, threshold: float) -> np.ndarray:
    """(own, which): whether two prints can be alike, true of all that are.

    The bits that differ in two windows, at every shift from products of their
    spectra, are at most those that differ in all; a pair whose windows differ
    in more than the whole may, at each shift, is out. Unlike prints mostly
    are after the windows that cover a third of them.
    """
    out = np.zeros((len(own), len(which)), bool)
    # those of like length together, as long ones take several windows
    rows, cols = np.argsort(x.sizes[own], kind="stable"), np.argsort(y.sizes[which], kind="stable")
    for i in range(0, len(own), _TILE[0]):
        r = rows[i : i + _TILE[0]]
        mine = x.spectra(own[r], 0)
        for j in range(0, len(which), _TILE[1]):
            c = cols[j : j + _TILE[1]]
            out[np.ix_(r, c)] = _tile(x, own[r], mine, y, which[c], threshold)
    return out


def _tile(x: _Windows, a: np.ndarray, mine: np.ndarray, y: _Windows, b: np.ndarray, threshold: float) -> np.ndarray:
    shifts = np.arange(-SHIFT, SHIFT + 1)
    waves = np.arange(_Windows.LENGTH // 2 + 1)
    weight = np.where((waves == 0) | (2 * waves == _Windows.LENGTH), 1, 2) / _Windows.LENGTH
    turn = 2 * np.pi * np.outer(shifts, waves) / _Windows.LENGTH
    cos, sin = (np.cos(turn) * weight).astype(np.float32), (np.sin(turn) * weight).astype(np.float32)
    hit = np.ones((len(a), len(b)), bool)
    rows, cols = np.arange(len(a)), np.arange(len(b))
    same = seen = np.float32(0)
    at = 0
    while True:
        theirs = y.kept(b[cols], at)
        mine = mine if at == 0 else x.spectra(a[rows], at)
        both = np.matmul(mine, theirs.conj().transpose(0, 2, 1)).reshape(len(waves), -1)
        same = same + (cos @ np.ascontiguousarray(both.real) - sin @ np.ascontiguousarray(both.imag)).reshape(len(shifts), len(rows), len(cols))
        parts = x.frames(a[rows], at), y.frames(b[cols], at)
        wholes = x.sizes[a[rows]].astype(np.float32), y.sizes[b[cols]].astype(np.float32)
        left = np.zeros((len(rows), len(cols)), bool)
        counts = np.empty_like(same)
        for k, shift in enumerate(shifts):
            n = np.minimum.outer(wholes[0] - max(shift, 0), wholes[1] - max(-shift, 0))
            counts[k] = np.maximum(np.minimum.outer(parts[0] - max(shift, 0), parts[1] - max(-shift, 0)), 0)
            now = counts[k] if at == 0 else counts[k] + seen[k]
            # frames with bits: equal ones less unequal ones, and what rounding may take
            left |= ((n >= OVERLAP) | ((shift == 0) & (n > 0))) & (same[k] + 4 >= 32 * now - 64 * (1 - threshold) * n)
        hit[np.ix_(rows, cols)] &= left
        at += 1
        shorter = np.minimum.outer(wholes[0], wholes[1])
        on = hit[np.ix_(rows, cols)] & (shorter > 2 * WINDOW * at)
        r, c = np.flatnonzero(on.any(1)), np.flatnonzero(on.any(0))
        # a window of a pair takes as long as ten of its frames in full
        if shorter[on].sum() <= 10 * len(r) * len(c):
            return hit
        seen = (counts if at == 1 else counts + seen)[:, r][:, :, c]
        same = same[:, r][:, :, c]
        rows, cols = rows[r], cols[c]


def alike_lengths(tolerance: float):
    """For ``graph.led``: which lengths (column duration_s) differ by at most ``tolerance`` of the longer from one; unknown ones are alike."""

    def among(rows: pd.DataFrame):
        lengths = rows["duration_s"].to_numpy(dtype=float)

        def ask(item: tuple, which: np.ndarray) -> np.ndarray:
            other, own = lengths[which], np.nan if item[0] is None else float(item[0])
            top = np.fmax(own, other)
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.isnan(own) | (top <= 0) | (np.abs(own - other) / top <= tolerance)

        def pairs(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            a, b = lengths[i], lengths[j]
            top = np.fmax(a, b)
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.isnan(b) | (top <= 0) | (np.abs(b - a) / top <= tolerance)

        ask.pairs = pairs
        return ask

    return among


def near_clusters(spark: SparkSession, files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(path, cluster): files that sound alike, in clusters of two or more.

    Files are filed under each of their first frames; in such a bucket a file
    joins the first leader that it is alike to (``graph.led``), and clusters
    that share a file are one. Equal fingerprints are one item beforehand, and
    buckets of the same files are one bucket, as their leaders are the same.
    """
    # fingerprints are made once; what they share is found without them
    made, kept = save(spark, files.select("path", "fp"), "near-prints")
    long = made.where(F.size("fp") >= LEAST_FRAMES)
    prints, path = save(spark, long.groupBy("fp").agg(F.min("path").alias("ordinal")), "near-items")
    probes = prints.select("ordinal", F.posexplode(F.slice("fp", 1, PROBES)).alias("i", "v"))
    buckets, dealt = save(spark, _distinct_sets(_shared(probes, ["i", "v"]), ["i", "v"], "ordinal"), "near-buckets")
    met = led(spark, buckets.join(prints, "ordinal"), ["i", "v"], alike_prints(threshold), ["fp"])
    same = long.join(prints, "fp").select(F.col("path").alias("a"), F.col("ordinal").alias("b"))
    edges = met.select(F.col("ordinal").alias("a"), F.col("head").alias("b")).union(same).where("a <> b")
    found = components(spark, edges).select(F.col("vertex").alias("path"), F.col("root").alias("cluster"))
    drop(spark, kept, path, dealt)
    return found


def _distinct_sets(rows: DataFrame, by: list[str], item: str) -> DataFrame:
    """One group of those that have the same items (each once in a group), told by their number and 120 bits of hashes."""
    key = F.struct(*by)
    # sums of 60 bits stay in range for groups of any size that fits here
    sums = [F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(k), item), 4).cast("decimal(20,0)")).alias(f"_h{k}") for k in (1, 2)]
    groups = rows.groupBy(*by).agg(F.count("*").alias("_n"), *sums)
    first = groups.groupBy("_n", "_h1", "_h2").agg(F.min(key).alias("_k")).select("_k.*")
    return rows.join(first, by, "left_semi")


def _shared(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose ``by`` occurs more than once."""
    return rows.join(rows.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), by, "left_semi")


def versions(spark: SparkSession, members: DataFrame, tolerance: float = LENGTH_TOLERANCE) -> DataFrame:
    """``members`` (path, cluster, filename, duration_s, ...) with ``version``, the first path of the version's files.

    Files are of one version if their names give the same remix and kind, and
    their lengths differ by at most ``tolerance``; unknown lengths only go
    with unknown ones.
    """
    keyed = members.withColumn("kind", version_key(F.col("filename"))).withColumn("timed", F.col("duration_s").isNotNull())
    by = ["cluster", "kind", "timed"]
    found = led(spark, keyed.withColumn("ordinal", F.col("path")), by, alike_lengths(tolerance), ["duration_s"])
    return members.join(found.select("cluster", F.col("ordinal").alias("path"), F.col("head").alias("version")), ["cluster", "path"])


def find(spark: SparkSession, files: DataFrame, threshold: float = THRESHOLD, distinct_versions: bool = True, all_formats: bool = False, exact: bool = True) -> DataFrame:
    """Members of all duplicate groups: method, group_id, path, keeper, size_bytes.

    ``files``: path, filename, ext, size_bytes, duration_s, digest, fp. Equal
    contents come first; of each such group the keeper goes on to the second
    phase, where files that sound alike are split into versions (and formats).
    """
    cols = ["method", "group_id", "path", "keeper", "size_bytes"]
    out = None
    rest = files
    if exact:
        twice = _shared(files.where("digest is not null"), ["digest"])
        first = keepers(twice, ["digest"])
        first, _ = save(spark, first, "dedupe-exact")
        rest = files.join(first.where("not keeper").select("path"), "path", "left_anti")
        out = first.select(F.lit("md5").alias("method"), F.col("digest").alias("group_id"), "path", "keeper", "size_bytes")
    clusters = near_clusters(spark, rest, threshold)
    members = rest.join(clusters, "path")
    # where all have one known content there is nothing to tell apart
    states = members.groupBy("cluster").agg(F.count_distinct("digest").alias("contents"), F.count_if(F.col("digest").isNull()).alias("unknown"))
    if exact:
        members = members.join(states.where("contents > 1 or unknown > 0").select("cluster"), "cluster", "left_semi")
    members = versions(spark, members) if distinct_versions else members.withColumn("version", F.col("cluster"))
    by = ["cluster", "version", "ext"] if all_formats else ["cluster", "version"]
    near = keepers(_shared(members, by), by)
    group = F.concat_ws("|", *by)
    near = near.select(F.lit("fingerprint").alias("method"), group.alias("group_id"), *cols[2:])
    return out.unionByName(near) if out is not None else near


def rank_by_rules(members: DataFrame, group: str, rules: list[str]) -> DataFrame:
    """``keeper_rank`` by the user's rules in their order; a missing value comes last, the row's ``ordinal`` decides ties."""
    order = [k for r in rules for k in _rule_keys()[r]]
    return members.withColumn("keeper_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order, "ordinal")))


def _rule_keys() -> dict[str, list[Column]]:
    return {
        "codec": [codec_rank(F.col("ext"))], "bitrate": [F.desc_nulls_last("bitrate")], "size": [F.desc_nulls_last("size_bytes")],
        "modified": [F.desc_nulls_last("modified")], "shortest_path": [F.asc_nulls_last(path_depth(F.col("path"))), F.length("path")],
    }


def _rule_values() -> dict[str, Column]:
    """What a rule compares, the least is best; missing values are the worst."""
    worst = F.lit(float("inf"))
    return {
        "codec": codec_rank(F.col("ext")).cast("double"), "bitrate": F.coalesce(-F.col("bitrate").cast("double"), worst), "size": F.coalesce(-F.col("size_bytes").cast("double"), worst),
        "modified": F.coalesce(-F.unix_micros(F.col("modified").cast("timestamp")).cast("double"), worst),
        "shortest_path": F.coalesce(path_depth(F.col("path")) * 1e6 + F.length("path"), worst),
    }


def explain(ranked: DataFrame, group: str, rules: list[str]) -> DataFrame:
    """(group, reason): the first rule by which the keeper (keeper_rank 1) beats another file of its group, else ``tie``."""
    values = _rule_values()
    rows = ranked.select(group, "keeper_rank", *[values[r].alias(f"_{r}") for r in rules])
    aggs = [F.min(F.when(F.col("keeper_rank") == 1, F.col(f"_{r}"))).alias(f"own_{r}") for r in rules] + [F.max(F.when(F.col("keeper_rank") > 1, F.col(f"_{r}"))).alias(f"far_{r}") for r in rules]
    g = rows.groupBy(group).agg(*aggs)
    reason = F.coalesce(*[F.when(F.col(f"own_{r}") < F.col(f"far_{r}"), r) for r in rules], F.lit("tie"))
    return g.select(group, reason.alias("reason"))


def apply_choices(ranked: DataFrame, group: str, chosen: DataFrame, skipped: DataFrame) -> DataFrame:
    """``keeper`` after the user's choices: (group, path) to keep instead, ignored where the path isn't in the group; skipped groups go."""
    real = chosen.select(group, F.col("path").alias("_path")).join(ranked.select(group, F.col("path").alias("_path")), [group, "_path"], "left_semi")
    real = real.groupBy(group).agg(F.min("_path").alias("_path"))
    left = ranked.join(skipped.select(group).distinct(), group, "left_anti").join(real, group, "left")
    return left.withColumn("keeper", F.when(F.col("_path").isNotNull(), F.col("path") == F.col("_path")).otherwise(F.col("keeper_rank") == 1)).drop("_path")


def planned(groups: DataFrame) -> DataFrame:
    """Rows to remove, each once: of (path, phase, keeper) all but keepers of any group, the earliest phase first."""
    kept = groups.where("keeper").select("path").distinct()
    left = groups.where("not keeper").join(kept, "path", "left_anti")
    return left.groupBy("path").agg(F.min("phase").alias("phase"))


def handled(plan: DataFrame, n: int, failed: DataFrame) -> DataFrame:
    """Paths that a run which got ``n`` files far has removed: the first of the plan by ``seq``, but for those that failed."""
    return plan.orderBy("seq").limit(n).join(failed.select("path"), "path", "left_anti")
