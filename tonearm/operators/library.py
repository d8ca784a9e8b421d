"""Queries and merges over a library of tracks.

Defined cases: a null never matches an active filter; null keys match nothing
in joins; repeated keys of a right side repeat rows, so right sides are unique
by contract; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.music import per_value, tag_reading
from ..functions.text import path_key

#: How the values of a facet are ordered where that isn't alphabetical.
DIRECTION_ORDER = ["Up", "Steady", "Down"]


def chips(tracks: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """Rows that match every dimension with values; any of a dimension's values will do."""
    active = [F.col(c).isin(v) for c, v in wanted.items() if v]
    return tracks.where(reduce(lambda a, b: a & b, active)) if active else tracks


def search(tracks: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with ``text`` in any of the columns, whatever its case."""
    return tracks.where(reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(text.lower()) for c in columns]))


def facet_order(facet: Column, value: Column) -> Column:
    """Directions go Up, Steady, Down; other values by themselves."""
    at = F.array_position(F.array(*[F.lit(x) for x in DIRECTION_ORDER]), value)
    return F.when(facet == "direction", F.concat(F.lit("#"), at.cast("string"))).otherwise(value)


def facets(tracks: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) of all non-null values, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return tracks.select(F.explode(pairs).alias("p")).where("p.value is not null").groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def find_compatible(tracks: DataFrame, seed: DataFrame) -> DataFrame:
    """Per seed (track_id) the filter that it makes and how many other tracks pass: seed_id, camelot, directions, energies, n.

    Passing tracks have an energy within one of the seed's, its direction or
    Up, and its key. Tracks are counted by these three first, so a seed meets
    at most six counts, whatever the number of tracks. Seeds without energy or
    key pass nothing.
    """
    sizes = tracks.groupBy("camelot", "direction", "energy").agg(F.count("*").alias("n"))
    near = F.sequence(F.greatest(F.lit(0), F.col("energy") - 1), F.least(F.lit(5), F.col("energy") + 1))
    ways = F.array_distinct(F.array("direction", F.lit("Up")))
    s = seed.where("energy is not null and camelot is not null and direction is not null").select(F.col("track_id").alias("seed_id"), "camelot", ways.alias("directions"), near.alias("energies"))
    cells = s.select("seed_id", "camelot", F.explode("directions").alias("direction"), "energies").select("seed_id", "camelot", "direction", F.explode("energies").alias("energy"))
    found = cells.join(sizes, ["camelot", "direction", "energy"]).groupBy("seed_id").agg((F.sum("n") - 1).alias("n"))
    return s.join(found, "seed_id").select("seed_id", "camelot", F.array_join("directions", ",").alias("directions"), F.array_join(F.transform("energies", lambda e: e.cast("string")), ",").alias("energies"), "n")


def report_stats(tracks: DataFrame, columns: list[str]) -> DataFrame:
    """Histograms of several columns from one aggregation over grouping sets."""
    sets = ", ".join(f"({c})" for c in columns)
    value = F.coalesce(*[F.col(c).cast("string") for c in columns])
    kind = reduce(lambda acc, c: F.when(F.col(f"g_{c}") == 0, c).otherwise(acc), columns, F.lit(None))
    picks = ", ".join(f"grouping({c}) AS g_{c}" for c in columns)
    spark = tracks.sparkSession
    out = spark.sql(f"SELECT {', '.join(columns)}, {picks}, count(*) AS n FROM {{t}} GROUP BY GROUPING SETS ({sets})", t=tracks.select(*columns))
    return out.select(kind.alias("histogram"), value.alias("value"), "n").where("value is not null")


def summary(tracks: DataFrame) -> DataFrame:
    """One row of counts; failed is what has an error of its own or of its analysis."""
    failed = (F.coalesce("error", F.lit("")) != "") | (F.coalesce("ml_error", F.lit("")) != "")
    return tracks.agg(
        F.count("*").alias("total_files"), F.count_if(~failed & F.col("ml_genre").isNotNull()).alias("analyzed"),
        F.count_if(failed).alias("errors"), F.count_if(F.col("ml_genre").isNotNull()).alias("with_genre"),
    )


def merge_priors(tracks: DataFrame, priors: DataFrame) -> DataFrame:
    """Priors replace a differing genre and fill missing keys and energies; ``changed`` names what they changed."""
    p = priors.select(path_key(F.col("path")).alias("_p"), F.col("genre").alias("_g"), F.col("key").alias("_k"), F.col("energy").alias("_e"))
    j = tracks.join(p, path_key(F.col("path")) == F.col("_p"), "left")
    genre = F.col("_g").isNotNull() & (F.lower("_g") != F.lower(F.coalesce("genre_tag", F.lit(""))))
    key, energy = F.col("key_raw").isNull() & F.col("_k").isNotNull(), F.col("energy").isNull() & F.col("_e").isNotNull()
    changed = F.array_join(F.array_compact(F.array(F.when(genre, "genre"), F.when(key, "key"), F.when(energy, "energy"))), ",")
    return j.select("track_id", F.when(genre, F.col("_g")).otherwise(F.col("genre_tag")).alias("genre_tag"), F.coalesce("key_raw", "_k").alias("key_raw"), F.coalesce("energy", "_e").alias("energy"), changed.alias("changed"))


def reattach(old: DataFrame, new: DataFrame, skipped: DataFrame, present: DataFrame, aborted: bool = False) -> DataFrame:
    """New rows, and the old ones they don't replace: skipped ones still present, or all if the run was aborted."""
    kept = old.join(new.select("path"), "path", "left_anti")
    if not aborted:
        kept = kept.join(skipped.select("path"), "path", "left_semi").join(present.select("path"), "path", "left_semi")
    return new.unionByName(kept)


def upsert(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order``; a key with very many rows is reduced in every task first. Null keys are one key."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.col(order)).alias("_row"))
    return last.select("_row.*")


def merge_full(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of a new full report, in the order of the old one, those new to it after that (column ``place``)."""
    at = old.select("path", F.col("place").alias("_old"))
    j = new.join(at, "path", "left")
    return j.select(*[F.col(c) for c in new.columns if c != "place"], F.struct(F.col("_old").isNull().alias("fresh"), F.coalesce("_old", "place").alias("at")).alias("place"))


def delete(rows: DataFrame, removed: DataFrame, moved: DataFrame) -> DataFrame:
    """Rows without those removed, the others with the path that they moved to (src, dst); removal goes before."""
    return remap(rows.join(removed.select("path"), "path", "left_anti"), moved)


def merge_sidecar(old: DataFrame, new: DataFrame) -> DataFrame:
    """Priors by path_key: a new row replaces the whole old one."""
    return new.unionByName(old.join(new.select("path_key"), "path_key", "left_anti"))


def count_new(files: DataFrame, known: DataFrame) -> DataFrame:
    """One row (n_files, n_known, n_new, reason): file names on disk that the report doesn't have. Names, not paths, so a moved library isn't all new."""
    name = lambda df: df.select(F.regexp_extract("path", r"[^/\\]*$", 0).alias("name")).distinct()
    f, k = name(files), name(known)
    both = f.join(k.withColumn("_k", F.lit(True)), "name", "left")
    out = both.agg(F.count("*").alias("n_files"), F.count("_k").alias("n_known"), (F.count("*") - F.count("_k")).alias("n_new"))
    return out.withColumn("reason", F.when(F.col("n_files") == 0, "empty").when(F.col("n_known") == 0, "nothing_known").when(F.col("n_new") == 0, "up_to_date").otherwise("new_files"))


def remap(tracks: DataFrame, moves: DataFrame) -> DataFrame:
    """Moved tracks get their new path and the file name that goes with it."""
    out = tracks.join(moves.select(F.col("src").alias("path"), "dst"), "path", "left").withColumn("path", F.coalesce("dst", "path")).drop("dst")
    return out.withColumn("filename", F.substring_index("path", "/", -1))


def resolve_conflicts(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """``approve`` (or any unknown action) fixes the reading; ``revert`` goes back to the tag's genre, if there is a tag. Both end the conflict."""
    j = rows.join(decisions, "track_id", "left")
    decided, revert = F.col("action").isNotNull(), F.coalesce(F.col("action") == "revert", F.lit(False))
    back = revert & (F.trim(F.coalesce("genre_tag", F.lit(""))) != "")
    j = per_value(j, "genre_tag", "_read", tag_reading)
    return j.select(
        "track_id", F.when(back, F.col("_read.parent")).otherwise(F.col("genre")).alias("genre"), F.when(back, F.col("_read.name")).otherwise(F.col("subgenre")).alias("subgenre"),
        F.when(back, "tag").when(decided & ~revert, "approved").otherwise(F.col("source")).alias("source"), F.when(decided, False).otherwise(F.col("conflict")).alias("conflict"),
    )


def newest(rows: DataFrame, by: str, order: list, n: int) -> DataFrame:
    """Ring buffer: the ``n`` newest rows of each owner; each task keeps no more than these of an owner before rows are shuffled."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("pos") <= n)
