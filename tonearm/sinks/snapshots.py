"""Snapshots of tags: taken before files are written to, and what to write to have them back.

A snapshot is a table with a row per file: path, size, version, tags
(map<string,string>), error, unsupported. Defined cases: null values of a map
are no tags, empty texts are; a null map is a file without tags; a path asked
for that no file has is an error of the backup and has no row; repeated rows
of a path are kept as they are; an empty table is an empty snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .writers import publish

#: What the readers of this version look at. A snapshot of an older one does not tell a tag that was not there from one not looked at.
VERSION = 2


def backup(files: DataFrame, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Write the snapshot of files (path, size_bytes, tags, error, unsupported) to ``path``, all or none of it.

    ``wanted`` (path): only these files. Returns one row: total, backed_up,
    not_fully_backed_up (of those: could not be read, or of a kind without
    reader), errors (wanted, but not there).
    """
    spark = files.sparkSession
    if wanted is not None:
        wanted = wanted.select("path").distinct()
        files = files.join(wanted, "path", "left_semi")
    rows = files.select(
        "path", F.col("size_bytes").cast("bigint").alias("size"), F.lit(VERSION).alias("version"), F.map_filter("tags", lambda _, v: v.isNotNull()).alias("tags"),
        F.col("error").cast("string").alias("error"), F.coalesce(F.col("unsupported").cast("boolean"), F.lit(False)).alias("unsupported"),
    )
    publish(rows, path)
    kept = spark.read.schema(rows.schema).parquet(path)
    n = kept.agg(F.count("*").alias("backed_up"), F.count_if(F.col("unsupported") | (F.coalesce("error", F.lit("")) != "")).alias("not_fully_backed_up"))
    if wanted is None:
        return n.select(F.col("backed_up").alias("total"), "backed_up", "not_fully_backed_up", F.lit(0).cast("bigint").alias("errors"))
    gone = wanted.join(kept.select("path"), "path", "left_anti").agg(F.count("*").alias("errors"))
    return n.join(gone, F.lit(True)).select((F.col("backed_up") + F.col("errors")).alias("total"), "backed_up", "not_fully_backed_up", "errors")


def restore(snapshot: DataFrame, current: DataFrame, managed: list[str]) -> DataFrame:
    """(path, field, action, value): what turns the tags of current files (path, tags) back into the snapshot's.

    ``set`` where a tag of the snapshot is another one now or gone; ``delete``
    where one of the ``managed`` fields has come since. Other fields that came
    since stay, and so does all that an older version may not have looked at.
    Files that could not be read then, or aren't there now, are left alone.
    """
    none = F.create_map().cast("map<string,string>")
    s = snapshot.where("coalesce(error, '') = '' and not coalesce(unsupported, false)").select("path", F.coalesce("tags", none).alias("_then"), (F.coalesce("version", F.lit(0)) >= VERSION).alias("_whole"))
    j = s.join(current.select("path", F.coalesce("tags", none).alias("_now")), "path")
    at = lambda m, k: F.try_element_at(F.col(m), k)
    put = F.transform(
        F.filter(F.map_keys("_then"), lambda k: at("_then", k).isNotNull() & ~at("_then", k).eqNullSafe(at("_now", k))),
        lambda k: F.struct(k.alias("field"), F.lit("set").alias("action"), at("_then", k).alias("value")),
    )
    fields = F.array(*[F.lit(f) for f in managed]).cast("array<string>")
    gone = F.transform(
        F.filter(F.array_distinct(fields), lambda k: F.col("_whole") & at("_then", k).isNull() & at("_now", k).isNotNull()),
        lambda k: F.struct(k.alias("field"), F.lit("delete").alias("action"), F.lit(None).cast("string").alias("value")),
    )
    return j.select("path", F.explode(F.concat(put, gone)).alias("_w")).select("path", "_w.*")
