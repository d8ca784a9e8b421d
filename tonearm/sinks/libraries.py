"""The index of libraries, and the reports and priors that belong to its rows.

Under one folder: ``index`` (JSON lines, a library each), and the tables
``reports`` and ``priors``, partitioned by the library's number (``md5`` of
its path). Reports of many libraries are put in by one write, each in the
place of its library's old one. One writer at a time changes the index.

Defined cases: lines of the index that are no objects or have no path are
passed over, so one bad line costs no other; single texts as ``tags`` become
lists; records without a library go nowhere; a library's report is there until
it is forgotten, even if the index no longer lists it; an index or a report
that was never written reads as empty or None, one that can't be read raises.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import failed
from ..runtime import drop
from .writers import exists, publish, recent

#: Libraries in the index.
MOST = 10
INDEX = "path string, name string, tags array<string>, track_count bigint, analyzed_count bigint, last_opened double, last_analyzed double"


def number(path: str) -> str:
    return hashlib.md5(path.encode(), usedforsecurity=False).hexdigest()


def index(spark: SparkSession, base: str) -> DataFrame:
    """The libraries, the last opened first by column ``last_opened``."""
    empty = spark.createDataFrame([], INDEX)
    if not exists(spark, f"{base}/index"):
        return empty
    v = F.try_parse_json("value")
    get = lambda field, kind: F.try_variant_get(F.col("v"), f"$.{field}", kind)
    shape = F.schema_of_variant(get("tags", "variant"))
    single = F.when((shape == "STRING") & (get("tags", "string") != ""), F.array(get("tags", "string")))
    tags = F.coalesce(F.when(shape.startswith("ARRAY"), get("tags", "array<string>")), single, F.array().cast("array<string>"))
    columns = [tags.alias(f.name) if f.name == "tags" else get(f.name, f.dataType.simpleString()).alias(f.name) for f in empty.schema]
    return spark.read.text(f"{base}/index").select(v.alias("v")).select(*columns).where("coalesce(path, '') <> ''")


def _save(base: str, rows: DataFrame, change: DataFrame) -> None:
    publish(recent(rows, change, MOST).drop("place"), f"{base}/index", "json", ignoreNullFields=True)


def opened(spark: SparkSession, base: str, path: str, at: float) -> None:
    """A library goes to the front, as a new one if it isn't in the index."""
    old = index(spark, base)
    own = old.where(F.col("path") == path)
    new = spark.range(1).select(F.lit(path).alias("path")).join(own, "path", "left").select(
        "path", "name", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("track_count", F.lit(0)).cast("bigint").alias("track_count"),
        F.coalesce("analyzed_count", F.lit(0)).cast("bigint").alias("analyzed_count"), F.lit(float(at)).alias("last_opened"), "last_analyzed",
    )
    _save(base, old.where(F.col("path") != path), new)


def analyzed(records: DataFrame, base: str, library: Column, at: Column) -> None:
    """Put the records of one or many libraries in the place of their old reports, count them, and bring the libraries to the front.

    ``library`` is the path that a record belongs to, ``at`` the time of its
    analysis. Counts are of the rows that were written. Tables with a column
    named ``library``, ``library_path``, ``analyzed_at`` or ``run`` lose it.
    """
    spark = records.sparkSession
    run = uuid.uuid4().hex
    names = {"library_path": library.cast("string"), "analyzed_at": at.cast("double"), "run": F.lit(run)}
    rows = records.withColumns({f"_{k}": v for k, v in names.items()}).drop("library", *names).withColumnsRenamed({f"_{k}": k for k in names})
    rows = rows.where("coalesce(library_path, '') <> ''").withColumn("library", F.md5("library_path"))
    # tasks by library, large ones cut into several
    rows.hint("rebalance", "library").write.mode("overwrite").partitionBy("library").option("partitionOverwriteMode", "dynamic").parquet(f"{base}/reports")
    own = spark.read.schema(rows.schema).parquet(f"{base}/reports").where(F.col("run") == run)
    good = ~failed() & F.col("ml_genre").isNotNull()
    n = own.groupBy(F.col("library_path").alias("path")).agg(F.count("*").alias("track_count"), F.count_if(good).alias("analyzed_count"), F.max("analyzed_at").alias("last_opened"), F.max("analyzed_at").alias("last_analyzed"))
    old = index(spark, base)
    new = n.join(old.select("path", "name", "tags"), "path", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).select(*old.columns)
    _save(base, old.join(n.select("path"), "path", "left_anti"), new)


def report(spark: SparkSession, base: str, path: str) -> DataFrame | None:
    """A library's records; None only if it has none."""
    place = f"{base}/reports/library={number(path)}"
    return spark.read.parquet(place) if exists(spark, place) else None


def renamed(spark: SparkSession, base: str, path: str, name: str) -> bool:
    """Show a library under another name, the folder's own if that is blank; False if it isn't in the index."""
    old = index(spark, base)
    if not old.where(F.col("path") == path).take(1):
        return False
    _save(base, old.withColumn("name", F.when(F.col("path") == path, F.lit(name.strip())).otherwise(F.col("name"))), old.limit(0))
    return True


def forgotten(spark: SparkSession, base: str, paths: list[str]) -> int:
    """Take libraries out of the index and delete their reports and priors, so that none comes back with the folder. Returns how many were listed."""
    old = index(spark, base)
    n = old.where(F.col("path").isin(*paths)).count()
    if n:
        _save(base, old.where(~F.col("path").isin(*paths)), old.limit(0))
    drop(spark, *[f"{base}/{kind}/library={number(p)}" for p in paths for kind in ("reports", "priors")])
    return n
