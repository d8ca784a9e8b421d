"""Queries of what is kept between runs: libraries and their reports, tag snapshots, reports of duplicates, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..operators import dedupe
from ..runtime import new_path
from ..sinks import libraries, snapshots, writers
from .catalog import _T, query
from .more import _DOCFILES, _texts_as_files
from .views import tracks

# -- libraries ----------------------------------------------------------------


@query("q_libraries", f"""{_T}, t AS (SELECT *, CAST(regexp_extract(path, '^/lib/T(\\d+)/', 1) AS INT) AS k, error IS NULL AND ml_error IS NULL AND ml_genre IS NOT NULL AS good FROM tracks),
n AS (SELECT k, count(*) FILTER (k % 3 = 0 OR release_id % 2 = 0) AS stored, count(*) FILTER (good AND (k % 3 = 0 OR release_id % 2 = 0)) AS good FROM t GROUP BY k),
l AS (SELECT *, CASE WHEN k = 1 THEN 200.0 WHEN k % 3 = 0 THEN 100.0 + k ELSE k END AS last_opened FROM n WHERE stored > 0 AND k <> 24)
SELECT '/lib/T' || k AS path, CASE WHEN k = 21 THEN 'Main' END AS name, CASE WHEN k = 1 THEN 0 ELSE stored END AS track_count, CASE WHEN k = 1 THEN 0 ELSE good END AS analyzed_count, CASE WHEN k <> 1 THEN last_opened END AS last_analyzed,
 CAST(row_number() OVER (ORDER BY last_opened DESC) AS INT) AS place, stored FROM l WHERE k = 1 OR k % 3 = 0 OR k = 23""")
def q_libraries(spark: SparkSession, d: str) -> DataFrame:
    """Every folder is a library: all are analysed by half, some again as a whole, one is forgotten, one renamed, one opened that the index had lost."""
    base = new_path(spark, "libraries")
    library = F.array_join(F.slice(F.split("path", "/"), 1, 3), "/")
    t = tracks(spark, d).select("track_id", "path", "release_id", "ml_genre", "error", "ml_error", library.alias("folder")).withColumn("k", F.substring("folder", 7, 9).cast("int"))
    libraries.analyzed(t.where("release_id % 2 = 0"), base, F.col("folder"), F.col("k"))
    libraries.analyzed(t.where("k % 3 = 0"), base, F.col("folder"), F.col("k") + 100)
    libraries.forgotten(spark, base, ["/lib/T24"])
    libraries.renamed(spark, base, "/lib/T21", " Main ")
    libraries.opened(spark, base, "/lib/T1", 200.0)
    stored = spark.read.parquet(f"{base}/reports").groupBy(F.col("library_path").alias("path")).agg(F.count("*").alias("stored"))
    index = libraries.index(spark, base)
    rows = writers.recent(index.limit(0), index, libraries.MOST).join(stored, "path", "left")
    return rows.select("path", "name", "track_count", "analyzed_count", "last_analyzed", "place", F.coalesce("stored", F.lit(0)).alias("stored"))


# -- snapshots ----------------------------------------------------------------

MANAGED = ["GENRE", "KEY", "MOOD"]


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    tags = F.create_map(*[x for k, c in (("GENRE", "genre_tag"), ("KEY", "key_raw"), ("ARTIST", "artist_tag"), ("TITLE", "title_tag")) for x in (F.lit(k), F.col(c))])
    return tracks(spark, d).select("*", tags.alias("tags"), F.when(F.col("ext") == "m4a", F.col("release_id") % 4 == 0).alias("unsupported"))


_BAD = "error IS NOT NULL OR coalesce(ext = 'm4a' AND release_id % 4 = 0, false)"


@query("q_tag_backup", f"{_T}, n AS (SELECT count(*) AS backed_up, count(*) FILTER ({_BAD}) AS not_fully_backed_up FROM tracks WHERE release_id % 2 = 0), g AS (SELECT count(*) AS errors FROM tracks WHERE release_id % 10 = 1) SELECT backed_up + errors AS total, * FROM n, g")
def q_tag_backup(spark: SparkSession, d: str) -> DataFrame:
    """The files about to be written to are backed up; some of those named are gone."""
    t = _tagged(spark, d)
    gone = t.where("release_id % 10 = 1").select(F.concat(F.lit("/gone"), "path").alias("path"))
    return snapshots.backup(t, new_path(spark, "snapshot"), t.where("release_id % 2 = 0").select("path").unionByName(gone))


@query("q_tag_restore", f"""{_T}, s AS (SELECT *, CASE WHEN release_id % 2 = 0 THEN ml_genre ELSE genre_tag END AS genre_now FROM tracks WHERE NOT ({_BAD}) AND release_id % 7 <> 0)
SELECT path, 'GENRE' AS field, CASE WHEN genre_tag IS NULL THEN 'delete' ELSE 'set' END AS action, genre_tag AS value FROM s WHERE genre_tag IS DISTINCT FROM genre_now
UNION ALL SELECT path, 'KEY', 'set', key_raw FROM s WHERE ext = 'mp3' AND key_raw IS NOT NULL UNION ALL SELECT path, 'MOOD', 'delete', NULL FROM s WHERE vocal_score > 0.5""")
def q_tag_restore(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot is written, the files get other tags, and the snapshot says what to write back."""
    path, t = new_path(spark, "snapshot"), _tagged(spark, d)
    snapshots.backup(t, path)
    now = F.create_map(
        F.lit("GENRE"), F.when(F.col("release_id") % 2 == 0, F.col("ml_genre")).otherwise(F.col("genre_tag")), F.lit("KEY"), F.when(F.col("ext") != "mp3", F.col("key_raw")),
        F.lit("ARTIST"), F.col("artist_tag"), F.lit("TITLE"), F.col("title_tag"), F.lit("MOOD"), F.when(F.col("vocal_score") > 0.5, "Dark"), F.lit("RATING"), F.lit("5"),
    )
    return snapshots.restore(spark.read.parquet(path), t.where("release_id % 7 <> 0").select("path", now.alias("tags")), MANAGED)


# -- reports of duplicates, dates ----------------------------------------------


@query("q_duplicate_report", f"WITH {_DOCFILES} SELECT 'md5' AS method, count(DISTINCT digest) AS groups, count(*) FILTER (NOT keeper) AS files, round_even(sum(CASE WHEN keeper THEN 0 ELSE size_bytes END) / 1048576, 2) AS recoverable_mb, count(*) AS lines FROM g WHERE n > 1 HAVING count(*) > 0")
def q_duplicate_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of equal texts, written and read back: its summary, and how many lines it has."""
    path = new_path(spark, "duplicates")
    f = dedupe.keepers(dedupe._shared(_texts_as_files(spark, d).where("digest is not null"), ["digest"]), ["digest"])
    s = writers.save_duplicates(f.select(F.lit("md5").alias("method"), F.col("digest").alias("group_id"), "path", "keeper", "size_bytes"), path)
    lines = spark.read.json(f"{path}/files").groupBy("method").agg(F.count("*").alias("lines")) if s.take(1) else s.select("method", F.lit(0).cast("bigint").alias("lines"))
    return s.join(lines, "method")


@query("q_dates", f"{_T} SELECT track_id, CASE WHEN release_id % 9 = 0 THEN '?' ELSE strftime(modified, '%-m/%-d/%Y') END AS shown, strftime(modified, '%Y%m%d-%H%M%S') AS stamp FROM tracks")
def q_dates(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("modified").cast("timestamp")
    epoch = F.when(F.col("release_id") % 9 != 0, F.unix_seconds(at)).when(F.col("release_id") % 2 == 0, 0)
    return tracks(spark, d).select("track_id", times.shown_date(epoch).alias("shown"), times.stamp(at).alias("stamp"))
