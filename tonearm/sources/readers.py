"""Sources: file listings, saved reports, collection exports, journals, references.

Defined cases: rows of another shape are skipped; a missing file is an error
of Spark's, a file that can't be parsed is ``Unreadable``; empty files give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.audio import unit
from ..functions.text import energy_mark, grouping_parts, path_key
from ..sinks.writers import COLLECTION_FIELDS

# File suffixes of the library.
SUFFIXES = ["mp3", "flac", "m4a", "wav", "aiff", "aif", "ogg", "aac", "wma"]


class Unreadable(ValueError):
    """A file is there, but is not what it should be."""


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, filename, extension, size_mb, error) of the audio files below ``root``; contents are never read.

    A file without a length gets an error and the size 0.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    size = F.bround(F.coalesce("length", F.lit(0)) / 1048576, 2)
    out = files.select("path", F.substring_index("path", "/", -1).alias("filename"), ext.alias("extension"), size.alias("size_mb"), F.when(F.col("length").isNull(), "no size").alias("error"))
    return out.where(F.col("extension").isin(SUFFIXES)).orderBy("path")


def scan_only(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The scan as records without analysis, and one row of counts."""
    rows = scan(spark, root)
    return rows, rows.agg(F.count("*").alias("total_files"), F.lit(0).alias("analyzed"), F.count("error").alias("errors"))


def media(files: DataFrame) -> DataFrame:
    """Adds ``bitrate`` where it is missing: kilobits a second by size and length."""
    made = F.floor(F.col("size_bytes") * 8 / F.col("duration_s") / 1000).cast("int")
    return files.withColumn("bitrate", F.coalesce("bitrate", F.when(F.col("duration_s") > 0, made)))


def tags(raw: DataFrame) -> DataFrame:
    """``raw`` (path, tags map<string,string>) as fields: the first that is there of several spellings; grouping gives energy and subgenre.

    Reading the containers' bytes is left to a source that yields such maps.
    """
    first = lambda *names: F.coalesce(*[F.nullif(F.trim(F.try_element_at("tags", F.lit(n))), F.lit("")) for n in names])
    energy, sub = grouping_parts(first("grouping"))
    bpm = first("bpm", "tbpm").try_cast("double").cast("int")
    return raw.select(
        "path", first("artist", "albumartist").alias("artist"), first("title").alias("title"), first("album").alias("album"), first("genre").alias("genre"), bpm.alias("bpm"),
        first("initialkey", "key", "tkey").alias("key"), F.coalesce(first("subgenre"), sub).alias("subgenre"), F.coalesce(energy_mark(first("comment")), energy).alias("energy_mik"),
    )


def report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Track rows of saved reports: JSON lines of rows, an object with ``tracks``, or a list of rows; rows of another shape are skipped.

    A report of one object is one row while it is read; large ones are kept as
    JSON lines or Parquet (``sinks.writers``).
    """
    whole = spark.read.text(path, wholetext=True)
    start = F.left(F.ltrim("value"), F.lit(1))
    bad = whole.where(~start.isin("[", "{") | F.try_parse_json("value").isNull()).where(~F.ltrim("value").rlike(r"^\{[^\n]*\}\s*(\n\s*\{[^\n]*\}\s*)*$"))
    if not bad.isEmpty():
        raise Unreadable(f"{path} holds no report")
    nested = F.from_json("value", "struct<tracks: array<string>>")["tracks"]
    by_line = F.split("value", "\n")
    rows = F.when(start == "[", F.from_json("value", "array<string>")).when(F.try_parse_json("value").isNull(), by_line).otherwise(F.coalesce(nested, by_line))
    each = whole.select(F.explode(rows).alias("t")).where(F.startswith(F.ltrim("t"), F.lit("{")))
    return each.select(F.from_json("t", f"struct<{schema}>").alias("t")).where("t is not null").select("t.*")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path) of a list of files, a path a line; blank lines are dropped."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def location_to_path(location: Column) -> Column:
    """``file://localhost/D:/a%20b+c`` to ``D:/a b+c``; another host becomes ``//HOST/...``."""
    host, rest = F.regexp_extract(location, "^file://([^/]*)", 1), F.regexp_extract(location, "^file://[^/]*(/.*)$", 1)
    plain = F.url_decode(F.replace(rest, F.lit("+"), F.lit("%2B")))
    local = F.regexp_replace(plain, "^/([A-Za-z]:)", "$1")
    return F.when(rest == "", None).when(F.lower(host).isin("localhost", ""), local).otherwise(F.concat(F.lit("//"), host, plain))


def collection_rows(spark: SparkSession, path: str) -> DataFrame:
    """(track_id, location, path, genre, key, comments, kind, size, rate, bit_rate) of the tracks of a DJ collection in XML.

    Playlists only name tracks by key, and are left out; collection rows
    without a location stay. Another root than DJ_PLAYLISTS is ``Unreadable``.
    """
    head = spark.read.text(path).where("value rlike '<\\\\w'").select(F.regexp_extract("value", r"<(\w+)", 1).alias("tag")).first()
    if head is None or head["tag"] != "DJ_PLAYLISTS":
        raise Unreadable(f"{path} is no collection")
    fields = COLLECTION_FIELDS
    schema = ", ".join(f"{c} string" for c in (*fields.values(), "_Key"))
    rows = spark.read.format("xml").option("rowTag", "TRACK").schema(schema).load(path).where("_Key is null or _Location is not null")
    out = rows.select(*[F.col(c).alias(k) for k, c in fields.items()])
    return out.withColumns({"path": location_to_path(F.col("location")), "size": F.col("size").try_cast("long"), "rate": F.col("rate").try_cast("int"), "bit_rate": F.col("bit_rate").try_cast("int")})


def priors(rows: DataFrame) -> DataFrame:
    """(path_key, genre, key, energy) of collection rows: what they know of a path, the last of repeated ones (by track_id); rows that know nothing are left out."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    p = rows.where("path is not null").select(path_key(F.col("path")).alias("path_key"), blank("genre").alias("genre"), blank("key").alias("key"), energy_mark(F.coalesce("comments", F.lit(""))).alias("energy"), F.col("track_id").try_cast("long").alias("_n"))
    p = p.where("coalesce(genre, key, cast(energy as string)) is not null")
    return p.groupBy("path_key").agg(F.max_by(F.struct("genre", "key", "energy"), F.coalesce("_n", F.lit(-1))).alias("p")).select("path_key", "p.*")


def collection(spark: SparkSession, path: str) -> DataFrame:
    """(path_key, genre, key, energy) of a DJ collection in XML."""
    return priors(collection_rows(spark, path))


def journal(spark: SparkSession, path: str) -> DataFrame:
    """(file, action, src, dst) of append-only journals, whatever number of appends they have; cut or malformed lines and the header are skipped.

    ``file`` is the journal that an entry is of, also where it is a folder of appends.
    """
    rows = spark.read.schema("action string, src string, dst string, v int").option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)
    name = F.regexp_replace(F.col("_metadata.file_path"), "/(header|end|batch-[0-9]{9})/[^/]*$", "")
    return rows.select(name.alias("file"), "action", "src", "dst").where("action is not null")


def history(spark: SparkSession, path: str, schema: str, last: int) -> DataFrame:
    """The ``last`` newest runs (column ``ts``) of JSON lines; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("ts is not null").orderBy(F.desc("ts")).limit(last)


def reference(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, label, emb) of labelled vectors, each of length 1; the null vector stays."""
    rows = spark.read.parquet(path)
    return rows.select("ref_id", "label", unit(F.col("emb")).alias("emb"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(key, field, kind, value, tol) of a file of expectations: an object of files with ``expect``, ``close``, ``min`` and ``present``.

    A file without any is ``Unreadable``.
    """
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<tracks: map<string, struct<expect: map<string,string>, close: map<string, struct<value: double, tol: double>>, min: map<string,double>, present: array<string>>>>").alias("m"))
    each = row.select(F.explode("m.tracks").alias("key", "e"))
    if each.isEmpty():
        raise Unreadable(f"{path} expects nothing")
    none = F.lit(None).cast("double")
    a = each.select("key", F.explode("e.expect").alias("field", "v")).select("key", "field", F.lit("expect").alias("kind"), F.col("v").alias("value"), none.alias("tol"))
    b = each.select("key", F.explode("e.close").alias("field", "v")).select("key", "field", F.lit("close").alias("kind"), F.col("v.value").cast("string").alias("value"), F.col("v.tol").alias("tol"))
    c = each.select("key", F.explode("e.min").alias("field", "v")).select("key", "field", F.lit("min").alias("kind"), F.col("v").cast("string").alias("value"), none.alias("tol"))
    d = each.select("key", F.explode("e.present").alias("field")).select("key", "field", F.lit("present").alias("kind"), F.lit(None).cast("string").alias("value"), none.alias("tol"))
    return a.unionByName(b).unionByName(c).unionByName(d)


def events(rows: DataFrame) -> DataFrame:
    """(type, payload) of lines ``EVENT<tab>type<tab>JSON``; other lines and bad JSON are skipped."""
    parts = F.split("value", "\t", 3)
    out = rows.where(F.startswith("value", F.lit("EVENT\t"))).select(F.get(parts, F.lit(1)).alias("type"), F.try_parse_json(F.get(parts, F.lit(2))).alias("payload"))
    return out.where("payload is not null and type is not null")
