"""Writers: reports, exports, journals, histories. Tables appear whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.dedupe import summary
from ..operators.library import merge_sidecar


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def publish(df: DataFrame, path: str, kind: str = "parquet", **options) -> int:
    """Write beside ``path``, then move into its place; a failed write leaves the old table. Returns the rows written."""
    spark = df.sparkSession
    part = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.format(kind).options(**options).save(part)
    _replace(spark, part, path)
    return _read(spark, path, kind, df, options).count()


def _replace(spark: SparkSession, part: str, path: str) -> None:
    fs, target = _fs(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{part}.old")
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"{path} can't be replaced")
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(part), target):
        if had:
            fs.rename(old, target)
        raise OSError(f"{path} can't be written")
    if had:
        fs.delete(old, True)


def _read(spark: SparkSession, path: str, kind: str, like: DataFrame, options: dict) -> DataFrame:
    r = spark.read.format(kind).options(**{k: v for k, v in options.items() if k == "rowTag"})
    return r.load(path) if kind == "text" else r.schema(like.schema).option("header", True).load(path)


def write_csv(flat: DataFrame, path: str) -> int:
    return publish(flat, path, "csv", header=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(rows: DataFrame, path: str) -> int:
    """One object a line; null fields are left out."""
    return publish(rows, path, "json", ignoreNullFields=True)


def write_playlist(rows: DataFrame, path: str) -> int:
    """One path a line, without a header, in the rows' order of ``path``; rows without a path are left out."""
    return publish(rows.where("coalesce(path, '') <> ''").select("path").orderBy("path"), path, "text")


def export(rows: DataFrame, source: str, path: str, kind: str) -> int:
    """csv, json or m3u8; the input is never overwritten."""
    if source.rstrip("/") == path.rstrip("/"):
        raise ValueError("an export can't replace its input")
    return {"csv": write_csv, "json": write_json, "m3u8": write_playlist}[kind](rows, path)


def save_duplicates(members: DataFrame, path: str) -> DataFrame:
    """Write a report of duplicates, both its tables or none: ``files``, a JSON object per file (method, group_id, path, keeper, size_bytes), and ``summary``, one per method.

    A file is a line and groups are not gathered, so a group may be of any
    size. The summary is that of the lines written; it is returned.
    """
    spark = members.sparkSession
    part = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    rows = members.select("method", "group_id", "path", "keeper", "size_bytes")
    rows.write.json(f"{part}/files")
    n = summary(spark.read.schema(rows.schema).json(f"{part}/files"))
    n.write.json(f"{part}/summary")
    _replace(spark, part, path)
    return spark.read.schema(n.schema).json(f"{path}/summary")


def save_report(records: DataFrame, base: str, library: str) -> None:
    """Replace one library's rows in the table of reports; the others stay."""
    out = records.withColumn("library", F.lit(library))
    out.write.mode("overwrite").partitionBy("library").option("partitionOverwriteMode", "dynamic").parquet(base)


def append_partial(batch: DataFrame, base: str, number: int) -> None:
    """A batch of an unfinished run, as it is; a batch that runs again replaces itself."""
    batch.withColumn("status", F.lit("in_progress")).write.mode("overwrite").parquet(f"{base}/batch={number}")


def save_priors(spark: SparkSession, new: DataFrame, path: str) -> int:
    """Merge priors into the table at ``path``; a new row replaces the whole old one."""
    old = spark.read.schema(new.schema).parquet(path) if exists(spark, path) else new.limit(0)
    return publish(merge_sidecar(old, new), path)


_ENTRY = {"v": "int", "kind": "string", "started_at": "double", "root": "string", "action": "string", "src": "string", "dst": "string", "at": "double"}


def _lines(rows: DataFrame, path: str) -> None:
    rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in _ENTRY.items()]).write.mode("overwrite").json(path)


def open_journal(spark: SparkSession, folder: str, kind: str, root: str | None, at: float) -> str:
    """Begin a journal of JSON lines with its header; entries are appended while the work goes on, so a run that breaks off keeps its own."""
    path = f"{folder}/{kind}-{uuid.uuid4().hex}"
    _lines(spark.range(1).select(F.lit(1).alias("v"), F.lit(kind).alias("kind"), F.lit(at).alias("started_at"), F.lit(root).cast("string").alias("root")), f"{path}/header")
    return path


def append_journal(entries: DataFrame, path: str, number: int) -> None:
    """Add the entries (seq, action, src, dst) of a batch, in the order of ``seq``.

    A batch has a place by its number: one that runs again, after a failure
    or a restart, takes the place of what it had left, so each entry is there
    once. To be given to ``foreachBatch``, whose batches have numbers.
    """
    _lines(entries.orderBy("seq"), f"{path}/batch-{number:09d}")


def close_journal(spark: SparkSession, path: str, at: float) -> None:
    _lines(spark.range(1).select(F.lit("completed").alias("action"), F.lit(at).alias("at")), f"{path}/end")


def journal(entries: DataFrame, folder: str, kind: str, root: str, at: float) -> str:
    """A whole journal at once: header, entries, end mark."""
    spark = entries.sparkSession
    path = open_journal(spark, folder, kind, root, at)
    append_journal(entries, path, 0)
    close_journal(spark, path, at)
    return path


# Names of a collection's attributes.
COLLECTION_FIELDS = {"track_id": "_TrackID", "location": "_Location", "genre": "_Genre", "key": "_Tonality", "comments": "_Comments", "kind": "_Kind", "size": "_Size", "rate": "_SampleRate", "bit_rate": "_BitRate"}


def write_collection(rows: DataFrame, path: str) -> int:
    """A DJ collection in XML, a TRACK element a row, as ``readers.collection_rows`` reads it.

    Columns of COLLECTION_FIELDS become attributes, null ones are left out;
    columns of arrays of structs (such as TEMPO, whose fields begin with
    ``_``) become elements inside it; the collection's own path column and
    others are not written.
    """
    own = [F.col(c).cast("string").alias(a) for c, a in COLLECTION_FIELDS.items() if c in rows.columns]
    inside = [F.col(f.name) for f in rows.schema.fields if f.dataType.simpleString().startswith("array<struct")]
    return publish(rows.select(*own, *inside), path, "xml", rootTag="DJ_PLAYLISTS", rowTag="TRACK")


def append_history(run: DataFrame, path: str, most: int = 50) -> int:
    """Add a run's row to the history (column ``ts``) and keep the ``most`` newest."""
    spark = run.sparkSession
    old = spark.read.schema(run.schema).parquet(path) if exists(spark, path) else run.limit(0)
    return publish(old.unionByName(run).orderBy(F.desc("ts")).limit(most), path)


def backup_counts(snapshot: DataFrame) -> DataFrame:
    """One row on a tag snapshot (path, error, unsupported): backed_up, not_fully_backed_up, errors."""
    bad = F.coalesce("error", F.lit("")) != ""
    part = F.coalesce("unsupported", F.lit(False)) & ~bad
    return snapshot.agg(F.count_if(~bad).alias("backed_up"), F.count_if(part).alias("not_fully_backed_up"), F.count_if(bad).alias("errors"))


def recent(index: DataFrame, change: DataFrame, most: int = 10) -> DataFrame:
    """The index of libraries after some were opened: the newest row of each path, the ``most`` last opened, with their ``place``.

    Rows without a path are dropped.
    """
    rows = index.unionByName(change).where("coalesce(path, '') <> ''")
    last = rows.groupBy("path").agg(F.max_by(F.struct(*rows.columns), "last_opened").alias("r")).select("r.*")
    top = last.orderBy(F.desc("last_opened"), "path").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("last_opened"), "path")))  # at most ``most`` rows


def backups(index: DataFrame, files: DataFrame, most: int = 50) -> DataFrame:
    """The ``most`` newest backups, each path once, with ``missing`` where its file is gone."""
    last = index.groupBy("path").agg(F.max_by(F.struct(*index.columns), "created_at").alias("r")).select("r.*").orderBy(F.desc("created_at"), "path").limit(most)
    return last.join(files.select("path", F.lit(True).alias("_t")).distinct(), "path", "left").withColumn("missing", F.col("_t").isNull()).drop("_t")


def rename(index: DataFrame, path: str, name: str) -> DataFrame:
    return index.withColumn("name", F.when(F.col("path") == path, F.trim(F.lit(name))).otherwise(F.col("name")))


def forget(index: DataFrame, path: str) -> DataFrame:
    return index.where(~F.coalesce(F.col("path") == path, F.lit(False)))
