"""Results that arrive as a stream: keyed state, progress, runs that are over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.library import upsert
from ..runtime import drop, new_path
from ..sinks.writers import append_partial, exists, publish

#: Batches between two reductions of what they left.
COMPACT = 20


def _drain(stream: DataFrame, each, base: str, name: str) -> None:
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()


def last_rows(spark: SparkSession, source: str, schema: str, key: str, order: str, checkpoint: str | None = None, per_batch: int = 50) -> DataFrame:
    """All rows of a file source, batch after batch, reduced to the last row of each key.

    Each batch leaves its own last rows; a restarted stream goes on from its
    checkpoint, and a batch that runs again replaces what it had left. Every
    ``COMPACT`` batches what is left is reduced to one table, so state grows
    with the keys, not with the rows.
    """
    base = checkpoint or new_path(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        upsert(batch, key, order).write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
        if number and number % COMPACT == 0:
            known = [f"{base}/rows/batch={i}" for i in range(max(0, number - COMPACT), number + 1)]
            parts = [p for p in [f"{base}/state", *known] if exists(spark, p)]
            publish(upsert(spark.read.schema(batch.schema).parquet(*parts), key, order), f"{base}/state")
            drop(spark, *known)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(source)
    _drain(stream, keep, base, "checkpoint")
    parts = [p for p in (f"{base}/rows", f"{base}/state") if exists(spark, p)]
    rows = spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(*parts) if parts else spark.createDataFrame([], stream.schema)
    return upsert(rows, key, order)


def run_rows(events: DataFrame, run: str) -> DataFrame:
    """Events of one run; those that name no run pass too."""
    return events.where(F.col("run_id").isNull() | (F.col("run_id") == run))


def results(spark: SparkSession, source: str, schema: str, run: str, checkpoint: str | None = None, per_batch: int = 50) -> DataFrame:
    """The rows of one run, each batch stored when it is done, as of an unfinished run."""
    base = checkpoint or new_path(spark, "results")
    stream = run_rows(spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(source), run)
    _drain(stream, lambda batch, n: append_partial(batch, f"{base}/rows", n), base, "checkpoint")
    return spark.read.schema(stream.withColumn("status", F.lit("")).schema).parquet(f"{base}/rows/*")


def progress(spark: SparkSession, source: str, schema: str, total: int, checkpoint: str | None = None, per_batch: int = 50) -> DataFrame:
    """(batch, done, total, final): one row a batch, however many rows it has; the last one always comes."""
    base = checkpoint or new_path(spark, "progress")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(source)
    _drain(stream, lambda batch, n: batch.agg(F.count("*").alias("rows")).withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/ticks/tick={n}"), base, "checkpoint")
    ticks = spark.read.schema("rows long, batch int").parquet(f"{base}/ticks/*")

    so_far = F.sum("rows").over(Window.orderBy("batch"))  # a row a batch
    return ticks.select("batch", so_far.alias("done")).withColumn("total", F.lit(total).cast("long")).withColumn("final", F.col("done") >= F.col("total"))


def append_log(spark: SparkSession, source: str, schema: str, folder: str, checkpoint: str, per_batch: int = 50) -> DataFrame:
    """Entries of a file stream appended to a log that is only ever added to; (batch, ...) in replay order of ``seq``."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(source)
    q = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder).orderBy(F.desc("seq"))
