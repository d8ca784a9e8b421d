"""What a run's events add up to: files that are tried again, and runs that send nothing any more.

Both are keyed state over an event stream, kept in Spark's state store and
checkpointed with the query, so a restarted stream goes on where it was.
Events of one key are taken in the order of ``seq`` (attempts) or ``at``
(results) inside a batch, and batch after batch; rows without a key are left
out; an empty stream gives no rows. A batch's events of one key are one task's,
so ``per_batch`` bounds what a key can hold of memory; the state itself is a
few numbers. Files of attempts are many, so they are kept by shards: a batch
reads and writes the state of the shards that its files fall into.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..runtime import new_path

#: How often a file is tried again after its worker died.
RETRIES = 2
#: Seconds without a result after which a run counts as stalled.
STALL = 300
#: Shards that the keys of attempts are dealt to; a checkpoint is only good for the number that it was made with.
SHARDS = 256
# What is written for a file whose workers keep dying.
GAVE_UP = "analysis worker died repeatedly on this track — skipped"


def _try(shard: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: the shard's keys, and of each its deaths so far, or -1 if it has its row."""
    known = dict(zip(*state.get)) if state.exists else {}
    out = []
    # a key's events of a batch may come in several pieces that are not in order
    events = pd.concat(list(chunks)).sort_values("seq", kind="stable")
    for key, status, value in zip(events["key"], events["status"], events["value"]):
        deaths = known.setdefault(key, 0)
        if deaths < 0:
            continue
        if status == "died":
            known[key] = deaths + 1
            if deaths + 1 > RETRIES:
                out.append((key, "error", deaths + 1, None, GAVE_UP))
                known[key] = -1
        elif status in ("ok", "error"):
            out.append((key, "result" if status == "ok" else "error", deaths + 1, value, None if status == "ok" else value))
            known[key] = -1
    # a key that no event has counted for is as one that never came
    known = {k: n for k, n in known.items() if n}
    state.update((list(known), list(known.values())))
    if out:
        yield pd.DataFrame(out, columns=["key", "outcome", "attempts", "value", "error"])


def attempts(events: DataFrame) -> DataFrame:
    """(key, outcome, attempts, value, error): one row per file, as soon as it is decided.

    ``events`` (key, seq, status, value): ``ok`` and ``error`` decide a file;
    ``died`` sends it to another worker, ``RETRIES`` times, then it is an
    error; any other status (a claim, a worker that ended in order) is no
    death. What comes for a file that has its row is dropped.
    """
    rows = events.where("key is not null").select(F.col("key").cast("string").alias("key"), F.col("seq").cast("bigint").alias("seq"), "status", F.col("value").cast("string").alias("value"))
    # a worker is entered once for a shard and batch, which takes as long as it was for a key
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(SHARDS)).cast("int"))
    return rows.groupBy("shard").applyInPandasWithState(_try, "key string, outcome string, attempts int, value string, error string", "keys array<string>, deaths array<int>", "append", GroupStateTimeout.NoTimeout)


def _watch(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: the last result's time in ms, results so far, and whether the run is over."""
    last, done, over = state.get if state.exists else (-1, 0, False)
    stalled = None
    if state.hasTimedOut:
        stalled = None if over else last + STALL * 1000
    else:
        events = pd.concat(list(chunks))
        events["ms"] = events["at"].astype("datetime64[ms]").astype("int64")
        for row in events.sort_values("ms", kind="stable").itertuples():
            if over or stalled is not None:
                break
            if last >= 0 and row.ms - last > STALL * 1000:
                stalled = last + STALL * 1000
            else:
                # a result that is late has been waited for; it does not set the clock back
                last, done, over = max(last, row.ms), done + (not row.start), bool(row.final)
    over = over or stalled is not None
    state.update((last, done, over))
    if not over:
        state.setTimeoutTimestamp(max(last + STALL * 1000, state.getCurrentWatermarkMs() + 1))
    if stalled is not None:
        yield pd.DataFrame([(key[0], pd.Timestamp(stalled, unit="ms"), done)], columns=["run", "stalled_at", "done"])


def stalls(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(run, stalled_at, done): runs of which no result came for STALL seconds, once each, with their results up to there.

    ``events`` (run, at timestamp, start boolean, final boolean): a start
    begins the waiting, a final result ends the run. A stalled run is over:
    later results do not revive it. Silence is noticed by an event-time timer
    when the stream's watermark, ``delay`` behind the newest event of any run,
    passes it.
    """
    rows = events.where("run is not null and at is not null").withWatermark("at", delay)
    rows = rows.select(F.col("run").cast("string").alias("run"), "at", F.coalesce("start", F.lit(False)).alias("start"), F.coalesce("final", F.lit(False)).alias("final"))
    return rows.groupBy("run").applyInPandasWithState(_watch, "run string, stalled_at timestamp, done bigint", "last bigint, done bigint, over boolean", "append", GroupStateTimeout.EventTimeTimeout)


def written(spark: SparkSession, stream: DataFrame, base: str | None = None) -> DataFrame:
    """Runs a query over all that its source has, into a table beside its checkpoint, and gives the table's rows of this and earlier runs."""
    base = base or new_path(spark, "runs")
    q = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
