"""How many workers fit a machine, for a table of machines at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.music import bound

# Megabytes per worker, resident part, bytes of decoded audio a second, by classifier; megabytes of a GPU worker; other limits.
WORKER_MB = {"clap": 4500, "discogs": 800}
RESIDENT_MB = {"clap": 3800, "discogs": 340}
DECODED_BYTES = {"clap": 48000 * 4, "discogs": 44100 * 4}
GPU_MB, GPU_UNKNOWN, HEADROOM_MB, RESERVE_MB, RESERVE_VM_MB, MB = 2500, 4, 1024, 2048, 4096, 1024 * 1024


def _of(table: dict[str, int]) -> Column:
    return F.when(F.col("classifier") == "clap", table["clap"]).otherwise(table["discogs"])


def worker_mb(longest_seconds: Column) -> Column:
    """Memory of a worker; tracks whose decoded audio does not fit beside the resident part raise it."""
    base = _of(WORKER_MB)
    decoded = F.ceil(longest_seconds * _of(DECODED_BYTES) / MB)
    return F.when(F.coalesce(longest_seconds, F.lit(0.0)) > 0, base + F.greatest(F.lit(0), decoded - (base - _of(RESIDENT_MB)))).otherwise(base)


def workers(machines: DataFrame) -> DataFrame:
    """``machines`` (classifier, requested, total_mb, free_mb, free_vram_mb, gpu_ok, cpus, vm, gpu_mode, hybrid, longest_s) with ``budget``.

    A struct of per_worker_mb, max_workers, gpu_workers, cpu_workers, limit
    (null, cores, memory, free_memory, unmeasured, gpu, refused). A null total
    was not measured, and cores alone limit; nothing fits: all are 0.
    """
    c = F.greatest(F.lit(1), "cpus")
    asked = F.when(F.coalesce("requested", F.lit(0)) > 0, F.col("requested")).otherwise(F.greatest(F.lit(1), c - 1))
    start = F.struct(c.alias("c"), asked.alias("asked"), F.greatest(F.lit(1), F.least(asked, c)).alias("run"), worker_mb(F.col("longest_s")).cast("long").alias("pw"), F.when(F.col("vm"), RESERVE_VM_MB).otherwise(RESERVE_MB).alias("reserve"))

    def memory(s: Column) -> Column:
        whole = F.floor(F.greatest(F.lit(0), F.col("total_mb") - s["reserve"]) / s["pw"])
        now = F.when(F.col("free_mb").isNotNull(), F.floor(F.greatest(F.lit(0), F.col("free_mb") - HEADROOM_MB) / s["pw"]))
        cap = F.when(F.col("total_mb").isNull(), s["c"].cast("long")).otherwise(F.least(whole, F.coalesce(now, whole)))
        return bound(F.struct(s.alias("s"), cap.alias("cap"), F.coalesce(now < whole, F.lit(False)).alias("short")), split)

    def split(x: Column) -> Column:
        s = x["s"]
        most = F.least(s["c"].cast("long"), x["cap"])
        ram = F.least(s["run"].cast("long"), most)
        use = F.col("gpu_mode").isin("auto", "on") & F.coalesce("gpu_ok", F.lit(True))
        gpu = F.when(use, F.greatest(F.lit(0), F.least(ram, F.when(F.col("free_vram_mb").isNull(), F.lit(GPU_UNKNOWN)).otherwise(F.floor(F.col("free_vram_mb") / GPU_MB))))).otherwise(F.lit(0))
        return bound(F.struct(x.alias("x"), most.alias("most"), ram.alias("ram"), gpu.cast("long").alias("gpu")), finish)

    def finish(y: Column) -> Column:
        s, short = y["x"]["s"], y["x"]["short"]
        cpu = F.when(y["gpu"] == 0, y["ram"]).when(F.col("hybrid") & (y["ram"] > y["gpu"]), F.least(s["c"].cast("long"), y["ram"]) - y["gpu"]).otherwise(F.lit(0))
        capped = (y["most"] < s["run"]) | (y["most"] < s["asked"])
        limit = (
            F.when(F.col("total_mb").isNull(), "unmeasured").when(y["most"] <= 0, "refused").when(capped & (y["x"]["cap"] >= s["c"]), "cores").when(capped & short, "free_memory").when(capped, "memory")
            .when(y["gpu"] + cpu < s["asked"], "gpu")
        )
        none = F.lit(0).cast("long")
        refused = y["most"] <= 0
        return F.struct(s["pw"].alias("per_worker_mb"), F.when(refused, none).otherwise(y["most"]).alias("max_workers"), F.when(refused, none).otherwise(y["gpu"]).alias("gpu_workers"), F.when(refused, none).otherwise(cpu.cast("long")).alias("cpu_workers"), limit.alias("limit"))

    return machines.withColumn("budget", bound(start, memory))


def longest(files: DataFrame, n: int = 8) -> DataFrame:
    """One row (longest_s): the longest of the ``n`` largest files."""
    return files.orderBy(F.desc("size_bytes"), "path").limit(n).agg(F.max("duration_s").alias("longest_s"))
