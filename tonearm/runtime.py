"""Session plumbing shared by operators: code shipping and tables in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Most bytes of rows in one Arrow batch; a longer single row is a batch of its own.
ARROW_BYTES = 16 << 20
#: The same where a batch becomes many times its size in a worker.
SMALL_BYTES = 4 << 20
_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession, batch_bytes: int = ARROW_BYTES) -> None:
    """Send this package to the executors once per application.

    Functions that run in Python workers are pickled by reference, so each
    worker has to be able to import the package, wherever it runs.
    """
    # batches of whole texts are held in a worker several times over while they are worked on
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    sc = spark.sparkContext
    if getattr(sc, "_tonearm_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    out = os.path.join(tempfile.mkdtemp(prefix="tonearm-"), "tonearm_code.zip")
    Path(out).write_bytes(data.getvalue())
    sc.addPyFile(out)
    sc._tonearm_shipped = True


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` over a task's batches, with freed memory given back at the end.

    Spark keeps a worker for later tasks, and what its allocators hold counts
    for the executor while other tasks, with or without Python, run there.
    """

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError, TypeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the setting is absent in local mode, as in tests, is a
    temporary folder made and kept for the session.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not getattr(sc, "_tonearm_local", None):
            sc._tonearm_local = "file://" + tempfile.mkdtemp(prefix="tonearm-shared-")
        base = sc._tonearm_local
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back, which cuts its lineage."""
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables of :func:`save` that no later step reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def free(spark: SparkSession) -> None:
    """Give up the shuffle files of plans that are over; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
