"""What a Python worker takes for a task, and what it still holds after it."""

import subprocess
import sys
from pathlib import Path

import public_tokenizers
import pytest

from tonearm.llm import packing, substrings

ROOT = Path(__file__).resolve().parents[2]
RUN = """
import re, sys
import numpy as np
import pyarrow as pa
from tonearm.llm import substrings

def held():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    r = np.random.default_rng(5)
    for k in range(4):
        text = [bytes(r.integers(97, 123, 4000, np.uint8)).decode() for _ in range(2000)]
        cols = [pa.array(range(2000 * k, 2000 * k + 2000), pa.int64()), pa.array(text), pa.array([np.array([5, 120], np.int64).tobytes()] * 2000, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols[:2] if sys.argv[1] == "_pieces" else cols, ["ord", "text", "spans"][: 2 + (sys.argv[1] != "_pieces")])

before = held()
rows = sum(b.num_rows for b in getattr(substrings, sys.argv[1])(batches()))
assert rows >= 8000
print(held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read")
@pytest.mark.parametrize("name", ["_pieces", "_cut"])
def test_freed_memory_goes_back_after_a_task(name):
    out = subprocess.run([sys.executable, "-c", RUN, name], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    assert float(out) < 60


def test_op5_asks_for_small_batches(spark):
    docs = spark.createDataFrame([(1, "a" * 300), (2, None)], "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(spark, docs).collect()}
    assert got == {1: 299, 2: 0}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_packing_asks_for_small_batches(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"] for r in packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert got == {1, 2}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
