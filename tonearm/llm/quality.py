"""Quality rules: plain counts per document, then a hashed n-gram likelihood ratio.

All of it is DataFrame expressions. Words are hashed once per document; the
hashes of single words and of neighbouring pairs fall into ``BUCKETS``
buckets. Two multinomials over the buckets are estimated, one from the
trusted documents (``labels.quality = 1``), one from all documents, and a
document's score is the mean logarithm of their ratio over its n-grams.
A document is kept if it passes the base rules and its score reaches
``THRESHOLD``.

The two count vectors cover every document and have ``BUCKETS`` rows, however
large the input is: they are the only thing that is gathered. Counting is
pre-aggregated per task, so a frequent word costs one row per task.

Defined cases: null and empty texts have zero counts, score 0.0 and fail the
base rules; a null doc_id is never trusted; repeated rows are judged alike
and each counts; without labels the ratio is 0 everywhere and every document
that passes the base rules is kept; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hash buckets of single words and word pairs.
BUCKETS = 1 << 16
#: Least mean log likelihood ratio of a kept document.
THRESHOLD = -0.2
#: Base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Trusted ids up to this many are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 2_000_000

SPACE = r"[\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """Maximal runs of characters that are not ASCII white space."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _windows(hashes: Column) -> Column:
    """A hash of each run of ``WINDOW`` neighbouring words; empty for shorter texts."""
    at = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
    made = F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(WINDOW)]))
    return F.when(F.size(hashes) >= WINDOW, made).otherwise(F.array().cast("array<bigint>"))


def _repeat_words(windows: Column) -> Column:
    """Words that lie in a window found twice or more; only texts with such a window are sorted."""

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))

        def step(acc: Column, p: Column) -> Column:
            end = (p + WINDOW).cast("bigint")
            return F.struct((acc["n"] + end - F.greatest(p.cast("bigint"), acc["end"])).alias("n"), end.alias("end"))

        return F.aggregate(at, zero, step, lambda acc: acc["n"])

    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # the null comparisons at both ends of the sorted array are not matches
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(_bind(pairs, covered))


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = docs.select(row, F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    out = out.withColumn("w", words(F.col("text")))
    return out.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))


def _grams(hashes: Column) -> Column:
    """Buckets of all single words, then of all pairs of neighbours."""
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    two = F.transform(hashes, lambda h, i: F.pmod(F.xxhash64(F.get(hashes, i - 1), h), F.lit(BUCKETS)).cast("int"))
    return F.concat(one, F.slice(two, 2, F.greatest(F.size(hashes), F.lit(1))))


def ratios(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row: ``model``, the log ratio of each bucket's two probabilities."""
    trusted = trusted.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    n = trusted.limit(BROADCAST_ROWS + 1).count()
    trusted = trusted.withColumn("good", F.lit(1))
    rows = docs.select("doc_id", "text").join(F.broadcast(trusted) if n <= BROADCAST_ROWS else trusted, "doc_id", "left")
    hashed = rows.select(F.coalesce("good", F.lit(0)).alias("good"), words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w"))
    hashed = hashed.select("good", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    counts = hashed.select("good", F.explode(_grams(F.col("h"))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("all"), F.sum("good").alias("good"))
    spark = docs.sparkSession
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").select("bucket", F.coalesce("all", F.lit(0)).alias("all"), F.coalesce("good", F.lit(0)).alias("good"))
    row = filled.agg(F.array_sort(F.collect_list(F.struct("bucket", "all", "good"))).alias("c"), F.sum("all").alias("n"), F.sum("good").alias("g"))
    log = F.transform("c", lambda x: F.log((x["good"] + 1) / (F.col("g") + BUCKETS)) - F.log((x["all"] + 1) / (F.col("n") + BUCKETS)))
    flat = F.transform("c", lambda x: F.lit(0.0))
    return row.select(F.when(F.col("g") > 0, log).otherwise(flat).alias("model"))


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, score and verdict of every row of ``docs``; its own columns are under ``row``."""
    model = ratios(docs, trusted).scalar()
    out = _hashed(docs)
    out = out.withColumn("win", _windows(F.col("h")))
    out = out.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(rf"[^\x20\x09-\x0D]"))))
    out = out.select(
        "row", "doc_id",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("win")).alias("n_repeat_words"),
        _grams(F.col("h")).alias("grams"),
    )
    total = F.aggregate("grams", F.lit(0.0), lambda acc, b: acc + F.get(F.col("_model"), b))
    score = F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("_model", model).withColumn("score", score).withColumn("base_failed", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    # a generated row: filters on it stay above, else the optimizer would repeat these expressions inside their lambdas
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return out.select("row", F.explode(F.array(F.struct(*names))).alias("_j")).select("row", "_j.*")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = judge(docs, trusted_ids(spark, sf_dir))
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
