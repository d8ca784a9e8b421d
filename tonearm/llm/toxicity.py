"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, any documents are the unlabelled
set; labelled clean documents are used for nothing but the class prior. A
linear model over the presence of words and word beginnings is trained in
numpy on the corrected risk

    prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)),

whose second part, the risk on negatives, is pushed back up whenever it would
fall below zero. Scores are the logistic of the model's sum.

The training sample is bounded: at most ``POSITIVES`` and ``UNLABELLED``
different documents, chosen by the hash of their ids (of equal rows one), and
at most ``FEATURES`` features.
Every whole text is scored.

Defined cases: null and empty texts get the score of no evidence; a null
doc_id is never held out, labelled or sampled; repeated rows get equal
scores; contradicting labels count as toxic; without positives the score is 0
everywhere; other columns are passed through under ``row``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import drop, save, ship

#: Bounds of the training sample and of the model.
POSITIVES, UNLABELLED, FEATURES = 4_000, 10_000, 4_096
#: Lengths of the word beginnings that are features besides whole words.
STEMS = (4, 5, 6)
#: A feature is in so many positives, and in this share of them, at least, and so many times as often there as in the unlabelled
#: set, relative to the most that the class prior allows.
LEAST_COUNT, LEAST_SHARE, LEAST_LIFT = 4, 0.006, 0.5
STEPS, RATE, DECAY = 300, 0.1, 1e-3
#: Prior where no labels tell, and its bounds.
PRIOR = 0.1

_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)]


def feature_set(text: str | None) -> set[str]:
    """Words and beginnings of a text; those that occur more than once also as such."""
    total: Counter[str] = Counter()
    for w, n in Counter(_WORD.findall((text or "").lower())).items():
        for f in features(w):
            total[f] += n
    return {*total, *(f"{f}+" for f, n in total.items() if n > 1)}


def _feature_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [sorted(feature_set(t)) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:1], *b.columns[2:], pa.array(out, pa.list_(pa.string()))], ["positive", "doc_id", "h", "features"])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 by 5; such rows' labels are never read."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


class Model:
    """Weights by feature; ``score`` of a text is in [0, 1]."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.cache: dict[str, tuple[str, ...]] = {}

    def known(self, word: str) -> tuple[str, ...]:
        found = self.cache.get(word)
        if found is None:
            found = tuple(f for f in features(word) if f in self.weights or f"{f}+" in self.weights)
            if len(self.cache) >= 300_000:
                self.cache.clear()
            self.cache[word] = found
        return found

    def score(self, text: str | None) -> float:
        total: Counter[str] = Counter()
        for w, n in Counter(_WORD.findall((text or "").lower())).items():
            for f in self.known(w):
                total[f] += n
        seen = [*total, *(f"{f}+" for f, n in total.items() if n > 1)]
        z = self.bias + sum(self.weights.get(f, 0.0) for f in sorted(seen))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias from documents as arrays of feature numbers."""

    def rows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        return np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64), len(docs)

    p, u = rows(positive), rows(unlabelled)
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)

    def value(d: tuple) -> np.ndarray:
        return np.bincount(d[0], w[d[1]], d[2]) + b

    def slope(d: tuple, g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(d[1], g[d[0]], size), g.sum()) / max(d[2], 1)

    def sigma(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    for t in range(1, STEPS + 1):
        zp, zu = value(p), value(u)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        back = slope(u, sigma(zu)) - prior * slope(p, sigma(zp))
        grad = -back if negative < 0 else prior * slope(p, -sigma(-zp)) + back
        grad[:-1] += DECAY * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _first(keys: DataFrame, most: int, order: tuple) -> DataFrame:
    """The first ``most`` distinct rows by hash; twice as many as needed are cut out by it before anything is sorted."""
    n = keys.count()
    if n > 4 * most:
        cut = int(2 * most / n * 2.0**64) - 2**63
        few = keys.where(order[0] < cut).distinct()
        if few.count() >= most:
            return few.orderBy(*order).limit(most)
    return keys.distinct().orderBy(*order).limit(most)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of the rows that are not held out."""
    ship(spark)
    labels = labels.where(~held_out(F.col("doc_id"))).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    tally = labels.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    if not tally["p"]:
        return Model({}, -500.0)
    prior = float(np.clip(tally["p"] / tally["n"], 0.01, 0.5)) if tally["p"] < tally["n"] else PRIOR
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null").where(~held_out(F.col("doc_id")))
    rows = rows.withColumn("h", F.xxhash64("text"))
    keys = rows.select("doc_id", "h")
    toxic = labels.where("toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    # of equal ids and texts one row is enough, so the limits bound the rows of the sample
    order = (F.xxhash64("doc_id"), "doc_id", "h")
    pos = _first(keys.join(toxic, "doc_id", "left_semi"), POSITIVES, order).withColumn("positive", F.lit(1))
    unl = _first(keys, UNLABELLED, order).withColumn("positive", F.lit(0))
    chosen = F.broadcast(pos.union(unl))
    sample = rows.join(chosen, ["doc_id", "h"]).select("positive", "text", "doc_id", "h")
    sets = sample.mapInArrow(_feature_sets, "positive int, doc_id long, h long, features array<string>").dropDuplicates(["positive", "doc_id", "h"])
    sets, path = save(spark, sets.select("positive", "features"), "op2-sample")
    size = sets.groupBy().agg(F.sum("positive").alias("p"), F.count("*").alias("n")).first()
    n_p, n_u = size["p"] or 0, size["n"] - (size["p"] or 0)
    if not n_p or not n_u:
        return Model({}, -500.0)
    tallies = sets.select("positive", F.explode("features").alias("f")).groupBy("f").agg(F.sum("positive").alias("p"), F.count("*").alias("n"))
    lift = (F.col("p") / n_p) / ((F.col("n") - F.col("p") + 1) / (n_u + 1))
    best = tallies.where((F.col("p") >= max(LEAST_COUNT, LEAST_SHARE * n_p)) & (lift >= LEAST_LIFT / prior)).orderBy(F.desc("p"), "f").limit(FEATURES)
    names = [r["f"] for r in best.select("f").collect()]
    if not names:
        return Model({}, -500.0)
    number = {f: i for i, f in enumerate(names)}

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[number[f] for f in x if f in number] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], ["positive", "features"])

    rows = sorted(sets.mapInArrow(known, "positive int, features array<int>").collect(), key=lambda r: (r["positive"], r["features"]))
    drop(spark, path)
    parts = [[np.array(r["features"], np.int64) for r in rows if r["positive"] == k] for k in (1, 0)]
    w, b = train(*parts, len(names), prior)
    return Model(dict(zip(names, w.tolist(), strict=True)), b)


def scorer(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, bias)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.score(t) for t in b.column(1).to_pylist()], pa.float64())], ["row", "score"])

    return run


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """Every row (its columns, or those of ``carry``, under ``row``) with its score and ``predicted``."""
    row = F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row")
    kind = docs.select(row).schema["row"].dataType.simpleString()
    out = docs.select(row, F.col("text").cast("string").alias("text")).mapInArrow(scorer(model), f"row {kind}, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model, ["doc_id"])
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")
