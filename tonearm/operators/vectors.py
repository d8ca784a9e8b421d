"""Votes of nearest neighbours, and class scores in arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..runtime import ship


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


#: References and queries in a block. Each block of queries meets each block of references once, as two matrices, and only a
#: query's nearest of each block go on.
BLOCK, ASKED = 1024, 256


def knn_votes(queries: DataFrame, reference: DataFrame, k: int = 15) -> DataFrame:
    """(query_id, label, share): the k nearest by cosine vote with weight 1 / max(1 - cosine, 1e-6).

    ``queries`` is a stated set; each of them meets all of ``reference``,
    block by block, whatever its size. Rows without id and vectors that are
    null, of length zero or infinite, or have nulls take no part; vectors of
    different sizes are not neighbours; of equal cosines the lower ref_id is
    nearer.
    """
    spark = reference.sparkSession
    ship(spark)
    emb = F.col("emb").cast("array<double>")
    sound = lambda df, key: df.withColumn("emb", emb).withColumn("norm", F.sqrt(dot("emb", "emb"))).where(F.col(key).isNotNull() & (F.col("norm") > 0) & (F.col("norm") < float("inf")))
    q, r = sound(queries, "query_id"), sound(reference, "ref_id")
    blocks, asked = max(1, -(-reference.count() // BLOCK)), max(1, -(-queries.count() // ASKED))
    # small in bytes, not in work: by number, so that they aren't coalesced into one task
    parts = min(blocks, 1000)
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n).cast("bigint"))
    r = r.groupBy(dealt("ref_id", blocks).alias("block")).agg(F.collect_list(F.struct("ref_id", "label", "emb", "norm")).alias("refs"))
    q = q.groupBy(dealt("query_id", asked).alias("_a")).agg(F.collect_list(F.struct("query_id", "emb", "norm")).alias("asks"))
    q = q.select("asks", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"))
    kinds = [queries.schema["query_id"].dataType, DoubleType(), reference.schema["ref_id"].dataType, reference.schema["label"].dataType]
    out = StructType([StructField(n, t) for n, t in zip(("query_id", "sim", "ref_id", "label"), kinds, strict=True)])
    near = q.repartition(parts, "block").join(r.repartition(parts, "block"), "block").select("asks", "refs").mapInArrow(nearest(k), out)
    near = near.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "ref_id"))).where(F.col("pos") <= k)
    votes = near.groupBy("query_id", "label").agg(F.sum(1 / F.greatest(1 - F.col("sim"), F.lit(1e-6))).alias("w"), F.min("pos").alias("first"))
    return votes.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("query_id")))


def nearest(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each block of queries, the k nearest of a block of references.

    A matrix product finds who can be among them; their cosines are then
    summed element by element, so that equal vectors get equal ones wherever
    they stand in a block.
    """

    def matrix(emb: pa.ListArray, rows: np.ndarray) -> np.ndarray:
        return emb.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for asks, refs in zip(b.column(0), b.column(1), strict=True):
                (q_id, q_emb, q_norm), (r_id, label, r_emb, r_norm) = asks.values.flatten(), refs.values.flatten()
                sizes = q_emb.value_lengths().to_numpy(), r_emb.value_lengths().to_numpy()
                for size in np.intersect1d(*sizes):
                    q, r = (np.flatnonzero(n == size) for n in sizes)
                    x, y, nx, ny = matrix(q_emb, q), matrix(r_emb, r), q_norm.to_numpy()[q], r_norm.to_numpy()[r]
                    ids, own = (c.take(pa.array(rows)).to_numpy(zero_copy_only=False) for c, rows in ((r_id, r), (q_id, q)))
                    place = np.argsort(np.argsort(ids, kind="stable"))
                    sims = np.where(own[:, None] == ids, -np.inf, (x @ y.T) / (nx[:, None] * ny))
                    least = np.partition(sims, max(len(r) - k, 0), axis=1)[:, max(len(r) - k, 0)] - 1e-9
                    i, j = np.nonzero((sims >= least[:, None]) & (sims > -np.inf))
                    for at in range(0, len(i), 65_536):  # many equal vectors may all be among the nearest
                        a, c = i[at : at + 65_536], j[at : at + 65_536]
                        sims[a, c] = np.cumsum(x[a] * y[c], axis=1)[:, -1] / (nx[a] * ny[c])
                    order = np.lexsort((place[j], -sims[i, j], i))
                    i, j = i[order], j[order]
                    first = np.arange(len(i)) - np.searchsorted(i, i)
                    i, j = i[first < k], j[first < k]
                    rows = pa.array(r[j])
                    yield pa.RecordBatch.from_arrays([q_id.take(pa.array(q[i])), pa.array(sims[i, j]), r_id.take(rows), label.take(rows)], ["query_id", "sim", "ref_id", "label"])

    return run


def predict(votes: DataFrame) -> DataFrame:
    """The label with the largest share; of equals that of the nearest neighbour."""
    return votes.groupBy("query_id").agg(F.max_by("label", F.struct("share", -F.col("first"))).alias("label"))


def top_classes(scores: str, n: int, least: float) -> Column:
    """Indices of the ``n`` highest scores from ``least`` on; equal scores keep their order."""
    ranked = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("s"), i.alias("i"))))
    return F.transform(F.filter(F.slice(ranked, 1, n), lambda x: -x["s"] >= least), lambda x: x["i"])


def majority(votes: DataFrame, owner: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each owner; of equals the one that came first."""
    g = votes.groupBy(owner, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return g.groupBy(owner).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value), F.max("n").alias("votes"))
