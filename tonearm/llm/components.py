"""Connected components by alternating large-star and small-star rounds.

Edges stay distributed: a round is one aggregation and one join per star, its
result is written to the shared folder, and nothing but two counts reaches the
driver. A vertex with very many edges costs one row per edge, never a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import drop, save

MAX_ROUNDS = 60


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """``edges`` (u, v). Large: neighbours above u go to the least neighbour; small: those below."""
    if small:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    out = both.join(low, "u")
    if small:
        out = out.select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v"))
    else:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, list[str]]:
    """(vertex, root) of every vertex with an edge; root is the least vertex of its component.

    Null ends and loops are ignored; repeated edges count once; no edges give no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e, path = save(spark, e.distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        # done when no root hangs below another vertex and no vertex has two roots
        kids = e.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        state = kids.agg(F.count("*").alias("kids"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.coalesce(F.sum(F.when(F.col("v") > F.col("u"), 1).otherwise(0)), F.lit(0)).alias("up")).first()
        if not state["up"] and state["kids"] == state["edges"] and e.select("v").join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        nxt, p = save(spark, _star(_star(e, False), True), "edges")
        drop(spark, path)
        e, path = nxt, p
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()), [path]
