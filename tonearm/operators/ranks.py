"""Ranks inside groups of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import parallelism


def with_rank(rows: DataFrame, by: list[str], order: str, out: str = "rank", ties: list[str] | None = None) -> DataFrame:
    """Adds ``out``, 0.. in the order of the whole number ``order`` among rows with equal ``by``.

    Groups are dealt by ranges of ``order`` too, so a large one is many tasks:
    a row's rank is its rank in its range and the sizes of the ranges before.
    Null orders come first; equal ones are ranked by ``ties``, else in no
    particular order.
    """
    many = parallelism(rows.sparkSession)
    cuts = rows.agg(F.percentile_approx(order, [i / many for i in range(1, many)], 10_000)).first()[0] or [] if many > 1 else []
    bounds = F.array(*[F.lit(c).cast("bigint") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    # a generated column: the optimizer must not trade it for its expression, which has a lambda, on the other side of the join
    dealt = rows.withColumn("_range", F.explode(F.array(F.coalesce(F.size(F.filter(bounds, lambda b: b <= F.col(order))), F.lit(0)))))
    sizes = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(order, *(ties or []))) - 1
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    out_rows = dealt.withColumn("_own", own).join(sizes, same)
    return out_rows.withColumn(out, (F.col("_own") + F.col("_before")).cast("bigint")).select(*rows.columns, out)
