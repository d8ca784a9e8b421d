"""Checks of results against expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, field, failure) of expectations that don't hold; null failure: it holds.

    expected: key, field, kind (expect, close, min, present), value, tol;
    found: key, field, value - values as text. A key without rows is missing.
    """
    have = found.select(key).distinct().withColumn("_seen", F.lit(True))
    f = found.select(key, "field", F.col("value").alias("_v"))
    j = expected.join(have, key, "left").join(f, [key, "field"], "left")
    want = F.col("value").try_cast("double")
    number = F.col("_v").try_cast("double")
    ok = (
        F.when(F.col("kind") == "expect", F.col("_v") == F.col("value")).when(F.col("kind") == "close", F.abs(number - want) <= F.coalesce("tol", F.lit(0.0)))
        .when(F.col("kind") == "min", number >= want).otherwise(F.coalesce("_v", F.lit("")) != "")
    )
    return j.select(key, "field", F.when(F.col("_seen").isNull(), "missing").when(~F.coalesce(ok, F.lit(False)), F.col("kind")).alias("failure"))
