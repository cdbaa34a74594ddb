"""Prefix sums that no single task has to hold: totals of key ranges first, then sums inside each range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranged_prefix(df: DataFrame, group: str, bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``group`` (null counts as a group) ordered before this one.

    ``bucket`` must not decrease along ``order`` and splits each group into ranges small enough for one task; only
    the range totals (one row a group and range) pass through the window of a whole group.
    """
    dealt = df.withColumn("_range", bucket)
    totals = dealt.groupBy(group, "_range").agg(F.sum(value).alias("_sum"))
    across = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_base")
    )
    inside = Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = local.join(starts, local[group].eqNullSafe(starts["_g"]) & (local["_range"] == starts["_r"]))
    return joined.withColumn(out, F.col("_base") + F.col("_local")).drop("_range", "_local", "_g", "_r", "_base")
