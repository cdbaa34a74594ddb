"""Dense surrogate ids in first-seen order, numbered range by range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import materialize

_BITS = 33  # of monotonically_increasing_id that count within a partition


def surrogate_ids(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, id: one row for each distinct key (null is a value), numbered from 0 by its earliest place in ``order``.

    Keys first seen at the same place are ordered by themselves. Rows are sorted in ranges; only the size of each range,
    one row a partition, passes through the window that numbers them all. An empty table gives an empty result.
    """
    firsts = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_place"))
    by = ["_place", *keys]
    placed = materialize(firsts.repartitionByRange(*by).sortWithinPartitions(*by).select(*keys, F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", _BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = placed.join(F.broadcast(starts), part == starts["_part"])
    return numbered.select(*keys, (F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))).alias("id"))
