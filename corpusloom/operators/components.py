"""Connected components by alternating large-star and small-star steps; edges never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import discard, materialize


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
        edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo > m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
    return moved.unionByName(least.select(F.col("m").alias("lo"), "hi")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that has an edge to another; component is the smallest node id reachable.

    Self loops, repeated edges and null endpoints are ignored; an empty input gives an empty result. Each round is
    written to the shared folder, so a lost executor only repeats one round.
    """
    current = materialize(
        edges.where(F.col(src) != F.col(dst))
        .select(F.least(src, dst).alias("lo"), F.greatest(src, dst).alias("hi"))
        .distinct()
    )
    before = _signature(current)
    while before[0]:
        starred = materialize(_large_star(current))
        following = materialize(_small_star(starred))
        discard(starred)
        discard(current)
        current, after = following, _signature(following)
        if after == before:
            break
        before = after
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
