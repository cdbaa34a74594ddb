"""Descriptive statistics: describe, pivots with totals, ratios, counters, top-k, splits, counts of flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from corpusloom.operators.prefix import ranged_prefix

PERCENTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def describe(df: DataFrame, value: str, by: list[str] = (), percentiles=PERCENTILES) -> DataFrame:
    """count, mean, std, min, percentiles (p01 ...), max of a column, by group."""
    cuts = [F.percentile(value, F.lit(p)).alias(f"p{round(p * 100):02d}") for p in percentiles]
    return df.groupBy(*by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), *cuts, F.max(value).alias("max")
    )


def totals(df: DataFrame, row: str, column: str, value: str, distinct: bool = False) -> DataFrame:
    """row, column, n with an 'All' row and column; distinct counts are made anew for the totals, not summed."""
    n = F.countDistinct(value) if distinct else F.count(value)
    cubed = df.cube(row, column).agg(n.alias("n"), F.grouping(row).alias("_r"), F.grouping(column).alias("_c"))
    return cubed.select(F.when(F.col("_r") == 1, "All").otherwise(F.col(row)).alias(row), F.when(F.col("_c") == 1, "All").otherwise(F.col(column)).alias(column), "n")


def pivot_totals(df: DataFrame, row: str, column: str, value: str, values: list, distinct: bool = False) -> DataFrame:
    return totals(df, row, column, value, distinct).groupBy(row).pivot(column, [*values, "All"]).agg(F.first("n"))


def repo_stats(df: DataFrame) -> DataFrame:
    """Commits per repo with the shares of all and of its language, in percent."""
    by = df.groupBy("repo").agg(F.count("*").alias("n"), F.min("language").alias("language"))
    langs = by.groupBy("language").agg(F.sum("n").alias("_lang"))
    whole = by.agg(F.sum("n").alias("_all"))
    return (
        by.join(langs, by["language"].eqNullSafe(langs["language"])).drop(langs["language"]).join(F.broadcast(whole))
        .select("repo", "language", "n", (F.col("n") * 100.0 / F.col("_all")).alias("percent_all"), (F.col("n") * 100.0 / F.col("_lang")).alias("percent_language"))
    )


def author_stats(df: DataFrame, history: DataFrame, skip_single: bool = False) -> DataFrame:
    """Commits per author against those of the original history (author, num_commits_orig)."""
    by = df.groupBy("author").agg(F.count("*").alias("num_commits")).join(history, "author")
    if skip_single:
        by = by.where("num_commits_orig > 1")
    return by.withColumn("percent_commits", F.try_divide(F.col("num_commits") * 100.0, "num_commits_orig"))


def merge_counters(df: DataFrame, counts: str, by: list[str] = ()) -> DataFrame:
    """key, n: the sums of map columns, by group."""
    return df.select(*by, F.explode(counts).alias("key", "_n")).groupBy(*by, "key").agg(F.sum("_n").alias("n"))


def top_k(counted: DataFrame, k: int, by: list[str] = ()) -> DataFrame:
    """The k largest n, ties by key; by group if asked."""
    if not by:
        return counted.orderBy(F.desc("n"), "key").limit(k)
    ranked = counted.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "key")))
    return ranked.where(F.col("_k") <= k).drop("_k")


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the first by ``order``; aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(F.min_by(F.struct(order, *rest), order).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def stratified_split(df: DataFrame, strata: str, key: str, shares=(("train", 0.8), ("val", 0.1), ("test", 0.1)), seed: str = "42") -> DataFrame:
    """``df`` with part: within each stratum, rows in the order of a hash of the key are cut by the shares.

    Ranks are prefix sums over 256 ranges of the hash, so a stratum with most of the rows is no single task's work.
    """
    hashed = df.withColumns({"_h": F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), "_one": F.lit(1).cast("long")})
    bucket = F.conv(F.substring("_h", 1, 2), 16, 10).cast("int")
    ranked = ranged_prefix(hashed, strata, bucket, ["_h", key], "_one", "_before").withColumn("_r", F.col("_before") + 1)
    sizes = df.groupBy(F.col(strata).alias("_s")).agg(F.count("*").alias("_n"))
    ranked = ranked.join(sizes, ranked[strata].eqNullSafe(sizes["_s"]))
    part, upto = F.lit(shares[-1][0]), 0.0
    cuts = []
    for name, share in shares[:-1]:
        upto += share
        cuts.append((name, upto))
    for name, cut in reversed(cuts):
        part = F.when(F.col("_r") <= F.round(F.col("_n") * F.lit(cut)), F.lit(name)).otherwise(part)
    return ranked.withColumn("part", part).drop("_h", "_one", "_before", "_r", "_s", "_n")


def value_counts(df: DataFrame, flag: str, by: list[str] = (), drop_null: bool = True) -> DataFrame:
    rows = df.where(F.col(flag).isNotNull()) if drop_null else df
    return rows.groupBy(*by, flag).count().withColumnRenamed("count", "n")


def count_and_sum(df: DataFrame, by: list[str], value: str, total: str = "total") -> DataFrame:
    """by, n, total: rows and the sum of a column, by group."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(value).alias(total))


def ratio(df: DataFrame, part: str, whole: str, out: str, percent: bool = True) -> DataFrame:
    """``df`` with one column's share of another; null where the whole is zero."""
    return df.withColumn(out, F.try_divide(F.col(part) * F.lit(100.0 if percent else 1.0), F.col(whole)))


def ratio_of(part: DataFrame, whole: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """keys, out: 100 times a value in one table by that of the same key in another; keys that only one has give null."""
    a, b = part.select(*keys, F.col(value).alias("_a")), whole.select(*keys, F.col(value).alias("_b"))
    return ratio(a.join(b, keys, "full"), "_a", "_b", out).select(*keys, out)


def describe_groups(df: DataFrame, part: str, group: str, percentiles=PERCENTILES) -> DataFrame:
    """Rows for each group, described for each part: two levels of one aggregation."""
    return describe(df.groupBy(part, group).agg(F.count("*").alias("n")), "n", [part], percentiles)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df``, and its number of rows as counted on the way by whatever action runs next (``.get["n"]``, which waits for it): no extra pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen
