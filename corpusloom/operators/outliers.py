"""Outlier stage: sizes of messages and modifications, percentiles of the training part, out-of-range rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import n_tokens

DIFF_STATS = ("num_tokens", "num_chars", "num_mods")
MESSAGE_STATS = ("num_tokens", "num_chars")


def message_stats(message: Column) -> Column:
    """struct(num_tokens, num_chars); nulls for a null message."""
    return F.struct(n_tokens(message).cast("long").alias("num_tokens"), F.length(message).cast("long").alias("num_chars"))


def _header(m: Column) -> Column:
    kind, old, new = m["change_type"], F.coalesce(m["old_path"], F.lit("None")), F.coalesce(m["new_path"], F.lit("None"))
    return (
        F.when(kind == "ADD", F.concat(F.lit("new file "), new, F.lit("\n")))
        .when(kind == "DELETE", F.concat(F.lit("deleted file "), old, F.lit("\n")))
        .when(kind == "RENAME", F.concat(F.lit("rename from "), old, F.lit("\nrename to "), new, F.lit("\n")))
        .when(kind == "COPY", F.concat(F.lit("copy from "), old, F.lit("\ncopy to "), new, F.lit("\n")))
        .otherwise(F.concat(new, F.lit("\n")))
    )


def mods_stats(mods: Column) -> Column:
    """struct(num_tokens, num_chars, num_mods); UNKNOWN ones count only as modifications; a null diff in another nulls all."""
    known = F.filter(mods, lambda m: ~m["change_type"].eqNullSafe(F.lit("UNKNOWN")))
    bad = F.exists(known, lambda m: m["diff"].isNull()) | mods.isNull()
    zero = F.lit(0).cast("long")
    tokens = F.aggregate(known, zero, lambda s, m: s + n_tokens(_header(m)) + n_tokens(m["diff"]))
    chars = F.aggregate(known, zero, lambda s, m: s + F.length(_header(m)) + F.length(m["diff"]))
    count = F.size(mods).cast("long")
    return F.struct(F.when(~bad, tokens).alias("num_tokens"), F.when(~bad, chars).alias("num_chars"), F.when(~bad, count).alias("num_mods"))


def percentiles(df: DataFrame, columns: list[str], lower: float = 5, upper: float = 95, part: str | None = "train") -> DataFrame:
    """One row: <column>_lower and <column>_upper by linear interpolation, nulls ignored, over the training part."""
    rows = df.where(F.col("part") == part) if part else df
    both = rows.agg(*[F.percentile(c, F.array(F.lit(lower / 100), F.lit(upper / 100))).alias(c) for c in columns])
    return both.select(*[F.get(c, F.lit(i)).alias(f"{c}_{end}") for c in columns for i, end in enumerate(("lower", "upper"))])


def save_percentiles(thresholds: DataFrame, folder: str, lower: float = 5, upper: float = 95) -> None:
    """Write diff.json and message.json: one object a file, {percentile: {statistic: value}}."""
    row = thresholds.first().asDict()
    for name, prefix in (("diff", "diff_"), ("message", "msg_")):
        found = {
            f"{p:g}": {c[len(prefix) : -len(end) - 1]: v for c, v in row.items() if c.startswith(prefix) and c.endswith(f"_{end}")}
            for p, end in ((lower, "lower"), (upper, "upper"))
        }
        text = thresholds.sparkSession.createDataFrame([(json.dumps(found),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{folder}/{name}.json")


def load_percentiles(spark: SparkSession, folder: str, lower: float = 5, upper: float = 95) -> DataFrame:
    """The row of thresholds from files of :func:`save_percentiles` (or single files of that form); numbers are numbers again."""
    made = {}
    for name, prefix in (("diff", "diff_"), ("message", "msg_")):
        text = "".join(r["value"] for r in spark.read.text(f"{folder}/{name}.json").collect())
        held = {float(p): stats for p, stats in json.loads(text).items()}
        for p, end in ((lower, "lower"), (upper, "upper")):
            made |= {f"{prefix}{c}_{end}": float(v) for c, v in held[p].items()}
    return spark.createDataFrame([tuple(made.values())], ", ".join(f"{c} double" for c in made))


def check_stats(chosen, allowed) -> tuple[str, ...]:
    chosen = tuple(chosen or allowed)
    if unknown := set(chosen) - set(allowed):
        raise ValueError(f"unknown statistics: {sorted(unknown)}")
    return chosen


def drop_outliers(df: DataFrame, thresholds: DataFrame, columns: list[str], upper_bounds: dict[str, float] | None = None) -> DataFrame:
    """Rows of which every column is known and within its thresholds (a table of one row), both ends included."""
    good = F.lit(True)
    for c in columns:
        good = good & F.col(c).isNotNull() & (F.col(c) >= F.col(f"{c}_lower")) & (F.col(c) <= F.col(f"{c}_upper"))
        if upper_bounds and c in upper_bounds:
            good = good & (F.col(c) <= upper_bounds[c])
    return df.join(F.broadcast(thresholds)).where(good).select(*df.columns)
