"""The stateless stages on a stream of commits, and exact repeats within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import diffs, messages, outliers
from corpusloom.plans.pipeline import with_stats


def clean_stream(commits: DataFrame, thresholds: DataFrame | None = None, columns: list[str] | None = None, line_sep: str = "\n", replace: bool = False) -> DataFrame:
    """Outliers by thresholds fitted before on a batch (a static table of one row), then messages and diffs."""
    if thresholds is not None:
        names = commits.columns
        commits = outliers.drop_outliers(with_stats(commits), thresholds, columns, None).select(*names)
    return diffs.clean_diffs(messages.clean_messages(commits, replace=replace, line_sep=line_sep), line_sep=line_sep)


def first_within(stream: DataFrame, text: str, time: str, delay: str) -> DataFrame:
    """The first row of each text within the watermark; unlike in a batch, a row that was let through cannot be taken back."""
    return stream.withWatermark(time, delay).withColumn("_h", F.md5(text)).dropDuplicatesWithinWatermark(["_h"]).drop("_h")
