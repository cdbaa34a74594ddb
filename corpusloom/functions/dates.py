"""Dates as commit files write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: day first, to the second
DATE = "dd.MM.yyyy HH:mm:ss"


def format_date(x: Column) -> Column:
    """A timestamp as text."""
    return F.date_format(x, DATE)


def parse_date(x: Column) -> Column:
    """The timestamp of such a text, in the session's time zone; null for anything else."""
    return F.try_to_timestamp(x, F.lit(DATE))
