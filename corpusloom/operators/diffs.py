"""Diff stage: normalised diffs of file modifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import is_ascii, strip


def clean_diff(diff: Column, line_sep: str = "\n") -> Column:
    """Stripped lines without empty ones and bare hunk headers, joined and ended by the separator, runs of blanks as one space."""
    lines = F.transform(F.split(diff, "\n"), strip)
    lines = F.filter(lines, lambda x: (x != "") & ~(x.startswith("@@") & x.endswith("@@")))
    joined = F.when(F.size(lines) > 0, F.concat(F.array_join(lines, line_sep), F.lit(line_sep))).otherwise(F.lit(""))
    return F.regexp_replace(joined, r"[\t\x0b-\r\x1c-\x20]+", " ")


def clean_mods(mods: Column, line_sep: str = "\n") -> Column:
    """Modifications with an ASCII diff, the diff cleaned; those with a null or other diff go."""
    kept = F.filter(mods, lambda m: m["diff"].isNotNull() & is_ascii(m["diff"]))
    return F.transform(kept, lambda m: m.withField("diff", clean_diff(m["diff"], line_sep)))


def clean_diffs(df: DataFrame, mods: str = "mods", line_sep: str = "\n") -> DataFrame:
    """``df`` with cleaned modifications; rows in which no diff has text go."""
    return df.withColumn(mods, clean_mods(F.col(mods), line_sep)).where(F.exists(mods, lambda m: F.length(m["diff"]) > 0))
