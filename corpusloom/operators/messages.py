"""Message stage: what is dropped, and the cleaning of what stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.cleaning import clean_lines
from corpusloom.functions.text import SPACE, is_ascii, one_token, strip

# fixed values: messages that say nothing, after punctuation has been padded with spaces
TRIVIAL = (
    r"\Aignore update ' .* \.\z",
    r"\Aupdate(d)? (changelog|gitignore|readme( . md| file)?)( \.)?\z",
    r"\Aprepare version (v)?[ \d.]+\z",
    r"\Abump (up )?version( number| code)?( to (v)?[ \d.]+( - snapshot)?)?( \.)?\z",
    r"\Amodify (dockerfile|makefile)( \.)?\z",
    r"\Aupdate submodule(s)?( \.)?\z",
    r"\Aupdated? \w+( \. \w+)?\z",
)


#: How a message begins wherever TRIVIAL can match: padding leaves its first word as it is.
TRIVIAL_START = rf"(?i)\A{SPACE}*+(?:ignore|update|prepare|bump|modify)"


def is_trivial(message: Column) -> Column:
    padded = F.regexp_replace(strip(message), r"([!-/:-@\[-`{-~])", " $1 ")
    padded = strip(F.regexp_replace(padded, " +", " "))
    return message.rlike(TRIVIAL_START) & padded.rlike("(?di)" + "|".join(f"(?:{p})" for p in TRIVIAL))


def is_merge(message: Column) -> Column:
    return message.startswith("Merge")


def is_revert(message: Column) -> Column:
    return message.startswith("Revert")


def is_squash(message: Column, line_sep: str = "\n") -> Column:
    """More than one line, and all after the first are list items."""
    if len(line_sep) == 1:  # then no two separators overlap, and a search for a line that is no item will do
        sep = rf"\Q{line_sep}\E"
        return message.contains(line_sep) & ~message.rlike(rf"{sep}(?!(?:(?!{sep}){SPACE})*+\*)")
    lines = F.split(message, rf"\Q{line_sep}\E")
    items = F.forall(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: x.rlike(rf"\A{SPACE}*\*"))
    return (F.size(lines) > 1) & items


def is_dropped(message: Column, line_sep: str = "\n") -> Column:
    """Null, not ASCII, of one word, trivial or by a bot, a merge, a revert or a squash."""
    bad = ~is_ascii(message) | is_merge(message) | is_revert(message) | one_token(message) | is_squash(message, line_sep) | is_trivial(message)
    return F.coalesce(bad, F.lit(True))


def clean_messages(df: DataFrame, message: str = "message", replace: bool = False, line_sep: str = "\n", keep_dropped: bool = False) -> DataFrame:
    """``df`` with its messages cleaned; rows whose message is dropped or comes out empty go (or hold '', on request)."""
    staged = df.withColumn("_ok", ~is_dropped(F.col(message)))
    lines = F.filter(clean_lines(F.split(message, "\n"), replace), lambda x: x != "")
    # past a generator no filter is pushed: else the cleaning runs again, several times, in what drops rows below
    staged = staged.withColumn(message, F.explode_outer(F.array(F.when(F.col("_ok"), F.array_join(lines, line_sep)).otherwise(""))))
    staged = staged.withColumn(message, F.when(is_dropped(F.col(message), line_sep), F.lit("")).otherwise(F.col(message))).drop("_ok")
    return staged if keep_dropped else staged.where(F.length(message) > 0)
