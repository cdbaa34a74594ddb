"""Filters over finished examples: sentences, verb and object, lengths, licences; one row of flags an example."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# fixed values: licences that a corpus may take
LICENCES = ("Apache License 2.0", "MIT License", "BSD 3-Clause New or Revised License")


def per_text(function: Callable[[str], bool | None]) -> Callable[[Column], Column]:
    """A plug for a language model's judgement of a text: an Arrow-batched function of a text, null for null and where it raises IndexError.

    Takes the place of the native approximation of sentences, or judges verb and object, with whatever parser is at hand.
    """

    def judged(texts: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else function(x)
            except IndexError:
                return None

        return pd.Series([one(x) for x in texts], dtype="boolean").astype(object).where(lambda s: s.notna(), None)

    return F.pandas_udf(judged, "boolean")


def is_one_sentence(x: Column, mode: str = "newline", punct: Callable[[Column], Column] = T.one_sentence_punct) -> Column:
    """Whether a text is one sentence: by line ends, or by punctuation as ``punct`` judges it (a native approximation by default)."""
    if mode not in ("newline", "punct"):
        raise ValueError(f"unknown mode {mode!r}: newline or punct")
    return T.one_sentence(x) if mode == "newline" else punct(x)


def starts_with_verb_and_object(words: Iterable[tuple[str, str, int]]) -> bool | None:
    """Whether a parsed sentence's first word is its root verb and has a direct object as its first child.

    ``words``: (part of speech, relation, head) of each word, heads counted from 1, 0 for the root.
    """
    words = list(words)
    if not words:
        return None
    kind, relation, head = words[0]
    children = [r for _, r, h in words if h == 1]
    return kind == "VERB" and (relation.lower() == "root" or head == 0) and bool(children) and children[0] in ("dobj", "obj")


def first_verb_has_object(words: Iterable[tuple[str, str, int]]) -> bool | None:
    """Whether the first word is a verb and any word is its object: the looser form, for parsers that name objects ``obj``."""
    words = list(words)
    if not words:
        return None
    return words[0][0] == "VERB" and any(relation == "obj" and head == 1 for _, relation, head in words)


def diff_for_lengths(mods: Column) -> Column:
    """The diffs of an example joined by line ends, as the length filters count them."""
    return F.array_join(F.transform(mods, lambda m: m["diff"]), "\n")


def filter_row(message: Column, diff: Column, judged: Column, punct: Callable[[Column], Column] = T.one_sentence_punct, message_tokens: int = 30, diff_tokens: int = 100) -> list[Column]:
    """The five flags of an example, for one select."""
    return [
        judged.alias("is_vdo"),
        is_one_sentence(message, "newline").alias("first_sentence_newline"),
        is_one_sentence(message, "punct", punct).alias("first_sentence_punct"),
        T.no_longer_than(message, message_tokens).alias(f"message_{message_tokens}_tokens"),
        T.no_longer_than(diff, diff_tokens).alias(f"diff_{diff_tokens}_tokens"),
    ]


def with_judgements(df: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the other columns of ``judged`` by key; an example without a judgement fails, as a misaligned file would."""
    known = judged.withColumn("_there", F.lit(True))
    out = df.join(known, keys, "left")
    there = F.when(F.col("_there").isNull(), F.raise_error(F.concat_ws(" ", F.lit("no judgement for"), *[F.col(k).cast("string") for k in keys]))).otherwise(F.col(keys[0]))
    return out.withColumn(keys[0], there).drop("_there")


def licensed(df: DataFrame, column: str = "license", licences: Iterable[str] = LICENCES) -> DataFrame:
    """Rows under one of the licences."""
    return df.where(F.col(column).isin(*licences))


def found_repos(search: DataFrame, metadata: DataFrame) -> DataFrame:
    """Search results with their metadata, by name; repositories that the service no longer names are left out."""
    return search.join(metadata, "name").where(F.col("github_full_name").isNotNull())


def in_parts(df: DataFrame, parts: dict[str, DataFrame], key: str = "name") -> dict[str, DataFrame]:
    """The rows of each part: those whose key its list of names holds."""
    return {part: df.join(names.select(key).distinct(), key, "left_semi") for part, names in parts.items()}
