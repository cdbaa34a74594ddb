"""Metadata stage: short examples, bots, authors shared by parts, repository attributes, author ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_short(df: DataFrame, columns=("n_unique_msg", "n_unique_diff")) -> DataFrame:
    """Rows with more than one unique token in message and diff."""
    good = F.lit(True)
    for c in columns:
        good = good & (F.col(c) > 1)
    return df.where(good)


def bot_authors(authors: DataFrame, bots: DataFrame) -> DataFrame:
    """Distinct (name, email): known bots by name, by login (compared with the name) or by email, and names that end in bot."""
    known = authors.select("name", "email").distinct()
    found = known.where(F.lower("name").endswith("bot") | F.lower("name").endswith("[bot]"))
    for own, theirs in (("name", "name"), ("name", "login"), ("email", "email")):
        listed = bots.select(F.col(theirs).alias(own)).where(F.length(own) > 0).distinct()
        found = found.unionByName(known.join(listed, own, "left_semi").select("name", "email"))
    return found.distinct()


def drop_bots(df: DataFrame, bots: DataFrame) -> DataFrame:
    return df.join(bots, ["name", "email"], "left_anti").select(*df.columns)


def drop_shared_authors(df: DataFrame, everyone: DataFrame | None = None, train: str = "train") -> DataFrame:
    """Training rows by authors of other parts go; ``everyone``: where these are looked up, if rows were dropped since."""
    others = (df if everyone is None else everyone).where(F.col("part") != train).select("name", "email").distinct()
    return df.where(F.col("part") != train).unionByName(df.where(F.col("part") == train).join(others, ["name", "email"], "left_anti").select(*df.columns))


def _latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    values = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in values])


def _require(df: DataFrame, column: str, what: str) -> DataFrame:
    checked = F.when(F.col(column).isNull(), F.raise_error(F.concat(F.lit(f"no {what} for "), F.col("repo")))).otherwise(F.col(column))
    return df.withColumn(column, checked)


def add_repo_metadata(df: DataFrame, repos: DataFrame, order: str, strict: bool = True) -> DataFrame:
    """``df`` with language and license of its repo ('#' read as '/'); of repeated names the last by ``order`` counts; a missing one fails unless not strict."""
    last = _latest(repos, ["name"], order)
    side = last.select(F.col("name").alias("_repo"), F.col("mainLanguage").alias("language"), "license")
    out = df.join(side, F.translate("repo", "#", "/") == F.col("_repo"), "left")
    missing = F.col("_repo").isNull()
    if strict:
        out = out.withColumn("language", F.when(missing, F.raise_error(F.concat(F.lit("no metadata for "), F.col("repo")))).otherwise(F.col("language")))
    return out.drop("_repo")


def add_author_ids(df: DataFrame, authors_map: DataFrame, order: str, strict: bool = True) -> DataFrame:
    """``df`` with author_id by (name, email, repo); of repeated keys the last by ``order`` counts; a missing one fails unless not strict."""
    keys = ["name", "email", "repo"]
    last = _latest(authors_map, keys, order)
    out = df.join(last.select(*keys, F.col("id").cast("long").alias("author_id")), keys, "left")
    return _require(out, "author_id", "author id") if strict else out
