"""The whole commit pipeline as one plan; only the diff stage's output is written, as both later passes read it."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import outliers as sizes
from corpusloom.operators.clones import add_hashes, drop_clones, pair_clones_to_drop
from corpusloom.operators.diffs import clean_diffs
from corpusloom.operators.messages import clean_messages
from corpusloom.operators.metadata import add_author_ids, add_repo_metadata, bot_authors, drop_bots, drop_shared_authors, drop_short
from corpusloom.runtime import materialize


@dataclass
class Config:
    """A stage is left out by setting its switch to False. Percentiles are in percent."""

    line_sep: str = "\n"
    outliers: bool = True
    lower: float = 5
    upper: float = 95
    diff_stats: tuple[str, ...] = sizes.DIFF_STATS
    message_stats: tuple[str, ...] = sizes.MESSAGE_STATS
    diff_upper_bound: int | None = None
    messages: bool = True
    replace_patterns: bool = False
    diffs: bool = True
    clones: bool = True
    tokens_hash: bool = False
    inner: bool = True
    only_full_inner: bool = False
    identical: bool = True  # of pairs: whole clones by components, not by shared pairs
    outer_parts: tuple[str, ...] = ("train",)
    metadata: bool = True
    strict: bool = True

    def __post_init__(self) -> None:
        if self.line_sep == "":
            raise ValueError("line_sep must not be empty")


@dataclass
class Tables:
    """Side tables of the metadata stage, thresholds fitted before (one row), and clone pairs of another tool, if any.

    Of repeated names or authors the last by the column ``line`` counts. Pairs come with the map of their ids (repo, hash,
    id) and replace the search by hashes; part_ids name the parts by the numbers that the pairs use.
    """

    bots: DataFrame | None = None
    authors_map: DataFrame | None = None
    repos: DataFrame | None = None
    thresholds: DataFrame | None = field(default=None)
    message_pairs: DataFrame | None = None
    diff_pairs: DataFrame | None = None
    id_map: DataFrame | None = None
    part_ids: dict[str, int] = field(default_factory=lambda: {"train": 1, "val": 2, "test": 3})
    line: str = "line"


def drop_paired(df: DataFrame, tables: Tables, config: Config) -> DataFrame:
    """Commits without those that clone pairs name: inside their part, and for ``outer_parts`` against the other parts."""
    gone = []
    for part in df.select("part").distinct().toPandas()["part"]:
        if tables.part_ids.get(part, -1) == -1:
            raise ValueError(f"no id for the part {part!r}")
        found = pair_clones_to_drop(
            tables.message_pairs, tables.diff_pairs, tables.part_ids[part], config.inner, part in config.outer_parts, config.only_full_inner, config.identical
        )
        gone.append(found.join(tables.id_map, "id").select(F.lit(part).alias("part"), "repo", "hash"))
    return df.join(reduce(DataFrame.unionByName, gone), ["part", "repo", "hash"], "left_anti").select(*df.columns) if gone else df


def with_stats(commits: DataFrame) -> DataFrame:
    # past a generator no filter is pushed: else texts are measured again in what drops rows below
    both = F.struct(sizes.message_stats(F.col("message")).alias("m"), sizes.mods_stats(F.col("mods")).alias("d"))
    staged = commits.withColumn("_s", F.explode_outer(F.array(both)))
    flat = {f"msg_{c}": F.col(f"_s.m.{c}") for c in sizes.MESSAGE_STATS} | {f"diff_{c}": F.col(f"_s.d.{c}") for c in sizes.DIFF_STATS}
    return staged.withColumns(flat).drop("_s")


def drop_by_metadata(df: DataFrame, tables: Tables, config: Config) -> DataFrame:
    """Short examples, bots and, in training, authors of other parts go; language, licence and author ids come in."""
    everyone, bots = df, bot_authors(df, tables.bots) if tables.bots is not None else None
    df = drop_short(df)
    if bots is not None:
        df = drop_bots(df, bots)
    df = drop_shared_authors(df, everyone)
    if tables.repos is not None:
        df = add_repo_metadata(df, tables.repos, tables.line, config.strict)
    if tables.authors_map is not None:
        df = add_author_ids(df, tables.authors_map, tables.line, config.strict)
    return df


def run(commits: DataFrame, tables: Tables | None = None, config: Config | None = None) -> DataFrame:
    """commits (part, repo, hash, message, mods, name, email, ...) to the final corpus."""
    tables, config = tables or Tables(), config or Config()
    df, columns = commits, commits.columns
    if config.outliers:
        chosen = [f"diff_{c}" for c in sizes.check_stats(config.diff_stats, sizes.DIFF_STATS)]
        chosen += [f"msg_{c}" for c in sizes.check_stats(config.message_stats, sizes.MESSAGE_STATS)]
        sized = with_stats(df)
        limits = tables.thresholds
        if limits is None:
            limits = sizes.percentiles(sized, chosen, config.lower, config.upper)
        bounds = {"diff_num_tokens": config.diff_upper_bound} if config.diff_upper_bound else None
        df = sizes.drop_outliers(sized, limits, chosen, bounds).select(*columns)
    if config.messages:
        df = clean_messages(df, replace=config.replace_patterns, line_sep=config.line_sep)
    if config.diffs:
        df = clean_diffs(df, line_sep=config.line_sep)
    by_hash = config.clones and tables.message_pairs is None
    if by_hash or config.metadata:
        df = df.withColumn("_id", F.concat_ws("\x00", "repo", "hash"))
        df = materialize(add_hashes(df, line_sep=config.line_sep, tokens_hash=config.tokens_hash))
    if config.clones and not by_hash:
        df = drop_paired(df, tables, config)
    if by_hash:
        df = drop_clones(df, "_id", config.inner, config.outer_parts, config.only_full_inner)
    if config.metadata:
        df = drop_by_metadata(df, tables, config)
    return df.drop("_id", "mh", "dh", "n_total_msg", "n_total_diff", "n_unique_msg", "n_unique_diff")
