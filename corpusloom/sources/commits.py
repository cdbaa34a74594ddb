"""Commit files: schemas, readers, writers, one folder for each repository of each part."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.operators.clones import hashes_of_encoded
from corpusloom.runtime import materialize

MODS = "array<struct<change_type:string,old_path:string,new_path:string,diff:string>>"
COMMIT = f"author array<string>, date string, timezone int, hash string, message string, mods {MODS}"
PAIRS = "part_id1 int, id1 int, part_id2 int, id2 int"
HASHES = "part_idx int, idx int, hash string"
PARTS = ("train", "val", "test")
SEARCH = "name string, commits long, mainLanguage string, createdAt string, stargazers long"


@dataclass(frozen=True)
class Format:
    """How a format's tables are read (session, root, parts, schema) and a partitioned writer's output is written."""

    read: Callable[[SparkSession, str, tuple, str], DataFrame]
    write: Callable[[DataFrameWriter, str], None]


FORMATS: dict[str, Format] = {}


def register_format(name: str, read, write) -> None:
    """Make a storage format known to the readers and writers here."""
    FORMATS[name] = Format(read, write)


def _known(data_format: str) -> Format:
    if data_format not in FORMATS:
        raise ValueError(f"unknown data format {data_format!r}: one of {tuple(FORMATS)}")
    return FORMATS[data_format]


def _read_jsonl(spark: SparkSession, root: str, parts, schema: str) -> DataFrame:
    path = F.col("_metadata.file_path")
    rows = spark.read.schema(schema).json([f"{root}/{p}/*/commits.jsonl.gz" for p in parts])
    return rows.select("*", F.element_at(F.split(path, "/"), -3).alias("part"), F.url_decode(F.element_at(F.split(path, "/"), -2)).alias("repo"))


def _read_parquet(spark: SparkSession, root: str, parts, schema: str) -> DataFrame:
    return spark.read.parquet(root).where(F.col("part").isin(*parts))


register_format("jsonl", _read_jsonl, lambda writer, root: writer.option("compression", "gzip").json(root))
register_format("parquet", _read_parquet, lambda writer, root: writer.parquet(root))


def read_commits(spark: SparkSession, root: str, parts=PARTS, data_format: str = "jsonl", schema: str = COMMIT) -> DataFrame:
    """All repositories of the parts in one scan, with part and repo ('org#name') from the path.

    The schema is declared, so a message of digits stays a string. Gzip files cannot be split: repartition, or convert
    to Parquet once, if a repository is large.
    """
    return _known(data_format).read(spark, root, tuple(parts), schema)


def write_commits(df: DataFrame, root: str, data_format: str = "jsonl", append: bool = False) -> None:
    """One folder for each part and repo; existing output is overwritten, or with ``append`` added to."""
    chosen = _known(data_format)
    chosen.write(df.write.mode("append" if append else "overwrite").partitionBy("part", "repo"), root)


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to a JSON-lines table, or lines to a text: a table of one string column named value is a text."""
    writer = df.write.mode("append")
    writer.text(path) if df.dtypes == [("value", "string")] else writer.json(path)


def merge_parts(df: DataFrame) -> DataFrame:
    """All repositories as one table, repo written as 'org/name'."""
    return df.withColumn("repo", F.translate("repo", "#", "/"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIRS).option("ignoreLeadingWhiteSpace", True).csv(path)


def read_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HASHES).csv(path)


def read_repo_list(spark: SparkSession, path: str) -> DataFrame:
    """name ('/' as '#') and github_url (git:// as https://) of the repositories to collect."""
    rows = spark.read.schema("name string, github_url string").json(path)
    return rows.select(F.translate("name", "/", "#").alias("name"), F.replace("github_url", F.lit("git://"), F.lit("https://")).alias("github_url"))


def read_search_results(spark: SparkSession, path: str, schema: str = SEARCH, encoding: str = "UTF-8") -> DataFrame:
    """Search results with the declared columns, by name; bytes that are no text become the replacement character, and go."""
    names = {c.split(" ")[0] for c in schema.split(", ")}
    rows = spark.read.option("header", True).option("multiLine", True).option("encoding", encoding).option("mode", "PERMISSIVE").csv(path)
    kinds = dict(c.split(" ") for c in schema.split(", "))
    clean = [F.expr(f"try_cast(replace(`{c}`, '\ufffd', '') AS {kinds[c]})").alias(c) if c in names else F.col(f"`{c}`") for c in rows.columns]
    return rows.select(*clean)


def without_done(df: DataFrame, done: DataFrame, key: str = "name") -> DataFrame:
    """What is left of a resumable job."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def diff_lines(df: DataFrame, line_sep: str = "\n") -> DataFrame:
    """One text a commit for the tokenizer: its diffs joined; a null diff fails."""
    diffs = F.transform("mods", lambda m: F.when(m["diff"].isNull(), F.raise_error(F.lit("null diff"))).otherwise(m["diff"]))
    return df.select(F.array_join(diffs, line_sep).alias("value"))


def write_diff_text(df: DataFrame, path: str, line_sep: str = "\n") -> None:
    diff_lines(df.where(F.col("part") == "train") if "part" in df.columns else df, line_sep).write.mode("overwrite").text(path)


def write_groups(groups: DataFrame, path: str) -> None:
    groups.write.mode("overwrite").json(path)


def gather_groups(spark: SparkSession, path: str, out: str) -> None:
    """The groups under ``path`` as one JSON-lines file in the folder ``out`` (an export: one task writes it)."""
    spark.read.schema("hash string, clones array<array<int>>").json(path).coalesce(1).write.mode("overwrite").json(out)


def hash_groups(hashes: DataFrame) -> DataFrame:
    """hash, clones (arrays of part and index): groups of two rows or more of a table of hashes."""
    return hashes.groupBy("hash").agg(F.array_sort(F.collect_list(F.array("part_idx", "idx"))).alias("clones")).where(F.size("clones") > 1)


def write_hashes(spark: SparkSession, encoded: dict[str, str], out: str, parts=PARTS, tokens_hash: bool = True) -> DataFrame:
    """part_idx, idx, hash of the encoded examples of each part's text file, as a CSV table under ``out``; the first part is the training one."""
    if not parts or parts[0] != "train":
        raise ValueError(f"the first part must be train, not {parts[:1]}")
    lines = reduce(DataFrame.unionByName, [spark.read.text(encoded[p]) for p in parts])
    hashes_of_encoded(lines, tokens_hash).write.mode("overwrite").csv(out)
    return read_hashes(spark, out)


def write_id_map(ids: DataFrame, path: str) -> None:
    """repo, hash, id as JSON lines."""
    ids.select("repo", "hash", "id").write.mode("overwrite").json(path)


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("repo string, hash string, id long").json(path)


def _numbered(spark: SparkSession, path: str, name: str) -> DataFrame:
    """_line, <name>: the lines of one text file, stripped, with their number; a split's first number is the sum of those before it."""
    read = spark.read.text(path).select(
        F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"), strip(F.col("value")).alias(name)
    )
    rows = materialize(read)
    before = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("_split").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    starts = splits.select("_split", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(starts, "_split").select((F.col("_base") + F.col("_id") - F.col("_first")).alias("_line"), name)


def read_aligned(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One row a line number that all files have: a column for each name, from its file's line, stripped."""
    files = [_numbered(spark, path, name) for name, path in paths.items()]
    return reduce(lambda a, b: a.join(b, "_line"), files).drop("_line")
