"""A corpus pipeline of five stages: each gets the rows that its predecessor kept.

Repeated and empty texts, nulls and long texts are handled as the operators' docstrings say. An empty table passes through
as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.lines import dedup_lines
from corpusloom.llm.mixing import mixed_documents
from corpusloom.llm.pieces import encode_documents
from corpusloom.llm.simhash import simhash_dedup
from corpusloom.llm.toxicity import drop_toxic
from corpusloom.runtime import load, materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return drop_toxic(docs, load(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that equal an earlier one, or are one word from it, go."""
    return dedup_lines(docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut or repeated to their target weights."""
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids."""
    return encode_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: Fitted scores, SimHash and piece ids are beyond SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
