"""A key for every row, whatever its id: rows that share an id, or have none, stay apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from corpusloom.runtime import discard, materialize


def keyed_rows(docs: DataFrame, id_col: str) -> DataFrame:
    """row, doc: a number for each row that is unique and grows with the id, and the whole row as a struct.

    Where all ids are present and unique, which is counted, the number is the id. Otherwise the rows are sorted by id (null
    last), rows of one id by a hash of all their columns, and numbered in that order; wholly equal rows may swap. The
    struct keeps the columns of ``docs`` apart from those that an operator adds.
    """
    key = F.col(f"`{id_col}`").cast("long")
    packed = docs.select(key.alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows, distinct = packed.agg(F.count("*"), F.count_distinct("row")).first()
    if rows == distinct:
        return packed
    hashed = [F.col(f"doc.`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)]
    # the place in a table that is written decides between equal rows, so a stage that is repeated deals the same
    placed = materialize(packed.select("row", F.xxhash64(*hashed).alias("tie"), "doc"))
    by = [F.col("row").asc_nulls_last(), "tie", "at"]
    dealt = placed.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    out = materialize(dealt.select(F.monotonically_increasing_id().alias("row"), "doc"))
    discard(placed)
    return out
