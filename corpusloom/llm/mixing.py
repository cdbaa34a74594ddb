"""Mix sources to target weights: hash-random order, distributed prefix sums, a cut at each source's exact budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.lines import with_text
from corpusloom.operators.ids import surrogate_ids
from corpusloom.operators.rows import keyed_rows
from corpusloom.runtime import discard, materialize

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """source, source_size, target: one row a source (null is a source, last in order).

    Weights 1, 2, 3 repeat by code point. A share above ``max_epochs`` times the source's size stops there; what is left is
    shared by weight until none is above. With r = cap / weight, the capped sources are those below one water level:
    each step takes the caps of all below the level and lifts it; the level only rises, so it settles in at most one
    step a source. Sources stay a table: they are numbered range by range, and a step is an aggregate of one row over them.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull())
    totals = materialize(totals)
    numbers = surrogate_ids(totals, ["source"], ["none", "source"]).withColumnRenamed("source", "s")
    weight = (F.pmod("id", F.lit(3)) + 1).cast("long").alias("weight")
    weighed = materialize(totals.join(numbers, totals["source"].eqNullSafe(numbers["s"])).select("source", "source_size", weight))
    discard(totals)
    cap = F.lit(max_epochs) * F.col("source_size")
    whole = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = whole[0] / whole[1] if whole[1] else 0.0
    while True:
        below = cap < F.lit(level) * F.col("weight")
        row = weighed.where(below).agg(F.coalesce(F.sum(cap), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        raised = (whole[0] - row[0]) / (whole[1] - row[1]) if whole[1] > row[1] else level
        if raised <= level:
            break
        level = raised
    share = F.lit(float(level)) * F.col("weight")
    return weighed.select("source", "source_size", F.when(cap < share, cap.cast("double")).otherwise(share).alias("target"))


def _taken(docs: DataFrame, max_epochs: int, seed: str, range_rows: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): the rows with their keys, and of each row doc_id, size, source_size, target, taken."""
    rows = keyed_rows(docs, id_col)
    text = F.col(f"doc.`{text_col}`")
    sized = rows.select(
        "row",
        F.col(f"doc.`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"doc.`{source_col}`").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sized = materialize(sized.withColumn("key", F.md5(F.concat(F.lit(seed), F.col("row").cast("string")))))
    bits = max(0, (sized.count() // range_rows).bit_length())
    span = F.shiftright(F.conv(F.substring("key", 1, 7), 16, 10).cast("int"), 28 - min(bits, 28))
    dealt = sized.withColumn("span", span)
    # what stands before each range of the hash, and the source's target: one row a source and range
    before = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = dealt.groupBy("source", "span").agg(F.sum("size").alias("held"))
    spans = spans.select(F.col("source").alias("s"), F.col("span").alias("at"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    targets = source_targets(sized, max_epochs)
    starts = spans.join(targets, spans["s"].eqNullSafe(targets["source"])).drop("source")
    inside = Window.partitionBy("source", "span").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = local.join(starts, local["source"].eqNullSafe(starts["s"]) & (local["span"] == starts["at"]))
    passes = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0).cast("long"))
    rest = F.floor("target") - passes * F.col("source_size") - F.col("base") - F.col("within")
    taken = passes * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least("size", rest))
    return rows, joined.select("row", "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(
    docs: DataFrame, max_epochs: int = 3, seed: str = "mix", range_rows: int = 2_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).

    A source's budget is its target rounded down. Whole passes over the source are taken as often as they fit; the
    rest is filled in the order of a hash of the id, and the document that crosses the budget gives just the words
    that are left. Null text has size 0 and gives nothing; a null source is a source. Rows that share an id or have none
    are documents of their own (see :func:`corpusloom.operators.rows.keyed_rows`). An empty table gives an empty result;
    further columns are ignored. Ranges of the hash hold about ``range_rows`` rows, so a hot source is spread like all others.
    """
    return _taken(docs.select(id_col, text_col, source_col), max_epochs, seed, range_rows, id_col, text_col, source_col)[1].drop("row")


def mixed_documents(docs: DataFrame, max_epochs: int = 3, seed: str = "mix", range_rows: int = 2_000) -> DataFrame:
    """The mixed table itself, with the columns of ``docs``: a document taken twice stands twice, and of the document
    that crosses its source's budget the last copy holds just the words that are left (n_chars follows such a text).

    Documents of no words take nothing from the budget and stay once, null texts as nulls. Rows that share an id or have
    none are documents of their own; further columns, whatever their names, are carried; an empty table gives an empty one.
    """
    rows, counts = _taken(docs, max_epochs, seed, range_rows, "doc_id", "text", "source")
    joined = rows.join(counts.select("row", "size", "taken"), "row")
    whole = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(1).cast("long"))
    part = F.when(F.col("size") > 0, F.expr("taken % size")).otherwise(F.lit(0).cast("long"))
    # one row for each whole copy and one for the part, if any
    lengths = F.concat(F.array_repeat(F.col("size"), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    copies = joined.withColumn("words", F.explode_outer(lengths)).where("words IS NOT NULL")
    words = F.expr(r"array_join(slice(regexp_extract_all(doc.text, '[^\\x20\\x09-\\x0D]+', 0), 1, cast(words as int)), ' ')")
    changed = F.col("words") != F.col("size")
    return with_text(copies.withColumn("text", F.when(changed, words).otherwise(F.col("doc.text"))), docs, changed)
