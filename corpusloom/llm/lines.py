"""Line de-duplication by a deletion-neighbourhood join, in DataFrame operations only.

Lines are sequences of words. Two lines are alike if they are equal or, with ``least_words`` words or more, one edit of
one word apart (a word put in, left out or exchanged), which for five words is a similarity of 0.8 or more. Every line
emits its deletion variants (itself, and itself without each of its words) as hashed keys; equal keys meet, the edit
distance of what met is verified on the words, and the earliest line stays.

Two such lines always share their first or their last half, so distinct lines whose halves nobody shares, which is
most, need not emit variants. A key is an exclusive or over hashes of words with their places; the keys of all variants
come from running ones over the line, so a line of n words costs n log n. Within a key no pairs are formed: each member
only needs the key's earliest lines. Expressions go into ``explode_outer``: ``explode`` would have them evaluated twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.rows import keyed_rows
from corpusloom.runtime import discard, materialize

BLANK = r"[\t-\r ]+"
PER_TASK = 10_000  # lines compared with one copy of a frequent earlier line


def lines_of(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """row, line_no, norm: the lines that hold a word, white space made one space."""
    # most lines hold single spaces only; the pattern is for the others
    odd = lambda x: x.contains("  ") | x.contains("\t") | x.contains("\r") | x.contains("\x0b") | x.contains("\x0c")
    tidy = F.transform(F.split(F.col(f"doc.`{text_col}`"), "\n"), lambda x: F.trim(F.when(odd(x), F.regexp_replace(x, BLANK, " ")).otherwise(x)))
    return rows.select("row", F.posexplode_outer(tidy).alias("line_no", "norm")).where("norm <> ''")


def _halves(n: str) -> list:
    """Keys of the first and last half, cut as for this length and, for the longer of two lines, as for one word less."""
    out = []
    for m in (n, f"({n} - 1)"):
        out.append(F.expr(f"xxhash64(slice(w, 1, {m} div 2), {m}, 'first')"))
        out.append(F.expr(f"xxhash64(slice(w, {n} - ({m} - {m} div 2) + 1, {m} - {m} div 2), {m}, 'last')"))
    return out


def _halves(n: str) -> list[Column]:
    """Keys of the first and last half, cut as for this length and, for the longer of two lines, as for one word less."""
    out = []
    for m in (n, f"({n} - 1)"):
        out.append(F.expr(f"xxhash64(slice(w, 1, {m} div 2), {m}, 'first')"))
        out.append(F.expr(f"xxhash64(slice(w, {n} - ({m} - {m} div 2) + 1, {m} - {m} div 2), {m}, 'last')"))
    return out


def _running(items: str) -> str:
    """SQL of the running exclusive or of an array: each pass doubles the reach."""
    passes = f"sequence(0, greatest(0, cast(ceil(log2(size({items}))) AS int) - 1))"
    shifted = "concat(array_repeat(0L, shiftleft(1, k)), slice(s, 1, greatest(0, size(s) - shiftleft(1, k))))"
    return f"IF(size({items}) < 2, {items}, aggregate({passes}, {items}, (s, k) -> zip_with(s, {shifted}, (x, y) -> x ^ coalesce(y, 0L))))"


def _variants(texts: DataFrame) -> DataFrame:
    """place, key, at: each line's own key (at -1) and those without the word at each place (from 0).

    A key is the exclusive or of the hashes of words with their places. Without word i, those before it keep their places and
    those after it move up by one: the running key to i of the one, and what is left of the other after i.
    """
    placed = texts.select("place", F.expr("transform(w, (x, i) -> xxhash64(x, i))").alias("a"), F.expr("transform(w, (x, i) -> xxhash64(x, i - 1))").alias("b"))
    running = placed.select("place", F.expr(_running("a")).alias("a"), F.expr(_running("b")).alias("b"))
    whole = "array(named_struct('key', element_at(a, -1), 'at', -1))"
    shorter = "transform(b, (y, i) -> named_struct('key', IF(i = 0, 0L, a[i - 1]) ^ y ^ element_at(b, -1), 'at', i))"
    return running.select("place", F.explode_outer(F.expr(f"concat({whole}, {shorter})")).alias("v")).select("place", "v.key", "v.at")


def _near(lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """(place, earlier): distinct lines with an earlier line one edit away, verified on the words."""
    keyed = distinct.where("halves IS NOT NULL").select("place", F.explode_outer("halves").alias("half"))
    shared = keyed.groupBy("half").agg(F.count("*").alias("members")).where("members > 1").select("half")
    chosen = keyed.join(shared, "half", "left_semi").select("place").distinct()
    placed = lines.select(F.struct("row", "line_no").alias("place"), "norm").join(chosen, "place", "left_semi")
    texts = materialize(placed.select("place", F.split("norm", " ").alias("w")))
    emitted = materialize(_variants(texts))
    # earliest of each key and place: an exchange of the word there; earliest whole line and earliest longer one: a word put in or left out
    slots = materialize(emitted.groupBy("key", "at").agg(F.min("place").alias("least"), F.count("*").alias("members")))
    ends = slots.groupBy("key").agg(F.min(F.when(F.col("at") < 0, F.col("least"))).alias("whole"), F.min(F.when(F.col("at") >= 0, F.col("least"))).alias("longer"))
    same = emitted.where("at >= 0").join(slots.where("at >= 0 AND members > 1"), ["key", "at"]).where("least < place").select("place", F.col("least").alias("earlier"))
    other = (
        emitted.join(ends.where("whole IS NOT NULL AND longer IS NOT NULL"), "key")
        .select("place", F.when(F.col("at") < 0, F.col("longer")).otherwise(F.col("whole")).alias("earlier"))
        .where("earlier < place")
    )
    met = materialize(same.unionByName(other).distinct())
    # one line may be the earliest of very many: it is copied to as many tasks as they need
    loads = met.groupBy("earlier").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("parts"))
    salted = met.join(loads, "earlier").select("place", "earlier", F.pmod(F.xxhash64("place"), F.col("parts")).cast("int").alias("salt"))
    copies = texts.select(F.col("place").alias("earlier"), F.col("w").alias("b")).join(loads, "earlier")
    copies = copies.select("earlier", "b", F.explode_outer(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    both = salted.join(texts.select("place", F.col("w").alias("a")), "place").join(copies, ["earlier", "salt"])
    near = materialize(both.where(_one_edit("a", "b")).select("place").distinct())
    discard(texts, emitted, slots, met)
    return near


def _one_edit(a: str, b: str):
    """Whether two word arrays are exactly one edit apart: what their common start and end leave is one word."""
    n, m = f"size({a})", f"size({b})"
    least = f"least({n}, {m})"
    head = f"coalesce(array_position(zip_with(slice({a}, 1, {least}), slice({b}, 1, {least}), (x, y) -> x = y), false), {least} + 1)"
    head = f"(CASE WHEN {head} = 0 THEN {least} ELSE {head} - 1 END)"
    # the words after the first difference must be equal when one (or, of equal lengths, one of each) is left out
    rest_a = f"slice({a}, cast({head} AS int) + 1 + IF({n} >= {m}, 1, 0), {n})"
    rest_b = f"slice({b}, cast({head} AS int) + 1 + IF({m} >= {n}, 1, 0), {m})"
    return F.expr(f"abs({n} - {m}) <= 1 AND NOT ({n} = {m} AND {head} = {n}) AND {rest_a} = {rest_b}")


def repeated_lines(rows: DataFrame, least_words: int = 5, text_col: str = "text") -> DataFrame:
    """(row, line_no): lines that equal or nearly equal an earlier one (of a smaller row, or earlier in the same row)."""
    lines = lines_of(rows, text_col)
    words = lines.select("row", "line_no", F.expr("xxhash64(norm)").alias("h1"), F.expr("xxhash64(norm, 1)").alias("h2"), F.split("norm", " ").alias("w"))
    halves = F.when(F.size("w") >= max(2, least_words), F.array_distinct(F.array(*_halves("size(w)"))))
    occurrences = materialize(words.select("row", "line_no", "h1", "h2", halves.alias("halves")))
    firsts = occurrences.groupBy("h1", "h2").agg(F.min(F.struct("row", "line_no", "halves")).alias("x"), F.count("*").alias("copies"))
    distinct = materialize(firsts.select("h1", "h2", F.struct("x.row", "x.line_no").alias("place"), "copies", "x.halves"))
    near = _near(lines, distinct).withColumn("like", F.lit(True))
    # only lines with copies, or with a like line before, have anything to lose
    marked = distinct.join(near, "place", "left").where("copies > 1 OR like").select("h1", "h2", "place", F.coalesce("like", F.lit(False)).alias("like"))
    met = occurrences.join(marked, ["h1", "h2"]).where(F.col("like") | (F.struct("row", "line_no") > F.col("place")))
    return met.select("row", "line_no")


def line_report(docs: DataFrame, least_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines (lines that hold a word), n_removed, removed (their numbers from 0, in order).

    Blank lines are never removed. Lines of fewer than ``least_words`` words go only when equal to an earlier line. Whether
    an earlier line goes itself does not matter. Null and empty texts have no lines; an empty table gives an empty
    result; further columns are ignored. Rows that share an id are separate documents, ordered as
    :func:`corpusloom.operators.rows.keyed_rows` says; rows without an id come last and keep their null.
    """
    rows = keyed_rows(docs.select(id_col, text_col), id_col)
    gone = repeated_lines(rows, least_words, text_col).groupBy("row").agg(F.array_sort(F.collect_list("line_no")).alias("removed"))
    text = F.coalesce(F.col(f"doc.`{text_col}`"), F.lit(""))
    count = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\t-\r ]"))).cast("long")
    counts = rows.select("row", F.col(f"doc.`{id_col}`").cast("long").alias("doc_id"), count.alias("n_lines"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return counts.join(gone, "row", "left").select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def dedup_lines(docs: DataFrame, least_words: int = 5) -> DataFrame:
    """``docs`` without its repeated lines; text and n_chars change, other columns do not, no document is dropped.

    Null and empty texts stay as they are; rows that share an id or have none are separate documents, as in
    :func:`line_report`; further columns, whatever their names, are carried; an empty table gives an empty table.
    """
    rows = keyed_rows(docs, "doc_id")
    gone = repeated_lines(rows, least_words).groupBy("row").agg(F.array_sort(F.collect_list("line_no")).alias("gone"))
    joined = rows.join(gone, "row", "left")
    # one flag a line, up to the last that goes: made from the gaps between those that go
    flags = "flatten(transform(gone, (x, i) -> concat(array_repeat(true, x - IF(i = 0, -1, gone[i - 1]) - 1), array(false))))"
    marked = joined.withColumn("keep", F.expr(flags))
    left = F.expr("array_join(filter(split(doc.text, '\\n'), (x, i) -> coalesce(get(keep, i), true)), '\\n')")
    return with_text(marked.withColumn("text", F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(left)), docs, F.col("gone").isNotNull())


def with_text(rows: DataFrame, docs: DataFrame, changed) -> DataFrame:
    """The columns of ``docs`` from the struct ``doc``, text taken from the column ``text``; n_chars follows where it changed."""
    out = []
    for f in docs.schema:
        column = F.col(f"doc.`{f.name}`")
        if f.name == "text":
            column = F.col("text")
        elif f.name == "n_chars":
            column = F.when(changed, F.length("text").cast(f.dataType)).otherwise(column)
        out.append(column.alias(f.name))
    return rows.select(*out)
