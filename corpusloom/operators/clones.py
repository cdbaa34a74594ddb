"""Clone search and dropping: hashes of whole texts or token bags, pairs of similar examples, components."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import BLANKS, strip
from corpusloom.operators.components import connected_components

# fixed value: what separates the tokens of clone search
SEPARATORS = r'[;.\[\]\(\)\~!\-\_\+\&\*/%<>\^\|\?\{\}=\#,"\\\:\$\'`@ +\n\r\t]'


def special_tokens(line_sep: str = "\n") -> list[str]:
    return ["[LONG]", line_sep, "[EMAIL]", "[URL]", "[NICKNAME]", "[COMMIT_ID]", "[ISSUE_ID]"]


def _without(x: Column, tokens: list[str]) -> Column:
    for token in tokens:
        x = F.replace(x, F.lit(token), F.lit(""))
    return x


def diff_text(mods: Column, line_sep: str = "\n") -> Column:
    joined = F.array_join(F.transform(mods, lambda m: m["diff"]), " ")
    return _without(F.regexp_replace(joined, r"(?d)@@.*?@@\n", ""), special_tokens(line_sep))


def message_text(message: Column, line_sep: str = "\n") -> Column:
    return _without(F.lower(message), special_tokens(line_sep))


def clone_tokens(text: Column) -> Column:
    """Tokens of a text; only blanks that are no separators are left to strip, and most texts hold none."""
    tokens = F.filter(F.split(text, SEPARATORS), lambda y: y != "")
    return F.when(text.rlike(r"[\x0b\x0c\x1c-\x1f]"), F.transform(tokens, strip)).otherwise(tokens)


def text_hash(text: Column) -> Column:
    """md5 of the text; null where it has no tokens, as such rows are no clones."""
    return F.when(text.rlike(SEPARATORS.replace("[", "[^", 1)), F.md5(text))


def bag_hash(ordered: Column) -> Column:
    """md5 of the token counts written as a sorted JSON object, from a column of sorted tokens (not an expression: it is
    read at each run's start). The order of the tokens in the text does not matter."""
    n = F.size(ordered)
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))
    )
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(n))
    entries = F.zip_with(starts, ends, lambda i, j: F.concat(F.lit('"'), F.get(ordered, i), F.lit('": '), (j - i).cast("string")))
    return F.when(n > 0, F.md5(F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))))


def add_hashes(df: DataFrame, message: str = "message", mods: str = "mods", line_sep: str = "\n", tokens_hash: bool = False) -> DataFrame:
    """``df`` with mh, dh (hashes for clone search, null without tokens), n_total_* and n_unique_* (token counts)."""
    texts = df.withColumns({"_msg": message_text(F.col(message), line_sep), "_diff": diff_text(F.col(mods), line_sep)})
    cut = texts.withColumns({"_msg_t": F.sort_array(clone_tokens(F.col("_msg"))), "_diff_t": F.sort_array(clone_tokens(F.col("_diff")))})
    made = {}
    for short, name in (("mh", "msg"), ("dh", "diff")):
        t = F.col(f"_{name}_t")
        made[short] = bag_hash(t) if tokens_hash else text_hash(F.col(f"_{name}"))
        made[f"n_total_{name}"] = F.size(t)
        made[f"n_unique_{name}"] = F.size(F.array_distinct(t))
    return cut.withColumns(made).drop("_msg", "_diff", "_msg_t", "_diff_t")


def clone_groups(df: DataFrame, hash_col: str, members: list[str]) -> DataFrame:
    """hash, clones (members in order): groups of at least two different rows."""
    return (
        df.where(F.col(hash_col).isNotNull())
        .groupBy(F.col(hash_col).alias("hash"))
        .agg(F.array_sort(F.collect_set(F.struct(*members))).alias("clones"))
        .where(F.size("clones") > 1)
    )


def _shared(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Combinations of the keys that at least two different rows have; counted, never collected."""
    known = df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    return known.select(*keys, id_col).distinct().groupBy(*keys).count().where("count > 1").select(*keys)


def inner_clones(df: DataFrame, id_col: str = "id", only_full: bool = False, message: str = "mh", diff: str = "dh") -> DataFrame:
    """part, id of rows that share a hash with another row of their part (both hashes at once if ``only_full``)."""
    keys = [["part", message, diff]] if only_full else [["part", message], ["part", diff]]
    found = [df.join(_shared(df, k, id_col), k, "left_semi").select("part", id_col) for k in keys]
    return found[0].distinct() if only_full else found[0].unionByName(found[1]).distinct()


def outer_clones(df: DataFrame, id_col: str = "id", parts: tuple[str, ...] = ("train",), message: str = "mh", diff: str = "dh") -> DataFrame:
    """part, id of rows of ``parts`` that share a hash with a row of another part."""
    found = []
    for h in (message, diff):
        spread = df.where(F.col(h).isNotNull()).groupBy(h).agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select(h)
        found.append(df.where(F.col("part").isin(*parts)).join(spread, h, "left_semi").select("part", id_col))
    return found[0].unionByName(found[1]).distinct()


def drop_clones(df: DataFrame, id_col: str = "id", inner: bool = True, outer_parts: tuple[str, ...] = ("train",), only_full: bool = False, keep_one: bool = False) -> DataFrame:
    """``df`` without its clones: all members of a group go. ``keep_one`` (an extension) spares the least id of each inner group."""
    gone = []
    if inner:
        found = inner_clones(df, id_col, only_full)
        if keep_one:
            rows = df.join(found, ["part", id_col], "left_semi")
            first = [rows.where(F.col(h).isNotNull()).groupBy("part", h).agg(F.min(id_col).alias(id_col)).select("part", id_col) for h in ("mh", "dh")]
            found = found.join(first[0].unionByName(first[1]).distinct(), ["part", id_col], "left_anti")
        gone.append(found)
    if outer_parts:
        gone.append(outer_clones(df, id_col, outer_parts))
    for found in gone:
        df = df.join(found, ["part", id_col], "left_anti")
    return df


def pair_sets(pairs: DataFrame, part: int, others: tuple[int, ...] | None = None) -> DataFrame:
    """root_part, root, clones: for each example, the set of the part's examples that it is paired with.

    Without ``others``, both ends are of the part; with them, the root is of one of the other parts. Pairs come in either orientation.
    """
    a = pairs.select(F.col("part_id1").alias("p"), F.col("id1").alias("x"), F.col("part_id2").alias("q"), F.col("id2").alias("y"))
    b = pairs.select(F.col("part_id2").alias("p"), F.col("id2").alias("x"), F.col("part_id1").alias("q"), F.col("id1").alias("y"))
    wanted = F.col("q").isin(*others) if others is not None else F.col("q") == part
    both = a.unionByName(b).where((F.col("p") == part) & wanted)
    return both.groupBy(F.col("q").alias("root_part"), F.col("y").alias("root")).agg(F.array_sort(F.collect_set("x")).alias("clones"))


def pair_edges(pairs: DataFrame, part: int | None = None, other: bool = False) -> DataFrame:
    """src, dst of clone pairs (part_id1, id1, part_id2, id2): within a part, or from it to others (either orientation)."""
    a = pairs.select(F.col("part_id1").alias("p"), F.col("id1").alias("src"), F.col("part_id2").alias("q"), F.col("id2").alias("dst"))
    b = pairs.select(F.col("part_id2").alias("p"), F.col("id2").alias("src"), F.col("part_id1").alias("q"), F.col("id1").alias("dst"))
    both = a.unionByName(b)
    wanted = (F.col("p") == part) if part is not None else F.lit(True)
    return both.where(wanted & ((F.col("p") != F.col("q")) if other else (F.col("p") == F.col("q")))).select("src", "dst").distinct()


def similar_full_clones(message_pairs: DataFrame, diff_pairs: DataFrame, part: int) -> DataFrame:
    """id: endpoints of the pairs that messages and diffs share."""
    return pair_edges(message_pairs, part).intersect(pair_edges(diff_pairs, part)).select(F.col("src").alias("id")).distinct()


def identical_full_clones(message_pairs: DataFrame, diff_pairs: DataFrame, part: int) -> DataFrame:
    """id: members of the same component of messages and of diffs as another id."""
    m = connected_components(pair_edges(message_pairs, part)).select(F.col("node").alias("id"), F.col("component").alias("m"))
    d = connected_components(pair_edges(diff_pairs, part)).select(F.col("node").alias("id"), F.col("component").alias("d"))
    both = m.join(d, "id")
    return both.join(both.groupBy("m", "d").count().where("count > 1"), ["m", "d"], "left_semi").select("id")


def pair_clones(message_pairs: DataFrame, diff_pairs: DataFrame, part: int, other: bool = False) -> DataFrame:
    """id: every id of the part that occurs in a pair of messages or of diffs."""
    return pair_edges(message_pairs, part, other).unionByName(pair_edges(diff_pairs, part, other)).select(F.col("src").alias("id")).distinct()


def pair_clones_to_drop(
    message_pairs: DataFrame, diff_pairs: DataFrame, part: int, inner: bool = True, outer: bool = True, only_full: bool = False, identical: bool = True
) -> DataFrame:
    """id: what goes from the part by clone pairs: inside it (whole clones only, if asked, identical or similar) and against other parts."""
    found = []
    if inner and only_full:
        found.append((identical_full_clones if identical else similar_full_clones)(message_pairs, diff_pairs, part))
    elif inner:
        found.append(pair_clones(message_pairs, diff_pairs, part))
    if outer:
        found.append(pair_clones(message_pairs, diff_pairs, part, other=True))
    if not found:
        return message_pairs.select(F.col("id1").alias("id")).limit(0)
    return reduce(DataFrame.unionByName, found).distinct()


# fixed values of encoded lines: what separates the head from the tokens, and a token from its count
HEAD, COUNT = "@#@", "@@::@@"


def _by_bytes(function):
    """A function of a text's bytes as one of columns; null for null. Functions made inside others are shipped whole: workers need not have this package."""

    def column(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else function(x) for x in texts.cast(pa.binary()).to_pylist()], pa.string())

    return F.arrow_udf(column, "string")


def _encoder():
    """n, different, md5, then each token with its count; one pass over the tokens of :func:`clone_tokens`."""
    # what separates tokens becomes a blank; all of it is ASCII, so that works on UTF-8 too
    to_blank = bytes(32 if i < 128 and re.fullmatch(SEPARATORS, chr(i)) else i for i in range(256))
    to_strip, blanks, count, head = re.compile(rb"[\x0b\x0c\x1c-\x1f]"), BLANKS.encode(), COUNT.encode(), HEAD

    def encode(text: bytes) -> str:
        tokens = [t for t in text.translate(to_blank).split(b" ") if t]
        if to_strip.search(text):
            tokens = [t.strip(blanks) for t in tokens]
        counts = Counter(tokens)  # in the order in which they first occur
        body = b",".join(b"%b%b%d" % (t, count, n) for t, n in counts.items()).decode("utf-8", "replace")
        return f"{len(tokens)},{len(counts)},{md5(text).hexdigest()}{head}{body}"

    return encode


def _bagger():
    """md5 of the counts of an encoded line's tokens as a sorted JSON object; a line without tokens' place fails."""
    count, head = COUNT.encode(), HEAD.encode()

    def bag(line: bytes) -> str:
        pairs = sorted(t.split(count) for t in line.split(head)[1].split(b","))
        return md5(b"{" + b", ".join(b'"%b": %b' % (p[0], p[1]) for p in pairs) + b"}").hexdigest()

    return bag


def encoded_lines(df: DataFrame, part_id: Column, column: str, text: Column, line_sep: str = "\n") -> DataFrame:
    """value: one line an example for external clone search: part, id, token counts, hash of the text, then each token with its count.

    ``column`` holds the id; tokens stand in the order in which they first occur. Null texts fail.
    """
    checked = F.when(text.isNull(), F.raise_error(F.lit("null text"))).otherwise(text)
    return df.select(F.concat_ws(",", part_id, F.col(column), _by_bytes(_encoder())(checked)).alias("value"))


def hashes_of_encoded(lines: DataFrame, tokens_hash: bool = True) -> DataFrame:
    """part_idx, idx, hash from lines of :func:`encoded_lines`; examples without tokens are left out."""
    info = F.split(F.substring_index("value", HEAD, 1), ",")
    rows = lines.select(info[0].cast("int").alias("part_idx"), info[1].cast("int").alias("idx"), info[3].cast("int").alias("unique"), info[4].alias("hash"), "value")
    rows = rows.where(F.col("unique") > 0)
    if tokens_hash:
        rows = rows.withColumn("hash", _by_bytes(_bagger())(F.col("value")))
    return rows.select("part_idx", "idx", "hash")
