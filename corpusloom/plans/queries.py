"""Queries of the commit operators over the test tables, each with its SQL.

Documents stand in for messages, repositories and parts, turns of conversations for file modifications, events and
orders for authors and histories.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import cleaning as C
from corpusloom.functions import dates
from corpusloom.functions import text as T
from corpusloom.operators import clones, diffs, filters, messages, metadata, outliers, stats
from corpusloom.operators.components import connected_components
from corpusloom.operators.ids import surrogate_ids as number_keys
from corpusloom.plans.pipeline import Config, Tables, drop_by_metadata, run
from corpusloom.runtime import load, materialize, shared_dir
from corpusloom.sources import commits

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# expressions that both dialects read
PART = "CASE doc_id % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END"
RICH = (
    "concat('Fix #', doc_id, ' - see https://ex.org/', doc_id, ' by @user', doc_id % 7, '; mail a', doc_id, '@b.org. ref:', "
    "md5(CAST(doc_id AS STRING)), ' GH-', doc_id, ' (ABC-12)', chr(10), text, chr(10), 'Signed-off-by: u', doc_id)"
)
MESSAGE = (
    "CASE doc_id % 12 WHEN 0 THEN concat('Merge pull ', text) WHEN 1 THEN concat('Revert ', text) "
    "WHEN 2 THEN concat('Squash', chr(10), '* a', doc_id, chr(10), ' * b') WHEN 3 THEN 'Update README.md' "
    "WHEN 4 THEN concat('bump version to 1.2.', doc_id) WHEN 5 THEN concat('word', doc_id) "
    f"WHEN 6 THEN concat('Updated file', doc_id, '.txt') ELSE {RICH} END"
)
DIFF = "concat('@@ -1,2 +3,4 @@', chr(10), text, chr(10), chr(10), ' tab', chr(9), 'x ', chr(10), '@@ -5 +6 @@ section')"
KIND = "CASE role WHEN 'system' THEN 'UNKNOWN' WHEN 'user' THEN 'MODIFY' ELSE 'ADD' END"

W = T.W
SP = f"[{W}]"
UNI = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "", everywhere: bool = False) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}" + (", 'g')" if everywhere else ")")


def s_strip(x: str) -> str:
    return sub(sub(x, rf"\A{SP}+"), rf"{SP}+\z")


def s_apply(x: str, pattern: str, token: str = "") -> str:
    if token:
        return sub(x, rf"((?:{SP}|\A){C.LEAD}){pattern}({C.AFTER}(?:{SP}|\z))", rf"\1{token}\2", True)
    # this dialect has no look-ahead: each blank gets a mark before it, and a match eats only the mark of the next
    marked = sub(sub(x, rf"\A{C.LEAD}{pattern}{C.AFTER}(?:{SP}|\z)"), f"({SP})", "\x01\\1", True)
    return "replace(" + sub(marked, rf"\x01?{SP}(?:[:\-]|\x01?{SP})*{pattern}{C.AFTER}(?:\x01|\z)", "", True) + ", chr(1), '')"


S_NICK = rf"@[^{W}\x01]+?"


def s_issues(x: str, token: str = "") -> str:
    for p in C.ISSUES:
        x = s_apply(x, p, token)
        if not token:
            x = sub(x, r"\A[\-–:]+")
    return x


def s_signatures(x: str) -> str:
    for p in C.SIGNATURES:
        x = sub(x, rf"(?i)(\A|{SP}){p}.*?\z")
    return sub(x, rf"\A{C.LINE_SIGNATURES}.*?\z")


def s_shas(x: str, token: str = "") -> str:
    out = x
    for prefix in C.SHA_PREFIXES:
        out = s_apply(out, prefix + C.SHA, token)
    return f"CASE WHEN regexp_matches({x}, {q(C.DATES)}) THEN {x} ELSE {out} END"


def each(lines: str, f) -> str:
    return f"list_transform({lines}, lambda x: {f('x')})"


def s_lines(f, text: str = RICH) -> str:
    return f"SELECT doc_id, array_to_string({each(f'string_split({text}, chr(10))', f)}, chr(10)) AS cleaned FROM documents"


def s_tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, {q(f'[^{UNI}]+')}))"


def s_trivial(x: str) -> str:
    padded = s_strip(sub(sub(s_strip(x), r"([!-/:-@\[-`{-~])", r" \1 ", True), " +", " ", True))
    return f"regexp_matches({padded}, {q('(?i)' + '|'.join(f'(?:{p})' for p in messages.TRIVIAL))})"


def s_squash(x: str) -> str:
    lines = f"string_split({x}, chr(10))"
    bad = f"len(list_filter({lines}[2:], lambda l: NOT regexp_matches(l, {q(rf'\A{SP}*\*')})))"
    return f"(len({lines}) > 1 AND {bad} = 0)"


def s_ascii(x: str) -> str:
    return f"regexp_matches({x}, {q(r'\A[\x00-\x7F]*\z')})"


def s_dropped(x: str) -> str:
    return f"(NOT {s_ascii(x)} OR starts_with({x}, 'Merge') OR starts_with({x}, 'Revert') OR {s_tokens(x)} = 1 OR {s_squash(x)} OR {s_trivial(x)})"


def documents(spark, sf_dir, **columns) -> DataFrame:
    return load(spark, sf_dir, "documents").select("*", *[F.expr(e).alias(n) for n, e in columns.items()])


def flagged(spark, sf_dir, flag) -> DataFrame:
    return documents(spark, sf_dir, message=MESSAGE).select("doc_id", flag(F.col("message")).alias("flag"))


def cleaned(spark, sf_dir, f) -> DataFrame:
    lines = F.transform(F.split("message", "\n"), f)
    return documents(spark, sf_dir, message=RICH).select("doc_id", F.array_join(lines, "\n").alias("cleaned"))


def s_flag(expression: str) -> str:
    return f"SELECT doc_id, {expression} AS flag FROM (SELECT doc_id, {MESSAGE} AS m FROM documents)"


@query(s_flag(s_ascii("m")))
def msg_ascii_filter(spark, sf_dir):
    return flagged(spark, sf_dir, T.is_ascii)


@query(s_flag(f"{s_tokens('m')} = 1"))
def msg_one_word(spark, sf_dir):
    return flagged(spark, sf_dir, lambda m: T.n_tokens(m) == 1)


@query(s_flag(s_trivial("m")))
def msg_trivial_bot(spark, sf_dir):
    return flagged(spark, sf_dir, messages.is_trivial)


@query(s_flag("starts_with(m, 'Merge') OR starts_with(m, 'Revert')"))
def msg_merge_revert(spark, sf_dir):
    return flagged(spark, sf_dir, lambda m: messages.is_merge(m) | messages.is_revert(m))


@query(s_flag(s_squash("m")))
def msg_squash(spark, sf_dir):
    return flagged(spark, sf_dir, messages.is_squash)


@query(s_lines(lambda x: s_apply(x, C.EMAIL)))
def msg_emails(spark, sf_dir):
    return cleaned(spark, sf_dir, lambda x: C.emails(x))


@query(s_lines(lambda x: s_apply(x, C.URL)))
def msg_urls(spark, sf_dir):
    return cleaned(spark, sf_dir, lambda x: C.urls(x))


@query(s_lines(lambda x: s_apply(x, S_NICK)))
def msg_nicks(spark, sf_dir):
    return cleaned(spark, sf_dir, lambda x: C.nicks(x))


@query(s_lines(s_shas))
def msg_sha(spark, sf_dir):
    return cleaned(spark, sf_dir, lambda x: C.shas(x))


@query(s_lines(s_issues))
def msg_issue_refs(spark, sf_dir):
    return cleaned(spark, sf_dir, lambda x: C.issues(x))


@query(s_lines(s_signatures))
def msg_signatures(spark, sf_dir):
    return cleaned(spark, sf_dir, lambda x: C.signatures(x))


def s_process(replace: bool) -> str:
    t = C.TOKENS if replace else dict.fromkeys(C.TOKENS, "")
    steps = [
        each("l", lambda x: s_apply(x, C.EMAIL, t["email"])),
        each("l", lambda x: s_apply(x, C.URL, t["url"])),
        each("l", lambda x: s_signatures(s_issues(x, t["issue_ref"]))),
        each("l", lambda x: s_apply(x, S_NICK if not replace else C.NICK, t["at_pattern"])),
        each("l", lambda x: s_shas(x, t["sha"])),
        f"list_filter({each('l', s_strip)}, lambda x: x <> '')",
    ]
    sql = f"SELECT doc_id, m, string_split(m, chr(10)) AS l FROM (SELECT doc_id, {MESSAGE} AS m FROM documents) WHERE NOT {s_dropped('m')}"
    for step in steps:
        sql = f"SELECT doc_id, {step} AS l FROM ({sql})"
    return f"SELECT doc_id, c AS message FROM (SELECT doc_id, array_to_string(l, chr(10)) AS c FROM ({sql})) WHERE NOT {s_dropped('c')} AND length(c) > 0"


@query(s_process(False))
def msg_process(spark, sf_dir):
    return messages.clean_messages(documents(spark, sf_dir, message=MESSAGE).select("doc_id", "message"))


@query(s_process(True))
def msg_process_replace(spark, sf_dir):
    return messages.clean_messages(documents(spark, sf_dir, message=MESSAGE).select("doc_id", "message"), replace=True)


def s_diff(x: str) -> str:
    lines = f"list_filter({each(f'string_split({x}, chr(10))', s_strip)}, lambda x: x <> '' AND NOT (starts_with(x, '@@') AND ends_with(x, '@@')))"
    return sub(f"array_to_string(list_transform({lines}, lambda x: x || chr(10)), '')", r"[\t\x0b-\r\x1c-\x20]+", " ", True)


@query(f"SELECT conv_id, turn, {s_diff(DIFF)} AS diff FROM conversations")
def diff_process(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").withColumn("diff", F.expr(DIFF))
    return rows.select("conv_id", "turn", diffs.clean_diff(F.col("diff")).alias("diff"))


def commits_of(spark, sf_dir, diff: str = DIFF) -> DataFrame:
    """One commit a conversation, its turns as modifications in order."""
    mod = f"struct(turn, {KIND} AS change_type, CAST(NULL AS STRING) AS old_path, concat('t', turn) AS new_path, {diff} AS diff)"
    rows = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.expr(mod))).alias("mods"))
    return rows.withColumn("mods", F.transform("mods", lambda m: m.dropFields("turn")))


@query(
    f"SELECT conv_id, count(*) AS n_mods, md5(string_agg(d, ' ' ORDER BY turn, d)) AS diff_md5 FROM (SELECT conv_id, turn, {s_diff(DIFF)} AS d "
    f"FROM conversations WHERE {s_ascii('text')}) GROUP BY conv_id HAVING sum(length(d)) > 0"
)
def diff_mods_filter(spark, sf_dir):
    kept = diffs.clean_diffs(commits_of(spark, sf_dir))
    return kept.select("conv_id", F.size("mods").cast("long").alias("n_mods"), F.md5(F.array_join(F.transform("mods", lambda m: m["diff"]), " ")).alias("diff_md5"))


@query(f"SELECT doc_id, {s_tokens('text')} AS num_tokens, length(text) AS num_chars FROM documents")
def stats_msg(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", outliers.message_stats(F.col("text")).alias("s")).select("doc_id", "s.*")


HEADER = "CASE WHEN role = 'user' THEN concat('t', turn, chr(10)) ELSE concat('new file t', turn, chr(10)) END"
S_MODS = (
    f"SELECT conv_id, coalesce(sum(CASE WHEN role <> 'system' THEN {s_tokens(HEADER)} + {s_tokens('text')} END), 0)::BIGINT AS num_tokens, "
    f"coalesce(sum(CASE WHEN role <> 'system' THEN length({HEADER}) + length(text) END), 0)::BIGINT AS num_chars, count(*) AS num_mods "
    "FROM conversations GROUP BY conv_id"
)


@query(S_MODS)
def stats_mods(spark, sf_dir):
    return commits_of(spark, sf_dir, "text").select("conv_id", outliers.mods_stats(F.col("mods")).alias("s")).select("conv_id", "s.*")


def sized(spark, sf_dir) -> DataFrame:
    """Ids, parts and sizes; written once, as thresholds and the rows within them both read it and texts are slow to measure."""
    rows = documents(spark, sf_dir, part=PART)
    return materialize(rows.select("doc_id", "part", outliers.message_stats(F.col("text")).alias("s")).select("doc_id", "part", "s.*"))


S_SIZED = f"SELECT doc_id, {PART} AS part, {s_tokens('text')} AS num_tokens, length(text) AS num_chars FROM documents"
S_LIMITS = "SELECT " + ", ".join(
    f"quantile_cont(num_{c}, {p}) AS num_{c}_{n}" for c in ("tokens", "chars") for n, p in (("lower", 0.05), ("upper", 0.95))
) + f" FROM ({S_SIZED}) WHERE part = 'train'"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def s_rounded(sql: str, columns: list[str]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in columns)}) FROM ({sql})"


@query(s_rounded(S_LIMITS, [f"num_{c}_{n}" for c in ("tokens", "chars") for n in ("lower", "upper")]))
def outlier_percentiles(spark, sf_dir):
    return rounded(outliers.percentiles(sized(spark, sf_dir), ["num_tokens", "num_chars"]))


@query(
    f"SELECT s.* FROM ({S_SIZED}) s, ({S_LIMITS}) WHERE num_tokens BETWEEN num_tokens_lower AND num_tokens_upper "
    "AND num_chars BETWEEN num_chars_lower AND num_chars_upper"
)
def outlier_drop(spark, sf_dir):
    rows = sized(spark, sf_dir)
    return outliers.drop_outliers(rows, outliers.percentiles(rows, ["num_tokens", "num_chars"]), ["num_tokens", "num_chars"])


def s_without(x: str) -> str:
    for token in clones.special_tokens():
        x = f"replace({x}, {q(token) if token != chr(10) else 'chr(10)'}, '')"
    return x


S_MSG = s_without("lower(text)")
S_DIFF = s_without(sub("regexp_replace(text, '[0-9]+', '', 'g')", r"@@.*?@@\n", "", True))


def s_cut(x: str) -> str:
    return f"list_transform(list_filter(regexp_split_to_array({x}, {q(clones.SEPARATORS)}), lambda y: y <> ''), lambda y: {s_strip('y')})"


S_HASHED = (
    f"SELECT doc_id, source, lang, {PART} AS part, CASE WHEN len({s_cut(S_MSG)}) > 0 THEN md5({S_MSG}) END AS mh, "
    f"CASE WHEN len({s_cut(S_DIFF)}) > 0 THEN md5({S_DIFF}) END AS dh FROM documents"
)


def hashed(spark, sf_dir, tokens_hash: bool = False) -> DataFrame:
    mods = "array(named_struct('change_type', 'MODIFY', 'old_path', CAST(NULL AS STRING), 'new_path', 'p', 'diff', regexp_replace(text, '[0-9]+', '')))"
    return clones.add_hashes(documents(spark, sf_dir, part=PART, mods=mods), "text", tokens_hash=tokens_hash)


def hashes(spark, sf_dir) -> DataFrame:
    """What clone search reads several times: ids, parts and hashes, written once instead of hashing the texts for each use."""
    return materialize(hashed(spark, sf_dir).select("doc_id", "part", "lang", "mh", "dh"))


@query(
    f"SELECT doc_id, len(t) AS n_total, len(list_distinct(t)) AS n_unique, md5(array_to_string(t, ' ')) AS tokens_md5 "
    f"FROM (SELECT doc_id, {s_cut(S_MSG)} AS t FROM documents)"
)
def encode_tokens(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", clones.clone_tokens(clones.message_text(F.col("text"))).alias("t"))
    return rows.select(
        "doc_id", F.size("t").cast("long").alias("n_total"), F.size(F.array_distinct("t")).cast("long").alias("n_unique"), F.md5(F.array_join("t", " ")).alias("tokens_md5")
    )


@query(f"SELECT doc_id, mh, dh FROM ({S_HASHED})")
def hash_string(spark, sf_dir):
    return hashed(spark, sf_dir).select("doc_id", "mh", "dh")


@query(
    "SELECT doc_id, CASE WHEN len(t) > 0 THEN md5('{' || array_to_string(list_transform(map_entries(list_aggregate(t, 'histogram')), "
    f"lambda e: '\"' || e.key || '\": ' || e.value), ', ') || '}}') END AS mh FROM (SELECT doc_id, {s_cut(S_MSG)} AS t FROM documents)"
)
def hash_tokens(spark, sf_dir):
    return hashed(spark, sf_dir, True).select("doc_id", "mh")


@query(
    f"SELECT mh AS hash, string_agg(part || ':' || doc_id, ',' ORDER BY part, doc_id) AS clones FROM ({S_HASHED}) WHERE mh IS NOT NULL GROUP BY mh HAVING count(*) > 1"
)
def clone_groups(spark, sf_dir):
    groups = clones.clone_groups(hashed(spark, sf_dir), "mh", ["part", "doc_id"])
    return groups.select("hash", F.array_join(F.transform("clones", lambda c: F.concat_ws(":", c["part"], c["doc_id"])), ",").alias("clones"))


S_ANY = "SELECT DISTINCT part, doc_id FROM h WHERE EXISTS (FROM h o WHERE o.part = h.part AND o.doc_id <> h.doc_id AND (o.mh = h.mh OR o.dh = h.dh))"
S_OUTER = "SELECT DISTINCT part, doc_id FROM h WHERE part = 'train' AND (mh IN (SELECT mh FROM h WHERE part <> 'train' AND mh IS NOT NULL) OR dh IN (SELECT dh FROM h WHERE part <> 'train' AND dh IS NOT NULL))"
S_INNER = "SELECT part, doc_id FROM (SELECT *, count(*) OVER (PARTITION BY part, mh) AS a, count(*) OVER (PARTITION BY part, dh) AS b FROM h) WHERE (mh IS NOT NULL AND a > 1) OR (dh IS NOT NULL AND b > 1)"


@query(f"WITH h AS ({S_HASHED}) {S_INNER}")
def inner_any(spark, sf_dir):
    return clones.inner_clones(hashes(spark, sf_dir), "doc_id")


@query(
    f"WITH h AS ({S_HASHED}) SELECT part, doc_id FROM (SELECT *, count(*) OVER (PARTITION BY part, mh, dh) AS n FROM h WHERE mh IS NOT NULL AND dh IS NOT NULL) WHERE n > 1"
)
def inner_full(spark, sf_dir):
    return clones.inner_clones(hashes(spark, sf_dir), "doc_id", only_full=True)


@query(f"WITH h AS ({S_HASHED}) {S_OUTER}")
def outer_clones(spark, sf_dir):
    return clones.outer_clones(hashes(spark, sf_dir), "doc_id")


S_LEFT = f"WITH h AS ({S_HASHED}) SELECT doc_id, part, lang FROM h WHERE doc_id NOT IN (SELECT doc_id FROM ({S_INNER})) AND doc_id NOT IN (SELECT doc_id FROM ({S_OUTER}))"


@query(S_LEFT)
def drop_clones(spark, sf_dir):
    return clones.drop_clones(hashes(spark, sf_dir), "doc_id").select("doc_id", "part", "lang")


@query(f"SELECT lang, part, count(*) AS n FROM ({S_LEFT}) GROUP BY lang, part")
def survivors_by_language(spark, sf_dir):
    return drop_clones(spark, sf_dir).groupBy("lang", "part").agg(F.count("*").alias("n"))


# pairs of similar examples, as another tool would report them: orders of one customer and day for messages, of one customer and priority for diffs
def pairs_of(spark, sf_dir, key: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.expr(key).alias("k"), (F.col("o_orderkey") % 3).cast("int").alias("p"))
    ranked = o.groupBy("o_custkey", "k").agg(F.array_sort(F.collect_list(F.struct("id", "p"))).alias("g"))
    steps = ranked.select(F.explode(F.expr("transform(slice(g, 2, size(g)), (x, i) -> named_struct('a', x, 'b', g[i]))")).alias("s"))
    return steps.select(F.col("s.a.p").alias("part_id1"), F.col("s.a.id").alias("id1"), F.col("s.b.p").alias("part_id2"), F.col("s.b.id").alias("id2"))


def s_pairs(key: str) -> str:
    return (
        "SELECT p AS part_id1, id AS id1, q AS part_id2, other AS id2 FROM (SELECT o_orderkey AS id, (o_orderkey % 3)::INT AS p, lag(o_orderkey) OVER w AS other, "
        f"(lag(o_orderkey) OVER w % 3)::INT AS q FROM orders WINDOW w AS (PARTITION BY o_custkey, {key} ORDER BY o_orderkey)) WHERE other IS NOT NULL"
    )


BY_MONTH, BY_STATUS = "month(o_orderdate)", "o_orderstatus"
S_EDGES = "SELECT id1 AS src, id2 AS dst FROM {0} WHERE part_id1 = 1 AND part_id2 = 1 UNION SELECT id2, id1 FROM {0} WHERE part_id1 = 1 AND part_id2 = 1"
S_BOTH = f"WITH RECURSIVE m AS ({s_pairs(BY_MONTH)}), d AS ({s_pairs(BY_STATUS)}), me AS ({S_EDGES.format('m')}), de AS ({S_EDGES.format('d')})"


@query(f"{S_BOTH} SELECT DISTINCT src AS id FROM (SELECT * FROM me INTERSECT SELECT * FROM de)")
def pairs_similar(spark, sf_dir):
    return clones.similar_full_clones(pairs_of(spark, sf_dir, BY_MONTH), pairs_of(spark, sf_dir, BY_STATUS), 1)


@query(f"{S_BOTH} SELECT DISTINCT src AS id FROM (SELECT * FROM me UNION SELECT * FROM de)")
def pairs_any(spark, sf_dir):
    return clones.pair_clones(pairs_of(spark, sf_dir, BY_MONTH), pairs_of(spark, sf_dir, BY_STATUS), 1)


@query(
    f"{S_BOTH} SELECT DISTINCT id1 AS id FROM (SELECT id1 FROM m WHERE part_id1 = 0 AND part_id2 <> 0 UNION SELECT id2 FROM m WHERE part_id2 = 0 AND part_id1 <> 0 "
    "UNION SELECT id1 FROM d WHERE part_id1 = 0 AND part_id2 <> 0 UNION SELECT id2 FROM d WHERE part_id2 = 0 AND part_id1 <> 0)"
)
def pairs_outer(spark, sf_dir):
    return clones.pair_clones(pairs_of(spark, sf_dir, BY_MONTH), pairs_of(spark, sf_dir, BY_STATUS), 0, other=True)


@query(
    f"{S_BOTH}, reach AS (SELECT src AS node, src AS seen FROM me UNION SELECT r.node, e.dst FROM reach r JOIN me e ON r.seen = e.src) "
    "SELECT node, min(seen) AS component FROM reach GROUP BY node"
)
def pairs_components(spark, sf_dir):
    return connected_components(clones.pair_edges(pairs_of(spark, sf_dir, BY_MONTH), 1))


@query(
    f"{S_BOTH}, mr AS (SELECT src AS node, src AS seen FROM me UNION SELECT r.node, e.dst FROM mr r JOIN me e ON r.seen = e.src), "
    "dr AS (SELECT src AS node, src AS seen FROM de UNION SELECT r.node, e.dst FROM dr r JOIN de e ON r.seen = e.src), "
    "mc AS (SELECT node, min(seen) AS c FROM mr GROUP BY node), dc AS (SELECT node, min(seen) AS c FROM dr GROUP BY node) "
    "SELECT id FROM (SELECT mc.node AS id, count(*) OVER (PARTITION BY mc.c, dc.c) AS n FROM mc JOIN dc ON mc.node = dc.node) WHERE n > 1"
)
def pairs_identical_full(spark, sf_dir):
    return clones.identical_full_clones(pairs_of(spark, sf_dir, BY_MONTH), pairs_of(spark, sf_dir, BY_STATUS), 1)


@query(f"SELECT doc_id FROM documents WHERE len(list_distinct({s_cut(S_MSG)})) > 1 AND len(list_distinct({s_cut(S_DIFF)})) > 1")
def short_examples(spark, sf_dir):
    return metadata.drop_short(hashed(spark, sf_dir)).select("doc_id")


NAME = "CASE WHEN user_id % 13 = 0 THEN concat('u', user_id, '[bot]') WHEN user_id % 17 = 0 THEN concat('ro', user_id, 'Bot') ELSE concat('u', user_id) END"
EMAIL = "CASE WHEN user_id % 5 = 0 THEN '' ELSE concat('m', user_id % 400, '@x.org') END"
BOTS = "concat('u', c_custkey * 3) AS name, concat('u', c_custkey * 7) AS login, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE concat('m', c_custkey * 11, '@x.org') END AS email"


def authored(spark, sf_dir) -> DataFrame:
    rows = load(spark, sf_dir, "events")
    part = F.expr("CASE event_id % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END")
    return rows.select("event_id", F.expr(NAME).alias("name"), F.expr(EMAIL).alias("email"), part.alias("part"), F.col("event_type").alias("repo"))


S_AUTHORED = f"SELECT event_id, {NAME} AS name, {EMAIL} AS email, CASE event_id % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS part, event_type AS repo FROM events"
S_BOTS = (
    f"WITH a AS (SELECT DISTINCT name, email FROM ({S_AUTHORED})), b AS (SELECT {BOTS} FROM customer) SELECT name, email FROM a WHERE lower(name) LIKE '%bot' OR lower(name) LIKE '%[bot]' "
    "OR (name <> '' AND (name IN (SELECT name FROM b) OR name IN (SELECT login FROM b))) OR (email <> '' AND email IN (SELECT email FROM b))"
)


@query(S_BOTS)
def bot_authors(spark, sf_dir):
    bots = load(spark, sf_dir, "customer").selectExpr(*BOTS.replace(" AS name, ", " AS name|").replace(" AS login, ", " AS login|").split("|"))
    return metadata.bot_authors(authored(spark, sf_dir), bots)


@query(f"SELECT event_id FROM ({S_AUTHORED}) WHERE (name, email) NOT IN ({S_BOTS})")
def drop_bots(spark, sf_dir):
    return metadata.drop_bots(authored(spark, sf_dir), bot_authors(spark, sf_dir)).select("event_id")


@query(f"WITH e AS ({S_AUTHORED}) SELECT event_id FROM e WHERE part <> 'train' OR NOT EXISTS (FROM e o WHERE o.part <> 'train' AND o.name = e.name AND o.email = e.email)")
def shared_authors(spark, sf_dir):
    return metadata.drop_shared_authors(authored(spark, sf_dir)).select("event_id")


def repo_table(spark, sf_dir) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("org/"), "source").alias("name"), F.col("lang").alias("mainLanguage"), F.concat(F.lit("L-"), "lang").alias("license"), "doc_id")


@query(
    "WITH r AS (SELECT 'org/' || source AS name, arg_max(lang, doc_id) AS language, arg_max('L-' || lang, doc_id) AS license FROM documents GROUP BY 1) "
    "SELECT doc_id, 'org#' || source AS repo, r.language, r.license FROM documents JOIN r ON r.name = 'org/' || source"
)
def repo_metadata_join(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("org#"), "source").alias("repo"))
    return metadata.add_repo_metadata(docs, repo_table(spark, sf_dir), order="doc_id")


@query(
    f"WITH e AS ({S_AUTHORED}), m AS (SELECT name, email, repo, max(event_id) AS author_id FROM e GROUP BY ALL) SELECT event_id, author_id FROM e JOIN m USING (name, email, repo)"
)
def author_ids(spark, sf_dir):
    rows = authored(spark, sf_dir)
    known = rows.select("name", "email", "repo", F.col("event_id").alias("id"), F.col("event_id").alias("line"))
    return metadata.add_author_ids(rows, known, order="line").select("event_id", "author_id")


S_PUNCT = rf"len(regexp_extract_all(text, {q(rf'{T.WORD}+|[^\p{{L}}\p{{N}}_{UNI}]+')}))"
S_APPROX = rf"CASE WHEN {s_strip('text')} <> '' THEN NOT regexp_matches(text, {q(rf'''[.!?]['")\]]*{SP}+['"(\[]*[A-Z]''')}) END"


@query(f"SELECT doc_id, NOT contains(text, chr(10)) AS newline, {S_APPROX} AS punct FROM documents")
def one_sentence(spark, sf_dir):
    x = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", T.one_sentence(x).alias("newline"), T.one_sentence_punct(x).alias("punct"))


@query(f"SELECT doc_id, {S_PUNCT} <= 30 AS no_longer, {S_PUNCT} >= 100 AS no_shorter FROM documents")
def length_filters(spark, sf_dir):
    x = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", T.no_longer_than(x, 30).alias("no_longer"), T.no_shorter_than(x, 100).alias("no_shorter"))


S_FLAGS = (
    f"SELECT doc_id, lang, quality = 1 AS is_vdo, NOT contains(text, chr(10)) AS first_sentence_newline, {S_APPROX} AS first_sentence_punct, "
    f"{S_PUNCT} <= 30 AS message_30_tokens, {S_PUNCT} <= 100 AS diff_100_tokens FROM documents JOIN labels USING (doc_id)"
)


@query(S_FLAGS)
def filter_flags(spark, sf_dir):
    judged = load(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("judged"))
    docs = load(spark, sf_dir, "documents").join(judged.select("doc_id"), "doc_id", "left_semi")
    joined = filters.with_judgements(docs, judged, ["doc_id"])
    return joined.select("doc_id", "lang", *filters.filter_row(F.col("text"), F.col("text"), F.col("judged")))


@query(f"SELECT lang, is_vdo, count(*) AS n FROM ({S_FLAGS}) GROUP BY ALL")
def value_counts(spark, sf_dir):
    return stats.value_counts(filter_flags(spark, sf_dir), "is_vdo", ["lang"], drop_null=False)


def s_totals(n: str) -> str:
    return (
        f"SELECT CASE WHEN grouping(part) = 1 THEN 'All' ELSE part END AS part, CASE WHEN grouping(lang) = 1 THEN 'All' ELSE lang END AS lang, {n} AS n "
        f"FROM (SELECT *, {PART} AS part FROM documents) GROUP BY CUBE (part, lang)"
    )


def s_pivot(n: str) -> str:
    return "SELECT part, " + ", ".join(f"max(n) FILTER (lang = '{c}') AS \"{c}\"" for c in ("en", "fr", "de", "es", "All")) + f" FROM ({s_totals(n)}) GROUP BY part"


@query(s_pivot("count(doc_id)"))
def pivot_count_margins(spark, sf_dir):
    return stats.pivot_totals(documents(spark, sf_dir, part=PART), "part", "lang", "doc_id", ["en", "fr", "de", "es"])


@query(s_pivot("count(DISTINCT source)"))
def pivot_nunique_margins(spark, sf_dir):
    return stats.pivot_totals(documents(spark, sf_dir, part=PART), "part", "lang", "source", ["en", "fr", "de", "es"], distinct=True)


S_CUTS = ", ".join(f"quantile_cont(n_chars, {p}) AS p{round(p * 100):02d}" for p in stats.PERCENTILES)


@query(
    s_rounded(
        f"SELECT lang, count(n_chars) AS count, avg(n_chars) AS mean, stddev_samp(n_chars) AS std, min(n_chars) AS min, {S_CUTS}, max(n_chars) AS max FROM documents GROUP BY lang",
        ["mean", "std", *(f"p{round(p * 100):02d}" for p in stats.PERCENTILES)],
    )
)
def describe_by_group(spark, sf_dir):
    return rounded(stats.describe(load(spark, sf_dir, "documents"), "n_chars", ["lang"]))


S_REPO = (
    "SELECT repo, language, n, n * 100.0::DOUBLE / sum(n) OVER () AS percent_all, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY language) AS percent_language "
    "FROM (SELECT source AS repo, min(lang) AS language, count(*) AS n FROM documents GROUP BY source)"
)


@query(s_rounded(S_REPO, ["percent_all", "percent_language"]))
def repo_stats(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("lang").alias("language"))
    return rounded(stats.repo_stats(docs))


@query(
    s_rounded(
        "SELECT author, num_commits, num_commits_orig, num_commits * 100.0::DOUBLE / num_commits_orig AS percent_commits FROM (SELECT o_custkey AS author, count(*) AS num_commits "
        "FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) JOIN (SELECT o_custkey AS author, count(*) AS num_commits_orig FROM orders GROUP BY 1) USING (author) WHERE num_commits_orig > 1",
        ["percent_commits"],
    )
)
def author_stats(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "author")
    history = rows.groupBy("author").agg(F.count("*").alias("num_commits_orig"))
    return rounded(stats.author_stats(rows.where("o_orderstatus = 'F'"), history, skip_single=True))


@query(
    s_rounded(
        f"SELECT part, count(n) AS count, avg(n) AS mean, stddev_samp(n) AS std, min(n) AS min, {S_CUTS.replace('n_chars', 'n')}, max(n) AS max FROM "
        f"(SELECT {PART} AS part, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY part",
        ["mean", "std", *(f"p{round(p * 100):02d}" for p in stats.PERCENTILES)],
    )
)
def describe_parts(spark, sf_dir):
    return rounded(stats.describe_groups(documents(spark, sf_dir, part=PART), "part", "source"))


def counters(spark, sf_dir) -> DataFrame:
    """One map a user: how often each event type occurs."""
    rows = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return rows.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m")).withColumn("g", F.col("user_id") % 5)


@query("SELECT event_type AS key, count(*)::BIGINT AS n FROM events GROUP BY 1 ORDER BY n DESC, key LIMIT 3")
def counter_top_k(spark, sf_dir):
    return stats.top_k(stats.merge_counters(counters(spark, sf_dir), "m"), 3)


@query(
    "SELECT g, key, n FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, key) AS k FROM (SELECT user_id % 5 AS g, event_type AS key, count(*)::BIGINT AS n FROM events GROUP BY ALL)) WHERE k <= 2"
)
def top_k_per_group(spark, sf_dir):
    return stats.top_k(stats.merge_counters(counters(spark, sf_dir), "m", ["g"]), 2, ["g"])


@query(
    "SELECT doc_id, lang, CASE WHEN r <= round(n * 0.8) THEN 'train' WHEN r <= round(n * 0.9) THEN 'val' ELSE 'test' END AS part FROM "
    "(SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)"
)
def stratified_split(spark, sf_dir):
    return stats.stratified_split(load(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("SELECT source, arg_min(lang, doc_id) AS lang, min(doc_id) AS doc_id FROM documents GROUP BY source")
def dedup_keep_first(spark, sf_dir):
    return stats.keep_first(load(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ["source"], "doc_id")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def license_whitelist(spark, sf_dir):
    return filters.licensed(load(spark, sf_dir, "customer"), "c_mktsegment", ("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query(
    "SELECT source, hash, row_number() OVER (ORDER BY place // 1000000000000, source NULLS FIRST, place, hash) - 1 AS id FROM "
    f"(SELECT source, md5(text) AS hash, min(CASE {PART} WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END * 1000000000000 + doc_id) AS place "
    "FROM documents GROUP BY source, md5(text))"
)
def surrogate_ids(spark, sf_dir):
    rank = f"CASE {PART} WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END"
    rows = load(spark, sf_dir, "documents").select("source", F.md5("text").alias("hash"), F.expr(rank).alias("rank"), F.col("source").alias("repo"), "doc_id")
    return number_keys(rows, ["source", "hash"], ["rank", "repo", "doc_id"])


@query("SELECT doc_id, 'org/' || source AS repo FROM documents")
def merge_parts(spark, sf_dir):
    return commits.merge_parts(load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("org#"), "source").alias("repo")))


@query("SELECT string_agg(text, '[NL]' ORDER BY turn, text) AS value FROM conversations GROUP BY conv_id")
def tokenizer_text(spark, sf_dir):
    return commits.diff_lines(commits_of(spark, sf_dir, "text"), "[NL]")


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS diff_md5 FROM conversations GROUP BY conv_id")
def filter_text(spark, sf_dir):
    return commits_of(spark, sf_dir, "text").select("conv_id", F.md5(filters.diff_for_lengths(F.col("mods"))).alias("diff_md5"))


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, round(sum(n_chars) * 1.0::DOUBLE / count(*), 6) AS ratio FROM documents GROUP BY lang")
def count_and_sum(spark, sf_dir):
    by = stats.count_and_sum(load(spark, sf_dir, "documents"), ["lang"], "n_chars", "chars")
    return rounded(stats.ratio(by, "chars", "n", "ratio", percent=False))


@query(
    f"SELECT lang, round(count(*) FILTER ({PART} = 'val') * 100.0::DOUBLE / nullif(count(*) FILTER ({PART} = 'train'), 0), 6) AS percent FROM documents "
    f"WHERE {PART} IN ('train', 'val') GROUP BY lang HAVING count(*) FILTER ({PART} = 'val') > 0 AND count(*) FILTER ({PART} = 'train') > 0"
)
def ratio_of_parts(spark, sf_dir):
    by = {p: documents(spark, sf_dir, part=PART).where(F.col("part") == p).groupBy("lang").agg(F.count("*").alias("n")) for p in ("val", "train")}
    return rounded(stats.ratio_of(by["val"], by["train"], ["lang"], "n", "percent")).where("percent IS NOT NULL")


@query("SELECT c_custkey, n_name AS github_full_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2")
def search_metadata(spark, sf_dir):
    search = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("name"))
    known = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("name"), F.expr("CASE WHEN n_regionkey <> 2 THEN n_name END").alias("github_full_name"))
    return filters.found_repos(search, known).select("c_custkey", "github_full_name")


@query("SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'val' ELSE 'train' END AS part FROM customer WHERE c_nationkey % 3 < 2")
def split_membership(spark, sf_dir):
    names = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    found = filters.in_parts(load(spark, sf_dir, "customer"), {"val": names.where("c_nationkey % 3 = 0"), "train": names.where("c_nationkey % 3 = 1")}, "c_nationkey")
    return found["val"].select("c_custkey", F.lit("val").alias("part")).unionByName(found["train"].select("c_custkey", F.lit("train").alias("part")))


@query(
    f"{S_BOTH} SELECT q AS root_part, y AS root, string_agg(x::VARCHAR, ',' ORDER BY x) AS clones FROM (SELECT id1 AS x, part_id2 AS q, id2 AS y FROM m WHERE part_id1 = 0 AND part_id2 <> 0 "
    "UNION SELECT id2, part_id1, id1 FROM m WHERE part_id2 = 0 AND part_id1 <> 0) GROUP BY q, y"
)
def pair_sets(spark, sf_dir):
    return clones.pair_sets(pairs_of(spark, sf_dir, BY_MONTH), 0, (1, 2)).select("root_part", "root", F.array_join("clones", ",").alias("clones"))


# pairs of documents, as another tool would report them
PAIR_MSG, PAIR_DIFF = ("doc_id % 6 = 0", 30), ("doc_id % 7 = 0", 1)
PART_ID = f"CASE {PART} WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END"


@query(
    f"WITH d AS (SELECT doc_id, {PART_ID} AS p FROM documents), pairs AS ("
    + " UNION ALL ".join(f"SELECT a.doc_id AS a, a.p AS p, b.doc_id AS b, b.p AS q FROM d a JOIN d b ON b.doc_id = a.doc_id + {n} WHERE {c.replace('doc_id', 'a.doc_id')}" for c, n in (PAIR_MSG, PAIR_DIFF))
    + "), gone AS (SELECT a AS doc_id FROM pairs WHERE p = q OR p = 1 UNION SELECT b FROM pairs WHERE p = q OR q = 1) "
    f"SELECT doc_id, {PART} AS part FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)"
)
def pairs_pipeline(spark, sf_dir):
    docs = documents(spark, sf_dir, part=PART, repo="source", hash="concat('h', doc_id)", p=PART_ID)
    ids = docs.select(F.col("p").alias("part_id1"), F.col("doc_id").alias("id1"))
    pairs = [
        ids.where(c.replace("doc_id", "id1")).withColumn("id2", F.col("id1") + n).join(ids.select(F.col("part_id1").alias("part_id2"), F.col("id1").alias("id2")), "id2")
        for c, n in (PAIR_MSG, PAIR_DIFF)
    ]
    tables = Tables(message_pairs=pairs[0], diff_pairs=pairs[1], id_map=docs.select("repo", "hash", F.col("doc_id").alias("id")))
    only_clones = Config(outliers=False, messages=False, diffs=False, metadata=False)
    return run(docs.select("doc_id", "part", "repo", "hash"), tables, only_clones).select("doc_id", "part")


@query(
    f"SELECT s.* FROM ({S_SIZED}) s, ({S_LIMITS}) WHERE num_tokens BETWEEN num_tokens_lower AND num_tokens_upper "
    "AND num_chars BETWEEN num_chars_lower AND num_chars_upper"
)
def thresholds_saved(spark, sf_dir):
    rows = sized(spark, sf_dir)
    renamed = {f"num_{c}": f"msg_num_{c}" for c in ("tokens", "chars")}
    folder = f"{shared_dir(spark)}/thresholds-{uuid.uuid4().hex}"
    outliers.save_percentiles(outliers.percentiles(rows.withColumnsRenamed(renamed), list(renamed.values())), folder)
    kept = outliers.drop_outliers(rows.withColumnsRenamed(renamed), outliers.load_percentiles(spark, folder), list(renamed.values()))
    return kept.withColumnsRenamed({new: old for old, new in renamed.items()})


S_BAG = "list_transform(list_distinct(t), lambda u: u || '@@::@@' || len(list_filter(t, lambda v: v = u)))"


@query(
    f"SELECT doc_id, md5(head || array_to_string(list_sort({S_BAG}), ',')) AS line_md5 FROM (SELECT doc_id, t, "
    f"concat_ws(',', 7, doc_id, len(t), len(list_distinct(t)), md5(x)) || '@#@' AS head FROM (SELECT doc_id, {S_MSG} AS x, {s_cut(S_MSG)} AS t FROM documents))"
)
def encoded_lines(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    lines = clones.encoded_lines(docs, F.lit(7), "doc_id", clones.message_text(F.col("text")))
    head, tokens = F.substring_index("value", "@#@", 1), F.substring_index("value", "@#@", -1)
    ordered = F.array_join(F.sort_array(F.split(tokens, ",")), ",")
    return lines.select(F.split(head, ",").getItem(1).cast("long").alias("doc_id"), F.md5(F.concat(head, F.lit("@#@"), ordered)).alias("line_md5"))


@query(
    "SELECT idx, md5(body) AS hash FROM (SELECT doc_id AS idx, '{' || array_to_string(list_transform(map_entries(list_aggregate(t, 'histogram')), lambda e: '\"' || e.key || '\": ' || e.value), ', ') || '}' AS body "
    f"FROM (SELECT doc_id, {s_cut(S_MSG)} AS t FROM documents) WHERE len(t) > 0)"
)
def encoded_hashes(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    lines = materialize(clones.encoded_lines(docs, F.lit(1), "doc_id", clones.message_text(F.col("text"))))
    return clones.hashes_of_encoded(lines).select(F.col("idx").cast("long").alias("idx"), "hash")


@query("SELECT o_orderkey, strftime(o_orderdate::TIMESTAMP, '%d.%m.%Y %H:%M:%S') AS date, strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d') AS day FROM orders")
def date_formats(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_orderkey", dates.format_date(F.col("o_orderdate").cast("timestamp")).alias("date"))
    return rows.withColumn("day", F.date_format(dates.parse_date(F.col("date")), "yyyy-MM-dd"))


STAGED = (
    "doc_id", f"{PART} AS part", "CASE WHEN doc_id % 23 = 0 THEN 'helper[bot]' ELSE concat('u', doc_id * 7 % 61) END AS name", "concat('m', doc_id % 13, '@x.org') AS email",
    "concat('org#', source) AS repo", "doc_id % 5 AS n_unique_msg", "doc_id % 4 AS n_unique_diff",
)


@query(
    f"WITH d AS (SELECT {', '.join(STAGED)} FROM documents), o AS (SELECT name, email FROM d WHERE part <> 'train'), "
    "r AS (SELECT 'org/' || source AS repo_name, arg_max(lang, doc_id) AS language, arg_max('L-' || lang, doc_id) AS license FROM documents GROUP BY 1), "
    "m AS (SELECT name, email, repo, max(doc_id) AS author_id FROM d GROUP BY ALL) "
    "SELECT doc_id, part, language, license, author_id FROM d JOIN r ON repo_name = replace(repo, '#', '/') JOIN m USING (name, email, repo) "
    "WHERE n_unique_msg > 1 AND n_unique_diff > 1 AND name NOT IN ('helper[bot]', 'u7', 'u11') AND (part <> 'train' OR NOT EXISTS (FROM o WHERE o.name = d.name AND o.email = d.email))"
)
def metadata_stage(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").selectExpr(*STAGED)
    bots = spark.createDataFrame([("u7", "", ""), ("x", "u11", "")], "name string, login string, email string")
    known = rows.select("name", "email", "repo", F.col("doc_id").alias("id"), F.col("doc_id").alias("line"))
    repos = repo_table(spark, sf_dir).withColumnRenamed("doc_id", "line")
    return drop_by_metadata(rows, Tables(bots=bots, authors_map=known, repos=repos), Config()).select("doc_id", "part", "language", "license", "author_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors_by_language(spark, sf_dir)
