"""The queries of the ten operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.exact import exact_dedup
from corpusloom.llm.licences import RULES, SENTENCES, longest_first, scan_licences
from corpusloom.llm.lines import line_report
from corpusloom.llm.mixing import mix
from corpusloom.llm.pagetext import extract_pages
from corpusloom.llm.pieces import encode_documents
from corpusloom.llm.pivots import embedding_groups
from corpusloom.llm.simhash import simhash_groups
from corpusloom.llm.spans import substring_dedup
from corpusloom.llm.toxicity import toxicity
from corpusloom.runtime import load


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(load(spark, sf_dir, "documents"), digests=True)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_report(load(spark, sf_dir, "documents"))
    return found.withColumn("removed", F.array_join("removed", ","))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(load(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(load(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(load(spark, sf_dir, "embeddings"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", "n_known", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_sentencepiece,
        op3_line_dedup,
        op4_mixing,
        op5_html_extraction,
        op6_simhash,
        op7_embeddings,
        op8_substring,
        op9_exact,
        op10_licences,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _licence_sql() -> str:
    quote = lambda s: "'" + s + "'"
    cases = [f"WHEN s = {quote(s)} THEN {quote(i)}" for i, s in SENTENCES if not s.endswith("*")]
    cases += [f"WHEN starts_with(s, {quote(s[:-1])}) THEN {quote(i)}" for i, s in longest_first(SENTENCES) if s.endswith("*")]
    # an ordered rule as a pattern over the coded sequence: at most two other sentences between two of it
    names = sorted({i for i, _ in SENTENCES})
    code = {n: f"<{k}>" for k, n in enumerate(names)}
    rules = ", ".join(
        f"CASE WHEN regexp_matches(coded, {quote('(<[0-9]*>){0,2}'.join(code[i] for i in ids))}) THEN {quote(name)} END" for name, ids in RULES
    )
    coded = "CASE " + " ".join(f"WHEN id = {quote(n)} THEN {quote(c)}" for n, c in code.items()) + " ELSE '<>' END"
    return rf"""
    WITH cut AS (
      SELECT doc_id, list_filter(list_transform(regexp_split_to_array(
        regexp_replace(coalesce(text, ''), '\n|[.;:!?]([ \t\r\n]|\z)', chr(1) || '\1', 'g'), chr(1)),
        lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS sentences
      FROM documents),
    named AS (SELECT doc_id, len(sentences) AS n, list_transform(sentences, lambda s: CASE {' '.join(cases)} END) AS ids FROM cut),
    coded AS (SELECT doc_id, n, list_filter(ids, lambda x: x IS NOT NULL) AS known,
      array_to_string(list_transform(ids, lambda id: {coded}), '') AS coded FROM named)
    SELECT doc_id, n AS n_sentences, len(known) AS n_known, array_to_string(known, ',') AS sentence_ids,
      array_to_string(list_sort(list_distinct(list_filter([{rules}], lambda x: x IS NOT NULL))), ',') AS licences
    FROM coded"""


ORACLE_SQL = {
    "op3_line_dedup": r"""
    WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    raw AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM cut),
    l AS (SELECT doc_id, no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    d AS (SELECT w, min((doc_id, no)) AS place FROM l GROUP BY w),
    v AS (SELECT place, len(w) AS n, i, md5(array_to_string(w[:i - 1] || w[i + 1:], ' ')) AS k
      FROM (SELECT place, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) >= 5)),
    whole AS (SELECT place, len(w) AS n, md5(array_to_string(w, ' ')) AS k FROM d WHERE len(w) >= 5),
    near AS (SELECT place FROM (SELECT place, min(place) OVER (PARTITION BY n, i, k) AS least FROM v) WHERE least < place
      UNION SELECT greatest(v.place, whole.place) FROM v JOIN whole ON v.k = whole.k AND v.n = whole.n + 1),
    gone AS (SELECT l.doc_id, l.no FROM l JOIN d ON l.w = d.w WHERE (l.doc_id, l.no) > d.place OR d.place IN (SELECT place FROM near)),
    listed AS (SELECT doc_id, count(*) AS n_removed, string_agg(no::VARCHAR, ',' ORDER BY no) AS removed FROM gone GROUP BY doc_id),
    counted AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id)
    SELECT documents.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed
    FROM documents LEFT JOIN counted USING (doc_id) LEFT JOIN listed USING (doc_id)""",
    "op4_mixing": rf"""
    WITH sized AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5('mix' || doc_id::VARCHAR) AS key FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
    r AS (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio,
      coalesce(sum(3 * source_size) OVER o, 0) AS caps, coalesce(sum(weight) OVER o, 0) AS weights FROM w
      WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT *, ((SELECT sum(source_size) FROM w) - caps)::DOUBLE / ((SELECT sum(weight) FROM w) - weights)::DOUBLE AS level FROM r),
    f AS (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, source NULLS LAST LIMIT 1),
    t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, (SELECT level FROM f) * weight) AS target FROM w),
    p AS (SELECT d.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE
      (floor(target)::BIGINT // source_size) * size + greatest(0, least(size, floor(target)::BIGINT % source_size - before)) END::BIGINT AS taken
    FROM p""",
    "op7_embeddings": """
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
    reach AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT node, l.b FROM reach JOIN l ON seen = l.a),
    c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
    n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id""",
    "op8_substring": rf"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM d WHERE len(w) >= 20),
    h AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g FROM win),
    rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS n FROM h) WHERE n > 1),
    gone AS (SELECT DISTINCT doc_id, s + k AS pos FROM rep, range(0, 20) AS r(k)),
    word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)""",
    "op9_exact": """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    g AS (SELECT text, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY text)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM d JOIN g USING (text)""",
    "op10_licences": _licence_sql(),
}
