"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Words and, for words that training saw too seldom, their prefixes get signed log-odds between toxic and clean training
texts under an informative Dirichlet prior, drawn towards zero by their own variance; contexts that repeat, as in copies,
count once. Every token also pays a small cost, so that clean text drifts down. A linear-time scan finds every maximal
scoring segment of a text. Segment scores are put on the scale of chance: lambda (Karlin and Altschul) solves the equation of
the clean tokens' scores, K is fitted to the best segments of clean training texts. Several segments are judged together by
their sum statistic, and a logistic curve fitted on the training rows turns that into a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import discard, materialize

PREFIXES = (4, 5, 6)
EDGES = b".,;:!?|\"'()[]{}<>*-"
CACHE = 400_000
BEST = 50  # segments of a training text that the calibration looks at, best first


def tokens(text: bytes) -> list[bytes]:
    return [w for w in (w.strip(EDGES) for w in text.lower().split()) if w]


def parts(word: str) -> list[str]:
    """The word and its prefixes, longest first, the latter marked so as not to mix with words."""
    return [word, *(word[:n] + "*" for n in sorted(PREFIXES, reverse=True) if len(word) > n)]


@dataclass
class Model:
    scores: dict[str, float]  # log-odds of words and prefixes
    cost: float  # what every token pays
    scale: float  # lambda of the extreme-value distribution
    log_k: float = 0.0  # logarithm of its K
    weight: float = 1.0
    bias: float = 0.0

    def evidence(self, x: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, self.weight * math.log1p(x) + self.bias))))


def maximal_segments(values: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of a sequence, in one pass: candidates are kept with the running
    totals at both ends; a new one absorbs those that it extends."""
    total, found = 0.0, []  # of (first, end, total before, total after)
    for i, value in enumerate(values):
        before, total = total, total + value
        if value <= 0:
            continue
        first, low = i, before
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= total:
                found.append((first, i + 1, low, total))
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after in found]


def toxic_passages(text: bytes, model: Model, cache: dict | None = None) -> tuple[list[tuple[int, int, float]], int]:
    """(first token, end token, score) of every maximal segment, and the number of tokens.

    A token's score is that of the word or else of its longest known prefix, less the cost. Tokens in a row that speak
    against toxicity enter the scan as one value, so its length is that of the others.
    """
    cache = {} if cache is None else cache
    words, scores, cost = tokens(text), model.scores, model.cost
    values, spots, run = [], [], 0.0
    for i, word in enumerate(words):
        score = cache.get(word)
        if score is None:
            if len(cache) > CACHE:
                cache.clear()
            score = cache[word] = next((s for s in map(scores.get, parts(word.decode("utf-8", "replace"))) if s is not None), 0.0) - cost
        if score > 0:
            if run:
                values.append(run)
                spots.append(i)
                run = 0.0
            values.append(score)
            spots.append(i)
        else:
            run += score
    return [(spots[a], spots[b - 1] + 1, s) for a, b, s in maximal_segments(values)], len(words)


def surprise(segments: list[tuple[int, int, float]], length: int, model: Model) -> float:
    """Minus the logarithm of the chance of the best r segments together, for the r that is least likely; 0 if none."""
    best, total, log_n = 0.0, 0.0, max(0.0, model.log_k + math.log(max(2, length)))
    for r, s in enumerate(sorted((s for *_, s in segments), reverse=True), 1):
        total += model.scale * s - log_n
        if total <= 0:
            break
        best = max(best, total - (r - 1) * math.log(total + 1) + math.lgamma(r + 1) + math.lgamma(r))
    return best


def _held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, max_train: int = 12_000, prior: float = 0.1, least: int = 4, spread: float = 3.0, cost: float = 1.5) -> Model:
    """Fit on at most ``max_train`` labelled rows outside the held-out third (a bounded sample, by hash of the id).

    Counts are aggregated on the cluster. What reaches the driver is a number for each word and prefix that occurs in at least
    ``least`` contexts of the sample, and for each of its rows the best segments: both bounded by the sample. ``prior``: the
    prior's weight, as a share of the counts; ``spread``: the variance of log-odds that one expects between words. Without
    toxic or clean rows the model is empty.
    """
    sample = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")

    def contexts(batches):
        for batch in batches:
            for text, toxic in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist()):
                words = tokens(text.as_py() or b"")
                made = {
                    (w, xxhash.xxh64_intdigest(b" ".join(words[max(0, i - 2) : i + 3])) - (1 << 63)) for i, w in enumerate(words)
                }
                out = [w.decode("utf-8", "replace") for w, _ in made]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out, pa.string()), pa.array([c for _, c in made], pa.int64()), pa.array([toxic] * len(out), pa.int32())],
                    names=["word", "context", "toxic"],
                )

    words = materialize(rows.mapInArrow(contexts, "word string, context long, toxic int").distinct().groupBy("word", "toxic").count())
    starts = [F.when(F.length("word") > n, F.array(F.concat(F.substring("word", 1, n), F.lit("*")))).otherwise(F.array().cast("array<string>")) for n in PREFIXES]
    counted = (
        words.select(F.explode_outer(F.concat(F.array("word"), *starts)).alias("part"), "toxic", "count")
        .groupBy("part")
        .agg(F.sum(F.when(F.col("toxic") > 0, F.col("count")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(F.col("count"))).alias("b"))
    )
    sums = words.groupBy().agg(F.sum(F.when(F.col("toxic") > 0, F.col("count"))), F.sum(F.when(F.col("toxic") > 0, F.lit(None)).otherwise(F.col("count")))).first()
    if not sums[0] or not sums[1]:
        return Model({}, cost, 1.0)
    n1, n0 = float(sums[0]), float(sums[1])
    share = F.lit(prior) * (F.col("a") + F.col("b"))
    a, b = F.col("a") + share, F.col("b") + share
    rest1, rest0 = F.lit(n1 + prior * (n1 + n0)) - a, F.lit(n0 + prior * (n1 + n0)) - b
    odds = F.log(a / rest1) - F.log(b / rest0)
    found = counted.where(F.col("a") + F.col("b") >= least).select("part", "b", (odds * spread / (spread + 1 / a + 1 / b)).alias("score")).collect()
    discard(words)
    model = Model({r["part"]: r["score"] for r in found}, cost, _scale([(r["score"] - cost, r["b"]) for r in found if not r["part"].endswith("*")], n0, cost))

    def best_of(batches):
        cache: dict = {}
        for batch in batches:
            scanned = [toxic_passages(t.as_py() or b"", model, cache) for t in batch.column(0).cast(pa.binary())]
            kept = [sorted((s for *_, s in segments), reverse=True)[:BEST] for segments, _ in scanned]
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept, pa.list_(pa.float64())), pa.array([n for _, n in scanned], pa.int64()), batch.column(1)], names=["scores", "n", "toxic"]
            )

    pairs = sorted((p["toxic"] > 0, p["n"], p["scores"]) for p in rows.mapInArrow(best_of, "scores array<double>, n long, toxic int").collect())  # rows arrive in any order
    clean = [model.scale * s[0] - math.log(max(2, n)) for toxic, n, s in pairs if not toxic and s]
    if clean:  # the mean of the extreme-value law is log(K n) + Euler's constant
        model.log_k = float(np.mean(clean)) - 0.5772156649
    x = np.array([surprise([(0, 0, s) for s in scores], n, model) for _, n, scores in pairs])
    model.weight, model.bias = _logistic(np.log1p(x), np.array([float(toxic) for toxic, _, _ in pairs]))
    return model


def _scale(clean: list[tuple[float, float]], total: float, cost: float) -> float:
    """The positive root of sum p exp(lambda s) = 1 over the scores of clean tokens; words without a score pay the cost."""
    s, p = np.array([x for x, _ in clean]), np.array([(x + 0.5) / total for _, x in clean])
    if not len(s) or s.max() <= 0:
        return 1.0
    rest = max(0.0, 1 - p.sum())
    p = p / (p.sum() + rest)
    low, high = 1e-6, 50.0 / s.max()
    for _ in range(200):
        mid = (low + high) / 2
        if (p * np.exp(mid * s)).sum() + rest * math.exp(-mid * cost) < 1:
            low = mid
        else:
            high = mid
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Weight and bias of a one-dimensional logistic regression, slightly damped so that separable data stay finite."""
    w, b = 0.1, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(w * x + b, -40, 40)))
        g = np.array([((p - y) * x).sum() + 0.01 * w, (p - y).sum() + 0.01 * b])
        v = p * (1 - p)
        h = np.array([[(v * x * x).sum() + 0.01, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        w, b = w - step[0], b - step[1]
    return float(max(w, 1e-6)), float(b)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 from ``threshold``), passages (start and end token, score).

    Null, empty and white-space texts have no passages and the score of no evidence; very long texts are scanned whole;
    repeated rows each get a row; an empty table gives an empty result; further columns are ignored. An empty model
    gives every text the same score.
    """

    def run(batches):
        cache: dict = {}
        for batch in batches:
            scores, found = [], []
            for text in batch.column(1).cast(pa.binary()):
                segments, n = toxic_passages(text.as_py() or b"", model, cache)
                scores.append(model.evidence(surprise(segments, n, model)))
                found.append([{"first": a, "end": b, "score": s} for a, b, s in segments])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(found, kind)], names=["doc_id", "score", "passages"]
            )

    schema = "doc_id long, score double, passages array<struct<first:int,end:int,score:double>>"
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, passages for every document, by a model fitted on ``labels``."""
    scored = score_toxicity(docs, train(docs, labels, **options), threshold)
    return scored.select("doc_id", _held_out().alias("held_out"), "score", "predicted", "passages")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """``docs`` without the documents scored at ``threshold`` or more; the columns are unchanged.

    Null, empty and white-space texts have no passages and stay unless that alone speaks for toxicity; long texts are read
    whole; rows that share an id or have none are judged each by itself; further columns, whatever their names, are carried;
    an empty table gives an empty table, and without labels nothing goes.
    """
    model = train(docs, labels, **options)
    fields = docs.schema

    def run(batches):
        cache: dict = {}
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            keep = [model.evidence(surprise(*toxic_passages(t.as_py() or b"", model, cache), model)) < threshold for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, fields)
