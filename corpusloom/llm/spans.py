"""Substring de-duplication: documents streamed past suffix automata of reference shards.

A window is a run of consecutive words of fixed length. Streaming every document past every shard would cost documents
times shards, so windows are routed: a window's minimizer, the least hash among its word k-grams, names the one shard that
can hold its equals. Consecutive windows with one minimizer are a passage. Passages whose minimizer nothing else has repeat
nothing; the different ones of all others, each with its earliest place, are the reference. They are dealt into shards of
bounded size. In a shard, the passages are streamed in the order of their places past the suffix automaton of those before,
whose suffix link after each word is the matching statistic; spans where it reaches the window length repeat what
stands earlier. Every later copy of a passage repeats all of it: that is its statistic against a shard that holds it.

A frequent k-gram in ever new surroundings would make one minimizer hold more than a shard: its passages are cut again
by longer k-grams, at last window by window, where nothing but copies of one window can meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.rows import keyed_rows
from corpusloom.runtime import discard, materialize

GRAM, LONGER_GRAM = 8, 16  # words of a minimizer's k-gram; of that of a minimizer with too many passages
CHUNK = 1 << 20  # bytes of text hashed at once
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240).integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


_POW = _powers(CHUNK + 2, _BASE)
_INV = _powers(CHUNK + 2, np.uint64(pow(int(_BASE), -1, 1 << 64)))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) in bytes of the runs of anything but ASCII white space."""
    blank = np.concatenate(([True], _SPACE[np.frombuffer(text, dtype=np.uint8)], [True]))
    turns = np.flatnonzero(blank[1:] != blank[:-1])
    return turns[::2], turns[1::2]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text; long texts are hashed in chunks cut between words."""
    starts, ends = word_bounds(text)
    out = np.empty(len(starts), dtype=np.uint64)
    data = np.frombuffer(text, dtype=np.uint8)
    at = 0
    while at < len(starts):
        base = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        a, b = starts[at:upto] - base, ends[at:upto] - base
        n = int(b[-1])
        if n <= CHUNK:
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE[data[base : base + n]] * _POW[:n], out=sums[1:])
            out[at:upto] = _mixed((sums[b] - sums[a]) * _INV[a] + (b - a).astype(np.uint64))
        else:  # one word longer than a chunk
            out[at] = int.from_bytes(hashlib.blake2b(text[base : base + n], digest_size=8).digest(), "little")
        at = upto
    return out


def _rolled(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words."""
    n = len(words) - length + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(length):
        out = out * _BASE + words[i : i + n]
    return _mixed(out)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[: len(values) - span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def passages(words: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, content hash, first window, number of windows) of each passage of a document; the number is negative
    for a passage that may repeat windows of its own. With a k-gram as long as a window, each window is a passage."""
    if len(words) < window:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    gram = min(gram, window)
    grams, width = _rolled(words, gram), window - gram + 1
    least = _sliding_min(grams, width)
    if width == 1:
        return least, grams, np.arange(len(grams)), np.ones(len(grams), dtype=np.int64)
    first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    count = np.diff(np.concatenate((first, [len(least)])))
    # content: differences of a running polynomial over the whole document, brought to the same power
    power, inverse = _POW, _INV
    if len(words) + 1 > len(power):
        power, inverse = _powers(len(words) + 1, _BASE), _powers(len(words) + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * power[: len(words)], out=sums[1:])
    content = _mixed((sums[first + count + window - 1] - sums[first]) * inverse[first] + count.astype(np.uint64))
    # a passage may repeat a window of its own only if its minimizer stands in it more than once
    held = sum((grams[t : t + len(least)] == least).astype(np.int8) for t in range(width))
    own = (np.maximum.reduceat(held, first) > 1) | (count > width)
    return least[first], content, first, np.where(own, -count, count)


OCCURRENCES = "key long, content long, windows int, row long, start int"


def _cut(window: int):
    """Documents to their passages."""

    def run(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).cast(pa.binary())
            parts, held = [], 0
            for row, text in zip(rows.tolist(), texts):
                least, content, first, count = passages(word_hashes(text.as_py() or b""), window)
                if len(least):
                    parts.append((least, content, count, np.full(len(least), row), first))
                    held += len(least)
                if held > 200_000:
                    yield _occurrences(parts)
                    parts, held = [], 0
            if parts:
                yield _occurrences(parts)

    return run


def _occurrences(parts) -> pa.RecordBatch:
    key, content, count, rows, first = (np.concatenate(x) for x in zip(*parts))
    columns = [key.view(np.int64), content.view(np.int64), count.astype(np.int32), rows, first.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "content", "windows", "row", "start"])


class SuffixAutomaton:
    """A suffix automaton of many word sequences that tells, word by word, how long a suffix was seen before."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def extend(self, last: int, word) -> tuple[int, int]:
        """(state, matching statistic) after the word; the statistic counts what ended at any earlier place."""
        follow, link, length = self.next, self.link, self.length
        known = follow[last].get(word)
        if known is not None and length[known] == length[last] + 1:
            return known, length[known]
        if known is not None:
            return self._split(last, word, known), length[last] + 1
        state = len(length)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and word not in follow[at]:
            follow[at][word] = state
            at = link[at]
        if at != -1:
            target = follow[at][word]
            link[state] = target if length[target] == length[at] + 1 else self._split(at, word, target)
        return state, length[link[state]]

    def _split(self, at: int, word, target: int) -> int:
        follow, link, length = self.next, self.link, self.length
        clone = len(length)
        follow.append(dict(follow[target]))
        length.append(length[at] + 1)
        link.append(link[target])
        link[target] = clone
        while at != -1 and follow[at].get(word) == target:
            follow[at][word] = clone
            at = link[at]
        return clone


def repeated_windows(sequences: list[list], window: int) -> list[list[int]]:
    """For each sequence, in order, the starts of its windows that also start earlier, in it or in one before it."""
    automaton, found = SuffixAutomaton(), []
    for words in sequences:
        state, starts = 0, []
        for i, word in enumerate(words):
            state, seen = automaton.extend(state, word)
            if seen >= window:
                starts.append(i - window + 1)
        found.append(starts)
    return found


def _fetch(window: int):
    """Documents with the passages wanted of them to the words (as hashes) of these passages."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for row, text, wanted in zip(batch.column(0).to_pylist(), texts, batch.column(2)):
                words, asked = word_hashes(text.as_py() or b""), wanted.as_py()
                made = [words[w["start"] : w["start"] + abs(w["windows"]) + window - 1].tobytes() for w in asked]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([w["key"] for w in asked], pa.int64()),
                        pa.array([w["content"] for w in asked], pa.int64()),
                        pa.array([w["windows"] for w in asked], pa.int32()),
                        pa.array([row] * len(asked), pa.int64()),
                        pa.array([w["start"] for w in asked], pa.int32()),
                        pa.array(made, pa.binary()),
                    ],
                    names=["key", "content", "windows", "row", "start", "words"],
                )

    return run


PARTS = "key long, content long, windows int, key2 long, content2 long, windows2 int, skip int, words2 binary"


def _finer(window: int, gram: int):
    """Passages to their parts under the minimizers of longer k-grams."""

    def run(batches):
        for batch in batches:
            for key, content, windows, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = np.frombuffer(data, dtype=np.uint64)
                key2, content2, skip, count = passages(words, window, gram)
                n = len(key2)
                made = [words[s : s + abs(c) + window - 1].tobytes() for s, c in zip(skip.tolist(), count.tolist())]
                columns = [np.full(n, key), np.full(n, content), np.full(n, windows, dtype=np.int32), _mixed(key2 + np.uint64(gram)).view(np.int64), content2.view(np.int64)]
                columns += [count.astype(np.int32), skip.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(made, pa.binary())], names=[c.split(" ")[0] for c in PARTS.split(", ")])

    return run


def _streamed(window: int):
    """Passages by shard and place to the runs of their windows (skip, number) that stand earlier."""
    kind = pa.list_(pa.struct([("skip", pa.int32()), ("n", pa.int32())]))

    def run(batches):
        shard, automaton = None, None
        for batch in batches:
            out = []
            for key, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != shard:
                    shard, automaton = key, SuffixAutomaton()
                state, since, i, found = 0, None, 0, []
                for i, word in enumerate(np.frombuffer(words, dtype=np.uint64).tolist()):
                    state, seen = automaton.extend(state, word)
                    if seen >= window:
                        since = i - window + 1 if since is None else since
                    elif since is not None:
                        found.append({"skip": since, "n": i - window + 1 - since})
                        since = None
                if since is not None:
                    found.append({"skip": since, "n": i - window + 2 - since})
                out.append(found)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(2, 7)), pa.array(out, kind)], names=["key", "content", "windows", "row", "start", "runs"])

    return run


SAME = ["key", "content", "windows"]


def _live(met: DataFrame) -> DataFrame:
    """Occurrences whose minimizer others have, too, or that may repeat windows of their own."""
    keys = met.groupBy("key").agg(F.count("*").alias("n"), F.min("windows").alias("least")).where("n > 1 OR least < 0").select("key")
    return met.join(keys, "key", "left_semi")


def _firsts(met: DataFrame) -> DataFrame:
    """Each different passage at its earliest place; copies are counted together before they are shuffled."""
    return met.groupBy(*SAME).agg(F.min(F.struct("row", "start")).alias("at")).select(*SAME, "at.row", "at.start")


def repeated_spans(rows: DataFrame, window: int, per_shard: int = 200_000) -> DataFrame:
    """(row, start, windows): runs of windows of each row of (row, text) that also start earlier.

    A shard holds about ``per_shard`` words, at most twice as many; its automaton takes some 600 bytes a word. A minimizer
    whose passages hold more than that is cut again.
    """
    met = materialize(rows.mapInArrow(_cut(window), OCCURRENCES))
    live = materialize(_live(met))
    discard(met)
    wanted = _firsts(live).groupBy("row").agg(F.collect_list(F.struct(*SAME, "start")).alias("wanted"))
    reference = materialize(rows.join(wanted, "row").select("row", "text", "wanted").mapInArrow(_fetch(window), f"{OCCURRENCES}, words binary"))
    for gram in (min(LONGER_GRAM, window), window):
        hot = materialize(reference.groupBy("key").agg(F.sum(F.length("words") / 8).alias("n")).where(F.col("n") > per_shard).select("key"))
        if hot.isEmpty():
            break
        parts = materialize(reference.join(hot, "key", "left_semi").select(*SAME, "words").mapInArrow(_finer(window, gram), PARTS))
        again = live.join(parts.drop("words2"), SAME).select(F.col("key2").alias("key"), F.col("content2").alias("content"), F.col("windows2").alias("windows"), "row", (F.col("start") + F.col("skip")).alias("start"))
        again = materialize(_live(again))
        words = parts.select(F.col("key2").alias("key"), F.col("content2").alias("content"), F.col("windows2").alias("windows"), "words2").groupBy(*SAME).agg(F.first("words2").alias("words"))
        live = live.join(hot, "key", "left_anti").unionByName(again)
        cut = materialize(reference.join(hot, "key", "left_anti").unionByName(_firsts(again).join(words, SAME)))
        discard(reference, parts)
        reference = cut
    held = reference.agg(F.coalesce(F.sum(F.length("words") / 8), F.lit(0))).first()[0]
    shard = F.pmod(F.xxhash64("key"), F.lit(max(1, int(held // per_shard)))).alias("shard")
    sharded = reference.select(shard, "words", *SAME, "row", "start").repartition("shard").sortWithinPartitions("shard", "row", "start")
    matched = materialize(sharded.mapInArrow(_streamed(window), f"{OCCURRENCES}, runs array<struct<skip:int,n:int>>"))
    first = matched.select(*SAME, F.struct("row", "start").alias("first"), "runs")
    whole = F.expr("array(named_struct('skip', 0, 'n', abs(windows)))")
    spans = live.join(first, SAME).select("row", "start", F.explode_outer(F.when(F.struct("row", "start") == F.col("first"), F.col("runs")).otherwise(whole)).alias("x"))
    out = materialize(spans.where("x IS NOT NULL").select("row", (F.col("start") + F.col("x.skip")).alias("start"), F.col("x.n").alias("windows")))
    discard(reference, matched)
    return out


def _kept(window: int):
    def run(batches):
        for batch in batches:
            out = []
            texts = batch.column(1).cast(pa.binary())
            for doc, text, spans in zip(batch.column(0).to_pylist(), texts, batch.column(2)):
                words = (text.as_py() or b"").split()
                gone = np.zeros(len(words) + 1, dtype=np.int32)
                for s in spans.as_py() or ():
                    gone[s["start"]] += 1
                    gone[s["start"] + s["windows"] + window - 1] -= 1
                keep = np.cumsum(gone[:-1]) == 0
                kept = b" ".join([w for w, k in zip(words, keep.tolist()) if k]) if not keep.all() else b" ".join(words)
                out.append((doc, len(words), len(words) - int(keep.sum()), kept.decode("utf-8")))
            doc, n, removed, kept = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return run


def substring_dedup(docs: DataFrame, window: int = 20, per_shard: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if a window over it, a run of ``window`` consecutive words, also starts earlier: in a document of a
    smaller doc_id, or earlier in the same one. Windows are judged on the input. Null and empty texts have no words; texts
    shorter than a window lose nothing; an empty table gives an empty result; further columns are ignored. Rows that share an
    id or have none are documents of their own, in the order of :func:`corpusloom.operators.rows.keyed_rows` (null ids
    last): of equal rows, one keeps its words. Words are compared by 64-bit hashes, windows by the hashes of all their words.
    """
    rows = keyed_rows(docs.select(id_col, text_col), id_col).select("row", F.col(f"doc.`{id_col}`").cast("long").alias("doc_id"), F.col(f"doc.`{text_col}`").alias("text"))
    spans = repeated_spans(rows.select("row", "text"), window, per_shard).groupBy("row").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    joined = rows.join(spans, "row", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept_text string")
