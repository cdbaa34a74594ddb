"""SimHash near-duplicates over deletion-variant signatures.

Two fingerprints within four bits, cut into three segments, must agree in one of them up to a single bit. Each
fingerprint is indexed under every one-wildcard variant of every segment (64 keys); equal keys meet and are verified.
A key's fingerprints yield the edges of a spanning forest, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.components import connected_components
from corpusloom.operators.rows import keyed_rows
from corpusloom.runtime import materialize

SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit, width
CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The 64-bit SimHash of a UTF-8 text: word shingles under XXH64 (seed 42), a bit set where over half have it."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: n - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(rows: DataFrame, shingle: int = 4, text_col: str = "text") -> DataFrame:
    """row, fp (the 64 bits as a signed long). Null text counts as empty."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            made = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["row", "fp"])

    return rows.select("row", F.col(f"doc.`{text_col}`").alias("text")).mapInArrow(run, "row long, fp long")


def _variants(prints: DataFrame) -> DataFrame:
    """key, fp, rep: one row for each bit taken as the wildcard of its segment."""
    bit = F.explode_outer(F.sequence(F.lit(0), F.lit(63))).alias("bit")
    low = "CASE WHEN bit < 21 THEN 0 WHEN bit < 42 THEN 21 ELSE 42 END"
    mask = "CASE WHEN bit < 42 THEN 2097151L ELSE 4194303L END"
    segment = f"(shiftrightunsigned(fp, {low}) & ({mask}) & ~shiftleft(1L, bit - ({low})))"
    return prints.select("fp", "rep", bit).select(F.expr(f"shiftleft(cast(bit AS bigint), 22) | {segment}").alias("key"), "fp", "rep")


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _forest(values: np.ndarray, bound: int, members: np.ndarray, sets: _Union):
    """Breadth first over the members: each one reached is compared only with those not yet reached."""
    rest = members
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(values[rest] ^ values[at]) <= bound
            reached, rest = rest[near], rest[~near]
            for other in reached.tolist():
                if sets.join(int(at), other):
                    yield int(at), other
            front.extend(reached.tolist())


def group_edges(bit: int, values: np.ndarray, bound: int) -> list[tuple[int, int]]:
    """Index pairs that connect what is within ``bound`` bits among the fingerprints of one key.

    Fingerprints with equal segments meet under every wildcard of the segment, so these edges are given only under its
    first bit; under the others, only edges that the wildcard is needed for and that connect something new.
    """
    sets, everyone = _Union(len(values)), np.arange(len(values))
    side = (values >> np.uint64(bit)) & np.uint64(1) == 1
    equal = [e for half in (everyone[side], everyone[~side]) for e in _forest(values, bound, half, sets)]
    across = list(_forest(values, bound, everyone, sets)) if side.any() and not side.all() else []
    return across + (equal if bit in (0, 21, 42) else [])


def _linked(bound: int):
    def flush(keys, fps, reps):
        edges = np.flatnonzero(np.diff(keys)) + 1
        starts = np.concatenate(([0], edges))
        sizes = np.diff(np.concatenate((starts, [len(keys)])))
        src, dst = [], []
        two = starts[sizes == 2]
        if len(two):
            bits, apart = (keys[two] >> 22), fps[two] ^ fps[two + 1]
            wild = (apart >> bits.astype(np.uint64)) & np.uint64(1) == 1
            good = two[(np.bitwise_count(apart) <= bound) & (wild | np.isin(bits, (0, 21, 42)))]
            src, dst = reps[good].tolist(), reps[good + 1].tolist()
        for at in np.flatnonzero(sizes > 2).tolist():
            a, n = starts[at], sizes[at]
            for i, j in group_edges(int(keys[a] >> 22), fps[a : a + n], bound):
                src.append(int(reps[a + i]))
                dst.append(int(reps[a + j]))
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if not len(new[0]):
                continue
            held.append(new)
            if held[0][0][0] == new[0][-1]:
                continue  # still the same key
            keys, fps, reps = (np.concatenate([h[i] for h in held]) for i in range(3))
            cut = int(np.searchsorted(keys, keys[-1]))
            yield flush(keys[:cut], fps[:cut].view(np.uint64), reps[:cut])
            held = [[keys[cut:], fps[cut:], reps[cut:]]]
        if held:
            keys, fps, reps = (np.concatenate([h[i] for h in held]) for i in range(3))
            yield flush(keys, fps.view(np.uint64), reps)

    return run


def _grouped(rows: DataFrame, bits: int, shingle: int, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(prints, named): row, fp of every row; fp and the smallest row of its component for every fingerprint."""
    if not 0 <= bits <= 4:
        raise ValueError("bits must be 0 to 4")
    prints = materialize(fingerprints(rows, shingle, text_col))
    nodes = materialize(prints.groupBy("fp").agg(F.min("row").alias("rep")))
    edges = _variants(nodes).repartition("key").sortWithinPartitions("key").mapInArrow(_linked(bits), "src long, dst long")
    groups = connected_components(edges)
    named = nodes.join(groups, nodes["rep"] == groups["node"], "left").select("fp", F.coalesce("component", "rep").alias("head"))
    return prints, materialize(named)


def simhash_groups(docs: DataFrame, bits: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Texts without words (null, empty, white space) have fingerprint zero and are linked like any other; texts of any
    length are read whole. Equal fingerprints are one node of the index however many documents share them. Rows that share
    an id are documents of their own; rows without one count as the largest ids (a component of such rows has a null).
    An empty table gives an empty result; further columns are ignored. ``bits`` may be at most 4: the three segments are
    made for that.
    """
    rows = keyed_rows(docs.select(id_col, text_col), id_col)
    prints, named = _grouped(rows, bits, shingle, text_col)
    ids = rows.select("row", F.col(f"doc.`{id_col}`").cast("long").alias("doc_id"))
    # the id of a component is looked up once for each fingerprint, not for each document
    headed = named.join(ids.select(F.col("row").alias("head"), F.col("doc_id").alias("component_id")), "head").select("fp", "component_id")
    return prints.join(headed, "fp").join(ids, "row").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, bits: int = 4, shingle: int = 4) -> DataFrame:
    """``docs`` with one document of each group, the one of the smallest doc_id; its columns are unchanged.

    Rows that share an id are documents of their own, and one of them stays at most where they are alike; rows without an
    id count as the largest. Null and empty texts form one group. Further columns, whatever their names, are carried; an
    empty table gives an empty table.
    """
    rows = keyed_rows(docs, "doc_id")
    named = _grouped(rows, bits, shingle, "text")[1]
    return rows.join(named.select(F.col("head").alias("row")).distinct(), "row", "left_semi").select("doc.*")
