"""Embedding near-duplicates through a pivot-permutation index.

Each vector is described by its nearest reference points, in order. Inverted lists hold the vectors that name a pivot;
two vectors become a candidate pair by the number of pivots they share, and the pair is verified by its cosine in the
list of its least shared pivot, so that each is counted once. Long lists are cut into tiles of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import FloatType

from corpusloom.operators.components import connected_components
from corpusloom.operators.rows import keyed_rows
from corpusloom.runtime import discard, materialize


MOST_PIVOTS = 4096


def _matrix(column, kind) -> np.ndarray:
    return np.stack([np.frombuffer(v, dtype=kind).astype(np.float64) for v in column])


def valid_vectors(rows: DataFrame, vector_col: str) -> DataFrame:
    """row, v for vectors that can link: not null or empty, all components finite, length above zero."""
    v = F.col(f"doc.`{vector_col}`").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return rows.select("row", v.alias("v")).where(F.coalesce(fine, F.lit(False)))


def pivots_for(n: int) -> int:
    """Reference points for n different vectors: they grow with the root of n, so lists and comparisons grow slower than the table's square."""
    return min(MOST_PIVOTS, max(512, int(2 * n**0.5)))


def choose_pivots(distinct: DataFrame, pivots: int, cosine: float, named: int, apart: float = 0.7, sample: int = 2 * MOST_PIVOTS) -> dict[int, np.ndarray]:
    """Reference points by dimension: at most ``pivots`` of a sample of at most ``sample`` distinct vectors, by hash of the id.

    In that order, a vector becomes a pivot if its cosine with those before is below ``apart``. A large group of near
    copies so gets few pivots, and its members agree on their nearest ones; with pivots from its midst they would not.
    Where this leaves fewer than eight for each one named, as in a narrow cone, the bound is the linking ``cosine``.
    """
    rows = distinct.select("node", "v").orderBy(F.xxhash64("node"), "node").limit(sample).collect()
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(len(r["v"]), []).append(np.array(r["v"]) / np.linalg.norm(r["v"]))

    def spread(points: list, bound: float) -> np.ndarray:
        chosen = np.empty((min(pivots, len(points)), len(points[0])))
        n = 0
        for x in points:
            if n < len(chosen) and (n == 0 or (chosen[:n] @ x).max() < bound):
                chosen[n], n = x, n + 1
        return chosen[:n]

    found = {}
    for width, points in out.items():
        found[width] = spread(points, min(apart, cosine))
        if len(found[width]) < min(pivots, 8 * named):
            found[width] = spread(points, cosine)
    return found


def _describe(pivots: dict[int, np.ndarray], named: int, kind: str):
    """Vectors to one row for each pivot they name: list, vector, its weight and its ordered pivots."""

    def run(batches):
        for batch in batches:
            ids, weights = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values = batch.column(2)
            lengths = np.diff(values.offsets.to_numpy())
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                x = np.stack([values[int(i)].values.to_numpy() for i in at])
                points = pivots.get(n)
                if points is None:  # no reference point of this dimension: one list, cut into tiles like any other
                    near = np.full((len(at), 1), -n, dtype=np.int32)
                else:
                    near = np.argsort(-((x / np.linalg.norm(x, axis=1, keepdims=True)) @ points.T), axis=1, kind="stable")[:, :named].astype(np.int32)
                    near += MOST_PIVOTS * n  # pivots of one dimension never meet those of another
                k = near.shape[1]
                raw = [r.tobytes() for r in x.astype(kind)]
                order = [r.tobytes() for r in near]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(near.ravel(), pa.int32()),
                        pa.array(np.repeat(ids[at], k), pa.int64()),
                        pa.array(np.repeat(weights[at], k), pa.int64()),
                        pa.array([o for o in order for _ in range(k)], pa.binary()),
                        pa.array([r for r in raw for _ in range(k)], pa.binary()),
                    ],
                    names=["pivot", "node", "copies", "named", "raw"],
                )

    return run


def _tile(shared: int, cosine: float, kind: str):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pivot, low, high = key
        ids, copies, block = (pdf[c].to_numpy() for c in ("node", "copies", "block"))
        order = np.argsort(ids, kind="stable")
        ids, copies, block = ids[order], copies[order], block[order]
        x = _matrix(pdf["raw"].iloc[order], kind)
        norms = np.sqrt((x * x).sum(axis=1))
        names = np.stack([np.frombuffer(b, dtype=np.int32) for b in pdf["named"].iloc[order]])
        local, inverse = np.unique(names, return_inverse=True)
        held = np.zeros((len(ids), len(local)), dtype=np.float32)
        held[np.arange(len(ids))[:, None], inverse.reshape(names.shape)] = 1
        before = held[:, : int(np.searchsorted(local, pivot))]
        a = np.flatnonzero(block == low)
        b = a if low == high else np.flatnonzero(block == high)
        if not len(a) or not len(b):
            return pd.DataFrame({"node": [], "links": [], "other": []})
        least = min(shared, names.shape[1])
        candidates = held[a] @ held[b].T >= least
        candidates &= (before[a] @ before[b].T) == 0
        linked = candidates & ((x[a] @ x[b].T) / np.outer(norms[a], norms[b]) >= cosine)
        if low == high:
            np.fill_diagonal(linked, False)
            links = linked @ copies[b]
            out_ids, out_links = ids[a], links
        else:
            out_ids, out_links = np.concatenate((ids[a], ids[b])), np.concatenate((linked @ copies[b], linked.T @ copies[a]))
        some = out_links > 0
        # a spanning forest of what is linked: breadth first, each row read once
        n = len(a)
        edges, unseen_a, unseen_b = [], np.ones(n, dtype=bool), np.ones(len(b), dtype=bool)
        for root in np.flatnonzero(linked.any(axis=1)).tolist():
            if not unseen_a[root]:
                continue
            unseen_a[root] = False
            if low == high:
                unseen_b[root] = False
            front = [(0, root)]
            while front:
                side, at = front.pop()
                if side == 0:
                    near = np.flatnonzero(linked[at] & unseen_b)
                    unseen_b[near] = False
                    if low == high:
                        unseen_a[near] = False
                    edges += [(ids[a[at]], ids[b[j]]) for j in near.tolist()]
                    front += [(0 if low == high else 1, j) for j in near.tolist()]
                else:
                    near = np.flatnonzero(linked[:, at] & unseen_a)
                    unseen_a[near] = False
                    edges += [(ids[b[at]], ids[a[j]]) for j in near.tolist()]
                    front += [(0, j) for j in near.tolist()]
        src = np.concatenate((out_ids[some], np.array([e[0] for e in edges], dtype=np.int64)))
        links = np.concatenate((out_links[some], np.zeros(len(edges), dtype=np.int64)))
        other = np.concatenate((np.full(int(some.sum()), -1), np.array([e[1] for e in edges], dtype=np.int64)))
        flag = np.concatenate((np.zeros(int(some.sum()), dtype=bool), np.ones(len(edges), dtype=bool)))
        return pd.DataFrame({"node": src, "links": links, "other": pd.array(other, dtype="Int64").copy()}).assign(
            other=lambda d: d["other"].where(flag)
        )

    return run


def embedding_groups(
    vectors: DataFrame, cosine: float = 0.9, pivots: int | None = None, named: int = 8, shared: int = 2, tile: int = 1500, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id (smallest id reachable), kept.

    Pairs found that share at least ``shared`` of their ``named`` nearest pivots link from ``cosine`` on, in double
    precision. Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
    different lengths never link. Equal vectors are one node of the index and count as links of each other. Rows that share
    an id are vectors of their own that link like others; of a component, the first row in the order of
    :func:`corpusloom.operators.rows.keyed_rows` is kept (a row without an id comes last, and its component, if it has no
    other, is null). An empty table gives an empty result; further columns are ignored. The index is fitted on a sample of
    at most 8,192 vectors (see :func:`choose_pivots`) and holds every vector; without ``pivots``, :func:`pivots_for` says how
    many there are, at most 4,096. A list longer than ``tile`` is compared tile by tile.
    """
    if pivots is not None and pivots > MOST_PIVOTS:
        raise ValueError(f"at most {MOST_PIVOTS} pivots")
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "<f8"
    rows = keyed_rows(vectors.select(id_col, vector_col), id_col)
    fine = valid_vectors(rows, vector_col).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64("v", F.lit(1))})
    # equal vectors are told by a digest: only one of each is shuffled further
    members = materialize(fine.groupBy("h1", "h2").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min_by("v", "row").alias("v")))
    points = choose_pivots(members, pivots or pivots_for(members.count()), cosine, named)
    listed = materialize(
        members.select("node", "copies", "v").mapInArrow(_describe(points, named, kind), "pivot int, node long, copies long, named binary, raw binary")
    )
    sizes = listed.groupBy("pivot").count().select("pivot", F.ceil(F.col("count") / tile).cast("int").alias("blocks"))
    dealt = listed.join(F.broadcast(sizes), "pivot").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tiled = dealt.withColumn("mate", F.explode_outer(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "pivot", F.least("block", "mate").alias("low"), F.greatest("block", "mate").alias("high"), "block", "node", "copies", "named", "raw"
    )
    found = materialize(tiled.groupBy("pivot", "low", "high").applyInPandas(_tile(shared, cosine, kind), "node long, links long, other long"))
    discard(listed)
    links = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("other IS NOT NULL").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    nodes = (
        members.select("h1", "h2", "node", "copies")
        .join(links, "node", "left")
        .join(groups, "node", "left")
        .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("head"))
    )
    linked = fine.select("row", "h1", "h2").join(nodes, ["h1", "h2"]).select("row", "n_links", "head")
    id_of = F.col(f"doc.`{id_col}`").cast("long")
    heads = rows.select(F.col("row").alias("head"), id_of.alias("component_id"))
    everyone = rows.select("row", id_of.alias("vec_id")).join(linked, "row", "left").withColumn("head", F.coalesce("head", "row"))
    return everyone.join(heads, "head").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", (F.col("head") == F.col("row")).alias("kept"))
