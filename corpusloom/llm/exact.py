"""Exact de-duplication against a minimal perfect hash over historical distinct digests.

History is a given table of digests or, for a table by itself, the digests of its later half of rows: since the largest id
stays, what stands there wins over all that comes before. Its digests are dealt into shards. Each shard becomes one
minimal perfect hash: a displacement per bucket of keys sends every digest to its own slot, and the slot holds the full
digest and the locator of the winning row. Look-ups compare all 32 bytes, so a digest that was never built in is always
recognised as a stranger; repeats of history are removed, strangers are grouped among themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.rows import keyed_rows
from corpusloom.runtime import materialize

#: row and id of the winner (an id may be missing) and the copies that history counted.
SLOT = np.dtype([("digest", "<u8", 4), ("row", "<i8"), ("id", "<i8"), ("named", "?"), ("copies", "<i8")])
PER_BUCKET = 4


def _words(digests: np.ndarray) -> np.ndarray:
    """The four 64-bit words of each 32-byte digest."""
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def _slots(words: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (words[:, 1] ^ (seeds * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29)) ^ words[:, 2]) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(32))) % np.uint64(n)


def build_table(digests: list[bytes], winners: pd.DataFrame) -> tuple[bytes, bytes]:
    """(displacements, slots) of a minimal perfect hash over distinct 32-byte digests, with the row, id and copies of each."""
    n = len(digests)
    words = _words(digests)
    buckets = max(1, n // PER_BUCKET)
    home = (words[:, 0] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    counts = np.bincount(home, minlength=buckets)
    starts = np.concatenate(([0], np.cumsum(counts)))
    seeds = np.zeros(buckets, dtype=np.uint32)
    taken = np.zeros(n, dtype=bool)
    place = np.zeros(n, dtype=np.int64)
    for b in np.argsort(-counts, kind="stable"):
        members = order[starts[b] : starts[b + 1]]
        if not len(members):
            break
        own, first = words[members], 0
        while True:
            # 64 displacements at a time: the last buckets look for one of few free slots
            tries = np.arange(first, first + 64, dtype=np.uint64)
            at = np.stack([_slots(np.broadcast_to(w, (64, 4)), tries, n) for w in own], axis=1).astype(np.int64)
            free = ~taken[at].any(axis=1)
            if len(members) > 1:
                ordered = np.sort(at, axis=1)
                free &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            hits = np.flatnonzero(free)
            if len(hits):
                seeds[b] = first + hits[0]
                place[members] = at[hits[0]]
                taken[at[hits[0]]] = True
                break
            first += 64
    slots = np.zeros(n, dtype=SLOT)
    slots["digest"][place] = words
    slots["row"][place], slots["copies"][place] = winners["row"].fillna(0), winners["copies"]
    slots["id"][place], slots["named"][place] = winners["id"].fillna(0), winners["id"].notna()
    return seeds.tobytes(), slots.tobytes()


def look_up(digests: list[bytes], seeds: bytes, slots: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each digest or -1, all slots); known only where all 32 bytes agree."""
    table, shift = np.frombuffer(slots, dtype=SLOT), np.frombuffer(seeds, dtype=np.uint32)
    words = _words(digests)
    at = _slots(words, shift[(words[:, 0] % np.uint64(len(shift))).astype(np.int64)].astype(np.uint64), len(table)).astype(np.int64)
    return np.where((table["digest"][at] == words).all(axis=1), at, -1), table


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    seeds, slots = build_table(pdf["digest"].tolist(), pdf)
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "seeds": [seeds], "slots": [slots]})


FOUND = "row long, doc_id long, digest binary, shard int, slot long, winner long, keep_id long, copies long"


def _probe(rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
    names = [c.split(" ")[0] for c in FOUND.split(", ")]
    if rows.empty:
        return pd.DataFrame({c: [] for c in names})
    out = rows[["row", "doc_id", "digest", "shard"]].copy()
    if table.empty:
        slot, held = np.full(len(out), -1), np.zeros(1, dtype=SLOT)
    else:
        slot, held = look_up(rows["digest"].tolist(), bytes(table["seeds"].iloc[0]), bytes(table["slots"].iloc[0]))
    own = held[slot]
    known = slot >= 0
    for name, values, there in (("slot", slot, known), ("winner", own["row"], known), ("keep_id", own["id"], known & own["named"]), ("copies", own["copies"], known)):
        out[name] = pd.array(values.astype(np.int64), dtype="Int64").copy()
        out.loc[~there, name] = pd.NA
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out[names]


def known_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """digest, id, copies of a table's distinct texts: what :func:`exact_dedup` takes as history. The largest id wins."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest")
    return docs.select(F.col(id_col).cast("long").alias("id"), digest).groupBy("digest").agg(F.max("id").alias("id"), F.count("*").alias("copies"))


def exact_dedup(
    docs: DataFrame, history: DataFrame | None = None, per_shard: int = 50_000, per_task: int = 100_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``history``: digest, id, copies of texts known before (see :func:`known_digests`): rows that repeat one go, their
    keep_id is its id and their group_size counts the copies there and here; of new equal texts, the row with the largest
    doc_id stays. Without it, of all equal texts the row with the largest doc_id stays. Null text counts as empty; texts of
    any length are hashed whole; an empty table gives an empty result; further columns are ignored. Rows that share an id
    are documents of their own, and one stays; rows without an id count as the largest (see
    :func:`corpusloom.operators.rows.keyed_rows`). Memory: one shard's table (about ``per_shard`` slots) and about
    ``per_task`` look-ups: a shard that a frequent text makes hot is split over as many tasks as its look-ups need, each
    with its copy of the table.
    """
    keyed = keyed_rows(docs.select(id_col, text_col), id_col)
    text = F.coalesce(F.col(f"doc.`{text_col}`"), F.lit(""))
    rows = materialize(keyed.select("row", F.col(f"doc.`{id_col}`").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")))
    if history is None:
        middle = rows.agg(F.percentile_approx("row", 0.5, 1000)).first()[0]
        later = rows.where(F.col("row") >= F.lit(middle)).groupBy("digest").agg(F.max("row").alias("row"), F.max_by("doc_id", "row").alias("id"))
        known = later.select("digest", "row", "id", F.lit(0).cast("long").alias("copies"))  # they are counted with all others
    else:
        known = history.select("digest", F.lit(None).cast("long").alias("row"), F.col("id").cast("long").alias("id"), F.col("copies").cast("long").alias("copies"))
    known = materialize(known)
    shards = max(1, -(-known.count() // per_shard), -(-rows.count() // per_task))
    # the digest is uniform, so a part of it deals the shards evenly
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 25, 7)), 16, 10).cast("long"), F.lit(shards)).cast("int")
    asked = rows.withColumn("shard", shard)
    loads = asked.groupBy("shard").count().select("shard", F.ceil(F.col("count") / per_task).cast("int").alias("salts"))
    tables = known.withColumn("shard", shard).groupBy("shard").applyInPandas(_build, "shard int, seeds binary, slots binary")
    spread = tables.join(loads.select("shard", F.col("salts").alias("parts")), "shard").select(
        "shard", "seeds", "slots", F.explode_outer(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")
    )
    dealt = asked.join(loads, "shard").select("shard", "row", "doc_id", "digest", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int").alias("salt"))
    found = materialize(dealt.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(_probe, FOUND))
    # repeats of history: counted by slot. Strangers: grouped by themselves
    members = found.where("slot IS NOT NULL")
    sizes = members.groupBy("shard", "slot").agg(F.count("*").alias("n"))
    repeats = members.join(sizes, ["shard", "slot"]).select("row", "doc_id", "digest", "winner", "keep_id", (F.col("copies") + F.col("n")).alias("group_size"))
    if history is not None:
        repeats = repeats.withColumn("winner", F.lit(None).cast("long"))
    strangers = found.where("slot IS NULL").select("row", "doc_id", "digest")
    groups = strangers.groupBy("digest").agg(F.max("row").alias("winner"), F.max_by("doc_id", "row").alias("keep_id"), F.count("*").alias("group_size"))
    own = strangers.join(groups, "digest").select("row", "doc_id", "digest", "winner", "keep_id", "group_size")
    kept = F.coalesce(F.col("winner") == F.col("row"), F.lit(False)).alias("kept")
    return repeats.unionByName(own).select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"))
