"""Consistent-hash sharding with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEED = "ring-1"
SHARDS, VNODES, LOAD = 64, 128, 1.05


def ring(shards: list[str] | int, vnodes: int = VNODES, seed: str = SEED) -> tuple[np.ndarray, list[str]]:
    """The virtual nodes in clockwise order: positions of 60 bits, and the shard of each."""
    names = [str(s) for s in (range(shards) if isinstance(shards, int) else shards)]
    nodes = sorted((int(hashlib.md5(f"{seed}|{s}|{v}".encode()).hexdigest()[:15], 16), s, v) for s in names for v in range(vnodes))
    return np.array([p for p, _, _ in nodes], np.int64), [s for _, s, _ in nodes]


def place(counts: np.ndarray, owners: list[str], capacity: int) -> list[list[tuple[int, int, str]]]:
    """For each arc the runs (keys up to, hops, shard) of its keys in order.

    Keys knock in waves. In wave j all keys that have no shard yet, arc by arc in ring order, knock at the shard of the j-th
    virtual node after their own; a shard takes keys in that order while it holds fewer than capacity. Work is by arc,
    not by key: at most arcs times hops steps.
    """
    free = dict.fromkeys(owners, capacity)
    left, taken = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64)
    runs: list[list[tuple[int, int, str]]] = [[] for _ in counts]
    active, hop = np.flatnonzero(left), 0
    while len(active):
        for a in active:
            shard = owners[(a + hop) % len(owners)]
            if n := min(free[shard], int(left[a])):
                free[shard] -= n
                left[a] -= n
                taken[a] += n
                runs[a].append((int(taken[a]), hop, shard))
        active, hop = active[left[active] > 0], hop + 1
    return runs


def _position(key: Column, seed: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def assign(df: DataFrame, key: str = "doc_id", shards: list[str] | int = SHARDS, vnodes: int = VNODES, load: float = LOAD, seed: str = SEED) -> DataFrame:
    """df with columns shard and hops; columns of these names in df are replaced.

    No shard gets more than ceil(load * rows / shards) rows, load >= 1. A key goes to the first virtual node at or after its
    position (MD5 of seed and key); where that shard is full it continues clockwise, and hops says how many virtual nodes
    on. Keys of an arc go by position, then by key as text. A null key is the empty key; repeated rows are placed one by one,
    and which of them goes on when a shard fills up makes no difference to the result. An empty table gives an empty table.

    Only row counts per arc reach the driver: shards * vnodes numbers, whatever the data. Rows of arcs that one shard takes
    whole are mapped without a shuffle; only arcs that are split between shards are ranked.
    """
    if load < 1:
        raise ValueError("load must be at least 1")
    places, owners = ring(shards, vnodes, seed)

    @F.arrow_udf("int")
    def arc_of(pos: pa.Array) -> pa.Array:
        return pa.array((np.searchsorted(places, pos.to_numpy(zero_copy_only=False), "left") % len(places)).astype(np.int32))

    columns = [c for c in df.columns if c not in ("shard", "hops")]
    own = df.select(*columns, _position(F.col(key), seed).alias("__ring_pos")).withColumn("__ring_arc", arc_of("__ring_pos"))
    counts = np.zeros(len(owners), np.int64)
    for arc, n in own.groupBy("__ring_arc").count().collect():
        counts[arc] = n
    runs = place(counts, owners, math.ceil(load * int(counts.sum()) / len(set(owners))))
    split = np.array([len(r) > 1 for r in runs])
    whole_shard = [r[0][2] if len(r) == 1 else None for r in runs]
    whole_hops = np.array([r[0][1] if len(r) == 1 else 0 for r in runs], np.int32)
    bounds = [np.array([u for u, _, _ in r], np.int64) for r in runs]

    @F.arrow_udf("boolean")
    def is_split(arc: pa.Array) -> pa.Array:
        return pa.array(split[arc.to_numpy(zero_copy_only=False)])

    @F.arrow_udf("struct<shard:string,hops:int>")
    def of_arc(arc: pa.Array) -> pa.Array:
        at = arc.to_numpy(zero_copy_only=False)
        return pa.StructArray.from_arrays([pa.array([whole_shard[a] for a in at], pa.string()), pa.array(whole_hops[at])], ["shard", "hops"])

    @F.arrow_udf("struct<shard:string,hops:int>")
    def of_rank(arc: pa.Array, rank: pa.Array) -> pa.Array:
        got = [runs[a][int(np.searchsorted(bounds[a], r, "left"))] for a, r in zip(arc.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False))]
        return pa.StructArray.from_arrays([pa.array([s for _, _, s in got], pa.string()), pa.array([h for _, h, _ in got], pa.int32())], ["shard", "hops"])

    placed = own.where(~is_split("__ring_arc")).withColumn("__ring_at", of_arc("__ring_arc"))
    order = W.partitionBy("__ring_arc").orderBy("__ring_pos", F.coalesce(F.col(key).cast("string"), F.lit("")))
    ranked = own.where(is_split("__ring_arc")).withColumn("__ring_rank", F.row_number().over(order)).withColumn("__ring_at", of_rank("__ring_arc", "__ring_rank")).drop("__ring_rank")
    return placed.unionByName(ranked).select(*columns, "__ring_at.shard", "__ring_at.hops")


def query(spark, sf_dir):
    from trawl.llm.common import table

    return assign(table(spark, sf_dir, "documents").select("doc_id"))


SQL = f"""
WITH RECURSIVE nodes AS (
  SELECT s::VARCHAR AS shard, v, ('0x' || substr(md5('{SEED}|' || s || '|' || v), 1, 15))::BIGINT AS pos FROM range({SHARDS}) a(s), range({VNODES}) b(v)),
ring AS (SELECT shard, pos, row_number() OVER (ORDER BY pos, shard, v) - 1 AS arc FROM nodes),
keyed AS (SELECT doc_id, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS pos FROM documents),
home AS (SELECT k.doc_id, k.pos, coalesce(r.arc, 0) AS arc FROM keyed k ASOF LEFT JOIN ring r ON k.pos <= r.pos),
waves AS (
  SELECT doc_id, pos, arc, NULL::VARCHAR AS shard, -1 AS hops, -1::BIGINT AS wave, count(*) OVER () AS unplaced, count(*) OVER () AS n FROM home
  UNION ALL
  SELECT doc_id, pos, arc, CASE WHEN ok THEN knock END, CASE WHEN shard IS NOT NULL THEN hops WHEN ok THEN wave + 1 ELSE -1 END, wave + 1,
         count(*) FILTER (NOT ok) OVER (), n
  FROM (SELECT *, shard IS NOT NULL OR row_number() OVER (PARTITION BY knock ORDER BY shard IS NULL, arc, pos, doc_id::VARCHAR) <= ceil({LOAD} * n / {SHARDS}) AS ok
        FROM (SELECT w.*, coalesce(w.shard, r.shard) AS knock FROM waves w JOIN ring r ON r.arc = (w.arc + w.wave + 1) % {SHARDS * VNODES} WHERE w.unplaced > 0)))
SELECT doc_id, shard, hops::INT AS hops FROM waves WHERE unplaced = 0
"""
