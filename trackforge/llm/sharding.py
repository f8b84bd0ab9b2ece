"""Sharding by Karmarkar-Karp differencing.

Law `bytes`: the shards' sizes come out near equal. Rows of equal text form a group that stays whole in one shard,
however large it is; a group above an even share then has its shard to itself as far as the other groups allow.

Groups are dealt to tasks by hash. Each task starts with one partial partition a group (all of it in one of k
subsets) and combines the two of largest spread again and again, oppositely ordered, until one is left: a map
from group to subset with k sums. Tasks do the same with `fan` of these, k sums of each, level by level until no more
than `fan` are left, which one task combines.

Null text: no bytes, a group with other nulls. Empty text: likewise by itself. Very long texts: groups like others.
Repeated rows: one group. Ties of size go by the hash of the text. Empty table: no rows. Other columns, whatever their
names, are ignored. Slots of a shard count up by doc_id within hash buckets; ties are in any order.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table


def differencing(starts: list[np.ndarray]):
    """Combines partial partitions, given by their sums; returns the final sums and, for each start, the subset that each of its subsets ends in."""
    k = len(starts[0])
    heap = []
    left: list[tuple[int, int] | None] = [None] * len(starts)  # a tree of the combinations
    orders: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(starts)
    for i, s in enumerate(starts):
        heap.append((int(s.min()) - int(s.max()), i, s))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        oa, ob = np.argsort(-a, kind="stable"), np.argsort(b, kind="stable")
        c = a[oa] + b[ob]
        left.append((i, j))
        orders.append((oa, ob))
        heapq.heappush(heap, (int(c.min()) - int(c.max()), len(left) - 1, c))
    _, root, sums = heap[0]
    ends: list = [None] * len(left)
    ends[root] = np.arange(k)
    for node in range(root, len(starts) - 1, -1):
        if left[node] is not None and ends[node] is not None:
            (i, j), (oa, ob) = left[node], orders[node]
            ends[i], ends[j] = np.empty(k, np.int64), np.empty(k, np.int64)
            ends[i][oa], ends[j][ob] = ends[node], ends[node]
    return sums, ends[: len(starts)]


def _partition(shards: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("bytes", "descending"), ("grp", "ascending"), ("grp2", "ascending")])
        size = t.column("bytes").to_numpy()
        starts = [np.concatenate([[x], np.zeros(shards - 1, np.int64)]) for x in size]
        sums, ends = differencing(starts)
        sub = np.array([e[0] for e in ends])
        return pa.table([t.column("part"), t.column("grp"), t.column("grp2"), pa.array(sub, pa.int32()), pa.array(sums[sub], pa.int64())], names=["part", "grp", "grp2", "subset", "total"])

    return run


def _level(shards: int):
    """Combines partial partitions given as rows (part, subset, total): where each subset ends, and what that holds."""

    def run(t: pa.Table) -> pa.Table:
        part, subset, total = (t.column(c).to_numpy() for c in ("part", "subset", "total"))
        at, row = np.unique(part, return_inverse=True)
        starts = np.zeros((len(at), shards), np.int64)
        starts[row, subset] = total
        sums, ends = differencing(list(starts))
        end = np.concatenate(ends).astype(np.int32)
        columns = [np.full(len(end), t.column("up")[0].as_py()), np.repeat(at, shards), np.tile(np.arange(shards, dtype=np.int32), len(at)), end, sums[end]]
        return pa.table([pa.array(c) for c in columns], names=["up", "part", "subset", "end", "total"])

    return run


def ends_of(sums: DataFrame, parts: int, shards: int, fan: int) -> DataFrame:
    """(part, subset, shard) for the partial partitions sums(part, subset, total), numbered from 0 to below parts."""
    trail = None
    while True:
        last = parts <= fan
        up = F.lit(0) if last else F.floor(F.col("part") / fan)
        made = sums.withColumn("up", up.cast("long")).groupBy("up").applyInArrow(_level(shards), "up long, part long, subset int, end int, total long")
        made = materialise(made, "level")
        step = made.select(F.col("part").alias("mid"), F.col("subset").alias("mid_subset"), "up", "end")
        if trail is None:
            trail = step.select(F.col("mid").alias("part"), F.col("mid_subset").alias("subset"), "up", "end")
        else:
            trail = trail.withColumnsRenamed({"up": "mid", "end": "mid_subset"}).join(step, ["mid", "mid_subset"]).drop("mid", "mid_subset")
        if last:
            return trail.select("part", "subset", F.col("end").alias("shard"))
        sums = made.groupBy(F.col("up").alias("part"), F.col("end").alias("subset")).agg(F.first("total").alias("total"))
        parts = -(-parts // fan)


def shard_by_bytes(docs: DataFrame, shards: int = 16, groups_per_task: int = 50_000, fan: int = 1024) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.col("text").isNull()).alias("grp"),
        F.xxhash64(F.lit(7), F.reverse(text)).alias("grp2"),
    )
    rows = materialise(rows, "rows")
    groups = materialise(rows.groupBy("grp", "grp2").agg(F.sum("size").alias("bytes")), "groups")
    n = groups.count()
    parts = max(1, -(-n // groups_per_task), min(12, n // 1000))
    pieces = groups.withColumn("part", F.pmod(F.col("grp2"), F.lit(parts)))
    placed = materialise(pieces.groupBy("part").applyInArrow(_partition(shards), "part long, grp long, grp2 long, subset int, total long"), "placed", drop=(groups,))
    sums = placed.groupBy("part", "subset").agg(F.first("total").alias("total"))
    ends = ends_of(sums, parts, shards, fan)
    placed = placed.join(F.broadcast(ends) if parts <= fan else ends, ["part", "subset"]).select("grp", "grp2", "shard")
    return with_slots(rows.join(placed, ["grp", "grp2"]).drop("grp", "grp2")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def with_slots(rows: DataFrame, rows_per_bucket: int = 20_000) -> DataFrame:
    """Adds slot, gapless from 0 within each shard: rows count up within buckets, which counts of the buckets before them shift."""
    rows = materialise(rows, "sharded")
    buckets = max(16, rows.count() // rows_per_bucket)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialise(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("shard", "bucket", "before"), "counts")
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id"))
    return rows.withColumn("own", own).join(counts, ["shard", "bucket"]).withColumn("slot", F.col("before") + F.col("own") - 1).drop("own", "before", "bucket")


def op10_karmarkar_karp(spark, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))
