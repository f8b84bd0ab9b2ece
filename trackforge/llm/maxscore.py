"""Exact top-k inner products by MaxScore.

A vector's components are its terms. For a query, the score bound of term d is the largest product that any
candidate of the shard can give: q_d times the greatest component d if q_d > 0, times the least if q_d < 0.
Terms are taken in order of bounds. The essential terms are the first ones, as many as are needed for the bounds
of the rest together to be unable to lift a candidate that has none of the essential score past the query's
threshold; their columns (postings) are traversed for all candidates of a block. The others are probed, a few
at a time, only for candidates that can still reach the threshold, the k-th best score so far. A tie can win by
its smaller id, so candidates that can equal the threshold go on.

Queries are taken in blocks of bounded size, each of which goes to all tasks; candidates stay where they are read.
A task takes its candidates a shard of bounded rows at a time and keeps the k best of each query, whose least
score is the threshold for the next shard. Tasks' results are merged by a partial top-k aggregation.

Components beyond the range of a long and scores beyond it take its least or greatest value; scores in between are
exact, in floating point where all sums are below 2^53, else in integers of any size.

Null vectors, or with null or non-finite components, or of another length than most, take no part. Ties go to the
smaller id; repeated rows are all ranked, but no row for a query of its own id. Long vectors are like others. Empty
table: no rows. Fewer than k candidates: all of them. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table


def _best(score, ids, k):
    """Positions of the k best by score, then smaller id."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= cut)
        return keep[np.lexsort((ids[keep], -score[keep]))[:k]]
    return np.lexsort((ids, -score))[:k]


def search_shard(q, q_ids, v, v_ids, k: int, floors: dict | None = None, block: int = 4096):
    """query, candidates, scores of the k best of one shard for each query; ids tell a query from its own row.

    floors: the k-th best score of each query in earlier shards, if k are known.
    """
    floors = floors or {}
    top, least = v.max(axis=0), v.min(axis=0)
    columns = np.ascontiguousarray(v.T)
    for qi, x in zip(q_ids, q):
        bound = np.where(x > 0, x * top, x * least)
        order = np.argsort(np.abs(x) * (top - least))[::-1]
        rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])
        scores, ids, floor = np.empty(0, v.dtype), np.empty(0, np.int64), floors.get(qi)
        for a in range(0, len(v), block):
            part = columns[:, a : a + block]
            alive = np.flatnonzero(v_ids[a : a + block] != qi)
            if floor is None:
                got = x @ part[:, alive]
            else:
                # essential: terms without which the threshold can't be reached
                essential = max(1, int(np.argmax(rest < floor)) if (rest < floor).any() else len(x))
                got = x[order[:essential]] @ part[order[:essential]]
                keep = got[alive] + rest[essential] >= floor
                alive, at = alive[keep], essential
                got = got[alive]
                while at < len(x) and len(alive):
                    to = min(len(x), at + 8)
                    got = got + x[order[at:to]] @ part[order[at:to]][:, alive]
                    keep = got + rest[to] >= floor
                    alive, got, at = alive[keep], got[keep], to
            scores, ids = np.concatenate([scores, got]), np.concatenate([ids, v_ids[a : a + block][alive]])
            best = _best(scores, ids, k)
            scores, ids = scores[best], ids[best]
            if len(scores) == k:
                floor = scores.min() if floor is None else max(floor, scores.min())
        yield qi, ids, scores


def _exact(q: np.ndarray, v: np.ndarray):
    """Both in a type in which no sum of products loses a digit."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(v.astype(np.float64)).max(initial=0)) * q.shape[1] * 2
    kind = np.float64 if most < 2**53 else object
    return q.astype(kind), v.astype(kind)


def _search(block, dim: int, k: int, shard_rows: int):
    """mapInArrow over candidates (vec_id, v): the k best of a task for each query of the block."""

    def run(batches):
        q_ids, q = block.value
        best: dict[int, tuple] = {}

        def search(held):
            ids = np.concatenate([x[0] for x in held])
            a, v = _exact(q, np.concatenate([x[1] for x in held]))
            floors = {qi: s[-1] for qi, (_, s) in best.items() if len(s) == k}
            for qi, found, score in search_shard(a, q_ids, v, ids, k, floors):
                score = np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in score], np.int64)
                if qi in best:
                    found, score = np.concatenate([best[qi][0], found]), np.concatenate([best[qi][1], score])
                o = np.lexsort((found, -score.astype(object) if len(score) and score.min() == -(2**63) else -score))[:k]
                best[qi] = found[o], score[o]

        held, n = [], 0
        for batch in batches:
            held.append((batch.column("vec_id").to_numpy(), batch.column("v").flatten().to_numpy().reshape(-1, dim)))
            n += len(held[-1][0])
            if n >= shard_rows:
                search(held)
                held, n = [], 0
        if n:
            search(held)
        for qi, (found, score) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([qi] * len(found), pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.int64())], ["query_id", "vec_id", "score"])

    return run


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, shard_rows: int = 8192, block_rows: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries(vec_id, embedding) the k best other rows of vectors."""
    spark = vectors.sparkSession
    fine = "embedding is not null and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) <> double('Infinity'))"
    whole = lambda df: df.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    cand, asked = materialise(whole(vectors), "vectors"), materialise(whole(queries), "queries")
    dims = cand.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims or not dims[0]["d"]:
        return asked.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    dim = dims[0]["d"]
    right = F.size("v") == dim
    cand, asked = cand.where(right), asked.where(right)
    blocks = max(1, -(-asked.count() // block_rows))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b).distinct().collect()
        q = np.array([r["v"] for r in rows], np.int64).reshape(-1, dim)
        block = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in rows], np.int64), q))
        found = cand.mapInArrow(_search(block, dim, k, shard_rows), "query_id long, vec_id long, score long")
        ranked = found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:  # later blocks don't wait for this one's broadcast
            ranked = materialise(ranked, "ranked")
        out = ranked if out is None else out.union(ranked)
    return out


def op6_maxscore(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_products(e, e.where("vec_id % 50 = 0"))


OP6_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
           from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from p)
select query_id, rank, vec_id, score from r where rank <= 5
"""
