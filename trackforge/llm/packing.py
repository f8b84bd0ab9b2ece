"""Best-fit packing by a grouping genetic algorithm.

A text becomes the ids of its tokens and an end id; what is longer than a sequence is cut into pieces of a
sequence's length, the last of which may be shorter. Pieces are packed into as few sequences as possible.

Pieces are dealt to demes at random. On each deme, islands evolve populations of packings. A packing is a list of
bins. Crossover injects the other parent's best-filled bins whole, removes the bins that hold any of their
documents, and puts the documents so displaced back by best fit, largest first. Mutation breaks up the worst-filled
bins. After some generations the elite of each island migrates to the next one. A packing is better with fewer bins,
then with fuller full ones. A round ends with the better-filled half of each deme's bins, and all that are filled to
1 - `waste`, as final; the documents of the others migrate to the next round's demes, half as many, until one deme
holds all that is left.

Null and empty texts: the end id alone. Very long texts: as many pieces as they need. Repeated rows are packed as
often as they occur. Ties of length go by doc_id, then piece. Empty table: no rows. Other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise, small_batches, table, word_bpe

#: Words that a worker keeps the ids of; fewer than elsewhere, for little more CPU time.
KNOWN = 400_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(path: str, limit: int, end_id: int):
    """mapInArrow over (doc_id, text): the pieces of each text."""

    def run(batches):
        words = word_bpe(path, KNOWN)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.texts(batch.column("text"))):
                ids = np.append(ids, end_id).astype("<u4")
                for p, a in enumerate(range(0, len(ids), limit)):
                    part = ids[a : a + limit]
                    for column, x in zip(out, (doc, p, a, len(part), zlib.crc32(part.tobytes()))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(items, size, bins: list[list[int]], room: list[int], limit: int) -> None:
    """Puts items, largest first, where they leave the least room; opens bins where none has room."""
    free = sorted((r, b) for b, r in enumerate(room) if r > 0)
    for i in sorted(items, key=lambda x: -size[x]):
        at = bisect_left(free, (size[i], -1))
        if at < len(free):
            r, b = free.pop(at)
        else:
            r, b = limit, len(bins)
            bins.append([])
            room.append(limit)
        bins[b].append(i)
        room[b] = r - size[i]
        if room[b]:
            insort(free, (room[b], b))


class Packing:
    def __init__(self, bins, size, limit):
        self.bins = [b for b in bins if b]
        self.room = [limit - sum(size[i] for i in b) for b in self.bins]
        full = [(limit - r) / limit for r in self.room]
        self.merit = (-len(self.bins), sum(f * f for f in full))


def cross(a: Packing, b: Packing, size, limit, rng) -> Packing:
    """b's best-filled bins whole, then those of a's bins that share no document with them, then best fit."""
    order = np.argsort(np.array(b.room) + rng.random(len(b.room)) * limit * 0.02, kind="stable")
    inject = [b.bins[k] for k in order[: max(1, int(len(order) * rng.uniform(0.2, 0.8)))]]
    taken = {i for x in inject for i in x}
    bins, loose = list(map(list, inject)), []
    for x in a.bins:
        if taken.isdisjoint(x):
            bins.append(list(x))
        else:
            loose += [i for i in x if i not in taken]
    room = [limit - sum(size[i] for i in x) for x in bins]
    worst = np.argsort(room)[::-1][: max(1, len(room) // 50)]
    for k in worst:  # mutation
        loose += bins[k]
        bins[k], room[k] = [], 0
    best_fit(loose, size, bins, room, limit)
    return Packing(bins, size, limit)


def evolve(size: list[int], limit: int, seed: int, islands: int, population: int, generations: int, epochs: int) -> Packing:
    """The best packing of a deme. After an epoch it stops as soon as no packing can have fewer bins."""
    rng = np.random.default_rng(seed)
    least = -(-sum(size) // limit)
    everything = range(len(size))

    def start(shuffled: bool) -> Packing:
        bins: list[list[int]] = []
        room: list[int] = []
        if shuffled:  # a random part first, then best fit of the rest
            some = rng.permutation(len(size))[: len(size) // 10].tolist()
            best_fit(some, size, bins, room, limit)
            chosen = set(some)
            best_fit([i for i in everything if i not in chosen], size, bins, room, limit)
        else:
            best_fit(everything, size, bins, room, limit)
        return Packing(bins, size, limit)

    first = start(False)
    if len(first.bins) < 3:  # nothing to exchange
        return first
    pools = [[first] + [start(True) for _ in range(population - 1)] for _ in range(islands)]
    for _ in range(epochs):
        for pool in pools:
            for _ in range(generations):
                a, b = (max((pool[k] for k in rng.integers(0, len(pool), 2)), key=lambda p: p.merit) for _ in range(2))
                pool.append(cross(a, b, size, limit, rng))
                pool.remove(min(pool, key=lambda p: p.merit))
        if max(p.merit for pool in pools for p in pool)[0] >= -least:
            break
        elite = [max(pool, key=lambda p: p.merit) for pool in pools]
        for k, pool in enumerate(pools):
            pool[pool.index(min(pool, key=lambda p: p.merit))] = elite[k - 1]
    return max((p for pool in pools for p in pool), key=lambda p: p.merit)


PACKED = PIECES + ", deme long, bin int, offset long, final boolean"


def _deme(limit: int, waste: float, seed: int, islands: int, population: int, generations: int, epochs: int):
    def run(t: pa.Table) -> pa.Table:
        forget()  # the texts are behind it
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        size = t.column("length").to_pylist()
        best = evolve(size, limit, seed, islands, population, generations, epochs)
        if len(best.bins) >= 1 << 16:
            raise ValueError("a deme has too many bins to number; deme_rows is too large")
        final = np.array(best.room) <= np.median(best.room)
        of, offset, done = np.empty(len(size), np.int32), np.empty(len(size), np.int64), np.empty(len(size), bool)
        for k, (items, r, f) in enumerate(zip(best.bins, best.room, final)):
            at = 0
            for i in items:
                of[i], offset[i], done[i] = k, at, f or r <= limit * waste
                at += size[i]
        return t.append_column("bin", pa.array(of)).append_column("offset", pa.array(offset)).append_column("final", pa.array(done))

    return run


def pack(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 0, deme_rows: int = 3000, waste: float = 0.005, islands: int = 2, population: int = 4, generations: int = 6, epochs: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs(doc_id, text)."""
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces(path, limit, end_id), PIECES)
    with small_batches(docs.sparkSession):
        cut = materialise(cut, "pieces")
    # sequences that one piece fills get even numbers, those of demes odd ones: round, deme and bin, of 6, 40 and 16 bits
    done = [cut.where(F.col("length") == limit).withColumns({"sequence_id": F.monotonically_increasing_id() * 2, "offset": F.lit(0).cast("long")})]
    rest, rnd = cut.where(F.col("length") < limit), 0
    n = rest.count()
    demes = max(1, n // deme_rows)
    while n:
        # by place in the table, so that repeated rows are dealt out as well
        deal = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(rnd)), F.lit(demes))
        packed = rest.withColumn("deme", deal).groupBy("deme").applyInArrow(_deme(limit, waste, rnd, islands, population, generations, epochs), PACKED)
        packed = materialise(packed, "packed")
        number = ((F.lit(rnd).cast("long") * 2**56 + F.col("deme") * 2**16 + F.col("bin")) * 2 + 1).alias("sequence_id")
        columns = ["doc_id", "piece", "start", "length", "ids_crc32", number, "offset"]
        done.append(packed.where(F.lit(demes == 1) | F.col("final")).select(*columns))
        if demes == 1:
            break
        rest, rnd = packed.where("not final").select("doc_id", "piece", "start", "length", "ids_crc32"), rnd + 1
        n = rest.count()
        demes = max(1, min(demes // 2, n // deme_rows))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def op2_pack(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
