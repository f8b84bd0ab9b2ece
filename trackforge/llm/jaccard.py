"""N-gram Jaccard join by set-relation skipping.

Every text is the set of its word shingles. Two sets link when their Jaccard similarity reaches num/den. The
join is exact; what it skips follows from relations between sets:

* Copies (equal sets) are one set.
* Index: each set lists the rarest of its shingles that a partner must share (prefix filter). An index list is
  sorted by set size and prefix position and cut into blocks. A block is skipped whole if its sizes or its least
  position rule out the overlap, or if all its sets are in the component of the set that probes.
* Answers: every set of a list is first compared with the list's head. A set that is linked to the head takes
  over the head's component, so its answers need not be searched again inside it; for two sets of one list the
  distances to their common head bound their own distance (Jaccard distance is a metric), which rules pairs out
  or in without reading the sets. Only pairs across components go on, past an odd-sketch bound, to an exact
  comparison.

The order of shingles is by how often they occur, as far as tasks saw them more than once, then by hash; the
table of frequent shingles is bounded by `frequent`. Any order gives the same result. Lists of frequent shingles
are dealt to several tasks by a hash of the set, and the heads of those parts are compared as well.

Texts travel only for pairs that no bound rules out: a bit table of `filter_bits` bits, built over the ids of their
documents, goes to all tasks; what passes it is keyed by the fingerprint of its set. A full table passes every text.

Nulls, empty texts and texts of white space: no shingles, linked with nothing. Fewer than k words: one shingle.
Very long texts are sets like others. Repeated rows and ties: one component. Empty table: no rows. Other columns,
whatever their names, are ignored. A null id is kept as a row of its own with null component; its text links others
as any text does. Of rows with one id each has its own set and component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, materialise, mix, release, shingles, small_batches, trim

SKETCH_BITS = 512
BLOCK = 128


def _texts(batch):
    return (t.encode() if t else b"" for t in batch.column("text").to_pylist())


def count_repeats(k: int):
    """mapInArrow: (shingle, n) for shingles that several texts of a task hold; copies within a task count once."""

    def run(batches):
        forget()
        held, size, seen = [], 0, set()
        for batch in batches:
            for data in _texts(batch):
                s = shingles(data, k)
                if len(s) and (key := s[: min(4, len(s))].tobytes() + len(s).to_bytes(4, "little") + int(s.sum()).to_bytes(8, "little")) not in seen:
                    seen.add(key)
                    held.append(s)
                    size += len(s)
                if size > 2_000_000:
                    yield from _repeats(held)
                    held, size, seen = [], 0, set()
        yield from _repeats(held)
        del held
        trim()

    return run


def _repeats(held):
    if held:
        u, n = np.unique(np.concatenate(held), return_counts=True)
        u, n = u[n > 1], n[n > 1]
        for i in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(u[i : i + 100_000].view(np.int64)), "n": pa.array(n[i : i + 100_000].astype(np.int64))})


def fingerprint(s: np.ndarray, seed: int) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    a = mix(s + np.uint64(2 * seed + 1))
    b = mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A))
    fold = lambda x: int((mix(x.sum(dtype=np.uint64, keepdims=True) ^ np.uint64(len(x))) if len(x) else np.zeros(1, np.uint64)).view(np.int64)[0])
    return fold(a), fold(b)


def sketch(s: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Parity of the elements in each of the buckets: sets differ in at least as many elements as sketches in bits."""
    odd = np.bincount((mix(s) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_sketch(s: np.ndarray) -> bytes | None:
    """Of a set of more than SKETCH_BITS elements a sketch of about as many bits, a power of two."""
    return sketch(s, 1 << (len(s) - 1).bit_length()) if len(s) > SKETCH_BITS else None


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ; the longer one is folded to the length of the other."""
    x, y = (np.frombuffer(v, np.uint8) for v in (x, y))
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, n)) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def close(num: int, den: int):
    """mapInArrow over pairs with sketches: those that the sketches don't rule out."""

    def run(batches):
        for batch in batches:
            ok = []
            for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb"))):
                ok.append(apart(x, y) <= na + nb - 2 * -(-num * (na + nb) // (num + den)))
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(ok, pa.bool_()))

    return run


def describe(k, num, den, seed, frequent):
    """mapInArrow: (id, n, set, check, prefix, sketches) of each text; prefix and sketches only for a task's first copy of a set."""

    def run(batches):
        forget()
        keys, counts = frequent.value
        seen: set[int] = set()
        for batch in batches:
            ns, fps, checks, prefixes, sketches, wide = [], [], [], [], [], []
            for data in _texts(batch):
                s = shingles(data, k)
                fp, check = fingerprint(s, seed)
                new = len(s) > 0 and fp not in seen
                if new and len(seen) < 500_000:
                    seen.add(fp)
                ns.append(len(s))
                fps.append(fp)
                checks.append(check)
                prefixes.append(_prefix(s, keys, counts, num, den).tobytes() if new else None)
                sketches.append(sketch(s) if new else None)
                wide.append(wide_sketch(s) if new else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(ns, pa.int64()), pa.array(fps, pa.int64()), pa.array(checks, pa.int64()), pa.array(prefixes, pa.binary()), pa.array(sketches, pa.binary()), pa.array(wide, pa.binary())],
                ["doc_id", "n", "fp", "check_fp", "prefix", "sketch", "wide"],
            )
        trim()

    return run


def _prefix(s, keys, counts, num, den):
    n = len(s)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
        often = np.where(keys[at] == s, counts[at], 0)
    else:
        often = np.zeros(n, np.int64)
    order = np.lexsort((s, often))
    return s[order[: n - -(-num * n // den) + 1]]


def index_parts(parts: int, frequent, per_list: int):
    """mapInArrow over described sets: (part, block of postings), postings as rows of shingle, set, size, position."""

    def run(batches):
        keys, counts = frequent.value
        held, size = [], 0
        for batch in batches:
            for fp, n, p in zip(batch.column("fp").to_pylist(), batch.column("n").to_pylist(), batch.column("prefix").to_pylist()):
                if p is not None:
                    tok = np.frombuffer(p, np.uint64)
                    rows = np.empty((len(tok), 4), np.uint64)
                    rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3] = tok, np.array([fp], np.int64).view(np.uint64)[0], n, np.arange(len(tok))
                    held.append(rows)
                    size += len(tok)
            if size > 500_000:
                yield _dealt(held, parts, keys, counts, per_list)
                held, size = [], 0
        if held:
            yield _dealt(held, parts, keys, counts, per_list)
        del held
        trim()

    return run


def salts(tok, fp, keys, counts, per_list):
    """The part of its list that a set is in: 0 unless the shingle is frequent."""
    if not len(keys):
        return np.zeros(len(tok), np.uint64)
    at = np.minimum(np.searchsorted(keys, tok), len(keys) - 1)
    ways = np.where(keys[at] == tok, -(-counts[at] // per_list), 1).astype(np.uint64)
    return mix(fp) % np.maximum(ways, np.uint64(1))


def _dealt(held, parts, keys, counts, per_list):
    rows = np.concatenate(held)
    salt = salts(rows[:, 0], rows[:, 1], keys, counts, per_list)
    part = (mix(rows[:, 0] + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    cut = np.flatnonzero(np.diff(part, prepend=-1))
    pack = zstandard.ZstdCompressor(level=1).compress
    blobs = [pack(np.ascontiguousarray(rows[a:b].T).tobytes()) for a, b in zip(cut, [*cut[1:], len(rows)])]
    return pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.array(blobs, pa.binary())], ["part", "blob"])


LISTED = "shingle long, salt long, fp long, n long, pos long, head long, head_n long"


def lists(frequent, per_list: int):
    """applyInArrow over a part of the index: the postings of lists that hold several sets, with the list's head."""

    def run(t: pa.Table) -> pa.Table:
        trim()  # of the part before
        keys, counts = frequent.value
        unpack = zstandard.ZstdDecompressor().decompress
        rows = np.concatenate([np.frombuffer(unpack(x), np.uint64).reshape(4, -1) for x in t.column("blob").to_pylist()], axis=1)
        tok, fp, n, pos = rows
        salt = salts(tok, fp, keys, counts, per_list)
        order = np.lexsort((fp.view(np.int64), salt, tok))
        tok, fp, n, pos, salt = (x[order] for x in (tok, fp, n, pos, salt))
        once = np.ones(len(tok), bool)
        once[1:] = (tok[1:] != tok[:-1]) | (fp[1:] != fp[:-1])
        tok, fp, n, pos, salt = (x[once] for x in (tok, fp, n, pos, salt))
        first = np.ones(len(tok), bool)
        first[1:] = (tok[1:] != tok[:-1]) | (salt[1:] != salt[:-1])
        at = np.flatnonzero(first)
        length = np.diff([*at, len(tok)])
        head = np.repeat(at, length)
        hot = np.zeros(len(tok), bool)
        if len(keys):
            k = np.minimum(np.searchsorted(keys, tok), len(keys) - 1)
            hot = (keys[k] == tok) & (counts[k] > per_list)
        keep = (np.repeat(length, length) > 1) | hot
        col = lambda x: pa.array(np.ascontiguousarray(x[keep]).view(np.int64))
        return pa.table([col(tok), col(salt), col(fp), col(n), col(pos), col(fp[head]), col(n[head])], names=["shingle", "salt", "fp", "n", "pos", "head", "head_n"])

    return run


def overlaps(k: int):
    """mapInArrow over pairs of packed texts: the size of the intersection of their sets."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        held: dict[int, np.ndarray] = {}

        def of(fp, text):
            if fp not in held:
                if len(held) >= 500:
                    held.clear()
                held[fp] = shingles(unpack(text), k)
            return held[fp]

        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))):
                out.append(len(np.intersect1d(of(a, x), of(b, y), assume_unique=True)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b", "na", "nb")] + [pa.array(out, pa.int64())], ["a", "b", "na", "nb", "common"])
        del held
        trim()

    return run


def id_bit(bits: int):
    """The bit of doc_id in a table of so many."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(bits))


def bit_table(members: DataFrame, bits: int) -> np.ndarray:
    """A table of bits, set where members(doc_id) have theirs; its size is fixed."""
    words = members.select(id_bit(bits).alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("m")).toPandas()
    out = np.zeros(-(-bits // 64), np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64).view(np.uint64)
    return out


def packed_sets(k: int, seed: int, table):
    """mapInArrow over (h, text): texts whose bit is set, compressed, under the fingerprint of their set."""

    def run(batches):
        forget()
        pack, bits = zstandard.ZstdCompressor(level=3).compress, table.value
        for batch in batches:
            h = batch.column("h").to_numpy().astype(np.uint64)
            some = batch.filter(pa.array((bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)))
            fps, blobs = [], []
            for data in _texts(some):
                s = shingles(data, k)
                if len(s):
                    fps.append(fingerprint(s, seed)[0])
                    blobs.append(pack(data))
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(blobs, pa.binary())], ["fp", "packed"])

    return run


def across(num: int, den: int, best: bool):
    """applyInArrow over some lists (or pairs of parts of lists): pairs across components that no bound rules out.

    best: for each set and each component that is larger in the list, only the pair whose sketches are closest; a row
    with shingle names a list that holds further ones.
    """
    far = (den - num) / den

    def run(t: pa.Table) -> pa.Table:
        trim()  # of the part before
        col = lambda c: t.column(c).to_numpy()
        order = np.lexsort((col("pos"), col("n"), col("hi"), col("lo"), col("shingle")))
        v = {c: col(c)[order] for c in ("shingle", "lo", "hi", "fp", "n", "pos", "comp", "head", "common", "head_n", "side")}
        v["bits"] = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(order), -1)[order]
        v["dist"] = np.where(v["common"] >= 0, 1 - v["common"] / np.maximum(v["n"] + v["head_n"] - v["common"], 1), np.nan)
        new = np.ones(len(order), bool)
        new[1:] = (v["shingle"][1:] != v["shingle"][:-1]) | (v["lo"][1:] != v["lo"][:-1]) | (v["hi"][1:] != v["hi"][:-1])
        start = np.flatnonzero(new)
        length = np.diff([*start, len(order)])
        found = []
        # short lists: each set against the one d places before it, all lists at once
        place = np.arange(len(order)) - np.repeat(start, length)
        short = np.repeat(length, length) <= BLOCK
        for d in range(1, BLOCK):
            i = np.flatnonzero(short & (place >= d))
            if not len(i):
                break
            found.append(_possible(v, i - d, i, num, den, far))
        # long lists: block by block
        for a, m in zip(start[length > BLOCK], length[length > BLOCK]):
            blocks = [slice(x, min(x + BLOCK, a + m)) for x in range(a, a + m, BLOCK)]
            facts = [(v["n"][s][0], v["n"][s][-1], v["pos"][s].min(), v["comp"][s][0] if (v["comp"][s] == v["comp"][s][0]).all() else None) for s in blocks]
            for k, (s, (small, large, least, comp)) in enumerate(zip(blocks, facts)):
                for s2, (small2, large2, least2, comp2) in zip(blocks[k:], facts[k:]):
                    # sizes, positions and components rule out whole blocks
                    need = -(-num * (small + small2) // (num + den))
                    if den * large < num * small2 or (comp is not None and comp == comp2) or min(large - least, large2 - least2) < need:
                        continue
                    j, i = np.meshgrid(np.arange(s.start, s.stop), np.arange(s2.start, s2.stop))
                    j, i = j.ravel(), i.ravel()
                    found.append(_possible(v, j[j < i], i[j < i], num, den, far))
        j, i, apart = (np.concatenate(x) for x in zip(*found)) if found else np.empty((3, 0), np.int64)
        if best and len(j):
            _, where, size = np.unique(np.stack([np.repeat(start, length), v["comp"]]), axis=1, return_inverse=True, return_counts=True)
            size = size[where.ravel()]
            swap = (size[j] > size[i]) | ((size[j] == size[i]) & (v["comp"][j] < v["comp"][i]))
            own, other = np.where(swap, i, j), np.where(swap, j, i)
            o = np.lexsort((apart, v["comp"][other], own))
            first = np.ones(len(o), bool)
            first[1:] = (own[o][1:] != own[o][:-1]) | (v["comp"][other[o]][1:] != v["comp"][other[o]][:-1])
            more = np.unique(v["shingle"][j[o[~first]]])
            j, i = j[o[first]], i[o[first]]
        else:
            more = np.empty(0, np.int64)
        swap = v["fp"][j] > v["fp"][i]
        a, b = np.where(swap, i, j), np.where(swap, j, i)
        out = np.unique(np.stack([v["fp"][a], v["fp"][b], v["n"][a], v["n"][b]]), axis=1)
        none = pa.nulls(len(more), pa.int64())
        columns = [pa.concat_arrays([pa.array(x), none]) for x in out] + [pa.concat_arrays([pa.nulls(out.shape[1], pa.int64()), pa.array(more)])]
        return pa.table(columns, names=["a", "b", "na", "nb", "shingle"])

    return run


def _possible(v, j, i, num, den, far):
    """The pairs j, i (j no larger than i) that are of two components and that no bound rules out, and how far their sketches are apart."""
    nj, ni = v["n"][j], v["n"][i]
    need = -(-num * (nj + ni) // (num + den))
    ok = (v["comp"][j] != v["comp"][i]) & (den * nj >= num * ni) & ((v["side"][j] != v["side"][i]) | (v["side"][i] == 0))
    ok &= np.minimum(ni - v["pos"][i], nj - v["pos"][j]) >= need
    # a head has been compared with its list; two sets are at least as far apart as their distances to one head differ
    ok &= (v["fp"][j] != v["head"][i]) & (v["fp"][i] != v["head"][j])
    ok &= ~((v["head"][j] == v["head"][i]) & (np.abs(v["dist"][j] - v["dist"][i]) > far + 1e-9))
    j, i, most = j[ok], i[ok], (nj + ni - 2 * need)[ok]
    apart = np.bitwise_count(v["bits"][j] ^ v["bits"][i]).sum(axis=1, dtype=np.int64)
    return j[apart <= most], i[apart <= most], apart[apart <= most]


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, frequent: int = 1 << 18, per_list: int = 1024, postings_per_part: int = 500_000, filter_bits: int = 1 << 26) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text)."""
    with small_batches(docs.sparkSession):
        return _components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, num, den, frequent, per_list, postings_per_part, filter_bits)


def _components(docs: DataFrame, k: int, num: int, den: int, frequent: int, per_list: int, postings_per_part: int, filter_bits: int) -> DataFrame:
    spark = docs.sparkSession
    often = docs.select("text").mapInArrow(count_repeats(k), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n >= 8")
    top = often.orderBy(F.desc("n"), "shingle").limit(frequent).toPandas()
    keys = top["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    table = spark.sparkContext.broadcast((keys[order], top["n"].to_numpy(np.int64)[order]))
    for seed in range(8):
        sets = materialise(docs.mapInArrow(describe(k, num, den, seed, table), "doc_id long, n long, fp long, check_fp long, prefix binary, sketch binary, wide binary"), "sets")
        one = sets.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.max("n").alias("n2"), F.min("check_fp").alias("c"), F.max("check_fp").alias("c2"))
        one = materialise(one, "copies")
        # two different sets with one fingerprint: the other fingerprint tells, and other hashes are taken
        if not one.where("c <> c2 or n <> n2").head(1):
            break
        release(sets, one)
    else:
        raise RuntimeError("fingerprints clash under every seed")
    prefixes = sets.where("prefix is not null").select("fp", "n", "prefix")
    total = prefixes.agg(F.sum(F.length("prefix"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 8 // postings_per_part))
    index = prefixes.mapInArrow(index_parts(parts, table, per_list), "part long, blob binary")
    listed = materialise(index.groupBy("part").applyInArrow(lists(table, per_list), LISTED), "lists")
    sketches = materialise(sets.where("sketch is not null").groupBy("fp").agg(F.first("sketch").alias("sketch"), F.first("wide").alias("wide")), "sketches")
    rows = materialise(sets.select("doc_id", "n", "fp"), "rows", drop=(sets,))

    # each set against the head of its list, and the heads of a list's parts against each other
    a, b = F.least("fp", "head").alias("a"), F.greatest("fp", "head").alias("b")
    swap = F.col("fp") > F.col("head")
    star = listed.where("fp <> head").select(a, b, F.when(swap, F.col("head_n")).otherwise(F.col("n")).alias("na"), F.when(swap, F.col("n")).otherwise(F.col("head_n")).alias("nb"))
    heads = listed.where("fp = head").groupBy("shingle").agg(F.min(F.struct("fp", "n")).alias("h"), F.count("*").alias("c")).where("c > 1").select("shingle", F.col("h.fp").alias("top"), F.col("h.n").alias("top_n"))
    more = listed.where("fp = head").join(heads, "shingle").where("fp <> top")
    more = more.select(F.least("fp", "top").alias("a"), F.greatest("fp", "top").alias("b"), F.when(F.col("fp") > F.col("top"), F.col("top_n")).otherwise(F.col("n")).alias("na"), F.when(F.col("fp") > F.col("top"), F.col("n")).otherwise(F.col("top_n")).alias("nb"))
    near = f"{den} * least(na, nb) >= {num} * greatest(na, nb)"
    first = star.union(more).where(near).distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that sketches don't rule out, with the size of their intersection."""
        of = lambda side: sketches.select(F.col("fp").alias(side), F.coalesce("wide", "sketch").alias("s" + side))
        left = materialise(pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(close(num, den), "a long, b long, na long, nb long"), "pairs")
        members = left.select(F.col("a").alias("fp")).union(left.select("b")).distinct()
        members = materialise(members.join(one.select("fp", "doc_id"), "fp"), "members")
        bits = spark.sparkContext.broadcast(bit_table(members, filter_bits))
        texts = docs.select(id_bit(filter_bits).alias("h"), "text").mapInArrow(packed_sets(k, seed, bits), "fp long, packed binary")
        texts = materialise(texts.join(members.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.first("packed").alias("packed")), "texts", "none", drop=(members,))
        both = left.join(texts.select(F.col("fp").alias("a"), F.col("packed").alias("ta")), "a").join(texts.select(F.col("fp").alias("b"), F.col("packed").alias("tb")), "b")
        out = materialise(both.mapInArrow(overlaps(k), "a long, b long, na long, nb long, common long"), "checked", drop=(left, texts))
        bits.destroy()
        return out

    linked = f"{den} * common >= {num} * (na + nb - common)"
    checked = verified(first)
    links, found, again = checked.where(linked).select("a", "b"), [], None
    # what is left: lists that hold several components. First the likeliest pair of each set and component, then all of the lists that had more
    for best in (True, False):
        groups = components(links)
        known = listed if again is None else listed.join(again, "shingle", "left_semi")
        known = known.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("component", "fp")).drop("component")
        known = materialise(known, "known", drop=(groups,))
        several = known.groupBy("shingle").agg(F.min("comp").alias("c"), F.max("comp").alias("c2"), F.max("salt").alias("ways")).where("c <> c2")
        rest = known.join(several.select("shingle", "ways"), "shingle")
        rest = rest.withColumns({"a": F.least("fp", "head"), "b": F.greatest("fp", "head")}).join(checked.select("a", "b", "common"), ["a", "b"], "left").drop("a", "b")
        rest = rest.withColumn("common", F.when(F.col("fp") == F.col("head"), F.col("n")).otherwise(F.coalesce("common", F.lit(-1))))
        rest = materialise(rest.join(sketches.select("fp", "sketch"), "fp"), "rest", drop=(known,))
        # parts of one list meet pairwise: part s goes to the tasks (s, t) and (t, s) of every t; side tells them apart
        met = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways"))))
        met = met.withColumns({"lo": F.least("salt", "other"), "hi": F.greatest("salt", "other")})
        met = met.withColumn("side", F.when(F.col("lo") == F.col("hi"), 0).when(F.col("salt") == F.col("lo"), 1).otherwise(2).cast("long")).drop("salt", "other", "ways")
        some = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-met.count() // 100_000))
        pairs = met.withColumn("part", F.pmod(F.xxhash64("shingle", "lo", "hi"), F.lit(some))).groupBy("part").applyInArrow(across(num, den, best), "a long, b long, na long, nb long, shingle long")
        pairs = materialise(pairs.distinct(), "across", drop=(rest,) if again is None else (rest, again))
        again = materialise(pairs.where("shingle is not null").select("shingle"), "again")
        found.append(verified(pairs.where("shingle is null").drop("shingle")))
        links = links.union(found[-1].where(linked).select("a", "b"))
        release(pairs)
    final = components(links)
    release(listed, sketches, checked, again, *found)

    # the least document of each component, then of each row
    of_set = one.select("fp", "doc_id").join(final.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    of_set = materialise(of_set, "of_set", drop=(one, final))
    least = of_set.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_set = materialise(of_set.join(least, "component").select("fp", "component_id"), "of_set", drop=(of_set,))
    own = rows.where("n > 0").join(of_set, "fp").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    none = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return materialise(own.union(none), "joined", drop=(rows, of_set))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return jaccard_components(table(spark, sf_dir, "documents"))
