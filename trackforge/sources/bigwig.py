"""BigWig files: range scans by the file's index, the table of sequences, and a writer.

A scan walks the index on the driver (one entry for about a thousand values), and deals the data blocks that it needs
out to tasks, which inflate them and clip their intervals to the ranges asked for. Intervals are 1-based and closed,
values 32-bit floats. Files must lie where driver and executors see them. The writer adds zoom levels, whose windows
lie on a fixed grid; summaries here are always computed from the values.
"""

from __future__ import annotations

import struct
import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.coverage import zoom, zoom_again, zoom_reductions
from . import parts

# Fixed values of the format: signatures of a file, its tree of names and its index; kinds of data blocks.
SIGNATURE, NAMES, INDEX = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
BEDGRAPH, VARIABLE, FIXED = 1, 2, 3
SIGNAL = "seqnames string, start int, end int, score double"


def merged(ranges) -> list[tuple[str, int, int]]:
    """Ranges (seqnames, start, end) in order, those that overlap or touch as one."""
    out: list[tuple[str, int, int]] = []
    for name, a, b in sorted(ranges):
        if out and out[-1][0] == name and a <= out[-1][2] + 1:
            out[-1] = (name, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((name, a, b))
    return out


class BigWig:
    """The header, names and index of an open file."""

    signature, kind = SIGNATURE, "BigWig"

    def __init__(self, path: str):
        self.f = open(path.removeprefix("file://"), "rb")
        head = self.f.read(64)
        self.order = next((o for o in "<>" if len(head) == 64 and struct.unpack(o + "I", head[:4])[0] == self.signature), None)
        if self.order is None:
            raise ValueError(f"{path}: not a {self.kind} file")
        _, _, zooms, names, self.data, self.index, self.fields, self.defined, self.described, self.summary, self.inflated, self.extension = struct.unpack(self.order + "IHHQQQHHQQIQ", head)
        #: (reduction, place of the data, place of the index) of each zoom level.
        self.zooms = [(r, d, i) for r, _, d, i in (self._get("IIQQ") for _ in range(zooms))]
        self.names: dict[str, tuple[int, int]] = {}  # number and length
        self.f.seek(names)
        magic, _, self._key, _, _, _ = self._get("IIIIQQ")
        if magic != NAMES:
            raise ValueError(f"{path}: damaged")
        self._name_node(names + 32)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()

    def _get(self, kinds: str):
        kinds = self.order + kinds
        return struct.unpack(kinds, self.f.read(struct.calcsize(kinds)))

    def _name_node(self, at: int) -> None:
        self.f.seek(at)
        leaf, _, n = self._get("BBH")
        items = [self._get(f"{self._key}s" + ("II" if leaf else "Q")) for _ in range(n)]
        for key, *rest in items:
            if leaf:
                self.names[key.rstrip(b"\0").decode()] = tuple(rest)
            else:
                self._name_node(rest[0])

    def total(self) -> dict[str, float]:
        """The summary of the whole file."""
        self.f.seek(self.summary)
        return dict(zip(("valid", "min_value", "max_value", "sum_value", "sum_squares"), self._get("Qdddd")))

    def blocks(self, ranges: list[tuple[int, int, int]] | None, index: int | None = None) -> list[tuple[int, int]]:
        """(offset, size) of the data blocks that overlap ranges(number, start from 0, end), or of all; index: that of a zoom level."""
        index = self.index if index is None else index
        self.f.seek(index)
        if self._get("I")[0] != INDEX:
            raise ValueError("damaged index")
        found, todo = [], [index + 48]
        while todo:
            self.f.seek(todo.pop())
            leaf, _, n = self._get("BBH")
            for _ in range(n):
                c0, a, c1, b, at, *size = self._get("IIIIQQ" if leaf else "IIIIQ")
                if ranges is None or any((c0, a) < (c, y) and (c1, b) > (c, x) for c, x, y in ranges):
                    if leaf:
                        found.append((at, size[0]))
                    else:
                        todo.append(at)
        return sorted(found)


def decode(body: bytes, order: str = "<") -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the sequence, starts from 0, ends and values of an inflated block."""
    number, start, _, step, span, kind, _, n = struct.unpack(order + "IIIIIBBH", body[:24])
    fields = {BEDGRAPH: [("a", order + "u4"), ("b", order + "u4")], VARIABLE: [("a", order + "u4")], FIXED: []}[kind]
    rows = np.frombuffer(body, np.dtype([*fields, ("v", order + "f4")]), n, 24)
    a = rows["a"].astype(np.int64) if kind != FIXED else start + step * np.arange(n, dtype=np.int64)
    return number, a, rows["b"].astype(np.int64) if kind == BEDGRAPH else a + span, rows["v"].astype(np.float64)


def seqinfo(spark: SparkSession, path: str) -> DataFrame:
    with BigWig(path) as w:
        rows = [(name, size, number) for name, (number, size) in w.names.items()]
    return spark.createDataFrame(rows, "seqnames string, seqlength long, seq_rank int")


def _wanted(w: BigWig, which, missing: str) -> list[tuple[int, int, int]] | None:
    """Numbers and ranges from 0. missing: "error" or "warn" for unknown sequences."""
    if which is None:
        return None
    if unknown := {r[0] for r in which} - set(w.names):
        if missing == "error":
            raise ValueError(f"unknown sequences: {sorted(unknown)}")
        warnings.warn(f"ranges of unknown sequences are left out: {sorted(unknown)}", stacklevel=3)
    return [(w.names[n][0], a - 1, b) for n, a, b in merged(r for r in which if r[0] in w.names)]


def _read_blocks(spark: SparkSession, blocks: list[tuple[int, int]], run, schema: str) -> DataFrame:
    ways = max(1, min(len(blocks) // 64, 10_000))
    return spark.createDataFrame(blocks, "at long, size long").repartitionByRange(ways, "at").mapInArrow(run, schema)


def scan(spark: SparkSession, path: str, which: list[tuple[str, int, int]] | None = None, columns: list[str] | None = None, missing: str = "error") -> DataFrame:
    """seqnames, start, end, score of a file, clipped to `which`; ranges that overlap or touch count as one.

    columns: ["score"], or [] for places alone, whose values then don't leave the workers. Unknown sequences are an
    error, or with missing="warn" left out. For many ranges join the whole scan with a table of them.
    """
    if columns not in (None, [], ["score"]):
        raise ValueError("columns are score or none")
    with BigWig(path) as w:
        wanted = _wanted(w, which, missing)
        blocks, order, packed = w.blocks(wanted), w.order, w.inflated > 0
        name_of = {number: name for name, (number, _) in w.names.items()}
    scored = columns != []

    def run(batches):
        with open(path.removeprefix("file://"), "rb") as f:
            for batch in batches:
                for at, size in zip(batch.column("at").to_pylist(), batch.column("size").to_pylist()):
                    f.seek(at)
                    body = f.read(size)
                    number, a, b, v = decode(zlib.decompress(body) if packed else body, order)
                    for x, y in [(0, 2**31)] if wanted is None else [r[1:] for r in wanted if r[0] == number]:
                        hit = (a < y) & (b > x)
                        if hit.any():
                            s, e = np.maximum(a[hit], x) + 1, np.minimum(b[hit], y)
                            cols = [pa.array([name_of[number]] * len(s)), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))]
                            yield pa.RecordBatch.from_arrays(cols + [pa.array(v[hit])] * scored, ["seqnames", "start", "end", "score"][: 3 + scored])

    return _read_blocks(spark, blocks, run, SIGNAL if scored else SIGNAL.rpartition(",")[0])


def scan_files(spark: SparkSession, paths: list[str], which: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """file, then as scan: several files as one table."""
    parts = [scan(spark, p, which).select(F.lit(p).alias("file"), "*") for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def scan_zoom(spark: SparkSession, path: str, level: int, reader: type[BigWig] = BigWig) -> DataFrame:
    """seqnames, start, end, valid, min_value, max_value, sum_value, sum_squares of a zoom level, from 0 on."""
    with reader(path) as w:
        blocks, order, packed = w.blocks(None, w.zooms[level][2]), w.order, w.inflated > 0
        name_of = {number: name for name, (number, _) in w.names.items()}
    kind = np.dtype([(c, order + t) for c, t in zip("nabclhsq", ("u4", "u4", "u4", "u4", "f4", "f4", "f4", "f4"))])

    def run(batches):
        with open(path.removeprefix("file://"), "rb") as f:
            for batch in batches:
                for at, size in zip(batch.column("at").to_pylist(), batch.column("size").to_pylist()):
                    f.seek(at)
                    body = f.read(size)
                    r = np.frombuffer(zlib.decompress(body) if packed else body, kind)
                    yield pa.RecordBatch.from_arrays([pa.array([name_of[int(n)] for n in r["n"]]), pa.array((r["a"] + 1).astype(np.int32)), pa.array(r["b"].astype(np.int32)), pa.array(r["c"].astype(np.int64)), *(pa.array(r[c].astype(np.float64)) for c in "lhsq")], [x.split()[0] for x in ZOOM.split(", ")])

    return _read_blocks(spark, blocks, run, ZOOM)


ZOOM = "seqnames string, start int, end int, valid long, min_value double, max_value double, sum_value double, sum_squares double"


# --- writing -----------------------------------------------------------------------------------


def _encode(numbers: dict[str, int], lengths: dict[str, int], slot: int):
    """mapInArrow over sorted features: one row for each data block."""

    def block(name, a, b, v):
        if (b < a).any() or (a[1:] <= b[:-1]).any():
            raise ValueError(f"{name}: features overlap or are empty")
        if a[0] < 1 or b[-1] > lengths[name]:
            raise ValueError(f"{name}: features outside 1-{lengths[name]}")
        if not np.isfinite(v).all():
            raise ValueError(f"{name}: scores must be finite numbers")
        rows = np.empty(len(a), [("a", "<u4"), ("b", "<u4"), ("v", "<f4")])
        rows["a"], rows["b"], rows["v"] = a - 1, b, v
        body = struct.pack("<IIIIIBBH", numbers[name], a[0] - 1, b[-1], 0, 0, BEDGRAPH, 0, len(a)) + rows.tobytes()
        x, w = rows["v"].astype(np.float64), (b - a + 1).astype(np.float64)
        return name, int(a[0] - 1), int(b[-1]), zlib.compress(body), len(body), int(w.sum()), float(x.min()), float(x.max()), float((w * x).sum()), float((w * x * x).sum())

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column("seqnames").to_pylist(), object)
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if lo == hi:
                    continue
                part = np.stack([batch.column(c).slice(lo, hi - lo).cast(pa.float64()).fill_null(float("nan")).to_numpy() for c in ("start", "end", "score")])
                for other in [n for n in held if n != names[lo]]:
                    yield out(other, held.pop(other))
                part = np.concatenate([held.pop(names[lo], part[:, :0]), part], axis=1)
                whole = part.shape[1] // slot * slot
                for i in range(0, whole, slot):
                    yield out(names[lo], part[:, i : i + slot])
                if whole < part.shape[1]:
                    held[names[lo]] = part[:, whole:]
        for name in list(held):
            yield out(name, held.pop(name))

    def out(name, part):
        row = block(name, part[0].astype(np.int64), part[1].astype(np.int64), part[2])
        types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), *[pa.float64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], [x.split()[0] for x in BLOCKS.split(", ")])

    return run


BLOCKS = "seqnames string, first long, last long, body binary, size long, bases long, low double, high double, total double, squares double"


def _index(leaves: list[tuple[int, int, int, int, int, int]], at: int, slot: int, fan: int = 256) -> bytes:
    """The tree over leaves (number, start, number, end, offset, size), to lie at `at` in the file."""
    span = lambda xs: (*min(x[:2] for x in xs), *max(x[2:4] for x in xs))
    levels = [[leaves[i : i + fan] for i in range(0, len(leaves), fan)] or [[]]]
    while len(levels[0]) > 1:
        below = levels[0]
        levels.insert(0, [[(*span(node), i + k) for k, node in enumerate(below[i : i + fan])] for i in range(0, len(below), fan)])
    places, here = [], at + 48
    for depth, level in enumerate(levels):
        width = 32 if depth == len(levels) - 1 else 24
        places.append([])
        for node in level:
            places[-1].append(here)
            here += 4 + width * len(node)
    whole = span(leaves) if leaves else (0, 0, 0, 0)
    out = [struct.pack("<IIQIIIIQII", INDEX, fan, len(leaves), *whole, at, slot, 0)]
    for depth, level in enumerate(levels):
        bottom = depth == len(levels) - 1
        for node in level:
            out.append(struct.pack("<BBH", bottom, 0, len(node)))
            out += [struct.pack("<IIIIQQ", *x) if bottom else struct.pack("<IIIIQ", *x[:4], places[depth + 1][x[4]]) for x in node]
    return b"".join(out)


def _zoom_blocks(numbers: dict[str, int], lengths: dict[str, int], reduction: int, slot: int, compress: bool):
    """mapInArrow over sorted windows: one row for each block of a zoom level."""

    def run(batches):
        for batch in batches:
            names = batch.column("seqnames").to_pylist()
            win, valid = batch.column("win").to_numpy(), batch.column("valid").to_numpy()
            values = [batch.column(c).cast(pa.float64()).to_numpy() for c in ("min_value", "max_value", "sum_value", "sum_squares")]
            edges = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                for i in range(lo, hi, slot):
                    j = min(i + slot, hi)
                    r = np.zeros(j - i, [(c, t) for c, t in zip("nabclhsq", ("<u4", "<u4", "<u4", "<u4", "<f4", "<f4", "<f4", "<f4"))])
                    r["n"], r["a"], r["b"], r["c"] = numbers[names[i]], win[i:j] * reduction, np.minimum((win[i:j] + 1) * reduction, lengths[names[i]]), valid[i:j]
                    for c, v in zip("lhsq", values):
                        r[c] = v[i:j]
                    row = names[i], int(r["a"][0]), int(r["b"][-1]), zlib.compress(r.tobytes()) if compress else r.tobytes(), r.nbytes, int(valid[i:j].sum()), float(values[0][i:j].min()), float(values[1][i:j].max()), float(values[2][i:j].sum()), float(values[3][i:j].sum())
                    types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), *[pa.float64()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], [x.split()[0] for x in BLOCKS.split(", ")])

    return run


def append_blocks(f, rows: DataFrame, encode, numbers: dict[str, int]):
    """Writes the blocks that encode makes of rows; their index entries, the largest one's size inflated, and their sums."""
    leaves, largest, stats, at = [], 0, [0, np.inf, -np.inf, 0.0, 0.0], f.tell()
    with parts.stored(rows, encode, BLOCKS.replace(" body binary,", ""), f.name) as (blocks, files):
        parts.append(f, files)
    for b in blocks:
        leaves.append((numbers[b["seqnames"]], b["first"], numbers[b["seqnames"]], b["last"], at, b["n"]))
        at += b["n"]
        largest = max(largest, b["size"])
        stats = [stats[0] + b["bases"], min(stats[1], b["low"]), max(stats[2], b["high"]), stats[3] + b["total"], stats[4] + b["squares"]]
    return leaves, largest, stats if leaves else [0, 0.0, 0.0, 0.0, 0.0]


def assemble(path: str, signature: int, rows: DataFrame, encode, lengths: dict[str, int], slot: int, zooms: list[tuple[int, DataFrame]], fields: tuple[int, int, bytes] = (0, 0, b""), summary: list | None = None, compress: bool = True) -> None:
    """Writes a file: header, zoom directory, summary, description, names, blocks, index, zoom levels.

    encode makes blocks of the sorted rows. zooms: reduction and windows(seqnames, win, ...) of each level. fields: number of fields, of standard ones among them,
    description. compress: whether blocks are.
    """
    numbers = {n: i for i, n in enumerate(sorted(lengths, key=str.encode))}
    key = max((len(n.encode()) for n in numbers), default=1)
    names = struct.pack("<IIIIQQ", NAMES, max(len(numbers), 1), key, 8, len(numbers), 0) + struct.pack("<BBH", 1, 0, len(numbers))
    names += b"".join(struct.pack(f"<{key}sII", n.encode(), i, lengths[n]) for n, i in numbers.items())
    at_summary = 64 + 24 * len(zooms)
    at_text = at_summary + 40
    text = fields[2] + b"\0" if fields[2] else b""
    data = at_text + len(text) + len(names)
    with open(path.removeprefix("file://"), "w+b") as f:
        f.write(bytes(data + 8))
        leaves, largest, stats = append_blocks(f, rows, encode, numbers)
        for a, b in zip(leaves, leaves[1:]):
            if signature == SIGNATURE and a[0] == b[0] and b[1] < a[3]:
                raise ValueError("features overlap")
        index = f.tell()
        f.write(_index(leaves, index, slot))
        places = []
        for reduction, windows in zooms:
            at = f.tell()
            f.write(bytes(4))
            some, large, _ = append_blocks(f, windows.orderBy("seqnames", "win"), _zoom_blocks(numbers, lengths, reduction, 512, compress), numbers)
            largest = max(largest, large)
            there = f.tell()
            f.write(_index(some, there, 512))
            places.append((reduction, 0, at, there))
        f.seek(0)
        f.write(struct.pack("<IHHQQQHHQQIQ", signature, 4, len(zooms), at_text + len(text), data, index, fields[0], fields[1], at_text if text else 0, at_summary, max(largest, 1) if compress else 0, 0))
        f.write(b"".join(struct.pack("<IIQQ", *p) for p in places))
        f.write(struct.pack("<Qdddd", *(summary or stats)) + text + names + struct.pack("<Q", len(leaves)))


def write(df: DataFrame, path: str, lengths: dict[str, int], slot: int = 1024, zooms: list[int] | None = None) -> None:
    """Writes df(seqnames, start, end, score) as one file; lengths of all sequences are needed.

    Tasks sort, check and compress; the driver joins their parts and keeps an index entry of each block. The features
    are computed once and kept on disk meanwhile.
    zooms: reductions of the zoom levels; if None they follow from the mean width of the features. Errors: overlaps,
    features outside a sequence, scores that are null or not finite, unknown sequences.
    """
    numbers = {n: i for i, n in enumerate(sorted(lengths, key=str.encode))}
    rows = df.select(F.col("seqnames"), F.col("start").cast("long"), F.col("end").cast("long"), F.col("score").cast("double")).persist(StorageLevel.DISK_ONLY)
    try:
        if zooms is None:
            r = rows.agg(F.count("*").alias("n"), F.avg(F.col("end") - F.col("start") + 1).alias("w")).first()
            zooms = zoom_reductions(r["w"], r["n"]) if r["n"] else []
        assemble(path, SIGNATURE, rows.orderBy("seqnames", "start"), _encode(numbers, lengths, slot), lengths, slot, zoom_levels(rows.withColumnRenamed("score", "value"), zooms))
    finally:
        rows.unpersist()


def zoom_levels(signal: DataFrame, reductions: list[int]) -> list[tuple[int, DataFrame]]:
    """Windows of each level, from a finer one where that divides it, else from the signal."""
    out: list[tuple[int, DataFrame]] = []
    for r in sorted(reductions):
        finer = [(q, z) for q, z in out if r % q == 0]
        out.append((r, zoom_again(finer[-1][1], r, finer[-1][0]) if finer else zoom(signal, r)))
    return out


def write_dense(df: DataFrame, path: str, step: int = 1) -> None:
    """Writes df(seqnames, values): the values of all bases of each sequence, whose length is theirs; nulls have no value."""
    rows = df.select("seqnames", F.posexplode("values").alias("i", "score"))
    lengths = {r["seqnames"]: r["n"] * step for r in df.select("seqnames", F.size("values").alias("n")).collect()}
    write(rows.where("score is not null").select("seqnames", (F.col("i") * step + 1).alias("start"), ((F.col("i") + 1) * step).alias("end"), "score"), path, lengths)


def write_runs(runs: DataFrame, path: str) -> None:
    """Writes runs(seqnames, start, end, value) that tile each sequence; a sequence is as long as its last run's end."""
    lengths = {r["seqnames"]: r["n"] for r in runs.groupBy("seqnames").agg(F.max("end").cast("long").alias("n")).collect()}
    write(runs.select("seqnames", "start", "end", F.col("value").alias("score")), path, lengths)


def write_list(df: DataFrame, path: str) -> None:
    """Writes a list of any kind: dense values, runs or features with seqlength, by its columns."""
    if "values" in df.columns:
        return write_dense(df, path)
    if "value" in df.columns:
        return write_runs(df, path)
    raise ValueError("a list has values or runs of value")


def from_wig(lines: DataFrame, path: str, lengths: dict[str, int], clip: bool = False) -> None:
    """Writes the sections of WIG lines(file, ord, value) as a BigWig file.

    Features that reach beyond their sequence, or are of an unknown one, are an error, or with clip cut or left out.
    A fixedStep section without span has spans of its step here.
    """
    from .lines import wig

    # as converters have it, a step without a span is the span
    fixed = F.col("value").rlike(r"^fixedStep\b") & ~F.col("value").rlike(r"\bspan=")
    step = F.regexp_extract("value", r"\bstep=(\d+)", 1)
    signal = wig(lines.withColumn("value", F.when(fixed & (step != ""), F.concat("value", F.lit(" span="), step)).otherwise(F.col("value"))))
    if clip:
        known = signal.sparkSession.createDataFrame(list(lengths.items()), "seqnames string, _size long")
        inside = signal.join(known, "seqnames").where((F.col("start") >= 1) & (F.col("start") <= F.col("_size")))
        signal = inside.withColumn("end", F.least(F.col("end").cast("long"), "_size")).drop("_size")
    write(signal, path, lengths)
