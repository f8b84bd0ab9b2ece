"""2bit files: sequences of two bits a base, with runs of N and of lower case kept beside them.

A file is read by its index: a task gets (path, name, start, end) and reads the bytes of that range only, so the ranges
of one file spread over tasks. Ranges are 1-based and closed. Files must lie where driver and executors see them.
Errors: unknown names, ranges outside a sequence, letters other than A, C, G, T and N. A range of no width is empty.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: its signature, and the bases in the order of their codes.
SIGNATURE, BASES = 0x1A412743, b"TCAG"
_CODE = np.full(256, 255, np.uint8)
for _i, _b in enumerate(BASES):
    _CODE[[_b, _b + 32]] = _i
_CODE[[ord("N"), ord("n")]] = 0


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(mask, prepend=False, append=False))
    return edge[::2], edge[1::2] - edge[::2]


def encode(sequences: Iterable[tuple[str, str]]) -> bytes:
    """The file that holds these sequences, in this order."""
    names, bodies = [], []
    for name, seq in sequences:
        label = name.encode()
        if not seq or len(label) > 255:
            raise ValueError(f"{name}: sequences may not be empty, nor names longer than 255 bytes")
        a = np.frombuffer(seq.encode(), np.uint8)
        code = _CODE[a]
        if (code == 255).any():
            raise ValueError(f"{name}: letters other than A, C, G, T and N")
        body = struct.pack("<I", len(a))
        for mask in ((a == ord("N")) | (a == ord("n")), a >= 97):
            start, width = _runs(mask)
            body += struct.pack("<I", len(start)) + start.astype("<u4").tobytes() + width.astype("<u4").tobytes()
        four = np.pad(code, (0, -len(code) % 4)).reshape(-1, 4)
        body += struct.pack("<I", 0) + (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).astype(np.uint8).tobytes()
        names.append(label)
        bodies.append(body)
    at = 16 + sum(5 + len(n) for n in names)
    index = b""
    for n, b in zip(names, bodies):
        index += bytes([len(n)]) + n + struct.pack("<I", at)
        at += len(b)
    if at >= 2**32:
        raise ValueError("a file holds less than 4 GB")
    return struct.pack("<4I", SIGNATURE, 0, len(names), 0) + index + b"".join(bodies)


class TwoBit:
    """An open file."""

    def __init__(self, path: str):
        self.f = open(path.removeprefix("file://"), "rb")
        head = self.f.read(16)
        self.order = next((o for o in "<>" if len(head) == 16 and struct.unpack(o + "I", head[:4])[0] == SIGNATURE), None)
        if self.order is None:
            raise ValueError(f"{path}: not a 2bit file")
        self.places: dict[str, int] = {}
        for _ in range(self._ints(1, head[8:12])[0]):
            name = self.f.read(self.f.read(1)[0]).decode()
            self.places[name] = self._ints(1)[0]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()

    def _ints(self, n: int, data: bytes | None = None) -> np.ndarray:
        return np.frombuffer(data or self.f.read(4 * n), self.order + "u4", n).astype(np.int64)

    def length(self, name: str) -> int:
        if name not in self.places:
            raise ValueError(f"unknown sequence: {name}")
        self.f.seek(self.places[name])
        return int(self._ints(1)[0])

    def read(self, name: str, start: int = 1, end: int | None = None, masked: bool = False) -> str:
        """Bases start to end; lower case where masked, if asked for."""
        size = self.length(name)
        end = size if end is None else end
        if start < 1 or end > size or end < start - 1:
            raise ValueError(f"{name}:{start}-{end} is not within 1-{size}")
        blocks = []
        for _ in range(2):
            n = int(self._ints(1)[0])
            blocks.append((self._ints(n), self._ints(n)) if n else (np.empty(0, np.int64),) * 2)
        self.f.seek(4, 1)
        a, b = start - 1, end
        if a == b:
            return ""
        self.f.seek(a // 4, 1)
        packed = np.frombuffer(self.f.read(-(-b // 4) - a // 4), np.uint8)
        code = (packed[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).reshape(-1)[a % 4 : a % 4 + b - a]
        out = np.frombuffer(BASES, np.uint8)[code]
        for (at, width), lower in zip(blocks, (False, True)):
            for s, w in zip(at[(at < b) & (at + width > a)].tolist(), width[(at < b) & (at + width > a)].tolist()):
                part = slice(max(s - a, 0), min(s + w, b) - a)
                if not lower:
                    out[part] = ord("N")
                elif masked:
                    out[part] += 32
        return out.tobytes().decode()


def seqinfo(spark: SparkSession, path: str) -> DataFrame:
    """seqnames, seqlength, seq_rank of a file."""
    with TwoBit(path) as t:
        rows = [(n, t.length(n), i) for i, n in enumerate(t.places)]
    return spark.createDataFrame(rows, "seqnames string, seqlength long, seq_rank int")


def scan(ranges: DataFrame, path: str, masked: bool = False) -> DataFrame:
    """ranges(seqnames, start, end), all columns, with seq: the bases of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with TwoBit(path) as t:
            for batch in batches:
                places = zip(*(batch.column(c).to_pylist() for c in ("seqnames", "start", "end")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t.read(*p, masked=masked) for p in places], pa.string())], [*batch.schema.names, "seq"])

    return ranges.mapInArrow(run, ranges.limit(0).withColumn("seq", F.lit("")).schema)


def tiles(spark: SparkSession, path: str, width: int = 1 << 20) -> DataFrame:
    """Ranges of at most width bases that tile a file's sequences: what a whole file is read by."""
    first = F.explode(F.sequence(F.lit(1).cast("long"), "seqlength", F.lit(width).cast("long"))).alias("start")
    return seqinfo(spark, path).where("seqlength > 0").select("seqnames", "seqlength", first).select("seqnames", "start", F.least(F.col("start") + width - 1, "seqlength").alias("end"))


def write(df: DataFrame, path: str) -> None:
    """Writes df(name, seq), in the order of ord if there is one, as one file.

    A file is under 4 GB by its format and is put together on the driver; rows come to it one partition at a time.
    """
    rows = df.orderBy("ord") if "ord" in df.columns else df
    body = encode((r["name"], r["seq"]) for r in rows.select("name", "seq").toLocalIterator())
    with open(path.removeprefix("file://"), "wb") as f:
        f.write(body)
