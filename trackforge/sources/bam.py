"""BAM files: scans that are dealt out by blocks, and a writer.

A task gets some of a file's blocks and reads the alignments that begin in them. Where the first of these begins is
found from the data: a place counts if it and the alignments that would follow hold together (lengths, references,
names). Files must lie where driver and executors see them.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bgzf, parts
from .lines import cigar_width

# Fixed values of the format.
MAGIC, OPERATIONS, BASES = b"BAM\1", "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
SCHEMA = "qname string, flag int, seqnames string, start int, mapq int, cigar string, mrnm string, mpos int, isize int, seq string, qual string, tags map<string,string>"
_TAKES = set("MDN=X")
#: About so many tasks at most read a file.
MOST_TASKS = 1024


def header(path: str) -> tuple[str, list[tuple[str, int]], int]:
    """Text, sequences with lengths, and the virtual offset of the first alignment."""
    with open(path.removeprefix("file://"), "rb") as f:
        r = bgzf.Reader(f)
        if r.read(4) != MAGIC:
            raise ValueError(f"{path}: not a BAM file")
        text = r.read(struct.unpack("<i", r.read(4))[0]).rstrip(b"\0").decode()
        refs = []
        for _ in range(struct.unpack("<i", r.read(4))[0]):
            name = r.read(struct.unpack("<i", r.read(4))[0])[:-1].decode()
            refs.append((name, struct.unpack("<i", r.read(4))[0]))
        return text, refs, r.offset


def seqinfo(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(n, size, i) for i, (n, size) in enumerate(header(path)[1])], "seqnames string, seqlength long, seq_rank int")


def _plausible(data: bytes, i: int, refs: list[tuple[str, int]]) -> int:
    """Where the alignment at i ends if it can be one, else -1; 0 if the data end before that can be told."""
    if i + 36 > len(data):
        return 0
    size, ref, pos, n_name, _, _, n_cigar, _, n_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, i)
    if not 32 <= size < 1 << 26 or not -1 <= ref < len(refs) or not -1 <= mate < len(refs) or n_name < 1 or n_seq < 0:
        return -1
    if pos < -1 or mate_pos < -1 or (ref >= 0 and pos > refs[ref][1]) or (mate >= 0 and mate_pos > refs[mate][1]):
        return -1
    if 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq > size:
        return -1
    name = data[i + 36 : i + 36 + n_name]
    if len(name) == n_name and (name[-1] != 0 or any(c < 33 or c > 126 for c in name[:-1])):
        return -1
    return i + 4 + size


def first_record(data: bytes, refs: list[tuple[str, int]], chain: int = 8) -> int:
    """The first place at which alignments begin that follow one another; -1: none."""
    for i in range(len(data) - 3):
        at = i
        for _ in range(chain):
            at = _plausible(data, at, refs)
            if at <= 0 or at >= len(data):
                break
        if at > 0 or (at == 0 and _plausible(data, i, refs) > 0):
            return i
    return -1


def _tags(body: bytes) -> dict[str, str]:
    out, i = {}, 0
    while i + 3 <= len(body):
        name, kind = body[i : i + 2].decode(), chr(body[i + 2])
        i += 3
        if kind in _NUMBERS:
            value = struct.unpack_from("<" + _NUMBERS[kind], body, i)[0]
            i += struct.calcsize(_NUMBERS[kind])
            out[name] = f"{value:g}" if kind == "f" else str(value)
        elif kind == "A":
            out[name] = chr(body[i])
            i += 1
        elif kind in "ZH":
            j = body.index(b"\0", i)
            out[name] = body[i:j].decode()
            i = j + 1
        elif kind == "B":
            sub, n = chr(body[i]), struct.unpack_from("<i", body, i + 1)[0]
            values = struct.unpack_from(f"<{n}{_NUMBERS[sub]}", body, i + 5)
            out[name] = ",".join([sub, *map(str, values)])
            i += 5 + n * struct.calcsize(_NUMBERS[sub])
        else:
            raise ValueError(f"unknown kind of tag: {kind}")
    return out


def decode(body: bytes, refs: list[tuple[str, int]]) -> tuple:
    """The fields of an alignment, of SCHEMA."""
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, mate, mate_pos, isize = struct.unpack_from("<iiBBHHHiiii", body)
    i = 32 + n_name
    name = body[32 : i - 1].decode()
    cigar = "".join(f"{c >> 4}{OPERATIONS[c & 15]}" for c in struct.unpack_from(f"<{n_cigar}I", body, i))
    i += 4 * n_cigar
    half = body[i : i + (n_seq + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in half)[:n_seq]
    i += len(half)
    qual = body[i : i + n_seq]
    i += n_seq
    text = None if not n_seq or qual[0] == 255 else "".join(chr(q + 33) for q in qual)
    at = lambda r: refs[r][0] if r >= 0 else None
    return name if name != "*" else None, flag, at(ref), pos + 1 if pos >= 0 else None, mapq, cigar or None, at(mate), mate_pos + 1, isize, seq or None, text, list(_tags(body[i:]).items())


def scan(spark: SparkSession, path: str, blocks_per_task: int = 256) -> DataFrame:
    """The alignments of a file: SCHEMA, with end and strand. blocks_per_task: at least, if there are many."""
    local = path.removeprefix("file://")
    _, refs, first = header(path)
    with open(local, "rb") as f:
        every = [(at, size) for at, size in bgzf.blocks(f) if at >= first >> 16]
    blocks_per_task = max(blocks_per_task, len(every) // MOST_TASKS)
    parts = [(part[0][0], part[-1][0] + part[-1][1]) for i in range(0, len(every), blocks_per_task) if (part := every[i : i + blocks_per_task])]

    def run(batches):
        with open(local, "rb") as f:
            for batch in batches:
                for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                    yield from part(f, a, b)

    def part(f, a: int, b: int):
        if a == first >> 16:
            r = bgzf.Reader(f, first)
        else:
            data, at, edge = b"", a, None
            while at < b or (edge is None and len(data) < 1 << 26):  # a little beyond the part, to see what follows
                more, to = bgzf.inflate(f, at)
                if to == at:
                    break
                data, at = data + more, to
                if len(data) > 1 << 17 and (found := first_record(data, refs)) >= 0:
                    edge = found
                    break
            skip = first_record(data, refs) if edge is None else edge
            if skip < 0:
                return
            r = bgzf.Reader(f, a << 16)
            r.read(skip)
        rows = []
        while r.more() and r.at < b:
            head = r.read(4)
            if len(head) < 4:
                break
            rows.append(decode(r.read(struct.unpack("<i", head)[0]), refs))
            if len(rows) == 5000:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)

    def out(rows):
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    table = spark.createDataFrame(parts, "a long, b long").repartition(max(1, len(parts)), "a")
    x = table.mapInArrow(run, SCHEMA)
    end = F.col("start") + cigar_width(F.col("cigar")) - 1
    return x.withColumns({"end": end, "strand": F.when(F.col("flag").bitwiseAND(16) > 0, "-").otherwise("+")})


def pairs(alignments: DataFrame) -> DataFrame:
    """name, first, second: the two mates of each name, of alignments that are mapped, paired and primary. Names that have not both are left out.

    Of a name with several pairs, mates belong together that name each other's place, equal ones in order; what is left of
    a name after that is one pair.
    """
    flag = F.col("flag")
    some = alignments.where((flag.bitwiseAND(0x1) > 0) & (flag.bitwiseAND(0x4 | 0x8 | 0x100 | 0x800) == 0))
    mate = F.struct("seqnames", "start", "end", "strand", "cigar", "flag", "mapq")
    own = F.struct("seqnames", "start")
    other = F.struct(F.when(F.col("mrnm") == "=", F.col("seqnames")).otherwise(F.col("mrnm")).alias("seqnames"), F.col("mpos").alias("start"))
    is_first = flag.bitwiseAND(0x40) > 0
    x = some.where(is_first | (flag.bitwiseAND(0x80) > 0)).select(F.col("qname").alias("name"), is_first.alias("_f"), F.when(is_first, own).otherwise(other).alias("_1"), F.when(is_first, other).otherwise(own).alias("_2"), mate.alias("mate"))
    x = x.repartition("name")  # once for all that follows
    x = x.withColumn("_k", F.row_number().over(Window.partitionBy("name", "_1", "_2", "_f").orderBy("mate")))
    met = x.groupBy("name", "_1", "_2", "_k").agg(F.min(F.when(F.col("_f"), F.col("mate"))).alias("first"), F.min(F.when(~F.col("_f"), F.col("mate"))).alias("second"))
    which = F.when(F.col("first").isNotNull() & F.col("second").isNotNull(), F.struct("_1", "_2", "_k"))
    return met.groupBy("name", which.alias("_w")).agg(F.min("first").alias("first"), F.min("second").alias("second")).where("first is not null and second is not null").drop("_w")


def _bin(start: int, end: int) -> int:
    """The smallest bin of the usual scheme that holds [start, end), from 0."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return first + (start >> shift)
    return 0


def encode(line: str, number: dict[str, int]) -> bytes:
    """An alignment of a line of SAM."""
    name, flag, ref, pos, mapq, cigar, mate, mpos, isize, seq, qual, *tags = line.split("\t")
    ops, n, width = [], 0, 0
    for c in cigar if cigar != "*" else "":
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            ops.append(n << 4 | OPERATIONS.index(c))
            width += n if c in _TAKES else 0
            n = 0
    seq = "" if seq == "*" else seq
    codes = [BASES.index(c) if c in BASES else 15 for c in seq.upper()] + [0]
    half = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
    scores = bytes(ord(c) - 33 for c in qual) if qual != "*" else b"\xff" * len(seq)
    more = b""
    for t in tags:
        key, kind, value = t.split(":", 2)
        more += key.encode() + kind.encode() + (struct.pack("<i", int(value)) if kind == "i" else struct.pack("<f", float(value)) if kind == "f" else value.encode() + (b"" if kind == "A" else b"\0"))
    at, label = int(pos) - 1, name.encode() + b"\0"
    mate_at = number.get(ref if mate == "=" else mate, -1)
    body = struct.pack("<iiBBHHHiiii", number.get(ref, -1), at, len(label), int(mapq), _bin(max(at, 0), max(at, 0) + max(width, 1)), len(ops), int(flag), len(seq), mate_at, int(mpos) - 1, int(isize))
    body += label + struct.pack(f"<{len(ops)}I", *ops) + half + scores + more
    return struct.pack("<i", len(body)) + body


def write(lines: DataFrame, path: str, sequences: list[tuple[str, int]]) -> None:
    """Writes lines(value) of SAM, without header, as a file sorted by sequence and start; tasks compress, the driver joins their parts."""
    number = {n: i for i, (n, _) in enumerate(sequences)}
    f = F.split("value", "\t")
    rank = lines.sparkSession.createDataFrame(list(number.items()), "ref string, rank int")
    x = lines.select("value", f[2].alias("ref"), f[3].cast("int").alias("pos")).join(F.broadcast(rank), "ref", "left")
    ordered = x.orderBy(F.col("rank").asc_nulls_last(), "pos", "value").select("value")

    def run(batches):
        held = bytearray()
        for batch in batches:
            for line in batch.column("value").to_pylist():
                held += encode(line, number)
                if len(held) > 1 << 20:
                    cut = len(held) // bgzf.FULL * bgzf.FULL
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(bgzf.packed(held[:cut]))], pa.binary())], ["body"])
                    held = held[cut:]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(bgzf.packed(held))], pa.binary())], ["body"])

    text = "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in sequences).encode()
    head = MAGIC + struct.pack("<i", len(text)) + text + struct.pack("<i", len(sequences)) + b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in sequences)
    with open(path.removeprefix("file://"), "wb") as f_:
        f_.write(b"".join(bgzf.packed(head)))
        with parts.stored(ordered, run, "", path) as (_, files):
            parts.append(f_, files)
        f_.write(bgzf.END)
