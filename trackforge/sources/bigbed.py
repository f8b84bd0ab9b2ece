"""BigBed files: scans by the index, field lists from the description, look-ups by name, and a writer.

Blocks are dealt out to tasks, which inflate them to places and the text of the other fields; Spark's own expressions
then parse that text, so fields that are not asked for are not parsed. Features come whole, not clipped. Coordinates
are 1-based and closed; legacy=True gives starts as they lie in the file.
"""

from __future__ import annotations

import re
import struct
import warnings
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.text import hex_to_rgb, rgb_to_hex, strand_of
from ..operators.coverage import coverage, zoom_reductions
from ..operators.nest import fold_blocks
from . import bigwig as W
from . import parts

# Fixed values of the format: its signature, and that of its trees of names.
SIGNATURE, TREE = 0x8789F2EB, 0x78CA8C91
STANDARD = ["chrom", "chromStart", "chromEnd", "name", "score", "strand", "thickStart", "thickEnd", "itemRgb", "blockCount", "blockSizes", "chromStarts"]


# --- descriptions ------------------------------------------------------------------------------


@dataclass
class Field:
    name: str
    kind: str
    size: str | None = None  # of a list: a number, or the field that holds it
    comment: str = ""
    indexed: bool = False
    values: tuple[str, ...] = ()  # of an enumeration or a set

    @property
    def spark(self) -> str:
        """The type of its values; lists are text, as are enumerations, sets and objects."""
        if self.size is not None and self.kind != "char":
            return "string"
        return {"float": "double", "double": "double", "uint": "long", "bigint": "long", "int": "int", "short": "int", "ushort": "int", "byte": "int", "ubyte": "short"}.get(self.kind, "string")


@dataclass
class Description:
    kind: str
    name: str
    comment: str
    fields: list[Field]


_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"|([A-Za-z_][\w.]*)|(\d+)|([()\[\];,])|#[^\n]*|\s+')


def describe(text: str) -> Description:
    """A description: table, simple or object, name, comment, and fields with kinds, lists, indexes and comments."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not a description: {text[at : at + 20]!r}")
        at = m.end()
        if m.lastindex:
            tokens.append(("text" if m.lastindex == 1 else "sign" if m.lastindex == 4 else "word", m[m.lastindex]))
    i = 0

    def take(kind: str | None = None, value: str | None = None) -> str:
        nonlocal i
        if i >= len(tokens) or (kind and tokens[i][0] != kind) or (value and tokens[i][1] != value):
            raise ValueError(f"a description lacks {value or kind}")
        i += 1
        return tokens[i - 1][1]

    def sees(value: str) -> bool:
        return i < len(tokens) and tokens[i] == ("sign", value)

    whole = take("word")
    if whole not in ("table", "simple", "object"):
        raise ValueError(f"a description is a table, simple or object, not {whole}")
    out = Description(whole, take("word"), take("text"), [])
    take("sign", "(")
    while not sees(")"):
        f = Field("", take("word"))
        if f.kind in ("simple", "object", "table"):
            f.kind = f"{f.kind} {take('word')}"
        if f.kind in ("enum", "set") and sees("("):
            take()
            values = []
            while not sees(")"):
                if sees(","):
                    take()
                else:
                    values.append(take("word"))
            take()
            f.values = tuple(values)
        if sees("["):
            take()
            f.size = take("word")
            take("sign", "]")
        f.name = take("word")
        while not sees(";"):  # primary, unique, index[n], auto
            f.indexed |= take() in ("primary", "unique", "index")
        take("sign", ";")
        if i < len(tokens) and tokens[i][0] == "text":
            f.comment = take("text")
        out.fields.append(f)
    take("sign", ")")
    return out


def rendered(d: Description) -> str:
    kind = lambda f: f"{f.kind}[{f.size}]" if f.size is not None else f"{f.kind}({', '.join(f.values)})" if f.values else f.kind
    return f'{d.kind} {d.name} "{d.comment}"\n(\n' + "".join(f'{kind(f)} {f.name}; "{f.comment}"\n' for f in d.fields) + ")\n"


# --- reading -----------------------------------------------------------------------------------


class BigBed(W.BigWig):
    signature, kind = SIGNATURE, "BigBed"

    def description(self) -> Description:
        """What the file says of its fields; without that, the standard names."""
        if self.described:
            self.f.seek(self.described)
            text = b""
            while b"\0" not in text and (more := self.f.read(4096)):
                text += more
            return describe(text.partition(b"\0")[0].decode())
        kinds = dict(zip(STANDARD, ("string", "uint", "uint", "string", "uint", "char", "uint", "uint", "uint", "int", "int", "int")))
        return Description("table", "bed", "", [Field(n, kinds[n]) for n in STANDARD[: max(self.fields, 3)]])

    def indexes(self) -> list[tuple[list[int], int]]:
        """Fields and place of each tree of names."""
        if not self.extension:
            return []
        self.f.seek(self.extension)
        _, n, at = self._get("HHQ")
        self.f.seek(at)
        out = []
        for _ in range(n):
            _, fields, place, _ = self._get("HHQI")
            out.append(([self._get("HH")[0] for _ in range(fields)], place))
        return out

    def places_of(self, name: str, tree: int) -> list[tuple[int, int]]:
        """Blocks (offset, size) whose features may have this name, by a tree."""
        self.f.seek(tree)
        magic, _, key, _, _, _ = self._get("IIIIQQ")
        if magic != TREE:
            raise ValueError("damaged tree of names")
        want, found, todo = name.encode()[:key].ljust(key, b"\0"), [], [tree + 32]
        while todo:
            self.f.seek(todo.pop())
            leaf, _, n = self._get("BBH")
            items = [self._get(f"{key}s" + ("QQ" if leaf else "Q")) for _ in range(n)]
            for i, (k, *rest) in enumerate(items):
                if leaf:
                    if k == want:
                        found.append(tuple(rest))
                elif k <= want and (i + 1 == n or items[i + 1][0] >= want):  # equal names may go on in the next leaf
                    todo.append(rest[0])
        return sorted(set(found))


def field_names(path: str) -> tuple[list[str], list[str]]:
    """Names of a file's features as scan gives them: standard ones, and further ones."""
    with BigBed(path) as b:
        d, n = b.description(), b.defined or min(b.fields, 12)
    return _standard(n), [f.name for f in d.fields[n:]]


def _standard(n: int) -> list[str]:
    return [name for name, least in (("name", 4), ("score", 5), ("thick", 8), ("itemRgb", 9), ("blocks", 12)) if n >= least]


def _raw(spark: SparkSession, path: str, blocks: list[tuple[int, int]], wanted, order: str, packed: bool, name_of: dict[int, str]) -> DataFrame:
    """seqnames, first (from 0), end, rest, at, size: features of blocks; zero-width ones meet ranges that they touch."""

    def run(batches):
        with open(path.removeprefix("file://"), "rb") as f:
            for batch in batches:
                for at, size in zip(batch.column("at").to_pylist(), batch.column("size").to_pylist()):
                    f.seek(at)
                    body = f.read(size)
                    body = zlib.decompress(body) if packed else body
                    rows, i = [], 0
                    while i < len(body):
                        number, a, b = struct.unpack_from(order + "III", body, i)
                        j = body.index(b"\0", i + 12)
                        if wanted is None or any(c == number and (a < y and b > x or a == b and (a == y or b == x)) for c, x, y in wanted):
                            rows.append((name_of[number], a, b, body[i + 12 : j].decode(), at, size))
                        i = j + 1
                    if rows:
                        types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["seqnames", "first", "end", "rest", "at", "size"])

    return W._read_blocks(spark, blocks, run, "seqnames string, first int, end int, rest string, at long, size long")


def _columns(d: Description, defined: int, columns: list[str] | None) -> list[Column]:
    """The fields asked for, all if None, of the text after the place."""
    f = F.split("rest", "\t")
    at = lambda i: F.get(f, F.lit(i - 3))
    have = {}
    if defined >= 4:
        have["name"] = at(3)
    if defined >= 5:
        have["score"] = at(4).try_cast("int" if d.fields[4].spark in ("int", "long") else "double")
    if defined >= 8:
        have["thick"] = F.struct((at(6).try_cast("int") + 1).alias("start"), at(7).try_cast("int").alias("end"))
    if defined >= 9:
        number = at(8).try_cast("int")
        have["itemRgb"] = F.when(F.contains(at(8), F.lit(",")), rgb_to_hex(at(8))).otherwise(F.when(number != 0, F.concat(F.lit("#"), F.lpad(F.hex(number), 6, "0"))))
    if defined >= 12:
        have["blocks"] = fold_blocks(at(10), at(11))
    for i, x in enumerate(d.fields[defined:], defined):
        have[x.name] = at(i).try_cast(x.spark)
    if columns is not None and (unknown := [c for c in columns if c not in have]):
        warnings.warn(f"the file has no fields {unknown}", stacklevel=3)
    strand = strand_of(at(5)) if defined >= 6 else F.lit("*")
    return [strand.alias("strand"), *[have[c].alias(c) for c in have if columns is None or c in columns]]


def scan(spark: SparkSession, path: str, which: list[tuple[str, int, int]] | None = None, columns: list[str] | None = None, legacy: bool = False, most: int = 0, missing: str = "warn") -> DataFrame:
    """seqnames, start, end, strand and the fields asked for of the features that meet `which`, or of all.

    Ranges that overlap or touch count as one. most: features at most, in order of place; 0 is all of them. Unknown fields
    are left out with a warning, unknown sequences likewise or with missing="error" an error.
    """
    with BigBed(path) as b:
        wanted = W._wanted(b, which, missing)
        # one base more on both sides, for features of no width
        blocks = b.blocks(None if wanted is None else [(c, max(x - 1, 0), y + 1) for c, x, y in wanted])
        d, order, packed, defined = b.description(), b.order, b.inflated > 0, b.defined or min(b.fields, 12)
        name_of = {number: name for name, (number, _) in b.names.items()}
    rows = _raw(spark, path, blocks, wanted, order, packed, name_of)
    if most:
        rows = rows.orderBy("seqnames", "first", "end").limit(most)
    return rows.select("seqnames", (F.col("first") + (0 if legacy else 1)).alias("start"), "end", *_columns(d, defined, columns))


def by_name(spark: SparkSession, path: str, name: str, field: str = "name") -> DataFrame:
    """Features of this name, by the file's tree of that field."""
    with BigBed(path) as b:
        d, defined = b.description(), b.defined or min(b.fields, 12)
        number = [f.name for f in d.fields].index(field)
        trees = [place for fields, place in b.indexes() if fields == [number]]
        if not trees:
            raise ValueError(f"no index of {field}")
        blocks, order, packed = b.places_of(name, trees[0]), b.order, b.inflated > 0
        name_of = {n: x for x, (n, _) in b.names.items()}
    rows = _raw(spark, path, blocks, None, order, packed, name_of).where(F.get(F.split("rest", "\t"), F.lit(number - 3)) == name)
    return rows.select("seqnames", (F.col("first") + 1).alias("start"), "end", *_columns(d, defined, None))


def seqinfo(spark: SparkSession, path: str) -> DataFrame:
    with BigBed(path) as b:
        rows = [(name, size, number) for name, (number, size) in b.names.items()]
    return spark.createDataFrame(rows, "seqnames string, seqlength long, seq_rank int")


# --- writing -----------------------------------------------------------------------------------

_PLACE = ("seqnames", "start", "end", "strand", "ord")
_OWN = ("name", "score", "thick", "itemRgb", "blocks")


def _level(df: DataFrame) -> int:
    have = set(df.columns)
    return 12 if "blocks" in have else 9 if "itemRgb" in have else 8 if "thick" in have else 6 if "strand" in have else 5 if "score" in have else 4 if "name" in have else 3


def description_of(df: DataFrame) -> Description:
    """What a file of df would say of its fields."""
    known = [("chrom", "string", None, "Reference sequence"), ("chromStart", "uint", None, "Start position"), ("chromEnd", "uint", None, "End position"), ("name", "string", None, "Name of item"), ("score", "uint", None, "Score (0-1000)"), ("strand", "char", "1", "+ or - for strand"), ("thickStart", "uint", None, "Start of the thick part"), ("thickEnd", "uint", None, "End of the thick part"), ("itemRgb", "uint", None, "Color"), ("blockCount", "int", None, "Number of blocks"), ("blockSizes", "int", "blockCount", "Sizes of the blocks"), ("chromStarts", "int", "blockCount", "Starts of the blocks from chromStart")]
    fields = [Field(n, k, s, c) for n, k, s, c in known[: _level(df)]]
    kinds = {"double": "double", "float": "double", "integer": "int", "long": "bigint", "short": "int", "byte": "int"}
    return Description("table", "bed", "Browser Extensible Data", fields + [Field(f.name, kinds.get(f.dataType.typeName(), "string")) for f in df.schema if f.name not in _PLACE + _OWN])


def text_rows(df: DataFrame) -> DataFrame:
    """seqnames, start, end, rest: the text of the fields after the place. Names and colors may not be null, nor scores."""
    have, n = set(df.columns), _level(df)
    if "score" in have and df.schema["score"].dataType.typeName() == "string":
        raise ValueError("scores must be numbers")
    if "blocks" in have and not isinstance(df.schema["blocks"].dataType, ArrayType):
        raise ValueError("blocks must be lists")
    sure = lambda c, x: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} may not be null"))).otherwise(x)
    out = []
    if n >= 4:
        out.append(sure("name", F.col("name").cast("string")) if "name" in have else F.lit("."))
    if n >= 5:
        out.append(sure("score", F.col("score").cast("long").cast("string")) if "score" in have else F.lit("0"))
    if n >= 6:
        out.append(F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise(".") if "strand" in have else F.lit("."))
    if n >= 8:
        a, b = (F.col("thick.start"), F.col("thick.end")) if "thick" in have else (F.col("start"), F.col("end"))
        out += [(a - 1).cast("string"), b.cast("string")]
    if n >= 9:
        out.append(sure("itemRgb", hex_to_rgb(F.col("itemRgb"))) if "itemRgb" in have else F.lit("0"))
    if n >= 12:
        out += [F.size("blocks").cast("string"), F.array_join(F.transform("blocks", lambda x: x["width"].cast("string")), ","), F.array_join(F.transform("blocks", lambda x: (x["start"] - 1).cast("string")), ",")]
    out += [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns if c not in _PLACE + _OWN]
    return df.select("seqnames", F.col("start").cast("long"), F.col("end").cast("long"), (F.concat_ws("\t", *out) if out else F.lit("")).alias("rest"))


def _encode(numbers: dict[str, int], lengths: dict[str, int], slot: int, compress: bool):
    """mapInArrow over sorted rows: blocks of at most slot features of one sequence."""

    def block(name, rows):
        for a, b, _ in rows:
            if a < 1 or b < a - 1 or b > lengths[name]:
                raise ValueError(f"{name}:{a}-{b} is not within 1-{lengths[name]}")
        body = b"".join(struct.pack("<III", numbers[name], a - 1, b) + rest.encode() + b"\0" for a, b, rest in rows)
        out = (name, rows[0][0] - 1, max(r[1] for r in rows), zlib.compress(body) if compress else body, len(body), 0, 0.0, 0.0, 0.0, 0.0)
        types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), *[pa.float64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, types)], [x.split()[0] for x in W.BLOCKS.split(", ")])

    def run(batches):
        name, held = None, []
        for batch in batches:
            for seq, *row in zip(*(batch.column(c).to_pylist() for c in ("seqnames", "start", "end", "rest"))):
                if held and (seq != name or len(held) == slot):
                    yield block(name, held)
                    held = []
                name = seq
                held.append(row)
        if held:
            yield block(name, held)

    return run


def _leaves(key: int, block: int):
    """mapInArrow over sorted (x, at, size): the leaves of a tree of names, of at most block items, with the first name of each."""

    def leaf(held):
        body = struct.pack("<BBH", 1, 0, len(held)) + b"".join(struct.pack(f"<{key}sQQ", x.encode(), a, s) for x, a, s in held)
        return pa.RecordBatch.from_arrays([pa.array([held[0][0]]), pa.array([body.ljust(4 + block * (key + 16), b"\0")], pa.binary())], ["first", "body"])

    def run(batches):
        held = []
        for batch in batches:
            for item in zip(*(batch.column(c).to_pylist() for c in ("x", "at", "size"))):
                held.append(item)
                if len(held) == block:
                    yield leaf(held)
                    held = []
        if held:
            yield leaf(held)

    return run


def _name_tree(f, names: DataFrame, block: int = 256) -> int:
    """Writes a tree over names(x, at, size) at the end of f; returns its place. Tasks write the leaves, the driver keeps the first name of each."""
    r = names.agg(F.count("*").alias("n"), F.max(F.octet_length("x")).alias("k")).first()
    n, key = r["n"], max(r["k"] or 1, 1)
    upper, lower = 4 + block * (key + 8), 4 + block * (key + 16)
    with parts.stored(names.orderBy("x", "at"), _leaves(key, block), "first string", f.name) as (rows, files):
        levels = [[x["first"] for x in rows] or [""]]  # the first name of each node, level by level
        while len(levels[0]) > 1:
            levels.insert(0, levels[0][::block])
        tree, starts = f.tell(), [f.tell() + 32]
        for level in levels[:-1]:
            starts.append(starts[-1] + len(level) * upper)
        f.write(struct.pack("<IIIIQQ", TREE, block, key, 16, n, 0))
        for depth, below in enumerate(levels[1:]):
            wide = lower if depth == len(levels) - 2 else upper
            for i in range(0, len(below), block):
                part = below[i : i + block]
                f.write((struct.pack("<BBH", 0, 0, len(part)) + b"".join(struct.pack(f"<{key}sQ", x.encode(), starts[depth + 1] + (i + j) * wide) for j, x in enumerate(part))).ljust(upper, b"\0"))
        if not rows:
            f.write(struct.pack("<BBH", 1, 0, 0).ljust(lower, b"\0"))
        parts.append(f, files)
    return tree


def write(df: DataFrame, path: str, lengths: dict[str, int], slot: int = 512, compress: bool = True, indexes: tuple[str, ...] = (), zooms: list[int] | None = None) -> None:
    """Writes df(seqnames, start, end, and strand, name, score, thick, itemRgb, blocks or further columns) as one file.

    Tasks sort, check and compress; the driver joins their parts. Zoom levels and the summary are of the depth of
    coverage, which is computed once and kept on disk meanwhile. indexes: fields of text that features can be looked up by.
    """
    if missing := df.select("seqnames").distinct().where(~F.col("seqnames").isin(list(lengths))).limit(1).collect():
        raise ValueError(f"unknown sequence: {missing[0][0]}")
    numbers = {n: i for i, n in enumerate(sorted(lengths, key=str.encode))}
    d, spark = description_of(df), df.sparkSession
    places = [[f.name for f in d.fields].index(x) for x in indexes]
    rows = text_rows(df).orderBy("seqnames", "start", "end")
    depth = coverage(df.where(F.col("end") >= F.col("start"))).persist(StorageLevel.DISK_ONLY)
    w = F.col("end") - F.col("start") + 1
    try:
        r = depth.agg(F.sum(w).alias("valid"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum(w * F.col("value")).alias("s"), F.sum(w * F.col("value") * F.col("value")).alias("q"), F.count("*").alias("n"), F.avg(w).alias("mean")).first()
        summary = [int(r["valid"] or 0), *(float(r[k] or 0) for k in ("lo", "hi", "s", "q"))]
        if zooms is None:
            zooms = zoom_reductions(r["mean"], r["n"]) if r["n"] else []
        W.assemble(path, SIGNATURE, rows, _encode(numbers, lengths, slot, compress), lengths, slot, W.zoom_levels(depth, zooms), (len(d.fields), min(_level(df), 12), rendered(d).encode()), summary, compress)
    finally:
        depth.unpersist()
    if places:
        _add_indexes(spark, path, places)


def _add_indexes(spark: SparkSession, path: str, places: list[int]) -> None:
    """Adds trees of names to a whole file: names are sorted by Spark, and tasks write the leaves."""
    with BigBed(path) as b:
        blocks, order, packed = b.blocks(None), b.order, b.inflated > 0
        name_of = {n: x for x, (n, _) in b.names.items()}
    with open(path.removeprefix("file://"), "r+b") as f:
        f.seek(0, 2)
        trees = []
        for number in places:
            x = F.get(F.split("rest", "\t"), F.lit(number - 3))
            names = _raw(spark, path, blocks, None, order, packed, name_of).select(x.alias("x"), "at", "size").distinct().persist(StorageLevel.DISK_ONLY)
            try:
                trees.append((number, _name_tree(f, names)))
            finally:
                names.unpersist()
        listed = f.tell()
        for number, at in trees:
            f.write(struct.pack("<HHQIHH", 0, 1, at, 0, number, 0))
        extension = f.tell()
        f.write(struct.pack("<HHQ", 64, len(trees), listed).ljust(64, b"\0"))
        f.seek(56)
        f.write(struct.pack("<Q", extension))

