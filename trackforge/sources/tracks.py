"""Track lines and collections of tracks in one text file.

A track line is a record of typed settings. A collection is read as one table of features with the number and the name
of their track, each track parsed by its own format and moved by its offset; or track by track.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.coverage import disjoint, graph_type
from ..operators.genome import padded, shifted
from . import lines as L


@dataclass
class TrackLine:
    """Settings that tracks of any kind have."""

    name: str | None = None
    description: str | None = None
    visibility: str | None = None
    color: tuple[int, int, int] | None = None
    priority: float | None = None
    more: dict[str, str] = field(default_factory=dict)

    @property
    def format(self) -> str:
        return "bed"


@dataclass
class BasicTrackLine(TrackLine):
    itemRgb: bool | None = None
    useScore: bool | None = None
    group: str | None = None
    db: str | None = None
    offset: int | None = None
    url: str | None = None
    htmlUrl: str | None = None
    colorByStrand: tuple[tuple[int, int, int], tuple[int, int, int]] | None = None


@dataclass
class GraphTrackLine(TrackLine):
    altColor: tuple[int, int, int] | None = None
    autoScale: bool | None = None
    alwaysZero: bool | None = None
    gridDefault: bool | None = None
    maxHeightPixels: tuple[int, ...] | None = None
    graphType: str | None = None
    viewLimits: tuple[float, float] | None = None
    yLineMark: float | None = None
    yLineOnOff: bool | None = None
    windowingFunction: str | None = None
    smoothingWindow: float | None = None
    type: str = "wig"

    @property
    def format(self) -> str:
        return self.type


@dataclass
class ArrayTrackLine(TrackLine):
    expNames: tuple[str, ...] | None = None
    expScale: float | None = None
    expStep: float | None = None

    @property
    def format(self) -> str:
        return "bed15"


# How flags are written in track lines, and the names of the types of graphs.
_FLAGS = {"itemRgb": ("off", "on"), "useScore": ("0", "1"), "autoScale": ("off", "on"), "alwaysZero": ("off", "on"), "gridDefault": ("off", "on"), "yLineOnOff": ("off", "on")}
_TYPES = {"wiggle_0": "wig", "array": "bed15", "bedGraph": "bedGraph"}
_NUMBERS = {"priority", "yLineMark", "smoothingWindow", "expScale", "expStep"}
_COLORS = {"color", "altColor"}


def settings(text: str) -> dict[str, str]:
    """Keys and values of a track line; values may be quoted and hold blanks."""
    return {m[1]: m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] for m in re.finditer(r"""(\w+)=(?:"([^"]*)"|'([^']*)'|(\S+))""", text)}


def line_class(form: str) -> type[TrackLine]:
    return {"wig": GraphTrackLine, "bedgraph": GraphTrackLine, "bed15": ArrayTrackLine}.get(form.lower(), BasicTrackLine)


def format_of(text: str, location: str = "") -> str:
    """The format that a track line names, else that of the location's ending, else bed."""
    kind = settings(text).get("type")
    if kind:
        return _TYPES.get(kind, kind)
    return location.lower().removesuffix(".gz").rpartition(".")[2] if "." in location else "bed"


def parse(text: str, form: str | None = None) -> TrackLine:
    """The record of a track line."""
    form = form or format_of(text)
    cls = line_class(form)
    known = {f.name for f in fields(cls)} - {"more"}
    out, more = {}, {}
    for k, v in settings(text).items():
        if k == "type":
            if cls is GraphTrackLine:
                out["type"] = _TYPES.get(v, v)
        elif k not in known:
            more[k] = v
        elif k in _FLAGS:
            out[k] = v.lower() in ("on", "1", "true")
        elif k in _COLORS:
            out[k] = tuple(int(x) for x in v.split(",")[:3])
        elif k in _NUMBERS:
            out[k] = float(v)
        elif k == "offset":
            out[k] = int(v)
        elif k == "colorByStrand":
            out[k] = tuple(tuple(int(y) for y in x.split(",")) for x in v.split()[:2])
        elif k == "viewLimits":
            a, _, b = v.partition(":")
            out[k] = (float(a), float(b))
        elif k == "maxHeightPixels":
            out[k] = tuple(int(x) for x in v.split(":"))
        elif k == "expNames":
            out[k] = tuple(x for x in v.split(",") if x)
        else:
            out[k] = v
    return cls(**out, more=more)


def render(line: TrackLine) -> str:
    """A track line as text; what is None is left out."""
    quoted = lambda v: f'"{v}"'
    number = lambda v: f"{v:g}"
    out = ["track"]
    if isinstance(line, GraphTrackLine):
        out.append("type=" + {"wig": "wiggle_0"}.get(line.type, line.type))
    if isinstance(line, ArrayTrackLine):
        out.append('type="array"')
    for f in fields(line):
        v = getattr(line, f.name)
        if v is None or f.name in ("type", "more"):
            continue
        if f.name in _FLAGS:
            text = _FLAGS[f.name][bool(v)]
        elif f.name in _COLORS:
            text = ",".join(map(str, v))
        elif f.name in _NUMBERS:
            text = number(v)
        elif f.name == "colorByStrand":
            text = quoted(" ".join(",".join(map(str, x)) for x in v))
        elif f.name == "viewLimits":
            text = ":".join(map(number, v))
        elif f.name == "maxHeightPixels":
            text = ":".join(map(str, v))
        elif f.name == "expNames":
            text = quoted(",".join(v) + ",")
        elif f.name in ("name", "description", "url", "htmlUrl"):
            text = quoted(v)
        else:
            text = str(v)
        out.append(f"{f.name}={text}")
    return " ".join(out + [f"{k}={quoted(v) if re.search(r'[^A-Za-z0-9_.:,-]', v) or not v else v}" for k, v in line.more.items()])


# --- reading -----------------------------------------------------------------------------------


def track_lines(lines: DataFrame, most: int = 10_000) -> list[tuple[str, int, str]]:
    """(file, number from 1, line) of the track lines, of which there are few beside data."""
    from pyspark.sql import Window

    marks = lines.where(F.col("value").startswith("track")).select("file", "value", F.row_number().over(Window.partitionBy("file").orderBy("ord")).cast("int").alias("n"))
    rows = marks.orderBy("file", "n").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} tracks; read them as raw lines")
    return [(r["file"], r["n"], r["value"]) for r in rows]


def _parsed(body: DataFrame, form: str, text: str, line: TrackLine) -> DataFrame:
    """Features of a track's lines(value, file, ord)."""
    kind = form.lower()
    if kind in ("bedgraph",):
        return L.bedgraph(body)
    if kind == "wig":
        return L.wig(body)
    if kind == "bed15":
        return L.bed15(body, list(line.expNames or []) if isinstance(line, ArrayTrackLine) else None)
    if kind in ("gff", "gtf", "gff2"):
        return L.gff(body, 2)
    if kind in ("gff3", "gff1"):
        return L.gff(body, int(kind[3]))
    if kind == "narrowpeak":
        return L.narrow_peak(body)
    if kind == "broadpeak":
        return L.broad_peak(body)
    return L.read_bed(body)


def collection(lines: DataFrame, subformat: str = "auto", location: str = "") -> list[tuple[TrackLine, DataFrame]]:
    """The tracks of lines(value, file, ord): the record of each and its features, moved by its offset."""
    carried = L._carried(lines.where(F.trim("value") != ""), F.col("value").startswith("track"))
    out = []
    for file, n, text in track_lines(lines):
        form = format_of(text, location or file) if subformat == "auto" else subformat
        line = parse(text, form)
        body = carried.where((F.col("file") == file) & (F.col("section") == n)).select("value", "file", "ord")
        features = _parsed(body, form, text, line)
        if isinstance(line, BasicTrackLine) and line.offset:
            features = shifted(features, line.offset)
        out.append((line, features))
    return out


def as_features(lines: DataFrame, subformat: str = "auto", location: str = "") -> DataFrame:
    """All tracks of a collection as one table: track (its name or number), then the columns of any of its formats."""
    parts = [df.select(F.lit(line.name if line.name is not None else str(i + 1)).alias("track"), "*") for i, (line, df) in enumerate(collection(lines, subformat, location))]
    return padded(*parts) if parts else lines.sparkSession.createDataFrame([], "track string, seqnames string, start int, end int")


# --- writing -----------------------------------------------------------------------------------


def best_format(df: DataFrame, line: TrackLine | None = None) -> str:
    """bed15, wig, bedGraph or bed: what the track line says, else the kind of graph for scores on one strand."""
    if line is not None and not isinstance(line, BasicTrackLine) and type(line) is not TrackLine:
        return line.format
    if "score" in df.columns and not isinstance(line, BasicTrackLine):
        return graph_type(df)
    return "bed"


def _strands_disjoint(df: DataFrame) -> bool:
    return not disjoint(df if "strand" in df.columns else df.withColumn("strand", F.lit("*"))).where("not is_disjoint").head(1)


def _sorted_lines(df: DataFrame, form: str, line: TrackLine) -> DataFrame:
    """k1, k2, value: the lines of one track in the order of k1, k2."""
    kind = form.lower()
    if kind == "wig":
        return L.wig_lines(df.select("seqnames", "start", "end", "score")).select(F.col("seqnames").alias("k1"), F.col("place").alias("k2"), "value")
    value = L.bedgraph_lines(df) if kind == "bedgraph" else L.bed15_lines(df, list(line.expNames or ())) if kind == "bed15" else L.bed_lines(df.drop("ord"))
    return value.select(F.lit("").alias("k1"), F.monotonically_increasing_id().alias("k2"), "value")


def track_document(df: DataFrame, line: TrackLine | None = None, subformat: str = "auto", number: int = 1) -> DataFrame:
    """track, k1, k2, value: a track line and its features, in the order of these columns.

    Graphs with features on several strands are one track a strand, their names ending in p, m or NA. Graphs whose
    features overlap on a strand become BED, or are an error if the format was asked for. The offset is taken off.
    """
    auto = subformat == "auto"
    form = best_format(df, line) if auto else subformat
    graph = form.lower() in ("wig", "bedgraph")
    if graph and not _strands_disjoint(df):
        if not auto:
            raise ValueError("features overlap on a strand or are empty; no graph can hold them")
        form, graph = "bed", False
    cls = line_class(form)
    line = line or cls()
    if not isinstance(line, cls):
        line = cls(**{f.name: getattr(line, f.name) for f in fields(TrackLine)})
    if isinstance(line, GraphTrackLine):
        line = replace(line, type="bedGraph" if form.lower() == "bedgraph" else "wig")
    if isinstance(line, ArrayTrackLine) and line.expNames is None:
        line = replace(line, expNames=tuple(c for c in df.columns if c not in ("seqnames", "start", "end", "strand", "name", "score", "ord")))
    if isinstance(line, BasicTrackLine) and line.offset:
        df = shifted(df, -line.offset)
    if line.name is None:
        line = replace(line, name=f"Track {number}")
    parts = [("", df)]
    if graph and "strand" in df.columns:
        strands = [r[0] for r in df.select("strand").distinct().orderBy("strand").collect()]
        if len(strands) > 1:
            parts = [(" " + {"+": "p", "-": "m"}.get(s, "NA"), df.where(F.col("strand").eqNullSafe(F.lit(s)))) for s in strands]
    out = []
    for k, (suffix, rows) in enumerate(parts):
        top = df.sparkSession.createDataFrame([(f"{number:08d}.{k}", "", -2, render(replace(line, name=line.name + suffix)))], "track string, k1 string, k2 long, value string")
        out.append(top.union(_sorted_lines(rows, form, line).select(F.lit(f"{number:08d}.{k}").alias("track"), "k1", "k2", "value")))
    return out[0] if len(out) == 1 else out[0].union(out[1]) if len(out) == 2 else out[0].union(out[1]).union(out[2])


def document(tracks: list[tuple[TrackLine | None, DataFrame]], subformat: str = "auto") -> DataFrame:
    """Several tracks as one document."""
    parts = [track_document(df, line, subformat, i + 1) for i, (line, df) in enumerate(tracks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def write(doc: DataFrame, path: str) -> None:
    """A document as text files whose names follow its order."""
    doc.repartitionByRange("track", "k1", "k2").sortWithinPartitions("track", "k1", "k2").select("value").write.text(path)
