"""GFF of all versions: what a whole file means, beyond the single lines that `lines.gff` parses.

lines(value, file, ord) as from `read_lines`. A file's features end where sequences begin: at its first line that
starts with > or is ##FASTA. Directives are the ## lines before a file's first feature. What the driver needs of
them (version, build, species, tags) is little; features stay tables.
"""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType

from ..functions.text import attribute, gff2_attributes, gff3_attribute, gff3_attributes, null_dot, strand_of, url_decode, url_encode, url_encode_except, values
from .parts import ordered

NAMES = ["seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes"]
#: Most distinct tags that columns are made of.
MOST_TAGS = 4096


def _data(lines: DataFrame) -> Column:
    return (F.trim("value") != "") & ~F.col("value").startswith("#")


def _with_cut(lines: DataFrame) -> DataFrame:
    """Lines with the place at which the sequences of their file begin, null if it has none."""
    mark = F.col("value").startswith(">") | F.col("value").rlike(r"^##FASTA\s*$")
    cut = lines.where(mark).groupBy("file").agg(F.min("ord").alias("_cut"))
    return lines.join(cut, "file", "left")


def without_sequences(lines: DataFrame) -> DataFrame:
    """Lines before the sequences of their file."""
    return _with_cut(lines).where("_cut is null or ord < _cut").drop("_cut")


def pragmas(lines: DataFrame) -> DataFrame:
    """The directives of each file: its ## lines before the first feature, or before its sequences."""
    first = lines.where(_data(lines)).groupBy("file").agg(F.min("ord").alias("_first"))
    return without_sequences(lines.where(F.col("value").startswith("#") | F.col("value").startswith(">"))).where(F.col("value").startswith("##")).join(first, "file", "left").where("_first is null or ord < _first").drop("_first")


def _directives(lines: DataFrame, tag: str, most: int = 1000) -> list[str]:
    """What follows the tag in directives of that name, in order; distinct ones of a file or of several."""
    rows = pragmas(lines).where(F.col("value").rlike(rf"^##{tag}\b")).groupBy("value").agg(F.min(F.struct("file", "ord")).alias("at")).orderBy("at").limit(most).select("value").collect()
    return [re.sub(rf"^##{tag}\s*", "", r["value"]).rstrip() for r in rows]


def attribute_style(text: str) -> int:
    """The version whose attributes look like this: 3 for tag=value, 2 for tag value, 1 for a single word, 0 for none of them."""
    piece = text.split(";")[0].strip()
    if not piece:
        return 0
    words = piece.split()
    if "=" in words[0] or (len(words) > 1 and words[1].startswith("=")):
        return 3
    if len(words) > 1:
        return 2
    return 1 if ";" not in text else 0


def sniff_version(lines: DataFrame) -> int:
    """The version that the first ##gff-version names; without one that of the first feature's attributes; 0: unknown."""
    named = list(dict.fromkeys(int(m[0]) for x in _directives(lines, "gff-version") if (m := re.match(r"\d+", x))))
    if len(named) > 1:
        warnings.warn(f"several versions, the first counts: {named}", stacklevel=2)
    if named:
        return named[0]
    first = without_sequences(lines).where(_data(lines)).orderBy("file", "ord").limit(1).collect()
    fields = first[0]["value"].rstrip("\r\n").split("\t") if first else []
    return attribute_style(fields[8]) if len(fields) > 8 else 0


def genome_build(lines: DataFrame) -> tuple[str | None, str | None]:
    """Provider and version of ##genome-build, which are apart by a tab or blanks."""
    for x in _directives(lines, "genome-build"):
        provider, version, *_ = (*re.split(r"\t|\s+", x), None, None)
        return provider, version
    return None, None


def species(lines: DataFrame) -> str | None:
    named = list(dict.fromkeys(_directives(lines, "species")))
    if len(named) > 1:
        raise ValueError(f"several species: {named}")
    return named[0] if named else None


def sequence_regions(lines: DataFrame) -> DataFrame:
    """seqnames, start, end, seqlength, starts_at_one of ##sequence-region; each sequence once, by its furthest end."""
    f = F.split(F.trim(F.regexp_replace("value", r"^##sequence-region\s*", "")), r"\s+")
    rows = pragmas(lines).where(F.col("value").rlike(r"^##sequence-region\b")).select(F.get(f, F.lit(0)).alias("seqnames"), F.get(f, F.lit(1)).try_cast("int").alias("start"), F.get(f, F.lit(2)).try_cast("int").alias("end"))
    return rows.groupBy("seqnames").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("seqnames", "start", "end", F.col("end").cast("long").alias("seqlength"), (F.col("start") == 1).alias("starts_at_one"))


# --- features ----------------------------------------------------------------------------------


def checked_int(c: Column, what: str) -> Column:
    """A 32-bit integer, blanks around it allowed; . is null; anything else is an error that shows the line."""
    text = F.trim(c)
    n = text.try_cast("int")
    return F.when(text.isNull() | (text == ".") | (text == ""), F.lit(None).cast("int")).when(n.isNotNull(), n).otherwise(F.raise_error(F.concat(F.lit(f"{what} is no 32-bit integer: "), F.col("value"))).cast("int"))


def checked_double(c: Column) -> Column:
    """A number, blanks around it allowed; else null."""
    return F.trim(c).try_cast("double")


def _fields(lines: DataFrame, filters: dict[str, list[str]] | None) -> DataFrame:
    """Feature lines split at tabs. Eight or nine columns; a further one may hold only blanks."""
    whole = "file" in lines.columns and "ord" in lines.columns
    body = _with_cut(lines) if whole else lines
    body = body.where(_data(lines)).withColumn("value", F.rtrim("value", F.lit("\r\n")))
    right = F.col("value").rlike(r"^[^\t]*(?:\t[^\t]*){7,8}(?:\t\s*)?$")
    # one condition with the cut, so that the check can't move before it
    checked = F.when(right, True).otherwise(F.raise_error(F.concat(F.lit("not 8 or 9 columns: "), F.col("value"))).cast("boolean"))
    body = body.where(F.when(F.expr("ord >= _cut"), False).otherwise(checked)).drop("_cut") if whole else body.where(checked)
    # through a generator, so that the optimiser doesn't split a line again for each column
    body = body.withColumn("f", F.explode(F.array(F.split("value", "\t"))))
    for name, allowed in (filters or {}).items():
        if name not in NAMES[:8]:
            raise ValueError(f"no filter by {name}")
        body = body.where(F.get("f", F.lit(NAMES.index(name))).isin(allowed))
    return body


def tags_of(lines: DataFrame, version: int) -> list[tuple[str, bool]]:
    """The tags of all features in the order in which they first occur, and whether a value of each has a comma."""
    a = (gff3_attributes if version == 3 else gff2_attributes)(F.get("f", F.lit(8)))
    x = _fields(lines, None).select("file", "ord", F.posexplode(a).alias("pos", "a"))
    found = x.groupBy(F.col("a.tag").alias("tag")).agg(F.min(F.struct("file", "ord", "pos")).alias("at"), F.max(F.contains("a.value", F.lit(","))).alias("comma"))
    rows = found.orderBy("at").limit(MOST_TAGS + 1).select("tag", "comma").collect()
    if len(rows) > MOST_TAGS:
        raise ValueError(f"more than {MOST_TAGS} tags; name those that are wanted")
    return [(r["tag"], r["comma"]) for r in rows]


def _with_commas(lines: DataFrame, tags: list[str]) -> list[tuple[str, bool]]:
    """These tags of GFF3, and whether any value of each has a comma."""
    a = F.get("f", F.lit(8))
    r = _fields(lines, None).agg(*[F.max(a.rlike(rf"(?s)(?:^|;) *\Q{t}\E=[^;]*,")).alias(f"c{i}") for i, t in enumerate(tags)]).first()
    return [(t, bool(r[i])) for i, t in enumerate(tags)]


def read(lines: DataFrame, version: int = 0, columns: list[str] | None = None, tags: list[str] | None = None, filters: dict[str, list[str]] | None = None, nrows: int = -1, raw: bool = False) -> DataFrame:
    """The features of lines(value, file, ord).

    version 0 is found out. columns: of NAMES, all if None. tags: attributes that become columns, all of them if None;
    with [] the attributes stay one column. filters: allowed raw texts by column. nrows: rows at most, the first in
    order. raw: all columns as the text they are. Tags of GFF3 with a comma in any value are arrays; values are decoded.
    """
    version = version or sniff_version(lines) or 3
    if columns is not None and (len(set(columns)) != len(columns) or not set(columns) <= set(NAMES)):
        raise ValueError(f"columns must be some of {NAMES}, each once")
    f = _fields(lines, filters)
    if nrows >= 0:
        f = f.orderBy("file", "ord").limit(nrows)
    at = lambda name: F.get("f", F.lit(NAMES.index(name)))
    if raw:
        every = {n: at(n) for n in NAMES}
    else:
        every = {n: null_dot(at(n)) for n in ("seqid", "source", "type", "attributes")} | {n: checked_int(at(n), n) for n in ("start", "end", "phase")} | {"score": checked_double(at("score")), "strand": strand_of(at("strand"))}
    own = [n for n in (columns or NAMES) if n != "attributes"]
    out = [every[n].alias("seqnames" if n == "seqid" and not raw else n) for n in own]
    if version == 1:
        return f.select(*out, every["attributes"].alias("group"))
    wanted = [(t, False) for t in tags] if tags is not None else tags_of(lines, version) if columns is None or "attributes" in columns else []
    if tags is not None and version == 3 and tags:
        wanted = _with_commas(lines, tags)
    if not wanted:
        return f.select(*out, *([every["attributes"].alias("attributes")] if columns is None or "attributes" in columns else []))
    found = (lambda t: gff3_attribute(at("attributes"), t)) if version == 3 else (lambda t: attribute(F.col("a"), t))
    one = lambda t, many: found(t) if raw else values(found(t)) if many and version == 3 else url_decode(found(t))
    f = f if version == 3 else f.withColumn("a", gff2_attributes(at("attributes")))
    return f.select(*out, *[one(t, many).alias(t or "__empty_tag__") for t, many in wanted])


# --- writing -----------------------------------------------------------------------------------

_BUILT_IN = {"seqnames", "start", "end", "strand", "type", "score", "phase", "source", "group", "ord"}


def _pair(df: DataFrame, tag: str, version: int) -> Column:
    kind = df.schema[tag].dataType
    code = (lambda c: url_encode(c, "%\t\n\r;=&,")) if version == 3 else (lambda c: c)
    if isinstance(kind, ArrayType):  # nulls inside are dots, empty arrays are left out
        text = F.when(F.size(tag) > 0, F.array_join(F.transform(tag, lambda x: F.coalesce(code(F.trim(x.cast("string"))), F.lit("."))), ","))
        kind = kind.elementType
    else:
        text = code(F.trim(F.col(tag).cast("string")))
    if version == 3:
        return F.concat(F.lit(f"{tag}="), text)
    return F.concat(F.lit(f"{tag} "), text) if isinstance(kind, NumericType) else F.concat(F.lit(f'{tag} "'), text, F.lit('"'))


def body_lines(df: DataFrame, version: int = 3, source: str = "trackforge", tags: list[str] | None = None) -> DataFrame:
    """part, value: lines of features; part is 1 for those with attributes, which come first, and 2 for those without."""
    have = df.columns
    tags = [c for c in have if c not in _BUILT_IN] if tags is None else tags
    text = lambda c, default=".": F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in have else F.lit(default)
    name = url_encode_except(F.col("seqnames"), r"[a-zA-Z0-9.:^*$@!+_?|\-]") if version == 3 else F.col("seqnames")
    src = text("source", source)
    strand = F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise(".") if "strand" in have else F.lit(".")
    if version == 1:
        attrs = text("group") if "group" in have else F.col("seqnames")
    else:
        attrs = F.nullif(F.array_join(F.filter(F.array(*[_pair(df, t, version) for t in tags]), lambda x: x.isNotNull()), ";" if version == 3 else "; "), F.lit("")) if tags else F.lit(None).cast("string")
    line = F.concat_ws("\t", name, url_encode(src, "\t\n\r;=%&,") if version == 3 else src, text("type", "sequence_feature"), F.col("start").cast("string"), F.col("end").cast("string"), text("score"), strand, text("phase"), attrs)
    return df.select(F.when(attrs.isNotNull(), 1).otherwise(2).alias("part"), line.alias("value"))


def header(version: int = 3, genome: str | None = None, date: str | None = None, source_version: tuple[str, str] | None = None) -> list[str]:
    out = [f"##gff-version {version}"]
    if source_version:
        out.append("##source-version " + " ".join(source_version))
    if date:
        out.append(f"##date {date}")
    if genome:
        out.append(f"##genome-build .\t{genome}")
    return out


def document(df: DataFrame, version: int = 3, source: str = "trackforge", tags: list[str] | None = None, genome: str | None = None, date: str | None = None, source_version: tuple[str, str] | None = None) -> DataFrame:
    """part, value: a whole file, in order of part: directives (0), features with attributes, features without."""
    top = df.sparkSession.createDataFrame([(0, x) for x in header(version, genome, date, source_version)], "part int, value string")
    return top.coalesce(1).union(body_lines(df, version, source, tags))


def grouped_document(df: DataFrame, group: str, version: int = 3, parent: str = "mRNA", child: str = "exon") -> DataFrame:
    """A file of groups as parents and children; version 3 only."""
    from ..operators.nest import as_gff

    if version != 3:
        raise ValueError("groups are written as GFF3 only")
    return document(as_gff(df, group, parent, child), 3)


def as_gtf(df: DataFrame, group: str) -> DataFrame:
    """Rows of GTF for the coding parts of transcripts: CDS with frame, and the first and last three bases as codons.

    df(seqnames, start, end, strand, group). Codons may be split over parts. On the minus strand a transcript begins at
    its greatest position. A transcript on several sequences or strands is an error.
    """
    width = F.col("end") - F.col("start") + 1
    forward = F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))
    w = Window.partitionBy(group).orderBy(forward, "end")
    x = df.withColumns({"_before": F.coalesce(F.sum(width).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum(width).over(Window.partitionBy(group))})
    place, of = F.struct("seqnames", "strand"), Window.partitionBy(group)
    mixed = F.min(place).over(of) != F.max(place).over(of)
    x = x.withColumn("start", F.when(mixed, F.raise_error(F.lit("a transcript has several sequences or strands")).cast("int")).otherwise(F.col("start")))
    cds = x.select("seqnames", "start", "end", "strand", F.lit("CDS").alias("type"), (F.col("_before") % 3).cast("int").alias("frame"), F.col(group).cast("string").alias("transcript_id"))

    def codon(kind: str, first: Column, last: Column) -> DataFrame:
        a, b = F.greatest(first, F.col("_before") + 1) - F.col("_before"), F.least(last, F.col("_before") + width) - F.col("_before")
        start = F.when(F.col("strand") == "-", F.col("end") - b + 1).otherwise(F.col("start") + a - 1)
        return x.where(a <= b).select("seqnames", start.cast("int").alias("start"), (start + b - a).cast("int").alias("end"), "strand", F.lit(kind).alias("type"), ((F.col("_before") + a - first) % 3).cast("int").alias("frame"), F.col(group).cast("string").alias("transcript_id"))

    return codon("start_codon", F.lit(1), F.lit(3)).union(codon("stop_codon", F.greatest(F.col("_all") - 2, F.lit(1)), F.col("_all"))).union(cds)


def write(spark: SparkSession, doc: DataFrame, path: str) -> None:
    """Writes a document as text files whose names follow the order of its parts."""
    ordered(doc, "part").write.text(path)
