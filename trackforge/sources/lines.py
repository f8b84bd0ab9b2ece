"""Readers and writers of line formats, as functions of a table of lines.

lines(value): from `read_lines` or built. The parsers are projections of one line each, so column pruning reaches
them and reads are split as Spark likes. Formats that carry state from line to line (WIG, track collections, chains)
take lines with (file, ord) and carry the last declaration forward within a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import attribute, gff2_attributes, gff3_attribute, gff3_attributes, hex_to_rgb, null_dot, rgb_to_hex, strand_of, track_line
from ..operators.nest import fold_blocks


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, ord: the lines of text files; ord follows the order within a file."""
    df = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    # within a split ids ascend, and splits of a file are told apart by where they start
    return df.select("value", F.col("file_path").alias("file"), F.struct("file_block_start", F.monotonically_increasing_id().alias("id")).alias("ord"))


BED = ["name", "score", "strand", "thickStart", "thickEnd", "itemRgb", "blockCount", "blockSizes", "blockStarts"]


def _fields(lines: DataFrame, pattern: str = "\t") -> DataFrame:
    keep = (F.trim("value") != "") & ~F.col("value").rlike("^(#|track|browser)")
    by_tabs = F.split("value", "\t")
    return lines.where(keep).withColumn("f", F.when(F.contains("value", F.lit("\t")), by_tabs).otherwise(F.split(F.trim("value"), r"\s+")) if pattern == "\t" else F.split("value", pattern))


def _int(i: int) -> Column:
    """A coordinate: anything but a 32-bit integer is an error that shows the line."""
    x = F.trim(F.get("f", F.lit(i)))
    n = x.try_cast("int")
    return F.when(n.isNotNull() | x.isNull() | (x == "."), n).otherwise(F.raise_error(F.concat(F.lit(f"column {i + 1} is no 32-bit integer: "), F.col("value"))).cast("int"))


def _text(i: int) -> Column:
    return null_dot(F.get("f", F.lit(i)))


def _double(i: int) -> Column:
    return F.trim(F.get("f", F.lit(i))).try_cast("double")


def bed_columns(lines: DataFrame) -> int:
    """Columns of the first data line: tabs part them, or runs of blanks if there are no tabs."""
    first = _fields(lines).select("value")
    first = first.limit(1) if "ord" not in lines.columns else _fields(lines).orderBy("file", "ord").select("value").limit(1)
    rows = first.collect()
    return len(rows[0]["value"].split("\t") if "\t" in rows[0]["value"] else rows[0]["value"].split()) if rows else 3


def read_bed(lines: DataFrame, extra: dict[str, str] | None = None, names: list[str] | None = None) -> DataFrame:
    """BED whose number of columns its first data line tells; the last of them are `extra`.

    names: columns that are wanted beside the place: of BED's own (thick and blocks as one each) and of extra; strand is *
    unless it is among them. Unknown names are an error, as are more extra columns than there are.
    """
    n = bed_columns(lines) - len(extra or {})
    if n < 3 or set(extra or {}) & {"seqnames", "start", "end", "width", "strand"}:
        raise ValueError("no such extra columns")
    whole = bed(lines, min(n, 12), extra)
    if names is None:
        return whole
    if set(names) - set(whole.columns):
        raise ValueError(f"unknown columns: {sorted(set(names) - set(whole.columns))}")
    strand = F.col("strand") if "strand" in names else F.lit("*").alias("strand")
    return whole.select("seqnames", "start", "end", strand, *[c for c in names if c not in ("seqnames", "start", "end", "strand")])


def bed(lines: DataFrame, columns: int = 12, extra: dict[str, str] | None = None, *keep: str) -> DataFrame:
    """BED with the given number of columns, then extra ones by name and type; thick, itemRgb and blocks are folded."""
    f = _fields(lines)
    out = [F.get("f", F.lit(0)).alias("seqnames"), (_int(1) + 1).alias("start"), _int(2).alias("end")]
    if columns >= 4:
        out.append(_text(3).alias("name"))
    if columns >= 5:
        out.append(_double(4).alias("score"))
    out.append((strand_of(F.get("f", F.lit(5))) if columns >= 6 else F.lit("*")).alias("strand"))
    if columns >= 8:
        out.append(F.struct((_int(6) + 1).alias("start"), _int(7).alias("end")).alias("thick"))
    if columns >= 9:
        out.append(rgb_to_hex(F.get("f", F.lit(8))).alias("itemRgb"))
    if columns >= 12:
        out.append(fold_blocks(F.get("f", F.lit(10)), F.get("f", F.lit(11))).alias("blocks"))
    for i, (name, kind) in enumerate((extra or {}).items()):
        out.append(null_dot(F.get("f", F.lit(columns + i))).try_cast(kind).alias(name))
    return f.select(*keep, *out)


def bedgraph(lines: DataFrame) -> DataFrame:
    return _fields(lines, r"\s+").select(F.get("f", F.lit(0)).alias("seqnames"), (_int(1) + 1).alias("start"), _int(2).alias("end"), _double(3).alias("score"))


NARROW = {"signalValue": "double", "pValue": "double", "qValue": "double", "peak": "int"}
BROAD = {"signalValue": "double", "pValue": "double", "qValue": "double"}


def narrow_peak(lines: DataFrame) -> DataFrame:
    return bed(lines, 6, NARROW)


def broad_peak(lines: DataFrame) -> DataFrame:
    return bed(lines, 6, BROAD)


def bed15_names(lines: DataFrame) -> list[str]:
    """The experiments of lines(value, file, ord): the names of the track line in the order of the first row's ids.

    Rows whose ids are others than the first's are an error.
    """
    line = lines.where(F.col("value").startswith("track")).orderBy("file", "ord").limit(1).collect()
    ids = _fields(lines).select(F.regexp_replace(F.get("f", F.lit(13)), ",$", "").alias("ids"))
    found = [r["ids"] for r in ids.distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError("rows have different experiments")
    at = [int(x) for x in found[0].split(",")] if found and found[0] else []
    named = line[0]["value"].partition('expNames="')[2].partition('"')[0].rstrip(",").split(",") if line else []
    return [named[i] if i < len(named) and named[i] else f"exp{i + 1}" for i in at]


def bed15(lines: DataFrame, experiments: list[str] | None = None) -> DataFrame:
    """BED15: one column of scores for each experiment, named by the track line unless names are given; -10000 is null."""
    experiments = bed15_names(lines) if experiments is None else experiments
    f = _fields(lines)
    scores = F.split(F.get("f", F.lit(14)), ",")
    value = lambda i: F.nullif(F.get(scores, F.lit(i)).try_cast("double"), F.lit(-10000.0))
    return f.select(F.get("f", F.lit(0)).alias("seqnames"), (_int(1) + 1).alias("start"), _int(2).alias("end"), _text(3).alias("name"), *[value(i).alias(e) for i, e in enumerate(experiments)])


def bedpe(lines: DataFrame) -> DataFrame:
    mate = lambda k, s: F.struct(F.get("f", F.lit(3 * k)).alias("seqnames"), (_int(3 * k + 1) + 1).alias("start"), _int(3 * k + 2).alias("end"), strand_of(F.get("f", F.lit(s))).alias("strand"))
    return _fields(lines).select(mate(0, 8).alias("first"), mate(1, 9).alias("second"), _text(6).alias("name"), _double(7).alias("score"))


def gff(lines: DataFrame, version: int = 3, tags: list[str] | None = None, filters: dict[str, list[str]] | None = None) -> DataFrame:
    """GFF: the nine columns; attributes as an array of (tag, value), or the given tags as columns. Filters apply to raw text."""
    from .gff import _fields, checked_int

    f = _fields(lines, filters)
    a = (gff3_attributes if version == 3 else gff2_attributes)(F.get("f", F.lit(8)))
    out = [F.get("f", F.lit(0)).alias("seqnames"), _text(1).alias("source"), _text(2).alias("type"), checked_int(F.get("f", F.lit(3)), "start").alias("start"), checked_int(F.get("f", F.lit(4)), "end").alias("end"), _double(5).alias("score"), strand_of(F.get("f", F.lit(6))).alias("strand"), checked_int(F.get("f", F.lit(7)), "phase").alias("phase")]
    if version == 1:
        return f.select(*out, _text(8).alias("group"))
    if tags is None:
        return f.select(*out, a.alias("attributes"))
    if version == 3:
        return f.select(*out, *[gff3_attribute(F.get("f", F.lit(8)), t).alias(t) for t in tags])
    return f.withColumn("a", a).select(*out, *[attribute(F.col("a"), t).alias(t) for t in tags])


def gff_tags(lines: DataFrame, version: int = 3) -> DataFrame:
    """tag, n, has_comma of all attributes."""
    x = gff(lines, version).select(F.explode("attributes").alias("a"))
    return x.groupBy(F.col("a.tag").alias("tag")).agg(F.count("*").alias("n"), F.max(F.contains("a.value", F.lit(","))).alias("has_comma"))


def _carried(lines: DataFrame, mark: Column) -> DataFrame:
    """Lines with the last declaration before them in their file, the number of their section and their place in it.

    Lines are counted by the parts of their file (splits as they were read, or stretches of ord), and what a part needs
    of those before it, their numbers of lines and sections and the last declaration, is handed on from part to part.
    """
    part = F.col("ord.file_block_start") if lines.schema["ord"].dataType.typeName() == "struct" else F.floor(F.col("ord") / (1 << 16))
    inside = Window.partitionBy("file", "_part").orderBy("ord")
    x = lines.withColumns({"_part": part, "_mark": mark}).withColumn("_n", F.row_number().over(inside))
    here = F.when(F.col("_mark"), F.struct(F.col("_n").cast("long").alias("n"), F.col("value").alias("decl")))
    until = inside.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"_last": F.last(here, ignorenulls=True).over(until), "_k": F.sum(F.col("_mark").cast("long")).over(until)})
    of = x.groupBy("file", "_part").agg(F.count("*").alias("rows"), F.sum(F.col("_mark").cast("long")).alias("marks"), F.max(here).alias("l"))
    before = Window.partitionBy("file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    of = of.withColumns({"_rows": F.coalesce(F.sum("rows").over(before), F.lit(0)), "_marks": F.coalesce(F.sum("marks").over(before), F.lit(0))})
    of = of.withColumn("_far", F.last(F.when(F.col("l").isNotNull(), F.struct((F.col("_rows") + F.col("l.n")).alias("n"), F.col("l.decl").alias("decl"))), ignorenulls=True).over(before))
    x = x.join(of.select("file", "_part", "_rows", "_marks", "_far"), ["file", "_part"])
    at = F.coalesce(F.col("_rows") + F.col("_last.n"), F.col("_far.n"), F.lit(0))
    x = x.withColumns({"section": F.col("_marks") + F.col("_k"), "decl": F.coalesce("_last.decl", "_far.decl"), "place": (F.col("_rows") + F.col("_n") - at - 1).cast("int")})
    return x.where(~F.col("_mark")).drop("_part", "_mark", "_n", "_last", "_k", "_rows", "_marks", "_far")


def wig(lines: DataFrame, names: list[str] | None = None) -> DataFrame:
    """WIG of lines(value, file, ord): variableStep and fixedStep sections; lines without a declaration are bedGraph.

    names: sequences that are wanted; sections of others are left out before their data are parsed.
    """
    body = lines.where(~F.col("value").rlike("^(#|track|browser)") & (F.trim("value") != ""))
    x = _carried(body, F.contains("value", F.lit("chrom=")))
    of = lambda k: F.regexp_extract("decl", rf"\b{k}=(\S+)", 1)
    v = F.split(F.trim("value"), r"\s+")
    bare = F.col("decl").isNull()
    if names is not None:
        x = x.where(F.when(bare, v[0]).otherwise(of("chrom")).isin(names))
    span = F.coalesce(of("span").try_cast("int"), F.lit(1))
    fixed = F.col("decl").startswith("fixedStep")
    start = F.when(bare, F.get(v, F.lit(1)).try_cast("int") + 1).when(fixed, of("start").try_cast("int") + F.col("place") * F.coalesce(of("step").try_cast("int"), F.lit(1))).otherwise(v[0].try_cast("int"))
    end = F.when(bare, F.get(v, F.lit(2)).try_cast("int")).otherwise(F.col("start") + span - 1)
    score = F.when(bare, F.get(v, F.lit(3))).when(fixed, F.trim("value")).otherwise(F.get(v, F.lit(1))).try_cast("double")
    return x.withColumn("start", start).select(F.when(bare, v[0]).otherwise(of("chrom")).alias("seqnames"), "start", end.alias("end"), score.alias("score"))


def ucsc(lines: DataFrame) -> DataFrame:
    """Lines of a track collection with the attributes of their track."""
    x = _carried(lines.where(F.trim("value") != ""), F.col("value").startswith("track"))
    return x.select("file", F.col("section").alias("track_id"), track_line(F.col("decl")).alias("track"), "ord", "value")


def chain(lines: DataFrame, exclude: str = "_") -> DataFrame:
    """Blocks of chains: from_name, from_start, width, offset, to_name, score, reversed."""
    body = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    x = _carried(body, F.col("value").startswith("chain"))
    d, v = F.split("decl", r"\s+"), F.split(F.trim("value"), r"\s+")
    x = x.withColumns({"d": d, "size": v[0].try_cast("int"), "dt": F.coalesce(F.get(v, F.lit(1)).try_cast("int"), F.lit(0)), "dq": F.coalesce(F.get(v, F.lit(2)).try_cast("int"), F.lit(0))})
    before = Window.partitionBy("file", "section").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    t = F.coalesce(F.sum(F.col("size") + F.col("dt")).over(before), F.lit(0)) + x["d"][5].try_cast("long")
    q = F.coalesce(F.sum(F.col("size") + F.col("dq")).over(before), F.lit(0)) + x["d"][10].try_cast("long")
    x = x.withColumns({"t": t, "q": q})
    n = lambda i: F.get("d", F.lit(i))
    t1 = F.when(n(4) == "+", F.col("t") + 1).otherwise(n(3).try_cast("long") - F.col("t") - F.col("size") + 1)
    q1 = F.when(n(9) == "+", F.col("q") + 1).otherwise(n(8).try_cast("long") - F.col("q") - F.col("size") + 1)
    out = x.select(n(2).alias("from_name"), t1.alias("from_start"), F.col("size").alias("width"), (t1 - q1).alias("offset"), n(7).alias("to_name"), n(1).try_cast("int").alias("score"), (n(4) != n(9)).alias("reversed"))
    return out.where(~F.contains("from_name", F.lit(exclude)) & ~F.contains("to_name", F.lit(exclude))) if exclude else out


def fasta(records: DataFrame) -> DataFrame:
    """name, seq of records(value): the text between > signs."""
    r = records.where(F.trim("value") != "")
    return r.select(F.substring_index(F.substring_index("value", "\n", 1), " ", 1).alias("name"), F.regexp_replace(F.substr("value", F.instr("value", "\n") + 1), r"\s", "").alias("seq"))


# --- writers -----------------------------------------------------------------------------------


def _str(c: Column, kind: str = "string") -> Column:
    return F.coalesce(c.cast(kind).cast("string") if kind != "string" else c.cast("string"), F.lit("."))


def bed_lines(df: DataFrame) -> DataFrame:
    """BED lines of features; columns to the left of one that is there are filled in."""
    have = set(df.columns)
    level = 12 if "blocks" in have else 9 if "itemRgb" in have else 8 if "thick" in have else 6 if "strand" in have else 5 if "score" in have else 4 if "name" in have else 3
    out = [F.col("seqnames"), (F.col("start") - 1).cast("string"), F.col("end").cast("string")]
    if level >= 4:
        out.append(_str(F.col("name")) if "name" in have else F.lit("."))
    if level >= 5:
        out.append(F.col("score").cast("string") if "score" in have else F.lit("0"))
    if level >= 6:
        out.append(F.when(F.col("strand") == "*", ".").otherwise(F.col("strand")) if "strand" in have else F.lit("."))
    if level >= 8:
        out += [(F.col("thick.start") - 1).cast("string"), F.col("thick.end").cast("string")] if "thick" in have else [(F.col("start") - 1).cast("string"), F.col("end").cast("string")]
    if level >= 9:
        out.append(hex_to_rgb(F.col("itemRgb")) if "itemRgb" in have else F.lit("0"))
    if level >= 12:
        last = F.element_at("blocks", -1)
        bad = (F.col("blocks")[0]["start"] != 1) | (F.col("start") + last["start"] + last["width"] - 2 != F.col("end"))
        count = F.when(bad, F.raise_error(F.lit("blocks must start at the feature's start and end at its end"))).otherwise(F.size("blocks").cast("string"))
        out += [count, F.array_join(F.transform("blocks", lambda b: b["width"].cast("string")), ","), F.array_join(F.transform("blocks", lambda b: (b["start"] - 1).cast("string")), ",")]
    return df.select(F.concat_ws("\t", *out).alias("value"))


def bedgraph_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\t", "seqnames", (F.col("start") - 1).cast("string"), F.col("end").cast("string"), F.coalesce(F.col("score").cast("string"), F.lit("0"))).alias("value"))


def gff_lines(df: DataFrame, tags: list[str], version: int = 3, source: str = "trackforge") -> DataFrame:
    """GFF lines; attributes that are null are left out."""
    from .gff import body_lines

    return body_lines(df.drop("source", "group"), version, source, tags).select("value")


def bed15_lines(df: DataFrame, experiments: list[str]) -> DataFrame:
    """BED15 lines: blocks, if there are none, are the feature itself; scores that are null are -10000."""
    have = set(df.columns)
    start, end = (F.col("start") - 1).cast("string"), F.col("end").cast("string")
    scores = F.concat_ws(",", *[F.coalesce(F.col(e).cast("double"), F.lit(-10000.0)).cast("string") for e in experiments])
    name = _str(F.col("name")) if "name" in have else F.lit(".")
    score = F.coalesce(F.col("score").cast("string"), F.lit("0")) if "score" in have else F.lit("0")
    strand = F.when(F.col("strand") == "*", ".").otherwise(F.col("strand")) if "strand" in have else F.lit(".")
    width = (F.col("end") - F.col("start") + 1).cast("string")
    ids = ",".join(map(str, range(len(experiments))))
    return df.select(F.concat_ws("\t", F.col("seqnames"), start, end, name, score, strand, start, end, F.lit("0"), F.lit("1"), width, F.lit("0"), F.lit(str(len(experiments))), F.lit(ids), scores).alias("value"))


def bedpe_lines(df: DataFrame) -> DataFrame:
    """BEDPE lines of pairs(first, second, name, score), then other columns in their order."""
    side = lambda m: [F.col(f"{m}.seqnames"), (F.col(f"{m}.start") - 1).cast("string"), F.col(f"{m}.end").cast("string")]
    strand = lambda m: F.when(F.col(f"{m}.strand") == "*", ".").otherwise(F.col(f"{m}.strand"))
    score = F.coalesce(F.col("score").cast("string"), F.lit("0")) if "score" in df.columns else F.lit("0")
    more = [_str(F.col(c)) for c in df.columns if c not in ("first", "second", "name", "score")]
    name = _str(F.col("name")) if "name" in df.columns else F.lit(".")
    return df.select(F.concat_ws("\t", *side("first"), *side("second"), name, score, strand("first"), strand("second"), *more).alias("value"))


def wig_lines(df: DataFrame, kind: str = "auto") -> DataFrame:
    """seqnames, place, value: WIG lines of df(seqnames, start, end, score); in order of place within a sequence.

    A sequence whose starts are evenly spaced is fixedStep, others are variableStep; kind may ask for one of the two.
    Errors, raised as the lines are computed: overlaps, more than one span in a sequence, uneven fixed steps.
    """
    if kind not in ("auto", "fixedStep", "variableStep"):
        raise ValueError(kind)
    from ..operators.coverage import with_previous

    p = F.col("_previous")
    x = with_previous(df, ["seqnames"], ["end"]).withColumns({"_step": F.col("start") - p["start"], "_clash": F.col("start") <= p["end"], "_span": F.col("end") - F.col("start") + 1})
    of = x.groupBy("seqnames").agg(
        F.min("start").alias("_first"), F.min("_span").alias("_least"), F.max("_span").alias("_most"), F.coalesce(F.min("_step"), F.lit(1)).alias("_by"), F.coalesce(F.min("_step") == F.max("_step"), F.lit(True)).alias("_even"), F.coalesce(F.max("_clash"), F.lit(False)).alias("_bad")
    )
    fault = F.when(F.col("_bad"), "features overlap").when(F.col("_least") != F.col("_most"), "features have several spans")
    if kind == "fixedStep":
        fault = fault.when(~F.col("_even"), "steps are uneven")
    fixed = F.lit(False) if kind == "variableStep" else F.col("_even")
    span = F.concat(F.lit(" span="), F.col("_least").cast("string"))
    head = F.when(fixed, F.concat(F.lit("fixedStep chrom="), "seqnames", F.lit(" start="), F.col("_first").cast("string"), F.lit(" step="), F.col("_by").cast("string"), span)).otherwise(F.concat(F.lit("variableStep chrom="), "seqnames", span))
    of = of.select("seqnames", fixed.alias("_fixed"), F.when(fault.isNotNull(), F.raise_error(F.concat("seqnames", F.lit(": "), fault))).otherwise(head).alias("_head"))
    score = F.col("score").cast("string")
    body = df.join(of, "seqnames").select("seqnames", F.col("start").cast("long").alias("place"), F.when(F.col("_fixed"), score).otherwise(F.concat_ws(" ", F.col("start").cast("string"), score)).alias("value"))
    return of.select("seqnames", F.lit(-1).cast("long").alias("place"), F.col("_head").alias("value")).unionByName(body)


def _filled(df: DataFrame, name: str, filler: Column | str) -> Column:
    """A column as text, the filler where it is null or missing."""
    fill = F.lit(filler) if isinstance(filler, str) else filler
    return F.coalesce(F.col(name).cast("string"), fill) if name in df.columns else fill


def sam_tags(df: DataFrame) -> list[Column]:
    """Tags XX:type:value of the columns with names of two letters: i, f or Z by their type; other types are left out with a warning."""
    import warnings

    kinds = {"integer": "i", "long": "i", "short": "i", "byte": "i", "double": "f", "float": "f", "string": "Z"}
    out = []
    for f in df.schema:
        if len(f.name) == 2:
            if (k := kinds.get(f.dataType.typeName())) is None:
                warnings.warn(f"{f.name}: no tag of type {f.dataType.simpleString()}", stacklevel=3)
            else:
                out.append(F.concat(F.lit(f"{f.name}:{k}:"), F.coalesce(F.col(f.name).cast("string"), F.lit("NA"))))
    return out


def sam_lines(df: DataFrame) -> DataFrame:
    """SAM lines of alignments, with defaults for what is missing or null; columns of two letters are tags."""
    flag = F.when(F.col("strand") == "-", "16").otherwise("0")
    name = _name(df) if "qname" not in df.columns else _filled(df, "qname", "*")
    return df.select(
        F.concat_ws("\t", name, _filled(df, "flag", flag), F.col("seqnames"), F.col("start").cast("string"), _filled(df, "mapq", "255"), F.col("cigar"), _filled(df, "mrnm", "*"), _filled(df, "mpos", "0"), _filled(df, "isize", "0"), _filled(df, "seq", "*"), _filled(df, "qual", "*"), *sam_tags(df)).alias("value")
    )


def sam_header(seqinfo: DataFrame) -> DataFrame:
    """@SQ lines of sequences whose length is known, in their order."""
    genome = F.coalesce(F.concat(F.lit("\tAS:"), "genome"), F.lit("")) if "genome" in seqinfo.columns else F.lit("")
    line = F.concat(F.lit("@SQ\tSN:"), "seqnames", F.lit("\tLN:"), F.col("seqlength").cast("string"), genome)
    return seqinfo.where("seqlength is not null").select("seq_rank", line.alias("value"))


def pair_flags(strand: Column, mate_strand: Column, first: Column) -> Column:
    """Flags of an alignment in a pair."""
    return (F.lit(1) + F.when(strand == "-", 16).otherwise(0) + F.when(mate_strand == "-", 32).otherwise(0) + F.when(first, 64).otherwise(128)).cast("int")


def paired(df: DataFrame) -> DataFrame:
    """Alignments of pairs(first, second, name): both mates with flag, mrnm and mpos from the other."""
    mates = F.explode(F.array(F.struct(F.lit(True).alias("is_first"), F.col("first").alias("own"), F.col("second").alias("mate")), F.struct(F.lit(False).alias("is_first"), F.col("second").alias("own"), F.col("first").alias("mate"))))
    x = df.select(*([F.col("name")] if "name" in df.columns else [F.col("ord").cast("string").alias("name")]), mates.alias("m"))
    return x.select("name", "m.own.*", pair_flags(F.col("m.own.strand"), F.col("m.mate.strand"), F.col("m.is_first")).alias("flag"), F.col("m.mate.seqnames").alias("mrnm"), F.col("m.mate.start").alias("mpos"))


def sam(lines: DataFrame) -> DataFrame:
    """Alignments of SAM lines: qname, flag, seqnames, start, end, strand, mapq, cigar, mate's place, isize, seq, qual, tags by name."""
    f = lines.where((F.trim("value") != "") & ~F.col("value").startswith("@")).withColumn("f", F.split("value", "\t"))
    tags = F.map_from_entries(F.transform(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(1))), lambda x: F.struct(F.substr(x, F.lit(1), F.lit(2)).alias("key"), F.substr(x, F.lit(6)).alias("value"))))
    tags = F.when(F.size("f") > 11, tags).otherwise(F.create_map().cast("map<string,string>"))
    flag = _int(1)
    return f.select(_text0(0).alias("qname"), flag.alias("flag"), _text0(2).alias("seqnames"), _int(3).alias("start"), (_int(3) + cigar_width(F.get("f", F.lit(5))) - 1).alias("end"), F.when(flag.bitwiseAND(16) > 0, "-").otherwise("+").alias("strand"), _int(4).alias("mapq"), _text0(5).alias("cigar"), _text0(6).alias("mrnm"), _int(7).alias("mpos"), _int(8).alias("isize"), _text0(9).alias("seq"), _text0(10).alias("qual"), tags.alias("tags"))


def _text0(i: int) -> Column:
    x = F.get("f", F.lit(i))
    return F.when(x != "*", x)


def cigar_width(cigar: Column) -> Column:
    """Bases of the reference that an alignment takes up."""
    parts = F.regexp_extract_all(cigar, F.lit("(\\d+)[MDN=X]"), F.lit(1))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x.cast("int"))


def _name(df: DataFrame) -> Column:
    return F.coalesce(F.col("name"), F.lit("*")) if "name" in df.columns else F.lit("*")


def fasta_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("seq")).alias("value"))


def tab_separated(lines: DataFrame, names: list[str] | None = None, seqnames: int = 1, start: int = 2, end: int = 3, header: bool = False, comment: str = "#") -> DataFrame:
    """Intervals of tab-separated lines by the places of their columns from 1; the others follow as text, named by `names` or V1, V2, ....

    header: each file's first line names the columns.
    """
    body = lines.where((F.trim("value") != "") & ~F.col("value").startswith(comment)) if comment else lines.where(F.trim("value") != "")
    if header:
        first = body.groupBy("file").agg(F.min("ord").alias("_first"))
        body = body.join(first, "file")
        if names is None:
            top = body.where("ord = _first").limit(1).collect()
            names = top[0]["value"].split("\t") if top else None
        body = body.where("ord > _first")
    n = len(names) if names else None
    if n is None:
        top = body.limit(1).collect()
        n = len(top[0]["value"].split("\t")) if top else 3
        names = [f"V{i + 1}" for i in range(n)]
    f = body.withColumn("f", F.split("value", "\t"))
    rest = [F.get("f", F.lit(i)).alias(names[i]) for i in range(n) if i + 1 not in (seqnames, start, end)]
    return f.select(F.get("f", F.lit(seqnames - 1)).alias("seqnames"), _int(start - 1).alias("start"), _int(end - 1).alias("end"), F.lit("*").alias("strand"), *rest)


def tab_separated_lines(df: DataFrame, header: bool = True) -> DataFrame:
    """part, value: rows as tab-separated text, nulls as NA, in the order of part; the names first if header."""
    cols = [c for c in df.columns if c not in ("ord", "width")]
    rows = df.select(F.lit(1).alias("part"), F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in cols]).alias("value"))
    return df.sparkSession.createDataFrame([(0, "\t".join(cols))], "part int, value string").union(rows) if header else rows


def write_lines(lines: DataFrame, path: str, mode: str = "error") -> None:
    lines.select("value").write.mode(mode).text(path)
