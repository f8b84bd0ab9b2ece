"""Sequences and selections: seqinfo tables, orders by sequence, checks of names, and set operations on columns.

seqinfo(seqnames, seqlength, genome, seq_rank): one row a sequence, few enough for one broadcast of a checked size.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .overlap import is_small

#: A table of sequences of at most so many rows is broadcast.
MOST_SEQUENCES = 1 << 20


def _side(seqinfo: DataFrame) -> DataFrame:
    return F.broadcast(seqinfo) if is_small(seqinfo, MOST_SEQUENCES) else seqinfo


# --- names -------------------------------------------------------------------------------------


def unknown(df: DataFrame, seqinfo: DataFrame) -> DataFrame:
    """Rows whose sequence seqinfo does not have."""
    return df.join(_side(seqinfo.select("seqnames")), "seqnames", "left_anti")


def known(df: DataFrame, seqinfo: DataFrame, missing: str = "warn") -> DataFrame:
    """Rows whose sequence seqinfo has. missing: "warn" and "drop" leave others out, "error" fails if there are any."""
    if missing not in ("warn", "drop", "error"):
        raise ValueError(missing)
    if missing != "drop":
        names = sorted(r[0] for r in unknown(df, seqinfo).select("seqnames").distinct().limit(20).collect())
        if names and missing == "error":
            raise ValueError(f"unknown sequences: {names}")
        if names:
            warnings.warn(f"rows of unknown sequences are left out: {names}", stacklevel=2)
    return df.join(_side(seqinfo.select("seqnames")), "seqnames", "left_semi").select(*df.columns)


def single_genome(seqinfo: DataFrame) -> str | None:
    """The genome that all sequences name, None if none does; several are an error."""
    names = [r[0] for r in seqinfo.select("genome").distinct().limit(3).collect()]
    if len(names) > 1:
        raise ValueError(f"several genomes: {names}")
    return names[0] if names else None


def merge_seqinfo(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sequences of both, those of a first; lengths that differ are an error, a null one takes the other's."""
    x = a.select("seqnames", F.col("seqlength").alias("la"), F.col("genome").alias("ga"), F.col("seq_rank").alias("ra"))
    y = b.select("seqnames", F.col("seqlength").alias("lb"), F.col("genome").alias("gb"), F.col("seq_rank").alias("rb"))
    length = F.when(F.col("la") != F.col("lb"), F.raise_error(F.concat(F.lit("lengths differ: "), "seqnames")).cast("long")).otherwise(F.coalesce("la", "lb"))
    m = x.join(y, "seqnames", "full")
    order = F.struct(F.col("ra").isNull().alias("later"), F.coalesce("ra", "rb").alias("rank"))
    return m.select("seqnames", length.alias("seqlength"), F.coalesce("ga", "gb").alias("genome"), order.alias("seq_rank"))


def union_levels(*tables: DataFrame) -> DataFrame:
    """seqnames, seq_rank: the sequences of several tables in the order in which they are first seen, table by table.

    A table's own order is that of its column ord if it has one, else that of names.
    """
    def seen(i: int, t: DataFrame) -> DataFrame:
        first = t.groupBy("seqnames").agg((F.min("ord") if "ord" in t.columns else F.lit(0)).cast("long").alias("at"))
        return first.select("seqnames", F.struct(F.lit(i).alias("table"), "at", F.col("seqnames").alias("name")).alias("k"))

    parts = [seen(i, t) for i, t in enumerate(tables)]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.groupBy("seqnames").agg(F.min("k").alias("seq_rank"))


# --- selections --------------------------------------------------------------------------------


def genome_ranges(seqinfo: DataFrame, chrom: list[str] | None = None) -> DataFrame:
    """Whole sequences as ranges, all or the named ones; names that are not there are an error."""
    out = seqinfo.select("seqnames", F.lit(1).alias("start"), F.col("seqlength").cast("int").alias("end"), F.lit("*").alias("strand"))
    if chrom is None:
        return out
    there = {r[0] for r in seqinfo.where(F.col("seqnames").isin(chrom)).select("seqnames").collect()}
    if set(chrom) - there:
        raise ValueError(f"unknown sequences: {sorted(set(chrom) - there)}")
    return out.where(F.col("seqnames").isin(chrom))


def selection(seqinfo: DataFrame, chrom: list[str] | None = None, columns: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Ranges and column names to read, as scans take them."""
    return genome_ranges(seqinfo, chrom), list(columns if columns is not None else ["score"])


def normalise(ranges: DataFrame, most: int | None = None) -> DataFrame:
    """Ranges without other columns, strand *. Beyond `most` the first ones in order stay, with a warning; most 1: their hull."""
    bare = ranges.select("seqnames", "start", "end", F.lit("*").alias("strand"))
    if most is None:
        return bare
    if most == 1:
        of = bare.agg(F.min("seqnames").alias("seqnames"), F.max("seqnames").alias("m"), F.min("start").alias("start"), F.max("end").alias("end"))
        one = F.when(F.col("seqnames") == F.col("m"), F.col("seqnames")).otherwise(F.raise_error(F.lit("ranges of several sequences have no hull")))
        return of.where("m is not null").select(one.alias("seqnames"), "start", "end", F.lit("*").alias("strand"))
    if not is_small(bare, most):
        warnings.warn(f"more than {most} ranges; the first {most} are used", stacklevel=2)
    order = ["ord"] if "ord" in ranges.columns else ["seqnames", "start", "end"]
    return ranges.orderBy(*order).limit(most).select("seqnames", "start", "end", F.lit("*").alias("strand"))


def names_filter(table: DataFrame, names: list[str] | None) -> DataFrame:
    """Rows whose name, or else whose frag, is one of names; all if None."""
    if names is None:
        return table
    column = next((c for c in ("name", "frag") if c in table.columns), None)
    if column is None:
        raise ValueError("the table has neither name nor frag")
    return table.where(F.col(column).isin(names))


def shifted(df: DataFrame, offset: int | Column) -> DataFrame:
    """Ranges moved by an offset."""
    return df.withColumns({"start": (F.col("start") + offset).cast("int"), "end": (F.col("end") + offset).cast("int")})


def with_chrom(df: DataFrame, seqnames: Column | str) -> DataFrame:
    """The rows on another sequence: a name for all of them, or an expression."""
    return df.withColumn("seqnames", F.lit(seqnames) if isinstance(seqnames, str) else seqnames)


def score(df: DataFrame) -> Column:
    """The column of scores: score, else the first numeric one that is no coordinate."""
    own = ("seqnames", "start", "end", "strand", "ord", "width")
    for c in ["score", *[f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "double", "float", "short") and f.name not in own]]:
        if c in df.columns:
            return F.col(c)
    raise ValueError("no score")


# --- order -------------------------------------------------------------------------------------


def sort_by_level(df: DataFrame, seqinfo: DataFrame, ignore_strand: bool = True) -> DataFrame:
    """Rows by the rank of their sequence, start, end; with strand between sequence and start unless it is ignored.

    A range-partitioned sort: no task holds a whole sequence. Unknown sequences come last, by name.
    """
    ranked = df.join(_side(seqinfo.select("seqnames", "seq_rank")), "seqnames", "left")
    strand = [] if ignore_strand or "strand" not in df.columns else [F.when(F.col("strand") == "+", 0).when(F.col("strand") == "-", 1).otherwise(2)]
    more = ["ord"] if "ord" in df.columns else []
    return ranked.orderBy(F.col("seq_rank").asc_nulls_last(), "seqnames", *strand, "start", "end", *more).select(*df.columns)


def placed_by_level(df: DataFrame, seqinfo: DataFrame, tile: int = 1 << 16) -> DataFrame:
    """df with place, its rank from 1 within its sequence by (start, end, ord): counts of the tiles before, then rows within a tile."""
    from pyspark.sql import Window

    x = df.withColumn("_tile", F.floor(F.col("start") / tile))
    counts = x.groupBy("seqnames", "_tile").agg(F.count("*").alias("n"))
    before = counts.select("seqnames", "_tile", F.coalesce(F.sum("n").over(Window.partitionBy("seqnames").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    more = ["ord"] if "ord" in df.columns else [c for c in df.columns if c not in ("seqnames", "start", "end")]
    own = F.row_number().over(Window.partitionBy("seqnames", "_tile").orderBy("start", "end", *more))
    ranked = x.withColumn("_own", own).join(before, ["seqnames", "_tile"]).withColumn("place", F.col("_before") + F.col("_own"))
    return ranked.join(_side(seqinfo.select("seqnames", "seq_rank")), "seqnames", "left").drop("_tile", "_own", "_before")


def restored(parts: DataFrame, by: str, *order: str) -> DataFrame:
    """Values gathered for each query in the order of the queries: by, then their own order."""
    return parts.orderBy(by, *order)


def capped(df: DataFrame, most: int, what: str = "ranges") -> DataFrame:
    """At most so many rows in order of ord, with a warning if there are more."""
    if not is_small(df, most):
        warnings.warn(f"more than {most} {what}; the first {most} are used", stacklevel=2)
    return df.orderBy(*(["ord"] if "ord" in df.columns else ["seqnames", "start", "end"])).limit(most)


# --- columns and splits ------------------------------------------------------------------------


def union_names(*lists: list[str]) -> list[str]:
    return list(dict.fromkeys(x for names in lists for x in names))


def common_names(a: list[str], b: list[str]) -> list[str]:
    return [x for x in a if x in set(b)]


def other_names(a: list[str], b: list[str]) -> list[str]:
    return [x for x in a if x not in set(b)]


def padded(*tables: DataFrame) -> DataFrame:
    """The rows of all tables with the columns of any; what a table does not have is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def merged_fields(rows: list[dict], more: list[dict], key: str = "name") -> list[dict]:
    """Records of two lists with one key joined, records of either alone kept; what a record does not have is None."""
    fields = union_names(*(list(r) for r in rows + more))
    by: dict = {}
    for r in rows + more:
        by[r[key]] = by.get(r[key], {}) | r
    return [{f: r.get(f) for f in fields} for r in by.values()]


def split_by(df: DataFrame, *keys: str, most: int = 10_000) -> dict[tuple, DataFrame]:
    """A table for each distinct value of keys; meant for genomes, strands and sequences, of which there are few."""
    values = df.select(*keys).distinct().limit(most + 1).collect()
    if len(values) > most:
        raise ValueError(f"more than {most} parts")
    out = {}
    for v in sorted(values, key=repr):
        where = F.lit(True)
        for k in keys:
            where = where & F.col(k).eqNullSafe(F.lit(v[k]))
        out[tuple(v)] = df.where(where)
    return out


def letters(df: DataFrame, alphabet: str = "ACGTN") -> DataFrame:
    """Counts of the letters of seq, a row of (letter, n) for each letter there is, whatever its case; is_valid tells those of the alphabet."""
    x = df.select(F.explode(F.filter(F.split(F.upper("seq"), ""), lambda c: c != "")).alias("letter"))
    return x.groupBy("letter").agg(F.count("*").alias("n")).withColumn("is_valid", F.col("letter").isin(*alphabet))


def registry(spark: SparkSession, *lists: list[dict]) -> DataFrame:
    """Records of several registries one after the other, as a table of strings."""
    names = union_names(*(list(r) for rows in lists for r in rows)) or ["name"]
    return spark.createDataFrame([tuple(None if r.get(n) is None else str(r.get(n)) for n in names) for rows in lists for r in rows], ", ".join(f"`{n}` string" for n in names))
