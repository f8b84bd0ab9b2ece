"""Binned summaries of a signal over query ranges, always from all data.

Bin i of n over [start, end] covers, 0-based, [b0 + floor(W i / n), b0 + floor(W (i + 1) / n)), at least one base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .overlap import is_small, overlap_join
from .tiles import statistics

TYPES = ("mean", "min", "max", "coverage", "sd")


def bins(queries: DataFrame, size: int) -> DataFrame:
    """One row for each bin of queries(query, seqnames, start, end)."""
    w, b0 = F.col("end") - F.col("start") + 1, F.col("start") - 1
    x = queries.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    lo, hi = b0 + F.floor(w * F.col("bin") / size), b0 + F.floor(w * (F.col("bin") + 1) / size)
    return x.select("query", "bin", "seqnames", (lo + 1).alias("start"), F.greatest(hi, lo + 1).alias("end"), w.alias("width"))


def summarise(signal: DataFrame, queries: DataFrame, size: int = 1, default: float | None = None, small: bool | None = None) -> DataFrame:
    """query, bin and mean, min, max, coverage, sd of signal(seqnames, start, end, value); bins without data have the default."""
    b = bins(queries, size)
    if small is not False and is_small(b):
        rows = _by_pairs(signal, b)
    else:
        rows = statistics(signal, b)
    s = rows.groupBy("query", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    var = F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.when(F.col("n") > 1, F.col("n") - 1).otherwise(F.col("n"))
    stats = s.select("query", "bin", (F.col("s") / F.col("n")).alias("mean"), F.col("lo").alias("min"), F.col("hi").alias("max"), F.col("n").alias("_n"), F.sqrt(var).alias("sd"))
    out = b.select("query", "bin", "width").join(stats, ["query", "bin"], "left").select("query", "bin", "mean", "min", "max", (F.col("_n") * size / F.col("width")).alias("coverage"), "sd")
    return out.fillna({t: default for t in TYPES}) if default is not None else out


def _by_pairs(signal: DataFrame, b: DataFrame) -> DataFrame:
    """What `statistics` gives, of pairs with a few bins that are broadcast."""
    p = overlap_join(signal, b, small=True)
    weight = F.least("l.end", "r.end") - F.greatest("l.start", "r.start") + 1
    v = F.col("l.value").cast("double")
    w = weight.cast("double")
    return p.select(F.col("r.query").alias("query"), F.col("r.bin").alias("bin"), w.alias("n"), (w * v).alias("s"), (w * v * v).alias("q"), v.alias("lo"), v.alias("hi"))
