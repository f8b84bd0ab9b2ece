"""Coverage, merging and checks of intervals.

Sweeps run over sums of events per position, pre-aggregated by (seqnames, position) before the window's shuffle, so a
window sees one row a position. Positions are dealt out by (seqnames, tile) with the depth carried in at each tile's
start, so no task holds a whole sequence. Merging, run joining and checks work likewise: what a tile needs of the tiles
before it (a greatest end, a last row) is aggregated by tile first, and a window over tiles, of which a sequence has
few, hands it on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(df: DataFrame, value: str | None = None, tile: int = 1 << 16, keep_zero: bool = False) -> DataFrame:
    """seqnames, start, end, value: runs of constant depth (or sum of value); runs end at most at event positions."""
    v = F.lit(1).cast("long") if value is None else F.col(value)
    opens = df.select("seqnames", F.col("start").cast("long").alias("pos"), v.alias("d"))
    closes = df.select("seqnames", (F.col("end") + 1).cast("long").alias("pos"), (-v).alias("d"))
    events = opens.union(closes).groupBy("seqnames", "pos").agg(F.sum("d").alias("d")).withColumn("tile", F.floor(F.col("pos") / tile))
    sums = events.groupBy("seqnames", "tile").agg(F.sum("d").alias("t"), F.min("pos").alias("first"))
    order = Window.partitionBy("seqnames").orderBy("tile")
    carried = sums.select("seqnames", "tile", F.coalesce(F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carry"), F.lead("first").over(order).alias("next_tile"))
    inside = Window.partitionBy("seqnames", "tile").orderBy("pos")
    runs = events.join(carried, ["seqnames", "tile"]).select(
        "seqnames",
        F.col("pos").alias("start"),
        (F.coalesce(F.lead("pos").over(inside), F.col("next_tile")) - 1).alias("end"),
        (F.col("carry") + F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("value"),
    )
    runs = runs.where("end is not null")
    return runs if keep_zero else runs.where("value <> 0")


TILE = 1 << 16


def _tiles(df: DataFrame, tile: int) -> DataFrame:
    return df.withColumn("_tile", F.floor(F.col("start") / tile))


def _greatest_before(rows: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """(key, _tile, name): the greatest value in the tiles before."""
    most = rows.groupBy(*key, "_tile").agg(F.max(value).alias("m"))
    return most.select(*key, "_tile", F.max("m").over(Window.partitionBy(*key).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)).alias(name))


def with_end_before(df: DataFrame, key: list[str], tile: int = TILE) -> DataFrame:
    """Adds _tile and _before: the greatest end of the rows before, by start, then end; null for the first of a sequence."""
    x = _tiles(df, tile)
    inside = Window.partitionBy(*key, "_tile").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(_greatest_before(x, key, "end", "_carry"), [*key, "_tile"])
    return x.withColumn("_before", F.greatest(F.col("_carry"), F.max("end").over(inside))).drop("_carry")


def with_previous(df: DataFrame, key: list[str], columns: list[str], tile: int = TILE) -> DataFrame:
    """Adds _previous: start and these columns of the row before by start; null for the first of a sequence."""
    x, row = _tiles(df, tile), F.struct("start", *columns)
    last = x.groupBy(*key, "_tile").agg(F.max(row).alias("l"))
    carry = last.select(*key, "_tile", F.lag("l").over(Window.partitionBy(*key).orderBy("_tile")).alias("_carry"))
    own = F.lag(row).over(Window.partitionBy(*key, "_tile").orderBy("start", *columns))
    return x.join(carry, [*key, "_tile"]).withColumn("_previous", F.coalesce(own, F.col("_carry"))).drop("_tile", "_carry")


def _run_starts(rows: DataFrame, key: list[str]) -> DataFrame:
    """Adds _run, the start of the last row marked _new, to rows with _tile."""
    x = rows.withColumn("_first", F.when(F.col("_new"), F.col("start")))
    inside = Window.partitionBy(*key, "_tile").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(_greatest_before(x, key, "_first", "_carry"), [*key, "_tile"])
    return x.withColumn("_run", F.coalesce(F.max("_first").over(inside), F.col("_carry")))


def joined_runs(runs: DataFrame, tile: int = TILE) -> DataFrame:
    """Neighbouring runs of one value become one."""
    p = F.col("_previous")
    marked = with_previous(runs, ["seqnames"], ["end", "value"], tile).withColumn("_new", F.coalesce((p["end"] != F.col("start") - 1) | (p["value"] != F.col("value")), F.lit(True)))
    return _run_starts(_tiles(marked, tile), ["seqnames"]).groupBy("seqnames", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("value").alias("value")).drop("_run")


def reduce_ranges(df: DataFrame, *by: str, tile: int = TILE) -> DataFrame:
    """The union of overlapping and adjacent ranges, for each sequence (and further columns)."""
    key = ["seqnames", *by]
    rows = with_end_before(df.groupBy(*key, "start").agg(F.max("end").alias("end")), key, tile)
    marked = rows.withColumn("_new", F.coalesce(F.col("start") > F.col("_before") + 1, F.lit(True)))
    return _run_starts(marked, key).groupBy(*key, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def hull(df: DataFrame, *group: str) -> DataFrame:
    """First start and last end of each group; `mixed` where a group has several sequences or strands."""
    one = F.min(F.struct("seqnames", "strand")) != F.max(F.struct("seqnames", "strand"))
    return df.groupBy(*group).agg(F.min("seqnames").alias("seqnames"), F.min("strand").alias("strand"), F.min("start").alias("start"), F.max("end").alias("end"), one.alias("mixed"))


def disjoint(df: DataFrame, tile: int = TILE) -> DataFrame:
    """Whether the ranges of each sequence and strand are disjoint and not empty."""
    x = with_end_before(df, ["seqnames", "strand"], tile)
    hit = F.coalesce(F.col("_before") >= F.col("start"), F.lit(False)) | (F.col("end") < F.col("start"))
    return x.groupBy("seqnames", "strand").agg((~F.bool_or(hit)).alias("is_disjoint"))


def spans_genome(df: DataFrame, seqinfo: DataFrame) -> DataFrame:
    """seqnames, covered, spans: whether the union of the ranges covers each sequence of seqinfo."""
    n = reduce_ranges(df).groupBy("seqnames").agg(F.sum(F.col("end") - F.col("start") + 1).cast("long").alias("n"))
    x = seqinfo.select("seqnames", "seqlength").join(n, "seqnames", "left")
    covered = F.coalesce("n", F.lit(0).cast("long"))
    return x.select("seqnames", covered.alias("covered"), (covered >= F.col("seqlength")).alias("spans"))


def graph_type(df: DataFrame, tile: int = TILE) -> str:
    """wig for signals of one width that are evenly spaced or dense, else bedGraph.

    Steps are those between all starts sorted together, whatever their sequence, as the statistics of wig need.
    """
    starts = df.select(F.lit("").alias("seqnames"), "start", (F.col("end") - F.col("start") + 1).alias("w"))
    x = with_previous(starts, ["seqnames"], ["w"], tile)
    step = F.col("start") - F.col("_previous.start")
    r = x.agg(F.count("*").alias("n"), F.min("w").alias("w0"), F.max("w").alias("w1"), F.min(step).alias("s0"), F.max(step).alias("s1"), F.avg(step).alias("mean")).first()
    one_width = r["n"] > 0 and r["w0"] == r["w1"]
    even = r["s0"] is not None and r["s0"] == r["s1"]
    dense = 3 < r["n"] and r["mean"] is not None and r["mean"] < 100
    return "wig" if one_width and (even or dense) else "bedGraph"


def zoom(signal: DataFrame, reduction: int) -> DataFrame:
    """Statistics of signal(seqnames, start, end, value) in windows of `reduction` bases on a fixed grid."""
    a, b = F.floor((F.col("start") - 1) / reduction), F.floor((F.col("end") - 1) / reduction)
    x = signal.withColumn("win", F.explode(F.sequence(a, b)))
    w: Column = F.least(F.col("end"), (F.col("win") + 1) * reduction) - F.greatest(F.col("start") - 1, F.col("win") * reduction)
    return x.withColumn("w", w).groupBy("seqnames", "win").agg(
        F.sum("w").alias("valid"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.sum(F.col("w") * F.col("value")).alias("sum_value"), F.sum(F.col("w") * F.col("value") * F.col("value")).alias("sum_squares")
    )


def zoom_again(level: DataFrame, reduction: int, before: int) -> DataFrame:
    """The windows of `reduction` bases from those of a finer level, whose `before` divides it."""
    if reduction % before:
        raise ValueError("the finer reduction must divide the coarser one")
    return level.withColumn("win", F.floor(F.col("win") * before / reduction)).groupBy("seqnames", "win").agg(
        F.sum("valid").alias("valid"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.sum("sum_value").alias("sum_value"), F.sum("sum_squares").alias("sum_squares")
    )


#: The reductions of files with fixed summaries.
FIXED_ZOOMS = (30, 65, 130, 260, 450, 648, 950, 1296, 4800, 19200)


def zoom_reductions(mean_width: float, items: int, most: int = 10, first: int = 10) -> list[int]:
    """Reductions of a pyramid: ten times the mean width of an item at first, at least `first`, then times four, while a level would still halve the items."""
    out, r = [], max(first, int(10 * mean_width))
    while len(out) < most and items * mean_width / r > 1 and (not out or items * mean_width / r >= 1):
        out.append(r)
        r *= 4
    return out


def accumulated(items: DataFrame, reduction: int) -> DataFrame:
    """seqnames, start, end, valid, min_value, max_value, sum_value, sum_squares of windows that follow the data.

    The first window of a sequence opens at its first item; the next abuts it, and after a gap of a window or more one
    opens at the next item. So windows depend on all before them: a sequence's items are folded in order, as runs of
    windows that a gap parts. Items are cut into runs first, and a run is folded by one task.
    """
    import numpy as np
    import pyarrow as pa

    x = with_previous(items, ["seqnames"], ["end"])
    far = F.coalesce(F.col("start") - F.col("_previous.end") > 2 * reduction, F.lit(True))  # surely beyond the open window
    runs = _run_starts(_tiles(x.withColumn("_new", far), TILE), ["seqnames"]).select("seqnames", F.col("_run").alias("run"), "start", "end", F.col("value").cast("double").alias("value"))

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by("start")
        a, b, v = (t.column(c).to_numpy() for c in ("start", "end", "value"))
        out, opened = [], None
        for s, e, value in zip(a.tolist(), b.tolist(), v.tolist()):
            while s <= e:
                if opened is None or s > opened[1]:
                    at = s if opened is None or s >= opened[1] + 1 + reduction else opened[1] + 1
                    opened = [at, at + reduction - 1, 0, np.inf, -np.inf, 0.0, 0.0]
                    out.append(opened)
                    if s > opened[1]:
                        continue
                w = min(e, opened[1]) - s + 1
                opened[2] += w
                opened[3], opened[4] = min(opened[3], value), max(opened[4], value)
                opened[5] += w * value
                opened[6] += w * value * value
                s += w
        out = [o for o in out if o[2]]
        name = t.column("seqnames")[0].as_py()
        cols = list(zip(*out))
        return pa.table([pa.array([name] * len(out)), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[3:])], names=["seqnames", "start", "end", "valid", "min_value", "max_value", "sum_value", "sum_squares"])

    return runs.groupBy("seqnames", "run").applyInArrow(fold, "seqnames string, start int, end int, valid long, min_value double, max_value double, sum_value double, sum_squares double")
