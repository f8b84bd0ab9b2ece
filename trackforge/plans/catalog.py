"""Registered queries over interval views of the given tables, and the SQL that gives the same rows.

Features come from lineitem, query ranges from part, chain blocks from supplier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import coverage as cov
from ..operators import nest, summary
from ..operators import genome
from ..operators.lift import flip, lift_grouped, lift_over, lift_pairs, lift_pieces, pieces_of
from ..operators.overlap import clipped, count_overlaps, overlap_join, overlap_semi
from ..sources import gff, hubs, tracks, web
from ..sources import lines as L

FEATURES_SQL = """
select concat('chr', cast(l_suppkey % 24 + 1 as string)) as seqnames,
       cast((l_orderkey * 37 + l_linenumber * 11 + l_partkey * 7) % 1000000 + 1 as int) as "start",
       cast((l_orderkey * 37 + l_linenumber * 11 + l_partkey * 7) % 1000000 + cast(l_quantity as int) as int) as "end",
       case l_returnflag when 'A' then '+' when 'R' then '-' else '*' end as strand,
       cast(l_quantity as int) as score, l_orderkey as grp, l_linenumber as line, l_partkey as part
from lineitem"""
QUERIES_SQL = """
select concat('chr', cast(p_partkey % 24 + 1 as string)) as seqnames, cast(p_partkey * 7919 % 1000000 + 1 as int) as "start",
       cast(p_partkey * 7919 % 1000000 + 50 + p_size as int) as "end", case p_partkey % 3 when 0 then '+' when 1 then '-' else '*' end as strand, p_partkey as query
from part"""
CHAIN_SQL = """
select concat('chr', cast(s_suppkey % 24 + 1 as string)) as from_name, cast(s_suppkey * 104729 % 900000 + 1 as int) as from_start, 20000 as width,
       cast(s_suppkey % 1000 - 500 as int) as "offset", concat('t', cast(s_nationkey as string)) as to_name, s_suppkey % 3 = 0 as reversed
from supplier"""


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _seq(key: str) -> Column:
    return F.concat(F.lit("chr"), (F.col(key) % 24 + 1).cast("string"))


def features(s: SparkSession, d: str) -> DataFrame:
    at = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11 + F.col("l_partkey") * 7) % 1000000
    q = F.col("l_quantity").cast("int")
    strand = F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-").otherwise("*")
    return _t(s, d, "lineitem").select(_seq("l_suppkey").alias("seqnames"), (at + 1).cast("int").alias("start"), (at + q).cast("int").alias("end"), strand.alias("strand"), q.alias("score"), F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))


def ranges(s: SparkSession, d: str) -> DataFrame:
    at, k = F.col("p_partkey") * 7919 % 1000000, F.col("p_partkey") % 3
    return _t(s, d, "part").select(_seq("p_partkey").alias("seqnames"), (at + 1).cast("int").alias("start"), (at + 50 + F.col("p_size")).cast("int").alias("end"), F.when(k == 0, "+").when(k == 1, "-").otherwise("*").alias("strand"), F.col("p_partkey").alias("query"))


def chain_blocks(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _t(s, d, "supplier").select(_seq("s_suppkey").alias("from_name"), (k * 104729 % 900000 + 1).cast("int").alias("from_start"), F.lit(20000).alias("width"), (k % 1000 - 500).cast("int").alias("offset"), F.concat(F.lit("t"), F.col("s_nationkey").cast("string")).alias("to_name"), (k % 3 == 0).alias("reversed"))


QUERIES: dict = {}
SQL: dict[str, str] = {}
# f1: features of a key of their own
WITH = f"with f as ({FEATURES_SQL}), f1 as (select * from f qualify count(*) over (partition by grp, part, line) = 1), q as ({QUERIES_SQL}), c as ({CHAIN_SQL})"


def query(name: str, sql: str | None):
    """Registers a function of (spark, sf_dir) with its SQL; f, q and c are the features, ranges and chain blocks."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"{WITH}{sql}" if sql.lstrip().startswith(",") else f"{WITH} {sql}"
        return f

    return add


HIT = 'f.seqnames = q.seqnames and f."start" <= q."end" and q."start" <= f."end"'
STRAND = "(f.strand = q.strand or f.strand = '*' or q.strand = '*')"
CORE = ["seqnames", "start", "end", "strand"]


# --- joins -------------------------------------------------------------------------------------


@query("overlap_semi", f'select seqnames, "start", "end", strand from f where exists (select 1 from q where {HIT})')
def _(s, d):
    return overlap_semi(features(s, d).select(CORE), ranges(s, d), ignore_strand=True)


@query("overlap_semi_strand", f'select seqnames, "start", "end", strand from f where exists (select 1 from q where {HIT} and {STRAND})')
def _(s, d):
    return overlap_semi(features(s, d).select(CORE), ranges(s, d))


@query("overlap_count", f"select q.query, count(*) as n_hits from f join q on {HIT} group by 1")
def _(s, d):
    return count_overlaps(features(s, d), ranges(s, d), "query").withColumnRenamed("n", "n_hits")


@query("overlap_clip", f'select q.query, f.seqnames, greatest(f."start", q."start") as "start", least(f."end", q."end") as "end" from f join q on {HIT}')
def _(s, d):
    return clipped(overlap_join(features(s, d), ranges(s, d)), "query")


@query("overlap_bucketed", f'select q.query, f.grp, f."start", f."end" from f join q on {HIT}')
def _(s, d):
    return overlap_join(features(s, d), ranges(s, d), small=False).select("query", "grp", F.col("l.start").alias("start"), F.col("l.end").alias("end"))


@query("overlap_semi_bucketed", f'select seqnames, "start", "end", strand from f where exists (select 1 from q where {HIT} and {STRAND})')
def _(s, d):
    return overlap_semi(features(s, d).select(CORE), ranges(s, d), small=False)


@query("bed_overlap_count", f"select f.seqnames, count(*) as n from f where f.strand = '+' and exists (select 1 from q where {HIT}) group by 1")
def _(s, d):
    f = L.bed(L.bed_lines(features(s, d).select("seqnames", "start", "end", F.lit("x").alias("name"), "score", "strand")), 6)
    return overlap_semi(f.where("strand = '+'"), ranges(s, d), ignore_strand=True).groupBy("seqnames").agg(F.count("*").alias("n"))


_LIFT = """select {keep} c.to_name as seqnames, p.s0 - c."offset" as "start", p.s0 - c."offset" + (p.e - p.s) as "end",
  case when c.reversed then translate(f.strand, '+-', '-+') else f.strand end as strand
from f join c on f.seqnames = c.from_name and f."start" <= c.from_start + c.width - 1 and c.from_start <= f."end",
lateral (select greatest(f."start", c.from_start) as s, least(f."end", c.from_start + c.width - 1) as e,
  case when c.reversed then c.from_start + c.from_start + c.width - 1 - least(f."end", c.from_start + c.width - 1) else greatest(f."start", c.from_start) end as s0) p
where {where}"""


@query("liftover_forward", _LIFT.format(keep="", where="not c.reversed"))
def _(s, d):
    return lift_over(features(s, d), chain_blocks(s, d).where("not reversed"), by_target=True)


@query("liftover_reversed", _LIFT.format(keep="", where="c.reversed"))
def _(s, d):
    return lift_over(features(s, d), chain_blocks(s, d).where("reversed"))


@query("liftover_grouped", ", x as (" + _LIFT.format(keep="f.grp,", where="true") + ') select grp, count(*) as pieces, min("start") as first_start, max("end") as last_end from x group by 1')
def _(s, d):
    return lift_over(features(s, d), chain_blocks(s, d), "grp").groupBy("grp").agg(F.count("*").alias("pieces"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))


@query("liftover_pairs", ", m as (select (grp * 1000000 + part * 10 + line) as ord, seqnames, \"start\" as a1, \"end\" as b1, greatest(\"start\" - 300, 1) as a2, \"end\" as b2 from f1), " + """p as (select m.ord, 1 as mate, c.to_name, m.a1 as s, m.b1 as e, c.* from m join c on m.seqnames = c.from_name and m.a1 <= c.from_start + c.width - 1 and c.from_start <= m.b1
union all select m.ord, 2, c.to_name, m.a2, m.b2, c.* from m join c on m.seqnames = c.from_name and m.a2 <= c.from_start + c.width - 1 and c.from_start <= m.b2),
y as (select ord, mate, case when reversed then 2 * from_start + width - 1 - least(e, from_start + width - 1) else greatest(s, from_start) end - "offset" as to_start from p)
select m.ord, m.a1 as first_start, count(*) filter (mate = 1) as n_first, count(*) filter (mate = 2) as n_second, min(to_start) filter (mate = 2) as least_second from m left join y on y.ord = m.ord group by 1, 2""")
def _(s, d):
    mate = lambda start: F.struct("seqnames", start.alias("start"), "end", "strand")
    pairs = _numbered(s, d).select("ord", mate(F.col("start")).alias("first"), mate(F.greatest(F.col("start") - 300, F.lit(1))).alias("second"))
    x = lift_pairs(pairs, chain_blocks(s, d))
    return x.select("ord", F.col("first.start").alias("first_start"), F.size("to_first").cast("long").alias("n_first"), F.size("to_second").cast("long").alias("n_second"), F.array_min(F.col("to_second.start")).alias("least_second"))


_KEY = "(f.grp * 1000000 + f.part * 10 + f.line)"
_ORD = _KEY + " as ord,"
_LIFT1 = _LIFT.replace("from f join", "from f1 f join")


@query("liftover_unmapped", ", x as (" + _LIFT1.format(keep=_ORD, where="true") + ") select " + _KEY + """ as ord, f."start", x.seqnames as to_seqnames, x."start" as to_start, x."end" as to_end, x.strand as to_strand from f1 f left join x on x.ord = """ + _KEY)
def _(s, d):
    return lift_pieces(_numbered(s, d), chain_blocks(s, d)).select("ord", "start", "to_seqnames", "to_start", "to_end", "to_strand")


@query("liftover_order", ", x as (" + _LIFT1.format(keep=_ORD + " c.from_start,", where="true") + """) select ord, cast(row_number() over (partition by ord order by from_start, seqnames, "start", "end") as int) as piece, "start" as to_start from x""")
def _(s, d):
    return pieces_of(_numbered(s, d), chain_blocks(s, d), "ord").select("ord", "piece", "to_start")


@query("liftover_empty_groups", ", x as (" + _LIFT1.format(keep="f.grp,", where="true") + """) select f.grp, (select count(*) from x where x.grp = f.grp) as n from (select distinct grp from f1) f""")
def _(s, d):
    return lift_grouped(_numbered(s, d), chain_blocks(s, d), "grp").select("grp", F.size("pieces").cast("long").alias("n"))


def _numbered(s, d) -> DataFrame:
    key = (F.col("grp") * 1000000 + F.col("part") * 10 + F.col("line")).alias("ord")
    return features(s, d).groupBy("grp", "part", "line").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in (*CORE, "score")]).where("n = 1").select(key, "grp", *CORE, "score")


@query("strand_flip", "select grp, line, translate(strand, '+-', '-+') as strand from f")
def _(s, d):
    return features(s, d).select("grp", "line", flip(F.col("strand")).alias("strand"))


# --- aggregations ------------------------------------------------------------------------------

_SWEEP = """, ev as (select seqnames, pos, sum(d) as d from (select seqnames, "start" as pos, {v} as d from f union all select seqnames, "end" + 1, -({v}) from f) group by 1, 2),
r as (select seqnames, pos as "start", lead(pos) over w - 1 as "end", sum(d) over w as v from ev window w as (partition by seqnames order by pos))"""


@query("coverage_depth", _SWEEP.format(v="1") + ' select seqnames, cast("start" as bigint) as "start", cast("end" as bigint) as "end", cast(v as bigint) as value from r where "end" is not null and v <> 0')
def _(s, d):
    return cov.coverage(features(s, d))


@query("coverage_weighted", _SWEEP.format(v="score") + ' select seqnames, cast("start" as bigint) as "start", cast("end" as bigint) as "end", cast(v as bigint) as value from r where "end" is not null and v <> 0')
def _(s, d):
    return cov.coverage(features(s, d), "score")


_REDUCE = """, m as (select *, max("end") over (partition by seqnames order by "start", "end" rows between unbounded preceding and 1 preceding) as before from f),
g as (select *, sum(case when before is null or "start" > before + 1 then 1 else 0 end) over (partition by seqnames order by "start", "end" rows unbounded preceding) as g from m),
u as (select seqnames, g, min("start") as "start", max("end") as "end" from g group by 1, 2)"""


@query("reduce_ranges", _REDUCE + ' select seqnames, "start", "end" from u')
def _(s, d):
    return cov.reduce_ranges(features(s, d))


@query("spans_genome", _REDUCE + ' select seqnames, cast(sum("end" - "start" + 1) as bigint) as covered, sum("end" - "start" + 1) >= 1000000 as spans from u group by 1')
def _(s, d):
    n = F.sum(F.col("end") - F.col("start") + 1).cast("long")
    return cov.reduce_ranges(features(s, d)).groupBy("seqnames").agg(n.alias("covered"), (n >= 1000000).alias("spans"))


@query("hull_by_group", 'select grp, min(seqnames) as seqnames, min(strand) as strand, min("start") as "start", max("end") as "end", count(distinct seqnames || strand) > 1 as mixed from f group by 1')
def _(s, d):
    return cov.hull(features(s, d), "grp")


@query("disjoint_check", ', m as (select *, max("end") over (partition by seqnames, strand order by "start", "end" rows between unbounded preceding and 1 preceding) as before from f) select seqnames, strand, not bool_or(coalesce(before >= "start", false)) as is_disjoint from m group by 1, 2')
def _(s, d):
    return cov.disjoint(features(s, d))


def _signal(s, d) -> DataFrame:
    return features(s, d).select("seqnames", "start", "end", F.col("score").alias("value"))


_BINS = """, b as (select query, i as bin, seqnames, "start" - 1 + w * i // 5 + 1 as bs, greatest("start" - 1 + w * (i + 1) // 5, "start" - 1 + w * i // 5 + 1) as be, w
  from (select *, "end" - "start" + 1 as w from q), generate_series(0, 4) g(i)),
o as (select b.query, b.bin, b.w, cast(least(f."end", b.be) - greatest(f."start", b.bs) + 1 as double) as n, cast(f.score as double) as v
  from f join b on f.seqnames = b.seqnames and f."start" <= b.be and b.bs <= f."end"),
a as (select query, bin, any_value(w) as w, sum(n) as n, sum(n * v) as s, sum(n * v * v) as q, min(v) as lo, max(v) as hi from o group by 1, 2)
select b.query, cast(b.bin as int) as bin, {x} from b left join a on a.query = b.query and a.bin = b.bin"""
_STATS = {
    "mean": "round(s / n, 6)",
    "min": "lo",
    "max": "hi",
    "coverage": "round(n * 5 / a.w, 6)",
    "sd": "round(sqrt(greatest(0, a.q - s * s / n) / case when n > 1 then n - 1 else n end), 6)",
}


def _summary(kind: str):
    @query(f"summary_{kind}", _BINS.format(x=f"{_STATS[kind]} as {kind}_value"))
    def _(s, d):
        out = summary.summarise(_signal(s, d), ranges(s, d), 5)
        v = F.col(kind) if kind in ("min", "max") else F.round(kind, 6)
        return out.select("query", "bin", v.alias(f"{kind}_value"))


for _kind in _STATS:
    _summary(_kind)


@query("zoom_fixed", """, z as (select seqnames, w as win, least("end", (w + 1) * 4800) - greatest("start" - 1, w * 4800) as n, score as v from f, lateral (select unnest(generate_series(("start" - 1) // 4800, ("end" - 1) // 4800)) as w))
select seqnames, cast(win as bigint) as win, cast(sum(n) as bigint) as valid, min(v) as min_value, max(v) as max_value, cast(sum(n * v) as bigint) as sum_value, cast(sum(n * v * v) as bigint) as sum_squares from z group by 1, 2""")
def _(s, d):
    return cov.zoom(_signal(s, d), 4800)


@query("file_summary", 'select cast(sum("end" - "start" + 1) as bigint) as valid, min(score) as min_value, max(score) as max_value, cast(sum(("end" - "start" + 1) * score) as bigint) as sum_value from f')
def _(s, d):
    w = F.col("end") - F.col("start") + 1
    return features(s, d).agg(F.sum(w).cast("long").alias("valid"), F.min("score").alias("min_value"), F.max("score").alias("max_value"), F.sum(w * F.col("score")).cast("long").alias("sum_value"))


@query("seq_usage", 'select seqnames, count(*) as n, round(avg("end" - "start" + 1), 6) as mean_width, max("end") as last_end from f group by 1')
def _(s, d):
    return features(s, d).groupBy("seqnames").agg(F.count("*").alias("n"), F.round(F.avg(F.col("end") - F.col("start") + 1), 6).alias("mean_width"), F.max("end").alias("last_end"))


# --- line formats: built from the features, then read ------------------------------------------


@query("bed_scan", """select seqnames, "start", "end", concat('n', cast(grp as string)) as name, cast(score as double) as score, strand from f""")
def _(s, d):
    return L.bed(L.bed_lines(features(s, d).select("seqnames", "start", "end", F.concat(F.lit("n"), F.col("grp").cast("string")).alias("name"), "score", "strand")), 6)


@query("bed_project", 'select seqnames, "start", "end", strand from f where score > 25')
def _(s, d):
    return L.bed(L.bed_lines(features(s, d).select("seqnames", "start", "end", F.lit("x").alias("name"), "score", "strand")), 6).where("score > 25").select(CORE)


@query("bed12_scan", """select seqnames, "start", "end", strand, "start" as thick_start, "end" as thick_end, '#FF' || lpad(upper(hex(line)), 2, '0') || '01' as rgb, case when "end" > "start" then 2 else 1 end as n_blocks, "end" - "start" as last_start from f""")
def _(s, d):
    f, wide = features(s, d), F.col("end") > F.col("start")
    rgb = F.concat(F.lit("255,"), F.col("line").cast("string"), F.lit(",1"))
    w = (F.col("end") - F.col("start")).cast("string")
    line = F.concat_ws("\t", "seqnames", (F.col("start") - 1).cast("string"), F.col("end").cast("string"), F.lit("x"), F.lit("0"), "strand", (F.col("start") - 1).cast("string"), F.col("end").cast("string"), rgb, F.when(wide, "2").otherwise("1"), F.when(wide, "1,1,").otherwise("1,"), F.when(wide, F.concat(F.lit("0,"), w, F.lit(","))).otherwise("0,"))
    b = L.bed(f.select(line.alias("value")))
    return b.select(*CORE, F.col("thick.start").alias("thick_start"), F.col("thick.end").alias("thick_end"), F.col("itemRgb").alias("rgb"), F.size("blocks").alias("n_blocks"), (F.element_at("blocks", -1)["start"] - 1).alias("last_start"))


@query("bedgraph_scan", 'select seqnames, "start", "end", cast(score as double) as score from f')
def _(s, d):
    return L.bedgraph(L.bedgraph_lines(features(s, d)))


@query("bed15_scan", """select seqnames, "start", "end", concat('n', cast(grp as string)) as name, cast(score as double) as a, cast(null as double) as b from f""")
def _(s, d):
    blank = [F.lit(".")] * 7
    line = F.concat_ws("\t", "seqnames", (F.col("start") - 1).cast("string"), F.col("end").cast("string"), F.concat(F.lit("n"), F.col("grp").cast("string")), F.lit("0"), "strand", *blank[:6], F.lit("2"), F.lit("0,1"), F.concat(F.col("score").cast("string"), F.lit(",-10000,")))
    return L.bed15(features(s, d).select(line.alias("value")), ["a", "b"])


@query("bedpe_scan", """select seqnames as seq1, "start" as start1, "end" as end1, strand as strand1, 'chrX' as seq2, "start" + 500 as start2, "end" + 500 as end2, '*' as strand2, cast(score as double) as score from f""")
def _(s, d):
    a, b = (F.col("start") - 1).cast("string"), F.col("end").cast("string")
    line = F.concat_ws("\t", "seqnames", a, b, F.lit("chrX"), (F.col("start") + 499).cast("string"), (F.col("end") + 500).cast("string"), F.lit("p"), F.col("score").cast("string"), "strand", F.lit("."))
    p = L.bedpe(features(s, d).select(line.alias("value")))
    return p.select(*[F.col(f"{m}.{c}").alias(n + str(i)) for i, m in ((1, "first"), (2, "second")) for c, n in (("seqnames", "seq"), ("start", "start"), ("end", "end"), ("strand", "strand"))], "score")


@query("narrowpeak_scan", """select seqnames, "start", "end", '.' is null as has_name, cast(score as double) / 2 as signal, -1 as peak from f""")
def _(s, d):
    line = F.concat_ws("\t", "seqnames", (F.col("start") - 1).cast("string"), F.col("end").cast("string"), F.lit("."), F.lit("0"), F.lit("."), (F.col("score") / 2).cast("string"), F.lit("1.5"), F.lit("."), F.lit("-1"))
    return L.narrow_peak(features(s, d).select(line.alias("value"))).select("seqnames", "start", "end", F.col("name").isNotNull().alias("has_name"), F.col("signalValue").alias("signal"), "peak")


@query("broadpeak_scan", 'select seqnames, "start", "end", cast(score as double) / 2 as signal from f')
def _(s, d):
    line = F.concat_ws("\t", "seqnames", (F.col("start") - 1).cast("string"), F.col("end").cast("string"), F.lit("."), F.lit("0"), F.lit("."), (F.col("score") / 2).cast("string"), F.lit("1.5"), F.lit("."))
    return L.broad_peak(features(s, d).select(line.alias("value"))).select("seqnames", "start", "end", F.col("signalValue").alias("signal"))


def _gff3(s, d, keep=()) -> DataFrame:
    attrs = F.concat(F.lit("ID=g"), F.col("grp").cast("string"), F.lit(";Note=a%2Cb+c;Alias=x"), F.col("line").cast("string"), F.lit(",y%20z;bare; Val=1;Val="), F.col("score").cast("string"))
    line = F.concat_ws("\t", "seqnames", F.lit("src"), F.when(F.col("line") == 1, "gene").otherwise("exon"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), F.when(F.col("strand") == "*", "?").otherwise(F.col("strand")), F.lit("."), attrs)
    # through a generator: a line is built once, as one that is read is, and not again for each of its uses
    return features(s, d).select(F.explode(F.array(line)).alias("value"), *keep)


@query("gff3_attrs", """select seqnames, "start", "end", strand, case when line = 1 then 'gene' else 'exon' end as type, concat('g', cast(grp as string)) as ID, 'a,b+c' as Note, cast(score as string) as Val from f""")
def _(s, d):
    g = L.gff(_gff3(s, d), 3, ["ID", "Note", "Val"])
    return g.select(*CORE, "type", "ID", X.url_decode(F.col("Note")).alias("Note"), "Val")


@query("gff2_attrs", """select seqnames, "start", "end", concat('g;', cast(grp as string)) as gene_id, cast(line as string) as n, 'w t' as note from f""")
def _(s, d):
    attrs = F.concat(F.lit('gene_id "g;'), F.col("grp").cast("string"), F.lit('"; n '), F.col("line").cast("string"), F.lit(' ; note "w t"'))
    line = F.concat_ws("\t", "seqnames", F.lit("."), F.lit("exon"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), F.lit("."), F.lit("."), attrs)
    return L.gff(features(s, d).select(line.alias("value")), 2, ["gene_id", "n", "note"]).select("seqnames", "start", "end", "gene_id", "n", "note")


@query("gff_tags", """select tag, count(*) * any_value(k) as n, any_value(c) as has_comma from f, (values ('ID', 1, false), ('Note', 1, false), ('Alias', 1, true), ('Val', 2, false)) t(tag, k, c) group by 1""")
def _(s, d):
    return L.gff_tags(_gff3(s, d))


@query("gff_filter", """select seqnames, "start", "end" from f where line = 1""")
def _(s, d):
    return L.gff(_gff3(s, d), 3, [], {"type": ["gene"], "score": ["."]}).select("seqnames", "start", "end")


@query("gff_multi_value", """select concat('g', cast(grp as string)) as ID, v from f, lateral (select unnest(['x' || cast(line as string), 'y z']) as v)""")
def _(s, d):
    return L.gff(_gff3(s, d), 3, ["ID", "Alias"]).select("ID", F.explode(X.values(F.col("Alias"))).alias("v"))


@query("gff_limit", 'select seqnames, "start", "end" from f where line = 2 order by grp, part, "start" limit 10')
def _(s, d):
    lines = _gff3(s, d, ("grp", "part", "start", "line")).withColumns({"file": F.lit("f"), "ord": F.struct("grp", "part", "start")}).where("line = 2")
    return gff.read(lines.select("value", "file", "ord"), 3, tags=[], columns=["seqid", "start", "end"], nrows=10)


def _orders(s, d) -> DataFrame:
    return _t(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 24 + 1).alias("k"), F.round("o_totalprice").cast("long").alias("v"))


@query("wig_fixed", """select 'chr' || cast(o_custkey % 24 + 1 as string) as seqnames, cast(1 + (i * 10) as int) as "start", cast(1 + i * 10 + 4 as int) as "end", cast(round(o_totalprice) + i as double) as score from orders, generate_series(0, 2) g(i)""")
def _(s, d):
    decl = F.concat(F.lit("fixedStep chrom=chr"), F.col("k").cast("string"), F.lit(" start=1 step=10 span=5"))
    o = _orders(s, d).select(F.col("o_orderkey").cast("string").alias("file"), F.posexplode(F.array(decl, F.col("v").cast("string"), (F.col("v") + 1).cast("string"), (F.col("v") + 2).cast("string"))).alias("ord", "value"))
    return L.wig(o)


@query("wig_variable", """select 'chr' || cast(o_custkey % 24 + 1 as string) as seqnames, cast(o_orderkey + i as int) as "start", cast(o_orderkey + i + 2 as int) as "end", cast(round(o_totalprice) as double) as score from orders, (values (1), (7)) g(i)""")
def _(s, d):
    decl = F.concat(F.lit("variableStep chrom=chr"), F.col("k").cast("string"), F.lit(" span=3"))
    row = lambda i: F.concat_ws(" ", (F.col("o_orderkey") + i).cast("string"), F.col("v").cast("string"))
    return L.wig(_orders(s, d).select(F.col("o_orderkey").cast("string").alias("file"), F.posexplode(F.array(decl, row(1), row(7))).alias("ord", "value")))


@query("ucsc_tracks", """select cast(o_orderkey as string) as file, 'a b' as name, '5' as moved, l as line from orders, (values ('chr1' || chr(9) || '0' || chr(9) || '5'), ('chr1' || chr(9) || '7' || chr(9) || '9')) v(l)""")
def _(s, d):
    o = _orders(s, d).select(F.col("o_orderkey").cast("string").alias("file"), F.posexplode(F.array(F.lit('track type=bed name="a b" offset=5'), F.lit("chr1\t0\t5"), F.lit("chr1\t7\t9"))).alias("ord", "value"))
    return L.ucsc(o).select("file", F.col("track")["name"].alias("name"), F.col("track")["offset"].alias("moved"), F.col("value").alias("line"))


@query("tracks_features", """select 'a b' as track, seqnames, "start" + 5 as "start", "end" + 5 as "end", cast(score as double) as score from f where line = 1 union all select 'g', seqnames, "start", "end", cast(score as double) / 2 from f where line = 2""")
def _(s, d):
    f = features(s, d)
    place = F.concat_ws("\t", "seqnames", (F.col("start") - 1).cast("string"), F.col("end").cast("string"))
    head = s.createDataFrame([(0, 'track name="a b" offset=5'), (2, 'track type=bedGraph name="g"')], "k int, value string").select("k", F.lit(0).cast("long").alias("at"), "value")
    one = f.where("line = 1").select(F.lit(1).alias("k"), F.col("grp").alias("at"), F.concat_ws("\t", place, F.lit("x"), F.col("score").cast("string"), F.lit("+")).alias("value"))
    two = f.where("line = 2").select(F.lit(3).alias("k"), F.col("grp").alias("at"), F.concat_ws(" ", F.translate(place, "\t", " "), (F.col("score") / 2).cast("string")).alias("value"))
    lines = head.union(one).union(two).select("value", F.lit("f").alias("file"), (F.col("k").cast("long") * 2**40 + F.col("at")).alias("ord"))
    return tracks.as_features(lines).select("track", "seqnames", "start", "end", "score")


@query("chain_scan", """select 'chr' || cast(s_suppkey % 24 + 1 as string) as from_name, cast(t as bigint) as from_start, cast(w as int) as width, cast(o as bigint) as "offset", r as reversed from supplier, (values (101, 10, -100, false), (116, 20, -98, false)) v(t, w, o, r)""")
def _(s, d):
    head = F.concat(F.lit("chain 9 chr"), (F.col("s_suppkey") % 24 + 1).cast("string"), F.lit(" 1000 + 100 135 t1 500 + 200 233 "), F.col("s_suppkey").cast("string"))
    x = _t(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("file"), F.posexplode(F.array(head, F.lit("10 5 3"), F.lit("20"), F.lit(""))).alias("ord", "value"))
    return L.chain(x).select("from_name", "from_start", "width", "offset", "reversed")


@query("fasta_scan", "select 's' || cast(l_orderkey as string) as name, upper(l_returnflag || l_linestatus) as seq, 2 as width from lineitem")
def _(s, d):
    rec = F.concat(F.lit("s"), F.col("l_orderkey").cast("string"), F.lit(" note\n"), F.col("l_returnflag"), F.lit("\n"), F.col("l_linestatus"), F.lit("\n"))
    return L.fasta(_t(s, d, "lineitem").select(rec.alias("value"))).withColumn("width", F.length("seq"))


@query("bed_write_lines", """select seqnames || chr(9) || cast("start" - 1 as string) || chr(9) || cast("end" as string) || chr(9) || '.' || chr(9) || '0' || chr(9) || case strand when '*' then '.' else strand end as value from f""")
def _(s, d):
    return L.bed_lines(features(s, d).select(CORE))


@query("bedgraph_write_lines", """select seqnames || chr(9) || cast("start" - 1 as string) || chr(9) || cast("end" as string) || chr(9) || cast(score as string) as value from f""")
def _(s, d):
    return L.bedgraph_lines(features(s, d))


@query("gff3_write_lines", """select seqnames || chr(9) || 'trackforge' || chr(9) || 'sequence_feature' || chr(9) || cast("start" as string) || chr(9) || cast("end" as string) || chr(9) || cast(score as string) || chr(9) || case strand when '*' then '.' else strand end || chr(9) || '.' || chr(9) || 'ID=g%3B' || cast(grp as string) as value from f""")
def _(s, d):
    f = features(s, d).withColumn("ID", F.concat(F.lit("g;"), F.col("grp").cast("string"))).withColumn("Note", F.lit(None).cast("string"))
    return L.gff_lines(f, ["ID", "Note"])


@query("sam_lines", """select '*' || chr(9) || case strand when '-' then '16' else '0' end || chr(9) || seqnames || chr(9) || cast("start" as string) || chr(9) || '255' || chr(9) || cast(score as string) || 'M' || chr(9) || '*' || chr(9) || '0' || chr(9) || '0' || chr(9) || '*' || chr(9) || '*' as value from f""")
def _(s, d):
    return L.sam_lines(features(s, d).withColumn("cigar", F.concat(F.col("score").cast("string"), F.lit("M"))))


@query("sam_tags", """select 'r' || cast(grp as string) || chr(9) || '99' || chr(9) || seqnames || chr(9) || cast("start" as string) || chr(9) || cast(line as string) || chr(9) || cast(score as string) || 'M' || chr(9) || '*' || chr(9) || '0' || chr(9) || '0' || chr(9) || '*' || chr(9) || '*' || chr(9) || 'NM:i:' || cast(line as string) || chr(9) || 'XZ:Z:z' as value from f""")
def _(s, d):
    f = features(s, d).select(*CORE, F.concat(F.col("score").cast("string"), F.lit("M")).alias("cigar"), F.concat(F.lit("r"), "grp").alias("qname"), F.lit(99).alias("flag"), F.col("line").alias("mapq"), F.col("line").alias("NM"), F.lit("z").alias("XZ"))
    return L.sam_lines(f)


@query("sam_pairs", """select 'p' || cast(grp as string) as name, seqnames, "start", 1 + case when strand = '-' then 16 else 0 end + 64 as flag, "start" + 500 as mpos from f union all
select 'p' || cast(grp as string), seqnames, "start" + 500, 1 + case when strand = '-' then 32 else 0 end + 128, "start" from f""")
def _(s, d):
    a, b = F.struct("seqnames", "start", "end", "strand"), F.struct("seqnames", (F.col("start") + 500).alias("start"), (F.col("end") + 500).alias("end"), F.lit("+").alias("strand"))
    return L.paired(features(s, d).select(F.concat(F.lit("p"), "grp").alias("name"), a.alias("first"), b.alias("second"))).select("name", "seqnames", "start", "flag", "mpos")


@query("gff2_write_lines", """select seqnames || chr(9) || 'trackforge' || chr(9) || 'sequence_feature' || chr(9) || cast("start" as string) || chr(9) || cast("end" as string) || chr(9) || '.' || chr(9) || case strand when '*' then '.' else strand end || chr(9) || '.' || chr(9) || 'gene_id "g' || cast(grp as string) || '"; n ' || cast(line as string) as value from f""")
def _(s, d):
    return L.gff_lines(features(s, d).select(*CORE, F.concat(F.lit("g"), "grp").alias("gene_id"), F.col("line").alias("n")), ["gene_id", "n"], 2)


@query("gff3_list_lines", """select case when line % 3 = 0 then 2 else 1 end as part, seqnames || chr(9) || 'trackforge' || chr(9) || 'sequence_feature' || chr(9) || cast("start" as string) || chr(9) || cast("end" as string) || chr(9) || '.' || chr(9) || '.' || chr(9) || '.' || case when line % 3 = 0 then '' else chr(9) || 'Parent=p%2C' || cast(grp as string) || ',.' end as value from f""")
def _(s, d):
    parent = F.when(F.col("line") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("p,"), "grp"), F.lit(None).cast("string")))
    return gff.body_lines(features(s, d).select("seqnames", "start", "end", parent.alias("Parent")))


@query("tab_separated_lines", """select seqnames || chr(9) || cast("start" as string) || chr(9) || cast("end" as string) || chr(9) || cast(score as string) as value from f union all select 'seqnames' || chr(9) || 'start' || chr(9) || 'end' || chr(9) || 'score'""")
def _(s, d):
    return L.tab_separated_lines(features(s, d).select("seqnames", "start", "end", "score")).select("value")


@query("url_encode_except", "select p_partkey as k, 'chr%201%3B' || cast(p_size as string) || '%C3%A9|' as v from part")
def _(s, d):
    return _t(s, d, "part").select(F.col("p_partkey").alias("k"), X.url_encode_except(F.concat(F.lit("chr 1;"), F.col("p_size").cast("string"), F.lit("é|")), r"[a-zA-Z0-9.:^*$@!+_?|\-]").alias("v"))


_PAIR = """concat_ws(chr(9), a.seqnames, cast(a."start" - 1 as string), cast(a."end" as string), a.seqnames, cast(a."end" + 9 as string), cast(a."end" + 20 as string), 'p' || cast(grp as string), cast(score as string), case strand when '*' then '.' else strand end, '.', cast(line as string))"""


@query("bedpe_write_lines", f"select {_PAIR} as value from f a")
def _(s, d):
    first = F.struct("seqnames", "start", "end", "strand")
    second = F.struct("seqnames", (F.col("end") + 10).alias("start"), (F.col("end") + 20).alias("end"), F.lit("*").alias("strand"))
    return L.bedpe_lines(features(s, d).select(first.alias("first"), second.alias("second"), F.concat(F.lit("p"), "grp").alias("name"), "score", "line"))


@query("bed15_write", """select seqnames, "start", "end", cast(null as string) as name, cast(score as double) as a, cast(null as double) as b from f""")
def _(s, d):
    return L.bed15(L.bed15_lines(features(s, d).withColumns({"a": F.col("score").cast("double"), "b": F.lit(None).cast("double")}), ["a", "b"]), ["a", "b"])


_PLACES = """, p as (select distinct seqnames, "start" from f), v as (select seqnames, "start", 'variableStep chrom=' || seqnames || ' span=1' as head from p)"""


@query("wig_write_variable", _PLACES + """ select seqnames, cast(-1 as bigint) as place, any_value(head) as value from v group by 1 union all select seqnames, cast("start" as bigint), cast("start" as string) || ' ' || cast("start" % 7 as string) from v""")
def _(s, d):
    p = features(s, d).select("seqnames", "start").distinct()
    return L.wig_lines(p.select("seqnames", "start", F.col("start").alias("end"), (F.col("start") % 7).alias("score")), "variableStep")


@query("wig_write_fixed", """, n as (select 's' || cast(n_nationkey as string) as seqnames, n_nationkey as k from nation) select seqnames, cast(-1 as bigint) as place, 'fixedStep chrom=' || seqnames || ' start=' || cast(k + 1 as string) || ' step=10 span=5' as value from n union all select seqnames, cast(k + 1 + i * 10 as bigint), cast(k * i as string) from n, generate_series(0, 4) g(i)""")
def _(s, d):
    at = F.col("n_nationkey") + 1 + F.col("i") * 10
    n = _t(s, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    return L.wig_lines(n.select(F.concat(F.lit("s"), "n_nationkey").alias("seqnames"), at.alias("start"), (at + 4).alias("end"), (F.col("n_nationkey") * F.col("i")).alias("score")))


@query("hub_stanzas", """select 'o' || cast(o_orderkey as string) as file, cast(1 as bigint) as stanza, k as key, v as value from (select o_orderkey, unnest(['track', 'visibility', 'parent']) as k, unnest(['t' || cast(o_custkey as string), 'full x', 'top on']) as v from orders)""")
def _(s, d):
    text = F.array(F.lit("# a hub"), F.concat(F.lit("track t"), "o_custkey"), F.lit("\tvisibility full x"), F.lit("\tparent  top on"), F.lit(""))
    lines = _t(s, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("file"), F.posexplode(text).alias("ord", "value"))
    return hubs.stanzas(lines).select("file", "stanza", F.explode("fields").alias("key", "value"))


# --- nesting, order, functions -----------------------------------------------------------------


@query("blocks_explode", """select grp, seqnames, "start" + k as "start", "start" + k + 1 as "end", strand from f, (values (0), (5)) t(k)""")
def _(s, d):
    b = F.array(F.struct(F.lit(1).alias("start"), F.lit(2).alias("width")), F.struct(F.lit(6).alias("start"), F.lit(2).alias("width")))
    return nest.blocks(features(s, d).withColumn("blocks", b), "grp")


@query("as_bed", """, g as (select grp, seqnames, strand, min("start") as "start", max("end") as "end" from f group by 1, 2, 3),
b as (select grp, seqnames, strand, string_agg(cast("start" as string) || '+' || cast("end" - "start" + 1 as string), ',' order by "start", "end") as blocks from f group by 1, 2, 3)
select cast(g.grp as string) || g.seqnames || g.strand as name, g.seqnames, g."start", g."end", g.strand, b.blocks from g join b on b.grp = g.grp and b.seqnames = g.seqnames and b.strand = g.strand""")
def _(s, d):
    f = features(s, d).withColumn("g", F.concat(F.col("grp").cast("string"), "seqnames", "strand"))
    b = nest.as_bed(f, "g")
    return b.select("name", *CORE, F.array_join(F.transform("blocks", lambda x: F.concat((x["start"] + F.col("start") - 1).cast("string"), F.lit("+"), x["width"].cast("string"))), ",").alias("blocks"))


@query("as_gff", """select min(seqnames) as seqnames, min("start") as "start", max("end") as "end", min(strand) as strand, 'mRNA' as type, 'mRNA' || cast(grp as string) as ID, cast(null as string) as Parent from f group by grp
union all select seqnames, "start", "end", strand, 'exon', 'exon_' || cast(grp as string) || '_' || cast(row_number() over (partition by grp order by "start", "end", strand, seqnames) as string), 'mRNA' || cast(grp as string) from f""")
def _(s, d):
    return nest.as_gff(features(s, d), "grp")


_PARTS = """, p as (select s_suppkey as t, i, 'c' as seqnames, case s_suppkey % 2 when 0 then '+' else '-' end as strand, cast(i * 100 + 1 as int) as "start", cast(i * 100 + 1 + s_suppkey % 7 as int) as "end" from supplier, generate_series(0, 3) g(i)),
o as (select *, "end" - "start" + 1 as w, coalesce(sum("end" - "start" + 1) over (partition by t order by case strand when '-' then -"start" else "start" end rows between unbounded preceding and 1 preceding), 0) as before from p)"""


@query("reading_frame", """, r as (select grp, line, "start", "end", cast(coalesce(sum("end" - "start" + 1) over (partition by grp order by "start", "end" rows between unbounded preceding and 1 preceding), 0) % 3 as int) as frame from f) select grp, "start", "end", frame from r""")
def _(s, d):
    return nest.reading_frame(features(s, d), "grp").select("grp", "start", "end", "frame")


def _transcripts(s, d) -> DataFrame:
    k, i = F.col("s_suppkey"), F.col("i")
    x = _t(s, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    return x.select(k.alias("t"), F.lit("c").alias("seqnames"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), (i * 100 + 1).cast("int").alias("start"), (i * 100 + 1 + k % 7).cast("int").alias("end"))


@query("as_gtf", _PARTS + """, e as (select t, strand, "start", "end", w, before, unnest(generate_series(1, w)) as k from o), n as (select t, sum(w) as n from o group by 1),
b as (select e.t, e.strand, before + k as nth, case strand when '-' then "end" - k + 1 else "start" + k - 1 end as pos, "start" as part, n.n from e join n on n.t = e.t)
select cast(t as string) as transcript_id, 'start_codon' as type, cast(min(pos) as int) as "start", cast(max(pos) as int) as "end", cast((min(nth) - 1) % 3 as int) as frame from b where nth <= 3 group by t, part
union all select cast(t as string), 'stop_codon', cast(min(pos) as int), cast(max(pos) as int), cast((min(nth) - greatest(any_value(n) - 2, 1)) % 3 as int) from b where nth > n - 3 group by t, part
union all select cast(t as string), 'CDS', "start", "end", cast(before % 3 as int) from o""")
def _(s, d):
    return gff.as_gtf(_transcripts(s, d), "t").select("transcript_id", "type", "start", "end", "frame")


def _seqinfo(s, d) -> DataFrame:
    """Sequences chr1 to chr20 and chrX, in reverse order of number."""
    n = s.range(1, 22).select(F.col("id").cast("int").alias("n"))
    return n.select(F.when(F.col("n") == 21, "chrX").otherwise(F.concat(F.lit("chr"), F.col("n").cast("string"))).alias("seqnames"), (F.col("n") * 100000).cast("long").alias("seqlength"), F.lit("g1").alias("genome"), (21 - F.col("n")).alias("seq_rank"))


_INFO = """, i as (select case n when 21 then 'chrX' else 'chr' || cast(n as string) end as seqnames, cast(n * 100000 as bigint) as seqlength, 'g1' as genome, cast(21 - n as int) as seq_rank from generate_series(1, 21) t(n))"""


@query("sort_seq_start", _INFO + """ select cast(row_number() over (partition by f.seqnames order by "start", "end", grp, line, part, score, strand) as bigint) as place, f.seqnames, "start", "end", seq_rank from f left join i on i.seqnames = f.seqnames""")
def _(s, d):
    f = features(s, d).select("seqnames", "start", "end", "grp", "line", "part", "score", "strand")
    return genome.placed_by_level(f, _seqinfo(s, d)).select("place", "seqnames", "start", "end", "seq_rank")


@query("seqinfo_antijoin", _INFO + " select q.query, q.seqnames from q where not exists (select 1 from i where i.seqnames = q.seqnames)")
def _(s, d):
    return genome.unknown(ranges(s, d), _seqinfo(s, d)).select("query", "seqnames")


@query("seqinfo_known", _INFO + ' select q.query, q.seqnames, q."start" from q where exists (select 1 from i where i.seqnames = q.seqnames)')
def _(s, d):
    return genome.known(ranges(s, d), _seqinfo(s, d), "drop").select("query", "seqnames", "start")


@query("seqinfo_merge", _INFO + ", o as (select distinct seqnames from f) select coalesce(i.seqnames, o.seqnames) as seqnames, i.seqlength, i.genome from i full join o on o.seqnames = i.seqnames")
def _(s, d):
    o = features(s, d).select("seqnames").distinct().select("seqnames", F.lit(None).cast("long").alias("seqlength"), F.lit(None).cast("string").alias("genome"), F.lit(0).alias("seq_rank"))
    return genome.merge_seqinfo(_seqinfo(s, d), o).select("seqnames", "seqlength", "genome")


@query("seqlevels_union", _INFO + ", l as (select seqnames, 0 as t, min(query) as nth from q where query <= 5 group by 1 union all select seqnames, 1, 21 - seq_rank from i) select seqnames, cast(row_number() over (order by min(t * 1000 + nth)) as int) as rank from l group by 1")
def _(s, d):
    a = ranges(s, d).where("query <= 5").withColumn("ord", F.col("query"))
    x = genome.union_levels(a, _seqinfo(s, d).withColumn("ord", 21 - F.col("seq_rank")))
    return x.select("seqnames", F.row_number().over(Window.orderBy("seq_rank")).alias("rank"))  # a few names


@query("selection", _INFO + """ select seqnames, 1 as "start", cast(seqlength as int) as "end", '*' as strand from i where seqnames in ('chr2', 'chrX')""")
def _(s, d):
    return genome.selection(_seqinfo(s, d), ["chr2", "chrX"])[0]


@query("ranges_hull", """select seqnames, cast(min("start") as int) as "start", cast(max("end") as int) as "end", '*' as strand from q where seqnames = 'chr3' group by 1""")
def _(s, d):
    return genome.normalise(ranges(s, d).where("seqnames = 'chr3'"), 1)


@query("ranges_capped", """select seqnames, "start", "end", '*' as strand from q order by query limit 1000""")
def _(s, d):
    return genome.normalise(ranges(s, d).withColumn("ord", F.col("query")), 1000)


@query("names_filter", """select query, name from (select query, 'n' || cast(query % 10 as string) as name from q) where name in ('n3', 'n7')""")
def _(s, d):
    return genome.names_filter(ranges(s, d).select("query", F.concat(F.lit("n"), (F.col("query") % 10).cast("string")).alias("name")), ["n3", "n7"])


@query("offset_shift", """select query, "start" + 25 as "start", "end" + 25 as "end" from q""")
def _(s, d):
    return genome.shifted(ranges(s, d), 25).select("query", "start", "end")


@query("padded_union", """select query, "start", cast(null as int) as score from q union all select null, "start", score from f""")
def _(s, d):
    return genome.padded(ranges(s, d).select("query", "start"), features(s, d).select("start", "score"))


@query("letter_counts", """select c as letter, count(*) as n, c in ('A', 'C', 'G', 'T', 'N') as is_valid from (select unnest(string_split(upper(l_returnflag || 'acgtn' || l_linestatus), '')) as c from lineitem) group by 1""")
def _(s, d):
    return genome.letters(_t(s, d, "lineitem").select(F.concat("l_returnflag", F.lit("acgtn"), "l_linestatus").alias("seq")))


@query("split_ranges", """select strand, seqnames, count(*) as n, min("start") as first from f group by 1, 2""")
def _(s, d):
    x = nest.split_ranges(features(s, d).select("strand", "seqnames", "start", "end"), "strand", "seqnames")
    return x.select("strand", "seqnames", F.size("members").cast("long").alias("n"), F.col("members")[0]["start"].alias("first"))


@query("json_rows", """select event_id, cast(event_id as int) % 7 as bin, 'n' || cast(event_id as string) as name from events""")
def _(s, d):
    text = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("event_id"), (F.col("event_id") % 7).alias("bin"), F.concat(F.lit("n"), "event_id").alias("name"))).alias("gold")).alias("data")))
    return web.rows_table(s, _t(s, d, "events").select(text.alias("value")), "$.data.gold", "event_id long, bin int, name string")


@query("genome_ranges", """select seqnames, 1 as "start", max("end") as "end", '*' as strand from f group by 1""")
def _(s, d):
    return features(s, d).groupBy("seqnames").agg(F.lit(1).alias("start"), F.max("end").alias("end"), F.lit("*").alias("strand"))


@query("genome_tiles", """select query, cast(i as int) as bin, "start" - 1 + ("end" - "start" + 1) * i // 4 + 1 as "start", greatest("start" - 1 + ("end" - "start" + 1) * (i + 1) // 4, "start" - 1 + ("end" - "start" + 1) * i // 4 + 1) as "end" from q, generate_series(0, 3) g(i)""")
def _(s, d):
    return summary.bins(ranges(s, d), 4).select("query", "bin", "start", "end")


@query("dense_vector", """, p as (select seqnames, unnest(generate_series("start", "end")) as pos, score from f), v as (select seqnames, pos, sum(score) as v from p group by 1, 2), e as (select query, seqnames, unnest(generate_series("start", "end")) as pos from q)
select e.query, cast(sum(coalesce(v, 0)) as bigint) as total, count(*) as bases, count(v) as covered from e left join v on v.seqnames = e.seqnames and v.pos = e.pos group by 1""")
def _(s, d):
    x = nest.dense(_signal(s, d), ranges(s, d))
    return x.groupBy("query").agg(F.sum("value").cast("long").alias("total"), F.count("*").alias("bases"), F.count_if(F.col("value") != 0).alias("covered"))


@query("rle_runs", _SWEEP.format(v="1") + """, k as (select *, case when lag("end") over w = "start" - 1 and lag(v) over w = v then 0 else 1 end as new from r where "end" is not null and v <> 0 window w as (partition by seqnames order by "start")),
k2 as (select *, sum(new) over (partition by seqnames order by "start") as g from k) select seqnames, cast(min("start") as bigint) as "start", cast(max("end") as bigint) as "end", cast(any_value(v) as bigint) as value from k2 group by seqnames, g""")
def _(s, d):
    return cov.joined_runs(cov.coverage(features(s, d)))


@query("graph_type", """, g as (select 'all' as k, "start", "end" - "start" + 1 as w from f union all select 'one', "start", 5 from (select distinct "start" from f) union all select 'even', "start", 5 from (select unnest(generate_series(1, 2000, 500)) as "start")),
t as (select k, w, "start" - lag("start") over (partition by k order by "start", w) as step from g)
select k, case when min(w) = max(w) and (min(step) = max(step) or (3 < count(*) and avg(step) < 100)) then 'wig' else 'bedGraph' end as type from t group by 1""")
def _(s, d):
    f = features(s, d).select("seqnames", "start", "end")
    even = s.range(1, 2001, 500).select(F.lit("c").alias("seqnames"), F.col("id").cast("int").alias("start"))
    one = f.select(F.lit("c").alias("seqnames"), "start").distinct()
    rows = [("all", cov.graph_type(f)), *((k, cov.graph_type(x.withColumn("end", F.col("start") + 4))) for k, x in (("one", one), ("even", even)))]
    return s.createDataFrame(rows, "k string, type string")


@query("step_statistics", """, s as (select seqnames, "start", lag("start") over (partition by seqnames order by "start") as before from f) select seqnames, count(distinct "start" - before) as n_steps, round(avg("start" - before), 6) as mean_step from s group by 1""")
def _(s, d):
    x = cov.with_previous(features(s, d), ["seqnames"], ["end"]).withColumn("step", F.col("start") - F.col("_previous.start"))
    return x.groupBy("seqnames").agg(F.count_distinct("step").alias("n_steps"), F.round(F.avg("step"), 6).alias("mean_step"))


@query("zoom_again", """, z as (select seqnames, w as win, least("end", (w + 1) * 4800) - greatest("start" - 1, w * 4800) as n, score as v from f, lateral (select unnest(generate_series(("start" - 1) // 4800, ("end" - 1) // 4800)) as w))
select seqnames, cast(win as bigint) as win, cast(sum(n) as bigint) as valid, min(v) as min_value, max(v) as max_value, cast(sum(n * v) as bigint) as sum_value, cast(sum(n * v * v) as bigint) as sum_squares from z group by 1, 2""")
def _(s, d):
    return cov.zoom_again(cov.zoom(_signal(s, d), 1200), 4800, 1200)


@query("revcomp", "select l_orderkey as k, reverse(translate(l_returnflag || 'ACGTN' || l_linestatus, 'ACGTacgt', 'TGCAtgca')) as seq from lineitem")
def _(s, d):
    return _t(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), X.reverse_complement(F.concat("l_returnflag", F.lit("ACGTN"), "l_linestatus")).alias("seq"))


@query("url_decode", "select l_orderkey as k, 'a,b+' || l_returnflag as v from lineitem")
def _(s, d):
    return _t(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), X.url_decode(F.concat(F.lit("a%2Cb+"), "l_returnflag")).alias("v"))


@query("rgb_hex", "select p_partkey as k, '#' || lpad(upper(hex(p_size)), 2, '0') || '00FF' as v, cast(p_size as string) || ',0,255' as back from part")
def _(s, d):
    p = _t(s, d, "part").select(F.col("p_partkey").alias("k"), X.rgb_to_hex(F.concat(F.col("p_size").cast("string"), F.lit(",0,255"))).alias("v"))
    return p.withColumn("back", X.hex_to_rgb(F.col("v")))


@query("positions", """select query, seqnames || ':' || cast("start" as string) || '-' || cast("end" as string) as pos, "start" as parsed from q""")
def _(s, d):
    r = ranges(s, d).select("query", X.position(F.col("seqnames"), F.col("start"), F.col("end")).alias("pos"))
    return r.withColumn("parsed", X.parse_position(F.col("pos"))["start"])
