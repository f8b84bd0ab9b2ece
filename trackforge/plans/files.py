"""Registered queries that write files of a format from the given tables and read them again.

Files lie in a folder of the session: under spark.checkpoint.dir where that is set, else, on one machine, in a temporary
one. They go when the process ends.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage as cov
from ..sources import bam, bigbed, bigwig, gff, parts, tabix, tracks, twobit
from ..sources import lines as L
from .catalog import _SWEEP, CORE, _numbered, _t, features, query

LENGTHS = {f"chr{i}": 1_000_100 for i in range(1, 25)}


def _place(s: SparkSession, name: str) -> str:
    root = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not s.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.gettempdir()
    folder = f"{root.removeprefix('file://').rstrip('/')}/trackforge-files-{uuid.uuid4().hex}"
    os.makedirs(folder)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"{folder}/{name}"


_BED = """select seqnames, "start", "end", strand, concat('n', cast(grp as string)) as name, score from f"""


def _named(s, d) -> DataFrame:
    return features(s, d).select(*CORE, F.concat(F.lit("n"), F.col("grp").cast("string")).alias("name"), "score")


def _bigbed(s, d, **options) -> str:
    path = _place(s, "x.bb")
    bigbed.write(_named(s, d), path, LENGTHS, **options)
    return path


@query("bigbed_scan", _BED)
def _(s, d):
    return bigbed.scan(s, _bigbed(s, d))


@query("bigbed_range", """select seqnames, "start", "end", strand, score from f where (seqnames = 'chr3' and "start" <= 500000 and "end" >= 100000) or (seqnames = 'chr7' and "start" <= 1000 and "end" >= 1)""")
def _(s, d):
    return bigbed.scan(s, _bigbed(s, d), [("chr3", 100000, 300000), ("chr3", 300001, 500000), ("chr7", 1, 1000)], ["score"])


@query("bigbed_by_name", """, k as (select grp from f order by grp limit 1) select seqnames, "start", "end", strand, concat('n', cast(grp as string)) as name, score from f where grp in (select grp from k)""")
def _(s, d):
    first = features(s, d).agg(F.min("grp")).first()[0]
    return bigbed.by_name(s, _bigbed(s, d, indexes=("name",)), f"n{first}")


@query("bigbed_fields", "select * from (values ('name', 'string', false), ('score', 'uint', false), ('strand', 'char', false), ('depth', 'double', true)) t(field, kind, further)")
def _(s, d):
    path = _place(s, "x.bb")
    bigbed.write(_named(s, d).withColumn("depth", F.col("score") / 2), path, LENGTHS)
    further = bigbed.field_names(path)[1]
    with bigbed.BigBed(path) as b:
        return s.createDataFrame([(f.name, f.kind, f.name in further) for f in b.description().fields[3:]], "field string, kind string, further boolean")


@query("bigbed_extra", """select seqnames, "start", "end", strand, concat('n', cast(grp as string)) as name, cast(score as double) / 2 as depth from f where score > 40""")
def _(s, d):
    path = _place(s, "x.bb")
    bigbed.write(_named(s, d).where("score > 40").withColumn("depth", F.col("score") / 2), path, LENGTHS)
    return bigbed.scan(s, path, columns=["name", "depth"])


@query("bigbed_limit", """select seqnames, "start", "end" from f order by seqnames, "start", "end" limit 25""")
def _(s, d):
    return bigbed.scan(s, _bigbed(s, d), columns=[], most=25).select("seqnames", "start", "end")


@query("bigbed_zoom", _SWEEP.format(v="1") + """, k as (select seqnames, w as win, least("end", (w + 1) * 5000) - greatest("start" - 1, w * 5000) as n, v from r, lateral (select unnest(generate_series(("start" - 1) // 5000, ("end" - 1) // 5000)) as w) where "end" is not null and v <> 0)
select seqnames, cast(win * 5000 + 1 as int) as "start", cast(sum(n) as bigint) as valid, cast(min(v) as double) as min_value, cast(max(v) as double) as max_value from k group by seqnames, win""")
def _(s, d):
    return bigwig.scan_zoom(s, _bigbed(s, d, zooms=[1250, 5000]), 1, bigbed.BigBed).select("seqnames", "start", "valid", "min_value", "max_value")


def _signal(s, d) -> DataFrame:
    return cov.coverage(features(s, d), "score").select("seqnames", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("value").cast("double").alias("score"))


def _bigwig(s, d, **options) -> str:
    path = _place(s, "x.bw")
    bigwig.write(_signal(s, d), path, LENGTHS, **options)
    return path


@query("bigwig_scan", _SWEEP.format(v="score") + ' select seqnames, cast("start" as int) as "start", cast("end" as int) as "end", cast(v as double) as score from r where "end" is not null and v <> 0')
def _(s, d):
    return bigwig.scan(s, _bigwig(s, d))


@query("bigwig_range", _SWEEP.format(v="score") + """ select seqnames, cast(greatest("start", 250001) as int) as "start", cast(least("end", 260000) as int) as "end", cast(v as double) as score from r where "end" is not null and v <> 0 and seqnames = 'chr2' and "start" <= 260000 and "end" >= 250001""")
def _(s, d):
    return bigwig.scan(s, _bigwig(s, d), [("chr2", 250001, 255000), ("chr2", 254000, 260000)])


@query("bigwig_places", _SWEEP.format(v="score") + """ select seqnames, cast("start" as int) as "start", cast("end" as int) as "end" from r where "end" is not null and v <> 0 and seqnames = 'chr5'""")
def _(s, d):
    return bigwig.scan(s, _bigwig(s, d), [("chr5", 1, 1_000_100), ("chrQ", 1, 5)], columns=[], missing="warn")


@query("bigwig_zoom", _SWEEP.format(v="score") + """, k as (select seqnames, w as win, least("end", (w + 1) * 4000) - greatest("start" - 1, w * 4000) as n, v from r, lateral (select unnest(generate_series(("start" - 1) // 4000, ("end" - 1) // 4000)) as w) where "end" is not null and v <> 0)
select seqnames, cast(win * 4000 + 1 as int) as "start", cast(sum(n) as bigint) as valid, cast(min(v) as double) as min_value, cast(max(v) as double) as max_value, cast(sum(n * v) as double) as sum_value from k group by seqnames, win""")
def _(s, d):
    return bigwig.scan_zoom(s, _bigwig(s, d, zooms=[1000, 4000]), 1).select("seqnames", "start", "valid", "min_value", "max_value", "sum_value")


@query("bigwig_total", _SWEEP.format(v="score") + """ select cast(sum("end" - "start" + 1) as bigint) as valid, cast(min(v) as double) as min_value, cast(max(v) as double) as max_value, cast(sum(("end" - "start" + 1) * v) as double) as sum_value from r where "end" is not null and v <> 0""")
def _(s, d):
    with bigwig.BigWig(_bigwig(s, d)) as w:
        t = w.total()
    return s.createDataFrame([(t["valid"], t["min_value"], t["max_value"], t["sum_value"])], "valid long, min_value double, max_value double, sum_value double")


@query("bigwig_dense", """select 's' || cast(n_nationkey as string) as seqnames, cast(i + 1 as int) as pos, cast(n_nationkey * 10 + i as double) as score from nation, generate_series(0, 6) g(i) where i <> 3""")
def _(s, d):
    path = _place(s, "d.bw")
    values = F.array(*[F.lit(None).cast("double") if i == 3 else (F.col("n_nationkey") * 10 + i).cast("double") for i in range(7)])
    bigwig.write_list(_t(s, d, "nation").select(F.concat(F.lit("s"), "n_nationkey").alias("seqnames"), values.alias("values")), path)
    return bigwig.scan(s, path).select("seqnames", F.explode(F.sequence("start", "end")).alias("pos"), "score")


@query("bigwig_runs", """select 's' || cast(n_nationkey as string) as seqnames, cast(i * 10 + 1 as int) as "start", cast(i * 10 + 10 as int) as "end", cast(i as double) as score from nation, generate_series(0, 4) g(i)""")
def _(s, d):
    path, i = _place(s, "r.bw"), F.col("i")
    x = _t(s, d, "nation").select(F.concat(F.lit("s"), "n_nationkey").alias("seqnames"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    bigwig.write_list(x.select("seqnames", (i * 10 + 1).alias("start"), (i * 10 + 10).alias("end"), i.cast("double").alias("value")), path)
    return bigwig.scan(s, path)


@query("bigwig_files", _SWEEP.format(v="score") + """ select k as file, count(*) as n from r, (values ('a'), ('b')) t(k) where "end" is not null and v <> 0 group by 1""")
def _(s, d):
    one, two = _bigwig(s, d), _bigwig(s, d)
    x = bigwig.scan_files(s, [one, two])
    return x.groupBy(F.when(F.col("file") == one, "a").otherwise("b").alias("file")).agg(F.count("*").alias("n"))


@query("wig_to_bigwig", """select 's' || cast(n_nationkey as string) as seqnames, cast(1 + i * 10 as int) as "start", cast(10 + i * 10 as int) as "end", cast(n_nationkey + i as double) as score from nation, generate_series(0, 2) g(i)""")
def _(s, d):
    k = F.col("n_nationkey")
    text = F.array(F.concat(F.lit("fixedStep chrom=s"), k.cast("string"), F.lit(" start=1 step=10")), *[(k + i).cast("string") for i in range(3)])
    lines = _t(s, d, "nation").select(F.lit("f").alias("file"), k.alias("k"), F.posexplode(text).alias("p", "value")).select("file", (F.col("k") * 10 + F.col("p")).cast("long").alias("ord"), "value")
    path = _place(s, "w.bw")
    bigwig.from_wig(lines, path, {f"s{i}": 30 for i in range(25)})
    return bigwig.scan(s, path)


# --- text files --------------------------------------------------------------------------------


@query("bed_file", _BED.replace("score from", "cast(score as double) as score from"))
def _(s, d):
    path = _place(s, "bed")
    L.write_lines(L.bed_lines(_named(s, d)), path)
    return L.read_bed(L.read_lines(s, path))


@query("bed_file_columns", """select seqnames, "start", "end", '*' as strand, cast(score as double) as score from f""")
def _(s, d):
    path = _place(s, "bed")
    L.write_lines(L.bed_lines(_named(s, d)), path)
    return L.read_bed(L.read_lines(s, path), names=["score"])


@query("bed_file_extra", """select seqnames, "start", "end", concat('n', cast(grp as string)) as name, cast(line as double) as depth from f""")
def _(s, d):
    path = _place(s, "bed")
    line = F.concat_ws(" ", "seqnames", (F.col("start") - 1).cast("string"), F.col("end").cast("string"), F.concat(F.lit("n"), F.col("grp").cast("string")), F.col("line").cast("string"))
    L.write_lines(features(s, d).select(line.alias("value")), path)
    return L.read_bed(L.read_lines(s, path), {"depth": "double"}).select("seqnames", "start", "end", "name", "depth")


@query("bed15_file", """select seqnames, "start", "end", cast(line as double) as b, cast(score as double) as a from f""")
def _(s, d):
    path = _place(s, "bed15")
    rows = features(s, d).select("seqnames", "start", "end", F.col("score").cast("double").alias("x"), F.col("line").cast("double").alias("y"))
    body = L.bed15_lines(rows, ["x", "y"]).withColumn("value", F.replace("value", F.lit("\t0,1\t"), F.lit("\t1,0\t")))
    top = s.createDataFrame([('track type="array" expNames="a,b,"',)], "value string")
    L.write_lines(top.coalesce(1).union(body), path)
    out = L.bed15(L.read_lines(s, path))
    return out.select("seqnames", "start", "end", F.col("a").alias("b"), F.col("b").alias("a"))


@query("wig_file", """select distinct seqnames, "start", "start" as "end", cast("start" % 7 as double) as score from f""")
def _(s, d):
    path = _place(s, "wig")
    p = features(s, d).select("seqnames", "start").distinct().select("seqnames", "start", F.col("start").alias("end"), (F.col("start") % 7).alias("score"))
    doc = L.wig_lines(p, "variableStep").repartition(8, "seqnames").sortWithinPartitions("seqnames", "place")
    L.write_lines(doc, path)
    return L.wig(L.read_lines(s, path))


@query("wig_file_pruned", """select distinct seqnames, "start" from f where seqnames in ('chr1', 'chr9')""")
def _(s, d):
    path = _place(s, "wig")
    p = features(s, d).select("seqnames", "start").distinct().select("seqnames", "start", F.col("start").alias("end"), F.lit(1).alias("score"))
    L.write_lines(L.wig_lines(p, "variableStep").repartition(8, "seqnames").sortWithinPartitions("seqnames", "place"), path)
    return L.wig(L.read_lines(s, path), ["chr1", "chr9"]).select("seqnames", "start")


def _gff_file(s, d, tail: list[str] = (), top: list[str] = ()) -> DataFrame:
    f = features(s, d).select(*CORE, F.when(F.col("line") == 1, "gene").otherwise("exon").alias("type"), F.concat(F.lit("g;"), F.col("grp").cast("string")).alias("ID"), F.array(F.concat(F.lit("x"), F.col("line").cast("string")), F.lit("y z")).alias("Alias"))
    lines = gff.document(f, 3, genome="hgX", date="2020-01-31").union(s.createDataFrame([(0, x) for x in top] + [(3, x) for x in tail], "part int, value string"))
    path = _place(s, "gff")
    parts.write_text(lines, path, "part")  # one file, so that what ends it ends all
    return L.read_lines(s, path)


@query("gff_fasta", """select seqnames, "start", "end", strand, case when line = 1 then 'gene' else 'exon' end as type, 'g;' || cast(grp as string) as ID, ['x' || cast(line as string), 'y z'] as Alias from f""")
def _(s, d):
    return gff.read(_gff_file(s, d, ["##FASTA", ">chr1", "ACGTTT", "ACG"])).select(*CORE, "type", "ID", "Alias")


@query("gff_directives", "select * from (values ('build', 'hgX'), ('species', 'Homo'), ('provider', '.'), ('version', '3'), ('chr1', '5000'), ('chr2', '700')) t(k, v)")
def _(s, d):
    x = _gff_file(s, d, top=["##species Homo", "##sequence-region chr1 1 5000", "##sequence-region chr2 1 700", "##sequence-region chr1 1 400"])
    provider, build = gff.genome_build(x)
    rows = [("build", build), ("provider", provider), ("species", gff.species(x)), ("version", str(gff.sniff_version(x)))]
    return s.createDataFrame(rows, "k string, v string").union(gff.sequence_regions(x).select("seqnames", F.col("seqlength").cast("string")))


@query("gff_sniff", "select * from (values ('named', 2), ('tag=value', 3), ('tag value', 2), ('word', 1)) t(k, v)")
def _(s, d):
    rows = {"named": ["##gff-version 2", "c\t.\tx\t1\t2\t.\t.\t.\tID=1"], "tag=value": ["# x", "c\t.\tx\t1\t2\t.\t.\t.\tID=1"], "tag value": ["c\t.\tx\t1\t2\t.\t.\t.\tID 1"], "word": ["c\t.\tx\t1\t2\t.\t.\t.\tgroup1"]}
    out = []
    for k, lines in rows.items():
        out.append((k, gff.sniff_version(s.createDataFrame([(x, "f", i) for i, x in enumerate(lines)], "value string, file string, ord int"))))
    return s.createDataFrame(out, "k string, v int")


@query("gff_pragmas", "select '##gff-version 3' as value union all select '##date 2020-01-31' union all select '##genome-build .' || chr(9) || 'hgX'")
def _(s, d):
    return gff.pragmas(_gff_file(s, d, ["##late", ">s", "##later"])).select("value")


@query("gff_grouped", """select min(seqnames) as seqnames, min("start") as "start", 'mRNA' as type, 'mRNA' || cast(grp as string) as ID, cast(null as string) as Parent from f group by grp
union all select seqnames, "start", 'exon', 'exon_' || cast(grp as string) || '_' || cast(row_number() over (partition by grp order by "start", "end", strand, seqnames) as string), 'mRNA' || cast(grp as string) from f""")
def _(s, d):
    path = _place(s, "gff")
    gff.write(s, gff.grouped_document(features(s, d), "grp"), path)
    return gff.read(L.read_lines(s, path), tags=["ID", "Parent"]).select("seqnames", "start", "type", "ID", "Parent")


@query("gff_raw", """select seqnames as seqid, cast("start" as string) as "start", '.' as phase from f""")
def _(s, d):
    return gff.read(_gff_file(s, d), 3, columns=["seqid", "start", "phase"], tags=[], raw=True)


@query("tab_separated_file", """select seqnames, "start", "end", '*' as strand, cast(score as string) as score from f""")
def _(s, d):
    path = _place(s, "tab")
    doc = L.tab_separated_lines(features(s, d).select("seqnames", "start", "end", "score"))
    parts.write_text(doc, path, "part")
    return L.tab_separated(L.read_lines(s, path), header=True)


@query("tracks_file", """select 'Track 1' as track, seqnames, "start", "end", score from (select distinct on (seqnames, "start") seqnames, "start", "start" as "end", 'x' as score from f) union all select 'named', seqnames, "start", "end", concat('n', cast(grp as string)) from f where line = 1""")
def _(s, d):
    path = _place(s, "tracks")
    p = features(s, d).select("seqnames", "start").distinct().select("seqnames", "start", F.col("start").alias("end"), F.lit(1).alias("score"))
    b = features(s, d).where("line = 1").select(*CORE, F.concat(F.lit("n"), F.col("grp").cast("string")).alias("name"))
    doc = tracks.document([(None, p), (tracks.BasicTrackLine(name="named", offset=7), b)])
    parts.write_text(doc, path, "track", "k1", "k2")
    return tracks.as_features(L.read_lines(s, path)).select("track", "seqnames", "start", "end", F.coalesce("name", F.lit("x")).alias("score"))


@query("sam_file", """select 'r' || cast(grp as string) as qname, case strand when '-' then '-' else '+' end as strand, seqnames, "start", "end", cast(score as string) || 'M' as cigar, cast(line as string) as nm from f""")
def _(s, d):
    path = _place(s, "sam")
    L.write_lines(L.sam_lines(_alignments(s, d)), path)
    return L.sam(L.read_lines(s, path)).select("qname", "strand", "seqnames", "start", "end", "cigar", F.col("tags")["NM"].alias("nm"))


def _alignments(s, d) -> DataFrame:
    return features(s, d).select(*CORE, F.concat(F.col("score").cast("string"), F.lit("M")).alias("cigar"), F.concat(F.lit("r"), "grp").alias("qname"), F.col("line").alias("NM"))


@query("bam_scan", """select 'r' || cast(grp as string) as qname, case strand when '-' then '-' else '+' end as strand, seqnames, "start", "end", cast(score as string) || 'M' as cigar, cast(line as string) as nm, 255 as mapq from f""")
def _(s, d):
    path = _place(s, "x.bam")
    bam.write(L.sam_lines(_alignments(s, d)), path, list(LENGTHS.items()))
    return bam.scan(s, path, 8).select("qname", "strand", "seqnames", "start", "end", "cigar", F.col("tags")["NM"].alias("nm"), "mapq")


@query("bam_pairs", """select 'p' || cast(grp * 1000000 + part * 10 + line as string) as name, "start" as first_start, "start" + 500 as second_start from f1""")
def _(s, d):
    path = _place(s, "p.bam")
    mate = lambda by: F.struct("seqnames", (F.col("start") + by).alias("start"), (F.col("end") + by).alias("end"), F.lit("+").alias("strand"), F.concat(F.col("score").cast("string"), F.lit("M")).alias("cigar"))
    pairs = _numbered(s, d).select(F.concat(F.lit("p"), "ord").alias("name"), mate(0).alias("first"), mate(500).alias("second"))
    bam.write(L.sam_lines(L.paired(pairs)), path, [(k, v + 1000) for k, v in LENGTHS.items()])
    return bam.pairs(bam.scan(s, path)).select("name", F.col("first.start").alias("first_start"), F.col("second.start").alias("second_start"))


@query("tabix_scan", """select seqnames, "start", "end", strand, concat('n', cast(grp as string)) as name, cast(score as double) as score from f where (seqnames = 'chr3' and "start" <= 500000 and "end" >= 100000) or (seqnames = 'chr7' and "start" <= 1000 and "end" >= 1)""")
def _(s, d):
    path = _place(s, "x.bed.gz")
    tabix.write(L.bed_lines(_named(s, d)), path, kind=0x10000)
    return tabix.scan(s, path, [("chr3", 100000, 300000), ("chr3", 290000, 500000), ("chr7", 1, 1000)])


@query("tabix_export", """select seqnames, "start", "end", '*' as strand, cast(score as string) as score from f""")
def _(s, d):
    path = _place(s, "x.tab.gz")
    tabix.export(features(s, d).select("seqnames", "start", "end", "score"), path)
    return tabix.scan(s, path)


@query("index_track", """select seqnames, "start", "end" from f where seqnames = 'chr11'""")
def _(s, d):
    path = _place(s, "x.bed")
    parts.write_text(L.bed_lines(_named(s, d)), path)
    return tabix.scan(s, tabix.index_track(s, path), [("chr11", 1, 2_000_000)]).select("seqnames", "start", "end")


@query("two_bit", """select 's' || cast(n_nationkey as string) as seqnames, cast(3 as bigint) as "start", cast(9 as bigint) as "end", substring(repeat('ACGTN' || upper(substring(translate(n_name, 'BDEFHIJKLMOPQRSUVWXYZ ', 'AAAAAAAAAAAAAAAAAAAAAA'), 1, 4)), 2), 3, 7) as seq from nation""")
def _(s, d):
    path = _place(s, "x.2bit")
    seq = F.repeat(F.concat(F.lit("ACGTN"), F.upper(F.substring(F.translate("n_name", "BDEFHIJKLMOPQRSUVWXYZ ", "A" * 22), 1, 4))), 2)
    twobit.write(_t(s, d, "nation").select(F.concat(F.lit("s"), "n_nationkey").alias("name"), seq.alias("seq"), F.col("n_nationkey").alias("ord")), path)
    asked = twobit.seqinfo(s, path).select("seqnames", F.lit(3).cast("long").alias("start"), F.lit(9).cast("long").alias("end"))
    return twobit.scan(asked, path)


@query("fasta_file", "select 's' || cast(o_orderkey as string) as name, repeat('ACG', 1 + cast(o_orderkey % 5 as int)) as seq from orders")
def _(s, d):
    path = _place(s, "fa")
    seq = F.expr("repeat('ACG', cast(1 + o_orderkey % 5 as int))")
    L.write_lines(L.fasta_lines(_t(s, d, "orders").select(F.concat(F.lit("s"), "o_orderkey").alias("name"), seq.alias("seq"))), path)
    return L.fasta(s.read.option("lineSep", ">").text(path))
