"""Golden tables of the line formats, and their way out and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackforge.functions import text as X
from trackforge.operators import nest, summary
from trackforge.operators.lift import lift_over
from trackforge.sources import lines as L


def table(spark, *lines):
    return spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, ord int, value string")


def test_bed12_there_and_back(spark):
    line = "chr7\t127471196\t127472363\tPos1\t0\t+\t127471196\t127472363\t255,0,0\t3\t300,200,567\t0,400,600"
    b = L.bed(table(spark, 'track name="x"', "# c", line))
    r = b.first()
    assert (r.seqnames, r.start, r.end, r.strand, r.name, r.score, r.itemRgb) == ("chr7", 127471197, 127472363, "+", "Pos1", 0.0, "#FF0000")
    assert [tuple(x) for x in r.blocks] == [(1, 300), (401, 200), (601, 567)]
    assert L.bed_lines(b.withColumn("score", F.col("score").cast("int"))).first().value == line


def test_wig_sections(spark):
    x = table(spark, "track type=wiggle_0", "variableStep chrom=chr19 span=150", "59304701 10.0", "fixedStep chrom=chr19 start=59307401 step=300 span=200", "1000", "900")
    assert sorted(tuple(r) for r in L.wig(x).collect()) == [("chr19", 59304701, 59304850, 10.0), ("chr19", 59307401, 59307600, 1000.0), ("chr19", 59307701, 59307900, 900.0)]


def test_gff3_attributes(spark):
    line = "c\t.\tgene\t1\t9\t.\t?\t.\tID=1;Note=a=b; X;Parent=p,q;ID=2"
    r = L.gff(table(spark, "##gff-version 3", line), 3, ["ID", "Note", "Parent", "X"]).first()
    assert (r.ID, r.Note, r.Parent, r.X, r.strand, r.source) == ("2", "a=b", "p,q", None, "*", None)


def test_gff2_attributes(spark):
    line = 'c\t.\tgene\t1\t9\t.\t+\t.\tgene_id "a;b"; n 3 ; note "w t"'
    r = L.gff(table(spark, line), 2, ["gene_id", "n", "note"]).first()
    assert (r.gene_id, r.n, r.note) == ("a;b", "3", "w t")


def test_url(spark):
    df = spark.createDataFrame([("a%2Cb+c",), ("50%",), (None,)], "v string")
    assert [r[0] for r in df.select(X.url_decode(F.col("v"))).collect()] == ["a,b+c", "50%", None]


def test_chain_reversed_and_forward(spark):
    c = L.chain(table(spark, "chain 1 a 1000 + 100 110 b 500 - 50 60 1", "10", "", "chain 1 a2 1000 + 100 110 b 500 + 200 210 2", "10", ""))
    rows = {r.from_name: r for r in c.collect()}
    assert (rows["a"].from_start, rows["a"].width, rows["a"].offset, rows["a"].reversed) == (101, 10, -340, True)
    f = spark.createDataFrame([("a", 101, 101, "+"), ("a", 110, 110, "-"), ("a2", 105, 120, "*")], "seqnames string, start int, end int, strand string")
    got = sorted((r.seqnames, r.start, r.end, r.strand) for r in lift_over(f, c).collect())
    assert got == [("b", 205, 210, "*"), ("b", 441, 441, "+"), ("b", 450, 450, "-")]


def test_summary_of_five_intervals(spark):
    s = spark.createDataFrame([("chr2", 1 + 300 * i, 300 + 300 * i, -1 + 0.25 * i) for i in range(5)], "seqnames string, start int, end int, value double")
    q = spark.createDataFrame([(1, "chr2", 1, 1500)], "query int, seqnames string, start int, end int")
    r = summary.summarise(s, q).first()
    assert (r["mean"], r["min"], r["max"], r["coverage"]) == (-0.5, -1.0, 0.0, 1.0)
    assert abs(r["sd"] - 0.353671) < 1e-6


def test_as_bed_and_frames(spark):
    e = spark.createDataFrame([("t", "chr1", 11, 20, "+"), ("t", "chr1", 31, 50, "+")], "g string, seqnames string, start int, end int, strand string")
    r = nest.as_bed(e, "g").first()
    assert (r.start, r.end, [tuple(b) for b in r.blocks]) == (11, 50, [(1, 10), (21, 20)])
    f = spark.createDataFrame([("t", 1, 10), ("t", 21, 27), ("t", 31, 35)], "g string, start int, end int")
    assert [x.frame for x in nest.reading_frame(f, "g").orderBy("start").collect()] == [0, 1, 2]


def test_bedpe_and_bedgraph(spark):
    r = L.bedpe(table(spark, "chr7\t9\t20\tchr8\t29\t40\tp\t37\t+\t.")).first()
    assert (r.first.start, r.second.seqnames, r.second.strand, r.score) == (10, "chr8", "*", 37.0)
    g = L.bedgraph(table(spark, "track type=bedGraph", "chr19 59302000 59302300 -1.0")).first()
    assert tuple(g) == ("chr19", 59302001, 59302300, -1.0)


def test_files(spark, tmp_path):
    f = spark.createDataFrame([("chr1", 1, 5), ("chr2", 3, 9)], "seqnames string, start int, end int")
    L.write_lines(L.bed_lines(f), str(tmp_path / "x"))
    back = L.bed(L.read_lines(spark, str(tmp_path / "x")), 3)
    assert sorted((r.seqnames, r.start, r.end, r.strand) for r in back.collect()) == [("chr1", 1, 5, "*"), ("chr2", 3, 9, "*")]
