"""GFF files: what ends them, directives, checks, and writing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trackforge.sources import gff

from .test_formats import table

LINE = "c\t.\tgene\t1\t9\t.\t?\t.\t"


def test_features_end_at_sequences(spark):
    x = table(spark, "##gff-version 3", LINE + "ID=1;A=x,y%2Cz;B=1", "", "# c", LINE + "ID=2;B=2;", ">seq", "ACGT", LINE + "ID=3")
    rows = gff.read(x).collect()
    assert gff.read(x).columns[-3:] == ["ID", "A", "B"]
    assert [(r.ID, list(r.A), r.B, r.strand, r.phase) for r in sorted(rows, key=lambda r: r.ID)] == [("1", ["x", "y,z"], "1", "*", None), ("2", [], "2", "*", None)]


@pytest.mark.parametrize("line,fault", [("c\t.\tx\t1", "columns"), ("c\t.\tx\t1\t2\t.\t.\t.\ta=1\tmore", "columns"), ("c\t.\tx\t1\t99999999999\t.\t.\t.\ta=1", "integer"), ("c\t.\tx\tone\t2\t.\t.\t.\ta=1", "integer")])
def test_faults_are_errors(spark, line, fault):
    with pytest.raises(Exception, match=fault):
        gff.read(table(spark, line), 3, tags=[]).collect()


def test_odd_lines_that_are_fine(spark):
    x = table(spark, "c\t.\tx\t1\t2\t 1.5 \t+\t0", "c\t.\tx\t 3 \t4\tbad\t-\t.\tID=1\t  ", "c\t.\tx\t5\t6\t.\t.\t.\tID=2\r")
    assert [tuple(r) for r in gff.read(x, 3, columns=["start", "score", "phase"], tags=["ID"]).orderBy("start").collect()] == [(1, 1.5, 0, None), (3, None, None, "1"), (5, None, None, "2")]


def test_styles():
    assert [gff.attribute_style(x) for x in ("ID=1", "ID =1", 'gene_id "a"', "group", "", "a;b")] == [3, 3, 2, 1, 0, 0]


def test_directives(spark):
    x = table(spark, "##gff-version 3", "##species A", "##species B", "##genome-build NCBI B36", "##sequence-region c 5 90", LINE + "ID=1", "##species C")
    with pytest.raises(ValueError, match="several species"):
        gff.species(x)
    assert gff.genome_build(x) == ("NCBI", "B36")
    assert [tuple(r) for r in gff.sequence_regions(x).collect()] == [("c", 5, 90, 90, False)]
    with pytest.warns(UserWarning):
        assert gff.sniff_version(table(spark, "##gff-version 2", "##gff-version 3", LINE)) == 2


def test_writing(spark):
    df = spark.createDataFrame([("c 1", 1, 5, "+", "a;b", 2.5, ["p", None]), ("d", 2, 3, "*", None, None, [])], "seqnames string, start int, end int, strand string, ID string, n double, P array<string>")
    lines = [r.value for r in gff.document(df, 3, genome="g", date="2020-01-02").orderBy("part").collect()]
    assert lines == ["##gff-version 3", "##date 2020-01-02", "##genome-build .\tg", "c%201\ttrackforge\tsequence_feature\t1\t5\t.\t+\t.\tID=a%3Bb;n=2.5;P=p,.", "d\ttrackforge\tsequence_feature\t2\t3\t.\t.\t."]
    assert [r.value.split("\t", 8)[-1] for r in gff.body_lines(df.limit(1), 2).collect()] == ['ID "a;b"; n 2.5; P "p,."']
    assert [r.value.split("\t", 8)[-1] for r in gff.body_lines(df.orderBy("start"), 1).collect()] == ["c 1", "d"]
    with pytest.raises(ValueError):
        gff.grouped_document(df, "ID", 2)
    with pytest.raises(Exception, match="several"):
        gff.as_gtf(df.withColumn("t", F.lit(1)), "t").collect()
