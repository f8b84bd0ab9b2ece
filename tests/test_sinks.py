"""WIG, BED15, BEDPE and 2bit: what is written is read back."""

from __future__ import annotations

import pytest

from trackforge.sources import lines as L
from trackforge.sources import twobit

from .test_formats import table

SIGNAL = "seqnames string, start int, end int, score double"


def _wig(df, kind="auto"):
    return [r.value for r in L.wig_lines(df, kind).orderBy("seqnames", "place").collect()]


def test_wig_picks_steps(spark):
    rows = [("a", 11, 15, 1.5), ("a", 1, 5, 2.0), ("a", 21, 25, None), ("b", 1, 2, 1.0), ("b", 9, 10, 3.0), ("b", 11, 12, 4.0)]
    out = _wig(spark.createDataFrame([r for r in rows if r[3] is not None], SIGNAL))
    assert out[0] == "fixedStep chrom=a start=1 step=10 span=5"
    assert out[3:] == ["variableStep chrom=b span=2", "1 1.0", "9 3.0", "11 4.0"]
    back = sorted(tuple(r) for r in L.wig(table(spark, *out)).collect())
    assert back == sorted(r for r in rows if r[3] is not None)


@pytest.mark.parametrize("rows,kind,fault", [([("a", 1, 5, 1.0), ("a", 5, 9, 1.0)], "auto", "overlap"), ([("a", 1, 5, 1.0), ("a", 7, 8, 1.0)], "auto", "several spans"), ([("a", 1, 1, 1.0), ("a", 3, 3, 1.0), ("a", 4, 4, 1.0)], "fixedStep", "uneven")])
def test_wig_refuses(spark, rows, kind, fault):
    with pytest.raises(Exception, match=fault):
        _wig(spark.createDataFrame(rows, SIGNAL), kind)


def test_wig_of_nothing(spark):
    assert _wig(spark.createDataFrame([], SIGNAL)) == []


def test_bed15_there_and_back(spark):
    df = spark.createDataFrame([("a", 5, 9, "n", 0.5, None), ("b", 1, 1, None, -1.0, 2.0)], "seqnames string, start int, end int, name string, x double, y double")
    out = L.bed15_lines(df, ["x", "y"])
    assert out.first().value.split("\t")[6:] == ["4", "9", "0", "1", "5", "0", "2", "0,1", "0.5,-10000.0"]
    assert sorted(tuple(r) for r in L.bed15(out, ["x", "y"]).collect()) == sorted(tuple(r) for r in df.collect())


def test_bedpe_there_and_back(spark):
    line = "a\t4\t9\tb\t0\t7\tp\t2.0\t+\t."
    pairs = L.bedpe(table(spark, line))
    assert L.bedpe_lines(pairs).first().value == line


def test_two_bit(spark, tmp_path):
    path = str(tmp_path / "x.2bit")
    seqs = [("s1", "ACGTNNacgtnA"), ("t", "G"), ("long", "ACGGT" * 1001)]
    twobit.write(spark.createDataFrame([(i, *x) for i, x in enumerate(seqs)], "ord int, name string, seq string"), path)
    assert [tuple(r) for r in twobit.seqinfo(spark, path).orderBy("seq_rank").collect()] == [(n, len(s), i) for i, (n, s) in enumerate(seqs)]
    with twobit.TwoBit(path) as t:
        for n, s in seqs:
            assert t.read(n, masked=True) == s and t.read(n) == s.upper()
        s = seqs[0][1]
        assert all(t.read("s1", a, b, True) == s[a - 1 : b] for a in range(1, 13) for b in range(a - 1, 13))
        for bad in (("no", 1, 1), ("t", 1, 2), ("t", 0, 1)):
            with pytest.raises(ValueError):
                t.read(*bad)
    got = twobit.scan(twobit.tiles(spark, path, 1000), path).orderBy("seqnames", "start").collect()
    joined = {}
    for r in got:
        joined[r.seqnames] = joined.get(r.seqnames, "") + r.seq
    assert joined == {n: s.upper() for n, s in seqs}
    for bad in (("x", ""), ("x", "ACU"), ("n" * 256, "A")):
        with pytest.raises(ValueError):
            twobit.encode([bad])
