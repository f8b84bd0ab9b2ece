"""BigWig: what is written is read back, whole and by ranges."""

from __future__ import annotations

import struct

import pytest

from trackforge.sources import bigwig

from .test_formats import table

SIGNAL = "seqnames string, start int, end int, score double"
ROWS = [("chr2", i * 5 + 1, i * 5 + 3, i / 4) for i in range(2500)] + [("chr19", 10, 20, -1.0), ("chr19", 21, 21, 2.5)]
LENGTHS = {"chr2": 20000, "chr19": 21, "chrX": 5}


def _brute(which):
    return sorted((n, max(s, a), min(e, b), v) for n, s, e, v in ROWS for m, a, b in which if m == n and s <= b and e >= a)


def test_there_and_back(spark, tmp_path):
    path = str(tmp_path / "x.bw")
    bigwig.write(spark.createDataFrame(ROWS, SIGNAL).repartition(4), path, LENGTHS, slot=3)
    assert sorted(tuple(r) for r in bigwig.scan(spark, path).collect()) == sorted(ROWS)
    assert {r.seqnames: r.seqlength for r in bigwig.seqinfo(spark, path).collect()} == LENGTHS
    with bigwig.BigWig(path) as w:
        w.f.seek(w.summary)
        assert struct.unpack("<Qdd", w.f.read(24)) == (7512, -1.0, 624.75)
        assert len(w.blocks([(1, 0, 5)])) < len(w.blocks(None)) > 256  # more than one level
    which = [("chr2", 2, 11), ("chr2", 5000, 5002), ("chr19", 20, 21), ("chrX", 1, 5)]
    assert sorted(tuple(r) for r in bigwig.scan(spark, path, which).collect()) == _brute(which)
    assert sorted(tuple(r) for r in bigwig.scan(spark, path, [("chr2", 1, 2), ("chr2", 2, 3)]).collect()) == _brute([("chr2", 1, 3)])
    with pytest.raises(ValueError, match="unknown"):
        bigwig.scan(spark, path, [("no", 1, 2)])


def test_empty(spark, tmp_path):
    path = str(tmp_path / "e.bw")
    bigwig.write(spark.createDataFrame([], SIGNAL), path, {"a": 5})
    assert bigwig.scan(spark, path).collect() == []


@pytest.mark.parametrize("rows", [[("a", 1, 3, 1.0), ("a", 3, 4, 1.0)], [("a", 1, 9, 1.0)], [("a", 1, 2, None)], [("b", 1, 2, 1.0)]])
def test_refused(spark, tmp_path, rows):
    with pytest.raises(Exception):
        bigwig.write(spark.createDataFrame(rows, SIGNAL), str(tmp_path / "r.bw"), {"a": 5})


def test_kinds_of_blocks():
    head = lambda kind, n: struct.pack("<IIIIIBBH", 7, 10, 99, 4, 2, kind, 0, n)
    for kind, body in ((bigwig.VARIABLE, struct.pack("<IfIf", 10, 1, 14, 2)), (bigwig.FIXED, struct.pack("<ff", 1, 2)), (bigwig.BEDGRAPH, struct.pack("<IIfIIf", 10, 12, 1, 14, 16, 2))):
        number, a, b, v = bigwig.decode(head(kind, 2) + body)
        assert (number, a.tolist(), b.tolist(), v.tolist()) == (7, [10, 14], [12, 16], [1.0, 2.0])


def test_from_wig(spark, tmp_path):
    path = str(tmp_path / "w.bw")
    wig = table(spark, "fixedStep chrom=a start=1 step=4", "1", "2", "variableStep chrom=a span=3", "9 5", "variableStep chrom=z", "1 1")
    with pytest.raises(Exception):
        bigwig.from_wig(wig, path, {"a": 10})
    bigwig.from_wig(wig, path, {"a": 10}, clip=True)
    assert sorted(tuple(r) for r in bigwig.scan(spark, path).collect()) == [("a", 1, 4, 1.0), ("a", 5, 8, 2.0), ("a", 9, 10, 5.0)]
