"""BigBed, zoom levels, BAM and tabix: what SQL does not show."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from trackforge.operators import coverage as cov
from trackforge.sources import bam, bgzf, bigbed, bigwig, tabix
from trackforge.sources import lines as L

FULL = "seqnames string, start int, end int, strand string, name string, score int, itemRgb string, thick struct<start:int,end:int>, blocks array<struct<start:int,width:int>>, depth double, note string"
ROWS = [("chr1", 10, 40, "+", "a", 5, "#FF0010", (12, 30), [(1, 5), (21, 11)], 0.5, "x y"), ("chr2", 1, 1, "*", "b", 0, "#000000", (1, 1), [(1, 1)], -1.0, "")]


def test_bigbed_with_all_fields(spark, tmp_path):
    path = str(tmp_path / "x.bb")
    bigbed.write(spark.createDataFrame(ROWS, FULL), path, {"chr1": 100, "chr2": 5}, indexes=("name", "note"))
    assert bigbed.field_names(path) == (["name", "score", "thick", "itemRgb", "blocks"], ["depth", "note"])
    got = bigbed.scan(spark, path).orderBy("start").collect()
    assert [(r.seqnames, r.start, r.end, r.strand, r["name"], r.score, tuple(r.thick), [tuple(b) for b in r.blocks], r.depth, r.note) for r in got] == [(x[0], x[1], x[2], x[3], x[4], x[5], x[7], x[8], x[9], x[10]) for x in sorted(ROWS, key=lambda r: r[1])]
    assert [r.itemRgb for r in got] == ["#000000", "#FF0010"]
    assert bigbed.scan(spark, path, legacy=True).orderBy("start").first().start == 0
    assert [r["name"] for r in bigbed.by_name(spark, path, "x y", "note").collect()] == ["a"] and bigbed.by_name(spark, path, "q", "note").count() == 0
    with pytest.warns(UserWarning):
        assert bigbed.scan(spark, path, [("no", 1, 5)], ["name", "gone"]).count() == 0
    with bigbed.BigBed(path) as b:
        assert (b.fields, b.defined) == (14, 12) and b.total()["valid"] == 32


def test_bigbed_names_in_many_leaves(spark, tmp_path):
    path = str(tmp_path / "n.bb")
    rows = [("c", i + 1, i + 1, f"n{i % 700}") for i in range(3000)]
    bigbed.write(spark.createDataFrame(rows, "seqnames string, start int, end int, name string"), path, {"c": 3000}, slot=7, indexes=("name",))
    for name in ("n0", "n13", "n699", "n350"):
        assert sorted(r.start for r in bigbed.by_name(spark, path, name).collect()) == [r[1] for r in rows if r[3] == name]


def test_bigbed_without_width_and_uncompressed(spark, tmp_path):
    path = str(tmp_path / "z.bb")
    bigbed.write(spark.createDataFrame([("c", 6, 5, "p"), ("c", 8, 9, "q")], "seqnames string, start int, end int, name string"), path, {"c": 20}, compress=False)
    assert [r["name"] for r in bigbed.scan(spark, path, [("c", 6, 6)]).collect()] == ["p"]
    assert [r["name"] for r in bigbed.scan(spark, path, [("c", 7, 8)]).collect()] == ["q"]


@pytest.mark.parametrize("rows", [[("c", 1, 9, "x")], [("c", 0, 1, "x")], [("d", 1, 1, "x")], [("c", 1, 1, None)]])
def test_bigbed_refuses(spark, tmp_path, rows):
    with pytest.raises(Exception):
        bigbed.write(spark.createDataFrame(rows, "seqnames string, start int, end int, name string"), str(tmp_path / "r.bb"), {"c": 5})


def test_descriptions():
    text = 'table t "a \\"b\\" c" (\n string chrom; "x"\n uint chromStart primary; ""\n uint chromEnd; "" # no\n enum(a, b) e; "one"\n int[blockCount] sizes index[5]; "two"\n simple p q; "r"\n)'
    d = bigbed.describe(text)
    assert [(f.name, f.kind, f.size, f.indexed, f.values) for f in d.fields[3:]] == [("e", "enum", None, False, ("a", "b")), ("sizes", "int", "blockCount", True, ()), ("q", "simple p", None, False, ())]
    assert d.fields[1].indexed and [f.spark for f in d.fields] == ["string", "long", "long", "string", "string", "string"]
    assert bigbed.describe(bigbed.rendered(d)).fields[4].size == "blockCount"
    for bad in ("tabel t", "table t ( string a; )", 'table t "" ( string a', "table t \x01"):
        with pytest.raises(ValueError):
            bigbed.describe(bad)


def test_zoom_reductions_and_fixed_ones(spark, tmp_path):
    assert cov.zoom_reductions(1, 10**6) == [10 * 4**i for i in range(9)] and cov.zoom_reductions(300, 9) == []
    path = str(tmp_path / "f.bw")
    bigwig.write(spark.createDataFrame([("c", i * 10 + 1, i * 10 + 5, float(i)) for i in range(500)], bigwig.SIGNAL), path, {"c": 5000}, zooms=list(cov.FIXED_ZOOMS[:4]))
    with bigwig.BigWig(path) as w:
        assert [z[0] for z in w.zooms] == [30, 65, 130, 260]
    rows = bigwig.scan_zoom(spark, path, 2).orderBy("start").collect()
    assert (rows[0].start, rows[0].end, rows[0].valid, rows[0].max_value) == (1, 130, 65, 12.0) and sum(r.valid for r in rows) == 2500


def _folded(items, r):
    """Windows that follow the data, one base at a time."""
    out = []
    for s, e, v in items:
        for x in range(s, e + 1):
            if not out or x > out[-1][1]:
                at = x if not out or x >= out[-1][1] + 1 + r else out[-1][1] + 1
                out.append([at, at + r - 1, 0, v, v, 0.0])
            o = out[-1]
            if x > o[1]:
                raise AssertionError
            o[2], o[3], o[4], o[5] = o[2] + 1, min(o[3], v), max(o[4], v), o[5] + v
    return [tuple(o) for o in out]


def test_windows_that_follow_the_data(spark):
    rng = random.Random(5)
    items, at = [], 1
    for _ in range(300):
        at += rng.choice([0, 1, 2, 9, 40, 200])
        items.append((at, at + rng.randrange(12), float(rng.randrange(5))))
        at = items[-1][1] + 1
    df = spark.createDataFrame([("c", *x) for x in items], "seqnames string, start int, end int, value double")
    for r in (7, 25):
        got = sorted((x.start, x.end, x.valid, x.min_value, x.max_value, x.sum_value) for x in cov.accumulated(df, r).collect())
        assert got == _folded(items, r)


def test_bgzf(tmp_path):
    data = random.Random(1).randbytes(200_000)
    path = tmp_path / "x"
    path.write_bytes(b"".join(bgzf.packed(data)) + bgzf.END)
    with open(path, "rb") as f:
        assert len(bgzf.blocks(f)) == 5
        r = bgzf.Reader(f)
        assert r.read(70_000) == data[:70_000]
        at = r.offset
        assert bgzf.Reader(f, at).read(10**6) == data[70_000:]


def test_bam_in_small_parts(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        n = rng.randrange(30, 200)
        seq = "".join(rng.choice("ACGTN") for _ in range(n))
        rows.append((rng.choice(["a", "b"]), rng.randrange(1, 10**6), f"q{i}", f"{n - 10}M2I5D8S", seq, "".join(chr(33 + rng.randrange(40)) for _ in seq), i, "z" * (i % 9), i / 8))
    df = spark.createDataFrame(rows, "seqnames string, start int, qname string, cigar string, seq string, qual string, NM int, XZ string, XF double").withColumn("strand", F.lit("-"))
    path = str(tmp_path / "x.bam")
    bam.write(L.sam_lines(df), path, [("a", 2 * 10**6), ("b", 2 * 10**6), ("c", 5)])
    for parts in (1, 3, 1000):
        got = {r.qname: r for r in bam.scan(spark, path, parts).collect()}
        assert len(got) == 3000
        for name, start, q, cigar, seq, qual, nm, z, x in rows:
            r = got[q]
            assert (r.seqnames, r.start, r.cigar, r.seq, r.qual, r.strand, r.tags["NM"], r.tags["XZ"], float(r.tags["XF"])) == (name, start, cigar, seq, qual, "-", str(nm), z, x)
            assert r.end == start + len(seq) - 10 + 5 - 1
    assert [r.seqnames for r in bam.seqinfo(spark, path).orderBy("seq_rank").collect()] == ["a", "b", "c"]


def test_tabix_ranges_against_all_lines(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b"]), s, s + rng.choice([0, 10, 40_000]), f"r{i}") for i in range(4000) for s in [rng.randrange(1, 3_000_000)]]
    path = str(tmp_path / "x.tab.gz")
    text = spark.createDataFrame([("\t".join(map(str, r)),) for r in rows], "value string")
    tabix.write(text, path, header=["#s\tb\te\tn"])
    for which in ([("a", 1, 5)], [("a", 1_000_000, 1_020_000), ("b", 2_900_000, 3_000_000)], [("c", 1, 9)], [("a", 500_000, 500_000), ("a", 499_000, 500_100)]):
        got = sorted(r.value for r in tabix.lines(spark, path, which).collect())
        assert got == sorted("\t".join(map(str, r)) for r in rows if any(r[0] == n and r[1] <= b and r[2] >= a for n, a, b in which))
    assert tabix.lines(spark, path).count() == 4000 and tabix.lines(spark, path, [("a", 1, 2)], header=True).where("value like '#%'").count() == 1
    with pytest.raises(ValueError):
        tabix.index_track(spark, "http://x/y.bed")


def test_magic_numbers(spark, tmp_path):
    path = str(tmp_path / "b.bb")
    bigbed.write(spark.createDataFrame([("c", 1, 2)], "seqnames string, start int, end int"), path, {"c": 5})
    head = open(path, "rb").read(64)
    assert struct.unpack("<IHH", head[:8])[:2] == (0x8789F2EB, 4)
    with pytest.raises(ValueError):
        bigwig.BigWig(path)
