"""Steps whose work and files must not gather on the driver, in one task or in pairs of intervals."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackforge.operators import lift, lift_tiles, nest, overlap, summary
from trackforge.plans import catalog, files  # noqa: F401
from trackforge.sources import bam, bigbed, bigwig, gff, parts, tabix
from trackforge.sources import lines as L

SF = "/root/testdata/sf0.001"


def forbidden(*_, **__):
    raise AssertionError("not this way")


def test_summaries_without_pairs(spark, monkeypatch):
    signal = spark.createDataFrame([("c", 1, 40_000, 2.0), ("c", 5, 9, None), ("c", 7, 7, -1.0), ("c", 16_384, 16_385, 5.0), ("d", 1, 2, 1.0)], "seqnames string, start int, end int, value double")
    queries = spark.createDataFrame([(1, "c", 1, 10), (2, "c", 16_380, 16_389), (3, "e", 1, 10)], "query int, seqnames string, start int, end int")
    want = {(r["query"], r["bin"]): tuple(r)[2:] for r in summary.summarise(signal, queries, 2).collect()}
    monkeypatch.setattr(summary, "overlap_join", forbidden)
    got = {(r["query"], r["bin"]): tuple(r)[2:] for r in summary.summarise(signal, queries, 2, small=False).collect()}
    assert got == want and got[3, 0] == (None,) * 5 and got[2, 1][2] == 7 - 2


@pytest.mark.parametrize("kind", summary.TYPES)
def test_summary_queries_make_no_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(summary, "overlap_join", forbidden)
    assert catalog.QUERIES[f"summary_{kind}"](spark, SF).count() == 5 * catalog.ranges(spark, SF).count()


def test_dense_without_pairs(spark, monkeypatch):
    signal = spark.createDataFrame([("c", 16_383, 16_386, 3), ("c", 16_384, 16_384, 4)], "seqnames string, start int, end int, value int")
    queries = spark.createDataFrame([("q", "c", 16_382, 16_387), ("r", "d", 1, 1)], "query string, seqnames string, start int, end int")
    want = sorted(map(tuple, nest.dense(signal, queries).collect()))
    monkeypatch.setattr(nest, "overlap_join", forbidden)
    assert sorted(map(tuple, nest.dense(signal, queries, small=False).collect())) == want == sorted([("q", 16_382 + i, v) for i, v in enumerate((0, 3, 7, 3, 3, 0))] + [("r", 1, 0)])


def test_counts_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(catalog, "overlap_join", forbidden)
    assert catalog.QUERIES["overlap_count"](spark, SF).count() > 0
    a = spark.createDataFrame([("c", 1, 5), ("c", 65_530, 65_540), ("c", 6, 6), ("c", 6, 6)], "seqnames string, start int, end int")
    b = spark.createDataFrame([(1, "c", 5, 6), (2, "c", 65_541, 65_542), (3, "c", 65_536, 70_000), (3, "c", 1, 1)], "k int, seqnames string, start int, end int")
    assert sorted(map(tuple, overlap.count_overlaps(a, b, "k").collect())) == [(1, 3), (3, 2)]


def test_buckets_fit(spark):
    f, r = catalog.features(spark, SF), catalog.ranges(spark, SF)
    assert overlap.fitted_width(f, r) == 128


def test_lifted_rows_come_by_target(spark, tmp_path):
    features = spark.range(20_000).select(F.lit("c").alias("seqnames"), (F.col("id") * 7919 % 5000).cast("int").alias("start"), (F.col("id") * 7919 % 5000 + F.col("id") % 4).cast("int").alias("end"), F.lit("+").alias("strand"))
    chain = spark.range(60).select(F.lit("c").alias("from_name"), F.lit(0).alias("from_start"), F.lit(6000).alias("width"), (F.col("id") % 6).cast("int").alias("offset"), F.lit("t").alias("to_name"), F.lit(False).alias("reversed"))
    lift._by_pairs(features, chain, small=True).write.parquet(f"{tmp_path}/pairs")
    lift.lift_over(features, chain, small=False, by_target=True).write.parquet(f"{tmp_path}/sorted")
    a, b = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("pairs", "sorted"))
    assert b.count() == 20_000 * 60 and not a.exceptAll(b).head(1)
    size = lambda x: sum(f.stat().st_size for f in (tmp_path / x).glob("*.parquet"))
    assert size("sorted") * 3 < size("pairs")


@pytest.mark.parametrize("tile, most, rows", [(4096, lift_tiles.MOST, lift_tiles.ROWS), (256, 7, 5), (64, 1, 1)])
def test_lifted_rows_of_odd_tables(spark, tile, most, rows):
    import random

    r = random.Random(tile)
    features, blocks = [], []
    for _ in range(200):
        a, w = r.randint(-200, 3000), r.choice((0, 1, 5, 50, 400, -3, -1))
        features.append((r.choice(("a", "b", "c", None)), a, r.choice((a + w, a + w, None)), r.choice(("+", "-", "*", None, "+-"))))
    for _ in range(60):
        blocks.append((r.choice(("a", "b", None)), r.randint(-200, 3000), r.choice((0, -1, -4, 1, 30, 300, 2000, None)), r.choice((-50, 3, 7, None)), r.choice(("t", "u", None)), r.choice((True, False, None))))
    f = spark.createDataFrame(features + features[:30], "seqnames string, start int, end int, strand string")
    c = spark.createDataFrame(blocks + blocks[:9], "from_name string, from_start int, width int, offset int, to_name string, reversed boolean")
    want = lift._by_pairs(f, c, small=True)
    got = lift_tiles.lift_sorted(f, c, want.schema, tile, most, rows)
    assert got.dtypes == want.dtypes and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) != []


@pytest.fixture
def few(spark):
    return spark.createDataFrame([("c", i % 900 + 1, i % 900 + 3, "+", f"n{i % 700}", i) for i in range(1500)], "seqnames string, start int, end int, strand string, name string, score int")


def test_indexed_files_without_the_driver(spark, monkeypatch, tmp_path, few):
    monkeypatch.setattr(type(few), "toLocalIterator", forbidden)
    path = str(tmp_path / "x.bb")
    bigbed.write(few, path, {"c": 1000}, slot=16, indexes=("name",), zooms=[10])
    assert sorted(r["score"] for r in bigbed.by_name(spark, path, "n5").collect()) == [5, 705, 1405] and bigbed.scan(spark, path).count() == 1500
    with bigbed.BigBed(path) as b:
        assert all(b.places_of(f"n{i}", b.indexes()[0][1]) for i in range(700)) and not b.places_of("n700", b.indexes()[0][1])
    path = str(tmp_path / "x.bed.gz")
    tabix.write(L.bed_lines(few), path, kind=0x10000)
    assert tabix.scan(spark, path, [("c", 1, 3)]).count() == 2 * 3 and len(os.listdir(tmp_path)) == 3


def test_alignments_without_the_driver(spark, monkeypatch, tmp_path, few):
    monkeypatch.setattr(type(few), "toLocalIterator", forbidden)
    path = str(tmp_path / "x.bam")
    bam.write(L.sam_lines(few.select("seqnames", "start", "end", "strand", F.col("name").alias("qname"), F.lit("3M").alias("cigar"))), path, [("c", 1000)])
    monkeypatch.setattr(bam, "MOST_TASKS", 1)
    assert bam.scan(spark, path, 1).rdd.getNumPartitions() <= 2 and bam.scan(spark, path, 1).count() == 1500


def test_signal_is_computed_once(spark, monkeypatch, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kind = "seqnames string, start int, end int, score double"
    signal = spark.createDataFrame([("c", 2 * i + 1, 2 * i + 1, 1.0) for i in range(100)], kind).mapInArrow(noted, kind)
    monkeypatch.setattr(type(signal), "toLocalIterator", forbidden)
    bigwig.write(signal, str(tmp_path / "x.bw"), {"c": 1000}, zooms=[10, 20])
    assert seen.value == 100 and bigwig.scan(spark, str(tmp_path / "x.bw")).count() == 100


def test_pairs_of_one_name(spark):
    kind = "qname string, flag int, seqnames string, start int, end int, strand string, cigar string, mapq int, mrnm string, mpos int"
    row = lambda name, flag, at, to: (name, flag, "c", at, at + 4, "+", "5M", 9, "c", to)
    x = spark.createDataFrame([row("a", 65, 10, 90), row("a", 129, 90, 10), row("a", 65, 20, 70), row("a", 129, 70, 20), row("a", 65, 20, 70), row("a", 129, 70, 20), row("b", 65, 1, 2), row("b", 129, 7, 8), row("d", 65, 1, 2)], kind)
    got = sorted((r["name"], r["first"]["start"], r["second"]["start"]) for r in bam.pairs(x).collect())
    assert got == [("a", 10, 90), ("a", 20, 70), ("a", 20, 70), ("b", 1, 7)]


def test_documents_in_many_tasks(spark, tmp_path, few):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        gff.write(spark, gff.document(few, 3), str(tmp_path / "many"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = sorted(f for f in os.listdir(tmp_path / "many") if f.startswith("part-"))
    assert len(names) > 3 and (tmp_path / "many" / names[0]).read_text().startswith("##gff-version 3\n")
    rows = spark.createDataFrame([(2, "y"), (0, "b"), (0, "a"), *((1, f"{i}") for i in range(500)), (2, "x")], "part int, value string")
    parts.write_text(rows, str(tmp_path / "one"), "part")
    assert (tmp_path / "one").read_text().splitlines() == ["b", "a", *map(str, range(500)), "y", "x"]


def test_tags_with_commas(spark):
    x = spark.createDataFrame([(f"c\t.\tx\t1\t2\t.\t.\t.\t{a}", "f", i) for i, a in enumerate(("A=1,2; B=x;A=3", "B=y;AB=1,2"))], "value string, file string, ord int")
    assert gff._with_commas(x, ["A", "B", "C"]) == [("A", True), ("B", False), ("C", False)]


def clashing(spark, folder: str) -> str:
    """sf0.001 with further lines whose numbers of order and part give keys that are there."""
    x = spark.read.parquet(f"{SF}/lineitem.parquet")
    more = x.where("l_orderkey % 7 = 0").withColumns({"l_orderkey": F.col("l_orderkey") - 1, "l_partkey": F.col("l_partkey") + 100_000, "l_suppkey": F.col("l_suppkey") + 1})
    x.unionByName(more).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    for t in ("supplier", "part"):
        spark.read.parquet(f"{SF}/{t}.parquet").coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return folder


@pytest.mark.parametrize("name", ["bam_pairs", "liftover_empty_groups", "liftover_order", "liftover_pairs", "liftover_unmapped"])
def test_shared_keys(spark, tmp_path, name):
    import duckdb

    d = clashing(spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "part"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, d)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = con.sql(f"select {columns} from ({catalog.SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
