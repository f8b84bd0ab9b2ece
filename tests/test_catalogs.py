"""Track lines, collections, web tables, sessions, catalogs and sequence operators."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from trackforge.operators import genome, lift
from trackforge.sources import hubs, tracks, web
from trackforge.sources import lines as L

from .test_formats import table

CORE = "seqnames string, start int, end int, strand string"


def test_track_lines_there_and_back():
    text = 'track type=wiggle_0 name="a b" color=1,2,3 viewLimits=0:10 autoScale=on maxHeightPixels=10:20:30 yLineMark=2.5 other=5'
    line = tracks.parse(text)
    assert isinstance(line, tracks.GraphTrackLine) and (line.name, line.color, line.viewLimits, line.autoScale, line.maxHeightPixels, line.yLineMark, line.more, line.format) == ("a b", (1, 2, 3), (0.0, 10.0), True, (10, 20, 30), 2.5, {"other": "5"}, "wig")
    assert tracks.parse(tracks.render(line)) == line
    basic = tracks.BasicTrackLine(name="n", offset=-3, itemRgb=True, useScore=False, colorByStrand=((1, 0, 0), (0, 1, 0)), db="g", url="http://x?a=1")
    assert tracks.parse(tracks.render(basic)) == basic
    array = tracks.parse('track type="array" expNames="a,b," expScale=3.0')
    assert array.expNames == ("a", "b") and array.format == "bed15" and tracks.parse(tracks.render(array)) == array
    assert tracks.format_of("track name=x", "y.bedGraph.gz") == "bedgraph" and tracks.format_of("track name=x") == "bed"


def test_collection_of_several_formats(spark):
    x = table(spark, "browser position c", 'track name="one" offset=10', "c\t0\t5\tn", 'track type=wiggle_0 name="two"', "fixedStep chrom=c start=3 step=2", "1", "2", 'track type=bedGraph name="three"', "c 7 9 1.5", 'track type="array" name="four" expNames="p,q"', "c\t1\t2\tn\t0\t+\t1\t2\t0\t1\t1\t0\t2\t0,1\t3,-10000")
    got = [(r.track, r.start, r.end, r.score, r.p, r.q) for r in tracks.as_features(x).orderBy("track", "start").collect()]
    assert got == [("four", 2, 2, None, 3.0, None), ("one", 11, 15, None, None, None), ("three", 8, 9, 1.5, None, None), ("two", 3, 3, 1.0, None, None), ("two", 5, 5, 2.0, None, None)]


def test_graphs_are_split_by_strand_or_become_bed(spark):
    df = spark.createDataFrame([("c", 1, 5, "+", 1.0), ("c", 1, 5, "-", 2.0)], CORE + ", score double")
    lines = [r.value for r in tracks.track_document(df, tracks.GraphTrackLine(name="t"), "bedGraph").orderBy("track", "k1", "k2").collect()]
    assert lines == ['track type=bedGraph name="t p"', "c\t0\t5\t1.0", 'track type=bedGraph name="t m"', "c\t0\t5\t2.0"]
    clash = df.withColumn("strand", F.lit("+"))
    with pytest.raises(ValueError):
        tracks.track_document(clash, None, "wig")
    assert tracks.track_document(clash).orderBy("track", "k1", "k2").first().value == 'track name="Track 1"'


def test_bed_columns_and_experiments(spark):
    x = table(spark, "# c", "a 0 5 n 1.5", "a 4 9 m .")
    assert [tuple(r) for r in L.read_bed(x).orderBy("start").collect()] == [("a", 1, 5, "n", 1.5, "*"), ("a", 5, 9, "m", None, "*")]
    with pytest.raises(ValueError):
        L.read_bed(x, names=["thick"])
    with pytest.raises(Exception, match="integer"):
        L.read_bed(table(spark, "a\tx\t5")).collect()
    with pytest.raises(ValueError):
        L.bed15_names(table(spark, *["\t".join(["c", "0", "1"] + ["."] * 9 + ["2", ids, "1,2"]) for ids in ("0,1", "1,0")]))
    assert [tuple(r) for r in L.wig(table(spark, "track type=wiggle_0", "c 7 9 1.5")).collect()] == [("c", 8, 9, 1.5)]


class Service:
    """Answers by the end of the address; keeps what was asked."""

    def __init__(self, **answers):
        self.answers, self.asked = answers, []

    def __call__(self, url, query):
        self.asked.append((url, query))
        a = self.answers[url.rpartition("/")[2]]
        a = a(query) if callable(a) else a
        return a if isinstance(a, str) else json.dumps(a)


def test_tables(spark):
    rows = [{"bin": 1, "chrom": "c", "chromStart": 0, "chromEnd": 9, "frag": "f1", "strand": "-"}, {"bin": 2, "chrom": "c", "chromStart": 5, "chromEnd": 7, "frag": "f2", "strand": "+"}]
    get = Service(track={"gold": {"c": rows}}, tracks={"g": {"gold": {}, "x": {"table": "y"}, "z": {"protectedData": 1}}}, schema={"itemCount": 2, "columnTypes": [{"name": "bin", "sqlType": "int", "jsonType": "number", "description": "d"}]})
    q = web.table_query(get, "g", "gold", range=("c", 1, 9), names=("f2",))
    assert web.table_names(get, q) == ["gold", "y"]
    with pytest.raises(ValueError):
        web.table_query(get, "g", "none")
    assert [tuple(r) for r in web.track(spark, get, q).collect()] == [("c", 6, 7, "+", 2, "f2")]
    assert get.asked[-1][1] == {"genome": "g", "track": "gold", "chrom": "c", "start": 1, "end": 9}
    with pytest.raises(ValueError):
        web.track(spark, get, q.with_(names=None), limit=2)
    table_, n = web.schema(spark, get, q)
    assert n == 2 and table_.first().sql_type == "int"
    assert web.flat_rows({"c": rows}, "gold", "c") == rows and web.flat_rows({"gold": rows}, "gold") == rows and web.flat_rows({}, "gold") == []


def test_listings_and_registries(spark):
    form = '<select name="db"><option value="g">G</option></select><select name="hgta_track"><option value="t1">Label\n</option></select><select name="hgta_table"><option value="a">a</option><option value="b">b</option></select>'
    get = Service(hgTables=form, ucscGenomes={"ucscGenomes": {"g": {"genome": "Human", "description": "Jan. 2020 (x/g)", "sourceName": "S", "scientificName": "H. s."}}}, reg="http://h/one", one='<Global name="G"><Resource name="r" path="p"/><Category name="C"><Resource name="s" path="q"/></Category></Global>', tax='<title>Taxonomy browser (Homo sapiens)</title><input name="old_id" value="9606">')
    assert web.tables_of(get, "g", "Label") == ["a", "b"]
    for bad in (("h", "Label"), ("g", "no")):
        with pytest.raises(ValueError):
            web.tables_of(get, *bad)
    assert [tuple(r) for r in web.genomes(spark, get, True).collect()] == [("g", "Human", "Jan. 2020", "S", "H. s.")]
    assert sorted(tuple(r) for r in web.igv_registry(spark, get, "http://h/reg").collect()) == [("C", "G", "s", "q"), ("G", None, "r", "p")]
    assert web.species_metadata(get, "http://n/tax") == {"Taxonomy ID": "9606", "Organism": "Homo sapiens"}


def test_session_and_views(spark):
    page = '<select name="t1"><option>hide<option selected>dense</select><select name="t2"><option selected>hide</select>'
    get = Service(hgTracks=page, hgGateway='<a href="x?hgsid=77_a">', cartDump="<pre>db Human_g9\nposition c:1,001-2,000\nodd line here\n</pre>")
    s = web.Session("g")
    s.refresh(get)
    assert (s.genome, s.range) == ("g9", ("c", 1001, 2000))
    v = s.view(get, ("c", 5, 9), ["t2"], 900)
    assert v.form == {"db": "g9", "position": "c:5-9", "t1": "hide", "t2": "full", "pix": 900} and v.hgsid == "77_a"
    assert v.url.startswith("https://genome.ucsc.edu/cgi-bin/hgTracks?db=g9&position=c%3A5-9&t1=hide") and v.visible(get) == ["t1"] and s.views == [v]
    m = web.TrackModes.of({"a": "hide"}, {"a": "Alpha"}, full=["b"])
    m["Alpha"] = "pack"
    assert m[["Alpha"]].modes == {"a": "pack"} and m.shown == ["a", "b"]
    with pytest.raises(KeyError):
        m.id_of("zz")
    sent = []
    df = spark.createDataFrame([("c", 1, 5, "+")], CORE)
    web.browse(get, [("g", tracks.BasicTrackLine(name="u"), df)], {"g": {"c"}}, lambda *x: sent.append(x))
    assert b'filename="track.txt"' in sent[0][2] and b'track name="u"\nc\t0\t5\t.\t0\t+\n' in sent[0][2]
    with pytest.raises(ValueError):
        web.uploads([("g", None, df)], {"g": {"d"}})
    assert web.cookie({"a": "1", "b": "2"}) == "a=1; b=2" and web.query_string({"a": "x y"}) == "a=x+y"


def test_hub_fields_sequences_and_writing(spark, tmp_path):
    hub = hubs.TrackHub.create(str(tmp_path), {"hub": "h"}, [{"genome": "g1", "trackDb": "g1/trackDb.txt"}, {"genome": "g2", "trackDb": "g2/trackDb.txt"}])
    assert hubs.read_stanzas("genome a\ntrackDb x\ngenome b\ntrackDb\ty") == [{"genome": "a", "trackDb": "x"}, {"genome": "b", "trackDb": "y"}]
    hub.set("email", "a@b.c")
    assert hubs.TrackHub(str(tmp_path)).get("email") == "a@b.c" and len(hub) == 2 and hub.genome_names() == ["g1", "g2"]
    with pytest.raises(KeyError):
        hub.get("nothing")
    hub.set_reference_sequence(spark.createDataFrame([("c", "ACGTN")], "name string, seq string"), "g1")
    asked = spark.createDataFrame([("c", 2, 4)], "seqnames string, start int, end int")
    assert hubs.TrackHub(str(tmp_path)).reference_sequence(asked, "g1").first().seq == "CGT"
    hub.write_track(spark.createDataFrame([("c", 1, 5, "+", 2.0)], CORE + ", score double"), "g1", "t", lengths={"c": 9}, autoScale="on", maxItems="x", odd="1", priority="2.5")
    assert [tuple(r) for r in hub.track(spark, "g1", "t").collect()] == [("c", 1, 5, 2.0)]
    assert hub.track_field("g1", "t", "type") == "bigWig" and hub.records("g1")[0] == {"track": "t", "type": "bigWig", "bigDataUrl": "t.bw", "autoScale": "on", "maxItems": None, "priority": 2.5}
    hub.set_track_field("g1", "t", "html", "x")
    assert hub.track_field("g1", "t", "html") == "x"
    assert hubs.typed_settings({"itemRgb": "On", "spectrum": "off"}) == {"itemRgb": True, "spectrum": False} and len(hubs.SETTINGS) > 150


def test_repository_fields_and_names(spark, tmp_path):
    r = hubs.Repository(str(tmp_path))
    r.create("H_sapiens_Mar_2006", "x", {"c": 9})
    r.set_reference_sequence(spark.createDataFrame([("c", "ACGT")], "name string, seq string"), "H_sapiens_Mar_2006")
    asked = spark.createDataFrame([("c", 1, 2)], "seqnames string, start int, end int")
    assert r.reference_sequence(asked, "H_sapiens_Mar_2006").first().seq == "AC"
    r.write_track(spark.createDataFrame([("c", 1, 5, "+")], CORE), "H_sapiens_Mar_2006", "one", note="n")
    r.write_track(spark.createDataFrame([("c", 1, 5, 1.0)], "seqnames string, start int, end int, score double"), "H_sapiens_Mar_2006", "two")
    assert sorted((x.title, x.name, x.note) for x in r.fields(spark, "H_sapiens_Mar_2006").collect()) == [("one", "one.bed", "n"), ("two", "two.bw", None)]
    assert (r.organism("H_sapiens_Mar_2006"), r.release_date("H_sapiens_Mar_2006"), r.release_date("hg18")) == ("H. sapiens", "Mar 2006", None)
    (tmp_path / "synonyms.txt").write_text("a\tb\tc\n")
    assert r.synonyms() == {"a": ["b", "c"]} and hubs.genome_id("Homo sapiens", "March 2006") == "H_sapiens_Mar_2006"
    assert hubs.joined("a/", "/b") == "/b" and hubs.joined("a/", "b/", "c") == "a/b/c" and hubs.joined("a", "http://x/") == "http://x"
    assert hubs.is_local("file:///x") and not hubs.is_local("s3://x") and hubs.exists("http://x", lambda u: True) and hubs.is_writable(str(tmp_path / "new" / "x")) and not hubs.is_writable("http://x")
    hubs.register(".mine", lambda s, p: 5)
    assert hubs.reader_of("a.mine")(None, "") == 5


def test_sequences(spark):
    info = spark.createDataFrame([("b", 10, "g", 0), ("a", 20, "g", 1)], "seqnames string, seqlength long, genome string, seq_rank int")
    df = spark.createDataFrame([("a", 5, 6, "-"), ("b", 9, 9, "+"), ("b", 1, 3, "-"), ("z", 1, 1, "*")], CORE)
    assert [(r.seqnames, r.start) for r in genome.sort_by_level(df, info).collect()] == [("b", 1), ("b", 9), ("a", 5), ("z", 1)]
    assert [(r.seqnames, r.start) for r in genome.sort_by_level(df, info, False).collect()] == [("b", 9), ("b", 1), ("a", 5), ("z", 1)]
    with pytest.warns(UserWarning, match="z"):
        assert genome.known(df, info).count() == 3
    with pytest.raises(ValueError, match="z"):
        genome.known(df, info, "error")
    with pytest.raises(ValueError):
        genome.genome_ranges(info, ["q"])
    assert genome.single_genome(info) == "g"
    with pytest.raises(ValueError):
        genome.single_genome(info.withColumn("genome", F.col("seqnames")))
    with pytest.raises(Exception, match="differ"):
        genome.merge_seqinfo(info, info.withColumn("seqlength", F.col("seqlength") + 1)).collect()
    with pytest.raises(Exception, match="hull"):
        genome.normalise(df, 1).collect()
    with pytest.warns(UserWarning):
        assert genome.normalise(df, 2).count() == 2
    with pytest.warns(UserWarning):
        assert genome.capped(df, 1).count() == 1
    assert {k: v.count() for k, v in genome.split_by(df, "strand").items()} == {("*",): 1, ("+",): 1, ("-",): 2}
    assert genome.union_names(["a", "b"], ["b", "c"]) == ["a", "b", "c"] and genome.common_names(["a", "b"], ["b"]) == ["b"] and genome.other_names(["a", "b"], ["b"]) == ["a"]
    assert genome.merged_fields([{"name": "x", "a": 1}], [{"name": "x", "b": 2}, {"name": "y"}]) == [{"name": "x", "a": 1, "b": 2}, {"name": "y", "a": None, "b": None}]
    scored = df.withColumn("v", F.lit(2.5))
    assert {r.s for r in scored.select(genome.score(scored).alias("s")).collect()} == {2.5}
    with pytest.raises(ValueError):
        genome.score(df)
    assert {r.seqnames for r in genome.with_chrom(df, "q").collect()} == {"q"}


def test_lift_by_path_and_gaps(spark, tmp_path):
    (tmp_path / "c.chain").write_text("chain 1 a 1000 + 100 120 b 500 + 200 220 1\n10 0 0\n10\n\nchain 1 a_x 9 + 0 9 b 9 + 0 9 2\n9\n\n")
    f = spark.createDataFrame([(1, "a", 105, 115, "+"), (2, "z", 1, 2, "-")], "ord long, " + CORE)
    got = lift.lift(f, str(tmp_path / "c.chain"))
    assert sorted((r.ord, r.piece, r.seqnames, r.start, r.end) for r in got.collect()) == [(1, 1, "b", 205, 210), (1, 2, "b", 211, 215)]
    assert [tuple(r) for r in lift.without_gaps(got, 0).collect()] == [(1, "b", 205, 215, "+")]
    assert lift.lift_pieces(f, L.chain(L.read_lines(spark, str(tmp_path / "c.chain")))).where("piece = 0").count() == 1
