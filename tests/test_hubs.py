"""Catalogs kept in files."""

from __future__ import annotations

import pytest

from trackforge.sources.hubs import Repository, TrackHub, read_stanzas, stanzas, write_stanzas

from .test_formats import table


def test_stanzas(spark):
    x = table(spark, "ignored 1", "# c", "track a", "type bed", "type  bigBed 3 ", "", "\ttrack b", "\tparent a on", "flag")
    got = [(r.stanza, r.indent, r.fields) for r in stanzas(x).orderBy("stanza").collect()]
    assert got == [(1, 0, {"track": "a", "type": "bigBed 3"}), (2, 1, {"track": "b", "parent": "a on", "flag": ""})]
    text = write_stanzas([{"track": "a", "html": True, "no": None}, {"track": "b", "x": False}], [0, 1])
    assert text == "track a\nhtml on\n\n\ttrack b\n\tx off\n" and read_stanzas(text) == [{"track": "a", "html": "on"}, {"track": "b", "x": "off"}]


def test_track_hub(spark, tmp_path):
    hub = TrackHub.create(str(tmp_path), {"hub": "h", "shortLabel": "two words"}, [{"genome": "g1", "trackDb": "g1/trackDb.txt"}])
    assert hub.hub["shortLabel"] == "two words" and hub.names("g1") == []
    hub.put("g1", {"track": "t", "bigDataUrl": "old.bed"})
    hub.put("g1", {"track": "t", "bigDataUrl": "x.bed", "visibility": "full"})
    (tmp_path / "g1" / "x.bed").write_text("c\t4\t9\tn\t1\t-\n")
    assert [tuple(r) for r in hub.track(spark, "g1", "t").select("seqnames", "start", "end", "strand").collect()] == [("c", 5, 9, "-")]
    for g, t in (("g2", "t"), ("g1", "u")):
        with pytest.raises(KeyError):
            hub.track(spark, g, t)


def test_repository(spark, tmp_path):
    r = Repository(str(tmp_path))
    assert r.genomes() == {}
    r.create("G_1", "Genome one", {"c": 100, "d": 7})
    assert r.genomes() == {"G_1": "Genome one"}
    assert [tuple(x) for x in r.seqinfo(spark, "G_1").orderBy("seq_rank").collect()] == [("c", 100, "G_1", 0), ("d", 7, "G_1", 1)]
    r.put("G_1", "signal", "s.bedGraph", description="a & b")
    (tmp_path / "G_1" / "s.bedGraph").write_text("c\t0\t5\t1.5\n")
    assert r.files("G_1") == [{"name": "s.bedGraph", "title": "signal", "description": "a & b"}]
    assert [tuple(x) for x in r.track(spark, "G_1", "signal").collect()] == [("c", 1, 5, 1.5)]
    r.put("G_1", "odd", "s.xyz")
    with pytest.raises(ValueError):
        r.track(spark, "G_1", "odd")
