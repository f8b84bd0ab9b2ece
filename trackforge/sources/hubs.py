"""Catalogs of tracks kept in files: track hubs (stanzas of keys and values) and directories with an XML list of files.

Stanza files of any number are read as tables. The catalogs themselves are small and live on the driver: what they
name is read by `reader`, a function of (spark, location) that callers choose by the location's ending.
Lookups of a name that is missing or there twice are errors.
"""

from __future__ import annotations

import os
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lines as L

Reader = Callable[[SparkSession, str], DataFrame]
READERS: dict[str, Reader] = {
    "bed": lambda s, p: L.bed(L.read_lines(s, p), 6),
    "bedgraph": lambda s, p: L.bedgraph(L.read_lines(s, p)),
    "narrowpeak": lambda s, p: L.narrow_peak(L.read_lines(s, p)),
    "broadpeak": lambda s, p: L.broad_peak(L.read_lines(s, p)),
    "wig": lambda s, p: L.wig(L.read_lines(s, p)),
    "gtf": lambda s, p: L.gff(L.read_lines(s, p), 2),
    "gff3": lambda s, p: L.gff(L.read_lines(s, p), 3),
    "gff": lambda s, p: _gff(s, p),
    "bw": lambda s, p: _binary("bigwig", s, p),
    "bigwig": lambda s, p: _binary("bigwig", s, p),
    "bb": lambda s, p: _binary("bigbed", s, p),
    "bigbed": lambda s, p: _binary("bigbed", s, p),
}


def _gff(spark: SparkSession, path: str) -> DataFrame:
    from .gff import read

    return read(L.read_lines(spark, path))


def _binary(module: str, spark: SparkSession, path: str) -> DataFrame:
    import importlib

    return importlib.import_module(f".{module}", __package__).scan(spark, path)


def register(ending: str, reader: Reader) -> None:
    """A reader for locations with another ending."""
    READERS[ending.lower().lstrip(".")] = reader


def reader_of(location: str) -> Reader:
    """By the ending of the location, that of a compressed file left out."""
    name = location.lower().removesuffix(".gz").removesuffix(".bz2")
    if (end := name.rpartition(".")[2]) not in READERS:
        raise ValueError(f"no reader for {location}")
    return READERS[end]


def best_format(df: DataFrame, grouped: bool = False, runs: bool = False) -> str:
    """bw for run lists and for numeric scores that lie on a single strand, else bed."""
    if runs:
        return "bw"
    numeric = "score" in df.columns and df.schema["score"].dataType.typeName() in ("integer", "long", "double", "float", "short")
    if grouped or not numeric:
        return "bed"
    one = "strand" not in df.columns or len(df.select("strand").distinct().limit(2).collect()) <= 1
    return "bw" if one else "bed"


def _write_track(df: DataFrame, path: str, form: str, lengths: dict[str, int] | None) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    if form == "bw":
        from .bigwig import write

        return write(df, path, lengths or {})
    if form == "bb":
        from .bigbed import write as write_bb

        return write_bb(df, path, lengths or {})
    writers = {"bed": L.bed_lines, "bedgraph": L.bedgraph_lines, "bedGraph": L.bedgraph_lines}
    if form not in writers:
        raise ValueError(f"no writer for {form}")
    L.write_lines(writers[form](df), path)


# --- names of genomes --------------------------------------------------------------------------


def genome_parts(genome: str) -> tuple[str | None, str | None]:
    """Organism and release of G_species_Mon_Year: "G. species" and "Mon Year"; None where the name is of another form."""
    parts = genome.split("_")
    if len(parts) != 4 or not parts[3].isdigit():
        return None, None
    return f"{parts[0]}. {parts[1]}", f"{parts[2]} {parts[3]}"


def genome_id(species: str, date: str) -> str:
    """G_species_Mon_Year of "Genus species" and a date whose last words are month and year."""
    genus, _, rest = species.strip().partition(" ")
    month, year = date.replace(",", " ").split()[-2:]
    return f"{genus[0]}_{rest.split()[0]}_{month.rstrip('.')[:3]}_{year}"


def is_local(location: str) -> bool:
    return "://" not in location or location.startswith("file://")


def exists(location: str, head: Callable[[str], bool] | None = None) -> bool:
    """Whether a local path is there; of others `head` tells."""
    if is_local(location):
        return os.path.exists(location.removeprefix("file://"))
    return head is not None and head(location)


def is_writable(location: str) -> bool:
    """Whether a local path, or the nearest folder of it that is there, can be written to."""
    if not is_local(location):
        return False
    path = os.path.abspath(location.removeprefix("file://"))
    while not os.path.exists(path):
        path = os.path.dirname(path)
    return os.access(path, os.W_OK)


def joined(base: str, *parts: str) -> str:
    """Parts of a location with one slash between them; an absolute part starts over."""
    out = base.rstrip("/")
    for p in parts:
        out = p.rstrip("/") if "://" in p or p.startswith("/") else f"{out}/{p.strip('/')}"
    return out


# --- settings of tracks ------------------------------------------------------------------------

# Fixed values of the format: settings that are flags, whole numbers and numbers; then those that are text.
FLAGS = "boxedCfg skipEmptyFields indelDoubleInsert indelQueryInsert indelPolyA showNames doWiggle itemRgb labelOnFeature exonArrows exonNumbers noScoreFilter spectrum thickDrawItem exonArrowsDense mergeSpannedItems linkIdInName showDiffBasesAllScales alwaysZero negateValues yLineOnOff gridDefault compositeTrack allButtonPair centerLabelsDense hideEmptySubtracks viewUi configurable showSubtrackColorOnUi noInherit".split()
WHOLE = "maxWindowToDraw denseCoverage maxItems scoreMax scoreMin maxWindowToQuery showSnpWidth useScore".split()
NUMBERS = ["priority"]
TEXT = "track type shortLabel longLabel bigDataUrl html visibility meta color altColor chromosomes darkerLabels dataVersion directUrl iframeUrl iframeOptions mouseOverField otherDb pennantIcon tableBrowser url urlLabel urls skipFields sepFields refUrl bigDataIndex bamColorMode bamGrayMode aliQualRange baseQualRange bamColorTag noColorTag bamSkipPrintQualScore minAliQual pairEndsByName pairSearchRange barChartBars barChartColor barChartLabel barChartMaxSize barChartSizeWindows barChartMetric barChartUnit barChartMatrixUrl barChartSampleUrl maxLimit labelFields defaultLabelFields colorByStrand scoreFilter scoreFilterLimits minGrayLevel searchIndex searchTrix labelSeparator bedNameLabel itemImagePath itemBigImagePath nextExonText prevExonText scoreLabel showTopScorers linkDataUrl interactDirectional interactUp interactMultiRegion maxHeightPixels speciesOrder frames summary baseColorUseCds baseColorUseSequence baseColorDefault autoscale autoScale viewLimits viewLimitsMax graphTypeDefault smoothingWindow transformFunc windowingFunction yLineMark otherSpecies minQual minFreq hapClusterEnabled hapClusterColorBy hapClusterTreeAngle hapClusterHeight applyMinQual superTrack parent dragAndDrop hideEmptySubtracksMultiBedUrl hideEmptySubtracksSourcesUrl hideEmptySubtracksLabel subGroups dimensions filterComposite dimensionAchecked dimensionBchecked sortOrder view container aggregate metadata".split()
SETTINGS = dict.fromkeys(TEXT + [f"subGroup{i}" for i in range(1, 10)], str) | dict.fromkeys(FLAGS, bool) | dict.fromkeys(WHOLE, int) | dict.fromkeys(NUMBERS, float)


def typed_settings(fields: dict[str, str]) -> dict:
    """A track's settings by their types: on and off are flags, numbers numbers; unknown settings are left out, bad numbers None."""
    out = {}
    for k, v in fields.items():
        kind = SETTINGS.get(k)
        if kind is bool:
            out[k] = {"on": True, "true": True, "off": False, "false": False, "1": True, "0": False}.get(v.lower())
        elif kind in (int, float):
            try:
                out[k] = kind(v)
            except ValueError:
                out[k] = None
        elif kind is str:
            out[k] = v
    return out


# --- stanzas -----------------------------------------------------------------------------------


def stanzas(lines: DataFrame, first: str = "track") -> DataFrame:
    """file, stanza (from 1), indent, fields of lines(file, ord, value): a stanza starts at the key `first`.

    indent is the number of tabs before that key: how deep the track is nested. Of a key that comes twice the later
    value counts. Lines before the first stanza, blank ones and those that start with # are left out.
    """
    body = lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    flat = F.regexp_replace("value", r"^\s+|\s+$", "")
    body = body.select("file", "ord", F.regexp_extract(flat, r"^\S+", 0).alias("key"), F.regexp_extract(flat, r"^\S+\s+(.*)$", 1).alias("v"), F.length(F.regexp_extract("value", r"^\t*", 0)).alias("tabs"))
    w = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    body = body.withColumn("stanza", F.sum((F.col("key") == first).cast("long")).over(w)).where("stanza > 0")
    last = body.groupBy("file", "stanza", "key").agg(F.max_by("v", "ord").alias("v"), F.min_by("tabs", "ord").alias("tabs"))
    return last.groupBy("file", "stanza").agg(F.max(F.when(F.col("key") == first, F.col("tabs"))).alias("indent"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "v")))).alias("fields"))


def read_stanzas(text: str, first: str | None = None) -> list[dict[str, str]]:
    """The stanzas of a small file: each begins at the key `first`, or, without one, at the key that the file begins with."""
    out: list[dict[str, str]] = []
    for line in text.splitlines():
        key, *value = line.strip().split(None, 1)[:2] if line.strip() else ("",)
        if not key or key.startswith("#"):
            continue
        first = first or key
        if key == first or not out:
            out.append({})
        out[-1][key] = value[0].strip() if value else ""
    return out


def write_stanzas(rows: Iterable[dict], indent: Iterable[int] = ()) -> str:
    """Stanzas as text; True and False are on and off, None is left out."""
    depth = iter(indent)
    word = lambda v: {True: "on", False: "off"}[v] if isinstance(v, bool) else str(v)
    return "\n".join("".join(f"{tab}{k} {word(v)}\n" for k, v in row.items() if v is not None) for row in rows for tab in ["\t" * next(depth, 0)])


def _load(path: str) -> str:
    with open(path) as f:
        return f.read()


def _store(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def _one(rows: list[dict], key: str, name: str) -> dict:
    found = [r for r in rows if r.get(key) == name]
    if len(found) != 1:
        raise KeyError(f"{len(found)} of {key} {name}")
    return found[0]


class TrackHub:
    """hub.txt, its genomes and their tracks, in a folder."""

    def __init__(self, folder: str):
        self.folder = folder
        self.hub = {k: v for x in read_stanzas(_load(f"{folder}/hub.txt")) for k, v in x.items()}
        self.genomes = read_stanzas(_load(f"{folder}/{self.hub['genomesFile']}"), "genome")

    @classmethod
    def create(cls, folder: str, hub: dict[str, str], genomes: list[dict[str, str]]) -> TrackHub:
        hub = hub | {"genomesFile": hub.get("genomesFile", "genomes.txt")}
        _store(f"{folder}/hub.txt", write_stanzas([hub]))
        _store(f"{folder}/{hub['genomesFile']}", write_stanzas(genomes))
        return cls(folder)

    def tracks(self, genome: str) -> list[dict[str, str]]:
        path = f"{self.folder}/{_one(self.genomes, 'genome', genome)['trackDb']}"
        return read_stanzas(_load(path), "track") if os.path.exists(path) else []

    # The fields of a hub that may be asked for and set.
    FIELDS = ("hub", "shortLabel", "longLabel", "genomesFile", "email", "descriptionUrl")

    def get(self, field: str) -> str | None:
        if field not in self.FIELDS:
            raise KeyError(field)
        return self.hub.get(field)

    def set(self, field: str, value: str) -> None:
        if field not in self.FIELDS:
            raise KeyError(field)
        self.hub[field] = value
        _store(f"{self.folder}/hub.txt", write_stanzas([self.hub]))

    def __len__(self) -> int:
        return len(self.genomes)

    def genome_names(self) -> list[str]:
        return [g["genome"] for g in self.genomes]

    def genome_field(self, genome: str, field: str) -> str | None:
        return _one(self.genomes, "genome", genome).get(field)

    def set_genome_field(self, genome: str, field: str, value: str) -> None:
        _one(self.genomes, "genome", genome)[field] = value
        _store(f"{self.folder}/{self.hub['genomesFile']}", write_stanzas(self.genomes))

    def track_field(self, genome: str, name: str, field: str) -> str | None:
        return _one(self.tracks(genome), "track", name).get(field)

    def set_track_field(self, genome: str, name: str, field: str, value: str) -> None:
        self.put(genome, _one(self.tracks(genome), "track", name) | {field: value})

    def records(self, genome: str) -> list[dict]:
        """The tracks with settings of their types; settings that are unknown are left out."""
        return [typed_settings(t) for t in self.tracks(genome)]

    def reference_sequence(self, ranges: DataFrame, genome: str) -> DataFrame:
        """ranges with seq, from the genome's 2bit file."""
        from .twobit import scan

        return scan(ranges, f"{self.folder}/{_one(self.genomes, 'genome', genome)['twoBitPath']}")

    def set_reference_sequence(self, sequences: DataFrame, genome: str) -> None:
        """Writes sequences(name, seq) as the genome's 2bit file and names it in genomes.txt."""
        from .twobit import write

        place = self.genome_field(genome, "twoBitPath") or f"{genome}/{genome}.2bit"
        os.makedirs(os.path.dirname(f"{self.folder}/{place}"), exist_ok=True)
        write(sequences, f"{self.folder}/{place}")
        self.set_genome_field(genome, "twoBitPath", place)

    def write_track(self, df: DataFrame, genome: str, name: str, form: str | None = None, lengths: dict[str, int] | None = None, **fields_: str) -> None:
        """Writes features in a format, the best one for them unless one is named, and registers them."""
        form = form or best_format(df)
        base = os.path.dirname(_one(self.genomes, "genome", genome)["trackDb"])
        place = f"{name}.{form}"
        _write_track(df, f"{self.folder}/{base}/{place}", form, lengths)
        kind = {"bw": "bigWig", "bb": "bigBed"}.get(form, form)
        self.put(genome, {"track": name, "type": kind, "bigDataUrl": place} | fields_)

    def names(self, genome: str) -> list[str]:
        return [t["track"] for t in self.tracks(genome)]

    def put(self, genome: str, fields: dict) -> None:
        """Adds a track, in the place of one of its name if there is one."""
        at = _one(self.genomes, "genome", genome)["trackDb"]
        rest = [t for t in self.tracks(genome) if t["track"] != fields["track"]]
        _store(f"{self.folder}/{at}", write_stanzas([*rest, fields]))

    def track(self, spark: SparkSession, genome: str, name: str, reader: Reader | None = None) -> DataFrame:
        to = _one(self.tracks(genome), "track", name)["bigDataUrl"]
        base = os.path.dirname(f"{self.folder}/{_one(self.genomes, 'genome', genome)['trackDb']}")
        where = to if "://" in to or to.startswith("/") else f"{base}/{to}"
        return (reader or reader_of(where))(spark, where)


class Repository:
    """A folder with contents.txt and, for each genome, annots.xml and mod_chromInfo.txt."""

    def __init__(self, folder: str):
        self.folder = folder

    def genomes(self) -> dict[str, str]:
        """Title by genome."""
        path = f"{self.folder}/contents.txt"
        rows = [x.split("\t") for x in _load(path).splitlines() if x.strip()] if os.path.exists(path) else []
        return {r[0]: r[1] if len(r) > 1 else r[0] for r in rows}

    def create(self, genome: str, title: str, lengths: dict[str, int]) -> None:
        self._files(genome, [])
        _store(f"{self.folder}/{genome}/mod_chromInfo.txt", "".join(f"{k}\t{v}\n" for k, v in lengths.items()))
        _store(f"{self.folder}/contents.txt", "".join(f"{k}\t{v}\n" for k, v in (self.genomes() | {genome: title}).items()))

    def seqinfo(self, spark: SparkSession, genome: str) -> DataFrame:
        rows = [x.split("\t") for x in _load(f"{self.folder}/{genome}/mod_chromInfo.txt").splitlines() if x.strip()]
        return spark.createDataFrame([(r[0], int(r[1]), genome, i) for i, r in enumerate(rows)], "seqnames string, seqlength long, genome string, seq_rank int")

    def files(self, genome: str) -> list[dict[str, str]]:
        return [dict(x.attrib) for x in ET.parse(f"{self.folder}/{genome}/annots.xml").getroot().iter("file")]

    def _files(self, genome: str, rows: list[dict[str, str]]) -> None:
        root = ET.Element("files")
        for r in rows:
            ET.SubElement(root, "file", r)
        _store(f"{self.folder}/{genome}/annots.xml", ET.tostring(root, "unicode"))

    def names(self, genome: str) -> list[str]:
        return [r.get("title", r["name"]) for r in self.files(genome)]

    def put(self, genome: str, title: str, name: str, **fields: str) -> None:
        """Registers a file, in the place of one of its title if there is one."""
        self._files(genome, [*(r for r in self.files(genome) if r.get("title") != title), {"name": name, "title": title} | fields])

    def release_date(self, genome: str) -> str | None:
        return genome_parts(genome)[1]

    def organism(self, genome: str) -> str | None:
        return genome_parts(genome)[0]

    def synonyms(self) -> dict[str, list[str]]:
        """Names that stand for one genome each, by the first of a line of synonyms.txt."""
        path = f"{self.folder}/synonyms.txt"
        rows = [x.split("\t") for x in _load(path).splitlines() if x.strip()] if os.path.exists(path) else []
        return {r[0]: r[1:] for r in rows}

    def __len__(self) -> int:
        return len(self.genomes())

    def fields(self, spark: SparkSession, genome: str) -> DataFrame:
        """What is known of a genome's files, one row each; fields that a file does not have are null."""
        from ..operators.genome import merged_fields, registry

        return registry(spark, merged_fields([], self.files(genome)))

    def reference_sequence(self, ranges: DataFrame, genome: str) -> DataFrame:
        """ranges with seq, from the genome's 2bit file."""
        from .twobit import scan

        return scan(ranges, f"{self.folder}/{genome}/{genome}.2bit")

    def set_reference_sequence(self, sequences: DataFrame, genome: str) -> None:
        from .twobit import write

        write(sequences, f"{self.folder}/{genome}/{genome}.2bit")

    def write_track(self, df: DataFrame, genome: str, title: str, form: str | None = None, lengths: dict[str, int] | None = None, **fields_: str) -> None:
        """Writes features in a format, the best one for them unless one is named, and registers them."""
        form = form or best_format(df)
        lengths = lengths or {r["seqnames"]: r["seqlength"] for r in self.seqinfo(df.sparkSession, genome).collect()}
        _write_track(df, f"{self.folder}/{genome}/{title}.{form}", form, lengths)
        self.put(genome, title, f"{title}.{form}", **fields_)

    def track(self, spark: SparkSession, genome: str, title: str, reader: Reader | None = None) -> DataFrame:
        where = f"{self.folder}/{genome}/{_one(self.files(genome), 'title', title)['name']}"
        return (reader or reader_of(where))(spark, where)
