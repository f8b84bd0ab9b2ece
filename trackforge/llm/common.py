"""Helpers that the training-data operators share: shared storage, word hashing, token caches, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import struct
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share.

    It lies under spark.checkpoint.dir, read from the session. Only where that is unset (tests on one
    machine) the session gets a folder of its own; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='trackforge-')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended first
            return


#: Shuffle files go as soon as the query that made them ends; what it wrote is read instead.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value):
    """A setting of the session for the plans that run meanwhile."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialise(df: DataFrame, tag: str, compression: str = "zstd", drop: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Writes df to a shared folder and reads it back: later jobs neither compute it again nor depend on executors that are lost.

    drop: tables made by this function that nothing reads any more once df is written; they are deleted then.
    """
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    with setting(spark, _CLEAN, "true"):
        df.write.option("compression", compression).parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    release(*drop)
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that materialise wrote and that nothing reads any more."""
    for df in tables:
        if path := df.__dict__.pop("_folder", None):
            remove(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = 8 << 20):
    """Python workers get batches of `size` bytes, a row at least, from the plans that run meanwhile."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with setting(spark, name, str(min(size, int(before)) if before.isdigit() else size)):
        yield


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def spread(df: DataFrame, key: str, rows: int, rows_per_task: int) -> DataFrame:
    """Deals df out by key to a number of partitions in proportion to its rows."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // rows_per_task)), key)


# --- words and shingles ------------------------------------------------------------------------

_G = np.random.Generator(np.random.Philox(20240607))
_BYTE = _G.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z counts as a-z
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(kind: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _POWERS[kind] = have = np.multiply.accumulate(out)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of one text, in order; words are runs other than x20 and x09-x0D, A-Z as a-z."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return np.empty(0, np.uint64)
    word = ~_SPACE[a]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * _powers("base", _BASE, len(a)), out=total[1:])
    h = (total[end] - total[start]) * _powers("inverse", _INVERSE, len(a))[start]
    return mix(h ^ (end - start).astype(np.uint64))


def shingles(data: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; with fewer words the whole sequence counts as one, without words there are none."""
    w = word_hashes(data)
    if not len(w):
        return w
    n = max(len(w) - k + 1, 1)
    h = np.full(n, min(len(w), k), np.uint64)
    for i in range(min(k, len(w))):
        h = mix(h ^ w[i : i + n])
    return np.unique(h)


# --- token ids by word -------------------------------------------------------------------------


def coded_words(texts: pa.Array):
    """The words of texts as lists, and all of them one after the other, dictionary-coded. None counts as empty."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    return lists, lists.flatten().dictionary_encode()


class WordIds:
    """The uint16 ids of texts, word by word.

    White space of ASCII never lies inside a token of the vocabularies used here, so a text's ids are those of
    its words one after the other, and words that are known needn't be encoded again. The table of known words
    is bounded: once it is full it stays as it is, unless most of a block's words are missing from it.
    """

    full = 700_000

    def __init__(self, encode, full: int | None = None):
        self.encode = encode  # list of words as bytes -> list of ids as bytes
        self.known: dict[bytes, bytes] = {}
        self.full = full or self.full

    def of_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word."""
        known = self.known
        fresh = [w for w in words if w not in known]
        if len(known) > self.full and len(fresh) > len(words) // 2:
            known.clear()
            fresh = words
        known.update(zip(fresh, self.encode(fresh)))
        parts = [known[w] for w in words]
        if len(known) > self.full:
            for w in fresh:
                del known[w]
        return parts

    def block(self, texts: pa.Array):
        lists, coded = coded_words(texts)
        parts = self.of_words(coded.dictionary.cast(pa.large_binary()).to_pylist())
        pool = np.frombuffer(b"".join(parts), np.uint16)
        size = np.fromiter(map(len, parts), np.int32, len(parts)) // 2
        place = (np.cumsum(size) - size).astype(np.int32)
        at = coded.indices.to_numpy()
        n = size[at]
        end = np.cumsum(n, dtype=np.int64)
        if len(end) and end[-1] >= 2**31:
            place = place.astype(np.int64)
        to = np.repeat((place[at] - end + n).astype(place.dtype), n)
        to += np.arange(len(to), dtype=place.dtype)
        ids = pool[to]
        del to
        bounds = np.append(0, end)[lists.offsets.to_numpy()]
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield ids[x:y]

    def counts(self, texts: pa.Array, block: int = 8 << 20):
        """The number of ids of each text in turn."""
        return self.texts(texts, block, self._counted)

    def _counted(self, texts: pa.Array):
        lists, coded = coded_words(texts)
        size = np.fromiter(map(len, self.of_words(coded.dictionary.cast(pa.large_binary()).to_pylist())), np.int64, len(coded.dictionary)) // 2
        ends = np.append(0, np.cumsum(size[coded.indices.to_numpy()]))[lists.offsets.to_numpy()]
        yield from np.diff(ends).tolist()

    def texts(self, texts: pa.Array | list, block: int = 8 << 20, of_block=None):
        """The ids of each text in turn; None counts as empty. block: bytes of text that are taken at once, a text's own at least."""
        of_block = of_block or self.block
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        gc.disable()  # the many small objects here hold no cycles
        try:
            at = 0
            while at < len(column):
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + block, "right")))
                yield from of_block(column.slice(at, to - at))
                at = to
        finally:
            gc.enable()


_CACHES: dict[tuple[str, int | None], WordIds | tuple[WordIds, WordIds]] = {}


def trim() -> None:
    """Gives freed memory of a worker back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc does so on request
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def forget() -> None:
    """Drops a worker's table of words and gives the memory back."""
    if _CACHES:
        _CACHES.clear()
        trim()


def _cached(path: str, full: int | None, make):
    """The vocabulary's table; a worker that goes on to another one drops the one before."""
    if (path, full) not in _CACHES:
        forget()
        _CACHES[path, full] = make()
    return _CACHES[path, full]


#: Letters that NFC leaves alone and whose lower case is one letter of the same kind, then one mark at most.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,]?)")


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones are themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def word_bpe(path: str, full: int | None = None) -> WordIds:
    """Ids of a vocabulary of the tokenizers library that lowers case and drops white space, without special tokens added.

    Plain words go to the vocabulary's merges directly; all others through the whole tokenizer. full: bound of the
    table of known words.
    """

    def make() -> WordIds:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        model, letters = t.model, _byte_letters()
        packed = lambda ids: struct.pack(f"<{len(ids)}H", *ids)
        stems: dict[str, bytes] = {}  # words without case and final mark
        mark = {m: packed([x.id for x in model.tokenize(m)]) if m else b"" for m in ("", ".", ",")}

        def one(word: bytes) -> bytes:
            if not word:
                return word
            w = word.decode()
            if not (m := _PLAIN.fullmatch(w)):
                return packed(t.encode(w, add_special_tokens=False).ids)
            x = m[1].lower()
            if (ids := stems.get(x)) is None:
                ids = packed([y.id for y in model.tokenize(x if x.isascii() else "".join(letters[b] for b in x.encode()))])
                if len(stems) < WordIds.full // 4:
                    stems[x] = ids
            return ids + mark[m[2]]

        return WordIds(lambda words: map(one, words), full)

    return _cached(path, full, make)


def word_pieces(path: str, ranks: str, pattern: str, full: int = 150_000) -> tuple[WordIds, WordIds]:
    """Ids for each word by itself in a sentencepiece vocabulary, and in a byte-level one given by ranks of byte strings."""

    def make() -> tuple[WordIds, WordIds]:
        import base64

        import sentencepiece
        import tiktoken

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        bytes_ = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        packed = lambda rows: (struct.pack(f"<{len(x)}H", *x) for x in rows)
        return (
            WordIds(lambda words: packed(sp.encode([w.decode() for w in words], num_threads=1)), full),
            WordIds(lambda words: packed(bytes_.encode_ordinary(" " + w.decode()) for w in words), full),
        )

    return _cached(f"{path} {ranks}", full, make)


# --- connected components ----------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable from each node of edges(a, b).

    Alternates large-star and small-star steps; every step is written to the shared folder. Each step first
    shrinks what a task holds to a spanning forest of it, so that rows don't gather at a node of many links.
    """
    from .forest import forest

    spark = edges.sparkSession
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    now = materialise(pairs.mapInArrow(forest, "a long, b long").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: neighbours above a node link to the least of its neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b")
        large = materialise(large.distinct(), "links", drop=(now,))
        # small star: a node and its neighbours below link to the least of them
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.select(F.col("b").alias("u"), F.col("a").alias("v")).join(low, "u")
        small = small.select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").union(low.select("m", "u"))
        now = materialise(small.distinct(), "links", drop=(large,))
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    top = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return materialise(top.union(now.select("a", "a").distinct()), "components", drop=(now,))
