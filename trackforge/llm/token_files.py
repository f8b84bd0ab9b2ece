"""Token ids in frequency-ranked, byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank in the corpus (0: most frequent; ties: smaller id). A file holds documents in
ascending order of doc_id:

    magic 8 bytes | n_documents, n_ids, n_data u64 | doc_id i64 each | ids of each u32 | control | data | crc32 u32

Control has two bits for each rank, four ranks a byte, lowest bits first: the number of its data bytes less one.
Data has the ranks' bytes, lowest first. Control and data are decoded by table lookup: a control byte gives the
four lengths, their running sums give the places, and each rank is gathered from its place under a mask.
The ranks' table is a file of its own (ids by rank, u32). Files are written to a temporary name and renamed, so a
task that runs twice leaves one whole file.

Null and empty texts: the end id alone. Texts of any length are encoded whole. Repeated rows: each is written. Null doc_id: before all others.
Ties of doc_id: in any order; a doc_id that many rows share, null or not, has as many buckets as its rows fill. Empty table: no files, no rows. Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _written, materialise, release, shared_dir, table, word_bpe

MAGIC = b"TFRANK01"
#: Stands for a null doc_id.
NO_ID = -(2**63)
#: For each control byte: the lengths of its four ranks.
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)
_MASK = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes."""
    r = ranks.astype(np.uint32)
    code = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    padded = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    padded[: len(r)] = code
    q = padded.reshape(-1, 4)
    control = (q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).astype(np.uint8)
    raw = r.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) <= code[:, None]].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(length) - length
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for i in range(1, int(length.max(initial=1))):
        out |= raw[at + i].astype(np.uint32) << np.uint32(8 * i)
    return out & _MASK[length - 1]


def pack_file(docs: list[int], counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = encode(ranks)
    body = MAGIC + np.array([len(docs), len(ranks), len(data)], "<u8").tobytes() + np.array(docs, "<i8").tobytes() + np.array(counts, "<u4").tobytes() + control + data
    return body + zlib.crc32(body).to_bytes(4, "little")


def unpack_file(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, counts and ranks."""
    if body[:8] != MAGIC or zlib.crc32(body[:-4]) != int.from_bytes(body[-4:], "little"):
        raise ValueError("not a whole file of ranks")
    n, total, size = np.frombuffer(body, "<u8", 3, 8).astype(int)
    at = 32
    docs = np.frombuffer(body, "<i8", n, at)
    counts = np.frombuffer(body, "<u4", n, at + 8 * n)
    at += 12 * n
    mid = at + -(-total // 4)
    return docs, counts, decode(body[at:mid], body[mid : mid + size], total)


def bucket_of(docs: np.ndarray, cuts: np.ndarray, first: int) -> np.ndarray:
    """Bucket of each doc_id, in the order of doc_ids; one that several cuts are equal to has its rows dealt out to that many buckets in turn.

    first: the number of the first row."""
    left, right = np.searchsorted(cuts, docs, "left"), np.searchsorted(cuts, docs, "right")
    return np.where(right > left, left + 1 + (first + np.arange(len(docs))) % np.maximum(right - left, 1), right).astype(np.int32)


def _token_blobs(path: str, end_id: int, cuts: np.ndarray):
    def run(batches):
        words, pack = word_bpe(path), zstandard.ZstdCompressor(level=1).compress
        rows = 0
        for batch in batches:
            blobs, n = [], []
            for ids in words.texts(batch.column("text")):
                ids = np.append(ids, np.uint16(end_id)).astype("<u2")
                blobs.append(pack(ids.tobytes()))
                n.append(len(ids))
            doc = batch.column("doc_id").cast(pa.int64())
            bucket = bucket_of(doc.to_numpy(), cuts, rows)
            rows += len(bucket)
            yield pa.RecordBatch.from_arrays([doc, pa.array(n, pa.int64()), pa.array(blobs, pa.binary()), pa.array(bucket)], ["doc_id", "n", "ids", "bucket"])

    return run


def _histogram(batches):
    unpack = zstandard.ZstdDecompressor().decompress
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for x in batch.column("ids").to_pylist():
            total += np.bincount(np.frombuffer(unpack(x), "<u2"), minlength=1 << 16)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])


def _files(rank_of: np.ndarray, file_ids: int):
    """mapInArrow over blobs in order: (first doc_id, file number within the partition, body) of files of about file_ids ids."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        docs, counts, held, n = [], [], [], 0

        def flush():
            body = pack_file(docs, counts, np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([docs[0]], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([n], pa.int64()), pa.array([body], pa.binary())], ["first", "docs", "ids", "body"])

        for batch in batches:
            for doc, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                held.append(rank_of[np.frombuffer(unpack(x), "<u2")])
                docs.append(doc)
                counts.append(len(held[-1]))
                n += len(held[-1])
                if n >= file_ids:
                    yield flush()
                    docs, counts, held, n = [], [], [], 0
        if docs:
            yield flush()

    return run


def _read(id_of: np.ndarray):
    def run(batches):
        for batch in batches:
            for before, body in zip(batch.column("before").to_pylist(), batch.column("body").to_pylist()):
                docs, counts, ranks = unpack_file(body)
                ids = id_of[ranks].astype("<u4")
                ends = np.cumsum(counts, dtype=np.int64)
                crc = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == NO_ID), pa.array(before + ends - counts), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_files(docs: DataFrame, path: str, end_id: int, folder: str, file_ids: int = 1 << 21, bucket_bytes: int = 64 << 20) -> DataFrame:
    """Writes docs(doc_id, text) as files of ranks under folder; returns the table of files: part, first, docs, ids, body, and own, the ids of its bucket before it.

    The folder is a Parquet table whose rows are whole files of the format (body) with their place in the order, so
    that it can be written to and read from any store that Spark reaches and commits of tasks are atomic.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    # a task holds one bucket, so their number follows the bytes of text
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ways = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes), 1)
    # bounds of ranges of doc_id, from that column alone
    cuts = docs.approxQuantile("doc_id", [i / ways for i in range(1, ways)], 0.1 / ways) if ways > 1 else []
    cuts = np.array(sorted(min(int(c), 2**63 - 1) for c in cuts), np.int64)
    blobs = docs.mapInArrow(_token_blobs(path, end_id, cuts), "doc_id long, n long, ids binary, bucket int")
    blobs = materialise(blobs.repartition(ways, "bucket").sortWithinPartitions("bucket", "doc_id", "n", "ids"), "blobs", "none")
    hist = blobs.select("ids").mapInArrow(_histogram, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").toPandas()
    id_of = hist["id"].to_numpy(np.uint32)
    rank_of = np.zeros(1 << 16, np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    spark.createDataFrame([(id_of.astype("<u4").tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{folder}/ranks")

    # a bucket lies in one partition; its documents go to files of that bucket in order
    def by_bucket(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("n", "ascending"), ("ids", "ascending")])
        out = list(_files(rank_of, file_ids)(t.to_batches()))
        out = pa.Table.from_batches(out)
        b = t.column("bucket")[0].as_py()
        ids = out.column("ids").to_numpy()
        return pa.table([pa.array([b] * len(out), pa.int32()), pa.array(range(len(out)), pa.int32()), *out.columns, pa.array(np.cumsum(ids) - ids)], names=["bucket", "part", "first", "docs", "ids", "body", "own"])

    files = blobs.groupBy("bucket").applyInArrow(by_bucket, "bucket int, part int, first long, docs long, ids long, body binary, own long")
    files.write.option("compression", "none").parquet(f"{folder}/files")
    release(blobs)
    return spark.read.parquet(f"{folder}/files")


def read_files(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    [row] = spark.read.parquet(f"{folder}/ranks").collect()
    id_of = np.frombuffer(row["ids"], "<u4")
    files = spark.read.parquet(f"{folder}/files")
    # running sums of the buckets, of which there are as many as blocks of text; files hold those within their bucket
    buckets = files.groupBy("bucket").agg(F.sum("ids").alias("n")).orderBy("bucket").toPandas()
    start = pd.DataFrame({"bucket": buckets["bucket"].astype("int32"), "start": (buckets["n"].cumsum() - buckets["n"]).astype("int64")})
    starts = spark.createDataFrame(start, "bucket int, start long")
    placed = files.join(F.broadcast(starts) if len(start) <= 1 << 20 else starts, "bucket").withColumn("before", F.col("start") + F.col("own"))
    return placed.select("before", "body").mapInArrow(_read(id_of), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_dir(spark, "ranked")
    write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, folder)
    _written.append((spark, folder))
    return read_files(spark, folder)
