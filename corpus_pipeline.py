"""A training corpus in five stages: quality rules, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows as Parquet and reads them
again as the next one's docs. All but the last keep the columns of documents. SQL can't express the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackforge.llm.common import fresh_name, materialise, table
from trackforge.llm.jaccard import jaccard_components
from trackforge.llm.mixing import mixed
from trackforge.llm.packing import pack
from trackforge.llm.pii import redacted
from trackforge.llm.quality import keep_good, vocabularies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts are rejected; each row, repeated or not and of any length, is judged by itself. Columns of any
    name are kept. Empty table: no rows."""
    return keep_good(docs, *vocabularies())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least doc_id stays; of rows that are equal in id and text one.

    Rows of null doc_id stay. Empty texts are nobody's duplicates. Texts of any length, ties and repeated rows are
    compared as the join does; columns of any name are kept. Empty table: no rows."""
    name, turn = fresh_name(docs, "kept_"), fresh_name(docs, "turn_")
    keep = jaccard_components(docs).where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    # always by a shuffle of the texts, small or large: what is kept grows with the input
    some = docs.join(keep.hint("merge"), docs["doc_id"] == keep[name], "left_semi")
    hashes = [F.xxhash64("text"), F.crc32(F.col("text").cast("binary")), F.length("text")]
    once = some.withColumn(turn, F.row_number().over(Window.partitionBy("doc_id", *hashes).orderBy(hashes[0]))).where(F.col(turn) == 1)
    return once.select(*docs.columns).union(docs.where("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text.

    Null texts stay null; texts are searched whole, row by row. Columns of any name are kept. Empty table: no rows."""
    out = redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as the mix says; toxic ones go.

    Null and empty texts have the posterior of a text without features; equal rows have equal rates and chances.
    Columns of any name are kept. Empty table: no rows."""
    import public_tokenizers

    return mixed(docs, table(spark, sf_dir, "labels"), public_tokenizers.path("word_bpe_49k.json"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of tokens.

    Null and empty texts are an end id; long texts are cut into pieces; rows taken several times are packed as often.
    Empty table: no rows."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("personal data", personal_data), ("mixing to target weights", mixing), ("best-fit packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), ()
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0], drop=before)
        before = (docs,)
    return docs
