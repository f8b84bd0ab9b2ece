"""Substring dedup by sliding sentence spans.

A text is cut into sentences, at full stops, question and exclamation marks before white space, and at line ends.
A sentence of more than `longest` words is cut further, at places that its words choose: of every `longest` places in
a row the one of least hash of the two words around it. So a passage is cut alike wherever it lies, and any run of
`longest` places has a cut. A span starts at each sentence and takes in sentences until it has at least
`least_sentences` of them and `least_words` words: fewer words of a language recur by chance. A text of several
sentences but fewer words is one span as a whole. Spans are hashed over their words and joined globally; the first one (least doc_id, then place) of equal spans stays. Every sentence that a span other
than the first covers is removed.

Only spans that occur more than once come back from the global step, by hash, each as one row with its first place.
They meet the places by a shuffled inner join, in which adaptive execution splits a partition that one hot span
makes large. Null and empty texts: no sentences, text as it was.
Texts of fewer sentences: no spans. Very long texts are read whole. Rows of null doc_id: their text stays
and counts for no span. Copies of a text: all but the first lose the sentences that spans cover. Rows with one doc_id
count as places of one document; ties go to the least place. Empty table: no rows. Other columns, whatever their names,
are kept by `without_repeats` and ignored by the query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, materialise, mix, small_batches, table, word_hashes


def sentences(text: str, longest: int = 16):
    """Start and end of each sentence as bytes of UTF-8, and the hashes of all words with each sentence's first."""
    data = text.encode()
    words = word_hashes(data)
    at = np.frombuffer(data, np.uint8)
    space = (at == 32) | ((at >= 9) & (at <= 13))
    edge = np.flatnonzero(np.diff(~space, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(words):
        return data, words, start, end, np.empty(0, np.int64)
    new = np.zeros(len(words), bool)
    new[0] = True
    last = at[end[:-1] - 1]
    new[1:] = (last == 46) | (last == 33) | (last == 63)
    lines = np.cumsum(at == 10)
    new[1:] |= lines[start[1:]] != lines[start[:-1]]
    first = np.flatnonzero(new)
    size = np.diff([*first, len(words)])
    if (size > longest).any():  # content-defined places in long sentences
        pair = np.zeros(len(words), np.uint64)
        pair[1:] = mix(words[1:] * np.uint64(3) + words[:-1])
        for a, n in zip(first[size > longest], size[size > longest]):
            inside = pair[a + 1 : a + n]
            new[a + 1 + np.unique(np.arange(n - longest) + np.lib.stride_tricks.sliding_window_view(inside, longest).argmin(axis=1))] = True
        first = np.flatnonzero(new)
    return data, words, start, end, first


def spans(words: np.ndarray, first: np.ndarray, least_sentences: int, least_words: int):
    """For each sentence that a span can start at: hash of the span, its first sentence and the one after its last."""
    if len(first) < least_sentences:
        return np.empty(0, np.uint64), first[:0], first[:0]
    bounds = np.append(first, len(words))
    to = np.maximum(np.searchsorted(bounds, first + min(least_words, len(words))), np.arange(len(first)) + least_sentences)
    i = np.flatnonzero(to <= len(first))
    to = to[i]
    # a rolling hash over words: prefix sums of hash times power
    n = len(words)
    base = 0xD6E8FEB86659FD93
    power = np.full(n + 1, base, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * power[:n], out=total[1:])
    # brought to one power, that of the longest text possible, by multiplying instead of dividing
    inverse = np.full(n + 1, pow(base, -1, 2**64), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    a, b = bounds[i], bounds[to]
    return mix((total[b] - total[a]) * inverse[a] ^ (b - a).astype(np.uint64)), i, to


def _spans(least_sentences: int, least_words: int, longest: int):
    def run(batches):
        for batch in batches:
            docs, hashes, places = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text or doc is None:
                    continue
                _, words, _, _, first = sentences(text, longest)
                h, i, _ = spans(words, first, least_sentences, least_words)
                docs.append(np.full(len(h), doc, np.int64))
                hashes.append(h.view(np.int64))
                places.append(i.astype(np.int32))
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(docs)), pa.array(np.concatenate(places))], ["span", "doc_id", "place"])

    return run


def _cut(least_sentences: int, least_words: int, longest: int, full: bool, mark: str):
    """mapInArrow over (doc_id, text, mark): the text without the sentences that the spans at these places cover."""

    def run(batches):
        for batch in batches:
            texts, counts, gone = [], [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column(mark).to_pylist()):
                if not text:
                    texts.append(text)
                    counts.append(0)
                    gone.append(0)
                    continue
                if not places and full:
                    texts.append(text)
                    counts.append(0)
                    gone.append(0)
                    continue
                data, words, start, _, first = sentences(text, longest)
                counts.append(len(first))
                if not places:
                    texts.append(text)
                    gone.append(0)
                    continue
                _, i, to = spans(words, first, least_sentences, least_words)
                drop = np.zeros(len(first) + 1, np.int64)
                chosen = np.isin(i, places)
                np.add.at(drop, i[chosen], 1)
                np.add.at(drop, to[chosen], -1)
                out = np.cumsum(drop)[:-1] > 0
                begin = np.append(start[first], len(data))
                begin[0] = 0
                texts.append(b"".join(data[begin[k] : begin[k + 1]] for k in np.flatnonzero(~out)).decode())
                gone.append(int(out.sum()))
            if full:
                at = batch.schema.get_field_index("text")
                kept = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                yield kept.select([c for c in kept.schema.names if c != mark])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_sentences", "n_removed", "text"])

    return run


def _places(docs: DataFrame, least_sentences: int, least_words: int, longest: int, mark: str) -> DataFrame:
    """(mark_id, mark): documents and the sentences at which spans start that are not the first of their kind."""
    with small_batches(docs.sparkSession):
        every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_spans(least_sentences, least_words, longest), "span long, doc_id long, place int")
        every = materialise(every, "spans")
    first = every.groupBy("span").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").select("span", F.col("first.doc_id").alias("d"), F.col("first.place").alias("p"))
    again = every.join(first, "span").where("doc_id <> d or place <> p").select("doc_id", "place")
    places = again.groupBy("doc_id").agg(F.sort_array(F.collect_set("place")).alias(mark)).withColumnRenamed("doc_id", mark + "id")
    return materialise(places, "places", drop=(every,))


def _marked(docs: DataFrame, least_sentences: int, least_words: int, longest: int) -> tuple[DataFrame, str]:
    mark = fresh_name(docs, "places_")
    while fresh_name(docs, mark + "id") != mark + "id":
        mark = "_" + mark
    places = _places(docs, least_sentences, least_words, longest, mark)
    return docs.join(places, docs["doc_id"] == places[mark + "id"], "left").drop(mark + "id"), mark


def without_repeats(docs: DataFrame, least_sentences: int = 2, least_words: int = 18, longest: int = 16) -> DataFrame:
    """docs, all columns, with repeated sentences removed from text."""
    rows, mark = _marked(docs, least_sentences, least_words, longest)
    return rows.mapInArrow(_cut(least_sentences, least_words, longest, True, mark), docs.schema)


def repeats(docs: DataFrame, least_sentences: int = 2, least_words: int = 18, longest: int = 16) -> DataFrame:
    """doc_id, n_sentences, n_removed and what is left of text, for every row of docs(doc_id, text)."""
    rows, mark = _marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), least_sentences, least_words, longest)
    return rows.mapInArrow(_cut(least_sentences, least_words, longest, False, mark), "doc_id long, n_sentences long, n_removed long, text string")


def op4_sentence_spans(spark, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
