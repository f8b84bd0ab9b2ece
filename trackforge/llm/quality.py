"""Quality rules by tokeniser fertility.

Each text's words are measured with two public vocabularies. With a sentencepiece one: characters per token, the share
of tokens that are byte fallbacks, and the entropy of the token distribution relative to that of as many tokens, 1024
at most, all different. With a byte-level one of many languages: characters per token. A text is rejected if a measure is outside the band of its script; Latin texts are told apart by common
words of languages, signs around the words left aside. Texts of another script have the band of OTHER. Relative entropy falls with the number of tokens, so its
least value is given at KNOTS and interpolated in the logarithm of the number of tokens. Two base rules come first: too few words, or
too many words in repeated three-word windows.

Null and empty texts: no words, base_failed. Texts of any length are measured whole, one at a time. Repeated rows
and ties: each row is judged by itself. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, word_pieces

# Chosen here: frequent function words by which Latin-script languages are told apart.
COMMON = {
    "en": "the of and to in is that for it with as was on are this be".split(),
    "de": "der die und das den von zu mit dem ist ein eine nicht auf für im".split(),
    "fr": "le la les de des et un une du que est pour dans qui avec par".split(),
    "es": "el la los las de que y en un una por con para del se su".split(),
}
KNOTS = np.arange(6.0, 13.0)  # log2 of the number of tokens
# Chosen here: (least, greatest) characters per token, greatest byte share, least relative entropy, at each of KNOTS or
# one for all, and (least, greatest) characters per token in the second vocabulary; by language or script. Of the four
# languages, the entropies are the 0.002 quantile of texts labelled quality 1, on one half of sf0.1's labels, and the
# least characters per token in the second vocabulary 0.97 times that quantile; the greatest are far above any text's, for
# invented words there are shorter in tokens than real ones. The entropy of Latin is the least of the four. The other scripts have no
# labelled text to fit to.
BANDS = {
    "en": ((1.8, 8.0), 0.05, (0.872, 0.806, 0.752, 0.705, 0.660, 0.674, 0.688), (2.05, 8.0)),
    "de": ((1.8, 8.0), 0.05, (0.860, 0.801, 0.743, 0.692, 0.642, 0.656, 0.667), (2.1, 8.0)),
    "fr": ((1.6, 8.0), 0.05, (0.838, 0.791, 0.744, 0.683, 0.637, 0.650, 0.659), (1.79, 8.0)),
    "es": ((1.6, 8.0), 0.05, (0.856, 0.793, 0.730, 0.683, 0.644, 0.659, 0.667), (1.86, 8.0)),
    "Latin": ((1.4, 8.0), 0.10, (0.838, 0.791, 0.730, 0.683, 0.637, 0.650, 0.659), (1.2, 8.0)),
    "Cyrillic": ((1.1, 8.0), 0.20, 0.45, (0.6, 8.0)),
    "Greek": ((0.5, 8.0), 0.60, 0.45, (0.4, 8.0)),
    "OTHER": ((0.2, 8.0), 1.00, 0.40, (0.2, 8.0)),
}
_SIGNS = b".,;:!?\"'()[]{}#*$%&|<>"
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_GREEK = re.compile("[Ͱ-Ͽ]")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_WORDS = {w.encode(): lang for lang in COMMON for w in COMMON[lang] if sum(w in x for x in COMMON.values()) == 1}


def language(words: list[bytes], text: str) -> str:
    """Script of most of the letters; for Latin the language whose common words are most frequent, if any are."""
    counts = {"Latin": len(_LATIN.findall(text)), "Cyrillic": len(_CYRILLIC.findall(text)), "Greek": len(_GREEK.findall(text))}
    other = sum(map(str.isalpha, text)) - sum(counts.values()) if not text.isascii() else 0
    script = max(counts, key=counts.get)
    if counts[script] <= other:
        return "OTHER"
    if script != "Latin":
        return script
    hits = dict.fromkeys(COMMON, 0)
    for w in words:
        if (lang := _WORDS.get(w.strip(_SIGNS))) is not None:
            hits[lang] += 1
    best = max(hits, key=hits.get)
    return best if hits[best] else "Latin"


def repeated_words(words: list[bytes]) -> int:
    """Words within three-word windows that the text holds twice or more, the first ones included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    x = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pairs = np.unique(x[:-2] * len(number) + x[1:-1], return_inverse=True)[1]
    _, where, count = np.unique(pairs * len(number) + x[2:], return_inverse=True, return_counts=True)
    start = np.flatnonzero(count[where] > 1)
    hit = np.zeros(len(words), bool)
    for d in range(3):
        hit[start + d] = True
    return int(hit.sum())


def repeated_lines(data: bytes) -> int:
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def fertility(ids: np.ndarray, word_chars: int) -> tuple[float, float, float]:
    """Characters per token, byte share, relative entropy."""
    n = len(ids)
    if not n:
        return 0.0, 0.0, 0.0
    count = np.bincount(ids)
    share = count[count > 0] / n
    entropy = float(-(share * np.log2(share)).sum())
    return word_chars / n, float(((ids >= 3) & (ids < 259)).mean()), entropy / np.log2(min(n, 1024)) if n > 1 else 1.0


def verdict(band, n: int, chars: float, bytes_: float, entropy: float, chars_2: float) -> bool:
    """Whether the measures of a text of n tokens are inside the band."""
    (low, high), most, least, (low_2, high_2) = band
    if not isinstance(least, float):
        least = np.interp(np.log2(max(n, 1)), KNOTS, least)
    return bool(low <= chars <= high and bytes_ <= most and entropy >= least and low_2 <= chars_2 <= high_2)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, band string, chars_per_token double, byte_share double, entropy double, chars_per_token_2 double"


def _measure(path: str, ranks: str, pattern: str, bands: dict, text_too: bool):
    def run(batches):
        pieces, second = word_pieces(path, ranks, pattern)
        for batch in batches:
            texts, out = batch.column("text"), []
            for text, ids, n_2 in zip(texts, pieces.texts(texts), second.counts(texts)):  # one text at a time leaves Arrow
                text = text.as_py() or ""
                data = text.encode()
                words = data.split()
                n = len(words)
                spaces = sum(map(text.count, " \t\n\r\x0b\x0c"))
                again = repeated_words(words)
                failed = n < 50 or 100 * again > 50 * n
                lang = language(words, text)
                measures = (*fertility(ids, len(text) - spaces), (len(text) - spaces) / n_2 if n_2 else 0.0)
                out.append((n, len(text) - spaces, len(_SYMBOLS.findall(text)), repeated_lines(data), again, failed, not failed and verdict(bands.get(lang, bands["OTHER"]), len(ids), *measures), lang, *measures))
            names = [x.split()[0] for x in SCHEMA.split(", ")][1:]
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()] + [pa.float64()] * 4
            columns = [pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * len(names), types)]
            if text_too:  # the rows kept, with the columns that came
                yield batch.filter(columns[names.index("kept")])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], ["doc_id", *names])

    return run


def quality_rules(docs: DataFrame, path: str, ranks: str, pattern: str, bands: dict = BANDS) -> DataFrame:
    """The measures and the verdict on every row of docs(doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_measure(path, ranks, pattern, bands, False), SCHEMA)


def keep_good(docs: DataFrame, path: str, ranks: str, pattern: str, bands: dict = BANDS) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep."""
    return docs.mapInArrow(_measure(path, ranks, pattern, bands, True), docs.schema)


def vocabularies() -> tuple[str, str, str]:
    """Places of the two public vocabularies, and the pattern that splits text for the second."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), *vocabularies())
