"""Personal data with offset-preserving deobfuscation.

Base spans come from four patterns on the text as it is. Then transducers rewrite the text and keep, for every
character they write, the source characters it stands for:

* homoglyphs (Cyrillic, Greek and full-width letters, digits of other scripts and forms) become ASCII characters,
  one for one;
* spelled digits, if one stands beside another, a digit or a disguised sign, become digits, those of a run joined; how
  many make an identifier is left to the patterns;
* disguised signs, such as "(at)" and "[dot]", or " at " with a " dot " after it, become @ and full stops.

The patterns run on the rewritten text too, with spelled digits left alone, with runs joined within a line, and with runs
joined over line ends and tabs. A match there that holds at least one rewritten character, and whose
source characters don't all lie inside one base span of its kind, is a further span. So a further span can contain or
extend a base span that is a fragment of it; base spans of a kind don't overlap.

Null and empty texts: no spans. Very long texts are searched whole. Repeated rows: each by itself. Empty table: no
rows. Other columns are ignored. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import forget, table

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match starts where its run of digits does: a later start in a run would fail as the first one did
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters that look like ASCII ones, by the ASCII letter.
HOMOGLYPHS = {
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "іι", "j": "ј", "l": "ӏ", "o": "оο", "p": "рρ", "q": "ԛ", "s": "ѕ", "v": "νѵ", "w": "ԝ", "x": "х", "y": "у", "n": "ո", "u": "υս", "g": "ɡ", "k": "к", "m": "м", "t": "т",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ",
    "@": "﹫", ".": "。．․", "-": "‐‑‒–−", "+": "﹢",
}
# Digits as words, 0 to 9, by language.
DIGITS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}


def _table() -> dict[int, str]:
    out = {ord(x): a for a, xs in HOMOGLYPHS.items() for x in xs}
    out |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width forms
    for c in (*range(0x660, 0x66A), *range(0x6F0, 0x6FA), *range(0x966, 0x970), *range(0x1D7CE, 0x1D800)):
        out[c] = str(unicodedata.digit(chr(c)))  # digits of other scripts and mathematical ones
    out |= {c: " " for c in (0xA0, 0x2007, 0x202F)}
    return out


_ASCII = _table()
_STRANGE = re.compile("[" + "".join(map(re.escape, sorted(map(chr, _ASCII)))) + "]")
_DIGIT = {w: str(i) for words in DIGITS.values() for i, w in enumerate(words.split())} | {"oh": "0"}
_WORD = "(?:" + "|".join(sorted(_DIGIT, key=len, reverse=True)) + ")"
_ONE = re.compile(_WORD, re.I)
_LETTER = r"[^\W_]"
_LINE, _ANY = "[ ,-]{1,2}", r"[\s,-]{1,4}"  # what joins a run


def _runs(join: str) -> re.Pattern:
    """Joint behind a digit, plus sign, run of spelled digits, joint before a digit."""
    return re.compile(rf"(?:(?<=[0-9])({join})|(?<!{_LETTER}))((?:plus|\+)[ ]?)?({_WORD}(?:{join}{_WORD})*)(?!{_LETTER})({join}(?=[0-9]))?|(?<!{_LETTER})(plus)[ ]?(?=[0-9])", re.I)


_RUNS = [_runs(_LINE), _runs(_ANY)]
_BESIDE = rf"(?:{_ANY}|[ ]?[.@+_()\[\]{{}}<>][ ]?|[ ](?:dot|at)[ ])"
_NEAR = re.compile(rf"\b{_WORD}(?:{_ANY}(?:[0-9]|{_WORD}(?!{_LETTER}))|[ ]?[.@_()\[\]{{}}<>][ ]?\w|[ ](?:dot|at)[ ])|_{_WORD}(?!{_LETTER})", re.I)
_NEAR_DIGIT = re.compile(rf"[0-9]{_BESIDE}{{1,2}}(?:plus[ ]?)?{_WORD}(?!{_LETTER})|plus[ ]?[0-9]", re.I)
_SIGN = re.compile(r"[ ]?[(\[{<][ ]?(?:(at|arroba|ät)|(dot|punkt|punto|point))[ ]?[)\]}>][ ]?", re.I)
_PART, _DOT = "[A-Za-z0-9._%+-]+", r"(?:[ ]dot[ ]|[ ]?[(\[{<][ ]?(?:dot|punkt|punto|point)[ ]?[)\]}>][ ]?)"
# not before an address: "me at john.doe@example.com"
_PLAIN_AT = re.compile(rf"(?<=[A-Za-z0-9._%+-])( at )(?=[A-Za-z0-9-]+(?: dot |\.)[A-Za-z0-9-]+)(?!{_PART}(?:{_DOT}{_PART})*(?:@|[ ]?[(\[{{<][ ]?(?:at|arroba|ät)[ ]?[)\]}}>]))", re.I)
_PLAIN_DOT = re.compile(r"(?<=[A-Za-z0-9-])( dot )(?=[A-Za-z0-9-])", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches of the email pattern that don't overlap, found from their @ signs."""
    last, at = 0, text.find("@")
    while at >= 0:
        if at >= last and (m := _DOMAIN.match(text, at)):
            start = at
            while start > last and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
                start -= 1
            if start < at:
                yield start, m.end()
                last = m.end()
        at = text.find("@", at + 1)


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {"email": list(emails(text)) if "@" in text else []}
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    out["card"] = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15] if "+" in text else []
    return out


class Rewritten:
    """A text with pieces replaced, and the source place of each of its characters."""

    def __init__(self, text: str, edits: list[tuple[int, int, str, list[tuple[int, int]]]]):
        """edits: start, end, what is written, and the source span of each character written; in order, apart."""
        parts, self.at, self.edits, n, last = [], [], [], 0, 0
        for start, end, new, spans in edits:
            self.at.append((n, last, None))
            parts.append(text[last:start])
            n += start - last
            self.at.append((n, start, spans))
            parts.append(new)
            n += len(new)
            last = end
        self.at.append((n, last, None))
        parts.append(text[last:])
        self.text = "".join(parts)
        self.starts = [x[0] for x in self.at]

    def source(self, i: int) -> tuple[int, int, bool]:
        """Source span of character i, and whether it was rewritten."""
        k = bisect_right(self.starts, i) - 1
        n, start, spans = self.at[k]
        return (start + i - n, start + i - n + 1, False) if spans is None else (*spans[i - n], True)

    def touched(self, a: int, b: int) -> bool:
        k = max(bisect_right(self.starts, a) - 1, 0)
        while k < len(self.at) and self.starts[k] < b:
            n, _, spans = self.at[k]
            if spans is not None and n + len(spans) > a:
                return True
            k += 1
        return False


def _digits(text: str, runs: re.Pattern) -> list[tuple[int, int, str, list[tuple[int, int]]]]:
    """Edits that make digits of the spelled ones."""
    out = []
    for m in runs.finditer(text):
        new, spans = "", []
        if m[1]:
            new, spans = " ", [m.span(1)]
        if plus := m[2] or m[5]:
            k = 2 if m[2] else 5
            new += "+"
            spans.append((m.start(k), m.start(k) + len(plus.rstrip(" "))))
        if m[3]:
            for w in _ONE.finditer(text, *m.span(3)):
                new += _DIGIT[w[0].lower()]
                spans.append(w.span())
        if m[4]:
            new += " "
            spans.append(m.span(4))
        out.append((m.start(), m.end(), new, spans))
    return out


def _edits(text: str, out: list) -> list[tuple[int, int, str, list[tuple[int, int]]]]:
    """These edits and those of disguised signs, in order, apart."""
    signs = []
    if "(" in text or "[" in text or "{" in text or "<" in text:
        signs += [(m.start(), m.end(), "@" if m[1] else ".", [m.span()]) for m in _SIGN.finditer(text)]
    low = " dot " in text or " DOT " in text or " Dot " in text
    if low or " at " in text or " AT " in text:
        at = [m.span(1) for m in _PLAIN_AT.finditer(text)]
        signs += [(a, b, "@", [(a, b)]) for a, b in at]
        if low:
            signs += [(*m.span(1), ".", [m.span(1)]) for m in _PLAIN_DOT.finditer(text)]
    last = 0
    for e in sorted(out + signs):
        if e[0] >= last:
            last = e[1]
            yield e


def find(text: str | None) -> tuple[dict, dict]:
    """Base spans and further spans, by kind."""
    text = text or ""
    base = detect(text)
    more: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    folded = text
    strange = [m.start() for m in _STRANGE.finditer(text)] if not text.isascii() else []
    if strange:
        folded = text.translate(_ASCII)
    ways = [list(_edits(folded, []))]
    if _NEAR.search(folded) or _NEAR_DIGIT.search(folded):
        for runs in _RUNS:
            if (edits := list(_edits(folded, _digits(folded, runs)))) not in ways:
                ways.append(edits)
    for edits in ways:
        if not strange and not edits:
            continue
        new = Rewritten(folded, edits)
        for kind, spans in detect(new.text).items():
            for a, b in spans:
                s, e = new.source(a)[0], new.source(b - 1)[1]
                k = bisect_right(strange, s - 1)
                if new.touched(a, b) or (k < len(strange) and strange[k] < e):
                    more[kind].append((s, e))
    for kind, spans in more.items():
        have = list(base[kind])
        for s, e in sorted(set(spans), key=lambda x: (x[0] - x[1], x)):
            if not any(x <= s and e <= y for x, y in have):
                have.append((s, e))
        more[kind] = sorted(have[len(base[kind]) :])
    return base, more


def joined(spans: dict) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def redact(text: str) -> str:
    """The text with every span of a kind replaced by the kind's name in brackets; of overlapping spans the union."""
    base, more = find(text)
    spans = sorted((a, b, k) for k in KINDS for a, b in base[k] + more[k])
    if not spans:
        return text
    out, last, i = [], 0, 0
    while i < len(spans):
        a, b, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < b:
            i += 1
            b = max(b, spans[i][1])
        out += [text[last:a], f"[{kind.upper()}]"]
        last, i = b, i + 1
    return "".join(out) + text[last:]


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _rows(batches):
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            base, more = find(text)
            every = {k: base[k] + more[k] for k in KINDS}
            out.append((*(len(base[k]) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), sum(map(len, more.values()))))
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        columns = [pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 7, types)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], [x.split()[0] for x in SCHEMA.split(", ")])


def _redacted(batches):
    forget()
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = [None if t is None else redact(t) for t in batch.column(at).to_pylist()]
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans, of every row of docs(doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_rows, SCHEMA)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in text."""
    return docs.mapInArrow(_redacted, docs.schema)


def op1_personal_data(spark, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
