"""Scalar functions of the text formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_dot(c: Column) -> Column:
    return F.when((c == ".") | (c == ""), None).otherwise(c)


def strand_of(c: Column) -> Column:
    return F.when(c.isin("+", "-"), c).otherwise("*")


def url_decode(c: Column) -> Column:
    """Percent escapes decoded; + stays; text with a bare % stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def url_encode(c: Column, chars: str) -> Column:
    """The characters in chars as percent escapes, % first."""
    for x in ["%", *[y for y in chars if y != "%"]]:
        c = F.replace(c, F.lit(x), F.lit(f"%{ord(x):02X}"))
    return c


def url_encode_except(c: Column, keep: str) -> Column:
    """All characters but those that match `keep` as percent escapes of their UTF-8 bytes."""
    one = lambda x: F.when(x.rlike(keep), x).otherwise(F.regexp_replace(F.hex(F.encode(x, "UTF-8")), "(..)", "%$1"))
    return F.when(c.rlike(f"^(?:{keep})*$"), c).otherwise(F.array_join(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), one), ""))


def gff3_attributes(c: Column) -> Column:
    """Array of (tag, value): pieces between semicolons, split at their first =; pieces without one are ignored."""
    pieces = F.filter(F.split(c, ";"), lambda x: F.instr(x, "=") > 0)
    return F.transform(pieces, lambda x: F.struct(F.substring_index(F.ltrim(x), "=", 1).alias("tag"), F.substr(F.ltrim(x), F.instr(F.ltrim(x), "=") + 1).alias("value")))


def gff2_attributes(c: Column) -> Column:
    """Array of (tag, value): pieces between semicolons outside quotes; the tag up to white space; one pair of quotes removed."""
    pieces = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r'((?:[^;"]|"[^"]*")+)'), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(pieces, lambda x: F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("tag"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^\S+", "")), '^"|"$', "").alias("value")))


def attribute(attributes: Column, tag: str) -> Column:
    """Value of a tag; of several the last."""
    return F.try_element_at(F.filter(attributes, lambda x: x["tag"] == tag), F.lit(-1))["value"]


def gff3_attribute(c: Column, tag: str) -> Column:
    """Value of a tag of GFF3 attributes, of several the last, found without taking the others apart; null if it is not there."""
    pattern = rf"(?s)^(?:.*;)? *\Q{tag}\E=([^;]*)"
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))


def values(c: Column) -> Column:
    """A multi-valued attribute: split at commas, then decoded; null is the empty array."""
    return F.coalesce(F.transform(F.split(c, ","), url_decode), F.array().cast("array<string>"))


def rgb_to_hex(c: Column) -> Column:
    """r,g,b as #RRGGBB; 0 is null."""
    p = F.split(c, ",")
    part = lambda i: F.lpad(F.hex(F.get(p, F.lit(i)).try_cast("int")), 2, "0")
    return F.when((c != "0") & (c != ".") & (F.size(p) == 3), F.concat(F.lit("#"), part(0), part(1), part(2)))


def hex_to_rgb(c: Column) -> Column:
    part = lambda a: F.conv(F.substring(c, a, 2), 16, 10)
    return F.coalesce(F.concat_ws(",", part(2), part(4), part(6)), F.lit("0"))


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGTacgt", "TGCAtgca"))


def track_line(c: Column) -> Column:
    """Map of key to value of a track line; values may be quoted and hold blanks."""
    found = F.regexp_extract_all(c, F.lit(r'(\w+=(?:"[^"]*"|\S+))'), F.lit(1))
    return F.map_from_entries(F.transform(found, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.regexp_replace(F.substr(x, F.instr(x, "=") + 1), '^"|"$', "").alias("value"))))


def position(seqnames: Column, start: Column, end: Column) -> Column:
    return F.concat(seqnames, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def parse_position(c: Column) -> Column:
    """chr:start-end, thousands commas allowed, as a struct."""
    d = F.replace(c, F.lit(","), F.lit(""))
    g = lambda i: F.regexp_extract(d, r"^([^:]+):(\d+)-(\d+)$", i)
    return F.struct(g(1).alias("seqnames"), g(2).try_cast("int").alias("start"), g(3).try_cast("int").alias("end"))
