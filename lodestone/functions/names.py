"""Scalar functions on names and strings; all are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = "<root>"


def full_match(text: Column, pattern: str) -> Column:
    """The pattern matches the whole text.  Dots take all but line feeds, classes are Unicode's."""
    return text.rlike(rf"(?dU)\A(?:{pattern})\z")


def search(text: Column, pattern: str) -> Column:
    """The pattern matches somewhere in the text."""
    return text.rlike(f"(?dU){pattern}")


def report_package(name: Column) -> Column:
    """What stands before the last slash; <root> where there is none."""
    return F.when(name.contains("/"), F.regexp_extract(name, r"(?s)\A(.*)/[^/]*\z", 1)).otherwise(F.lit(ROOT))


def package(name: Column) -> Column:
    """What stands before the last slash; empty where there is none."""
    return F.when(name.contains("/"), F.regexp_extract(name, r"(?s)\A(.*)/[^/]*\z", 1)).otherwise(F.lit(""))


def simple_name(name: Column) -> Column:
    return F.substring_index(name, "/", -1)


def is_suspicious(simple: Column) -> Column:
    """One or two lower-case ASCII letters."""
    return simple.rlike(r"\A[a-z]{1,2}\z")


def is_rl(simple: Column) -> Column:
    """rl and ASCII digits."""
    return simple.rlike(r"\Arl[0-9]+\z")


def is_readable(text: Column) -> Column:
    """Four characters at least, three of them alphabetic, none a control character."""
    return (F.char_length(text) >= 4) & (F.regexp_count(text, F.lit(r"\p{IsAlphabetic}")) >= 3) & ~text.rlike(r"\p{Cc}")


def modified_utf8_length(text: Column) -> Column:
    """Bytes of the text in the class-file form of UTF-8: NUL takes two, characters beyond U+FFFF six."""
    nuls = F.char_length(text) - F.char_length(F.replace(text, F.lit("\x00")))
    wide = F.char_length(text) - F.char_length(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", ""))
    return F.octet_length(text) + nuls + 2 * wide


def entry_name(raw: Column) -> Column:
    """An archive entry's name with / between its parts and without empty and . parts; null where it is empty, absolute or climbs with .. ."""
    slashed = F.translate(raw, "\\", "/")
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    bad = slashed.startswith("/") | slashed.rlike(r"\A[A-Za-z]:") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))
