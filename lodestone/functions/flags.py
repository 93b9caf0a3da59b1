"""Access-flag bitsets as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the class-file format.
CLASS_FLAGS = {"PUBLIC": 0x0001, "FINAL": 0x0010, "SUPER": 0x0020, "INTERFACE": 0x0200, "ABSTRACT": 0x0400, "SYNTHETIC": 0x1000, "ANNOTATION": 0x2000, "ENUM": 0x4000, "MODULE": 0x8000}
FIELD_FLAGS = {"PUBLIC": 0x0001, "PRIVATE": 0x0002, "PROTECTED": 0x0004, "STATIC": 0x0008, "FINAL": 0x0010, "VOLATILE": 0x0040, "TRANSIENT": 0x0080, "SYNTHETIC": 0x1000, "ENUM": 0x4000}
METHOD_FLAGS = {
    "PUBLIC": 0x0001, "PRIVATE": 0x0002, "PROTECTED": 0x0004, "STATIC": 0x0008, "FINAL": 0x0010, "SYNCHRONIZED": 0x0020, "BRIDGE": 0x0040,
    "VARARGS": 0x0080, "NATIVE": 0x0100, "ABSTRACT": 0x0400, "STRICT": 0x0800, "SYNTHETIC": 0x1000,
}
VISIBILITY = 0x0001 | 0x0002 | 0x0004


def mask(names: list[str], known: dict[str, int]) -> int:
    """The bits of named flags; an unknown name is an error."""
    unknown = [n for n in names if n.upper() not in known]
    if unknown:
        raise ValueError(f"unknown access flags: {unknown}")
    return reduce(lambda bits, n: bits | known[n.upper()], names, 0)


def has_all(flags: Column, bits: int) -> Column:
    """All bits are set; true for no bits."""
    return flags.bitwiseAND(F.lit(bits)) == bits


def has_any(flags: Column, bits: int) -> Column:
    """A bit is set; false for no bits."""
    return flags.bitwiseAND(F.lit(bits)) != 0


def has_none(flags: Column, bits: int) -> Column:
    return flags.bitwiseAND(F.lit(bits)) == 0


def add(flags: Column, bits: int) -> Column:
    return flags.bitwiseOR(F.lit(bits))


def remove(flags: Column, bits: int) -> Column:
    return flags.bitwiseAND(F.lit(~bits))


def names(flags: Column, known: dict[str, int]) -> Column:
    """The names of the known flags that are set, in bit order."""
    ordered = sorted(known, key=known.get)
    return F.array_compact(F.array(*(F.when(has_any(flags, known[n]), F.lit(n)) for n in ordered)))
