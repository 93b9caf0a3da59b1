"""Edits of class tables: each takes a DataFrame and gives a new one.

A class transform changes rows of `classes` (class_id, name, super_name,
access_flags, interfaces, ...); member transforms change `fields` or `methods`
(class_id, name, descriptor, access_flags, ...); code transforms change
`code_items`.  Matchers are those of lodestone.operators.matchers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lodestone.functions import flags as bits
from lodestone.operators.matchers import Matcher, anything

Edit = Callable[[DataFrame], DataFrame]


def update(column: str, value: Column, match: Matcher | None = None) -> Edit:
    """Set a column of the matching rows."""
    test = (match or anything()).column

    def apply(df: DataFrame) -> DataFrame:
        kind = df.schema[column].dataType
        new = value if isinstance(kind, ArrayType) else value.cast(kind)
        return df.withColumn(column, F.when(test, new).otherwise(F.col(column)))

    return apply


def rename(to: str, match: Matcher | None = None) -> Edit:
    """Set the name alone; what refers to the old one stays as it is."""
    return update("name", F.lit(to), match)


def set_flags(mask: int, match: Matcher | None = None) -> Edit:
    return update("access_flags", F.lit(mask), match)


def add_flags(mask: int, match: Matcher | None = None) -> Edit:
    return update("access_flags", bits.add(F.col("access_flags"), mask), match)


def remove_flags(mask: int, match: Matcher | None = None) -> Edit:
    return update("access_flags", bits.remove(F.col("access_flags"), mask), match)


def set_super_class(name: str | None, match: Matcher | None = None) -> Edit:
    return update("super_name", F.lit(name), match)


def add_interface(name: str, match: Matcher | None = None) -> Edit:
    """Append, unless it is there already."""
    have = F.array_contains("interfaces", name)
    return update("interfaces", F.when(have, F.col("interfaces")).otherwise(F.array_append("interfaces", F.lit(name))), match)


def remove_interface(name: str, match: Matcher | None = None) -> Edit:
    return update("interfaces", F.array_remove("interfaces", name), match)


def drop_rows(match: Matcher) -> Edit:
    """Remove fields or methods."""
    return lambda df: df.where(~match.column)


def mapped(column: str, mapping: DataFrame, keys: list[str], value: str, match: Matcher | None = None) -> Edit:
    """Look a new value up by key columns; rows without an entry, or not matching, keep theirs.  mapping: keys and value."""
    test = (match or anything()).column

    def apply(df: DataFrame) -> DataFrame:
        entries = mapping.select(*keys, F.col(value).alias("_new"))
        joined = df.join(entries, keys, "left")
        return joined.withColumn(column, F.when(test & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col(column))).select(*df.columns)

    return apply


def redirect_calls(match: Matcher, owner: str, name: str, descriptor: str | None = None) -> Edit:
    """Point matching calls at another method; without a descriptor theirs stays."""
    parts = {"owner": owner, "name": name} | ({"descriptor": descriptor} if descriptor else {})

    def apply(df: DataFrame) -> DataFrame:
        hit = match.column
        return df.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in parts.items()})

    return apply


def replace_string(old: str, new: str) -> Edit:
    return update("ldc_string", F.lit(new), Matcher.of((F.col("kind") == "ldc") & (F.col("ldc_string") == old), f"ldc {old!r}"))


def sequence(*edits: Edit) -> Edit:
    """In order; each sees what the one before made."""
    return lambda df: reduce(lambda d, e: e(d), edits, df)


def gate_by_member(owners: DataFrame, members: DataFrame, match: Matcher, key: str, into: str = "_gate") -> DataFrame:
    """owners with a column: whether any member matches."""
    hit = members.where(match.column).select(key).distinct().withColumn(into, F.lit(True))
    return owners.join(hit, key, "left").withColumn(into, F.coalesce(into, F.lit(False)))


def within(owners: DataFrame, owner: Matcher, key: str, edit: Edit, test: Matcher | None = None) -> Edit:
    """Apply an edit only to rows of the owners that match, and only where test holds; other rows stay as they are."""

    def apply(df: DataFrame) -> DataFrame:
        inside = owners.where(owner.column).select(key).distinct().withColumn("_in", F.lit(True))
        marked = df.join(inside, key, "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
        if test is not None:
            marked = marked.withColumn("_in", F.col("_in") & test.column)
        changed = edit(marked.where("_in")).select(*df.columns)
        return changed.unionByName(marked.where("not _in").select(*df.columns))

    return apply
