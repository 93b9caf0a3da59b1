"""Differences of two snapshots of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key, change, column, old, new): missing and extra keys, and a row for each differing column; values as text."""
    old = before.select(*key, *(F.col(c).alias(f"_old_{c}") for c in columns), F.lit(True).alias("_before"))
    new = after.select(*key, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_after"))
    both = old.join(new, key, "full_outer")
    text = F.lit(None).cast("string")
    note = lambda change, column=text, was=text, now=text: F.struct(F.lit(change).alias("change"), column.alias("column"), was.alias("old"), now.alias("new"))
    cells = [F.when(~F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}")), note("changed", F.lit(c), F.col(f"_old_{c}").cast("string"), F.col(f"_new_{c}").cast("string"))) for c in columns]
    changed = F.array_compact(F.array(*cells))
    rows = F.when(F.col("_after").isNull(), F.array(note("missing"))).when(F.col("_before").isNull(), F.array(note("extra"))).otherwise(changed)
    return both.select(*key, F.explode(rows).alias("r")).select(*key, "r.*")


def sequence_diff(before: DataFrame, after: DataFrame, by: list[str], order: str, value: str, symbol: str, equivalent: DataFrame | None = None) -> DataFrame:
    """(by, order, severity, old, new) for ordered rows compared place by place.

    Partitions of different length give one ERROR at place -1 and nothing else.  Values in the table equivalent
    (a, b), either way round, give a WARNING; different values of one symbol INFO; others ERROR.
    """
    sizes = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    counts = sizes(before, "_old_n").join(sizes(after, "_new_n"), by, "full_outer").fillna(0, ["_old_n", "_new_n"])
    uneven = counts.where("_old_n != _new_n").select(*by, F.lit(-1).cast("bigint").alias(order), F.lit("ERROR").alias("severity"), F.col("_old_n").cast("string").alias("old"), F.col("_new_n").cast("string").alias("new"))
    even = counts.where("_old_n = _new_n").select(*by)
    side = lambda df, name: df.select(*by, F.col(order).cast("bigint").alias(order), F.col(value).alias(name), F.col(symbol).alias(f"{name}_symbol"))
    pairs = side(before, "old").join(side(after, "new"), [*by, order]).join(even, by, "left_semi").where(~F.col("old").eqNullSafe(F.col("new")))
    if equivalent is not None:
        known = equivalent.select(F.col("a").alias("old"), F.col("b").alias("new")).unionAll(equivalent.select(F.col("b").alias("old"), F.col("a").alias("new"))).distinct().withColumn("_same", F.lit(True))
        pairs = pairs.join(known, ["old", "new"], "left")
    else:
        pairs = pairs.withColumn("_same", F.lit(None).cast("boolean"))
    severity = F.when(F.col("_same"), "WARNING").when(F.col("old_symbol").eqNullSafe(F.col("new_symbol")), "INFO").otherwise("ERROR")
    return uneven.unionByName(pairs.select(*by, order, severity.alias("severity"), F.col("old").cast("string").alias("old"), F.col("new").cast("string").alias("new")))


#: What a handler is, apart from its place in the table.
CELLS = ["start", "end", "target", "catch_type"]


def bound_handlers(items: DataFrame, other: DataFrame, handlers: DataFrame, by: list[str], order: str, identity: str) -> DataFrame:
    """(by, handler_ordinal, start, end, target, catch_type): handlers whose labels are the number of nodes before them that `other` has too.

    So labels of both snapshots are told in one numbering, whatever was inserted or removed between them; a label that is
    not in the items is null.
    """
    shared = other.where("kind != 'label'").select(*by, identity, F.lit(1).alias("_shared"))
    marked = items.join(shared, [*by, identity], "left").withColumn("_shared", F.when(F.col("kind") == "label", 0).otherwise(F.coalesce("_shared", F.lit(0))))
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    places = marked.withColumn("_place", F.coalesce(F.sum("_shared").over(before), F.lit(0))).where("kind = 'label'")
    out = handlers
    for label, name in (("start_label", "start"), ("end_label", "end"), ("handler_label", "target")):
        out = out.join(places.select(*by, F.col("label_id").alias(label), F.col("_place").alias(name)), [*by, label], "left")
    return out.select(*by, "handler_ordinal", *CELLS)


def handler_diff(before: DataFrame, after: DataFrame, old: DataFrame, new: DataFrame, by: list[str], order: str, identity: str) -> DataFrame:
    """(by, change, old_ordinal, new_ordinal, what) of exception tables, of the same code before and after an edit.

    before, after: items (by, order, kind, label_id, identity); identity names an item in its method in both.
    old, new: handlers (by, handler_ordinal, start_label, end_label, handler_label, catch_type) with the labels of their
    own items.  Equal handlers are matched, the first with the first; a match whose rank among the matches differs is
    "moved".  What is left between the same two matches is compared place by place: "changed", with the cells that differ
    in `what`, and beyond the shorter side "removed" or "inserted".
    """
    key = F.to_json(F.struct(*CELLS), {"ignoreNullFields": "false"})
    nth = F.row_number().over(Window.partitionBy(*by, "_key").orderBy("handler_ordinal"))
    told = lambda items, other, handlers: bound_handlers(items, other, handlers, by, order, identity).withColumn("_key", key).withColumn("_nth", nth)
    a, b = told(before, after, old), told(after, before, new)
    side = lambda df, name: df.select(*by, "_key", "_nth", F.col("handler_ordinal").alias(f"{name}_ordinal"), F.struct(*CELLS).alias(f"{name}_cells"))
    both = side(a, "old").join(side(b, "new"), [*by, "_key", "_nth"], "full_outer").drop("_key", "_nth")
    matched = F.col("old_ordinal").isNotNull() & F.col("new_ordinal").isNotNull()
    rank = lambda name: F.row_number().over(Window.partitionBy(*by, "_matched").orderBy(name))
    both = both.withColumn("_matched", matched).withColumn("_moved", F.col("_matched") & (rank("old_ordinal") != rank("new_ordinal")))
    fixed = (F.col("_matched") & ~F.col("_moved")).cast("int")

    def left_over(name: str) -> DataFrame:
        """What only one side has, with the number of fixed matches before it and its place behind the last of them."""
        rows = both.where(F.col(f"{name}_ordinal").isNotNull())
        gap = F.sum(fixed).over(Window.partitionBy(*by).orderBy(f"{name}_ordinal"))
        rows = rows.withColumn("_gap", gap).where("not _matched")
        place = F.row_number().over(Window.partitionBy(*by, "_gap").orderBy(f"{name}_ordinal"))
        return rows.select(*by, "_gap", place.alias("_place"), f"{name}_ordinal", f"{name}_cells")

    pairs = left_over("old").join(left_over("new"), [*by, "_gap", "_place"], "full_outer")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"old_cells.{c}").eqNullSafe(F.col(f"new_cells.{c}")), F.lit(c)) for c in CELLS)))
    change = F.when(F.col("new_ordinal").isNull(), "removed").when(F.col("old_ordinal").isNull(), "inserted").otherwise("changed")
    edits = pairs.select(*by, change.alias("change"), "old_ordinal", "new_ordinal", F.when(change == "changed", F.array_join(differ, ",")).alias("what"))
    return both.where("_moved").select(*by, F.lit("moved").alias("change"), "old_ordinal", "new_ordinal", F.lit(None).cast("string").alias("what")).unionByName(edits)
