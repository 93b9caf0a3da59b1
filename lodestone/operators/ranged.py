"""Running sums over groups of any size: rows are dealt out by ranges, and only the totals of the ranges meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.scratch import Scratch


def running_sums(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with a column for each of `sums`: its total over the rows of the same group that come before by `order`, 0 for the first.

    A group may be larger than a task: it is cut into ranges, each summed by itself.  Of rows equal in group and order,
    any comes first; give an order without ties.
    """
    save = Scratch(df.sparkSession).write
    dealt = save(df.repartitionByRange(*by, *order).withColumns({"_range": F.spark_partition_id(), **{f"_{name}": F.coalesce(value.cast("long"), F.lit(0)) for name, value in sums.items()}}))
    before = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumns({name: F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)) for name in sums})
    totals = dealt.groupBy("_range", *by).agg(*(F.sum(f"_{name}").alias(f"_{name}") for name in sums))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *by, F.row_number().over(Window.partitionBy(*by).orderBy("_range")).alias("_nth"), *(F.sum(f"_{name}").over(earlier).alias(f"+{name}") for name in sums))
    starts = starts.where("_nth > 1").drop("_nth")  # groups that go on from one range to the next: one a range at most
    keys = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in ["_range", *by]]
    joined = within.alias("l").join(F.broadcast(starts.alias("r")), keys, "left")
    return joined.select(*(F.col(f"l.`{c}`") for c in df.columns), *((F.col(f"l.`{name}`") + F.coalesce(F.col(f"r.`+{name}`"), F.lit(0))).alias(name) for name in sums))
