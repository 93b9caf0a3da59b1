"""Dictionaries with versions: append-only codes, lookups as of an epoch, rollback to a checkpoint, limits.

A dictionary (one for each value of `by`) takes requests in the order of epoch and
place.  A value that it does not hold gets the next code, and takes one slot or
two.  A rollback at the beginning of an epoch cuts off what has come after the end
of an earlier one, so later values get those codes again; it brings nothing back.

Entries of epoch x are seen until the first rollback after x that goes back beyond
x.  These spans are nested or apart, like the states of a stack, so a request adds
an entry just if every earlier request of that value is out of sight by then, and
the slots in use are a running sum of what comes and what goes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ranged import running_sums
from lodestone.sources.scratch import Scratch

#: Later than every epoch.
NEVER = (1 << 63) - 1


# Fixed values of the class-file format: indexes begin at 1, the last is 65534, and texts have 65,535 bytes at most.
@dataclass(frozen=True)
class Limits:
    first: int = 1
    last: int | None = 65534
    size: int | None = 65535


#: For dictionaries of other tables, which may hold any number of values.
UNLIMITED = Limits(last=None, size=None)


def spans(epochs: DataFrame, rollbacks: DataFrame, by: list[str]) -> DataFrame:
    """(by, epoch, until) of each epoch (by, epoch): when its entries go, by rollbacks (by, epoch, target); NEVER if they stay."""
    moves = rollbacks.select(*by, F.col("epoch").alias("_at"), F.col("target").alias("_target"))
    gone = epochs.join(moves, by).where("_at > epoch and _target < epoch").groupBy(*by, "epoch").agg(F.min("_at").alias("until"))
    return epochs.join(gone, [*by, "epoch"], "left").withColumn("until", F.coalesce("until", F.lit(NEVER)))


def entries(requests: DataFrame, by: list[str], value: str, at: str, rollbacks: DataFrame | None = None, width: Column | None = None, size: Column | None = None, limits: Limits = Limits()) -> DataFrame:
    """Every entry that the requests (by, epoch, at, value) add: (by, value, epoch, at, until, width, code, error).

    width: slots of a value, 1 or 2; size: its bytes.  Both depend on the value alone.  A value over Limits.size is
    never held: its request has no code and the error "size".  One that does not fit before Limits.last has the error
    "full"; if it is a value of two slots with one left, the next value of one slot still gets that.  None limits nothing.
    Requests without a value add nothing.  `rollbacks`: (by, epoch, target), at most one at an epoch.
    """
    save = Scratch(requests.sparkSession).write
    one = F.lit(1).cast("long")
    told = requests.where(F.col(value).isNotNull()).withColumns({"_width": one if width is None else width.cast("long"), "_size": F.lit(0).cast("long") if size is None else size.cast("long")})
    first = told.groupBy(*by, value, "epoch").agg(F.min(at).alias("at"), F.first("_width").alias("width"), F.first("_size").alias("_size"))
    if rollbacks is None:
        first = first.groupBy(*by, value).agg(F.min(F.struct("epoch", "at")).alias("_e"), F.first("width").alias("width"), F.first("_size").alias("_size"))
        first = first.select(*by, value, "_e.epoch", "_e.at", "width", "_size", F.lit(NEVER).alias("until"))
    else:
        first = first.join(spans(first.select(*by, "epoch").distinct(), rollbacks, by), [*by, "epoch"])
        earlier = Window.partitionBy(*by, value).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
        first = first.withColumn("_seen", F.max("until").over(earlier)).where(F.col("_seen").isNull() | (F.col("_seen") <= F.col("epoch"))).drop("_seen")
    first = save(first)
    fits = F.lit(True) if limits.size is None else F.col("_size") <= limits.size
    start = F.lit(limits.first) + F.col("_used")
    placed = _in_use(first.where(fits).drop("_size"), by, value, {"_used": F.col("width")}).withColumn("_start", start)
    over = F.lit(False) if limits.last is None else F.col("_start") + F.col("width") - 1 > limits.last
    plain = placed.where(~over).select(*by, value, "epoch", "at", "until", "width", F.col("_start").alias("code"), F.lit(None).cast("string").alias("error"))
    large = first.where(~fits).select(*by, value, "epoch", "at", "until", "width", F.lit(None).cast("long").alias("code"), F.lit("size").alias("error"))
    if limits.last is None:
        return plain.unionAll(large)
    edge = (F.col("_start") == limits.last) & (F.col("width") == 2)
    late = _in_use(save(placed.where(over)), by, value, {"_edges": F.when(edge, one), "_narrow": F.when(F.col("width") == 1, one)})
    last = (F.col("width") == 1) & (F.col("_edges") > 0) & (F.col("_narrow") == 0)
    late = late.select(*by, value, "epoch", "at", "until", "width", F.when(last, F.lit(limits.last).cast("long")).alias("code"), F.when(~last, F.lit("full")).alias("error"))
    return plain.unionAll(late).unionAll(large)


def _in_use(rows: DataFrame, by: list[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """rows with, for each of `sums`, its total over the rows before that are still in sight."""
    rows = rows.withColumns({f"{name}_own": F.coalesce(amount, F.lit(0)) for name, amount in sums.items()})
    come = rows.select(*by, F.col("epoch").alias("_time"), F.lit(1).alias("_kind"), "at", value, *(c for c in rows.columns if c not in {*by, "at", value}))
    ends = rows.where(F.col("until") < NEVER).groupBy(*by, "until").agg(*(-F.sum(f"{name}_own").alias(f"{name}_own") for name in sums))
    ends = ends.toDF(*by, "_time", *(f"{name}_own" for name in sums)).withColumn("_kind", F.lit(0))  # a rollback comes before the requests of its epoch
    events = come.unionByName(ends, allowMissingColumns=True)
    summed = running_sums(events, by, ["_time", "_kind", "at", value], {name: F.col(f"{name}_own") for name in sums})
    return summed.where("_kind = 1").drop("_time", "_kind", *(f"{name}_own" for name in sums))


def find(keys: DataFrame, held: DataFrame, by: list[str], value: str) -> DataFrame:
    """keys (by, value, as_of, ...) with the code that the dictionary holds for the value at the end of epoch as_of, null if none."""
    known = held.where("code is not null").select(*(F.col(c).alias(f"_{c}") for c in [*by, value, "epoch", "until"]), "code")
    same = [F.col(c) == F.col(f"_{c}") for c in [*by, value]]
    return keys.join(known, [*same, F.col("_epoch") <= F.col("as_of"), F.col("as_of") < F.col("_until")], "left").select(*(F.col(c) for c in keys.columns), "code")


def checkpoints(epochs: DataFrame, held: DataFrame, by: list[str], limits: Limits = Limits()) -> DataFrame:
    """epochs (by, epoch) with next_code: where the dictionary goes on after that epoch, which is what a rollback to it restores."""
    known = held.where("code is not null")
    changes = known.select(*by, F.col("epoch").alias("_time"), F.col("width").alias("_own")).unionAll(known.where(F.col("until") < NEVER).select(*by, F.col("until"), -F.col("width")))
    changes = changes.groupBy(*by, "_time").agg(F.sum("_own").alias("_own"))
    marks = epochs.select(*by, "epoch").distinct().select(*by, F.col("epoch").alias("_time"), F.lit(True).alias("_asked"))
    events = changes.join(marks, [*by, "_time"], "full").withColumn("_own", F.coalesce("_own", F.lit(0)))
    summed = running_sums(events, by, ["_time"], {"_before": F.col("_own")}).where("_asked")
    return summed.select(*by, F.col("_time").alias("epoch"), (F.lit(limits.first) + F.col("_before") + F.col("_own")).alias("next_code"))
