"""Clean-up of code items: nops, jumps to what follows anyway, chains of jumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.cfg import GOTO
from lodestone.operators.sequences import islands, remove
from lodestone.sources.scratch import Scratch


def remove_nops(items: DataFrame, by: list[str], order: str = "ordinal") -> DataFrame:
    return remove(items, (F.col("kind") == "raw") & (F.col("opcode") == 0), by, order)


def idle_gotos(items: DataFrame, by: list[str], order: str = "ordinal") -> DataFrame:
    """(by, order) of the gotos whose target is among the labels right after them."""
    # A run of labels belongs to the last item before it.
    runs = items.withColumn("_run", islands(F.col("kind") != "label", by, order))
    labels = runs.where("kind = 'label'").select(*by, "_run", F.col("label_id").alias("target_label"))
    gotos = runs.where((F.col("kind") == "branch") & (F.col("opcode") == GOTO))
    return gotos.join(labels, [*by, "_run", "target_label"], "left_semi").select(*by, order)


def chase(pointers: DataFrame, key: list[str], at: str, to: str) -> DataFrame:
    """(key, at, end): where following pointers from at ends; null where it runs in a circle.

    Every round doubles the reach, and no chain is longer than its key has pointers, so what still moves then runs in
    a circle.
    """
    save = Scratch(pointers.sparkSession).write
    hop = save(pointers.select(*key, F.col(at).alias("_at"), F.col(to).alias("_end"), F.lit(True).alias("_moved")))
    longest, reach = hop.groupBy(*key).count().agg(F.max("count")).first()[0] or 0, 1
    while reach <= 2 * longest:
        further = hop.select(*key, F.col("_at").alias("_end"), F.col("_end").alias("_next"))
        hop = hop.select(*key, "_at", "_end").join(further, [*key, "_end"], "left")
        hop = save(hop.select(*key, "_at", F.coalesce("_next", "_end").alias("_end"), F.col("_next").isNotNull().alias("_moved")))
        reach *= 2
        if hop.where("_moved").isEmpty():
            break
    return hop.select(*key, F.col("_at").alias(at), F.when(~F.col("_moved"), F.col("_end")).alias("end"))


def goto_pointers(items: DataFrame, by: list[str], order: str = "ordinal") -> DataFrame:
    """(by, label, to): labels whose next item that is no label is a goto, and where that goes."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    here: Column = F.struct("kind", "opcode", "target_label")
    following = items.withColumn("_next", F.first(F.when(F.col("kind") != "label", here), ignorenulls=True).over(w))
    hit = (F.col("_next.kind") == "branch") & (F.col("_next.opcode") == GOTO)
    return following.where(F.col("kind") == "label").where(hit).select(*by, F.col("label_id").alias("label"), F.col("_next.target_label").alias("to"))


def collapse_gotos(items: DataFrame, by: list[str], order: str = "ordinal") -> DataFrame:
    """Gotos that lead to gotos go to the end of the chain; circles stay as they are."""
    ends = chase(goto_pointers(items, by, order), by, "label", "to").where("end is not null")
    ends = ends.select(*by, F.col("label").alias("target_label"), F.col("end").alias("_to"), F.lit("branch").alias("kind"), F.lit(GOTO).alias("opcode"))
    joined = items.join(ends, [*by, "target_label", "kind", "opcode"], "left")
    return joined.withColumn("target_label", F.coalesce("_to", "target_label")).select(*items.columns)


def clean(items: DataFrame, by: list[str], order: str = "ordinal") -> DataFrame:
    """Nops once, then chains and idle gotos until nothing changes: every round but the last takes some away."""
    save = Scratch(items.sparkSession).write
    items = remove_nops(items, by, order)
    while True:
        items = save(collapse_gotos(items, by, order))
        idle = idle_gotos(items, by, order)
        if idle.isEmpty():
            return items
        marked = items.join(idle.withColumn("_idle", F.lit(True)), [*by, order], "left")
        items = remove(marked, F.coalesce("_idle", F.lit(False)), by, order).select(*items.columns)


def remove_nops_of_straight_code(items: DataFrame, by: list[str], order: str = "ordinal") -> DataFrame:
    """Nops go from methods without labels, branches and switches only."""
    moving = items.where(F.col("kind").isin("label", "branch", "lookup_switch", "table_switch")).select(*by).distinct()
    straight = items.join(moving, by, "left_anti")
    return remove_nops(straight, by, order).unionByName(items.join(moving, by, "left_semi"))
