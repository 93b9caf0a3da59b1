"""Forests of parents by binary lifting: ends, depths, circles, chains and common ancestors without a closure.

Pointer doubling: after k rounds every node knows its ancestor 2^k steps up, or
the end of its chain and how far that is.  A round joins the nodes that are still
under way with all nodes, so a chain of n nodes takes log2(n) rounds of n rows.
A node that is under way after more steps than there are nodes runs into a circle;
the nodes that such walks stand on are the circle itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import Scratch


@dataclass(frozen=True)
class Lifting:
    #: levels[k]: (node, up), the ancestor 2^k steps up of the nodes that have one.
    levels: list[DataFrame]
    #: (node, top, depth) of the nodes whose chain ends, depth steps up at top.
    tops: DataFrame
    #: (node, at, low) of the nodes whose chain ends nowhere: at is in a circle, low the smallest node of that.
    endless: DataFrame

    def circles(self) -> DataFrame:
        """(node, circle) of the nodes that their own chain reaches again; a circle is named by its smallest node."""
        inside = self.endless.select(F.col("at").alias("node")).distinct()
        return self.endless.join(inside, "node", "left_semi").select("node", F.col("low").alias("circle"))


def lift(parents: DataFrame, node: str = "child", parent: str = "parent") -> Lifting:
    """The lifting tables of (node, parent); of several parents of one node the smallest counts, null parents are none."""
    save = Scratch(parents.sparkSession).write
    near = parents.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("at")).where("at is not null")
    last = save(near.select("node", "at", F.lit(1).cast("long").alias("steps"), F.col("at").alias("low")))
    nodes, reach = last.count(), 1
    levels, ended = [last.select("node", F.col("at").alias("up"))], []
    while nodes:
        # A row of `last` is under way with `reach` steps, or it ended before; what ended earlier is in `ended`.
        going = last.where(F.col("steps") == reach)
        known = reduce(DataFrame.unionAll, [*ended, last]).select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("low").alias("_low"))
        further = going.join(known, "at", "left").select("node", F.coalesce("_at", "at").alias("at"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.least("low", "_low").alias("low"))
        ended.append(last.where(F.col("steps") < reach))
        last, reach = save(further), 2 * reach
        level = last.where(F.col("steps") == reach).select("node", F.col("at").alias("up"))
        if level.isEmpty():
            ended.append(last)
            return Lifting(levels, _tops(ended), last.limit(0).select("node", "at", "low"))
        if reach > nodes:
            ended.append(last.where(F.col("steps") < reach))
            return Lifting(levels, _tops(ended), last.where(F.col("steps") == reach).select("node", "at", "low"))
        levels.append(level)
    return Lifting(levels, _tops([last]), last.select("node", "at", "low"))


def _tops(ended: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, ended).select("node", F.col("at").alias("top"), F.col("steps").alias("depth"))


def chains(lifting: Lifting, nodes: DataFrame | None = None) -> DataFrame:
    """(node, depth, ancestor) of the nodes (all, or those of (node)) whose chain ends, nearest ancestor at depth 1.

    Every row is made once: a depth is the sum of the powers of two in it, taken in their order.
    """
    starts = lifting.tops.select("node")
    if nodes is not None:
        starts = starts.join(nodes.select("node"), "node", "left_semi")
    save = Scratch(starts.sparkSession).write
    rows = [save(starts.select("node", F.lit(0).cast("long").alias("depth"), F.col("node").alias("ancestor")))]
    for k, level in enumerate(lifting.levels):
        so_far = reduce(DataFrame.unionAll, rows)
        rows.append(save(so_far.join(level.select(F.col("node").alias("ancestor"), "up"), "ancestor").select("node", (F.col("depth") + (1 << k)).alias("depth"), F.col("up").alias("ancestor"))))
    return reduce(DataFrame.unionAll, rows[1:])


def common_ancestors(pairs: DataFrame, lifting: Lifting) -> DataFrame:
    """(a, b, common) of each distinct pair: the first of a's chain, a included, that is in b's; null if there is none.

    The deeper of the two is lifted to the depth of the other, then both are lifted as long as they differ.
    Pairs with a node whose chain ends nowhere have none, unless both are the same.
    """
    save = Scratch(pairs.sparkSession).write
    depth = lambda name: lifting.tops.select(F.col("node").alias(name), F.col("depth").alias(f"{name}_depth"))
    lost = lambda name: lifting.endless.select(F.col("node").alias(name))
    rows = pairs.select("a", "b").distinct()
    able = rows.join(lost("a"), "a", "left_anti").join(lost("b"), "b", "left_anti").join(depth("a"), "a", "left").join(depth("b"), "b", "left")
    gap = F.coalesce("a_depth", F.lit(0)) - F.coalesce("b_depth", F.lit(0))
    able = save(able.select("a", "b", F.col("a").alias("u"), F.col("b").alias("v"), gap.alias("gap")))
    for k in reversed(range(len(lifting.levels))):
        step = 1 << k
        level, far = lifting.levels[k], F.abs("gap") >= step
        left = F.col("gap") > 0
        moved = able.where(far).withColumn("node", F.when(left, F.col("u")).otherwise(F.col("v"))).join(level, "node")
        moved = moved.select("a", "b", F.when(left, F.col("up")).otherwise(F.col("u")).alias("u"), F.when(left, F.col("v")).otherwise(F.col("up")).alias("v"), (F.col("gap") - F.signum("gap").cast("long") * step).alias("gap"))
        able = save(able.where(~far).unionAll(moved))
    met = [able.where("u = v").select("a", "b", F.col("u").alias("common"))]
    apart = able.where("u <> v").select("a", "b", "u", "v")
    for k in reversed(range(len(lifting.levels))):
        up = lambda name, k=k: lifting.levels[k].select(F.col("node").alias(name), F.col("up").alias(f"{name}_up"))
        both = apart.join(up("u"), "u", "left").join(up("v"), "v", "left")
        differ = F.coalesce(F.col("u_up") != F.col("v_up"), F.lit(False))  # both are equally deep: if one is at its end, so is the other
        apart = save(both.select("a", "b", F.when(differ, F.col("u_up")).otherwise(F.col("u")).alias("u"), F.when(differ, F.col("v_up")).otherwise(F.col("v")).alias("v")))
    above = lambda name: lifting.levels[0].select(F.col("node").alias(name), F.col("up").alias(f"{name}_up"))
    met.append(apart.join(above("u"), "u").join(above("v"), "v").where("u_up = v_up").select("a", "b", F.col("u_up").alias("common")))
    found = reduce(DataFrame.unionAll, met).unionAll(rows.join(lost("a"), "a", "left_semi").where("a = b").select("a", "b", F.col("a").alias("common")))
    return rows.join(found, ["a", "b"], "left")


def chain_errors(lifting: Lifting, known: Column | None = None) -> DataFrame:
    """(node, error, at) of the chains that are errors: into a circle (at: its smallest node), or to a top that `known` (of top) denies."""
    endless = lifting.endless.select("node", F.lit("cycle").alias("error"), F.col("low").alias("at"))
    if known is None:
        return endless
    return endless.unionAll(lifting.tops.where(~known).select("node", F.lit("unresolved").alias("error"), F.col("top").alias("at")))
