"""Connected components of a links table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """links: (a, b).  (node, root) for every node in a link; nodes share a root when links join them.

    Each round points every node at its smallest neighbour, follows the
    pointers three times, and keeps only the links between different ends.
    Every node with a smaller neighbour goes, so rounds grow with the logarithm
    of the nodes.  All rounds are written tables; nothing meets on the driver.
    """
    work = scratch.write(links.where(F.col("a") != F.col("b")).distinct())
    roots = None
    while not work.isEmpty():
        both = work.unionAll(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        step = scratch.write(step)
        for _ in range(2):
            further = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            step = step.join(further, "root").select("node", F.col("next").alias("root"))
        step = scratch.write(step)
        to = lambda name: step.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
        work = scratch.write(work.join(to("a"), "a").join(to("b"), "b").where(F.col("a_root") != F.col("b_root")).select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct())
        if roots is None:
            roots = step
        else:
            moved = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = scratch.write(roots.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
    if roots is None:
        return work.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
