"""Grouped counts, top lists, ordered distinct samples, medians, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.scratch import Scratch


def top_groups(df: DataFrame, group: Column, condition: Column, name: str = "name", limit: int = 10) -> DataFrame:
    """(name, n, n_matching): the largest groups by n, then matching rows, then name."""
    found = df.groupBy(group.alias(name)).agg(F.count("*").alias("n"), F.count_if(condition).alias("n_matching"))
    return found.orderBy(F.desc("n"), F.desc("n_matching"), F.asc(name)).limit(limit)


def with_counts(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """parents with one measure of each child table; 0 for parents without children.  Each child is aggregated before the join."""
    out = parents
    for name, (child, measure) in children.items():
        out = out.join(child.groupBy(key).agg(measure.alias(name)), key, "left").fillna(0, [name])
    return out


def top(df: DataFrame, *order: Column, limit: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def first_distinct(df: DataFrame, key: list[str], value: str, order: str | list[str], n: int = 3, name: str = "sample") -> DataFrame:
    """(key, n_distinct, sample): the first n distinct values of each key in the order they come first."""
    at = F.struct(*[order] if isinstance(order, str) else order)
    first = df.groupBy(*key, value).agg(F.min(at).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", F.col(value).alias("v"))))
    return first.groupBy(*key).agg(F.count("*").alias("n_distinct"), ordered.alias("all")).select(*key, "n_distinct", F.transform(F.slice("all", 1, n), lambda x: x["v"]).alias(name))


def first_n(df: DataFrame, match: Column, order: str, n: int) -> DataFrame:
    """The first n matching rows."""
    return df.where(match).orderBy(order).limit(n)


def spread(df: DataFrame, key: list[str], value: str, integer: bool = False) -> DataFrame:
    """(key, median, low, high, spread); integer: an even count's median is cut to a whole number."""
    median = F.percentile(value, F.lit(0.5))
    return df.groupBy(*key).agg((F.floor(median) if integer else median).alias("median"), F.min(value).alias("low"), F.max(value).alias("high"), (F.max(value) - F.min(value)).alias("spread"))


def stage_averages(df: DataFrame, stage: str, value: str) -> DataFrame:
    return df.groupBy(stage).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def extra_copies(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Every row beyond the first of its key."""
    w = Window.partitionBy(*key).orderBy(order)
    return df.withColumn("copy", F.row_number().over(w)).where("copy > 1")


def multiplicity(df: DataFrame, key: list[str], at_least: int = 2) -> DataFrame:
    """(key, n) of the keys with several rows."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def dictionary(df: DataFrame, value: str, order: str, name: str = "code") -> DataFrame:
    """(value, code): dense codes from 0 by first appearance.

    The distinct values are dealt out by ranges of that order and numbered in each; only the sizes of the ranges come
    together.
    """
    first = df.groupBy(value).agg(F.min(order).alias("at"))
    dealt = Scratch(df.sparkSession).write(first.repartitionByRange("at", value).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))  # a row for each shuffle partition at most
    within = F.row_number().over(Window.partitionBy("_range").orderBy("at", value)) - 1
    return dealt.withColumn("_within", within).join(F.broadcast(starts), "_range").select(value, (F.col("_before") + F.col("_within")).alias(name))


def dangling(df: DataFrame, reference: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is not null and not known."""
    return df.where(F.col(reference).isNotNull()).join(known.select(F.col(key).alias(reference)), reference, "left_anti")


def unique_or_fail(df: DataFrame, key: str) -> DataFrame:
    """df itself; an error where a key comes twice."""
    twice = multiplicity(df, [key]).limit(5).collect()
    if twice:
        raise ValueError(f"duplicate {key}: {[r[0] for r in twice]}")
    return df
