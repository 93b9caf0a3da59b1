"""Pattern search and point edits over ordered rows.

Rows of one partition (a method, a user, ...) are ordered by a position column.
A pattern is a list of boolean columns, one for each successive row.  Searches
overlap; edits take matches greedily from the left, without overlap, as they
were before the edit.  Positions are renumbered from 0 by every edit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keyed(by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def starts(pattern: list[Column], by: list[str], order: str) -> Column:
    """Whether the pattern begins at this row; an empty pattern never does."""
    if not pattern:
        return F.lit(False)
    w = _keyed(by, order)
    return reduce(lambda a, b: a & b, (F.coalesce(F.lead(p, i).over(w) if i else p, F.lit(False)) for i, p in enumerate(pattern)))


def find_all(df: DataFrame, pattern: list[Column], by: list[str], order: str) -> DataFrame:
    """(by, order) of every row where the pattern begins."""
    return df.withColumn("_hit", starts(pattern, by, order)).where("_hit").select(*by, order)


def find_first(df: DataFrame, match: Column, by: list[str], order: str, at_least: int | None = None) -> DataFrame:
    """(by, order) of the first matching row at or after a position; partitions without one give no row."""
    wanted = match if at_least is None else match & (F.col(order) >= at_least)
    return df.where(wanted).groupBy(*by).agg(F.min(order).alias(order))


def count_matches(df: DataFrame, match: Column, by: list[str]) -> DataFrame:
    """(by, n_matches, has_match) for every partition."""
    return df.groupBy(*by).agg(F.count_if(match).alias("n_matches"), F.coalesce(F.bool_or(match), F.lit(False)).alias("has_match"))


def greedy(positions: Column, length: int) -> Column:
    """Of a sorted array of starts those that a scan from the left takes without overlap."""
    first = F.struct(F.array().cast("array<bigint>").alias("taken"), F.lit(None).cast("bigint").alias("free"))

    def step(state: Column, start: Column) -> Column:
        fits = state["free"].isNull() | (start >= state["free"])
        return F.struct(F.when(fits, F.array_append(state["taken"], start)).otherwise(state["taken"]).alias("taken"), F.when(fits, start + length).otherwise(state["free"]).alias("free"))

    return F.aggregate(positions, first, step, lambda state: state["taken"])


def find_greedy(df: DataFrame, pattern: list[Column], by: list[str], order: str) -> DataFrame:
    """(by, order) of the non-overlapping matches.  order must count rows from any number on without gaps.

    A start as far from the one before as the pattern is long is taken in any case, so each run of nearer starts is
    scanned by itself.  In a run without gaps every n-th is taken; only the others are put in an array.
    """
    n = len(pattern)
    w = _keyed(by, order)
    hits = find_all(df, pattern, by, order).withColumn(order, F.col(order).cast("bigint"))
    if n < 2:
        return hits
    gap = F.col(order) - F.lag(order).over(w)
    runs = hits.withColumn("_gap", gap).withColumn("_run", islands(F.col("_gap").isNull() | (F.col("_gap") >= n), by, order))
    spans = runs.groupBy(*by, "_run").agg(F.min(order).alias("_first"), F.max(order).alias("_last"), F.count("*").alias("_n"))
    dense = F.col("_last") - F.col("_first") + 1 == F.col("_n")
    every = spans.where(dense).select(*by, F.explode(F.sequence("_first", "_last", F.lit(n).cast("bigint"))).alias(order))
    loose = runs.join(spans.where(~dense).select(*by, "_run"), [*by, "_run"], "left_semi")
    loose = loose.groupBy(*by, "_run").agg(F.sort_array(F.collect_list(order)).alias("_all"))
    return every.unionByName(loose.select(*by, F.explode(greedy(F.col("_all"), n)).alias(order)))


def renumber(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 in the given order, as column name; helper columns (beginning with _) go."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))
    return out.drop(*[c for c in out.columns if c.startswith("_") and c != name])


def remove(df: DataFrame, match: Column, by: list[str], order: str) -> DataFrame:
    return renumber(df.where(~F.coalesce(match, F.lit(False))), by, [order], order)


def splice(df: DataFrame, match: Column, items: list[dict], by: list[str], order: str, place: str) -> DataFrame:
    """items (column values) put before, after or in place of every matching row; other columns of an item are null."""
    if place not in ("before", "after", "replace"):
        raise ValueError(place)
    if not items:
        return remove(df, match, by, order) if place == "replace" else renumber(df, by, [order], order)
    kinds = {f.name: f.dataType for f in df.schema}
    values = [c for c in df.columns if c not in (*by, order)]
    own = F.struct(F.lit(0).alias("_side"), F.lit(0).alias("_nth"), *(F.col(c) for c in values))
    side = {"before": -1, "after": 1, "replace": 0}[place]
    new = [F.struct(F.lit(side).alias("_side"), F.lit(i).alias("_nth"), *(F.lit(item.get(c)).cast(kinds[c]).alias(c) for c in values)) for i, item in enumerate(items)]
    rows = F.when(F.coalesce(match, F.lit(False)), F.array(*new) if place == "replace" else F.array(own, *new)).otherwise(F.array(own))
    out = df.select(*by, F.col(order).alias("_at"), F.explode(rows).alias("_row")).select(*by, "_at", "_row.*")
    return renumber(out, by, ["_at", "_side", "_nth"], order).select(*df.columns)


def replace_sequences(df: DataFrame, pattern: list[Column], items: list[dict], by: list[str], order: str) -> DataFrame:
    """Every greedy match of the pattern replaced by items; none: removed."""
    n = len(pattern)
    w = _keyed(by, order)
    taken = find_greedy(df, pattern, by, order).withColumn("_start", F.lit(True))
    marked = df.join(taken, [*by, order], "left")
    covered = F.coalesce(F.max(F.col("_start").cast("int")).over(w.rowsBetween(-(n - 1), 0)), F.lit(0)) == 1
    marked = marked.withColumn("_covered", covered).where(~F.col("_covered") | F.coalesce("_start", F.lit(False)))
    marked = marked.withColumn("_hit", F.coalesce("_start", F.lit(False))).drop("_start", "_covered")
    kept = [c for c in marked.columns if c != "_hit"]
    return splice(marked.withColumnRenamed("_hit", "hit__"), F.col("hit__"), items, by, order, "replace").select(*kept) if items else remove(marked, F.col("_hit"), by, order).select(*kept)


def next_row(value: Column, by: list[str], order: str, n: int = 1) -> Column:
    return F.lead(value, n).over(_keyed(by, order))


def next_known(value: Column, by: list[str], order: str) -> Column:
    """The first value that is not null in this row or after it."""
    return F.first(value, ignorenulls=True).over(_keyed(by, order).rowsBetween(0, Window.unboundedFollowing))


def running_sum(value: Column, by: list[str], order: str, inclusive: bool = False) -> Column:
    """The sum of the rows before this one (and this one)."""
    frame = _keyed(by, order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return F.coalesce(F.sum(value).over(frame), F.lit(0))


def islands(begins: Column, by: list[str], order: str) -> Column:
    """A number for each run of rows, from 1, new where begins is true."""
    return F.sum(F.coalesce(begins, F.lit(False)).cast("int")).over(_keyed(by, order).rowsBetween(Window.unboundedPreceding, 0))
