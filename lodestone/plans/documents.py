"""Reports in one piece: one JSON document for each key, with lists in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(columns: list[str], order: list[tuple[str, bool]]) -> Column:
    """An aggregate: the rows of a group as an array of structs of `columns`, by `order` (column, descending)."""
    keys = [c for c, _ in order]
    both = F.collect_list(F.struct(F.struct(*keys).alias("_k"), F.struct(*columns).alias("v")))

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for name, down in reversed(order):
            x, y = a["_k"][name], b["_k"][name]
            out = F.when(x < y, 1 if down else -1).when(x > y, -1 if down else 1).otherwise(out)
        return out

    return F.transform(F.array_sort(both, compare), lambda x: x["v"])


def top_with_ties(df: DataFrame, by: list[str], order: list[tuple[str, bool]], limit: int) -> DataFrame:
    """The first `limit` rows of each group by order, and those that are equal to the last of them."""
    w = Window.partitionBy(*by).orderBy(*(F.desc(c) if down else F.asc(c) for c, down in order))
    return df.withColumn("_rank", F.rank().over(w)).where(F.col("_rank") <= limit).drop("_rank")


def assembled(key: str, head: DataFrame, **parts: DataFrame) -> DataFrame:
    """(key, report): the columns of head, then each part (key, one column), as one JSON document; a part that a key lacks is an empty list."""
    out = head
    for name, part in parts.items():
        (value,) = (c for c in part.columns if c != key)
        kind = part.schema[value].dataType
        out = out.join(part.select(key, F.col(value).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out.select(key, F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"}).alias("report"))


def write(reports: DataFrame, path: str, key: str) -> None:
    """Each report as a line of JSON in the folder of its key."""
    reports.select(F.col("report").alias("value"), key).write.partitionBy(key).mode("overwrite").text(path)
