"""A rule engine: each rule is a filter that gives violation rows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("INFO", "WARNING", "ERROR")


@dataclass(frozen=True)
class Rule:
    """A row of the table breaks the rule where `broken` is true."""

    category: str
    message: Column | str
    broken: Column
    severity: str = "ERROR"


#: Where rules get numbers while numbered() holds.
_NUMBERS: ContextVar[Iterator[int] | None] = ContextVar("numbers", default=None)


@contextmanager
def numbered():
    """Inside, violations() has a column `rule`: the number of the rule, from 0 in the order in which rules are given."""
    token = _NUMBERS.set(count())
    try:
        yield
    finally:
        _NUMBERS.reset(token)


def violations(df: DataFrame, rules: list[Rule], location: dict[str, Column | str]) -> DataFrame:
    """(severity, category, message, location...) for every row and rule broken; df is read once."""
    as_column = lambda x: x if isinstance(x, Column) else F.col(x)
    numbers = _NUMBERS.get()
    number = lambda: [] if numbers is None else [F.lit(next(numbers)).alias("rule")]
    told = [
        F.when(F.coalesce(r.broken, F.lit(False)), F.struct(*number(), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"), (r.message if isinstance(r.message, Column) else F.lit(r.message)).alias("message")))
        for r in rules
    ]
    where = [as_column(v).alias(k) for k, v in location.items()]
    return df.select(*where, F.explode(F.array_compact(F.array(*told))).alias("v")).select("v.*", *location)


def gather(*found: DataFrame, columns: list[str]) -> DataFrame:
    """One table of all violations; location columns that a rule group lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found).select("severity", "category", "message", *columns)
