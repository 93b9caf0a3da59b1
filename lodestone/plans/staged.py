"""Checks that stop at a class's first error.

Stages of rules run in order.  Of each class that breaks rules in a stage one
error is kept, the first by the order of the rules, found with a minimum in the
partial aggregates; the class then leaves, so later stages read less.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.rules import gather, numbered
from lodestone.plans import contents, verify
from lodestone.sources.scratch import Scratch

#: What orders the errors of one rule in one class.
PLACE = ["member_name", "member_descriptor", "attribute_name", "cp_index", "message"]


@dataclass(frozen=True)
class Tables:
    """The tables of a corpus that are checked, all by class_id; those that are not given are not."""

    classes: DataFrame
    fields: DataFrame | None = None
    methods: DataFrame | None = None
    attributes: DataFrame | None = None
    pool: DataFrame | None = None
    items: DataFrame | None = None
    contents: DataFrame | None = None
    components: DataFrame | None = None

    def without(self, failed: DataFrame) -> Tables:
        """The tables without the classes (class_id) that failed."""
        kept = {f.name: getattr(self, f.name) for f in fields(self)}
        return replace(self, **{k: v.join(failed, "class_id", "left_anti") for k, v in kept.items() if v is not None})


#: (name, the tables it needs, its violations) in the order in which they are told.
STAGES: list[tuple[str, tuple[str, ...], Callable[[Tables], DataFrame]]] = [
    ("pool", ("pool",), lambda t: contents.all_pool_rules(t.pool, t.classes)),
    ("class", (), lambda t: verify.class_rules(t.classes)),
    ("fields", ("fields",), lambda t: verify.field_rules(t.fields, t.classes)),
    ("methods", ("methods",), lambda t: verify.method_rules(t.methods, t.classes)),
    ("attributes", ("attributes",), lambda t: verify.attribute_rules(t.attributes, t.classes)),
    ("contents", ("contents", "pool"), lambda t: contents.content_rules(t.contents, contents.with_gaps(t.pool).where("not gap"))),
    ("components", ("components",), lambda t: contents.component_rules(t.components, t.classes)),
    ("code", ("items", "methods"), lambda t: verify.code_rules(t.items, t.methods)),
]


def _told(tables: Tables, stage: tuple) -> DataFrame:
    """The violations of a stage with its rules' numbers and all places."""
    with numbered():
        found = stage[2](tables)
    if "rule" not in found.columns:
        found = found.withColumn("rule", F.lit(0))
    typed = {"class_name": "string", "member_name": "string", "member_descriptor": "string", "attribute_name": "string", "cp_index": "int"}
    return found.withColumns({c: F.lit(None).cast(k) for c, k in typed.items() if c not in found.columns})


def _ready(tables: Tables) -> list[tuple]:
    return [s for s in STAGES if all(getattr(tables, name) is not None for name in s[1])]


def every_violation(tables: Tables) -> DataFrame:
    """All violations with stage and rule, in whose order they are told."""
    told = [_told(tables, s).withColumns({"stage": F.lit(s[0]), "place": F.lit(i)}) for i, s in enumerate(_ready(tables))]
    columns = ["place", "stage", "rule", "severity", "category", "message", "class_id", "class_name", "member_name", "member_descriptor", "attribute_name", "cp_index"]
    return reduce(lambda a, b: a.unionByName(b), [t.select(*columns) for t in told])


def first_errors(tables: Tables) -> DataFrame:
    """One row for each class that breaks a rule: stage, rule, category, message and place of its first error; warnings stop nothing."""
    save = Scratch(tables.classes.sparkSession).write
    ready, out = _ready(tables), []
    for i, stage in enumerate(ready):
        errors = _told(tables, stage).where("severity = 'ERROR'")
        first = F.min(F.struct("rule", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in PLACE), "category", "message", "member_name", "member_descriptor", "attribute_name", "cp_index"))
        found = save(errors.groupBy("class_id").agg(first.alias("e")).select("class_id", F.lit(stage[0]).alias("stage"), "e.rule", "e.category", "e.message", "e.member_name", "e.member_descriptor", "e.attribute_name", "e.cp_index"))
        out.append(found)
        if i + 1 < len(ready):
            tables = tables.without(found.select("class_id"))
    return reduce(DataFrame.unionAll, out)


def report(tables: Tables, fail_fast: bool = False) -> DataFrame:
    """All violations, or with fail_fast the first error of each class, in the columns of all checks."""
    if fail_fast:
        return gather(first_errors(tables).withColumns({"severity": F.lit("ERROR"), "class_name": F.lit(None).cast("string")}), columns=verify.LOCATION)
    return gather(every_violation(tables), columns=verify.LOCATION)
