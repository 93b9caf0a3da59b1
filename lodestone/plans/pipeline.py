"""Pipelines: ordered edits of a class catalog, each behind a matcher."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.matchers import Matcher, anything
from lodestone.operators.transforms import Edit, gate_by_member, within


@dataclass(frozen=True)
class Catalog:
    """The tables of a corpus, keyed by class_id (code items by class_id and method_ordinal)."""

    classes: DataFrame
    fields: DataFrame
    methods: DataFrame
    code_items: DataFrame


@dataclass
class Pipeline:
    """Steps run in the order they are added; every step sees what those before made."""

    steps: list[tuple[str, Callable[[Catalog], Catalog]]] = field(default_factory=list)

    def _add(self, text: str, step: Callable[[Catalog], Catalog]) -> Pipeline:
        self.steps.append((text, step))
        return self

    def on_classes(self, match: Matcher, edit: Edit) -> Pipeline:
        def step(c: Catalog) -> Catalog:
            chosen = c.classes.withColumn("_in", match.column)
            edited = edit(chosen.where("_in").drop("_in"))
            return replace(c, classes=edited.unionByName(chosen.where("not _in").drop("_in")))

        return self._add(f"classes {match}", step)

    def _on_members(self, table: str, match: Matcher, edit: Edit, owner: Matcher | None) -> Pipeline:
        def step(c: Catalog) -> Catalog:
            gated = gate_by_member(c.classes, getattr(c, table), match, "class_id")
            gated = gated.withColumn("_gate", F.col("_gate") & (owner or anything()).column)
            edited = edit(gated.where("_gate").drop("_gate"))
            return replace(c, classes=edited.unionByName(gated.where("not _gate").drop("_gate")))

        return self._add(f"{table} {match} of {owner or anything()}", step)

    def on_fields(self, match: Matcher, edit: Edit, owner: Matcher | None = None) -> Pipeline:
        """A class edit, once for each class of which any field matches."""
        return self._on_members("fields", match, edit, owner)

    def on_methods(self, match: Matcher, edit: Edit, owner: Matcher | None = None) -> Pipeline:
        """A class edit, once for each class of which any method matches."""
        return self._on_members("methods", match, edit, owner)

    def on_each(self, table: str, match: Matcher, edit: Edit, owner: Matcher | None = None) -> Pipeline:
        """A member edit for every matching field or method of the owners."""
        return self._add(f"each of {table} {match}", lambda c: replace(c, **{table: within(c.classes, owner or anything(), "class_id", edit, match)(getattr(c, table))}))

    def on_code(self, match: Matcher, edit: Edit, owner: Matcher | None = None) -> Pipeline:
        """A code edit for the items of matching methods of the owners."""

        def step(c: Catalog) -> Catalog:
            owners = c.classes.where((owner or anything()).column).select("class_id")
            keys = c.methods.where(match.column).join(owners, "class_id", "left_semi").select("class_id", F.col("ordinal").alias("method_ordinal"))
            keys = keys.distinct().withColumn("_in", F.lit(True))
            items = c.code_items.join(keys, ["class_id", "method_ordinal"], "left")
            edited = edit(items.where("_in").drop("_in")).select(*c.code_items.columns)
            return replace(c, code_items=edited.unionByName(items.where("_in is null").select(*c.code_items.columns)))

        return self._add(f"code of {match}", step)

    def custom(self, step: Callable[[Catalog], Catalog], text: str = "custom") -> Pipeline:
        """Any function of the catalog; it has to return one."""

        def checked(c: Catalog) -> Catalog:
            out = step(c)
            if not isinstance(out, Catalog):
                raise TypeError(f"{text} returned {type(out).__name__}, not a Catalog")
            return out

        return self._add(text, checked)

    def apply(self, catalog: Catalog) -> Catalog:
        for _, step in self.steps:
            catalog = step(catalog)
        return catalog

    def __len__(self) -> int:
        return len(self.steps)

    def __repr__(self) -> str:
        return "\n".join(text for text, _ in self.steps)
