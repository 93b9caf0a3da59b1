"""Patch plans: rules from a JSON file, applied in order, with counters for each rule.

A rule has a kind (class, field, method), a matcher, for members an owner
matcher, and an action; a method rule may have code actions too.  Patterns
search anywhere, as rule files expect.  The report has for each rule the classes
and targets matched and changed; what a code action matches counts as changed,
sequences without overlap.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lodestone.functions import flags as bits
from lodestone.operators import matchers, sequences
from lodestone.plans.pipeline import Catalog
from lodestone.sources.scratch import Scratch

TABLES = {"class": "classes", "field": "fields", "method": "methods"}
RULE_KEYS = {"kind", "name", "matcher", "owner", "action", "code_actions"}
#: Code actions and their keys.
CODE_ACTIONS = {
    "remove-insn": {"matcher"},
    "replace-insn": {"matcher", "replacement"},
    "insert-before": {"matcher", "items"},
    "insert-after": {"matcher", "items"},
    "remove-sequence": {"pattern"},
    "replace-sequence": {"pattern", "replacement"},
    "redirect-method-call": {"from", "to"},
    "redirect-field-access": {"from", "to"},
    "replace-string": {"from", "to"},
    "sequence": {"actions"},
}
BY, ORDER = ["class_id", "method_ordinal"], "item_ordinal"


def load(text: str) -> list[dict]:
    """The rules of a plan; unknown keys and kinds are errors, unnamed rules are called rule-N."""
    plan = json.loads(text)
    if unknown := set(plan) - {"options", "rules"}:
        raise ValueError(f"unknown keys in a plan: {sorted(unknown)}")
    rules = []
    for i, rule in enumerate(plan.get("rules", []), 1):
        if unknown := set(rule) - RULE_KEYS:
            raise ValueError(f"unknown keys in rule {i}: {sorted(unknown)}")
        if rule.get("kind") not in TABLES:
            raise ValueError(f"unknown kind of rule {i}: {rule.get('kind')!r}")
        actions = rule.get("code_actions", [])
        if actions and rule["kind"] != "method":
            raise ValueError(f"rule {i} of kind {rule['kind']} has code actions")
        if not actions and "action" not in rule:
            raise ValueError(f"rule {i} has no action")
        for action in flat(actions):
            known = CODE_ACTIONS.get(action.get("type"))
            if known is None or set(action) - known - {"type"}:
                raise ValueError(f"unknown code action or keys in rule {i}: {action}")
            check_items(action.get("items") or action.get("replacement") or [], f"rule {i}")
        rules.append({"name": f"rule-{i}", "matcher": {}, "owner": {}, "action": None, "code_actions": []} | rule)
    return rules


def check_items(items: list[dict], where: str) -> None:
    """The items that a code action puts in: labels are declared once, jumps go to labels among them, switches have a target for each value.

    A label is told by its label_id, a jump by target_label, a switch by switch_default and switch_labels; a table switch may
    say its values from low to high.
    """
    labels = [x.get("label_id") for x in items if x.get("kind") == "label"]
    if None in labels or len(set(labels)) < len(labels):
        raise ValueError(f"labels of {where} need names of their own")
    for item in items:
        aims = [item[k] for k in ("target_label", "switch_default") if item.get(k) is not None] + list(item.get("switch_labels") or [])
        if unknown := [x for x in aims if x not in labels]:
            raise ValueError(f"labels {unknown} of {where} are not declared")
        if item.get("kind") == "table_switch" and "low" in item and "high" in item:
            width, targets = item["high"] - item["low"] + 1, len(item.get("switch_labels") or [])
            if width < 1:
                raise ValueError(f"invalid range {item['low']} to {item['high']} of a table switch in {where}")
            if targets != width:
                raise ValueError(f"a table switch from {item['low']} to {item['high']} in {where} has {targets} targets")


def flat(actions: list[dict]) -> list[dict]:
    """Actions with sequences taken apart, in order."""
    return [x for a in actions for x in (flat(a["actions"]) if a.get("type") == "sequence" else [a])]


def item_test(spec: dict) -> Column:
    """Code items whose columns have the given values; an opcode of a constant load means all of its forms."""
    of = matchers.insns
    tests = [of.opcode(v) if k == "opcode" else matchers.Matcher.of(F.col(k) == F.lit(v), k) for k, v in spec.items()]
    return matchers.all_of(*tests, ~of.is_label()).column if spec else F.lit(False)


def edit_code(items: DataFrame, action: dict) -> tuple[DataFrame, DataFrame]:
    """The edited items of all methods, and (class_id, n) of what the action matched."""
    what = action["type"]
    per_class = lambda df: df.groupBy("class_id").agg(F.count("*").alias("n"))
    if what.endswith("-sequence"):
        pattern = [item_test(p) for p in action["pattern"]]
        return sequences.replace_sequences(items, pattern, action.get("replacement", []), BY, ORDER), per_class(sequences.find_greedy(items, pattern, BY, ORDER))
    if what in ("redirect-method-call", "redirect-field-access", "replace-string"):
        if what == "replace-string":
            hit, values = (F.col("kind") == "ldc") & (F.col("ldc_string") == action["from"]), {"ldc_string": action["to"]}
        else:
            kinds = matchers.Instructions.CALLS[:2] if what == "redirect-method-call" else ("field",)
            parts = {k: v for k, v in action["from"].items() if what == "redirect-method-call" or k != "descriptor"}
            hit, values = F.col("kind").isin(*kinds) & item_test(parts), action["to"]
        hit = F.coalesce(hit, F.lit(False))
        return items.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}), per_class(items.where(hit))
    hit = item_test(action["matcher"])
    counts = per_class(items.where(hit))
    if what == "remove-insn":
        return sequences.remove(items, hit, BY, ORDER), counts
    place = {"replace-insn": "replace", "insert-before": "before", "insert-after": "after"}[what]
    return sequences.splice(items, hit, action.get("replacement", action.get("items", [])), BY, ORDER, place), counts


def new_values(kind: str, action: dict) -> dict[str, Column] | None:
    """The columns that an action sets, as expressions of the old ones; None: the rows go."""
    of = {"class": bits.CLASS_FLAGS, "field": bits.FIELD_FLAGS, "method": bits.METHOD_FLAGS}[kind]
    what = action["type"]
    flags = F.col("access_flags")
    if what.endswith("access-flags"):
        mask = bits.mask(action["flags"], of)
        return {"access_flags": {"add-access-flags": bits.add(flags, mask), "remove-access-flags": bits.remove(flags, mask), "set-access-flags": F.lit(mask)}[what]}
    if kind == "class":
        have = F.col("interfaces")
        if what == "set-super-class":
            return {"super_name": F.lit(action["to"]).cast("string")}
        if what == "add-interface":
            return {"interfaces": F.when(F.array_contains(have, action["name"]), have).otherwise(F.array_append(have, F.lit(action["name"])))}
        if what == "remove-interface":
            return {"interfaces": F.array_remove(have, action["name"])}
    elif what == "rename":
        return {"name": F.lit(action["to"])}
    elif what == "remove":
        return None
    raise ValueError(f"unknown {kind} action: {what}")


def typed(rows: DataFrame, column: str, value: Column) -> Column:
    kind = rows.schema[column].dataType
    return value if isinstance(kind, ArrayType) else value.cast(kind)


def apply(catalog: Catalog, rules: list[dict]) -> tuple[Catalog, DataFrame]:
    """The patched catalog, and a row (rule, kind, matched_classes, changed_classes, matched_targets, changed_targets) for each rule."""
    save = Scratch(catalog.classes.sparkSession).write
    counts = None
    for number, rule in enumerate(rules):
        kind, table = rule["kind"], TABLES[rule["kind"]]
        rows = getattr(catalog, table)
        hit = matchers.from_json(kind, rule["matcher"]).column
        if kind == "class":
            marked = rows.withColumn("_hit", hit)
        else:
            owners = catalog.classes.where(matchers.from_json("class", rule["owner"]).column).select("class_id", F.lit(True).alias("_own"))
            marked = rows.join(owners, "class_id", "left").withColumn("_hit", F.coalesce("_own", F.lit(False)) & hit).drop("_own")
        values = new_values(kind, rule["action"]) if rule["action"] else {}
        if values is None:
            marked, after = marked.withColumn("_new", F.col("_hit")), lambda df: df.where("not _hit")
        else:
            differs = F.lit(False)
            for column, value in values.items():
                differs = differs | ~F.col(column).eqNullSafe(typed(rows, column, value))
            marked = marked.withColumn("_new", F.col("_hit") & differs)
            after = lambda df, v=values, r=rows: df.withColumns({c: F.when(F.col("_hit"), typed(r, c, x)).otherwise(F.col(c)) for c, x in v.items()})
        marked = save(marked)  # counted and edited from here: no rule is applied again for those after it
        once = lambda flag: F.count_distinct(F.when(F.col(flag), F.col("class_id")))
        count = marked.agg(once("_hit").alias("matched_classes"), once("_new").alias("changed_classes"), F.count_if("_hit").alias("matched_targets"), F.count_if("_new").alias("changed_targets"))
        if rule["code_actions"]:
            inside = marked.where("_hit").select("class_id", F.col("ordinal").alias("method_ordinal")).distinct().withColumn("_in", F.lit(True))
            items = catalog.code_items.join(inside, BY, "left")
            chosen, rest = items.where("_in").drop("_in"), items.where("_in is null").select(*catalog.code_items.columns)
            told = None
            for action in flat(rule["code_actions"]):
                chosen, n = edit_code(chosen, action)
                told = n if told is None else told.unionAll(n)
            code = told.agg(F.count_distinct("class_id").alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("t"))
            if not rule["action"]:  # code actions alone: the targets are what they match
                count = code.select(F.col("c").alias("matched_classes"), F.col("c").alias("changed_classes"), F.col("t").alias("matched_targets"), F.col("t").alias("changed_targets"))
            else:
                count = count.crossJoin(F.broadcast(code)).select(*(F.col(f"{a}_classes") for a in ("matched", "changed")), *((F.col(f"{a}_targets") + F.col("t")).alias(f"{a}_targets") for a in ("matched", "changed")))  # one row with one row
            catalog = replace(catalog, code_items=save(chosen.select(*catalog.code_items.columns).unionByName(rest)))
        count = count.select(F.lit(number).alias("ordinal"), F.lit(rule["name"]).alias("rule"), F.lit(kind).alias("kind"), "*")
        counts = count if counts is None else counts.unionByName(count)
        catalog = replace(catalog, **{table: after(marked).select(*rows.columns)})
    return catalog, counts
