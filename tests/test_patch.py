import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import deobfuscate
from lodestone.plans import debug, patch, pipeline

MEMBER = "class_id int, ordinal int, access_flags int, name string, descriptor string"
ITEMS = "class_id int, method_ordinal int, item_ordinal bigint, kind string, opcode int, owner string, name string, descriptor string, ldc_string string"


def catalog(spark):
    classes = spark.createDataFrame([(1, "p/A", "java/lang/Object", ["x/I"], 0x21, 52), (2, "q/B", "p/A", [], 0x30, 50)], "class_id int, name string, super_name string, interfaces array<string>, access_flags int, major int")
    fields = spark.createDataFrame([(1, 0, 2, "count", "I"), (2, 0, 1, "count", "J")], MEMBER)
    methods = spark.createDataFrame([(1, 0, 1, "run", "()V", True), (1, 1, 0x401, "later", "()V", False), (2, 0, 1, "run", "()V", True)], MEMBER + ", has_code boolean")
    code = [("raw", 0, None, None, None, None), ("ldc", 0x12, None, None, None, "old"), ("method", 0xB8, "u/U", "call", "()V", None), ("raw", 0, None, None, None, None), ("raw", 0, None, None, None, None), ("raw", 0, None, None, None, None), ("raw", 0xB1, None, None, None, None)]
    items = spark.createDataFrame([(c, 0, i, *row) for c in (1, 2) for i, row in enumerate(code)], ITEMS)
    return pipeline.Catalog(classes, fields, methods, items)


def plan(*rules):
    return patch.load(json.dumps({"rules": rules}))


def test_rules_change_and_count(spark):
    rules = plan(
        {"kind": "class", "matcher": {"name_matches": "A"}, "action": {"type": "add-interface", "name": "x/I"}},
        {"kind": "class", "name": "sealed", "matcher": {"version_below": 52}, "action": {"type": "set-super-class", "to": None}},
        {"kind": "field", "matcher": {"name": "count"}, "owner": {"name": "q/B"}, "action": {"type": "rename", "to": "total"}},
        {"kind": "method", "matcher": {"has_code": False}, "action": {"type": "remove"}},
        {"kind": "method", "matcher": {"name": "run"}, "owner": {"name": "p/A"}, "code_actions": [
            {"type": "remove-sequence", "pattern": [{"opcode": 0}, {"opcode": 0}]},
            {"type": "sequence", "actions": [{"type": "replace-string", "from": "old", "to": "new"}, {"type": "redirect-method-call", "from": {"owner": "u/U", "name": "call"}, "to": {"owner": "v/V"}}]},
            {"type": "insert-before", "matcher": {"opcode": 0xB1}, "items": [{"kind": "raw", "opcode": 4}, {"kind": "raw", "opcode": 87}]},
            {"type": "remove-insn", "matcher": {"opcode": 0}}]},
    )
    out, report = patch.apply(catalog(spark), rules)
    told = [(r.rule, r.matched_classes, r.changed_classes, r.matched_targets, r.changed_targets) for r in report.orderBy("ordinal").collect()]
    # Of three nops in a row one pair goes; the first and the left-over one go with remove-insn.
    assert told == [("rule-1", 1, 0, 1, 0), ("sealed", 1, 1, 1, 1), ("rule-3", 1, 1, 1, 1), ("rule-4", 1, 1, 1, 1), ("rule-5", 1, 1, 6, 6)]
    assert {r.class_id: r.super_name for r in out.classes.collect()} == {1: "java/lang/Object", 2: None}
    assert sorted((r.class_id, r.name) for r in out.fields.collect()) == [(1, "count"), (2, "total")]
    assert sorted((r.class_id, r.name) for r in out.methods.collect()) == [(1, "run"), (2, "run")]
    code = [(r.kind, r.opcode, r.owner, r.ldc_string) for r in out.code_items.where("class_id = 1").orderBy("item_ordinal").collect()]
    assert code == [("ldc", 0x12, None, "new"), ("method", 0xB8, "v/V", None), ("raw", 4, None, None), ("raw", 87, None, None), ("raw", 0xB1, None, None)]
    assert out.code_items.where("class_id = 2").count() == 7


@pytest.mark.parametrize(
    "rule",
    [
        {"kind": "module", "action": {}},
        {"kind": "class", "acton": {}},
        {"kind": "class"},
        {"kind": "class", "code_actions": [{"type": "remove-insn", "matcher": {}}]},
        {"kind": "method", "code_actions": [{"type": "remove-insn", "macher": {}}]},
    ],
)
def test_bad_plans_are_refused(rule):
    with pytest.raises(ValueError):
        plan(rule)


def test_debug_data_is_marked_and_stripped(spark):
    classes = debug.mark_stale(spark.createDataFrame([(1, "A"), (2, "B")], "class_id int, name string"), F.col("name") == "A")
    attributes = spark.createDataFrame([(c, k, n) for c in (1, 2) for k, n in (("class", "SourceFile"), ("code", "LineNumberTable"), ("class", "Signature"))], "class_id int, owner_kind string, name string")
    left = lambda policy: sorted((r.class_id, r.name) for r in debug.strip(attributes, classes, policy).collect())
    assert left("preserve") == [(1, "Signature"), (2, "LineNumberTable"), (2, "Signature"), (2, "SourceFile")]
    assert left("strip") == [(1, "Signature"), (2, "Signature")]


def test_only_straight_code_loses_nops(spark):
    rows = [(1, 0, "raw", 0), (1, 1, "raw", 0xB1), (2, 0, "raw", 0), (2, 1, "label", None)]
    items = spark.createDataFrame(rows, "method int, ordinal bigint, kind string, opcode int")
    out = deobfuscate.remove_nops_of_straight_code(items, ["method"])
    assert sorted((r.method, r.ordinal, r.kind) for r in out.collect()) == [(1, 0, "raw"), (2, 0, "raw"), (2, 1, "label")]


def test_items_with_labels_and_switches_are_validated():
    from lodestone.plans.patch import check_items

    label = {"kind": "label", "label_id": "a"}
    check_items([label, {"kind": "branch", "opcode": 167, "target_label": "a"}, {"kind": "table_switch", "switch_default": "a", "low": 3, "high": 4, "switch_labels": ["a", "a"]}], "rule 1")
    for broken in (
        [{"kind": "branch", "target_label": "b"}], [label, label], [{"kind": "label"}], [label, {"kind": "lookup_switch", "switch_default": "a", "switch_labels": ["c"]}],
        [label, {"kind": "table_switch", "switch_default": "a", "low": 3, "high": 5, "switch_labels": ["a", "a"]}], [label, {"kind": "table_switch", "switch_default": "a", "low": 3, "high": 2, "switch_labels": []}],
    ):
        with pytest.raises(ValueError):
            check_items(broken, "rule 1")
