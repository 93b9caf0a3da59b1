"""First errors, strict documents, reports, observed stages and exception tables against plain Python."""

import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lodestone.operators import diff, matchers, transforms
from lodestone.plans import documents, observed, staged
from lodestone.plans.pipeline import Catalog, Pipeline
from lodestone.sources import documents as json_documents
from lodestone.sources.scratch import Scratch

CLASS = "class_id int, name string, super_name string, interfaces array<string>, access_flags int, major int, slots int"
MEMBER = "class_id int, ordinal int, access_flags int, name string, descriptor string"


def test_first_errors_are_the_first_of_all(spark):
    rng = random.Random(2)
    o = "java/lang/Object"
    classes = [(i, rng.choice(["a/B", "a/B", "a/B", "x.y"]), rng.choice([o, o, o, "p//q", None]), rng.choice([[], [], ["I"], ["I", "I"]]), rng.choice([0x21, 0x21, 0x600, 0x210]), 52, 2 if i < 40 else 1) for i in range(60)]
    fields = [(i, k, rng.choice([1, 1, 3, 0x50]), rng.choice(["x", "y", "z", "a.b"]), rng.choice(["I", "I", "Q"])) for i in range(60) for k in range(rng.choice([0, 0, 2]))]
    methods = [(i, k, 1, rng.choice(["f", "g", "<x>"]), rng.choice(["()V", "(I"]), rng.random() < 0.8) for i in range(60) for k in range(rng.choice([0, 0, 1, 3]))]
    pool = [(i, 1, rng.choice([1, 1, 1, 1, 7, 5]), "a", None, 1, None) for i in range(40)]
    tables = staged.Tables(
        spark.createDataFrame(classes, CLASS), spark.createDataFrame(fields, MEMBER), spark.createDataFrame(methods, MEMBER + ", has_code boolean"),
        pool=spark.createDataFrame(pool, "class_id int, cp_index int, tag int, utf8 string, bits long, ref1 int, ref2 int"),
    )
    every = staged.every_violation(tables).where("severity = 'ERROR'").collect()
    blank = lambda v: "" if v is None else str(v)
    want = {}
    for r in sorted(every, key=lambda r: (r.place, r.rule, *(blank(r[c]) for c in staged.PLACE))):
        want.setdefault(r.class_id, (r.stage, r.rule, r.message))
    found = staged.first_errors(tables).collect()
    assert len(found) == len(want) and {r.class_id: (r.stage, r.rule, r.message) for r in found} == want
    assert {"pool", "class", "fields", "methods"} <= {r.stage for r in found}
    fast, whole = staged.report(tables, fail_fast=True), staged.report(tables)
    assert fast.columns == whole.columns and fast.count() == len(want) and whole.count() >= len(every)
    assert staged.first_errors(replace(tables, classes=tables.classes.limit(0))).where("stage <> 'pool'").isEmpty()


def walk(value, path=""):
    """Every path below a value."""
    for name, x in value.items() if isinstance(value, dict) else [(None, x) for x in value] if isinstance(value, list) else []:
        at = f"{path}[]" if name is None else f"{path}.{name}" if path else name
        yield at
        yield from walk(x, at)


def test_paths_and_unknown_keys_of_random_documents(spark):
    rng = random.Random(6)

    def value(depth):
        kind = rng.choice("oalls") if depth else "l"
        if kind == "o":
            return {rng.choice("abcd"): value(depth - 1) for _ in range(rng.randint(0, 3))}
        return [value(depth - 1) for _ in range(rng.randint(0, 3))] if kind == "a" else rng.choice([1, "s", None, True, 1.5])

    texts = [json.dumps(value(4)) for _ in range(120)] + ["{bad", None, "", "7", "[]", "{}", '{"a": {"a": {"a": {"a": {"a": {"a": 1}}}}}}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    sound = {i: json.loads(t) for i, t in enumerate(texts) if t and t != "{bad"}
    got = sorted((r.id, r.path) for r in json_documents.paths(df, ["id"], "text").collect())
    assert got == sorted((i, p) for i, v in sound.items() for p in walk(v))
    allowed = ["a", "a[]", "a.b", "[]", "[].c", "d.**"]
    fine = lambda p: p in allowed or p == "d" or p.startswith(("d.", "d[]"))
    above = lambda p: p[:-2] if p.endswith("[]") else p.rpartition(".")[0]
    reached = lambda p: not p or fine(p) and reached(above(p))
    want = {(i, p, "unknown key") for i, v in sound.items() for p in walk(v) if not fine(p) and reached(above(p))} | {(i, "$", "malformed") for i, t in enumerate(texts) if t in ("{bad", "")}
    found = [tuple(r) for r in json_documents.unknown_keys(df, ["id"], "text", allowed).collect()]
    assert len(found) == len(want) and set(found) == want


def test_compiler_control_files_with_unknown_keys_are_refused(spark):
    files = [("a.jar", '[{"match": ["x/Y.z", "q"], "c2": {"exclude": true}}, {"match": ["n"], "c2": {"exclude": false}}, {"match": ["m"]}]'), ("b.jar", '[{"match": ["x"], "c2": {"exclude": true, "log": 1}}]'), ("c.jar", "[{"), ("d.jar", '[{"Match": []}]')]
    entries = spark.createDataFrame([(a, "compilercontrol.json", t.encode()) for a, t in files] + [("e.jar", "other.json", b"{}")], "archive string, entry_name string, content binary")
    excludes, errors = json_documents.compiler_excludes(entries)
    assert {tuple(r) for r in excludes.collect()} == {("a.jar", "x/Y.z"), ("a.jar", "q")}
    assert {tuple(r) for r in errors.collect()} == {("b.jar", "[].c2.log", "unknown key"), ("c.jar", "$", "malformed"), ("d.jar", "[].Match", "unknown key")}


def test_reports_have_their_lists_in_order_and_ties(spark, tmp_path):
    rows = [(k, n, m) for k in "xyz" for n, m in (("b", 3), ("a", 3), ("c", 2), ("d", 1), ("e", 2))] + [("only", "p", 1)]
    df = spark.createDataFrame(rows, "k string, name string, n int").repartition(3)
    top = documents.top_with_ties(df, ["k"], [("n", True)], 3)
    lists = top.groupBy("k").agg(documents.in_order(["name", "n"], [("n", True), ("name", False)]).alias("names"))
    head = df.groupBy("k").agg(F.count("*").alias("rows")).unionByName(spark.createDataFrame([("none", 0)], "k string, rows long"))
    reports = documents.assembled("k", head, best=lists)
    got = {r.k: json.loads(r.report) for r in reports.collect()}
    assert got["x"] == {"k": "x", "rows": 5, "best": [{"name": "a", "n": 3}, {"name": "b", "n": 3}, {"name": "c", "n": 2}, {"name": "e", "n": 2}]}
    assert got["only"]["best"] == [{"name": "p", "n": 1}] and got["none"] == {"k": "none", "rows": 0, "best": []}
    documents.write(reports, f"{tmp_path}/out", "k")
    back = spark.read.text(f"{tmp_path}/out")
    assert {r.k: json.loads(r.value) for r in back.collect()} == got and (tmp_path / "out" / "k=x").is_dir()


def test_observed_figures_are_the_counted_ones(spark):
    classes = spark.createDataFrame([(i, f"c{i}", "s", [], i, 50) for i in range(30)], "class_id int, name string, super_name string, interfaces array<string>, access_flags int, major int")
    members = spark.createDataFrame([(i, i, "f" * (i % 4), "I", 1) for i in range(30)], "class_id int, ordinal int, name string, descriptor string, access_flags int")
    items = spark.createDataFrame([(i, i, k, "raw", k) for i in range(30) for k in range(3)], "class_id int, method_ordinal int, item_ordinal int, kind string, opcode int")
    pipeline = Pipeline().on_classes(matchers.classes.named("c3"), transforms.rename("longer")).custom(lambda c: replace(c, fields=c.fields.where("class_id % 2 = 0"), code_items=c.code_items.where("opcode > 0")), "few").custom(lambda c: replace(c, classes=c.classes.where("class_id < 0")), "none")
    stages = observed.Stages(Scratch(spark))
    done = stages.run(pipeline, Catalog(classes, members, members, items))
    told = {(r.number, r.table): (r.rows, r.bytes) for r in stages.table().collect()}
    want, catalog = {}, Catalog(classes, members, members, items)
    for number, (_, step) in enumerate(pipeline.steps, 1):
        after = step(catalog)
        for t in observed.TABLES:
            if getattr(after, t) is not getattr(catalog, t):
                df = getattr(after, t)
                want[number, t] = tuple(df.agg(F.count("*"), F.coalesce(F.sum(observed.text_bytes(df)), F.lit(0))).first())
        catalog = after
    assert told == want and set(told) == {(1, "classes"), (2, "fields"), (2, "code_items"), (3, "classes")}
    assert done.classes.isEmpty() and all(r.seconds > 0 for r in stages.table().collect())


def plain_diff(old, new):
    """Edits of two lists of handlers in one numbering, as handler_diff tells them."""
    nth = lambda xs: [(x, xs[:i].count(x)) for i, x in enumerate(xs)]
    a, b = nth(old), nth(new)
    pairs = sorted((i, b.index(x)) for i, x in enumerate(a) if x in b)
    ranks = {p: r for r, p in enumerate(sorted(pairs, key=lambda p: p[1]))}
    moved = {p for r, p in enumerate(pairs) if ranks[p] != r}
    fixed = [p for p in pairs if p not in moved]
    gap = lambda i, side: sum(p[side] < i for p in fixed)
    left = {}
    for side, xs in ((0, a), (1, b)):
        for i in range(len(xs)):
            if i not in {p[side] for p in pairs}:
                left.setdefault(gap(i, side), ([], []))[side].append(i)
    out = [("moved", x, y, None) for x, y in moved]
    for x, y in left.values():
        for i in range(max(len(x), len(y))):
            p, q = x[i] if i < len(x) else None, y[i] if i < len(y) else None
            what = ",".join(c for c, u, v in zip(diff.CELLS, old[p], new[q], strict=True) if u != v) if p is not None and q is not None else None
            out.append(("removed" if q is None else "inserted" if p is None else "changed", p, q, what))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_exception_tables_are_compared_modulo_renumbering(spark, seed):
    rng = random.Random(seed)
    items, edited, handlers, changed, want = [], [], [], [], []
    for m in range(25):
        code = [("label", f"L{i}") if rng.random() < 0.4 else ("raw", i) for i in range(14)]
        labels = [x for k, x in code if k == "label"] or ["L?"]
        after = [x for x in code if x[0] == "label" or rng.random() < 0.85]
        for _ in range(3):
            after.insert(rng.randint(0, len(after)), ("raw", 100 + rng.randrange(1000)))
        number = {s: {x: 10 * s + i for i, (k, x) in enumerate(c) if k == "label"} for s, c in ((0, code), (1, after))}
        shared = {x for k, x in code if k == "raw"} & {x for k, x in after if k == "raw"}
        place = lambda c, label: next((sum(y in shared for kk, y in c[:i] if kk == "raw") for i, (k, x) in enumerate(c) if (k, x) == ("label", label)), None)
        old = [tuple(rng.choice(labels) for _ in range(3)) + (rng.choice(["E", None]),) for _ in range(rng.randint(0, 6))]
        new = [h for h in old if rng.random() < 0.8]
        for _ in range(rng.randint(0, 2)):
            new.insert(rng.randint(0, len(new)), tuple(rng.choice(labels) for _ in range(3)) + ("F",))
        if rng.random() < 0.3:
            rng.shuffle(new)
        for rows, c, s in ((items, code, 0), (edited, after, 1)):
            rows += [(m, i, k, number[s].get(x) if k == "label" else None, x if k == "raw" else -1 - i) for i, (k, x) in enumerate(c)]
        for rows, hs, s in ((handlers, old, 0), (changed, new, 1)):
            rows += [(m, i, *(number[s].get(x, 999) for x in h[:3]), h[3]) for i, h in enumerate(hs)]
        told = lambda hs, c: [(*(place(c, x) for x in h[:3]), h[3]) for h in hs]
        want += [(m, *r) for r in plain_diff(told(old, code), told(new, after))]
    item, handler = "m int, pos int, kind string, label_id int, id int", "m int, handler_ordinal int, start_label int, end_label int, handler_label int, catch_type string"
    found = diff.handler_diff(spark.createDataFrame(items, item), spark.createDataFrame(edited, item), spark.createDataFrame(handlers, handler), spark.createDataFrame(changed, handler), ["m"], "pos", "id")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
