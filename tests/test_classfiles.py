import re
import shutil
import subprocess
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.operators import cfg, deobfuscate, hierarchy, matchers
from lodestone.sources import archives, classfile

KEY = ["archive", "entry_ordinal"]


@pytest.fixture(scope="module")
def jar(tmp_path_factory):
    if not shutil.which("javac"):
        pytest.skip("no Java compiler")
    out = tmp_path_factory.mktemp("java")
    subprocess.run(["javac", "--release", "8", "-g", "-d", out, Path(__file__).parent / "java/Shop.java"], check=True, capture_output=True)
    path = out / "jars" / "shop.jar"
    path.parent.mkdir()
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("dir/", b"")
        for name in ("Shop", "Store", "Priced"):
            z.write(out / f"{name}.class", f"dir\\.\\{name}.class" if name == "Store" else f"dir/{name}.class")
        z.writestr("notes.txt", b"words")
        z.writestr("broken.class", b"\xca\xfe\xba\xbe\x00\x00\x00\x34\x00\x05")
        z.writestr("../escape.class", b"no class")
    (path.parent / "no.jar").write_bytes(b"not an archive")
    return path.parent, out


@pytest.fixture(scope="module")
def entries(spark, jar):
    return archives.read_entries(spark, str(jar[0])).persist()


@pytest.fixture(scope="module")
def parsed(spark, entries):
    rows = archives.named(entries).where("is_class")
    return classfile.parse(rows, [*KEY, "entry_name"]).persist()


def test_entries_keep_order_and_metadata(entries):
    rows = archives.named(entries).orderBy("entry_ordinal").collect()
    assert [r.raw_name for r in rows] == ["dir/", "dir/Shop.class", "dir\\.\\Store.class", "dir/Priced.class", "notes.txt", "broken.class", "../escape.class"]
    assert [r.entry_name for r in rows] == ["dir", "dir/Shop.class", "dir/Store.class", "dir/Priced.class", "notes.txt", "broken.class", None]
    assert [r.is_class for r in rows] == [False, True, True, True, False, True, False]
    assert rows[1].compression == 8 and rows[0].is_dir and rows[4].content == b"words"
    assert [r.raw_name for r in archives.bad_names(entries).collect()] == ["../escape.class"]
    found = archives.inventory(entries).first()
    assert (found.n_classes, found.n_resources) == (4, 2)


def test_changed_archives_are_put_together_again(spark, entries, tmp_path):
    name = entries.first().archive
    new = spark.createDataFrame([(name, "notes.txt", b"other"), (name, "added.txt", b"new")], "archive string, entry_name string, content binary")
    changed = archives.put(entries, new)
    gone = archives.remove(changed, spark.createDataFrame([(name, "dir/Priced.class")], "archive string, entry_name string"))
    with pytest.raises(KeyError):
        archives.remove(changed, spark.createDataFrame([(name, "nothing")], "archive string, entry_name string"))
    (tmp_path / "x.jar").write_bytes(archives.zipped(gone).first().content)
    with zipfile.ZipFile(tmp_path / "x.jar") as z:
        assert z.namelist() == ["dir/", "dir/Shop.class", "dir\\.\\Store.class", "notes.txt", "broken.class", "../escape.class", "added.txt"]
        assert z.read("notes.txt") == b"other" and z.read("added.txt") == b"new"


def test_classes_and_members(parsed):
    classes = {r.name: r for r in classfile.classes(parsed, KEY).collect()}
    assert classes["Shop"].super_name == "Store" and classes["Shop"].interfaces == ["Priced", "java/lang/Comparable"] and classes["Shop"].major == 52
    assert classes["Priced"].access_flags == 0x0600
    fields = {r.name: r for r in classfile.fields(parsed, KEY).collect()}
    assert (fields["total"].descriptor, fields["total"].access_flags) == ("J", 0x42)
    broken = classfile.errors(parsed, ["entry_name"]).collect()
    assert [(r.entry_name, r.error_kind) for r in broken] == [("broken.class", "truncated")]
    kinds = {r.name for r in classfile.attributes(parsed, KEY).collect()}
    assert {"SourceFile", "Code", "LineNumberTable", "ConstantValue", "StackMapTable"} <= kinds


def test_instructions_are_those_of_javap(parsed, jar):
    text = subprocess.run(["javap", "-p", "-c", "-cp", jar[1], "Shop"], capture_output=True, text=True, check=True).stdout
    want = [[int(n) for n in re.findall(r"^\s+(\d+): [a-z]", body, re.M)] for body in text.split("Code:")[1:]]
    shop = parsed.where("name = 'Shop'")
    got = classfile.instructions(shop, KEY).groupBy("method_ordinal").agg(F.sort_array(F.collect_list("pc")).alias("pcs")).orderBy("method_ordinal")
    assert [r.pcs for r in got.collect()] == want
    strings = {r.ldc_string for r in classfile.instructions(shop, KEY).where("ldc_string is not null").collect()}
    assert strings == {"hello shop", "one", "thousand", "other words", "not a number", "opened"}
    calls = matchers.insns.method(owner="java/io/PrintStream", name="println")
    assert classfile.instructions(shop, KEY).where(calls.column).count() == 1
    dims = classfile.instructions(shop, KEY).where("kind = 'multi_new_array'").first()
    assert (dims.descriptor, dims.dims) == ("[[I", 2)


def test_graphs_of_methods(parsed):
    shop = parsed.where("name = 'Shop'")
    items = classfile.code_items(shop, KEY).persist()
    by = [*KEY, "method_ordinal"]
    names = {r.name: r.ordinal for r in classfile.methods(shop, KEY).collect()}
    edges = cfg.jump_edges(items, by, "item_ordinal").persist()
    switch = items.where((F.col("kind") == "table_switch") & (F.col("method_ordinal") == names["sort"])).first()
    targets = edges.where((F.col("method_ordinal") == names["sort"]) & (F.col("src") == switch.node_ordinal)).orderBy("edge_ordinal").collect()
    assert len(targets) == 4 and targets[0].edge_ordinal == 0
    branch = items.where((F.col("kind") == "branch") & (F.col("method_ordinal") == names["price"]) & F.col("opcode").between(0x99, 0xA6)).first()
    assert edges.where((F.col("method_ordinal") == names["price"]) & (F.col("src") == branch.node_ordinal)).count() == 2
    caught = cfg.handler_edges(items, classfile.handlers(shop, KEY), by, "item_ordinal")
    types = {r.catch_type for r in caught.where(F.col("method_ordinal") == names["careful"]).collect()}
    assert types == {"java/lang/NumberFormatException", None}
    starts = cfg.blocks(items, edges, by, "item_ordinal", caught)
    first = starts.where((F.col("method_ordinal") == names["sort"]) & F.col("is_block_start")).count()
    assert first == 5  # the switch, three cases and the default
    assert starts.groupBy(*by).agg(F.min("block").alias("b")).where("b != 1").isEmpty()


def test_hierarchy_and_overrides(parsed):
    classes = classfile.classes(parsed, KEY)
    edges = hierarchy.edges_of(classes)
    closed = hierarchy.closure(edges).persist()
    up = {(r.child, r.ancestor) for r in closed.collect()}
    assert ("Shop", "Priced") in up and ("Shop", "java/lang/Object") in up
    chain = [r.ancestor for r in hierarchy.superclasses(edges).where("child = 'Shop'").orderBy("depth").collect()]
    assert chain == ["Store", "java/lang/Object"]
    methods = classfile.methods(parsed, [*KEY]).join(classes.select(*KEY, F.col("name").alias("owner")), KEY).withColumn("package", F.lit(""))
    found = {(r.owner, r.name, r.overrides) for r in hierarchy.overridden(methods, closed).collect()}
    assert found == {("Shop", "open", "Store"), ("Shop", "price", "Priced")}
    assert {r.parent for r in hierarchy.unresolved(edges, classes).collect()} == {"java/lang/Comparable"}
    assert hierarchy.cycles(edges).isEmpty()


def test_summary_holds_opcodes(parsed):
    shop = classfile.class_summary(parsed, ["entry_name"]).where("entry_name = 'dir/Shop.class'").first()
    main = next(m for m in shop.methods if m.name == "main")
    assert main.opcodes == [0xB2, 0x12, 0xB6, 0xB1] and "SourceFile" in shop.attribute_names


def test_clean_up_of_jumps(spark):
    rows = [(1, k, op, label, target) for k, op, label, target in [
        ("raw", 0, None, None), ("branch", 0xA7, None, 5), ("label", None, 5, None), ("branch", 0xA7, None, 7), ("raw", 4, None, None),
        ("label", None, 7, None), ("branch", 0xA7, None, 9), ("raw", 0, None, None), ("label", None, 9, None), ("raw", 0xB1, None, None),
        ("label", None, 11, None), ("branch", 0xA7, None, 11)]]
    items = spark.createDataFrame([(m, i, *rest) for i, (m, *rest) in enumerate(rows)], "method int, ordinal bigint, kind string, opcode int, label_id int, target_label int")
    out = deobfuscate.clean(items, ["method"]).orderBy("ordinal").collect()
    assert [r.ordinal for r in out] == list(range(len(out)))
    told = [(r.kind, r.opcode, r.target_label) for r in out if r.kind != "label"]
    # nops go, jumps to jumps end at 9, the one right before 9 goes too, the circle stays
    assert told == [("branch", 0xA7, 9), ("branch", 0xA7, 9), ("raw", 4, None), ("raw", 0xB1, None), ("branch", 0xA7, 11)]


def test_frames_reach_javac_s_limits(parsed):
    from lodestone.operators import frames

    items = classfile.code_items(parsed, KEY)
    methods, classes = classfile.methods(parsed, KEY).persist(), classfile.classes(parsed, KEY)
    chains = hierarchy.superclasses(hierarchy.edges_of(classes))
    found = frames.simulate(items, classfile.handlers(parsed, KEY), methods, classes, chains, KEY)
    both = found.join(methods.select(*KEY, F.col("ordinal").alias("method_ordinal"), "name", F.col("max_stack").alias("s"), F.col("max_locals").alias("l")), [*KEY, "method_ordinal"]).collect()
    assert len(both) > 10
    for r in both:
        assert r.error is None, r
        assert r.max_stack == r.s and r.max_locals <= r.l, r
    careful = next(r for r in both if r.name == "careful")
    assert any(f.stack == ["java/lang/NumberFormatException"] for f in careful.frames)
    assert any(f.stack == ["java/lang/Throwable"] for f in careful.frames)


def test_frames_tell_what_cannot_be(spark):
    from lodestone.operators.frames import Method, Unverifiable

    raw = lambda op: {"kind": "raw", "opcode": op}
    m = Method("A", "f", "(J)V", False, {"B": ["A", "java/lang/Object"], "C": ["A"]})
    assert m.start() == ([], ["A", "long", "top"])
    assert m.join("B", "C") == "A" and m.join("null", "B") == "B" and m.join("int", "B") == "top" and m.join("[I", "B") == "java/lang/Object"
    with pytest.raises(Unverifiable):
        m.run([raw(0x57), raw(0xB1)], {0: [1]}, {})
    with pytest.raises(Unverifiable):
        m.run([raw(0xCA)], {}, {})
    states, stack, local = m.run([raw(0x09), raw(0x5C), raw(0x58), raw(0x58), raw(0xB1)], {i: [i + 1] for i in range(4)}, {})
    assert (stack, local, states[4][0]) == (4, 3, [])


def test_signatures_follow_the_grammar(spark):
    from lodestone.functions import signatures

    good = {"class": ["<T:Ljava/lang/Object;:Ljava/lang/Runnable;>La/B<TT;>.C<*>;Lx/I;", "Ljava/lang/Object;"], "method": ["<T:>(TT;[I+Lx;)V", "()Lx/Y<+TT;-[J>;^TE;", "(IJ[[D)V^Lx;"], "field": ["TT;", "[Lx/Y<[I>;", "La<La<La;>;>;"]}
    good["method"][0] = "<T:Lx;>(TT;[ILx;)V"
    bad = {"class": ["", "I", "<>Lx;", "Lx"], "method": ["()", "(V)V", "<T>()V", "()VV"], "field": ["I", "L;", "Lx<>;", "Lx;;", "Lx//y;"]}
    for kind in good:
        rows = spark.createDataFrame([(t, True) for t in good[kind]] + [(t, False) for t in bad[kind]], "t string, ok boolean")
        for r in rows.withColumn("found", signatures.is_valid(kind)(F.col("t"))).collect():
            assert r.found == r.ok, (kind, r.t)


def test_lengths_add_up_to_pcs(parsed):
    from lodestone.functions import opcodes
    from lodestone.operators.sequences import running_sum

    items = classfile.code_items(parsed, KEY)
    by = [*KEY, "method_ordinal"]
    straight = items.join(items.where("kind like '%switch'").select(*by).distinct(), by, "left_anti")
    placed = straight.withColumn("at", running_sum(opcodes.length(), by, "item_ordinal")).where("kind != 'label'")
    assert placed.count() > 100 and placed.where("at != pc").isEmpty()
    padded = items.where("kind like '%switch'").select(opcodes.switch_padding(F.col("pc")).alias("p"), "pc").collect()
    assert all((r.pc + 1 + r.p) % 4 == 0 for r in padded)


def test_opcode_columns(spark):
    from lodestone.functions import descriptors, opcodes

    row = spark.range(1).select(
        opcodes.shortcut(F.lit(0x15), F.lit(2)).alias("a"), opcodes.shortcut(F.lit(0x3A), F.lit(4)).alias("b"), opcodes.implicit_slot(F.lit(0x1C)).alias("c"),
        opcodes.inverted_branch(F.lit(0x99)).alias("d"), opcodes.inverted_branch(F.lit(0xC7)).alias("e"), opcodes.short_constant(F.lit("int"), F.lit(-1)).alias("f"),
        opcodes.fits_short(F.lit(40000)).alias("g"), descriptors.component_type(F.lit("[[I")).alias("h"), descriptors.element_type(F.lit("[[I")).alias("i"),
    ).first()
    assert tuple(row) == (0x1C, None, 2, 0x9A, 0xC6, 2, False, "[I", "I")
    assert opcodes.equivalents(spark).count() == 14


def test_modified_utf8_goes_round():
    for text in ("", "plain", "a\x00b", "é日", "😀 x", "\ud800"):
        raw = classfile.encode_modified_utf8(text)
        assert b"\x00" not in raw
        assert classfile.decode_modified_utf8(raw) == (None if text == "\ud800" else text)
    assert classfile.decode_modified_utf8(b"\xff") is None


def test_handler_tables_are_compared_place_by_place(spark):
    from lodestone.operators import diff

    kind = "m int, handler_ordinal bigint, v string, s string"
    a = spark.createDataFrame([(1, 0, "0,4,9,E", "E"), (2, 0, "0,1,2,E", "E"), (2, 1, "x", "x")], kind)
    b = spark.createDataFrame([(1, 0, "0,5,9,F", "F"), (2, 0, "0,1,2,E", "E")], kind)
    found = {(r.m, r.handler_ordinal, r.severity) for r in diff.sequence_diff(a, b, ["m"], "handler_ordinal", "v", "s").collect()}
    assert found == {(1, 0, "ERROR"), (2, -1, "ERROR")}
