import zipfile

from pyspark.sql import functions as F

from lodestone.plans import deobfuscation_report, pipeline, verify
from lodestone.operators import matchers, transforms
from lodestone.streaming import ingest

CLASS = "class_id int, name string, super_name string, interfaces array<string>, access_flags int, major int"
MEMBER = "class_id int, ordinal int, access_flags int, name string, descriptor string"


def tables(spark):
    classes = spark.createDataFrame(
        [
            (1, "a/Good", "java/lang/Object", ["b/I"], 0x21, 52),
            (2, "bad.name", None, ["b/I", "b/I", "x;"], 0x0210, 52),
            (3, "c/Mixed", "java/lang/Object", [], 0x0410, 51),
            (4, "module-info", "java/lang/Object", [], 0x8001, 53),
            (5, "d/Face", "java/lang/Object", [], 0x0600, 52),
            (6, "e/Old", "java/lang/Object", [], 0x0600, 51),
        ],
        CLASS,
    )
    fields = spark.createDataFrame([(1, 0, 2, "x", "I"), (1, 1, 2, "x", "I"), (1, 2, 3, "y", "Q"), (1, 3, 0x50, "z/w", "[J"), (5, 0, 1, "k", "I")], MEMBER)
    methods = spark.createDataFrame(
        [
            (1, 0, 1, "<init>", "()V", True), (1, 1, 0x0402, "a", "()I", False), (1, 2, 1, "b", "(I", True), (1, 3, 1, "c", "()V", False),
            (1, 4, 0x0101, "n", "()V", True), (1, 5, 0, "<clinit>", "()I", True), (1, 6, 0x11, "<init>", "(I)V", True), (1, 7, 1, "<x>", "()V", True),
            (5, 0, 0, "m", "()V", True), (5, 1, 1, "ok", "()V", True), (6, 0, 1, "m", "()V", True), (1, 8, 1, "c", "()V", True),
        ],
        MEMBER + ", has_code boolean",
    )
    return classes, fields, methods


def test_rules_of_classes_and_members(spark):
    classes, fields, methods = tables(spark)
    found = {(r.class_id, r.severity, r.message) for r in verify.verify(classes, fields, methods).collect()}
    want = {
        (2, "ERROR", 'Invalid class name: "bad.name"'), (2, "WARNING", "No superclass (only valid for java/lang/Object)"), (2, "ERROR", 'Duplicate interface: "b/I"'),
        (2, "ERROR", 'Invalid interface name: "x;"'), (2, "ERROR", "INTERFACE class must also be ABSTRACT"), (2, "ERROR", "INTERFACE class must not be FINAL"),
        (3, "ERROR", "Class cannot be both FINAL and ABSTRACT"), (4, "ERROR", "MODULE class has unexpected flags: 0x0001"),
        (1, "ERROR", "Duplicate field: x I"), (1, "ERROR", 'Invalid field descriptor: "Q"'), (1, "ERROR", 'Field "y" has multiple visibility modifiers'),
        (1, "ERROR", 'Invalid field name: "z/w"'), (1, "ERROR", 'Field "z/w" cannot be both FINAL and VOLATILE'), (5, "ERROR", 'Interface field "k" must be PUBLIC STATIC FINAL'),
        (1, "ERROR", 'ABSTRACT method "a" has illegal flags: 0x0002'), (1, "ERROR", 'Invalid method descriptor: "(I"'), (1, "ERROR", 'Method "c" must have code'),
        (1, "ERROR", 'NATIVE method "n" must not have code'), (1, "ERROR", "<clinit> must be STATIC"), (1, "ERROR", '<clinit> must have descriptor ()V, got "()I"'),
        (1, "ERROR", "<init> has illegal flags: 0x0010"), (1, "ERROR", 'Invalid method name: "<x>"'), (1, "ERROR", "Duplicate method: c()V"),
        (5, "ERROR", 'Interface method "m" must be PUBLIC (or PRIVATE for Java 9+)'), (6, "ERROR", 'Interface method "m" must be PUBLIC ABSTRACT (pre-Java 8)'),
    }
    assert found == want
    assert verify.has_errors(verify.verify(classes, fields, methods))


def test_rules_of_attributes(spark):
    classes, _, _ = tables(spark)
    rows = [(1, "class", 0, "SourceFile"), (1, "class", 0, "SourceFile"), (1, "field", 0, "Code"), (1, "class", 0, "NestHost"), (1, "method", 1, "Mine"), (1, "class", 0, "Module")]
    found = {(r.class_id, r.message) for r in verify.attribute_rules(spark.createDataFrame(rows, "class_id int, owner_kind string, owner_ordinal int, name string"), classes).collect()}
    assert found == {
        (1, "class must not declare multiple SourceFile attributes"), (1, "Code attribute is not allowed on field"), (1, "NestHost attribute requires class file version 55.0 or newer"),
        (1, "Module attribute is only allowed on module classes"), (1, "Module attribute requires class file version 53.0 or newer"), (4, "module class must declare exactly one Module attribute"),
    }


def test_rules_of_constants(spark):
    rows = [(1, 1, 1, "A", None, None), (1, 2, 7, None, 1, None), (1, 3, 7, None, 2, None), (1, 4, 1, "()V", None, None), (1, 5, 12, None, 1, 4), (1, 6, 10, None, 2, 5), (1, 7, 9, None, 2, 5), (1, 8, 10, None, 1, 2), (1, 9, 16, None, 1, None), (1, 10, 8, None, 99, None)]
    pool = spark.createDataFrame(rows, "class_id int, cp_index int, tag int, utf8 string, ref1 int, ref2 int")
    found = {(r.cp_index, r.message) for r in verify.pool_rules(pool).collect()}
    assert found == {
        (3, "class entry references invalid Utf8 name"), (7, "field reference descriptor must be a field descriptor"), (8, "member reference has invalid class_index"),
        (8, "member reference has invalid name_and_type_index"), (9, "method type descriptor must be a method descriptor"), (10, "string entry references invalid Utf8 payload"),
    }


def test_rules_of_code(spark):
    items = spark.createDataFrame([(1, 0, "branch", None, 7, None, None), (1, 0, "label", 3, None, None, None), (1, 0, "lookup_switch", None, None, 3, [3, 9])], "class_id int, method_ordinal int, kind string, label_id int, target_label int, switch_default int, switch_labels array<int>")
    methods = spark.createDataFrame([(1, 0, 1, "f", "()V", True), (1, 1, 1, "g", "()V", True)], MEMBER + ", has_code boolean")
    found = {(r.member_name, r.message) for r in verify.code_rules(items, methods).collect()}
    assert found == {("f", "branch target references label not in instruction stream"), ("f", "switch case references label not in instruction stream"), ("g", "Code has empty instruction list")}


def test_pipelines_gate_by_owner_and_member(spark):
    classes, fields, methods = tables(spark)
    items = spark.createDataFrame([(1, 0, 0, "ldc", "old"), (1, 1, 0, "ldc", "old"), (5, 0, 0, "ldc", "old")], "class_id int, method_ordinal int, item_ordinal int, kind string, ldc_string string")
    catalog = pipeline.Catalog(classes, fields, methods, items)
    steps = (
        pipeline.Pipeline()
        .on_classes(matchers.classes.named("c/Mixed"), transforms.remove_flags(0x10))
        .on_methods(matchers.methods.named("m"), transforms.add_interface("x/Marked"), owner=matchers.classes.flag("interface"))
        .on_each("fields", matchers.fields.named("x"), transforms.rename("renamed"), owner=matchers.classes.named("a/Good"))
        .on_code(matchers.methods.is_constructor(), transforms.replace_string("old", "new"))
        .custom(lambda c: c)
    )
    out = steps.apply(catalog)
    assert len(steps) == 5
    by_name = {r.name: r for r in out.classes.collect()}
    assert by_name["c/Mixed"].access_flags == 0x0400
    assert by_name["d/Face"].interfaces == ["x/Marked"] and by_name["a/Good"].interfaces == ["b/I"]
    assert sorted(r.name for r in out.fields.where("class_id = 1").collect()) == ["renamed", "renamed", "y", "z/w"]
    assert sorted((r.class_id, r.method_ordinal, r.ldc_string) for r in out.code_items.collect()) == [(1, 0, "new"), (1, 1, "old"), (5, 0, "old")]


def test_report_of_names_and_strings(spark):
    classes = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "rl4"), (4, "pkg/Normal")], "class_id int, name string")
    none = spark.createDataFrame([], MEMBER)
    items = spark.createDataFrame([(4, 0, 0, "ldc", 0x12, "hello there"), (4, 0, 1, "ldc", 0x12, "hello there"), (4, 0, 2, "branch", 0xA7, None), (4, 0, 3, "raw", 0, None), (4, 1, 0, "ldc", 0x12, "ab1")], "class_id int, method_ordinal int, item_ordinal int, kind string, opcode int, ldc_string string")
    metrics = deobfuscation_report.class_metrics(classes, none, none, items).persist()
    entries = spark.createDataFrame([("j", "compilercontrol.json", False, False, bytearray(b'[{"match":["ed::ad([B)V"],"c2":{"exclude":true}},{"match":["no"],"c2":{"exclude":false}}]'))], "archive string, entry_name string, is_class boolean, is_dir boolean, content binary")
    assert deobfuscation_report.totals(metrics, entries).first().asDict() == {"classes": 4, "suspicious": 2, "rl": 1, "resources": 1}
    assert [tuple(r) for r in deobfuscation_report.top_packages(metrics).collect()] == [("<root>", 3, 2), ("pkg", 1, 0)]
    assert [tuple(r) for r in deobfuscation_report.string_hints(metrics, items).collect()] == [("pkg/Normal", 1, ["hello there"])]
    assert [r.match for r in deobfuscation_report.excludes(entries).collect()] == ["ed::ad([B)V"]
    four = metrics.where("class_id = 4").first()
    assert (four.branches, four.nops, four.strings, four.methods) == (1, 1, 1, 0)


def test_dropped_archives_are_ingested_once(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()

    def put(name):
        with zipfile.ZipFile(drop / name, "w") as z:
            z.writestr("X.class", b"\xca\xfe\xba\xbe")

    run = lambda: ingest.start_ingest(spark, str(drop), f"{tmp_path}/lake", f"{tmp_path}/state").awaitTermination()
    put("a.jar")
    run()
    put("b.jar")
    run()
    run()
    found = spark.read.parquet(f"{tmp_path}/lake")
    assert found.count() == 2 and {r.error_kind for r in found.collect()} == {"truncated"}
    assert found.select(F.count_distinct("archive")).first()[0] == 2


def test_headers_by_the_numbers_of_their_constants(spark):
    from lodestone.plans import contents

    pool = spark.createDataFrame([(c, 1, 1, "java/lang/Object" if c == 3 else "a/B", None, None, None) for c in range(9)] + [(c, 2, 7, None, None, 1, None) for c in range(9)], "class_id int, cp_index int, tag int, utf8 string, bits long, ref1 int, ref2 int")
    magic = 0xCAFEBABE
    rows = [
        (1, magic, 52, 0, 0x21, 2, 2, [2], 1, 1), (2, 0xCAFE, 70, 0, 0x21, 0, 0, [1], 0, 0), (3, magic, 60, 0, 0x21, 2, 2, [], 0, 0), (4, magic, 56, 1, 0x21, 1, 9, [], 0, 0),
        (5, magic, 53, 3, 0x8000, 2, 2, [2], 1, 2), (6, magic, 69, 65535, 0x8000, 2, 0, [], 0, 0), (7, magic, 56, 65535, 0x21, 2, 2, None, 0, 0),
    ]
    headers = spark.createDataFrame(rows, "class_id int, magic long, major int, minor int, access_flags int, this_class int, super_class int, interfaces array<int>, n_fields int, n_methods int")
    assert {(r.class_id, r.message) for r in contents.header_rules(headers, pool).collect()} == {
        (2, "invalid magic 0x0000cafe"), (2, "invalid class version 70/0"), (2, "this_class must be non-zero"), (2, "non-root class must have non-zero super_class"), (2, "interface entry must reference CONSTANT_Class"),
        (3, "java/lang/Object must have super_class == 0"), (4, "invalid class version 56/1"), (4, "this_class must reference CONSTANT_Class"), (4, "super_class must reference CONSTANT_Class"),
        (5, "module class must have super_class == 0"), (5, "module class must not declare interfaces"), (5, "module class must not declare fields"), (5, "module class must not declare methods"),
    }


def test_labels_of_tables_beside_the_code(spark):
    items = spark.createDataFrame([(1, 0, "label", 3), (1, 0, "raw", None)], "class_id int, method_ordinal int, kind string, label_id int")
    methods = spark.createDataFrame([(1, 0, 1, "f", "()V")], MEMBER)
    handlers = spark.createDataFrame([(1, 0, 3, 4, 5)], "class_id int, method_ordinal int, start_label int, end_label int, handler_label int")
    lines = spark.createDataFrame([(1, 0, 3), (1, 0, 7)], "class_id int, method_ordinal int, label_id int")
    variables = spark.createDataFrame([(1, 0, "x", 3, 8)], "class_id int, method_ordinal int, name string, start_label int, end_label int")
    found = verify.label_rules(items, methods, handlers, lines, variables, variables).collect()
    assert sorted(r.message.removesuffix(" references label not in instruction stream") for r in found) == ["Exception handler end", "Exception handler handler", "Line number entry", "Local variable 'x' end", "Local variable type 'x' end"]
