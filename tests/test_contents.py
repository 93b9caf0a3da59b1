"""Checks of attribute contents, handles, record components and pool slots, each with rows that break them."""

import itertools

from lodestone.plans import contents, verify

POOL = "class_id int, cp_index int, tag int, utf8 string, bits long, ref1 int, ref2 int"
#: 1 text, 2 class, 3 class of nothing, 4 name and type, 5 handle, 6 module, 7 package, 8 int, 9 string, 10 a signature, 11 name and type of nothing.
CONSTANTS = [(1, 1, 1, "a/B", None, None, None), (1, 2, 7, None, None, 1, None), (1, 3, 7, None, None, 99, None), (1, 4, 12, None, None, 1, 1), (1, 5, 15, None, 5, 2, None), (1, 6, 19, None, None, 1, None), (1, 7, 20, None, None, 1, None), (1, 8, 3, None, 7, None, None), (1, 9, 8, None, None, 1, None), (1, 10, 1, "Ljava/util/List<TT;>;", None, None, None), (1, 11, 12, None, None, 1, 2)]
ATTRIBUTES = f"class_id int, owner_kind string, owner_ordinal int, name string, {contents.CONTENTS}"


def attribute(name, owner="class", **held):
    columns = ["index", "indexes", "class_index", "method_index", "bootstrap", "types", "module"]
    return (1, owner, 0, name, *(held.get(c) for c in columns))


def test_every_place_wants_its_kind(spark):
    pool = spark.createDataFrame(CONSTANTS, POOL)
    module = lambda n: (n, n, [(n, n), (n, 0)], [(n, [n, n])], [(n, [n])], [n, n], [(n, [n])])
    rows = [
        attribute("Signature", index=2), attribute("SourceFile", index=77), attribute("Exceptions", "method", indexes=[2, 3, 1]), attribute("EnclosingMethod", class_index=3, method_index=11), attribute("EnclosingMethod", class_index=2, method_index=0),
        attribute("MethodParameters", "method", indexes=[0, 1, 2]), attribute("BootstrapMethods", bootstrap=[(5, [8, 9, 6]), (2, []), (4, None)]), attribute("LocalVariableTypeTable", "code", types=[(1, 2), (2, 1)]),
        attribute("NestHost", index=1), attribute("NestMembers", indexes=[2, 6]), attribute("Module", module=module(8)), attribute("ModulePackages", indexes=[7, 6]), attribute("ModuleMainClass", index=0),
        attribute("PermittedSubclasses", indexes=[2, 2, 4]), attribute("PermittedSubclasses"), attribute("Own", index=99), attribute("Signature", "method", index=1),
    ]
    found = contents.content_rules(spark.createDataFrame(rows, ATTRIBUTES), pool, grammar=False).collect()
    got = sorted((r.attribute_name, r.path, r.cp_index) for r in found)
    want = [
        ("BootstrapMethods", "bootstrap[0].args[2]", 6), ("BootstrapMethods", "bootstrap[1].ref", 2), ("BootstrapMethods", "bootstrap[2].ref", 4), ("EnclosingMethod", "class_index", 3), ("EnclosingMethod", "method_index", 11),
        ("Exceptions", "indexes[1]", 3), ("Exceptions", "indexes[2]", 1), ("LocalVariableTypeTable", "types[0].signature", 2), ("LocalVariableTypeTable", "types[1].name", 2), ("MethodParameters", "indexes[2]", 2),
        ("ModuleMainClass", "index", 0), ("ModulePackages", "indexes[1]", 6), ("NestHost", "index", 1), ("NestMembers", "indexes[1]", 6), ("PermittedSubclasses", "indexes[2]", 4), ("Signature", "index", 2), ("SourceFile", "index", 77),
        *(("Module", f"module.{p}", 8) for p in ("name", "version", "requires[0].index", "requires[1].index", "requires[0].version", "exports[0].index", "exports[0].to[0]", "exports[0].to[1]", "opens[0].index", "opens[0].to[0]", "uses[0]", "uses[1]", "provides[0].index", "provides[0].to[0]")),
    ]
    assert got == sorted(want)
    assert {r.message for r in found} == {p.message for p in contents.PLACES}
    # All is well with the right kinds.
    right = (6, 1, [(6, 0)], [(7, [6])], [(7, [])], [2], [(2, [2])])
    assert contents.content_rules(spark.createDataFrame([attribute("Module", module=right), attribute("BootstrapMethods", bootstrap=[(5, [2, 5, 8, 9])])], ATTRIBUTES), pool).isEmpty()


def test_grammar_of_signatures(spark):
    pool = spark.createDataFrame(CONSTANTS, POOL)
    rows = [attribute("Signature", "class", index=10), attribute("Signature", "field", index=10), attribute("Signature", "record_component", index=1), attribute("Signature", "method", index=10), attribute("Signature", "code", index=1), attribute("LocalVariableTypeTable", "code", types=[(1, 10), (1, 1)])]
    found = contents.content_rules(spark.createDataFrame(rows, ATTRIBUTES), pool)
    assert sorted((r.owner_kind, r.message) for r in found.collect()) == [("code", "invalid local variable type signature"), ("method", "invalid method signature"), ("record_component", "invalid record component signature")]


def admitted(kind, tag, major, name):
    """None, or the rule that a handle breaks."""
    if not 1 <= kind <= 9:
        return "kind"
    targets = {9} if kind <= 4 else {11} if kind == 9 else {10, 11} if kind in (6, 7) and major >= 52 else {10}
    if tag not in targets:
        return "target"
    if kind == 8:
        return "init" if name is not None and name != "<init>" else None
    return "special" if kind in (5, 6, 7, 9) and name in ("<init>", "<clinit>") else None


def test_every_kind_of_handle_with_every_target(spark):
    rows, classes, want = [], [], {}
    for c, (kind, tag, major, name) in enumerate(itertools.product(range(11), (9, 10, 11, 7, None), (51, 52), ("m", "<init>", "<clinit>", None))):
        classes.append((c, major))
        rows += [(c, 1, 15, None, kind, 2, None)]
        if tag is not None:
            rows += [(c, 2, tag, None, None, 5, 3), (c, 3, 12, None, None, 4, 4)]
        if name is not None:
            rows.append((c, 4, 1, name, None, None, None))
        if broken := admitted(kind, tag, major, name):
            want[c] = broken
    found = contents.handle_rules(spark.createDataFrame(rows, POOL), spark.createDataFrame(classes, "class_id int, major int")).collect()
    kinds = {contents._NO_KIND: "kind", contents._NOT_INIT: "init", contents._SPECIAL: "special"}
    assert len(found) == len(want) and {r.class_id: kinds.get(r.message, "target") for r in found} == want


def test_components_and_their_attributes(spark):
    classes = spark.createDataFrame([(1, "r/R", 60, 0x11), (2, "r/Old", 50, 0x11)], "class_id int, name string, major int, access_flags int")
    rows = [
        (1, 0, "x", "I", ["Signature", "Signature", "Own", "Own"]), (1, 1, None, "I", ["RuntimeVisibleAnnotations"]), (1, 2, "y", "Q", ["Code", "Code"]), (1, 3, "z", None, None), (1, 4, "x", "I", ["Signature"]),
        (2, 0, "m", "[J", ["Module", "NestHost"]),
    ]
    components = spark.createDataFrame(rows, "class_id int, component_ordinal int, name string, descriptor string, attributes array<string>")
    got = sorted((r.class_id, r.component_ordinal, r.attribute_name, r.message) for r in contents.component_rules(components, classes).collect())
    assert got == sorted([
        (1, 0, "Signature", "record component must not declare multiple Signature attributes"), (1, 1, "Record", "record component name_index must reference Utf8"),
        (1, 2, "Record", "invalid record component descriptor"), (1, 2, "Code", "Code attribute is not allowed on record component"), (1, 2, "Code", "Code attribute is not allowed on record component"),
        (1, 2, "Code", "record component must not declare multiple Code attributes"), (1, 3, "Record", "invalid record component descriptor"),
        (2, 0, "Module", "Module attribute is not allowed on record component"), (2, 0, "Module", "Module attribute is only allowed on module classes"), (2, 0, "Module", "Module attribute requires class file version 53.0 or newer"),
        (2, 0, "NestHost", "NestHost attribute is not allowed on record component"), (2, 0, "NestHost", "NestHost attribute requires class file version 55.0 or newer"),
    ])


def slots_by_hand(slots):
    """Messages of a list of tags, None for an empty slot."""
    if not slots:
        return [(None, "constant pool must include slot 0")]
    out, gap = [], False
    if slots[0] is not None:
        out.append((0, "constant pool slot 0 must be empty"))
    for i, tag in enumerate(slots[1:], 1):
        if gap:
            if tag is not None:
                out.append((i, "long/double constant-pool entry must be followed by an empty gap slot"))
            gap = False
        elif tag is None:
            out.append((i, "unexpected empty constant-pool slot"))
        else:
            gap = tag in (5, 6)
    return [*out, (None, "long/double constant-pool entry is missing its trailing gap slot")] if gap else out


def test_slots_of_random_pools(spark):
    import random

    rng = random.Random(4)
    pools = [[], [None], [3], [None, 5], [None, 5, None], [None, 5, 6, 5, None]] + [[rng.choice([None, None, 3])] + [rng.choice([1, 5, 6, 5, None, 7]) for _ in range(rng.randint(0, 12))] for _ in range(150)]
    rows = [(c, i, tag, None, None, 1, 1) for c, p in enumerate(pools) for i, tag in enumerate(p) if tag is not None]
    classes = spark.createDataFrame([(c, len(p)) for c, p in enumerate(pools)], "class_id int, slots int")
    got = sorted(((r.class_id, r.cp_index, r.message) for r in contents.slot_rules(spark.createDataFrame(rows, POOL), classes).collect()), key=repr)
    assert got == sorted(((c, *x) for c, p in enumerate(pools) for x in slots_by_hand(p)), key=repr)


def test_empty_tables(spark):
    pool, classes = spark.createDataFrame([], POOL), spark.createDataFrame([], "class_id int, name string, major int, access_flags int, slots int")
    assert contents.all_pool_rules(pool, classes).isEmpty() and contents.content_rules(spark.createDataFrame([], ATTRIBUTES), pool).isEmpty()
    assert set(verify.ALLOWED) == {"class", "field", "method", "code"}
