"""Structural checks of a corpus: rules over its tables that give violation rows.

Columns: severity, category, message, class_id, class_name, member_name,
member_descriptor, attribute_name, cp_index.  Every rule is a filter, a join or
a grouping; class-level facts reach the members by one join on class_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import descriptors
from lodestone.functions.flags import CLASS_FLAGS, FIELD_FLAGS, METHOD_FLAGS, VISIBILITY, has_all, has_any
from lodestone.operators.rules import Rule, gather, violations

LOCATION = ["class_id", "class_name", "member_name", "member_descriptor", "attribute_name", "cp_index"]

# Fixed values of the class-file format: owners of attributes, first versions, attributes of module classes.
_ANNOTATIONS = "RuntimeVisibleAnnotations RuntimeInvisibleAnnotations RuntimeVisibleTypeAnnotations RuntimeInvisibleTypeAnnotations".split()
ALLOWED = {
    "class": "Signature SourceFile SourceDebugExtension Synthetic Deprecated InnerClasses EnclosingMethod NestHost NestMembers BootstrapMethods Module ModulePackages ModuleMainClass Record PermittedSubclasses".split() + _ANNOTATIONS,
    "field": "ConstantValue Signature Synthetic Deprecated".split() + _ANNOTATIONS,
    "method": "Signature Synthetic Deprecated Exceptions Code MethodParameters AnnotationDefault RuntimeVisibleParameterAnnotations RuntimeInvisibleParameterAnnotations".split() + _ANNOTATIONS,
    "code": "StackMapTable LineNumberTable LocalVariableTable LocalVariableTypeTable RuntimeVisibleTypeAnnotations RuntimeInvisibleTypeAnnotations".split(),
}
FIRST_MAJOR = {"StackMapTable": 50, "BootstrapMethods": 51, "MethodParameters": 52, "Module": 53, "ModulePackages": 53, "ModuleMainClass": 53, "NestHost": 55, "NestMembers": 55, "Record": 60, "PermittedSubclasses": 61}
MODULE_ONLY = ["Module", "ModulePackages", "ModuleMainClass"]


# The texts of the checks below.


def _quoted(name: Column | str) -> Column:
    return F.concat(F.lit('"'), F.col(name) if isinstance(name, str) else name, F.lit('"'))


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _hex(bits: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.hex(bits), 4, "0"))


def internal_name(name: Column) -> Column:
    return (name != "") & ~name.startswith("/") & ~name.endswith("/") & ~name.contains("//") & ~name.rlike(r"[.;\[]")


def unqualified_name(name: Column) -> Column:
    return (name != "") & ~name.rlike(r"[.;\[/]")


def method_name(name: Column) -> Column:
    return name.isin("<init>", "<clinit>") | ((name != "") & ~name.rlike(r"[.;\[/<>]"))


def _many_visible(flags: Column) -> Column:
    return F.bit_count(flags.bitwiseAND(F.lit(VISIBILITY))) > 1


def class_rules(classes: DataFrame) -> DataFrame:
    """Names, interfaces and flags of classes (class_id, name, super_name, interfaces, access_flags)."""
    flags = F.col("access_flags")
    on = lambda name: has_all(flags, CLASS_FLAGS[name])
    above = F.col("super_name")
    foreign = flags.bitwiseAND(F.lit(0xFFFF & ~(CLASS_FLAGS["MODULE"] | CLASS_FLAGS["SYNTHETIC"])))
    rules = [
        Rule("class_structure", _text("Invalid class name: ", _quoted("name")), ~internal_name(F.col("name"))),
        Rule("class_structure", _text("Invalid super class name: ", _quoted("super_name")), above.isNotNull() & ~internal_name(above)),
        Rule("class_structure", "No superclass (only valid for java/lang/Object)", above.isNull() & (F.col("name") != "java/lang/Object"), "WARNING"),
        Rule("access_flags", "INTERFACE class must also be ABSTRACT", on("INTERFACE") & ~on("ABSTRACT")),
        Rule("access_flags", "INTERFACE class must not be FINAL", on("INTERFACE") & on("FINAL")),
        Rule("access_flags", "INTERFACE class must not be ENUM", on("INTERFACE") & on("ENUM")),
        Rule("access_flags", "ANNOTATION class must also be INTERFACE", on("ANNOTATION") & ~on("INTERFACE")),
        Rule("access_flags", _text("MODULE class has unexpected flags: ", _hex(foreign)), on("MODULE") & (foreign != 0)),
        Rule("access_flags", "Class cannot be both FINAL and ABSTRACT", on("FINAL") & on("ABSTRACT") & ~on("INTERFACE")),
    ]
    place = {"class_id": "class_id", "class_name": "name"}
    each = classes.select("class_id", "name", F.posexplode("interfaces").alias("at", "interface"))
    nth = F.row_number().over(Window.partitionBy("class_id", "interface").orderBy("at"))
    each = each.withColumn("nth", nth)
    interfaces = [
        Rule("class_structure", _text("Invalid interface name: ", _quoted("interface")), ~internal_name(F.col("interface"))),
        Rule("class_structure", _text("Duplicate interface: ", _quoted("interface")), F.col("nth") > 1),
    ]
    return violations(classes, rules, place).unionByName(violations(each, interfaces, place))


def _with_class(members: DataFrame, classes: DataFrame) -> DataFrame:
    about = classes.select("class_id", F.col("name").alias("class_name"), "major", has_all(F.col("access_flags"), CLASS_FLAGS["INTERFACE"]).alias("in_interface"))
    nth = F.row_number().over(Window.partitionBy("class_id", "name", "descriptor").orderBy("ordinal"))
    return members.join(about, "class_id").withColumn("nth", nth)


_MEMBER = {"class_id": "class_id", "class_name": "class_name", "member_name": "name", "member_descriptor": "descriptor"}


def field_rules(fields: DataFrame, classes: DataFrame) -> DataFrame:
    flags, name = F.col("access_flags"), _quoted("name")
    rules = [
        Rule("class_structure", _text("Duplicate field: ", F.col("name"), " ", F.col("descriptor")), F.col("nth") > 1),
        Rule("field", _text("Invalid field name: ", name), ~unqualified_name(F.col("name"))),
        Rule("descriptor", _text("Invalid field descriptor: ", _quoted("descriptor")), ~descriptors.is_field_descriptor(F.col("descriptor"))),
        Rule("access_flags", _text("Field ", name, " has multiple visibility modifiers"), _many_visible(flags)),
        Rule("access_flags", _text("Field ", name, " cannot be both FINAL and VOLATILE"), has_all(flags, FIELD_FLAGS["FINAL"] | FIELD_FLAGS["VOLATILE"])),
        Rule("access_flags", _text("Interface field ", name, " must be PUBLIC STATIC FINAL"), F.col("in_interface") & ~has_all(flags, 0x0019)),
    ]
    return violations(_with_class(fields, classes), rules, _MEMBER)


def method_rules(methods: DataFrame, classes: DataFrame) -> DataFrame:
    flags, name, quoted = F.col("access_flags"), F.col("name"), _quoted("name")
    bits = lambda *names: sum(METHOD_FLAGS[n] for n in names)
    on = lambda n: has_all(flags, METHOD_FLAGS[n])
    barred = flags.bitwiseAND(F.lit(bits("PRIVATE", "STATIC", "FINAL", "SYNCHRONIZED", "NATIVE", "STRICT")))
    barred_init = flags.bitwiseAND(F.lit(bits("STATIC", "FINAL", "SYNCHRONIZED", "NATIVE", "ABSTRACT", "BRIDGE")))
    plain = F.col("in_interface") & ~name.isin("<clinit>", "<init>")
    empty = on("ABSTRACT") | on("NATIVE")
    old = F.col("major") < 52
    rules = [
        Rule("class_structure", _text("Duplicate method: ", name, F.col("descriptor")), F.col("nth") > 1),
        Rule("method", _text("Invalid method name: ", quoted), ~method_name(name)),
        Rule("descriptor", _text("Invalid method descriptor: ", _quoted("descriptor")), ~descriptors.is_method_descriptor(F.col("descriptor"))),
        Rule("access_flags", _text("Method ", quoted, " has multiple visibility modifiers"), _many_visible(flags)),
        Rule("access_flags", _text("ABSTRACT method ", quoted, " has illegal flags: ", _hex(barred)), on("ABSTRACT") & (barred != 0)),
        Rule("access_flags", _text("Interface method ", quoted, " must be PUBLIC ABSTRACT (pre-Java 8)"), plain & old & ~has_all(flags, bits("PUBLIC", "ABSTRACT"))),
        Rule("access_flags", _text("Interface method ", quoted, " must be PUBLIC (or PRIVATE for Java 9+)"), plain & ~old & ~on("PUBLIC") & ((F.col("major") < 53) | ~on("PRIVATE"))),
        Rule("method", _text("<init> has illegal flags: ", _hex(barred_init)), (name == "<init>") & (barred_init != 0)),
        Rule("method", "<clinit> must be STATIC", (name == "<clinit>") & ~on("STATIC")),
        Rule("method", _text("<clinit> must have descriptor ()V, got ", _quoted("descriptor")), (name == "<clinit>") & (F.col("descriptor") != "()V")),
        Rule("method", _text(F.when(on("ABSTRACT"), "ABSTRACT").otherwise("NATIVE"), " method ", quoted, " must not have code"), empty & F.col("has_code")),
        Rule("method", _text("Method ", quoted, " must have code"), ~empty & ~F.col("has_code")),
    ]
    return violations(_with_class(methods, classes), rules, _MEMBER)


def attribute_rules(attributes: DataFrame, classes: DataFrame) -> DataFrame:
    """Places, versions and numbers of attributes (class_id, owner_kind, owner_ordinal, name); unknown ones may be anywhere."""
    known = sorted({n for names in ALLOWED.values() for n in names})
    about = classes.select("class_id", F.col("name").alias("class_name"), "major", has_any(F.col("access_flags"), CLASS_FLAGS["MODULE"]).alias("is_module"))
    rows = attributes.withColumnRenamed("name", "attribute_name").join(about, "class_id")
    name, owner = F.col("attribute_name"), F.col("owner_kind")
    allowed = F.lit(False)
    for kind, names in ALLOWED.items():
        allowed = allowed | ((owner == kind) & name.isin(names))
    first = F.create_map(*(F.lit(x) for pair in FIRST_MAJOR.items() for x in pair))[name]
    rules = [
        Rule("attribute", _text(name, " attribute is not allowed on ", owner), name.isin(known) & ~allowed),
        Rule("attribute", _text(name, " attribute is only allowed on module classes"), name.isin(MODULE_ONLY) & ~F.col("is_module")),
        Rule("attribute", _text(name, " attribute requires class file version ", first.cast("string"), ".0 or newer"), F.col("major") < first),
    ]
    place = {"class_id": "class_id", "class_name": "class_name", "attribute_name": "attribute_name"}
    several = rows.where(name.isin(known)).groupBy("class_id", "class_name", "owner_kind", "owner_ordinal", "attribute_name").agg(F.count("*").alias("n"))
    twice = [Rule("attribute", _text(owner, " must not declare multiple ", name, " attributes"), F.col("n") > 1)]
    modules = about.where("is_module").join(rows.where((owner == "class") & (name == "Module")).groupBy("class_id").agg(F.count("*").alias("n")), "class_id", "left")
    modules = modules.withColumn("attribute_name", F.lit("Module"))
    single = [Rule("attribute", "module class must declare exactly one Module attribute", F.coalesce("n", F.lit(0)) != 1)]
    return violations(rows, rules, place).unionByName(violations(several, twice, place)).unionByName(violations(modules, single, place))


def pool_rules(pool: DataFrame) -> DataFrame:
    """Links between constants (class_id, cp_index, tag, utf8, ref1, ref2): each refers to constants of the right kind."""
    target = lambda n: pool.select("class_id", F.col("cp_index").alias(f"ref{n}"), F.col("tag").alias(f"tag{n}"), F.col("utf8").alias(f"utf8_{n}"), F.col("ref2").alias(f"second{n}"))
    linked = pool.where(~F.col("tag").isin(1, 3, 4, 5, 6)).join(target(1), ["class_id", "ref1"], "left").join(target(2), ["class_id", "ref2"], "left")
    typed = pool.select("class_id", F.col("cp_index").alias("second2"), F.col("utf8").alias("type2"))
    linked = linked.join(typed, ["class_id", "second2"], "left")
    tag = F.col("tag")
    tag1, tag2 = F.coalesce("tag1", F.lit(0)), F.coalesce("tag2", F.lit(0))
    member, dynamic = tag.isin(9, 10, 11), tag.isin(17, 18)
    kind = F.when(tag == 9, "field reference").when(tag == 10, "method reference").otherwise("interface method reference")
    is_field, is_method = descriptors.is_field_descriptor(F.col("type2")), descriptors.is_method_descriptor(F.col("type2"))
    found_type = F.col("type2").isNotNull()
    rules = [
        Rule("constant_pool", "class entry references invalid Utf8 name", (tag == 7) & (tag1 != 1)),
        Rule("constant_pool", "string entry references invalid Utf8 payload", (tag == 8) & (tag1 != 1)),
        Rule("constant_pool", "member reference has invalid class_index", member & (tag1 != 7)),
        Rule("constant_pool", "member reference has invalid name_and_type_index", member & (tag2 != 12)),
        Rule("constant_pool", _text(kind, F.when(tag == 9, " descriptor must be a field descriptor").otherwise(" descriptor must be a method descriptor")), member & found_type & F.when(tag == 9, ~is_field).otherwise(~is_method)),
        Rule("constant_pool", "name_and_type entry references invalid Utf8 name", (tag == 12) & (tag1 != 1)),
        Rule("constant_pool", "name_and_type entry references invalid Utf8 descriptor", (tag == 12) & (tag2 != 1)),
        Rule("constant_pool", "method type entry references invalid Utf8 descriptor", (tag == 16) & (tag1 != 1)),
        Rule("constant_pool", "method type descriptor must be a method descriptor", (tag == 16) & (tag1 == 1) & ~descriptors.is_method_descriptor(F.col("utf8_1"))),
        Rule("constant_pool", "dynamic entry has invalid name_and_type_index", dynamic & (tag2 != 12)),
        Rule("constant_pool", "dynamic entry descriptor must be a field descriptor", (tag == 17) & found_type & ~is_field),
        Rule("constant_pool", "invokedynamic entry descriptor must be a method descriptor", (tag == 18) & found_type & ~is_method),
        Rule("constant_pool", "module/package entry references invalid Utf8 name", tag.isin(19, 20) & (tag1 != 1)),
    ]
    return violations(linked, rules, {"class_id": "class_id", "cp_index": "cp_index"})


def code_rules(items: DataFrame, methods: DataFrame) -> DataFrame:
    """Methods without instructions, and jumps to labels that aren't there (class_id, method_ordinal, kind, label_id, target_label, ...)."""
    by = ["class_id", "method_ordinal"]
    heads = methods.select("class_id", F.col("ordinal").alias("method_ordinal"), F.col("name").alias("member_name"), F.col("descriptor").alias("member_descriptor"), "has_code")
    counts = heads.where("has_code").join(items.where("kind != 'label'").groupBy(*by).agg(F.count("*").alias("n")), by, "left")
    empty = [Rule("code", "Code has empty instruction list", F.coalesce("n", F.lit(0)) == 0, "WARNING")]
    told = F.array_compact(F.array(
        F.struct(F.lit("branch target").alias("context"), F.col("target_label").alias("label_id")),
        F.struct(F.lit("switch default").alias("context"), F.col("switch_default").alias("label_id")),
    ))
    cases = F.transform(F.coalesce("switch_labels", F.array().cast("array<int>")), lambda x: F.struct(F.lit("switch case").alias("context"), x.alias("label_id")))
    used = items.select(*by, F.explode(F.concat(told, cases)).alias("u")).select(*by, "u.*").where("label_id is not null")
    missing = used.join(items.where("kind = 'label'").select(*by, "label_id"), [*by, "label_id"], "left_anti").join(heads, by)
    dangling = [Rule("code", _text(F.col("context"), " references label not in instruction stream"), F.lit(True))]
    place = {c: c for c in ("class_id", "member_name", "member_descriptor")}
    return violations(counts, empty, place).unionByName(violations(missing, dangling, place))


def label_rules(items: DataFrame, methods: DataFrame, handlers: DataFrame | None = None, lines: DataFrame | None = None, variables: DataFrame | None = None, variable_types: DataFrame | None = None) -> DataFrame:
    """Labels of tables beside the code (class_id, method_ordinal, ...) that are not among the items' labels.

    handlers: (start_label, end_label, handler_label); lines: (label_id); variables, variable_types: (name, start_label, end_label).
    """
    by = ["class_id", "method_ordinal"]
    ends = lambda df, what: (df, [(F.concat(F.lit(f"{what} '"), F.col("name"), F.lit(f"' {e}")), f"{e}_label") for e in ("start", "end")])
    tables = []
    if handlers is not None:
        tables.append((handlers, [(F.lit(f"Exception handler {e}"), f"{e}_label") for e in ("start", "end", "handler")]))
    if lines is not None:
        tables.append((lines, [(F.lit("Line number entry"), "label_id")]))
    if variables is not None:
        tables.append(ends(variables, "Local variable"))
    if variable_types is not None:
        tables.append(ends(variable_types, "Local variable type"))
    told = [df.select(*by, F.explode(F.array(*(F.struct(c.alias("context"), F.col(label).cast("bigint").alias("label_id")) for c, label in uses))).alias("u")).select(*by, "u.*") for df, uses in tables]
    if not told:
        raise ValueError("no table of labels is given")
    heads = methods.select("class_id", F.col("ordinal").alias("method_ordinal"), F.col("name").alias("member_name"), F.col("descriptor").alias("member_descriptor"))
    known = items.where("kind = 'label'").select(*by, F.col("label_id").cast("bigint").alias("label_id"))
    missing = reduce(DataFrame.unionAll, told).join(known, [*by, "label_id"], "left_anti").join(heads, by)
    rule = Rule("code", _text(F.col("context"), " references label not in instruction stream"), F.lit(True))
    return violations(missing, [rule], {c: c for c in ("class_id", "member_name", "member_descriptor")})


def simulation_rules(frames: DataFrame, methods: DataFrame) -> DataFrame:
    """Methods whose simulation fails; frames as from lodestone.operators.frames, keyed by class_id."""
    heads = methods.select("class_id", F.col("ordinal").alias("method_ordinal"), F.col("name").alias("member_name"), F.col("descriptor").alias("member_descriptor"))
    failed = frames.where("error is not null").join(heads, ["class_id", "method_ordinal"])
    return violations(failed, [Rule("code", F.col("error"), F.lit(True))], {c: c for c in ("class_id", "member_name", "member_descriptor")})


def stale_debug_rules(classes: DataFrame) -> DataFrame:
    """Classes (class_id, name, debug_state) whose debug data is marked stale."""
    rule = Rule("attribute", "Class debug metadata is marked stale and will be stripped during lowering", F.col("debug_state") == "stale", "WARNING")
    return violations(classes, [rule], {"class_id": "class_id", "class_name": "name"})


def verify(classes: DataFrame, fields: DataFrame, methods: DataFrame, attributes: DataFrame | None = None, pool: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """All violations of a corpus; tables that are not given are not checked."""
    found = [class_rules(classes), field_rules(fields, classes), method_rules(methods, classes)]
    if attributes is not None:
        found.append(attribute_rules(attributes, classes))
    if pool is not None:
        found.append(pool_rules(pool))
    if items is not None:
        found.append(code_rules(items, methods))
    typed = {"class_id": None, "class_name": "string", "member_name": "string", "member_descriptor": "string", "attribute_name": "string", "cp_index": "int"}
    whole = []
    for df in found:
        missing = {c: F.lit(None).cast(k) for c, k in typed.items() if k and c not in df.columns}
        whole.append(df.withColumns(missing) if missing else df)
    return gather(*whole, columns=LOCATION)


def has_errors(found: DataFrame) -> bool:
    """Whether any violation is an ERROR: stops at the first."""
    return not found.where("severity = 'ERROR'").limit(1).isEmpty()
