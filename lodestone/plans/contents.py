"""Checks of what attributes, method handles, record components and constant pools hold.

All references out of attributes become one typed table: whose it is, the
attribute, the path inside of it, the index, and the kind of constant that it
wants.  Nested lists are flattened with their places in the path.  What the pool
offers is such a table too, so one anti-join checks every kind of reference.
Method handles are looked up in a small decision table; a handle that no line
admits is a violation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import descriptors, signatures
from lodestone.operators.rules import Rule, violations
from lodestone.plans.verify import ALLOWED, FIRST_MAJOR, MODULE_ONLY, pool_rules

#: Attributes (class_id, owner_kind, owner_ordinal, name) with what they hold; of a row's columns only those of its attribute are filled.
CONTENTS = (
    "`index` int, indexes array<int>, class_index int, method_index int, bootstrap array<struct<ref: int, args: array<int>>>, types array<struct<name: int, signature: int>>, "
    "module struct<name: int, version: int, requires: array<struct<`index`: int, version: int>>, exports: array<struct<`index`: int, `to`: array<int>>>, "
    "opens: array<struct<`index`: int, `to`: array<int>>>, uses: array<int>, provides: array<struct<`index`: int, `to`: array<int>>>>"
)


@dataclass(frozen=True)
class Place:
    attribute: str
    #: Names of columns and fields, [] behind those that are lists.
    path: str
    wanted: str
    message: str
    #: Whether index 0 stands for nothing.
    or_zero: bool = False


# Fixed values of the class-file format: where attributes refer to constants, of which kind, and the texts of the checks.
PLACES = [
    Place("Signature", "index", "utf8", "Signature attribute must reference a Utf8 signature"),
    Place("SourceFile", "index", "utf8", "SourceFile attribute must reference a Utf8 source file name"),
    Place("Exceptions", "indexes[]", "class", "Exceptions attribute entries must reference CONSTANT_Class"),
    Place("EnclosingMethod", "class_index", "class", "EnclosingMethod attribute class_index must reference CONSTANT_Class"),
    Place("EnclosingMethod", "method_index", "name_and_type", "EnclosingMethod attribute method_index must reference CONSTANT_NameAndType or be zero", True),
    Place("MethodParameters", "indexes[]", "utf8", "MethodParameters names must reference Utf8 or be zero", True),
    Place("BootstrapMethods", "bootstrap[].ref", "method_handle", "BootstrapMethods bootstrap_method_ref must reference CONSTANT_MethodHandle"),
    Place("BootstrapMethods", "bootstrap[].args[]", "loadable", "BootstrapMethods arguments must reference loadable constants"),
    Place("LocalVariableTypeTable", "types[].name", "utf8", "LocalVariableTypeTable name_index must reference Utf8"),
    Place("LocalVariableTypeTable", "types[].signature", "utf8", "LocalVariableTypeTable signature_index must reference Utf8"),
    Place("NestHost", "index", "class", "NestHost attribute must reference CONSTANT_Class"),
    Place("NestMembers", "indexes[]", "class", "NestMembers entries must reference CONSTANT_Class"),
    Place("Module", "module.name", "module", "Module attribute must reference CONSTANT_Module for module_name_index"),
    Place("Module", "module.version", "utf8", "Module attribute module_version_index must reference Utf8 or be zero", True),
    Place("Module", "module.requires[].index", "module", "Module requires entries must reference CONSTANT_Module"),
    Place("Module", "module.requires[].version", "utf8", "Module requires version indices must reference Utf8 or be zero", True),
    Place("Module", "module.exports[].index", "package", "Module exports entries must reference CONSTANT_Package"),
    Place("Module", "module.exports[].to[]", "module", "Module exports targets must reference CONSTANT_Module"),
    Place("Module", "module.opens[].index", "package", "Module opens entries must reference CONSTANT_Package"),
    Place("Module", "module.opens[].to[]", "module", "Module opens targets must reference CONSTANT_Module"),
    Place("Module", "module.uses[]", "class", "Module uses entries must reference CONSTANT_Class"),
    Place("Module", "module.provides[].index", "class", "Module provides entries must reference CONSTANT_Class"),
    Place("Module", "module.provides[].to[]", "class", "Module provides targets must reference CONSTANT_Class"),
    Place("ModulePackages", "indexes[]", "package", "ModulePackages entries must reference CONSTANT_Package"),
    Place("ModuleMainClass", "index", "class", "ModuleMainClass attribute must reference CONSTANT_Class"),
    Place("PermittedSubclasses", "indexes[]", "class", "PermittedSubclasses entries must reference CONSTANT_Class"),
]
#: Tags of constants that bootstrap arguments may be.
LOADABLE = [3, 4, 5, 6, 7, 8, 15, 16, 17]


def _references(place: Place) -> Column:
    """array<struct<path, index>> of what stands at a place of a row; paths have places in lists, from 0."""
    steps = [(s.removesuffix("[]"), s.endswith("[]")) for s in place.path.split(".")]
    none = F.array().cast("array<struct<path: string, index: int>>")

    def from_(value: Column, path: Column, rest: list[tuple[str, bool]]) -> Column:
        if not rest:
            return F.array(F.struct(path.alias("path"), value.cast("int").alias("index")))
        (name, many), rest = rest[0], rest[1:]
        inner, path = value[name], F.concat(path, F.lit(f".{name}"))
        if not many:
            return from_(inner, path, rest)
        return F.coalesce(F.flatten(F.transform(inner, lambda x, i: from_(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), rest))), none)

    (name, many), rest = steps[0], steps[1:]
    if many:
        told = F.flatten(F.transform(name, lambda x, i: from_(x, F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]")), rest)))
    else:
        told = from_(F.col(name), F.lit(name), rest)
    return F.coalesce(told, none)


def references(attributes: DataFrame) -> DataFrame:
    """(class_id, owner_kind, owner_ordinal, attribute_name, path, index, wanted, or_zero, message) of the attributes' references."""
    none = F.array().cast("array<struct<path: string, index: int, wanted: string, or_zero: boolean, message: string>>")

    def typed(place: Place) -> Column:
        about = [F.lit(place.wanted).alias("wanted"), F.lit(place.or_zero).alias("or_zero"), F.lit(place.message).alias("message")]
        here = F.transform(_references(place), lambda x: F.struct(x.path.alias("path"), x["index"].alias("index"), *about))
        return F.when(F.col("name") == place.attribute, here).otherwise(none)

    told = [typed(place) for place in PLACES]
    rows = attributes.where(F.col("name").isin(sorted({p.attribute for p in PLACES})))
    rows = rows.select("class_id", "owner_kind", "owner_ordinal", F.col("name").alias("attribute_name"), F.explode(F.concat(*told)).alias("r"))
    return rows.select("class_id", "owner_kind", "owner_ordinal", "attribute_name", "r.*").where("index is not null")


def offers(pool: DataFrame) -> DataFrame:
    """(class_id, index, wanted): what each constant can be referred to as, if its own references hold."""
    text = lambda n: pool.where("tag = 1").select("class_id", F.col("cp_index").alias(f"ref{n}"), F.lit(True).alias(f"_text{n}"))
    known = pool.select("class_id", "cp_index", "tag", "ref1", "ref2").join(text(1), ["class_id", "ref1"], "left").join(text(2), ["class_id", "ref2"], "left")
    tag, first, second = F.col("tag"), F.coalesce("_text1", F.lit(False)), F.coalesce("_text2", F.lit(False))
    kinds = [
        F.when(tag == 1, "utf8"), F.when((tag == 7) & first, "class"), F.when((tag == 12) & first & second, "name_and_type"), F.when(tag == 15, "method_handle"),
        F.when((tag == 19) & first, "module"), F.when((tag == 20) & first, "package"), F.when(tag.isin(LOADABLE), "loadable"),
    ]
    return known.select("class_id", F.col("cp_index").alias("index"), F.explode(F.array_compact(F.array(*kinds))).alias("wanted"))


def content_rules(attributes: DataFrame, pool: DataFrame, grammar: bool = True) -> DataFrame:
    """References of attributes that no constant of the wanted kind answers, with their path; with `grammar`, signatures that are none."""
    told = references(attributes)
    place = {"class_id": "class_id", "owner_kind": "owner_kind", "owner_ordinal": "owner_ordinal", "attribute_name": "attribute_name", "path": "path", "cp_index": "index"}
    asked = told.where(~(F.col("or_zero") & (F.col("index") == 0)))
    missing = asked.join(offers(pool), ["class_id", "index", "wanted"], "left_anti")
    found = violations(missing, [Rule("constant_pool", F.col("message"), F.lit(True))], place)
    if not grammar:
        return found
    texts = pool.where("tag = 1").select("class_id", F.col("cp_index").alias("index"), "utf8")
    signed = told.where("attribute_name = 'Signature' or path like 'types[%].signature'").join(texts, ["class_id", "index"])
    owner, text = F.col("owner_kind"), F.col("utf8")
    kind = F.when(F.col("attribute_name") != "Signature", "local variable type").when(owner == "record_component", "record component").otherwise(owner)
    rules = [
        Rule("attribute", F.concat(F.lit("invalid "), kind, F.lit(" signature")), ~F.when(kind == "class", signatures.is_valid("class")(text)).when(kind == "method", signatures.is_valid("method")(text)).when(kind == "code", True).otherwise(signatures.is_valid("field")(text)))
    ]
    return found.unionByName(violations(signed, rules, place))


# Fixed values of the class-file format: for each kind of handle the tag of its target, the first major version, and the names that it may have.
HANDLES = [
    (1, 9, 0, "any"),
    (2, 9, 0, "any"),
    (3, 9, 0, "any"),
    (4, 9, 0, "any"),
    (5, 10, 0, "method"),
    (6, 10, 0, "method"),
    (6, 11, 52, "method"),
    (7, 10, 0, "method"),
    (7, 11, 52, "method"),
    (8, 10, 0, "<init>"),
    (9, 11, 0, "method"),
]
# The texts of the checks.
_NO_KIND = "method handle reference_kind must be in 1..=9"
_TARGETS = {
    1: "field-access method handles must reference CONSTANT_Fieldref",
    2: "field-access method handles must reference CONSTANT_Fieldref",
    3: "field-access method handles must reference CONSTANT_Fieldref",
    4: "field-access method handles must reference CONSTANT_Fieldref",
    5: "REF_invokeVirtual method handle must reference CONSTANT_Methodref",
    6: "REF_invokeStatic and REF_invokeSpecial method handles must reference CONSTANT_Methodref or CONSTANT_InterfaceMethodref",
    7: "REF_invokeStatic and REF_invokeSpecial method handles must reference CONSTANT_Methodref or CONSTANT_InterfaceMethodref",
    8: "REF_newInvokeSpecial method handle must reference CONSTANT_Methodref",
    9: "REF_invokeInterface method handle must reference CONSTANT_InterfaceMethodref",
}
_NOT_INIT = "REF_newInvokeSpecial method handle must reference <init>"
_SPECIAL = "method handles of kind REF_invokeVirtual/Static/Special/InterfaceSpecial must not reference <init> or <clinit>"


def handle_rules(pool: DataFrame, classes: DataFrame) -> DataFrame:
    """Method handles (tag 15: bits the kind, ref1 the target) that no line of HANDLES admits; classes: (class_id, major).

    A target whose name cannot be found has no name to break a rule; pool_rules tells of it.
    """
    table = pool.sparkSession.createDataFrame(HANDLES, "_kind int, _tag int, _first int, _names string")
    handles = pool.where("tag = 15").select("class_id", "cp_index", F.col("bits").cast("int").alias("kind"), F.col("ref1").alias("target"))
    members = pool.where("tag in (9, 10, 11)").select("class_id", F.col("cp_index").alias("target"), F.col("tag").alias("target_tag"), F.col("ref2").alias("named"))
    named = pool.where("tag = 12").select("class_id", F.col("cp_index").alias("named"), F.col("ref1").alias("text"))
    texts = pool.where("tag = 1").select("class_id", F.col("cp_index").alias("text"), F.col("utf8").alias("target_name"))
    rows = handles.join(classes.select("class_id", "major"), "class_id").join(members, ["class_id", "target"], "left").join(named, ["class_id", "named"], "left").join(texts, ["class_id", "text"], "left")
    fits = (F.col("_kind") == F.col("kind")) & (F.col("_tag") == F.col("target_tag")) & (F.col("_first") <= F.col("major"))
    told = rows.join(F.broadcast(table), fits, "left")  # eleven lines, one of which fits at most
    name, names = F.col("target_name"), F.col("_names")
    texts_of = F.create_map(*(F.lit(x) for pair in _TARGETS.items() for x in pair))
    rules = [
        Rule("constant_pool", _NO_KIND, ~F.col("kind").between(1, 9)),
        Rule("constant_pool", texts_of[F.col("kind")], F.col("kind").between(1, 9) & F.col("_kind").isNull()),
        Rule("constant_pool", _NOT_INIT, (names == "<init>") & (name != "<init>")),
        Rule("constant_pool", _SPECIAL, (names == "method") & name.isin("<init>", "<clinit>")),
    ]
    return violations(told, rules, {"class_id": "class_id", "cp_index": "cp_index"})


# Fixed values of the class-file format: attributes of record components.
ON_COMPONENT = ["Signature", "RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations", "RuntimeVisibleTypeAnnotations", "RuntimeInvisibleTypeAnnotations"]


def component_rules(components: DataFrame, classes: DataFrame) -> DataFrame:
    """Names and descriptors of record components, and the places, versions and numbers of their attributes.

    components: (class_id, component_ordinal, name, descriptor, attributes array<string>), name and descriptor null where
    their index has no text.  A component and its attributes are one row, so what is unique in it needs no grouping.
    """
    about = classes.select("class_id", F.col("name").alias("class_name"), "major", F.col("access_flags").bitwiseAND(F.lit(0x8000)).alias("_module"))
    rows = components.join(about, "class_id").withColumn("attributes", F.coalesce("attributes", F.array().cast("array<string>")))
    known = sorted({n for names in ALLOWED.values() for n in names} | set(ON_COMPONENT))
    first = F.create_map(*(F.lit(x) for pair in FIRST_MAJOR.items() for x in pair))
    told = lambda category, message, attribute=None: F.struct(F.lit("ERROR").alias("severity"), F.lit(category).alias("category"), (message if isinstance(message, Column) else F.lit(message)).alias("message"), (F.lit("Record") if attribute is None else attribute).alias("attribute_name"))
    own = F.array_compact(F.array(
        F.when(F.col("name").isNull(), told("constant_pool", "record component name_index must reference Utf8")),
        F.when(F.col("descriptor").isNull() | ~descriptors.is_field_descriptor(F.col("descriptor")), told("descriptor", "invalid record component descriptor")),
    ))
    of_each = F.flatten(F.transform("attributes", lambda a: F.array_compact(F.array(
        F.when(a.isin(known) & ~a.isin(ON_COMPONENT), told("attribute", F.concat(a, F.lit(" attribute is not allowed on record component")), a)),
        F.when(a.isin(MODULE_ONLY) & (F.col("_module") == 0), told("attribute", F.concat(a, F.lit(" attribute is only allowed on module classes")), a)),
        F.when(F.col("major") < first[a], told("attribute", F.concat(a, F.lit(" attribute requires class file version "), first[a].cast("string"), F.lit(".0 or newer")), a)),
    ))))
    counted = F.transform(
        F.filter(F.array_distinct("attributes"), lambda a: a.isin(known) & (F.size(F.filter("attributes", lambda b: b == a)) > 1)),
        lambda a: told("attribute", F.concat(F.lit("record component must not declare multiple "), a, F.lit(" attributes")), a),
    )
    found = rows.select("class_id", "class_name", "component_ordinal", F.col("name").alias("member_name"), F.explode(F.concat(own, of_each, counted)).alias("v"))
    return found.select("v.severity", "v.category", "v.message", "class_id", "class_name", "component_ordinal", "member_name", "v.attribute_name")


def with_gaps(pool: DataFrame) -> DataFrame:
    """pool (class_id, cp_index, tag, ...) with gap: whether a constant stands where the one before it needs its second slot.

    Of wide constants (tags 5 and 6) that follow one another without a free slot every second one stands in a gap.
    """
    by = Window.partitionBy("class_id").orderBy("cp_index")
    wide = F.col("tag").isin(5, 6)
    before = F.lag("cp_index").over(by) == F.col("cp_index") - 1
    after_wide = before & F.lag(wide).over(by)
    rows = pool.withColumn("_after", F.coalesce(after_wide, F.lit(False)))
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_after"), 0).otherwise(1)).over(by))
    nth = F.row_number().over(Window.partitionBy("class_id", "_run").orderBy("cp_index"))
    return rows.withColumn("gap", F.col("_after") & (nth % 2 == 0)).drop("_after", "_run")


def slot_rules(pool: DataFrame, classes: DataFrame) -> DataFrame:
    """Slots of a pool: the first is empty, wide constants have a gap behind them, no others are empty.  classes: (class_id, slots)."""
    rows = with_gaps(pool)
    real = rows.where(~F.col("gap") & (F.col("cp_index") > 0))
    width = F.when(F.col("tag").isin(5, 6), 2).otherwise(1)
    # Where the slots behind each constant begin and end, and those before the first: a constant carries the place before it too.
    by = Window.partitionBy("class_id").orderBy("cp_index")
    known = real.select("class_id", "cp_index", width.alias("width"), F.lead("cp_index").over(by).alias("next"), F.row_number().over(by).alias("nth"))
    rows_of = classes.select("class_id", "slots").join(known, "class_id", "left")
    none = F.col("cp_index").isNull()
    start = F.struct(F.lit(0).alias("cp_index"), F.lit(1).alias("width"), F.coalesce("cp_index", "slots").alias("to_"))
    each = F.struct(F.col("cp_index"), F.col("width"), F.coalesce("next", "slots").alias("to_"))
    told = F.when(none, F.array(start)).when(F.col("nth") == 1, F.array(start, each)).otherwise(F.array(each))
    spans = rows_of.select("class_id", "slots", F.explode(told).alias("s")).select("class_id", "slots", "s.*").withColumn("from_", F.col("cp_index") + F.col("width"))
    empty = spans.where("from_ < to_").select("class_id", F.explode(F.sequence("from_", F.col("to_") - 1)).alias("cp_index"))
    place = {"class_id": "class_id", "cp_index": "cp_index"}
    found = violations(rows, [Rule("constant_pool", "constant pool slot 0 must be empty", F.col("cp_index") == 0), Rule("constant_pool", "long/double constant-pool entry must be followed by an empty gap slot", F.col("gap"))], place)
    found = found.unionByName(violations(empty, [Rule("constant_pool", "unexpected empty constant-pool slot", F.lit(True))], place))
    ends = [
        Rule("constant_pool", "constant pool must include slot 0", F.col("slots") == 0),
        Rule("constant_pool", "long/double constant-pool entry is missing its trailing gap slot", (F.col("width") == 2) & (F.col("from_") > F.col("slots"))),
    ]
    last = spans.where("slots = 0 and cp_index = 0 or slots > 0")
    return found.unionByName(violations(last, ends, {"class_id": "class_id", "cp_index": F.lit(None).cast("int")}))


def all_pool_rules(pool: DataFrame, classes: DataFrame) -> DataFrame:
    """Slots, links and handles of constant pools; what stands in slot 0 or in a gap is not looked at further."""
    real = with_gaps(pool).where("not gap and cp_index > 0").drop("gap")
    return slot_rules(pool, classes).unionByName(pool_rules(real)).unionByName(handle_rules(real, classes))


# Fixed values of the class-file format: the first bytes, and the versions that exist.
MAGIC, FIRST_VERSION, LAST_VERSION, PREVIEW = 0xCAFEBABE, 45, 69, 65535


def header_rules(headers: DataFrame, pool: DataFrame) -> DataFrame:
    """Magic, version, and what a class says of itself, its super class and its interfaces, as numbers of constants.

    headers: (class_id, magic, major, minor, access_flags, this_class, super_class, interfaces array<int>, n_fields, n_methods).
    """
    known = offers(pool).where("wanted = 'class'").select("class_id", "index")
    text = pool.where("tag = 1").select("class_id", F.col("cp_index").alias("ref1"), "utf8")
    named = pool.where("tag = 7").select("class_id", F.col("cp_index").alias("this_class"), "ref1").join(text, ["class_id", "ref1"]).select("class_id", "this_class", F.col("utf8").alias("class_name"))
    is_class = lambda name: known.select("class_id", F.col("index").alias(f"{name}_class"), F.lit(True).alias(f"_{name}"))
    rows = headers.join(named, ["class_id", "this_class"], "left").join(is_class("this"), ["class_id", "this_class"], "left").join(is_class("super"), ["class_id", "super_class"], "left")
    module, super_ = F.col("access_flags").bitwiseAND(F.lit(0x8000)) != 0, F.col("super_class")
    root = ~module & F.coalesce(F.col("class_name") == "java/lang/Object", F.lit(False))
    plain = ~module & ~root
    major, minor = F.col("major"), F.col("minor")
    version = major.between(FIRST_VERSION, LAST_VERSION) & ((major < 56) | minor.isin(0, PREVIEW))
    rules = [
        Rule("magic", F.concat(F.lit("invalid magic 0x"), F.lpad(F.lower(F.hex("magic")), 8, "0")), F.col("magic") != MAGIC),
        Rule("version", F.concat(F.lit("invalid class version "), major.cast("string"), F.lit("/"), minor.cast("string")), ~version),
        Rule("class_structure", "this_class must be non-zero", F.col("this_class") == 0),
        Rule("class_structure", "this_class must reference CONSTANT_Class", (F.col("this_class") != 0) & F.col("_this").isNull()),
        Rule("class_structure", "module class must have super_class == 0", module & (super_ != 0)),
        Rule("class_structure", "module class must not declare interfaces", module & (F.size("interfaces") > 0)),
        Rule("class_structure", "module class must not declare fields", module & (F.col("n_fields") > 0)),
        Rule("class_structure", "module class must not declare methods", module & (F.col("n_methods") > 0)),
        Rule("class_structure", "java/lang/Object must have super_class == 0", root & (super_ != 0)),
        Rule("class_structure", "non-root class must have non-zero super_class", plain & (super_ == 0)),
        Rule("class_structure", "super_class must reference CONSTANT_Class", plain & (super_ != 0) & F.col("_super").isNull()),
    ]
    place = {"class_id": "class_id", "class_name": "class_name"}
    each = rows.select("class_id", "class_name", F.explode("interfaces").alias("index"))
    missing = each.join(known, ["class_id", "index"], "left_anti")
    return violations(rows, rules, place).unionByName(violations(missing, [Rule("class_structure", "interface entry must reference CONSTANT_Class", F.lit(True))], place))
