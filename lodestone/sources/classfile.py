"""Class files as rows: one pass over the bytes gives nested columns; everything else is joins over them.

parse() turns a table with class bytes into one row a class; the functions
after it flatten that row into the tables of the corpus: classes,
constant_pool, fields, methods, instructions, handlers, attributes, parse
errors, and code_items (instructions and labels in order).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed values of the class-file format: bytes after each constant-pool tag (Utf8 apart), and operand shapes of opcodes.
POOL_SIZES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
ARRAY_TYPES = {4: "[Z", 5: "[C", 6: "[F", 7: "[D", 8: "[B", 9: "[S", 10: "[I", 11: "[J"}

SHAPES = ["raw"] * 256
for _range, _shape in (
    (range(0x10, 0x11), "byte"), (range(0x11, 0x12), "short"), (range(0x12, 0x13), "ldc"), (range(0x13, 0x15), "ldc_wide"),
    (range(0x15, 0x1A), "var"), (range(0x36, 0x3B), "var"), (range(0xA9, 0xAA), "var"), (range(0x84, 0x85), "iinc"),
    (range(0x99, 0xA9), "branch"), (range(0xC6, 0xC8), "branch"), (range(0xC8, 0xCA), "branch_wide"),
    (range(0xAA, 0xAB), "table_switch"), (range(0xAB, 0xAC), "lookup_switch"), (range(0xB2, 0xB6), "field"), (range(0xB6, 0xB9), "method"),
    (range(0xB9, 0xBA), "interface_method"), (range(0xBA, 0xBB), "invoke_dynamic"), (range(0xBB, 0xBC), "type"), (range(0xBD, 0xBE), "type"),
    (range(0xC0, 0xC2), "type"), (range(0xBC, 0xBD), "new_array"), (range(0xC4, 0xC5), "wide"), (range(0xC5, 0xC6), "multi_new_array"),
):
    for _op in _range:
        SHAPES[_op] = _shape

POOL = "array<struct<cp_index int, tag int, utf8 string, utf8_raw binary, bits bigint, ref1 int, ref2 int>>"
INSNS = (
    "array<struct<pc int, opcode int, kind string, cp_index int, owner string, name string, descriptor string, is_interface boolean, slot int, imm int, "
    "ldc_type string, ldc_string string, ldc_bits bigint, bsm_index int, dims int, target int, switch_default int, switch_cases array<struct<key int, target int>>>>"
)
MEMBER = "ordinal int, access_flags int, name string, descriptor string"
ATTRIBUTES = "array<struct<owner_kind string, owner_ordinal int, ordinal int, name string, length int, payload binary>>"
PARSED = (
    "minor int, major int, access_flags int, name string, super_name string, interfaces array<string>, "
    f"pool {POOL}, fields array<struct<{MEMBER}>>, methods array<struct<{MEMBER}, has_code boolean, max_stack int, max_locals int, code_length int, insns {INSNS}, "
    "handlers array<struct<ordinal int, start_pc int, end_pc int, handler_pc int, catch_type string>>, lines array<struct<pc int, line int>>, "
    f"locals array<struct<start_pc int, end_pc int, name string, descriptor string, slot int>>>>, attributes {ATTRIBUTES}, error_kind string, error_offset int, error string"
)


class Malformed(ValueError):
    def __init__(self, kind: str, offset: int, message: str):
        super().__init__(message)
        self.kind, self.offset = kind, offset


def decode_modified_utf8(raw: bytes) -> str | None:
    """The text, or null where it holds half a surrogate pair or is not well-formed."""
    try:
        text = raw.replace(b"\xc0\x80", b"\x00").decode("utf-8", "surrogatepass")
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le")
    except UnicodeDecodeError:
        return None


def encode_modified_utf8(text: str) -> bytes:
    """The class-file form: NUL as two bytes, characters beyond U+FFFF as two surrogates of three bytes each."""
    units = struct.unpack(f">{len(text.encode('utf-16-be', 'surrogatepass')) // 2}H", text.encode("utf-16-be", "surrogatepass"))
    return b"".join(b"\xc0\x80" if u == 0 else chr(u).encode("utf-8", "surrogatepass") for u in units)


class Reader:
    """Walks one class file."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        try:
            values = struct.unpack_from(">" + form, self.data, self.at)
        except struct.error:
            raise Malformed("truncated", self.at, f"the file ends in {struct.calcsize('>' + form)} bytes read at {self.at}") from None
        self.at += struct.calcsize(">" + form)
        return values

    def raw(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise Malformed("truncated", self.at, f"the file ends in {n} bytes read at {self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def pool(self) -> None:
        (count,) = self.take("H")
        if not count:
            raise Malformed("constant_pool", self.at, "the constant pool has no slot 0")
        self.slots: list[tuple | None] = [None] * count
        i = 1
        while i < count:
            at = self.at
            (tag,) = self.take("B")
            if tag == 1:
                (n,) = self.take("H")
                raw = self.raw(n)
                self.slots[i] = (i, 1, decode_modified_utf8(raw), raw, None, None, None)
            elif tag in (3, 4):
                self.slots[i] = (i, tag, None, None, self.take("i")[0], None, None)
            elif tag in (5, 6):
                self.slots[i] = (i, tag, None, None, self.take("q")[0], None, None)
                i += 1
            elif tag in (7, 8, 16, 19, 20):
                self.slots[i] = (i, tag, None, None, None, self.take("H")[0], None)
            elif tag in (9, 10, 11, 12, 17, 18):
                self.slots[i] = (i, tag, None, None, None, *self.take("HH"))
            elif tag == 15:
                kind, ref = self.take("BH")
                if not 1 <= kind <= 9:
                    raise Malformed("constant_pool", at, f"method handle of kind {kind}")
                self.slots[i] = (i, tag, None, None, kind, ref, None)
            else:
                raise Malformed("constant_pool", at, f"unknown constant-pool tag {tag}")
            i += 1

    def slot(self, index: int, *tags: int) -> tuple:
        found = self.slots[index] if 0 < index < len(self.slots) else None
        if found is None or found[1] not in tags:
            raise Malformed("index", self.at, f"constant {index} is not of tag {tags}")
        return found

    def utf8(self, index: int) -> str:
        entry = self.slot(index, 1)
        return entry[2] if entry[2] is not None else entry[3].decode("utf-8", "replace")

    def named(self, index: int) -> str:
        """The name of a class, module or package."""
        return self.utf8(self.slot(index, 7, 19, 20)[5])

    def pair(self, index: int) -> tuple[str, str]:
        entry = self.slot(index, 12)
        return self.utf8(entry[5]), self.utf8(entry[6])

    def attributes(self, kind: str, owner: int) -> Iterator[tuple[str, bytes, int]]:
        for ordinal in range(self.take("H")[0]):
            index, length = self.take("HI")
            start = self.at
            name, payload = self.utf8(index), self.raw(length)
            self.found.append((kind, owner, ordinal, name, length, payload))
            yield name, payload, start

    def member(self, kind: str, ordinal: int) -> tuple:
        flags, name, descriptor = self.take("HHH")
        head = (ordinal, flags, self.utf8(name), self.utf8(descriptor))
        code = None
        for attribute, payload, start in self.attributes(kind, ordinal):
            if attribute == "Code" and kind == "method":
                code = self.code(payload, start, ordinal)
        return head if kind == "field" else head + (code or (False, None, None, None, [], [], [], []))

    def code(self, payload: bytes, start: int, ordinal: int) -> tuple:
        inner = Reader(payload)
        inner.slots, inner.found = self.slots, self.found
        stack, most_locals, length = inner.take("HHI")
        if not 0 < length < 65536:
            raise Malformed("code", start, f"code of {length} bytes")
        insns = list(self.instructions(inner.raw(length), start))
        handlers = []
        for i in range(inner.take("H")[0]):
            begin, end, handler, caught = inner.take("HHHH")
            handlers.append((i, begin, end, handler, self.named(caught) if caught else None))
        lines, names = [], []
        for name, data, _ in inner.attributes("code", ordinal):
            table = Reader(data)
            if name == "LineNumberTable":
                lines += [table.take("HH") for _ in range(table.take("H")[0])]
            elif name == "LocalVariableTable":
                for _ in range(table.take("H")[0]):
                    begin, span, text, descriptor, slot = table.take("HHHHH")
                    names.append((begin, begin + span, self.utf8(text), self.utf8(descriptor), slot))
        if inner.at != len(payload):
            raise Malformed("attribute", start + inner.at, "Code has bytes left over")
        return (True, stack, most_locals, length, insns, handlers, lines, names)

    def instructions(self, code: bytes, base: int) -> Iterator[tuple]:
        at, end = 0, len(code)
        read = lambda form, where: struct.unpack_from(">" + form, code, where)
        try:
            while at < end:
                pc, opcode = at, code[at]
                shape = SHAPES[opcode]
                v = dict.fromkeys(FIELDS)
                v |= {"pc": pc, "opcode": opcode, "kind": shape}
                at += 1
                if shape == "raw":
                    if 0x1A <= opcode <= 0x2D:
                        v |= {"kind": "var", "opcode": 0x15 + (opcode - 0x1A) // 4, "slot": (opcode - 0x1A) % 4}
                    elif 0x3B <= opcode <= 0x4E:
                        v |= {"kind": "var", "opcode": 0x36 + (opcode - 0x3B) // 4, "slot": (opcode - 0x3B) % 4}
                    elif opcode > 0xC9:
                        raise Malformed("code", base + 8 + pc, f"unknown opcode 0x{opcode:02x}")
                elif shape in ("byte", "new_array"):
                    v["imm"] = read("b" if shape == "byte" else "B", at)[0]
                    if shape == "new_array":
                        v["descriptor"] = ARRAY_TYPES.get(v["imm"])
                    at += 1
                elif shape == "short":
                    (v["imm"],) = read("h", at)
                    at += 2
                elif shape in ("ldc", "ldc_wide"):
                    index = read("B" if shape == "ldc" else "H", at)[0]
                    at += 1 if shape == "ldc" else 2
                    v |= {"kind": "ldc", "opcode": 0x12, "cp_index": index} | self.constant(index)
                elif shape == "var":
                    v["slot"] = code[at] if at < end else read("B", at)[0]
                    at += 1
                elif shape == "iinc":
                    v["slot"], v["imm"] = read("Bb", at)
                    at += 2
                elif shape in ("branch", "branch_wide"):
                    wide = shape == "branch_wide"
                    v |= {"kind": "branch", "opcode": opcode - 0x21 if wide else opcode, "target": pc + read("i" if wide else "h", at)[0]}
                    at += 4 if wide else 2
                elif shape == "wide":
                    inner = code[at]
                    v |= {"kind": "iinc" if inner == 0x84 else "var", "opcode": inner, "slot": read("H", at + 1)[0]}
                    at += 3
                    if inner == 0x84:
                        (v["imm"],) = read("h", at)
                        at += 2
                elif shape in ("table_switch", "lookup_switch"):
                    at += -at % 4
                    if shape == "table_switch":
                        default, low, high = read("iii", at)
                        if high < low:
                            raise Malformed("code", base + 8 + pc, "a table switch whose high is below its low")
                        targets = read(f"{high - low + 1}i", at + 12)
                        cases = [(low + i, pc + t) for i, t in enumerate(targets)]
                        at += 12 + 4 * len(targets)
                    else:
                        default, n = read("ii", at)
                        flat = read(f"{2 * n}i", at + 8)
                        cases = [(k, pc + t) for k, t in zip(flat[::2], flat[1::2], strict=True)]
                        at += 8 + 8 * n
                    v |= {"switch_default": pc + default, "switch_cases": cases}
                else:
                    (index,) = read("H", at)
                    at += 2
                    v["cp_index"] = index
                    if shape in ("field", "method", "interface_method"):
                        entry = self.slot(index, 9, 10, 11)
                        v["owner"] = self.named(entry[5])
                        v["name"], v["descriptor"] = self.pair(entry[6])
                        v["is_interface"] = entry[1] == 11
                        at += 2 * (shape == "interface_method")
                    elif shape == "invoke_dynamic":
                        entry = self.slot(index, 18)
                        v["bsm_index"] = entry[5]
                        v["name"], v["descriptor"] = self.pair(entry[6])
                        at += 2
                    else:
                        v["descriptor"] = self.named(index)
                        if shape == "multi_new_array":
                            v["dims"] = code[at]
                            at += 1
                yield tuple(v.values())
        except (struct.error, IndexError):
            raise Malformed("code", base + 8 + at, "an instruction goes beyond the code") from None

    def constant(self, index: int) -> dict:
        entry = self.slot(index, 3, 4, 5, 6, 7, 8, 15, 16, 17)
        kind = {3: "int", 4: "float", 5: "long", 6: "double", 7: "class", 8: "string", 15: "method_handle", 16: "method_type", 17: "dynamic"}[entry[1]]
        out = {"ldc_type": kind, "ldc_bits": entry[4] if entry[1] < 7 else None}
        if entry[1] == 8:
            out["ldc_string"] = self.utf8(entry[5])
        elif entry[1] in (7, 16):
            out["descriptor"] = self.utf8(entry[5])
        elif entry[1] == 17:
            out["name"], out["descriptor"] = self.pair(entry[6])
        return out

    def run(self) -> tuple:
        (magic,) = self.take("I")
        if magic != 0xCAFEBABE:
            raise Malformed("magic", 0, f"invalid magic 0x{magic:08x}")
        minor, major = self.take("HH")
        if not (45 <= major <= 55 or 56 <= major <= 69 and minor in (0, 65535)):
            raise Malformed("version", 4, f"unsupported class version {major}.{minor}")
        self.found: list[tuple] = []
        self.pool()
        flags, this, above = self.take("HHH")
        interfaces = [self.named(self.take("H")[0]) for _ in range(self.take("H")[0])]
        fields = [self.member("field", i) for i in range(self.take("H")[0])]
        methods = [self.member("method", i) for i in range(self.take("H")[0])]
        list(self.attributes("class", 0))
        if self.at != len(self.data):
            raise Malformed("trailing", self.at, f"{len(self.data) - self.at} bytes after the class")
        pool = [s for s in self.slots if s is not None]
        return (minor, major, flags, self.named(this), self.named(above) if above else None, interfaces, pool, fields, methods, self.found, None, None, None)


FIELDS = "pc opcode kind cp_index owner name descriptor is_interface slot imm ldc_type ldc_string ldc_bits bsm_index dims target switch_default switch_cases".split()


def parse_one(data: bytes) -> tuple:
    """The columns PARSED of one class; malformed bytes give the error alone."""
    try:
        return Reader(data).run()
    except Malformed as e:
        return (None,) * 10 + (e.kind, e.offset, str(e))


def parse(classes: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """keep and the columns of PARSED for every row."""
    head = classes.select(*keep)
    schema = StructType(head.schema.fields + StructType.fromDDL(PARSED).fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(PARSED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                rows = [parse_one(x or b"") for x in batch.column(len(keep)).to_pylist()]
                columns = [pa.array([_shaped(v, f.type) for v in c], f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], schema.names)

    return classes.select(*keep, content).mapInArrow(run, schema)


def _shaped(value, kind: pa.DataType):
    """Tuples as the dicts that Arrow takes for structs."""
    if value is None:
        return None
    if pa.types.is_list(kind):
        return [_shaped(v, kind.value_type) for v in value]
    if pa.types.is_struct(kind):
        return {kind.field(i).name: _shaped(v, kind.field(i).type) for i, v in enumerate(value)}
    return value


# Tables of the parsed rows; key names the class.


def classes(parsed: DataFrame, key: list[str]) -> DataFrame:
    return parsed.where("error_kind is null").select(*key, "minor", "major", "access_flags", "name", "super_name", "interfaces", F.size("pool").alias("n_constants"))


def errors(parsed: DataFrame, key: list[str]) -> DataFrame:
    return parsed.where("error_kind is not null").select(*key, "error_kind", "error_offset", "error")


def constant_pool(parsed: DataFrame, key: list[str]) -> DataFrame:
    return parsed.select(*key, F.explode("pool").alias("c")).select(*key, "c.*")


def fields(parsed: DataFrame, key: list[str]) -> DataFrame:
    return parsed.select(*key, F.explode("fields").alias("f")).select(*key, "f.*")


def methods(parsed: DataFrame, key: list[str]) -> DataFrame:
    head = "ordinal access_flags name descriptor has_code max_stack max_locals code_length".split()
    return parsed.select(*key, F.explode("methods").alias("m")).select(*key, *(f"m.{c}" for c in head))


def attributes(parsed: DataFrame, key: list[str]) -> DataFrame:
    return parsed.select(*key, F.explode("attributes").alias("a")).select(*key, "a.*")


def _of_methods(parsed: DataFrame, key: list[str], column: str) -> DataFrame:
    each = parsed.select(*key, F.explode("methods").alias("m"))
    return each.select(*key, F.col("m.ordinal").alias("method_ordinal"), F.explode(f"m.{column}").alias("x")).select(*key, "method_ordinal", "x.*")


def instructions(parsed: DataFrame, key: list[str]) -> DataFrame:
    return _of_methods(parsed, key, "insns")


def handlers(parsed: DataFrame, key: list[str]) -> DataFrame:
    """Exception handlers; labels are named by their pc."""
    return _of_methods(parsed, key, "handlers").select(*key, "method_ordinal", F.col("ordinal").alias("handler_ordinal"), F.col("start_pc").alias("start_label"), F.col("end_pc").alias("end_label"), F.col("handler_pc").alias("handler_label"), "catch_type")


def line_numbers(parsed: DataFrame, key: list[str]) -> DataFrame:
    return _of_methods(parsed, key, "lines")


def local_variables(parsed: DataFrame, key: list[str]) -> DataFrame:
    return _of_methods(parsed, key, "locals")


def code_items(parsed: DataFrame, key: list[str]) -> DataFrame:
    """Instructions and labels in order, from 0 in each method.

    A label stands before the instruction at its pc, or at the end: for each target of a jump or switch, bound of a
    handler or local variable, and start of a line.  item_ordinal counts both, node_ordinal instructions only.
    """
    by = [*key, "method_ordinal"]
    insns = instructions(parsed, key)
    at = lambda df, *columns: [df.select(*by, F.col(c).alias("pc")) for c in columns]
    cases = insns.select(*by, F.explode("switch_cases").alias("c")).select(*by, F.col("c.target").alias("pc"))
    places = [*at(insns, "target", "switch_default"), cases, *at(handlers(parsed, key), "start_label", "end_label", "handler_label"), *at(line_numbers(parsed, key), "pc"), *at(local_variables(parsed, key), "start_pc", "end_pc")]
    labels = places[0]
    for more in places[1:]:
        labels = labels.unionAll(more)
    labels = labels.where("pc is not null").distinct().select(*by, "pc", F.lit("label").alias("kind"), F.col("pc").alias("label_id"))
    whole = insns.withColumn("label_id", F.lit(None).cast("int")).unionByName(labels, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("pc", F.col("kind") != "label")
    node = F.sum((F.col("kind") != "label").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    numbered = whole.withColumn("item_ordinal", (F.row_number().over(w) - 1).cast("bigint")).withColumn("node_ordinal", F.when(F.col("kind") != "label", node))
    return numbered.withColumn("switch_labels", F.transform("switch_cases", lambda c: c["target"])).withColumnRenamed("target", "target_label")


def version_supported(major: Column, minor: Column) -> Column:
    """Majors 45 to 55 with any minor, 56 to 69 with minor 0 or 65535."""
    return major.between(45, 55) | (major.between(56, 69) & minor.isin(0, 65535))


def class_summary(parsed: DataFrame, key: list[str]) -> DataFrame:
    """(key, major, minor, n_constants, attribute_names, methods with their opcodes in order)."""
    names = F.transform(F.filter("attributes", lambda a: a["owner_kind"] == "class"), lambda a: a["name"])
    told = F.transform("methods", lambda m: F.struct(m["name"].alias("name"), m["descriptor"].alias("descriptor"), F.transform(m["insns"], lambda i: i["opcode"]).alias("opcodes")))
    return parsed.where("error_kind is null").select(*key, "major", "minor", F.size("pool").alias("n_constants"), names.alias("attribute_names"), told.alias("methods"))
