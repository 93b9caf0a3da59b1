"""Stack frames of methods: types of stack and locals at every node, to a fixpoint.

The fixpoint of one method is sequential and its graph small, so each method is
one row of an Arrow function; methods run side by side.  The lattice:
int, float, long, double, null, return addresses, uninitialised values, classes
by name, arrays by descriptor, and top.  Wide values take two slots, the second
is top.  Two classes meet in their common superclass by the table of super
chains that comes with the rows, else in the root.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestone.operators import cfg

ROOT = "java/lang/Object"
THROWABLE = "java/lang/Throwable"
TOP = "top"
WIDE = ("long", "double")
_TYPES = re.compile(r"\[*(?:[BCDFIJSZ]|L[^;]+;)")
_BASIC = {"B": "int", "C": "int", "I": "int", "S": "int", "Z": "int", "F": "float", "J": "long", "D": "double"}

# Opcodes by effect on the stack, as (first, last, slots taken, type put).
EFFECTS = (
    (0x00, 0x00, 0, None), (0x01, 0x01, 0, "null"), (0x02, 0x08, 0, "int"), (0x09, 0x0A, 0, "long"), (0x0B, 0x0D, 0, "float"), (0x0E, 0x0F, 0, "double"),
    (0x10, 0x11, 0, "int"), (0x2E, 0x2E, 2, "int"), (0x2F, 0x2F, 2, "long"), (0x30, 0x30, 2, "float"), (0x31, 0x31, 2, "double"), (0x33, 0x35, 2, "int"),
    (0x4F, 0x4F, 3, None), (0x50, 0x50, 4, None), (0x51, 0x51, 3, None), (0x52, 0x52, 4, None), (0x53, 0x56, 3, None), (0x57, 0x57, 1, None), (0x58, 0x58, 2, None),
    (0x85, 0x85, 1, "long"), (0x86, 0x86, 1, "float"), (0x87, 0x87, 1, "double"), (0x88, 0x88, 2, "int"), (0x89, 0x89, 2, "float"), (0x8A, 0x8A, 2, "double"),
    (0x8B, 0x8B, 1, "int"), (0x8C, 0x8C, 1, "long"), (0x8D, 0x8D, 1, "double"), (0x8E, 0x8E, 2, "int"), (0x8F, 0x8F, 2, "long"), (0x90, 0x90, 2, "float"), (0x91, 0x93, 1, "int"),
    (0x94, 0x94, 4, "int"), (0x95, 0x96, 2, "int"), (0x97, 0x98, 4, "int"), (0xAC, 0xAC, 1, None), (0xAD, 0xAD, 2, None), (0xAE, 0xAE, 1, None), (0xAF, 0xAF, 2, None),
    (0xB0, 0xB0, 1, None), (0xB1, 0xB1, 0, None), (0xBE, 0xBE, 1, "int"), (0xBF, 0xBF, 1, None), (0xC2, 0xC3, 1, None),
)
SIMPLE = {op: (taken, put) for first, last, taken, put in EFFECTS for op in range(first, last + 1)}
for _k, _kind in enumerate(("int", "long", "float", "double")):
    _slots = 2 if _kind in WIDE else 1
    for _base in (0x60, 0x64, 0x68, 0x6C, 0x70):
        SIMPLE[_base + _k] = (2 * _slots, _kind)
    SIMPLE[0x74 + _k] = (_slots, _kind)
for _op in range(0x78, 0x84):  # shifts take an int beside the value, and, or, xor two values
    _wide = _op % 2
    SIMPLE[_op] = ((3 if _wide else 2) if _op < 0x7E else (4 if _wide else 2), "long" if _wide else "int")
LOADS = ("int", "long", "float", "double")
#: dup family and swap: slots taken, and the order in which these are put back (0 is the top).
PERMUTATIONS = {0x59: (1, (0, 0)), 0x5A: (2, (0, 1, 0)), 0x5B: (3, (0, 2, 1, 0)), 0x5C: (2, (1, 0, 1, 0)), 0x5D: (3, (1, 0, 2, 1, 0)), 0x5E: (4, (1, 0, 3, 2, 1, 0)), 0x5F: (2, (0, 1))}


class Unverifiable(ValueError):
    pass


def of_descriptor(text: str) -> str:
    return _BASIC.get(text) or (text if text[0] == "[" else text[1:-1])


def with_filler(kind: str) -> list[str]:
    return [kind, TOP] if kind in WIDE else [kind]


def is_reference(kind: str) -> bool:
    return kind not in ("int", "float", "long", "double", TOP) and not kind.startswith(("uninitialized", "return "))


class Method:
    """One method's nodes, edges and chains, and its states."""

    def __init__(self, owner: str, name: str, descriptor: str, static: bool, chains: dict[str, list[str]]):
        self.owner, self.name, self.static, self.chains = owner, name, static, chains
        inside, _, back = descriptor[1:].rpartition(")")
        self.takes, self.returns = _TYPES.findall(inside), back

    def start(self) -> tuple[list[str], list[str]]:
        local = [] if self.static else ["uninitialized this" if self.name == "<init>" else self.owner]
        for kind in self.takes:
            local += with_filler(of_descriptor(kind))
        return [], local

    def join(self, a: str, b: str) -> str:
        if a == b:
            return a
        if a.startswith("return ") and b.startswith("return "):
            return "return " + ",".join(sorted({*a[7:].split(","), *b[7:].split(",")}))
        if is_reference(a) and is_reference(b):
            if "null" in (a, b):
                return b if a == "null" else a
            if a[0] == "[" or b[0] == "[":
                return ROOT
            others = {b, *self.chains.get(b, [])}
            return next((c for c in [a, *self.chains.get(a, [])] if c in others), ROOT)
        return TOP

    def merge(self, old: tuple | None, new: tuple) -> tuple:
        if old is None:
            return new
        if len(old[0]) != len(new[0]):
            raise Unverifiable(f"stack depths {len(old[0])} and {len(new[0])} meet")
        n = max(len(old[1]), len(new[1]))
        pad = lambda x: x + [TOP] * (n - len(x))
        return tuple([self.join(a, b) for a, b in zip(x, y, strict=True)] for x, y in ((old[0], new[0]), (pad(old[1]), pad(new[1]))))

    def step(self, node: int, row: dict, state: tuple) -> tuple[list[str], list[str]]:
        stack, local = list(state[0]), list(state[1])
        kind, op = row["kind"], row["opcode"]

        def take(n: int) -> list[str]:
            if n > len(stack):
                raise Unverifiable(f"stack underflow at node {node}")
            out = stack[len(stack) - n :]
            del stack[len(stack) - n :]
            return out[::-1]

        def put(type_: str) -> None:
            stack.extend(with_filler(type_))

        def settle(old: str, new: str) -> None:
            stack[:] = [new if x == old else x for x in stack]
            local[:] = [new if x == old else x for x in local]

        if kind == "var":
            slot = row["slot"]
            local.extend([TOP] * (slot + 2 - len(local)))
            if 0x15 <= op <= 0x19:
                put(LOADS[op - 0x15] if op < 0x19 else local[slot])
            elif 0x36 <= op <= 0x3A:
                taken = take(2 if op in (0x37, 0x39) else 1)
                local[slot : slot + 1] = [LOADS[op - 0x36] if op < 0x3A else taken[0]]
                if op in (0x37, 0x39):
                    local[slot + 1] = TOP
            while local and local[-1] == TOP and not (len(local) > 1 and local[-2] in WIDE):
                local.pop()
        elif kind == "iinc":
            pass
        elif kind == "ldc":
            put({"int": "int", "float": "float", "long": "long", "double": "double", "string": "java/lang/String", "class": "java/lang/Class", "method_handle": "java/lang/invoke/MethodHandle", "method_type": "java/lang/invoke/MethodType"}.get(row["ldc_type"]) or of_descriptor(row["descriptor"]))
        elif kind == "field":
            type_ = of_descriptor(row["descriptor"])
            if op in (0xB3, 0xB5):
                take(len(with_filler(type_)))
            if op in (0xB4, 0xB5):
                take(1)
            if op in (0xB2, 0xB4):
                put(type_)
        elif kind in ("method", "interface_method", "invoke_dynamic"):
            inside, _, back = row["descriptor"][1:].rpartition(")")
            take(sum(len(with_filler(of_descriptor(t))) for t in _TYPES.findall(inside)))
            if op not in (0xB8, 0xBA):
                (receiver,) = take(1)
                if op == 0xB7 and row["name"] == "<init>" and receiver.startswith("uninitialized"):
                    settle(receiver, self.owner if receiver.endswith("this") else receiver.split(" ", 2)[2])
            if back != "V":
                put(of_descriptor(back))
        elif kind == "type":
            name = row["descriptor"]
            if op == 0xBB:
                put(f"uninitialized {node} {name}")
            else:
                take(1)
                put("int" if op == 0xC1 else "[" + (name if name[0] == "[" else f"L{name};") if op == 0xBD else name)
        elif kind == "new_array":
            take(1)
            put(row["descriptor"])
        elif kind == "multi_new_array":
            take(row["dims"])
            put(row["descriptor"])
        elif kind == "branch":
            if op == cfg.JSR:
                put(f"return {node + 1}")
            elif op != cfg.GOTO:
                take(2 if 0x9F <= op <= 0xA6 else 1)
        elif kind in ("lookup_switch", "table_switch"):
            take(1)
        elif kind in ("byte", "short"):
            put("int")
        elif op == 0x32:
            array = take(2)[1]
            inner = array[1:]
            put(of_descriptor(inner) if array[:1] == "[" and (inner[:1] in "[L") else array if array == "null" else ROOT)
        elif op in PERMUTATIONS:
            n, order = PERMUTATIONS[op]
            taken = take(n)
            stack.extend(taken[i] for i in order)
        elif op in SIMPLE:
            taken, given = SIMPLE[op]
            take(taken)
            if given:
                put(given)
        else:
            raise Unverifiable(f"unsupported instruction 0x{op:02x} at node {node}")
        return stack, local

    def run(self, rows: list[dict], edges: dict[int, list[int]], caught: dict[int, list[tuple[int, str]]]) -> tuple[dict[int, tuple], int, int]:
        """States on entry to every reached node, and the most stack and local slots."""
        states: dict[int, tuple] = {0: self.start()}
        waiting, most_stack, most_locals = [0], 0, len(states[0][1])
        while waiting:
            node = waiting.pop()
            before = states[node]
            after = self.step(node, rows[node], before)
            most_stack = max(most_stack, len(before[0]), len(after[0]))
            most_locals = max(most_locals, len(before[1]), len(after[1]))
            onward = [(d, after) for d in edges.get(node, [])]
            if rows[node]["kind"] == "var" and rows[node]["opcode"] == cfg.RET:
                address = before[1][rows[node]["slot"]]
                if not address.startswith("return "):
                    raise Unverifiable(f"no return address at node {node}")
                onward += [(int(d), after) for d in address[7:].split(",")]
            # A handler sees the state before the covered instruction.
            onward += [(d, ([c or THROWABLE], before[1])) for d, c in caught.get(node, [])]
            for target, state in onward:
                merged = self.merge(states.get(target), state)
                if merged != states.get(target):
                    states[target] = merged
                    waiting.append(target)
        return states, most_stack, most_locals


RESULT = "max_stack int, max_locals int, frames array<struct<node int, locals array<string>, stack array<string>>>, error string"


def simulate(items: DataFrame, handlers: DataFrame, methods: DataFrame, classes: DataFrame, chains: DataFrame, key: list[str]) -> DataFrame:
    """(key, method_ordinal, max_stack, max_locals, frames, error): frames at the reached block starts but the first.

    items, handlers and methods as from lodestone.sources.classfile; chains: (child, ancestor, depth) of super classes.
    Only the chains of classes that a method names go to it.
    """
    by = [*key, "method_ordinal"]
    at = cfg.nodes(items, by, "item_ordinal")
    jumps = cfg.jump_edges(items, by, "item_ordinal")
    caught = cfg.handler_edges(items, handlers, by, "item_ordinal")
    starts = cfg.blocks(items, jumps, by, "item_ordinal", caught).where("is_block_start").groupBy(*by).agg(F.collect_list("node").alias("starts"))
    row = F.struct("node", "kind", "opcode", "owner", "name", "descriptor", "slot", "ldc_type", "dims")
    code = at.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    out = jumps.groupBy(*by).agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    caught_rows = caught.groupBy(*by).agg(F.collect_list(F.struct("src", "dst", "catch_type")).alias("caught"))
    named = F.explode(F.array_distinct(F.concat(F.array("owner"), F.transform(F.regexp_extract_all("descriptor", F.lit("L([^;]+);"), F.lit(1)), lambda x: x), F.array("descriptor"))))
    used = at.select(*by, named.alias("child")).unionByName(caught.select(*by, F.col("catch_type").alias("child"))).distinct()
    heads = methods.join(classes.select(*key, F.col("name").alias("class_name")), key)
    heads = heads.select(*key, F.col("ordinal").alias("method_ordinal"), "class_name", "name", "descriptor", F.col("access_flags").bitwiseAND(F.lit(8)).alias("static"))
    used = used.unionByName(heads.select(*by, F.col("class_name").alias("child"))).distinct()
    above = chains.groupBy("child").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "ancestor"))), lambda x: x["ancestor"]).alias("above"))
    known = used.join(above, "child").groupBy(*by).agg(F.collect_list(F.struct("child", "above")).alias("chains"))
    whole = heads.join(code, by).join(starts, by)
    for more in (out, caught_rows, known):
        whole = whole.join(more, by, "left")
    schema = StructType(whole.select(*by).schema.fields + StructType.fromDDL(RESULT).fields)
    names, types = schema.names, to_arrow_schema(schema).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for m in batch.to_pylist():
                some = lambda name, m=m: m[name] if m[name] is not None else []
                chain = {c["child"]: list(c["above"]) for c in some("chains")}
                edges: dict[int, list[int]] = {}
                for e in some("edges"):
                    edges.setdefault(e["src"], []).append(e["dst"])
                handled: dict[int, list[tuple[int, str]]] = {}
                for e in some("caught"):
                    handled.setdefault(e["src"], []).append((e["dst"], e["catch_type"]))
                method = Method(m["class_name"], m["name"], m["descriptor"], bool(m["static"]), chain)
                try:
                    states, stack, local = method.run(m["rows"], edges, handled)
                    frames = [{"node": n, "locals": states[n][1], "stack": states[n][0]} for n in sorted(m["starts"]) if n and n in states]
                    rows.append([*(m[k] for k in by), stack, local, frames, None])
                except Unverifiable as e:
                    rows.append([*(m[k] for k in by), None, None, None, str(e)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return whole.mapInArrow(run, schema)
