"""Instruction facts as column expressions over code items, and constants that two opcodes can push."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the instruction set: a short constant's mnemonic, and the longer form with its operand.
EQUIVALENTS = [
    ("iconst_m1", "bipush -1"),
    ("iconst_0", "bipush 0"),
    ("iconst_1", "bipush 1"),
    ("iconst_2", "bipush 2"),
    ("iconst_3", "bipush 3"),
    ("iconst_4", "bipush 4"),
    ("iconst_5", "bipush 5"),
    ("lconst_0", "ldc2_w 0"),
    ("lconst_1", "ldc2_w 1"),
    ("fconst_0", "ldc 0.0"),
    ("fconst_1", "ldc 1.0"),
    ("fconst_2", "ldc 2.0"),
    ("dconst_0", "ldc2_w 0.0"),
    ("dconst_1", "ldc2_w 1.0"),
]


def equivalents(spark: SparkSession) -> DataFrame:
    """(a, b) of EQUIVALENTS, for sequence_diff."""
    return spark.createDataFrame(EQUIVALENTS, "a string, b string")


def short_constant(kind: Column, value: Column) -> Column:
    """The opcode that pushes an int or long by itself, null where there is none."""
    v = value.cast("bigint")
    return F.when((kind == "int") & v.between(-1, 5), v + 0x03).when((kind == "long") & v.between(0, 1), v + 0x09).cast("int")


def fits_short(value: Column) -> Column:
    return value.between(-0x8000, 0x7FFF)


def switch_padding(pc: Column) -> Column:
    """Bytes between a switch's opcode and its operands."""
    return F.pmod(-(pc + 1), F.lit(4))


def shortcut(opcode: Column, slot: Column) -> Column:
    """The one-byte form of a load or store of slots 0 to 3, null for others."""
    near = slot.between(0, 3)
    return F.when(near & opcode.between(0x15, 0x19), 0x1A + (opcode - 0x15) * 4 + slot).when(near & opcode.between(0x36, 0x3A), 0x3B + (opcode - 0x36) * 4 + slot).cast("int")


def implicit_slot(opcode: Column) -> Column:
    """The slot in a one-byte load or store, null for other opcodes."""
    return F.when(opcode.between(0x1A, 0x2D), F.pmod(opcode - 0x1A, F.lit(4))).when(opcode.between(0x3B, 0x4E), F.pmod(opcode - 0x3B, F.lit(4))).cast("int")


def inverted_branch(opcode: Column) -> Column:
    """The conditional branch that is taken when this one isn't, null for others."""
    pairs = opcode.between(0x99, 0xA6)
    return F.when(pairs, F.when(opcode % 2 == 1, opcode + 1).otherwise(opcode - 1)).when(opcode == 0xC6, 0xC7).when(opcode == 0xC7, 0xC6).cast("int")


def length() -> Column:
    """Bytes of a code item in its shortest encoding; 0 for labels, null for switches, whose padding depends on their pc.

    Branches count as short ones.
    """
    kind, slot, opcode = F.col("kind"), F.col("slot"), F.col("opcode")
    near = slot < 256
    one_byte = shortcut(opcode, slot).isNotNull()
    wide_constant = F.col("ldc_type").isin("long", "double") | (F.col("cp_index") > 255)
    return (
        F.when(kind == "label", 0)
        .when(kind == "raw", 1)
        .when(kind.isin("byte", "new_array"), 2)
        .when(kind.isin("short", "branch", "field", "method", "type"), 3)
        .when(kind == "var", F.when(one_byte, 1).when(near, 2).otherwise(4))
        .when(kind == "iinc", F.when(near & F.col("imm").between(-128, 127), 3).otherwise(6))
        .when(kind == "ldc", F.when(wide_constant, 3).otherwise(2))
        .when(kind.isin("interface_method", "invoke_dynamic"), 5)
        .when(kind == "multi_new_array", 4)
    )
