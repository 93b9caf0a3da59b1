"""Field and method descriptors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD = r"\[*(?:[BCDFIJSZ]|L[^;.\[/]+(?:/[^;.\[/]+)*;)"
METHOD = rf"\((?:{FIELD})*\)(?:V|{FIELD})"


def is_field_descriptor(text: Column) -> Column:
    return F.coalesce(text.rlike(rf"\A{FIELD}\z"), F.lit(False))


def is_method_descriptor(text: Column) -> Column:
    return F.coalesce(text.rlike(rf"\A{METHOD}\z"), F.lit(False))


def parameters(descriptor: Column) -> Column:
    """The descriptors of the parameters, in order."""
    inside = F.regexp_extract(descriptor, r"\A\((.*)\)", 1)
    return F.regexp_extract_all(inside, F.lit(f"({FIELD})"), F.lit(1))


def return_type(descriptor: Column) -> Column:
    """What stands after the last ); all of it where there is none."""
    return F.substring_index(descriptor, ")", -1)


def slots(field: Column) -> Column:
    """Stack or local slots of a value: 2 for long and double."""
    return F.when(field.isin("J", "D"), 2).otherwise(1)


def parameter_slots(descriptor: Column) -> Column:
    return F.aggregate(parameters(descriptor), F.lit(0), lambda total, p: total + slots(p))


def dimensions(field: Column) -> Column:
    return F.char_length(F.regexp_extract(field, r"\A(\[*)", 1))


def element_type(field: Column) -> Column:
    """The type without its dimensions."""
    return F.regexp_replace(field, r"\A\[+", "")


def class_name(field: Column) -> Column:
    """Internal name of an object type, null for others."""
    return F.when(field.rlike(r"\AL[^;]+;\z"), F.regexp_extract(field, r"\AL([^;]+);\z", 1))


def component_type(field: Column) -> Column:
    """The type of an array's elements, itself an array or not; null for others."""
    return F.when(field.startswith("["), F.substring(field, 2, 1 << 30))


def field_of(element: Column, dims: Column) -> Column:
    """The descriptor of an element type (a primitive or L...;) in so many dimensions: the inverse of element_type() and dimensions()."""
    return F.concat(F.repeat(F.lit("["), dims), element)


def object_of(name: Column) -> Column:
    """The descriptor of a class by its internal name: the inverse of class_name()."""
    return F.concat(F.lit("L"), name, F.lit(";"))


def method_of(parameters: Column, returned: Column) -> Column:
    """The descriptor of a method by the descriptors of its parameters and its return type: the inverse of parameters() and return_type()."""
    return F.concat(F.lit("("), F.array_join(parameters, ""), F.lit(")"), returned)
