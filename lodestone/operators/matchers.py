"""Matchers: named boolean columns that combine with &, | and ~.

A matcher never yields null: what a null name or super class can't answer is
false, so ~ is the plain complement.  all_of() of nothing is true, any_of() of
nothing false.  Patterns match the whole text unless mode="search" is given.
The members ask for columns by name; any table with these columns will do.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import descriptors, names
from lodestone.functions.flags import CLASS_FLAGS, FIELD_FLAGS, METHOD_FLAGS, VISIBILITY, has_all, has_any, has_none


@dataclass(frozen=True)
class Matcher:
    column: Column
    text: str

    @classmethod
    def of(cls, column: Column, text: str) -> Matcher:
        """Any boolean column as a matcher."""
        return cls(F.coalesce(column, F.lit(False)), text)

    def __and__(self, other: Matcher) -> Matcher:
        return all_of(self, other)

    def __or__(self, other: Matcher) -> Matcher:
        return any_of(self, other)

    def __invert__(self) -> Matcher:
        return Matcher(~self.column, f"!{self.text}")

    def __repr__(self) -> str:
        return self.text


def all_of(*matchers: Matcher) -> Matcher:
    return Matcher(reduce(lambda a, m: a & m.column, matchers, F.lit(True)), "(" + " & ".join(m.text for m in matchers) + ")")


def any_of(*matchers: Matcher) -> Matcher:
    return Matcher(reduce(lambda a, m: a | m.column, matchers, F.lit(False)), "(" + " | ".join(m.text for m in matchers) + ")")


def not_(matcher: Matcher) -> Matcher:
    return ~matcher


def anything() -> Matcher:
    return Matcher(F.lit(True), "any")


def equals(column: str, value: str) -> Matcher:
    return Matcher.of(F.col(column) == value, f"{column}={value!r}")


def matches(column: str, pattern: str, mode: str = "fullmatch") -> Matcher:
    """A regular expression on a column; look-around and backreferences are refused, so that every engine reads it alike."""
    if any(x in pattern for x in ("(?=", "(?!", "(?<=", "(?<!")) or any(f"\\{d}" in pattern for d in range(1, 10)):
        raise ValueError(f"look-around and backreferences are not supported: {pattern!r}")
    test = {"fullmatch": names.full_match, "search": names.search}[mode]
    return Matcher.of(test(F.col(column), pattern), f"{column}~{pattern!r}")


@dataclass(frozen=True)
class Members:
    """Matchers of one kind of thing: its flags, and what counts as package-private."""

    flags: dict[str, int]
    #: Bits of which none may be set in something package-private.
    visible: int
    prefix: str = ""

    def _col(self, name: str) -> Column:
        return F.col(self.prefix + name)

    def any(self) -> Matcher:
        return anything()

    def named(self, name: str) -> Matcher:
        return equals(self.prefix + "name", name)

    def name_matches(self, pattern: str, mode: str = "fullmatch") -> Matcher:
        return matches(self.prefix + "name", pattern, mode)

    def access_all(self, bits: int) -> Matcher:
        return Matcher.of(has_all(self._col("access_flags"), bits & self.known), f"all(0x{bits:04x})")

    def access_any(self, bits: int) -> Matcher:
        return Matcher.of(has_any(self._col("access_flags"), bits & self.known), f"any(0x{bits:04x})")

    @property
    def known(self) -> int:
        return reduce(lambda a, b: a | b, self.flags.values())

    def flag(self, name: str) -> Matcher:
        """One flag by name: public, static, synthetic and so on."""
        return Matcher(self.access_all(self.flags[name.upper()]).column, name.lower())

    def package_private(self) -> Matcher:
        return Matcher.of(has_none(self._col("access_flags"), self.visible), "package_private")


@dataclass(frozen=True)
class Classes(Members):
    def extends(self, name: str) -> Matcher:
        return equals(self.prefix + "super_name", name)

    def implements(self, name: str) -> Matcher:
        return Matcher.of(F.array_contains(self._col("interfaces"), name), f"implements({name!r})")

    def version(self, major: int) -> Matcher:
        return Matcher.of(self._col("major") == major, f"version={major}")

    def version_at_least(self, major: int) -> Matcher:
        return Matcher.of(self._col("major") >= major, f"version>={major}")

    def version_below(self, major: int) -> Matcher:
        return Matcher.of(self._col("major") < major, f"version<{major}")


@dataclass(frozen=True)
class Described(Members):
    def descriptor(self, text: str) -> Matcher:
        return equals(self.prefix + "descriptor", text)

    def descriptor_matches(self, pattern: str, mode: str = "fullmatch") -> Matcher:
        return matches(self.prefix + "descriptor", pattern, mode)


@dataclass(frozen=True)
class Methods(Described):
    def has_code(self) -> Matcher:
        return Matcher.of(self._col("has_code"), "has_code")

    def is_constructor(self) -> Matcher:
        return self.named("<init>")

    def is_static_initializer(self) -> Matcher:
        return self.named("<clinit>")

    def returns(self, descriptor: str) -> Matcher:
        return Matcher.of(descriptors.return_type(self._col("descriptor")) == descriptor, f"returns({descriptor!r})")


#: A class is package-private when it isn't public; a member when none of the three visibilities is set.
classes = Classes(CLASS_FLAGS, 0x0001)
fields = Described(FIELD_FLAGS, VISIBILITY)
methods = Methods(METHOD_FLAGS, VISIBILITY)


class Instructions:
    """Matchers of code items: kind, opcode, owner, name, descriptor, slot, ldc_string."""

    LDC = (0x12, 0x13, 0x14)
    CALLS = ("method", "interface_method", "invoke_dynamic")

    def any(self) -> Matcher:
        return anything()

    def opcode(self, opcode: int) -> Matcher:
        return self.opcode_any([opcode])

    def opcode_any(self, opcodes: list[int]) -> Matcher:
        """One of the opcodes; a constant load matches any of its three, a label none."""
        wanted = {*opcodes, *(self.LDC if {*opcodes} & {*self.LDC} else ())}
        return Matcher.of(F.col("opcode").isin(*wanted) & (F.col("kind") != "label"), f"opcode({sorted(opcodes)})")

    def kind(self, *kinds: str) -> Matcher:
        return Matcher.of(F.col("kind").isin(*kinds), "|".join(kinds))

    def is_field_access(self) -> Matcher:
        return self.kind("field")

    def is_method_call(self) -> Matcher:
        return self.kind(*self.CALLS)

    def is_return(self) -> Matcher:
        return Matcher.of((F.col("kind") == "raw") & F.col("opcode").between(0xAC, 0xB1), "return")

    def is_branch(self) -> Matcher:
        return self.kind("branch", "lookup_switch", "table_switch")

    def is_label(self) -> Matcher:
        return self.kind("label")

    def is_ldc(self) -> Matcher:
        return self.kind("ldc")

    def is_var(self) -> Matcher:
        return self.kind("var")

    def field(self, owner: str | None = None, name: str | None = None, descriptor: str | None = None) -> Matcher:
        """Field accesses with the given parts."""
        return self._parts(("field",), owner, name, descriptor)

    def method(self, owner: str | None = None, name: str | None = None, descriptor: str | None = None) -> Matcher:
        """Calls with the given parts; a dynamic call has a name and descriptor, but no owner."""
        kinds = self.CALLS if owner is None else self.CALLS[:2]
        return self._parts(kinds, owner, name, descriptor)

    def _parts(self, kinds: tuple[str, ...], owner: str | None, name: str | None, descriptor: str | None) -> Matcher:
        parts = [equals(c, v) for c, v in (("owner", owner), ("name", name), ("descriptor", descriptor)) if v is not None]
        return all_of(self.kind(*kinds), *parts)

    def type_descriptor(self, descriptor: str) -> Matcher:
        return all_of(self.kind("type", "multi_new_array"), equals("descriptor", descriptor))

    def ldc_string(self, text: str) -> Matcher:
        return all_of(self.kind("ldc"), equals("ldc_string", text))

    def var_slot(self, slot: int) -> Matcher:
        return all_of(self.kind("var"), Matcher.of(F.col("slot") == slot, f"slot={slot}"))

    def field_owner_matches(self, pattern: str) -> Matcher:
        return all_of(self.kind("field"), matches("owner", pattern))

    def method_owner_matches(self, pattern: str) -> Matcher:
        return all_of(self.kind(*self.CALLS[:2]), matches("owner", pattern))

    def method_name_matches(self, pattern: str) -> Matcher:
        return all_of(self.kind(*self.CALLS), matches("name", pattern))


insns = Instructions()


def from_json(kind: str, spec: dict, mode: str = "search") -> Matcher:
    """The conjunction of the keys of a matcher in a rules file; unknown keys are errors, no keys match all."""
    of = {"class": classes, "field": fields, "method": methods}[kind]
    flags = lambda names: sum({of.flags[n.upper()] for n in names})
    known = {
        "name": of.named,
        "name_matches": lambda p: of.name_matches(p, mode),
        "access_all": lambda f: of.access_all(flags(f)),
        "access_any": lambda f: of.access_any(flags(f)),
        "package_private": lambda on: of.package_private() if on else ~of.package_private(),
    }
    if kind == "class":
        known |= {
            "extends": of.extends,
            "implements": lambda all_: all_of(*map(of.implements, all_)),
            "version": of.version,
            "version_at_least": of.version_at_least,
            "version_below": of.version_below,
        }
    else:
        known |= {"descriptor": of.descriptor, "descriptor_matches": lambda p: of.descriptor_matches(p, mode)}
    if kind == "method":
        known["has_code"] = lambda on: of.has_code() if on else ~of.has_code()
    if unknown := [k for k in spec if k not in known]:
        raise ValueError(f"unknown keys in a {kind} matcher: {unknown}")
    return all_of(*(known[k](v) for k, v in spec.items()))
