"""Generic signatures: a recursive grammar, so one small parser behind a pandas UDF.

parse() gives a signature as JSON: types are their descriptors, {"class": ...},
{"var": ...} or {"array": ...}.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F

_NAME = re.compile(r"[^.;\[/<>:]+")
PRIMITIVES = "BCDFIJSZ"


class Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def eat(self, token: str) -> bool:
        if token and self.text.startswith(token, self.at):
            self.at += len(token)
            return True
        return False

    def need(self, token: str) -> None:
        if not self.eat(token):
            raise ValueError(f"expected {token!r} at {self.at}")

    def name(self) -> str:
        found = _NAME.match(self.text, self.at)
        if not found:
            raise ValueError(f"expected a name at {self.at}")
        self.at = found.end()
        return found[0]

    def type(self):
        if self.peek() and self.peek() in PRIMITIVES:
            self.at += 1
            return self.text[self.at - 1]
        return self.reference()

    def reference(self):
        if self.eat("["):
            return {"array": self.type()}
        if self.eat("T"):
            name = self.name()
            self.need(";")
            return {"var": name}
        return self.class_type()

    def class_type(self):
        self.need("L")
        parts = [self.name()]
        while self.eat("/"):
            parts.append(self.name())
        out = {"class": "/".join(parts), "arguments": self.arguments(), "inner": []}
        while self.eat("."):
            out["inner"].append({"name": self.name(), "arguments": self.arguments()})
        self.need(";")
        return out

    def arguments(self) -> list:
        if not self.eat("<"):
            return []
        out = []
        while not self.eat(">"):
            if self.eat("*"):
                out.append({"wildcard": "*"})
            elif self.peek() in ("+", "-"):
                self.at += 1
                out.append({"wildcard": self.text[self.at - 1], "bound": self.reference()})
            else:
                out.append(self.reference())
        if not out:
            raise ValueError(f"empty type arguments at {self.at}")
        return out

    def parameters(self) -> list:
        if not self.eat("<"):
            return []
        out = []
        while not self.eat(">"):
            name = self.name()
            self.need(":")
            bound = None if self.peek() in (":", ">", "") or not (self.peek() in "LT[") else self.reference()
            bounds = []
            while self.eat(":"):
                bounds.append(self.reference())
            out.append({"name": name, "class_bound": bound, "interface_bounds": bounds})
        if not out:
            raise ValueError(f"empty type parameters at {self.at}")
        return out

    def whole(self, kind: str) -> dict:
        if kind == "field":
            out = {"type": self.reference()}
        elif kind == "class":
            out = {"parameters": self.parameters(), "super": self.class_type(), "interfaces": []}
            while self.at < len(self.text):
                out["interfaces"].append(self.class_type())
        else:
            out = {"parameters": self.parameters(), "takes": [], "throws": []}
            self.need("(")
            while not self.eat(")"):
                out["takes"].append(self.type())
            out["returns"] = "V" if self.eat("V") else self.type()
            while self.eat("^"):
                out["throws"].append(self.reference())
        if self.at != len(self.text):
            raise ValueError(f"text left over at {self.at}")
        return out


def parse_text(text: str | None, kind: str) -> str | None:
    try:
        return None if text is None else json.dumps(Parser(text).whole(kind))
    except (ValueError, RecursionError):
        return None


def parse(kind: str):
    """A UDF: the JSON of a class, method or field signature, null where it is not one."""
    if kind not in ("class", "method", "field"):
        raise ValueError(kind)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: parse_text(t, kind))

    return run


def is_valid(kind: str):
    """A boolean expression of a column."""
    run = parse(kind)
    return lambda column: run(column).isNotNull()
