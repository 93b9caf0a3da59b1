"""JSON documents whose keys are all known: every path of a document against the paths that are allowed.

A document is read as VARIANT; its paths are listed one depth after another, by
exploding what holds more, and only below paths that are allowed.  A path names
the keys from the top with dots between, [] for the places of a list:
[].c2.exclude.  An allowed path that ends with .** lets anything stand below.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import Scratch

# The keys of compiler-control files.
COMPILER_CONTROL = ["[]", "[].match", "[].match[]", "[].c2", "[].c2.exclude"]


def paths(df: DataFrame, key: list[str], text: str, allowed: list[str] | None = None) -> DataFrame:
    """(key, path, kind) of everything in the documents but their tops; kind: OBJECT, ARRAY or VALUE.

    With `allowed` only what is allowed is looked into, so of an unknown part the top alone is listed.  Null texts and
    texts that are no JSON have no paths.
    """
    save = Scratch(df.sparkSession).write
    kind = F.schema_of_variant("v")
    about = lambda rows: rows.withColumn("kind", F.when(kind.startswith("OBJECT"), "OBJECT").when(kind.startswith("ARRAY"), "ARRAY").otherwise("VALUE"))
    at = about(df.select(*key, F.lit("").alias("path"), F.try_parse_json(text).alias("v")).where("v is not null"))
    found = []
    while True:
        inside = at.where("kind <> 'VALUE'").select(*key, F.col("path").alias("above"), F.col("v").alias("whole"))
        parts = df.sparkSession.tvf.variant_explode(F.col("whole").outer())
        step = inside.lateralJoin(parts).select(*key, "above", F.col("key").alias("name"), F.col("value").alias("v"))
        path = F.when(F.col("name").isNull(), F.concat("above", F.lit("[]"))).when(F.col("above") == "", F.col("name")).otherwise(F.concat("above", F.lit("."), "name"))
        step = save(about(step.select(*key, path.alias("path"), "v")))
        if step.isEmpty():
            break
        found.append(step.select(*key, "path", "kind"))
        at = step if allowed is None else step.where(is_allowed(allowed))
    none = df.select(*key, F.lit("").alias("path"), F.lit("").alias("kind")).limit(0)
    return reduce(DataFrame.unionAll, found, none)


def is_allowed(allowed: list[str]):
    """Whether the column path is one of those; names of any object are the same in all."""
    exact = [a for a in allowed if not a.endswith(".**")]
    below = [a.removesuffix("**") for a in allowed if a.endswith(".**")]
    return reduce(lambda a, b: a | b, [F.col("path").startswith(b) | F.col("path").startswith(b.removesuffix(".") + "[]") | (F.col("path") == b.removesuffix(".")) for b in below], F.col("path").isin(exact))


def unknown_keys(df: DataFrame, key: list[str], text: str, allowed: list[str]) -> DataFrame:
    """(key, path, error): "unknown key" for each path that is not allowed, once a document, "malformed" for texts that are no JSON."""
    wrong = df.where(F.col(text).isNotNull() & F.try_parse_json(text).isNull()).select(*key, F.lit("$").alias("path"), F.lit("malformed").alias("error"))
    unknown = paths(df, key, text, allowed).where(~is_allowed(allowed)).select(*key, "path").distinct()
    return unknown.withColumn("error", F.lit("unknown key")).unionAll(wrong)


def compiler_excludes(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(archive, match) of what c2 excludes in compiler-control files without errors, and the errors (archive, path, error)."""
    texts = entries.where("entry_name = 'compilercontrol.json'").select("archive", F.col("content").cast("string").alias("text"))
    errors = Scratch(entries.sparkSession).write(unknown_keys(texts, ["archive"], "text", COMPILER_CONTROL))
    kind = "array<struct<match:array<string>,c2:struct<exclude:boolean>>>"
    rows = texts.join(errors.select("archive"), "archive", "left_anti").select("archive", F.explode(F.from_json("text", kind)).alias("r"))
    return rows.where("r.c2.exclude").select("archive", F.explode("r.match").alias("match")), errors
