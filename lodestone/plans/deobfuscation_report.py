"""The report of an archive's classes: counts, packages, hotspots, string hints, excludes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import names
from lodestone.operators import reports
from lodestone.sources import documents


def class_metrics(classes: DataFrame, fields: DataFrame, methods: DataFrame, items: DataFrame) -> DataFrame:
    """A row a class: name, package, suspicious, rl, methods, fields, branches (no switches), nops, readable strings (distinct)."""
    simple = names.simple_name(F.col("name"))
    head = classes.select("class_id", "name", names.report_package(F.col("name")).alias("package"), names.is_suspicious(simple).alias("suspicious"), names.is_rl(simple).alias("rl"))
    readable = F.when((F.col("kind") == "ldc") & names.is_readable(F.col("ldc_string")), F.col("ldc_string"))
    return reports.with_counts(
        head,
        "class_id",
        {
            "methods": (methods, F.count("*")),
            "fields": (fields, F.count("*")),
            "branches": (items, F.count_if(F.col("kind") == "branch")),
            "nops": (items, F.count_if((F.col("kind") == "raw") & (F.col("opcode") == 0))),
            "strings": (items, F.count_distinct(readable)),
        },
    )


def top_packages(metrics: DataFrame, limit: int = 10) -> DataFrame:
    return reports.top_groups(metrics, F.col("package"), F.col("suspicious"), "package", limit).withColumnRenamed("n_matching", "n_suspicious")


def hotspots(metrics: DataFrame, sizes: DataFrame, limit: int = 10) -> DataFrame:
    """Classes by methods, fields, bytes and name; sizes: (class_id, byte_len)."""
    told = metrics.join(sizes, "class_id", "left").fillna(0, ["byte_len"])
    return reports.top(told, F.desc("methods"), F.desc("fields"), F.desc("byte_len"), F.asc("name"), limit=limit)


def string_hints(metrics: DataFrame, items: DataFrame, limit: int = 10) -> DataFrame:
    """Classes with readable strings by their number, each with its first three."""
    readable = items.where((F.col("kind") == "ldc") & names.is_readable(F.col("ldc_string")))
    first = reports.first_distinct(readable, ["class_id"], "ldc_string", ["method_ordinal", "item_ordinal"], 3)
    told = metrics.join(first, "class_id").select("name", F.col("n_distinct").alias("n_strings"), "sample")
    return reports.top(told, F.desc("n_strings"), F.asc("name"), limit=limit)


def totals(metrics: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: classes, suspicious and rl ones, resources."""
    resources = entries.where("not is_class and not is_dir").agg(F.count("*").alias("resources"))
    counted = metrics.agg(F.count("*").alias("classes"), F.count_if("suspicious").alias("suspicious"), F.count_if("rl").alias("rl"))
    return counted.crossJoin(F.broadcast(resources))  # one row with one row


def excludes(entries: DataFrame) -> DataFrame:
    """(archive, match) of the compiler-control file: the matches of the entries that c2 excludes; files with unknown keys give none."""
    return documents.compiler_excludes(entries)[0]
