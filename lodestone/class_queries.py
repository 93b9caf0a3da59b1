"""Queries of the class plane over an archive that comes with PySpark; they read no driver tables and have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import cfg, frames, hierarchy
from lodestone.plans import deobfuscation_report, verify
from lodestone.sources import archives, classfile
from lodestone.sources.scratch import Scratch

KEY = ["class_id"]


def archive_path(spark: SparkSession) -> str:
    """The archive that the JVM has the classes of its Python gateway from, wherever Spark is installed."""
    return spark._jvm.java.lang.Class.forName("py4j.GatewayServer").getProtectionDomain().getCodeSource().getLocation().toString()


def entries(spark: SparkSession) -> DataFrame:
    return archives.named(archives.read_entries(spark, archive_path(spark)))


def parsed(spark: SparkSession) -> DataFrame:
    """Parsed once and written; what follows reads the columns it needs."""
    rows = entries(spark).where("is_class").withColumn("class_id", F.xxhash64("archive", "entry_ordinal"))
    return Scratch(spark).write(classfile.parse(rows, [*KEY, "entry_name"]))


def class_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.inventory(archives.read_entries(spark, archive_path(spark))).drop("archive")


def class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classfile.class_summary(parsed(spark), ["entry_name"]).withColumn("methods", F.size("methods"))


def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed(spark)
    items = classfile.code_items(rows, KEY)
    metrics = deobfuscation_report.class_metrics(classfile.classes(rows, KEY), classfile.fields(rows, KEY), classfile.methods(rows, KEY), items)
    return deobfuscation_report.top_packages(metrics)


def class_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed(spark)
    items = classfile.code_items(rows, KEY)
    metrics = classfile.classes(rows, KEY).select(*KEY, "name")
    return deobfuscation_report.string_hints(metrics, items)


def class_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed(spark)
    by = [*KEY, "method_ordinal"]
    items = classfile.code_items(rows, KEY)
    edges = cfg.jump_edges(items, by, "item_ordinal")
    caught = cfg.handler_edges(items, classfile.handlers(rows, KEY), by, "item_ordinal")
    return cfg.blocks(items, edges, by, "item_ordinal", caught).groupBy(*by).agg(F.max("block").alias("n_blocks"), F.count("*").alias("n_nodes"))


def class_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed(spark)
    classes = classfile.classes(rows, KEY)
    about = classes.select(*KEY, F.col("name").alias("owner"), F.regexp_extract("name", "^(.*)/", 1).alias("package"))
    return hierarchy.overridden(classfile.methods(rows, KEY).join(about, KEY), hierarchy.closure(hierarchy.edges_of(classes)))


def class_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed(spark)
    table = lambda of: of(rows, KEY)
    return verify.verify(table(classfile.classes), table(classfile.fields), table(classfile.methods), table(classfile.attributes), table(classfile.constant_pool), table(classfile.code_items))


def class_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed(spark)
    classes = classfile.classes(rows, KEY)
    chains = hierarchy.superclasses(hierarchy.edges_of(classes))
    found = frames.simulate(classfile.code_items(rows, KEY), classfile.handlers(rows, KEY), classfile.methods(rows, KEY), classes, chains, KEY)
    return found.select(*KEY, "method_ordinal", "max_stack", "max_locals", F.size("frames").alias("n_frames"), "error")


QUERIES = {f.__name__: f for f in (class_inventory, class_summary, class_report, class_strings, class_blocks, class_overrides, class_violations, class_frames)}
