"""Debug data: marking it stale, and stripping it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The debug attributes of classes and of code.
CLASS_DEBUG = ["SourceFile", "SourceDebugExtension"]
CODE_DEBUG = ["LineNumberTable", "LocalVariableTable", "LocalVariableTypeTable"]


def mark_stale(rows: DataFrame, match: Column) -> DataFrame:
    """rows with debug_state: stale where match holds, else as it was (fresh without the column)."""
    before = F.col("debug_state") if "debug_state" in rows.columns else F.lit("fresh")
    return rows.withColumn("debug_state", F.when(F.coalesce(match, F.lit(False)), "stale").otherwise(before))


def strip(attributes: DataFrame, classes: DataFrame, policy: str = "preserve") -> DataFrame:
    """attributes (class_id, owner_kind, name, ...) without debug data: of all classes with policy strip, else of stale ones.

    classes: (class_id, debug_state).  Stale class data goes under either policy, and so does that of their code.
    """
    if policy not in ("preserve", "strip"):
        raise ValueError(policy)
    owner, name = F.col("owner_kind"), F.col("name")
    debug = ((owner == "class") & name.isin(CLASS_DEBUG)) | ((owner == "code") & name.isin(CODE_DEBUG))
    if policy == "strip":
        return attributes.where(~debug)
    stale = classes.where("debug_state = 'stale'").select("class_id", F.lit(True).alias("_stale"))
    return attributes.join(stale, "class_id", "left").where(~(debug & F.coalesce("_stale", F.lit(False)))).select(*attributes.columns)
