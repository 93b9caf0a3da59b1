"""Stages with what they did: rows, bytes and seconds that come from the run itself.

Every table that a stage changes is written once, and observed while it is
written; nothing is read again to be counted.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lodestone.plans.pipeline import Catalog, Pipeline
from lodestone.sources.scratch import Scratch

TABLES = ["classes", "fields", "methods", "code_items"]


def text_bytes(df: DataFrame) -> Column:
    """The bytes of a row's texts and binaries."""
    wide = [F.octet_length(F.col(f"`{name}`")) for name, kind in df.dtypes if kind in ("string", "binary")]
    return sum((F.coalesce(w, F.lit(0)).cast("long") for w in wide), F.lit(0).cast("long"))


@dataclass
class Stages:
    """Runs named stages and keeps for each (stage, table, rows, bytes, seconds)."""

    scratch: Scratch
    told: list[tuple[int, str, str, int, int, float]] = field(default_factory=list)

    def write(self, number: int, stage: str, table: str, df: DataFrame) -> DataFrame:
        """df written, with its figures noted."""
        seen = Observation()
        watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(text_bytes(df)), F.lit(0)).alias("bytes"))
        began = time.perf_counter()
        out = self.scratch.write(watched)
        figures = seen.get
        self.told.append((number, stage, table, int(figures["rows"]), int(figures["bytes"]), time.perf_counter() - began))
        return out

    def run(self, pipeline: Pipeline, catalog: Catalog) -> Catalog:
        """The catalog after all steps of a pipeline; tables that a step leaves alone are not written again."""
        for number, (text, step) in enumerate(pipeline.steps, 1):
            after = step(catalog)
            changed = {t: self.write(number, text, t, getattr(after, t)) for t in TABLES if getattr(after, t) is not getattr(catalog, t)}
            catalog = replace(after, **changed)
        return catalog

    def table(self) -> DataFrame:
        """A row for each table that each stage wrote."""
        return self.scratch.spark.createDataFrame(self.told, "number int, stage string, table string, rows long, bytes long, seconds double")
