"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.sources import scratch

#: Documents handled at once inside a task; bounds the Python objects alive.
SLICE, SLICE_BYTES = 256, 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch(scratch.Scratch):
    """Written tables, which can also be deleted once nothing reads them again."""

    def drop(self, df: DataFrame) -> None:
        jvm = self.spark._jvm
        for file in df.inputFiles():
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, False)


def numbered_rows(scratch: Scratch, df: DataFrame, name: str = "number") -> DataFrame:
    """df as a written table with a number for each row, from 0 without gaps, in the order of its partitions and rows."""
    rows = scratch.write(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy(part.alias("_part")).count().select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row for each partition
    rows = rows.withColumns({"_part": part, "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_before", "_at")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most `rows` rows and about `size` bytes of text, one row at least."""
    for batch in batches:
        bytes_before = np.zeros(batch.num_rows + 1, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                bytes_before[1:] += np.cumsum(utf8_lengths(column).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(bytes_before, bytes_before[at] + size, "right")) - 1
            to = max(at + 1, min(to, at + rows, batch.num_rows))
            yield batch.slice(at, to - at)
            at = to


def texts_of(column: pa.Array) -> list[str]:
    """A text column as Python strings, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def utf8_lengths(column: pa.Array) -> pa.Array:
    """UTF-8 bytes of each text as int64, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.cast(pc.binary_length(column), pa.int64()), 0)
