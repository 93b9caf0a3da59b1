"""Archives as tables: entries with metadata, classes and resources, inventories, rewriting."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions.names import entry_name

ENTRIES = (
    "archive string, entry_ordinal int, raw_name string, is_dir boolean, compression int, mtime timestamp, "
    "unix_mode int, system int, comment binary, extra binary, content binary"
)
#: Bytes of content in one record batch.
BATCH_BYTES = 16_000_000


def _unzip(path: str, data: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for ordinal, info in enumerate(archive.infolist()):
            year, month, day, *rest = info.date_time
            try:
                mtime = datetime(max(year, 1980), max(month, 1), max(day, 1), *rest)
            except ValueError:
                mtime = None
            try:
                content = b"" if info.is_dir() else archive.read(info)
            except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError):  # damaged, encrypted or of a method unknown
                content = None
            yield (path, ordinal, info.filename, info.is_dir(), info.compress_type, mtime, info.external_attr >> 16, info.create_system, info.comment, info.extra, content)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """A row for every entry of the archives at path, in the order of the directory.  What is no archive gives no row."""
    return unzip(spark.read.format("binaryFile").load(path).select("path", "content"))


def unzip(files: DataFrame) -> DataFrame:
    """The entries of files (path, content); content is null where it can't be read."""
    schema = StructType.fromDDL(ENTRIES)
    kinds = [pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.timestamp("us", "UTC"), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for file, data in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                if not zipfile.is_zipfile(io.BytesIO(data)):
                    continue
                for row in _unzip(file, data):
                    rows.append(row)
                    size += len(row[-1] or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema.names)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema.names)

    return files.mapInArrow(run, schema)


def named(entries: DataFrame) -> DataFrame:
    """entries with entry_name (null where the name is not allowed) and is_class."""
    name = entry_name(F.col("raw_name"))
    return entries.withColumn("entry_name", name).withColumn("is_class", ~F.col("is_dir") & F.coalesce(F.col("entry_name").endswith(".class"), F.lit(False)))


def bad_names(entries: DataFrame) -> DataFrame:
    """(archive, entry_ordinal, raw_name) of the entries whose names are empty, absolute or climb."""
    return named(entries).where("entry_name is null").select("archive", "entry_ordinal", "raw_name")


def inventory(entries: DataFrame) -> DataFrame:
    """(archive, n_classes, n_resources, class_bytes, resource_bytes); directories are no resources."""
    size = F.length("content").cast("bigint")
    resource = ~F.col("is_class") & ~F.col("is_dir")
    return named(entries).groupBy("archive").agg(
        F.count_if("is_class").alias("n_classes"),
        F.count_if(resource).alias("n_resources"),
        F.coalesce(F.sum(F.when(F.col("is_class"), size)), F.lit(0)).alias("class_bytes"),
        F.coalesce(F.sum(F.when(resource, size)), F.lit(0)).alias("resource_bytes"),
    )


def put(entries: DataFrame, changed: DataFrame) -> DataFrame:
    """entries with those of changed (archive, entry_name, content) replaced, metadata kept, or added after the last."""
    have = named(entries)
    new = changed.select("archive", "entry_name", F.col("content").alias("_content"))
    kept = have.join(new, ["archive", "entry_name"], "left").withColumn("content", F.coalesce("_content", "content")).select(*entries.columns)
    last = entries.groupBy("archive").agg((F.max("entry_ordinal") + 1).alias("_next"))
    added = new.join(have.select("archive", "entry_name"), ["archive", "entry_name"], "left_anti").join(last, "archive", "left")
    ordinal = F.coalesce("_next", F.lit(0)) + F.row_number().over(_by_name()) - 1
    added = added.select("archive", ordinal.cast("int").alias("entry_ordinal"), F.col("entry_name").alias("raw_name"), F.col("_content").alias("content"))
    filled = {"is_dir": F.lit(False), "compression": F.lit(zipfile.ZIP_DEFLATED), "unix_mode": F.lit(0), "system": F.lit(3), "comment": F.lit(b""), "extra": F.lit(b"")}
    return kept.unionByName(added.withColumns(filled), allowMissingColumns=True)


def _by_name():
    return Window.partitionBy("archive").orderBy("entry_name")


def remove(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """entries without those of gone (archive, entry_name); a name that is not there is an error."""
    have = named(entries)
    missing = gone.join(have.select("archive", "entry_name"), ["archive", "entry_name"], "left_anti").limit(5).collect()
    if missing:
        raise KeyError(f"no such entries: {[tuple(r) for r in missing]}")
    return have.join(gone.select("archive", "entry_name"), ["archive", "entry_name"], "left_anti").select(*entries.columns)


def zipped(entries: DataFrame) -> DataFrame:
    """(archive, content): every archive put together again, in the order of its entries.  A task holds one archive."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            for row in rows.sort_values("entry_ordinal").itertuples():
                info = zipfile.ZipInfo(row.raw_name, (row.mtime.timetuple()[:6] if not pd.isna(row.mtime) else (1980, 1, 1, 0, 0, 0)))
                info.compress_type, info.create_system = int(row.compression), int(row.system)
                info.external_attr = int(row.unix_mode) << 16 | (0x10 if row.is_dir else 0)
                info.comment, info.extra = bytes(row.comment or b""), bytes(row.extra or b"")
                archive.writestr(info, bytes(row.content or b""))
        return pd.DataFrame({"archive": [rows["archive"].iloc[0]], "content": [out.getvalue()]})

    return entries.groupBy("archive").applyInPandas(build, "archive string, content binary")
