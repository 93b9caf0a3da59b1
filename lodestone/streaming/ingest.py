"""Ingest of a drop folder of archives as a stream.

An addition to what the batch sources do: new archives are unzipped and parsed
once, in micro-batches, and appended to the lake.  A batch that runs again
after a failure replaces its own folder, so nothing comes twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.sources import archives, classfile

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def start_ingest(spark: SparkSession, drop: str, lake: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parse every new archive in drop and write its classes to lake/batch=N; once: stop when all present ones are done."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", "*.jar").load(drop)

    def write(batch: DataFrame, number: int) -> None:
        entries = archives.named(archives.unzip(batch.select("path", "content"))).where("is_class")
        parsed = classfile.parse(entries.withColumn("content_hash", F.xxhash64("content")), ["archive", "entry_ordinal", "entry_name", "content_hash"])
        parsed.write.mode("overwrite").parquet(f"{lake}/batch={number}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
