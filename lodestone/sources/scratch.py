"""Intermediate tables of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Tables in the folder that the cluster names in spark.checkpoint.dir; a local folder only where one machine runs all (tests)."""

    _local: str | None = None

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            Scratch._local = base = Scratch._local or tempfile.mkdtemp(prefix="spark-")
        self.base = f"{base}/{uuid.uuid4().hex}"

    def write(self, df: DataFrame) -> DataFrame:
        """df written and read back: its lineage ends here, and lost executors cost nothing."""
        path = f"{self.base}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a written table that nothing reads any more."""
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
