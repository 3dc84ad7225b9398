"""Intermediate tables in the shared folder, dropped when they are no longer read."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


class Scratch:
    """Tables written below one fresh folder of ``spark.checkpoint.dir``; they outlive lost executors."""

    def __init__(self, spark: SparkSession, kind: str):
        self.spark, self.root = spark, shared_dir(spark, kind)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back."""
        df.write.parquet(self.path(name), compression="zstd")
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def tidy(self) -> None:
        """Let shuffle files of tables already written go now, not when the driver next happens to collect its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()
