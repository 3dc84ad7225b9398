"""Table sinks and the idempotent bar upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import keep_last


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet", mode: str = "overwrite") -> None:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def merge_bars(old: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Old and fresh bars together, the fresh row winning on equal keys."""
    both = old.withColumn("__gen", F.lit(0)).unionByName(fresh.withColumn("__gen", F.lit(1)))
    return keep_last(both, keys, "__gen").drop("__gen")


def upsert_partitions(spark: SparkSession, fresh: DataFrame, path: str, keys: list[str], part: str) -> None:
    """Merge ``fresh`` into a partitioned parquet table, rewriting only the partitions it touches.

    The merged rows are first written beside the table so the overwrite never reads what it replaces.
    """
    touched = fresh.select(part).distinct()
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # first run: the table does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is not None:
        from ..session import materialise

        fresh = materialise(merge_bars(old.join(touched, part, "left_semi").select(*fresh.columns), fresh, keys))
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def manifest(df: DataFrame, key: str = "code", ts: str = "date") -> DataFrame:
    """Rows, first and last timestamp per instrument."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("bars"), F.min(ts).alias("start"), F.max(ts).alias("end"))


def todo(universe: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work not yet recorded in the result table."""
    return universe.join(done.select(*keys).distinct(), keys, "left_anti")
