"""Event-time bars, sessions, deduplication and the streaming upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def tick_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """File stream of a tick table, one file or a folder of files; bounded micro-batches.

    A pattern is the one form in which the source takes a single file as well as a folder.
    """
    raw = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")
    return raw.select(F.col("event_type").alias("code"), "ts", F.col("value").alias("price"), "event_id", "user_id")


def window_bars(ticks: DataFrame, length: str, delay: str, slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) OHLC bars; rows later than ``delay`` are dropped by the watermark.

    Partial aggregation runs before the shuffle, so a hot code sends one partial row per window and task.
    """
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        ticks.withWatermark("ts", delay)
        .groupBy("code", w.alias("w"))
        .agg(
            F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", "ts").alias("close"), F.count(F.lit(1)).alias("n"),
        )
        .select("code", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "n")
    )


def bar_parts(ticks: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """What one micro-batch knows of each bar; merge_bar_parts() makes bars of all of them, in any order of arrival.

    Open and close are the first and last price by (ts, event_id).
    """
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    tick = F.struct("ts", "event_id", "price")
    return (
        ticks.groupBy("code", w.alias("w"))
        .agg(F.min(tick).alias("first"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(tick).alias("last"), F.count(F.lit(1)).alias("n"))
        .select("code", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "first", "high", "low", "last", "n")
    )


def merge_bar_parts(parts: DataFrame) -> DataFrame:
    g = parts.groupBy("code", "start", "end").agg(F.min("first").alias("first"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return g.select("code", "start", "end", F.col("first.price").alias("open"), "high", "low", F.col("last.price").alias("close"), "n")


def run_parts(stream: DataFrame, part: Callable[[DataFrame], DataFrame], path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Drain what is available and return ``part`` of every micro-batch so far, one folder for each.

    A file stream has no event-time order, so nothing is dropped as late: the caller merges the parts, which may
    hold rows of one key in any batch. A replayed batch overwrites its own folder.
    """
    spark = stream.sparkSession
    path = path or shared_dir(spark, "parts")
    checkpoint = checkpoint or shared_dir(spark, "parts-ckpt")
    schema = part(spark.createDataFrame([], stream.schema)).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/batch=-1")

    def save(batch: DataFrame, number: int) -> None:
        part(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(path)


def session_stats(ticks: DataFrame, key: str, gap: str, delay: str) -> DataFrame:
    """Gap-separated sessions per key."""
    return (
        ticks.withWatermark("ts", delay)
        .groupBy(key, F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
    )


def batch_sessions(ticks: DataFrame, key: str, gap_minutes: int, chunk_minutes: int = 1440) -> DataFrame:
    """Batch sessions that split a hot key over time chunks.

    Sessions are first closed inside each (key, chunk) by independent tasks; the few chunk sessions of a
    key (at most one boundary pair per chunk) are then chained where the gap between them is short enough.
    """
    return chain_sessions(session_parts(ticks, key), key, gap_minutes, chunk_minutes)


def session_parts(ticks: DataFrame, key: str) -> DataFrame:
    """One row for each instant of a key: repeated timestamps collapse map-side."""
    return ticks.groupBy(key, "ts").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))


def chain_sessions(parts: DataFrame, key: str, gap_minutes: int, chunk_minutes: int = 1440) -> DataFrame:
    """Sessions from session_parts() of any number of batches; see batch_sessions()."""
    from pyspark.sql.window import Window

    gap = F.expr(f"INTERVAL {gap_minutes} MINUTES")

    def island(df: DataFrame, part: list[str], start: str, end: str) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(start, end)
        new = F.coalesce((F.lag(end).over(w) + gap <= F.col(start)).cast("int"), F.lit(1))
        return df.withColumn("__new", new).withColumn("__isl", F.sum("__new").over(w))

    t = parts.groupBy(key, "ts").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    t = t.withColumn("__chunk", F.window("ts", f"{chunk_minutes} minutes").start)
    local = island(t, [key, "__chunk"], "ts", "ts").groupBy(key, "__chunk", "__isl").agg(
        F.min("ts").alias("s"), F.max("ts").alias("e"), F.sum("n").alias("n"), F.sum("total").alias("total")
    )
    # per key: one row per local session, already far fewer than the ticks
    out = island(local.drop("__isl"), [key], "s", "e").groupBy(key, "__isl").agg(
        F.min("s").alias("start"), (F.max("e") + gap).alias("end"), F.sum("n").alias("n"), F.sum("total").alias("total")
    )
    return out.drop("__isl")


def dedupe_stream(ticks: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """First copy of each key within the watermark (append-only feeds with retries)."""
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, output_mode: str = "append", path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Drain what is available into a parquet table in the shared folder and return that table."""
    spark = stream.sparkSession
    path = path or shared_dir(spark, "stream")
    checkpoint = checkpoint or shared_dir(spark, "stream-ckpt")
    q = (
        stream.writeStream.format("parquet").outputMode(output_mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_upsert(stream: DataFrame, keys: list[str], part: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Merge each micro-batch into a partitioned table: last write per key wins, only touched partitions are rewritten.

    Replaying a batch after a failure gives the same table, because the merge is idempotent.
    """
    from ..sources.sinks import upsert_partitions

    spark = stream.sparkSession
    path = path or shared_dir(spark, "upsert")
    checkpoint = checkpoint or shared_dir(spark, "upsert-ckpt")

    def merge(batch: DataFrame, _: int) -> None:
        upsert_partitions(batch.sparkSession, batch, path, keys, part)

    q = stream.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path)
