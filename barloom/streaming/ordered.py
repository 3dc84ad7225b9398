"""Causal state over a feed in any order: rows wait in their bar until the watermark has passed it.

The state of a key is one small vector and the open bars, a map from bar to the rows that have arrived for it. An
event-time timer at the end of each bar folds its rows in the order of (time, tie) and emits what was known before each;
a row that is late but not behind the watermark joins its bar. Memory of a task is one bar of a key. Where a key is hot,
ticks become bars in Spark's own windowed aggregation first (combined before the shuffle, so a key is split by bar and
by task), and the state gets one row for each bar; both operators are one streaming query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import shared_dir
from .bars import EVENT_SCHEMA, run_to_table
from .state import Step

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedState(StatefulProcessor):
    """Folds ``step`` over the rows (us: microseconds, tie, x) of a key in their order, bar by bar of ``bar_ms``."""

    def __init__(self, step: Step, bar_ms: int):
        self.step, self.bar_ms = step, bar_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.vector = handle.getValueState("vector", "v array<double>")
        self.open = handle.getMapState("open", "bar long", "ts array<long>, tie array<long>, x array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            frame = frame[frame["x"].notna()]
            for bar, some in frame.groupby(frame["us"] // (self.bar_ms * 1000)):
                columns = [some["us"].tolist(), some["tie"].tolist(), some["x"].tolist()]
                if self.open.containsKey((int(bar),)):
                    columns = [list(a) + b for a, b in zip(self.open.getValue((int(bar),)), columns, strict=True)]
                else:
                    self.handle.registerTimer((int(bar) + 1) * self.bar_ms)
                self.open.updateValue((int(bar),), tuple(columns))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bar = expiredTimerInfo.getExpiryTimeInMs() // self.bar_ms - 1
        rows = sorted(zip(*self.open.getValue((bar,)), strict=True))
        self.open.removeKey((bar,))
        v = list(self.vector.get()[0]) if self.vector.exists() else None
        prior = []
        for _, _, x in rows:
            v, before = self.step(v, float(x))
            prior.append(before)
        self.vector.update((v,))
        ts, tie, values = zip(*rows, strict=True)
        yield pd.DataFrame({"key": key[0], "us": ts, "tie": tie, "x": values, "prior": np.array([np.nan if p is None else p for p in prior], float)})

    def close(self) -> None:
        pass


def ordered_state(stream: DataFrame, key: str, ts: str, value: str, step: Step, tie: str | None = None, bar_ms: int = 86_400_000, out: str = "prior") -> DataFrame:
    """Stream of (key, ts, tie, value, ``out``): ``step`` (see state.py) over each key, in event-time order.

    ``stream`` has a watermark on ``ts``. A row is emitted once, when the watermark has passed the end of its bar, so rows
    may arrive in any order within the watermark's delay, in any file and batch. Rows of equal time follow ``tie`` (a
    long). Rows without a value are passed over. Needs the RocksDB state store (see draining()).
    """
    order = F.col(tie).cast("long") if tie else F.lit(0).cast("long")
    # microseconds do not depend on the session's time zone; ``ts`` itself carries the watermark
    rows = stream.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("us"), order.alias("tie"), F.col(value).cast("double").alias("x"))
    schema = f"key {stream.schema[key].dataType.simpleString()}, us long, tie long, x double, prior double"
    done = rows.groupBy("key").transformWithStateInPandas(statefulProcessor=OrderedState(step, bar_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return done.select(F.col("key").alias(key), F.timestamp_micros("us").alias(ts), "tie", F.col("x").alias(value), F.col("prior").alias(out))


def last_of_bars(ticks: DataFrame, length: str) -> DataFrame:
    """Stream of (code, ts, price, n): last price of each bar at its end; ``ticks`` has a watermark on ``ts``."""
    last = F.max(F.struct("ts", "event_id", "price"))
    bars = ticks.groupBy("code", F.window("ts", length).alias("w")).agg(last.alias("last"), F.count(F.lit(1)).alias("n"))
    # window_time keeps the watermark for the state behind; the bar's end is one microsecond later
    return bars.select("code", F.window_time("w").alias("ts"), F.col("last.price").alias("price"), "n")


def stage_shuffled(spark: SparkSession, events: str, files: int = 8, deliveries: int = 1) -> str:
    """The event table in ``files`` files of no time order in the shared folder, each row in ``deliveries`` of them."""
    path = shared_dir(spark, "feed")
    rows = spark.read.schema(EVENT_SCHEMA).parquet(events).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(deliveries))))
    rows.repartition(files, F.xxhash64("event_id", "copy")).drop("copy").write.parquet(path)
    return path


def close_feed(spark: SparkSession, path: str, after: str) -> None:
    """Add a row without code or value ``after`` the last one, which moves the watermark over all bars."""
    end = spark.read.schema(EVENT_SCHEMA).parquet(path).agg((F.max("ts") + F.expr(f"interval {after}")).alias("ts"))
    columns = [F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields]
    end.where("ts is not null").select(*columns).coalesce(1).write.mode("append").parquet(path)


def drain(spark: SparkSession, plan: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """run_to_table() with the state store that ordered_state() needs; what the session had is set again."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return run_to_table(plan, path=path, checkpoint=checkpoint)
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def drain_closed(spark: SparkSession, feed: str, plan: DataFrame, after: str) -> DataFrame:
    """Drain a feed, close it, and go on from the checkpoint with what the closing row releases."""
    path, checkpoint = shared_dir(spark, "stream"), shared_dir(spark, "stream-ckpt")
    drain(spark, plan, path, checkpoint)
    close_feed(spark, feed, after)
    return drain(spark, plan, path, checkpoint)
