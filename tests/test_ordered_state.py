"""Streaming state over files in any order: batches, restarts, late rows, ties, and bars before state."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.session import shared_dir
from barloom.streaming import bars, ordered, state

T0 = dt.datetime(2024, 1, 1)
HOUR = 3_600_000


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def write(spark, folder, rows):
    """Rows (event_id, minutes, code, price) as one more file."""
    data = [(i, at(m), 1, c, x, "{}") for i, m, c, x in rows]
    spark.createDataFrame(data, bars.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def priors(rows, lam):
    """Exponential average before each row, in the order of (time, id) within each code."""
    want, known = {}, {}
    for i, _, c, x in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[1], r[0])):
        want[i] = known.get(c)
        known[c] = x if known.get(c) is None else lam * known[c] + (1 - lam) * x
    return want


@pytest.fixture()
def feed():
    rng = random.Random(4)
    rows = [(i, rng.randrange(600), rng.choice("aab"), rng.random()) for i in range(240)]
    return rows + [(240, 30, "a", None), (241, rows[0][1], rows[0][2], 5.0)]


def test_shuffled_files_and_restarts_give_the_ordered_state(spark, feed):
    folder, out, checkpoint = (shared_dir(spark, kind) for kind in ("in", "out", "ck"))
    write(spark, folder, feed[:60])
    plan = lambda: ordered.ordered_state(
        bars.tick_stream(spark, folder, files_per_trigger=1).withWatermark("ts", "1 day"), "code", "ts", "price", state.ewma_step(0.9), tie="event_id", bar_ms=HOUR)
    assert ordered.drain(spark, plan(), out, checkpoint).count() == 0  # nothing is final within the delay
    write(spark, folder, feed[60:150])
    write(spark, folder, feed[150:])
    ordered.drain(spark, plan(), out, checkpoint)  # goes on from the checkpoint
    ordered.close_feed(spark, folder, "3 days")
    got = ordered.drain(spark, plan(), out, checkpoint).collect()
    want = priors(feed, 0.9)
    assert sorted(r["tie"] for r in got) == sorted(want)
    for r in got:
        assert r["prior"] == (None if want[r["tie"]] is None else pytest.approx(want[r["tie"]], abs=1e-12))


def test_rows_leave_when_the_watermark_has_passed_their_bar(spark):
    folder, out, checkpoint = (shared_dir(spark, kind) for kind in ("in", "out", "ck"))
    plan = lambda: ordered.ordered_state(
        bars.tick_stream(spark, folder).withWatermark("ts", "30 minutes"), "code", "ts", "price", state.ewma_step(0.5), tie="event_id", bar_ms=HOUR)
    write(spark, folder, [(0, 5, "a", 1.0), (1, 50, "a", 3.0), (2, 80, "a", 9.0)])
    assert ordered.drain(spark, plan(), out, checkpoint).count() == 0
    write(spark, folder, [(3, 55, "a", 5.0), (4, 95, "a", 7.0)])  # late, but not behind the watermark (50 minutes)
    first = ordered.drain(spark, plan(), out, checkpoint).orderBy("ts").collect()
    assert [(r["tie"], r["prior"]) for r in first] == [(0, None), (1, 1.0), (3, 2.0)]
    write(spark, folder, [(5, 10, "a", 100.0), (6, 200, "a", 1.0)])  # row 5 is behind it
    second = ordered.drain(spark, plan(), out, checkpoint).orderBy("ts").collect()
    assert [(r["tie"], r["prior"]) for r in second] == [(0, None), (1, 1.0), (3, 2.0), (2, 3.5), (4, 6.25)]


def test_bars_before_state_in_one_query(spark, feed):
    folder = shared_dir(spark, "in")
    write(spark, folder, feed[:100])
    write(spark, folder, feed[100:])
    ticks = bars.tick_stream(spark, folder, files_per_trigger=1).withWatermark("ts", "1 day")
    plan = ordered.ordered_state(ordered.last_of_bars(ticks, "20 minutes"), "code", "ts", "price", state.ewma_step(0.8))
    got = ordered.drain_closed(spark, folder, plan, "3 days").collect()
    last = {}
    for i, m, c, x in sorted(feed, key=lambda r: (r[1], r[0])):
        last[c, m // 20] = (i, m // 20, c, x)
    bar_rows = [(k, b, c, x) for k, (_, b, c, x) in enumerate(last.values()) if x is not None]
    want = {(c, b): p for (k, b, c, _), p in zip(bar_rows, (priors(bar_rows, 0.8)[k] for k, *_ in bar_rows), strict=True)}
    found = {(r["code"], (r["ts"] - T0) // dt.timedelta(minutes=20)): r["prior"] for r in got}
    assert found.keys() == want.keys()
    for key, p in want.items():
        assert found[key] == (None if p is None else pytest.approx(p, abs=1e-12))


def test_the_session_keeps_its_state_store(spark):
    before = spark.conf.get(ordered.PROVIDER, None)
    folder = shared_dir(spark, "in")
    write(spark, folder, [(0, 1, "a", 1.0)])
    plan = ordered.ordered_state(bars.tick_stream(spark, folder).withWatermark("ts", "1 day"), "code", "ts", "price", state.drawdown_step())
    assert ordered.drain(spark, plan.where(F.col("prior") > 5)).collect() == []
    assert spark.conf.get(ordered.PROVIDER, None) == before
