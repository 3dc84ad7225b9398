"""Streaming plans: each drains the event table as a file stream into a table and returns the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..sources import tables as t
from ..streaming import bars, ordered, state
from . import query
from . import sqltext as q
from .recursions import MEANS, START, TRANS, VARS, ewma_sql
from .sqltext import r



def _source(spark, sf):
    return bars.tick_stream(spark, f"{sf}/events.parquet")


DELAY = "73000 days"  # a backlog in any order: every row is in time, and the closing row releases all of them


def _feed(spark, sf):
    """The event table as shuffled files, and its ticks as a stream that takes two files a batch."""
    feed = ordered.stage_shuffled(spark, f"{sf}/events.parquet")
    return feed, bars.tick_stream(spark, feed, files_per_trigger=2).withWatermark("ts", DELAY)


def _prior(spark, sf, step):
    """What ``step`` knew before each tick."""
    feed, ticks = _feed(spark, sf)
    d = ordered.drain_closed(spark, feed, ordered.ordered_state(ticks, "code", "ts", "price", step, tie="event_id"), "73400 days")
    return d.select("code", "ts", r6("prior").alias("prior"))


def _bar_sql(length: str, starts: str) -> str:
    return f"""WITH x AS (SELECT event_type AS code, {starts} AS w_start, ts, value FROM events), b AS (SELECT code, w_start, w_start + INTERVAL '{length}' AS w_end, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS n FROM x GROUP BY code, w_start)
 SELECT code, w_start AS start, n, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close FROM b"""


def _bars(spark, sf, length, slide=None):
    return bars.merge_bar_parts(bars.run_parts(_source(spark, sf), lambda b: bars.bar_parts(b, length, slide)))


def _bars_out(df):
    return df.select("code", "start", "n", *[r6(c).alias(c) for c in ("open", "high", "low", "close")])


@query("stream_bars_tumbling", _bar_sql("30 minutes", "time_bucket(INTERVAL '30 minutes', ts)"))
def _(spark, sf):
    return _bars_out(_bars(spark, sf, "30 minutes"))


@query("stream_bars_sliding", _bar_sql("60 minutes", "unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes'])"))
def _(spark, sf):
    return _bars_out(_bars(spark, sf, "60 minutes", "30 minutes"))


SESS = """WITH o AS (SELECT user_id, ts, value, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR > ts THEN 0 ELSE 1 END AS nw FROM events), i AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS isl FROM o),
 s AS (SELECT user_id, isl, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS w_end, count(*) AS n, sum(value) AS total FROM i GROUP BY user_id, isl)"""


@query("stream_sessions", f"{SESS} SELECT user_id, start, w_end AS \"end\", n, {r('total')} AS total FROM s")
def _(spark, sf):
    s = bars.chain_sessions(bars.run_parts(_source(spark, sf), lambda b: bars.session_parts(b, "user_id")), "user_id", 120)
    return s.select("user_id", "start", "end", "n", r6("total").alias("total"))


@query("batch_sessions", f"{SESS} SELECT user_id, start, w_end AS \"end\", n, {r('total')} AS total FROM s")
def _(spark, sf):
    s = bars.batch_sessions(t.ticks(spark, sf), "user_id", 120)
    return s.select("user_id", "start", "end", "n", r6("total").alias("total"))


@query("stream_upsert", f"""SELECT event_type AS code, user_id, CAST(ts AS DATE) AS day, max(ts) AS ts, {r('arg_max(value, ts)')} AS price FROM events GROUP BY ALL""")
def _(spark, sf):
    keys = ["code", "user_id", "day"]
    last = F.max(F.struct("ts", "event_id", "price")).alias("last")
    parts = bars.run_parts(_source(spark, sf), lambda b: b.withColumn("day", F.to_date("ts")).groupBy(*keys).agg(last))
    out = parts.groupBy(*keys).agg(F.max("last").alias("last"))
    return out.select(*keys, "last.ts", r6(F.col("last.price")).alias("price"))


@query("stream_dedupe", "SELECT event_id, event_type AS code FROM events")
def _(spark, sf):
    """Every event is delivered twice, in files of any order; the first delivery within the watermark counts."""
    feed = ordered.stage_shuffled(spark, f"{sf}/events.parquet", deliveries=2)
    ticks = bars.tick_stream(spark, feed, files_per_trigger=2)
    return ordered.drain(spark, bars.dedupe_stream(ticks, ["event_id"], DELAY).select("event_id", "code"))


TK = "WITH tk AS (SELECT event_type AS code, ts, value AS price, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS pos FROM events)"


@query("stream_ewma_state", f"{TK}, e AS (SELECT code, ts, pos, {ewma_sql('price', 0.94)} AS v FROM tk) SELECT code, ts, {r('lag(v) OVER (PARTITION BY code ORDER BY pos)')} AS prior FROM e")
def _(spark, sf):
    return _prior(spark, sf, state.ewma_step(0.94))


def _pdf(x, j):
    return f"exp(-0.5 * (ln(2 * pi() * {VARS[j]}) + power({x} - {MEANS[j]}, 2) / {VARS[j]}))"


@query("stream_regime_state", "WITH RECURSIVE" + TK[4:] + f""", z AS (SELECT code, ts, pos, {_pdf('(price / 1000)', 0)} AS f0, {_pdf('(price / 1000)', 1)} AS f1 FROM tk),
  h AS (SELECT code, ts, pos, {START[1]} * f1 / ({START[0]} * f0 + {START[1]} * f1) AS p, NULL::DOUBLE AS prior FROM z WHERE pos = 0 UNION ALL
   SELECT z.code, z.ts, z.pos, z.f1 * ((1 - h.p) * {TRANS[0][1]} + h.p * {TRANS[1][1]}) /
     (z.f0 * ((1 - h.p) * {TRANS[0][0]} + h.p * {TRANS[1][0]}) + z.f1 * ((1 - h.p) * {TRANS[0][1]} + h.p * {TRANS[1][1]})), h.p FROM h JOIN z ON z.code = h.code AND z.pos = h.pos + 1)
 SELECT code, ts, {r('prior')} AS prior FROM h""")
def _(spark, sf):
    step = state.regime_step(MEANS, VARS, TRANS, START)
    return _prior(spark, sf, lambda v, x: step(v, x / 1000))


BARTK = """WITH x AS (SELECT event_type AS code, time_bucket(INTERVAL '30 minutes', ts) AS w_start, ts, value FROM events), b AS (SELECT code, w_start + INTERVAL '30 minutes' AS w_end, arg_max(value, ts) AS price FROM x GROUP BY code, w_start),
 tk AS (SELECT code, w_end AS ts, price, row_number() OVER (PARTITION BY code ORDER BY w_end) - 1 AS pos FROM b)"""


@query("stream_bar_ewma_state", f"{BARTK}, e AS (SELECT code, ts, pos, {ewma_sql('price', 0.94)} AS v FROM tk) SELECT code, ts, {r('lag(v) OVER (PARTITION BY code ORDER BY pos)')} AS prior FROM e")
def _(spark, sf):
    """Bars first, then state: a hot code reaches the state as one row per bar."""
    feed, ticks = _feed(spark, sf)
    plan = ordered.ordered_state(ordered.last_of_bars(ticks, "30 minutes"), "code", "ts", "price", state.ewma_step(0.94))
    d = ordered.drain_closed(spark, feed, plan, "73400 days")
    return d.select("code", F.date_trunc("second", F.col("ts") + F.expr("interval 1 millisecond")).alias("ts"), r6("prior").alias("prior"))
