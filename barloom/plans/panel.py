"""Scans, cleaning, alignment and resampling plans."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.columns import month_index, r6, year_of
from ..operators import aggregate as ag
from ..operators import align, clean
from ..operators.clock import Clock, with_calendar, with_position
from ..session import shared_dir
from ..sources import keyed, parse, sinks
from ..sources import tables as t
from . import query
from . import sqltext as q
from .sqltext import r

OHLC = ["open", "high", "low", "close"]
R_OHLC = ", ".join(f"{r(c)} AS {c}" for c in OHLC)


@query("panel_daily_ohlcv", f"WITH {q.DAILY} SELECT code, date, {R_OHLC}, {r('volume')} AS volume, {r('turnover', 2)} AS turnover FROM daily")
def _(spark, sf):
    return t.daily_panel(spark, sf).select("code", "date", *[r6(c).alias(c) for c in [*OHLC, "volume"]], r6("turnover", 2).alias("turnover"))


@query("scan_projection", f"""SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, {r('l_extendedprice', 2)} AS amount
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'""")
def _(spark, sf):
    return (
        t.table(spark, sf, "lineitem")
        .where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp"))
        .select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("date"), r6("l_extendedprice", 2).alias("amount"))
    )


@query("field_panel", f"""WITH {q.MONTHLY} SELECT mi // 12 AS yr, {', '.join(f"{r(f'max(CASE WHEN mi % 12 = {m} THEN s END)', 2)} AS m{m + 1}" for m in range(12))}
  FROM (SELECT mi, sum(turnover) AS s FROM monthly GROUP BY mi) GROUP BY 1""")
def _(spark, sf):
    m = t.monthly_panel(spark, sf).groupBy("mi").agg(F.sum("turnover").alias("s"))
    m = m.withColumns({"yr": F.floor(F.col("mi") / 12), "mm": F.col("mi") % 12 + 1})
    out = m.groupBy("yr").pivot("mm", list(range(1, 13))).agg(F.max("s"))
    return out.select("yr", *[r6(F.col(f"`{i}`"), 2).alias(f"m{i}") for i in range(1, 13)])


def _raw_prices(spark, sf):
    """Monthly closes rendered as vendor text: day-first dates, thousands commas, some bad prices."""
    m = t.monthly_panel(spark, sf)
    d = F.col("month")
    text = F.format_number(F.col("close"), 10)
    return m.select(
        "code",
        F.when(F.col("code") % 2 == 0, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy")).alias("Date"),
        F.when(F.col("mi") % 7 == 0, "-").otherwise(text).alias("Price"),
        F.col("mi").alias("row_id"),
    )


def _keyed_folder(spark, sf):
    """The monthly panel as one file for each instrument, written by the committing sink in two appends."""
    keyed.register(spark)
    path = shared_dir(spark, "keyed")
    m = t.monthly_panel(spark, sf).select(F.col("code").cast("string").alias("code"), "month", "close", "volume")
    for half in (0, 1):
        part = m.where(F.pmod(F.year("month"), F.lit(2)) == half)
        part.repartition("code").sortWithinPartitions("code").write.format("keyed_files").option("key", "code").mode("append").save(path)
    return path


@query("sink_partitioned", f"WITH {q.MONTHLY} SELECT code::VARCHAR AS code, month AS date, {r('close', 4)} AS close, {r('volume', 4)} AS volume FROM monthly")
def _(spark, sf):
    d = spark.read.format("keyed_files").load(_keyed_folder(spark, sf))
    return d.select("code", F.col("month").alias("date"), r6("close", 4).alias("close"), r6("volume", 4).alias("volume"))


@query("scan_file_per_key", f"""WITH {q.MONTHLY} SELECT code::VARCHAR AS code, count(*) AS months, min(month) AS first, {r('arg_max(close, month)', 4)} AS last_close FROM monthly
  WHERE code IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) GROUP BY code""")
def _(spark, sf):
    """Only the files of the active instruments are opened, and only the columns of the schema are read."""
    active = t.symbols(spark, sf).where("status = 'active'").select(F.col("code").cast("string").alias("code"))
    keys = json.dumps([x["code"] for x in active.collect()])  # the symbol master
    d = spark.read.format("keyed_files").option("keys", keys).schema("code string, month date, close double").load(_keyed_folder(spark, sf))
    d = d.groupBy("code").agg(F.count(F.lit(1)).alias("months"), F.min("month").alias("first"), F.max_by("close", "month").alias("c"))
    return d.select("code", "months", "first", r6("c", 4).alias("last_close"))


@query("scan_locale_prices", f"WITH {q.MONTHLY} SELECT code, month AS date, {r('close', 4)} AS close FROM monthly WHERE mi % 7 <> 0")
def _(spark, sf):
    return parse.parse_locale_prices(_raw_prices(spark, sf)).select("code", "date", r6("close", 4).alias("close"))


@query("scan_dual_column", f"WITH {q.MONTHLY} SELECT code, month AS date, {r('close', 4)} AS close, {r('volume', 4)} AS volume FROM monthly WHERE mi % 7 <> 0")
def _(spark, sf):
    raw = _raw_prices(spark, sf).join(t.monthly_panel(spark, sf).select("code", F.col("mi").alias("row_id"), F.format_number("volume", 6).alias("Low")), ["code", "row_id"])
    return parse.parse_locale_prices(raw, extra={"volume": "Low"}).select("code", "date", r6("close", 4).alias("close"), r6("volume", 4).alias("volume"))


@query("scan_day_first", f"WITH {q.MONTHLY} SELECT code, code % 2 = 0 AS day_first FROM monthly GROUP BY code")
def _(spark, sf):
    return parse.day_first_flags(_raw_prices(spark, sf), "code", "Date")


@query("scan_unit_volume", f"""WITH {q.MONTHLY} SELECT code, mi, {r('close', 4)} AS close, {r('turnover', 0)} AS volume FROM monthly WHERE code % 5 <> 0""")
def _(spark, sf):
    m = t.monthly_panel(spark, sf)
    px = F.when(F.col("code") % 5 == 0, "n/a").otherwise(F.format_number("close", 10))
    vol = F.when(F.col("turnover") >= 1e6, F.concat(F.format_number(F.col("turnover") / 1e6, 12), F.lit("M"))).otherwise(
        F.concat(F.format_number(F.col("turnover") / 1e3, 10), F.lit("K"))
    )
    raw = m.select("code", "mi", px.alias("Open"), px.alias("High"), px.alias("Low"), px.alias("Price"), vol.alias("Vol."))
    out = parse.parse_ohlcv(raw, {"open": "Open", "high": "High", "low": "Low", "close": "Price", "volume": "Vol."})
    return out.select("code", "mi", r6("close", 4).alias("close"), r6("volume", 0).alias("volume"))


@query("scan_macro_series", f"""SELECT date, {r('value', 2)} AS value FROM (
  SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS value FROM orders GROUP BY 1) WHERE dayofweek(date) NOT IN (0, 6)""")
def _(spark, sf):
    o = t.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("v"))
    weekend = F.dayofweek("d").isin(1, 7)
    raw = o.select(F.col("d").cast("string").alias("DATE"), F.when(weekend, ".").otherwise(F.col("v").cast("string")).alias("VALUE"))
    return parse.parse_macro(raw, "DATE", "VALUE").select("date", r6("value", 2).alias("value"))


@query("statements_from_json", f"""WITH {q.STATEMENTS} SELECT code, fiscal_date,
   CAST(CASE WHEN quarter(fiscal_date) = 4 THEN fiscal_date + 45 ELSE fiscal_date + 120 END AS DATE) AS avail_date,
   {r('assets', 2)} AS assets, {r('sales', 2)} AS sales FROM statements""")
def _(spark, sf):
    s = t.statements(spark, sf)
    filed = F.when(F.quarter("fiscal_date") == 4, F.col("avail_date").cast("string"))
    key = F.col("fiscal_date").cast("string")
    raw = s.groupBy("code").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(key, F.struct(filed.alias("filing_date"), F.col("assets").cast("string").alias("totalAssets")))))).alias("bs"),
        F.to_json(F.map_from_entries(F.collect_list(F.struct(key, F.struct(F.col("sales").cast("string").alias("totalRevenue")))))).alias("inc"),
    )
    out = parse.parse_statements(raw, "code", "bs", "inc")
    return out.select("code", "fiscal_date", "avail_date", r6("assets", 2).alias("assets"), r6("sales", 2).alias("sales"))


@query("json_record_flatten", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def _(spark, sf):
    e = t.table(spark, sf, "events")
    return e.withColumn("p", F.from_json("props", "k BIGINT")).select("event_id", F.col("p.k").alias("k"))


@query("symbol_master_union", f"""WITH {q.SYMBOLS}, two AS (
   SELECT code, name, status, 0 AS prio FROM symbols WHERE status = 'active' UNION ALL
   SELECT code, name || ' (old)' AS name, 'delisted' AS status, 1 AS prio FROM symbols WHERE currency = 'GBX')
 SELECT code, arg_min(name, prio) AS name, arg_min(status, prio) AS status FROM two GROUP BY code""")
def _(spark, sf):
    s = t.symbols(spark, sf)
    active = s.where("status = 'active'").select("code", "name", "status")
    old = s.where("currency = 'GBX'").select("code", F.concat("name", F.lit(" (old)")).alias("name"), F.lit("delisted").alias("status"))
    return parse.first_wins([active, old], "code")


@query("instrument_profile", f"WITH {q.SYMBOLS} SELECT currency, status, count(*) AS n, count(DISTINCT nation) AS nations FROM symbols GROUP BY ALL")
def _(spark, sf):
    return t.symbols(spark, sf).groupBy("currency", "status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("nation").alias("nations"))


@query("vendor_normalise", f"""WITH {q.MONTHLY} SELECT 'T-' || code AS code, month AS date, {r('close', 4)} AS close, {r('volume')} AS volume
  FROM monthly WHERE mi % 5 <> 0""")
def _(spark, sf):
    m = t.monthly_panel(spark, sf)
    keep = F.col("mi") % 5 != 0
    raw = m.select(
        F.concat(F.lit("t."), F.col("code")).alias("ticker"), F.col("month").alias("date"),
        F.when(keep, F.col("close")).alias("Close"), F.when(keep, F.col("volume")).alias("Volume"), F.lit(1).alias("Splits"),
    )
    return parse.normalise_vendor(raw, "ticker").select("code", "date", r6("close", 4).alias("close"), r6("volume").alias("volume"))


@query("upsert_bars", f"""WITH {q.bars(60)} SELECT code, ts, {r('CASE WHEN ts >= TIMESTAMP ' + "'2024-01-10'" + ' THEN close * 1.01 ELSE close END')} AS close FROM bars""")
def _(spark, sf):
    b = t.bars(t.ticks(spark, sf), 60).select("code", "ts", "close")
    old = b.where("ts < TIMESTAMP '2024-01-20'")
    fresh = b.where("ts >= TIMESTAMP '2024-01-10'").withColumn("close", F.col("close") * 1.01)
    return sinks.merge_bars(old, fresh, ["code", "ts"]).select("code", "ts", r6("close").alias("close"))


@query("panel_manifest", f"WITH {q.DAILY} SELECT code, count(*) AS bars, min(date) AS start, max(date) AS \"end\" FROM daily GROUP BY code")
def _(spark, sf):
    return sinks.manifest(t.daily_panel(spark, sf))


@query("resume_list", f"WITH {q.MONTHLY} SELECT DISTINCT code, mi FROM monthly WHERE (code, mi) NOT IN (SELECT (code, mi) FROM monthly WHERE turnover > 500000)")
def _(spark, sf):
    m = t.monthly_panel(spark, sf)
    return sinks.todo(m.select("code", "mi"), m.where("turnover > 500000"), ["code", "mi"])


@query("panel_wick_repair", f"""WITH {q.DAILY} SELECT code, date, {r('CASE WHEN low < 0.5 * least(open, close) THEN least(open, close) ELSE low END')} AS low,
  {r('CASE WHEN high > greatest(open, close) / 0.5 THEN greatest(open, close) ELSE high END')} AS high FROM daily""")
def _(spark, sf):
    d = clean.wick_repair(t.daily_panel(spark, sf))
    return d.select("code", "date", r6("low").alias("low"), r6("high").alias("high"))


@query("panel_wick_clamp", f"""WITH {q.DAILY} SELECT code, date, {r('greatest(least(low, close), 0.5 * close)')} AS low,
  {r('greatest(least(high, 2 * close), close)')} AS high FROM daily""")
def _(spark, sf):
    d = clean.wick_clamp(t.daily_panel(spark, sf))
    return d.select("code", "date", r6("low").alias("low"), r6("high").alias("high"))


@query("panel_winsorised_returns", f"WITH {q.RETS} SELECT code, date, {r('CASE WHEN lret IS NOT NULL THEN greatest(least(lret, 0.6), -0.6) END')} AS lret FROM rets")
def _(spark, sf):
    return t.daily_returns(spark, sf).select("code", "date", r6(clean.winsorise("lret", 0.6)).alias("lret"))


@query("panel_quality_gate", f"""WITH {q.RETS}, g AS (SELECT code FROM rets GROUP BY code HAVING count(*) >= 500 AND max(abs(lret)) <= 6.5)
 SELECT code, count(*) AS n_obs, {r('max(abs(lret))')} AS max_abs_ret FROM rets WHERE code IN (SELECT code FROM g) GROUP BY code""")
def _(spark, sf):
    d = clean.quality_gate(t.daily_returns(spark, sf), 500, 6.5)
    return clean.series_quality(d).withColumn("max_abs_ret", r6("max_abs_ret"))


@query("panel_causal_gate", f"""WITH {q.RETS} SELECT code, date FROM (SELECT code, date, count(*) OVER k AS n, max(abs(lret)) OVER k AS m
  FROM rets WINDOW k AS (PARTITION BY code ORDER BY pos)) WHERE n >= 60 AND m <= 3.5""")
def _(spark, sf):
    return clean.causal_quality_gate(t.daily_returns(spark, sf), 60, 3.5).select("code", "date")


FLAGS = q.RETS + """, fl AS (SELECT code, coalesce(abs(lret) > 1.5 AND abs(lret + nx) < 0.5, false) AS bp,
   coalesce(abs(lret) > 1.5 AND abs(pv) < 0.7 AND abs(nx) < 0.7, false) AS st
  FROM (SELECT *, lead(lret) OVER k AS nx, lag(lret) OVER k AS pv FROM rets WINDOW k AS (PARTITION BY code ORDER BY pos)))"""


def _flags(spark, sf):
    return clean.bad_print_flags(t.daily_returns(spark, sf), thr=1.5, resid=0.5, calm=0.7)


@query("panel_bad_prints", f"WITH {FLAGS} SELECT code, count(*) FILTER (WHERE bp) AS n_bad FROM fl GROUP BY code")
def _(spark, sf):
    return _flags(spark, sf).groupBy("code").agg(F.count_if("bad_print").alias("n_bad"))


@query("panel_iso_steps", f"WITH {FLAGS} SELECT code, count(*) FILTER (WHERE st) AS n_steps FROM fl GROUP BY code")
def _(spark, sf):
    return _flags(spark, sf).groupBy("code").agg(F.count_if("iso_step").alias("n_steps"))


@query("panel_clean_universe", f"""WITH {FLAGS} SELECT code, count(*) FILTER (WHERE bp) AS n_bad, count(*) FILTER (WHERE st) AS n_steps,
  count(*) FILTER (WHERE bp) <= 40 AND count(*) FILTER (WHERE st) <= 12 AS kept FROM fl GROUP BY code""")
def _(spark, sf):
    return clean.clean_universe(_flags(spark, sf), 40, 12)


@query("panel_dedupe_last", f"""SELECT user_id, CAST(ts AS DATE) AS day, arg_max(event_type, ts) AS event_type, {r('arg_max(value, ts)')} AS value
  FROM events GROUP BY ALL""")
def _(spark, sf):
    e = t.table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_type", "value")
    return clean.keep_last(e, ["user_id", "day"], "ts").select("user_id", "day", "event_type", r6("value").alias("value"))


@query("panel_eligibility_mask", f"""WITH {q.RETS} SELECT code, date, elig, {r('CASE WHEN elig THEN lret END')} AS lret FROM (
  SELECT code, date, lret, coalesce(avg(turnover) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) > 75000, false)
   AND lret IS NOT NULL AS elig FROM rets)""")
def _(spark, sf):
    d = t.daily_returns(spark, sf)
    liq = F.avg("turnover").over(Clock("code").back(20, 1))
    d = d.withColumn("elig", F.coalesce(liq > 75000, F.lit(False)) & F.col("lret").isNotNull())
    return d.select("code", "date", "elig", r6(F.when(F.col("elig"), F.col("lret"))).alias("lret"))


@query("panel_ever_eligible", f"""WITH {q.MONTHLY} SELECT code, mi FROM monthly WHERE code IN (SELECT code FROM monthly WHERE turnover > 900000)""")
def _(spark, sf):
    m = t.monthly_panel(spark, sf).withColumn("hot", F.col("turnover") > 900000)
    return clean.ever_true(m, "hot").select("code", "mi")


@query("panel_stale_pinned", f"""WITH {q.DAILY}, l AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS rn FROM daily)
 SELECT code, max(date) AS last_date, {r('(max(close) - min(close)) / avg(close)')} AS rel_range,
  datediff('day', max(date), DATE '2001-11-04') > 7 OR (max(close) - min(close)) / avg(close) < 0.03 AS dropped FROM l WHERE rn <= 40 GROUP BY code""")
def _(spark, sf):
    out = clean.stale_or_pinned(t.daily_panel(spark, sf), F.lit("2001-11-04").cast("date"))
    return out.withColumn("rel_range", r6("rel_range"))


@query("session_prefix", f"""WITH {q.bars(30)}, s AS (SELECT *, CAST(ts - INTERVAL 5 HOUR AS DATE) AS session,
    (hour(ts - INTERVAL 5 HOUR) * 60 + minute(ts - INTERVAL 5 HOUR)) // 30 AS slot FROM bars),
  p AS (SELECT *, row_number() OVER (PARTITION BY code, session ORDER BY slot) - 1 AS bar_no FROM s WHERE slot >= 19 AND slot < 32)
 SELECT code, session, bar_no, {r('close')} AS close, count(*) OVER (PARTITION BY code, session) AS n_bars
 FROM p WHERE slot = bar_no + 19 QUALIFY count(*) OVER (PARTITION BY code, session) >= 4""")
def _(spark, sf):
    out = session_bars(spark, sf)
    return out.select("code", "session", F.col("bar_no").cast("long").alias("bar_no"), r6("close").alias("close"), "n_bars")


def session_bars(spark, sf, minutes: int = 30, min_bars: int = 4):
    """New York regular-session bars, contiguous from the open."""
    b = t.bars(t.ticks(spark, sf), minutes)
    ny = F.from_utc_timestamp("ts", "America/New_York")
    b = b.withColumns({"session": F.to_date(ny), "slot": F.floor((F.hour(ny) * 60 + F.minute(ny)) / minutes)})
    first, last = 570 // minutes, 960 // minutes
    return clean.contiguous_prefix(b.where(F.col("slot") < last), "slot", ["code", "session"], first, min_bars)


@query("threshold_book", f"""WITH {q.MSIG}, x AS (SELECT *, turnover / avg(turnover) OVER (PARTITION BY mi) AS liq_ratio FROM msig WHERE mom IS NOT NULL),
  c AS (SELECT quantile_cont(mom, 1.0/3) AS q1, quantile_cont(mom, 2.0/3) AS q2 FROM x)
 SELECT code, mi, {r('liq_ratio')} AS liq_ratio, {r('mom')} AS mom FROM x, c WHERE liq_ratio >= 1.1 AND mom > q1 AND mom <= q2""")
def _(spark, sf):
    from ..operators import xsec

    n = xsec.splits_for(t.instrument_count(spark, sf))
    m = monthly_signals(spark, sf).where("mom IS NOT NULL")
    x = xsec.with_stats(m, "mi", {"mt": F.avg("turnover")}, n).withColumn("liq_ratio", F.col("turnover") / F.col("mt"))
    # pooled terciles over the whole book: exact, split over tasks by value range
    cuts = xsec.quantiles(x.withColumn("g", F.lit(0)), "g", "mom", [1 / 3, 2 / 3], "code", max(n, 8)).drop("g")
    x = x.crossJoin(F.broadcast(cuts))  # exactly one row of two thresholds
    x = x.where((F.col("liq_ratio") >= 1.1) & (F.col("mom") > F.col("q")[0]) & (F.col("mom") <= F.col("q")[1]))
    return x.select("code", "mi", r6("liq_ratio").alias("liq_ratio"), r6("mom").alias("mom"))


def monthly_signals(spark, sf):
    """Monthly panel with clipped return, 12-1 momentum and next month's return on the month clock."""
    from ..operators import rolling

    c = Clock("code", "mi")
    m = t.monthly_panel(spark, sf)
    m = m.withColumns(
        {
            "mret": F.expm1(clean.winsorise(F.log(F.col("close") / c.at("close", -1)), 0.6)),
            "mom": rolling.momentum(c, "close", 12, 1),
        }
    )
    return m.withColumn("fret", c.at("mret", 1))


@query("market_percentiles", f"""WITH {q.RETS} SELECT year(date) AS yr, {', '.join(f"{r(f'quantile_cont(lret, {p})')} AS p{int(p * 100)}" for p in (0.01, 0.25, 0.5, 0.75, 0.99))},
  count(*) FILTER (WHERE abs(lret) > 2) AS n_extreme, {r('max(abs(lret))')} AS max_abs FROM rets WHERE lret IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    from ..operators import xsec

    ps = [0.01, 0.25, 0.5, 0.75, 0.99]
    d = t.daily_returns(spark, sf).where("lret IS NOT NULL").withColumn("yr", year_of("date")).select("code", "yr", "pos", "lret")
    # a year pools every instrument and day, so its quantiles are split over tasks by value range
    qs = xsec.quantiles(d, "yr", "lret", ps, "code", max(8, xsec.splits_for(t.instrument_count(spark, sf) * 250)))
    ext = d.groupBy("yr").agg(F.count_if(F.abs("lret") > 2).alias("n_extreme"), r6(F.max(F.abs("lret"))).alias("max_abs"))
    return qs.join(ext, "yr").select("yr", *[r6(F.col("q")[i]).alias(f"p{int(p * 100)}") for i, p in enumerate(ps)], "n_extreme", "max_abs")


@query("train_test_split", f"""WITH {q.DAILY}, c AS (SELECT quantile_cont(datediff('day', DATE '1970-01-01', date), 0.6) AS cut FROM daily)
 SELECT code, datediff('day', DATE '1970-01-01', date) <= cut AS is_train, count(*) AS n FROM daily, c GROUP BY ALL""")
def _(spark, sf):
    d = clean.time_quantile_split(t.daily_panel(spark, sf).select("code", "date"))
    return d.groupBy("code", "is_train").agg(F.count(F.lit(1)).alias("n"))


ERAS = [("early", "1995-01-01", "1997-12-31"), ("crisis", "1998-07-01", "1998-12-31"), ("late", "1999-01-01", "2001-12-31")]


@query("era_split", f"""WITH {q.RETS}, e AS (SELECT 'early' AS era, DATE '1995-01-01' AS lo, DATE '1997-12-31' AS hi UNION ALL
   SELECT 'crisis', DATE '1998-07-01', DATE '1998-12-31' UNION ALL SELECT 'late', DATE '1999-01-01', DATE '2001-12-31')
 SELECT era, count(lret) AS n, {r('avg(lret)')} AS mean_lret FROM rets JOIN e ON date BETWEEN lo AND hi GROUP BY era""")
def _(spark, sf):
    d = t.daily_returns(spark, sf).withColumn("era", clean.era_of("date", ERAS)).where("era IS NOT NULL")
    return d.groupBy("era").agg(F.count("lret").alias("n"), r6(F.avg("lret")).alias("mean_lret"))


@query("thirds_split", f"""WITH {q.RETS}, b AS (SELECT date, avg(lret) AS x FROM rets WHERE lret IS NOT NULL GROUP BY date)
 SELECT part, count(*) AS n, {r('avg(x)')} AS mean_x, min(date) AS lo FROM (SELECT *, ntile(3) OVER (ORDER BY date) AS part FROM b) GROUP BY part""")
def _(spark, sf):
    book = t.daily_returns(spark, sf).where("lret IS NOT NULL").groupBy("date").agg(F.avg("lret").alias("x"))
    out = clean.split_parts(book, 3, ["date"])
    return out.groupBy(F.col("part").cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x")).alias("mean_x"), F.min("date").alias("lo"))


@query("split_half_universe", f"""WITH {q.DAILY}, k AS (SELECT code, (row_number() OVER (ORDER BY code) - 1) % 2 AS half FROM (SELECT DISTINCT code FROM daily))
 SELECT half, count(*) AS n, count(DISTINCT code) AS names, {r('avg(close)')} AS mean_close FROM daily JOIN k USING (code) GROUP BY half""")
def _(spark, sf):
    d = clean.alternate_halves(t.daily_panel(spark, sf))
    return d.groupBy(F.col("half").cast("long").alias("half")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("code").alias("names"), r6(F.avg("close")).alias("mean_close")
    )


@query("heldout_universe", f"WITH {q.DAILY}, {q.SYMBOLS} SELECT code, count(*) AS n FROM daily WHERE code NOT IN (SELECT code FROM symbols WHERE status = 'active') GROUP BY code")
def _(spark, sf):
    original = t.symbols(spark, sf).where("status = 'active'").select("code")
    return t.daily_panel(spark, sf).join(original, "code", "left_anti").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("semi_membership", f"WITH {q.DAILY}, {q.SYMBOLS} SELECT code, count(*) AS n FROM daily WHERE code IN (SELECT code FROM symbols WHERE currency = 'GBX') GROUP BY code")
def _(spark, sf):
    gbx = t.symbols(spark, sf).where("currency = 'GBX'").select("code")
    return t.daily_panel(spark, sf).join(gbx, "code", "left_semi").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# ---- joins and alignment -------------------------------------------------------------------------

@query("date_align_inner", f"""WITH {q.DAILY}, a AS (SELECT date, avg(close) AS px FROM daily GROUP BY date),
  b AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS flow FROM orders GROUP BY 1)
 SELECT date, {r('px')} AS px, {r('flow', 2)} AS flow FROM a JOIN b USING (date)""")
def _(spark, sf):
    a = t.daily_panel(spark, sf).groupBy("date").agg(r6(F.avg("close")).alias("px"))
    b = t.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(r6(F.sum("o_totalprice"), 2).alias("flow"))
    return a.join(b, "date")


@query("panel_densify", f"""WITH {q.DAILY}, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS c FROM (SELECT DISTINCT date FROM daily)),
  s AS (SELECT code, min(c) AS lo, max(c) AS hi, count(*) AS listed FROM daily JOIN cal USING (date) GROUP BY code)
 SELECT code, hi - lo + 1 AS cells, listed, hi - lo + 1 - listed AS gaps FROM s""")
def _(spark, sf):
    d = with_calendar(t.daily_panel(spark, sf), t.trading_days(spark, sf)).select("code", "cal", "close")
    dense = align.densify(d, "code", "cal")
    out = dense.groupBy("code").agg(F.count(F.lit(1)).alias("cells"), F.count("close").alias("listed"))
    return out.withColumn("gaps", F.col("cells") - F.col("listed"))


@query("dimension_lookup", f"""WITH {q.MONTHLY}, {q.SYMBOLS} SELECT code, mi, {r("turnover * CASE WHEN currency = 'GBX' THEN 0.01 ELSE 1.0 END", 2)} AS turnover_gbp
  FROM monthly LEFT JOIN symbols USING (code)""")
def _(spark, sf):
    s = t.symbols(spark, sf).select("code", F.when(F.col("currency") == "GBX", 0.01).otherwise(1.0).alias("factor"))
    m = t.monthly_panel(spark, sf).join(s, "code", "left")
    return m.select("code", "mi", r6(F.col("turnover") * F.col("factor"), 2).alias("turnover_gbp"))


@query("asof_statements", f"""WITH {q.MONTHLY}, {q.STATEMENTS} SELECT m.code, m.mi, s.avail_date AS asof_date, {r('s.sales', 2)} AS sales, {r('s.assets', 2)} AS assets
  FROM monthly m ASOF LEFT JOIN statements s ON m.code = s.code AND m.month >= s.avail_date""")
def _(spark, sf):
    m = t.monthly_panel(spark, sf).select("code", "mi", "month")
    out = align.asof_last(m, t.statements(spark, sf), "code", "month", "avail_date", ["sales", "assets"])
    return out.select("code", "mi", "asof_date", r6("sales", 2).alias("sales"), r6("assets", 2).alias("assets"))


@query("dividend_snap", f"""WITH {q.DAILY}, {q.STATEMENTS}, c AS (SELECT s.code, s.avail_date, s.cost, d.date,
    row_number() OVER (PARTITION BY s.code, s.avail_date ORDER BY abs(datediff('day', s.avail_date, d.date)), d.date) AS rn
   FROM statements s JOIN daily d ON s.code = d.code AND abs(datediff('day', s.avail_date, d.date)) <= 3)
 SELECT code, avail_date, date AS snap_date FROM c WHERE rn = 1""")
def _(spark, sf):
    ev = t.statements(spark, sf).select("code", "avail_date")
    return align.nearest_within(ev, t.daily_panel(spark, sf), "code", "avail_date", "date", 3)


@query("holding_period_carry", f"""WITH {q.DAILY}, d AS (SELECT date, count(*) AS n, CASE WHEN lag(month(date)) OVER (ORDER BY date) <> month(date) THEN date END AS reb
   FROM daily GROUP BY date)
 SELECT date, n, last_value(reb IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reb_date FROM d""")
def _(spark, sf):
    from pyspark.sql.window import Window

    d = t.daily_panel(spark, sf).groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    prev = F.lag(F.month("date")).over(Window.orderBy("date"))
    d = d.withColumn("reb", F.when(prev != F.month("date"), F.col("date")))
    return d.withColumn("reb_date", align.carry_period(d, [], "date", F.col("reb"))).drop("reb")


@query("forward_fill_limited", f"""WITH {q.DAILY}, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS c FROM (SELECT DISTINCT date FROM daily)),
  x AS (SELECT code, c, CASE WHEN volume >= 20 THEN close END AS v FROM daily JOIN cal USING (date))
 SELECT code, c AS cal, {r('last_value(v IGNORE NULLS) OVER (PARTITION BY code ORDER BY c RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)')} AS filled FROM x""")
def _(spark, sf):
    d = with_calendar(t.daily_panel(spark, sf), t.trading_days(spark, sf)).withColumn("v", F.when(F.col("volume") >= 20, F.col("close")))
    return d.select("code", F.col("cal").cast("long").alias("cal"), r6(align.forward_fill("v", "code", "cal", 5)).alias("filled"))


# ---- aggregation and resampling -------------------------------------------------------------------

@query("group_aggregate", f"""WITH {q.RETS} SELECT code, year(date) AS yr, count(*) AS n, {r('sum(turnover)', 2)} AS turnover, {r('avg(close)')} AS mean_close,
   {r('min(low)')} AS low, {r('max(high)')} AS high, {r('arg_max(close, date)')} AS last_close FROM rets GROUP BY ALL""")
def _(spark, sf):
    return t.daily_panel(spark, sf).groupBy("code", year_of("date").alias("yr")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("turnover"), 2).alias("turnover"), r6(F.avg("close")).alias("mean_close"),
        r6(F.min("low")).alias("low"), r6(F.max("high")).alias("high"), r6(F.max_by("close", "date")).alias("last_close"),
    )


@query("session_ohlc", f"""WITH {q.bars(30)} SELECT code, CAST(ts AS DATE) AS session, {r('max(high)')} AS high, {r('min(low)')} AS low, {r('arg_max(close, ts)')} AS close
  FROM bars GROUP BY ALL""")
def _(spark, sf):
    b = t.bars(t.ticks(spark, sf), 30).withColumn("session", F.to_date("ts"))
    return ag.ohlc_session(b, ["code", "session"]).select("code", "session", *[r6(c).alias(c) for c in ("high", "low", "close")])


@query("monthly_last", f"WITH {q.MONTHLY} SELECT code, mi, {r('close')} AS close FROM monthly")
def _(spark, sf):
    return ag.month_last(t.daily_panel(spark, sf), ["close"]).select("code", "mi", r6("close").alias("close"))


@query("monthly_turnover", f"WITH {q.DAILY} SELECT code, year(date) * 12 + month(date) - 1 AS mi, {r('avg(turnover)')} AS mean_turnover, count(*) AS n FROM daily GROUP BY ALL")
def _(spark, sf):
    return t.daily_panel(spark, sf).groupBy("code", month_index("date").alias("mi")).agg(r6(F.avg("turnover")).alias("mean_turnover"), F.count(F.lit(1)).alias("n"))


@query("monthly_log_return_sum", f"WITH {q.RETS} SELECT code, year(date) * 12 + month(date) - 1 AS mi, {r('sum(lret)')} AS lret FROM rets GROUP BY ALL")
def _(spark, sf):
    return t.daily_returns(spark, sf).groupBy("code", month_index("date").alias("mi")).agg(r6(F.sum("lret")).alias("lret"))


@query("weekly_last", f"""WITH {q.DAILY} SELECT code, CAST(date + CAST((12 - dayofweek(date)) % 7 AS INT) AS DATE) AS week, {r('arg_max(close, date)')} AS close FROM daily GROUP BY 1, 2""")
def _(spark, sf):
    return ag.week_last(t.daily_panel(spark, sf), "close").select("code", "week", r6("close").alias("close"))


@query("phase_shift_monthly", f"""WITH {q.DAILY}, s AS (SELECT unnest([0, 7, 14, 21]) AS shift), x AS (SELECT shift, code, date, close, CAST(date - shift AS DATE) AS d FROM daily, s)
 SELECT shift, code, year(d) * 12 + month(d) - 1 AS mi, {r('arg_max(close, date)')} AS close FROM x GROUP BY 1, 2, 3""")
def _(spark, sf):
    return ag.phase_months(t.by_instrument(spark, sf, t.daily_panel(spark, sf).select("code", "date", "close")), [0, 7, 14, 21], "close").withColumn("close", r6("close"))


@query("market_return", f"""WITH {q.BOOKRET}, m AS (SELECT date, avg(cret) AS mret, count(cret) AS n FROM br WHERE cret IS NOT NULL GROUP BY date)
 SELECT date, n, {r('mret')} AS mret, {r('sum(ln(1 + mret)) OVER (ORDER BY date)')} AS log_index FROM m""")
def _(spark, sf):
    m = market(spark, sf)
    from pyspark.sql.window import Window

    return m.select("date", "n", r6("mret").alias("mret"), r6(F.sum(F.log1p("mret")).over(Window.orderBy("date"))).alias("log_index"))


def book_returns(spark, sf):
    """Daily returns with the clipped simple return ``cret`` used by every book."""
    return t.daily_returns(spark, sf).withColumn("cret", F.expm1(clean.winsorise("lret", 0.6)))


def market(spark, sf):
    """Equal-weight return over the names with data that day: one row per date."""
    return book_returns(spark, sf).where("cret IS NOT NULL").groupBy("date").agg(F.avg("cret").alias("mret"), F.count("cret").alias("n"))


@query("compound_return", f"WITH {q.BOOKRET} SELECT code, year(date) AS yr, {r('ln(1 + product(1 + cret) - 1)')} AS log_growth FROM br WHERE cret IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    d = book_returns(spark, sf).where("cret IS NOT NULL").groupBy("code", year_of("date").alias("yr")).agg(ag.compound("cret").alias("g"))
    return d.select("code", "yr", r6(F.log1p("g")).alias("log_growth"))


@query("exact_quantiles", f"""WITH {q.DAILY} SELECT year(date) * 12 + month(date) - 1 AS mi, {r('median(close)')} AS med, {r('quantile_cont(close, 0.25)')} AS q25, {r('quantile_cont(close, 0.9)')} AS q90 FROM daily GROUP BY 1""")
def _(spark, sf):
    from ..operators import xsec

    d = t.daily_panel(spark, sf).select("code", month_index("date").alias("mi"), "close")
    out = xsec.quantiles(d, "mi", "close", [0.5, 0.25, 0.9], "code", xsec.splits_for(t.instrument_count(spark, sf) * 31))
    return out.select("mi", *[r6(F.col("q")[i]).alias(n) for i, n in enumerate(["med", "q25", "q90"])])


@query("pivot_by_status", f"""WITH {q.RETS}, {q.SYMBOLS} SELECT year(date) AS yr, {', '.join(r(f"avg(CASE WHEN currency = '{c}' THEN lret END)") + f' AS {c.lower()}' for c in ('GBX', 'USD'))}
  FROM rets JOIN symbols USING (code) GROUP BY 1""")
def _(spark, sf):
    d = t.daily_returns(spark, sf).join(t.symbols(spark, sf).select("code", "currency"), "code").withColumn("yr", year_of("date"))
    currencies = [x["currency"] for x in t.symbols(spark, sf).select("currency").distinct().orderBy("currency").collect()]
    out = d.groupBy("yr").pivot("currency", currencies).agg(F.avg("lret"))
    return out.select("yr", *[r6(c).alias(c.lower()) for c in currencies])


@query("distinct_and_switches", f"""WITH {q.MSIG}, p AS (SELECT mi, arg_max(code, mom) AS pick FROM (SELECT * FROM msig WHERE mom IS NOT NULL) GROUP BY mi)
 SELECT count(DISTINCT pick) AS n_picks, count(*) FILTER (WHERE pick <> pv) AS switches, count(*) AS n FROM (SELECT *, lag(pick) OVER (ORDER BY mi) AS pv FROM p)""")
def _(spark, sf):
    from pyspark.sql.window import Window

    p = monthly_signals(spark, sf).where("mom IS NOT NULL").groupBy("mi").agg(F.max_by("code", "mom").alias("pick"))
    p = p.withColumn("pv", F.lag("pick").over(Window.orderBy("mi")))
    return p.agg(F.countDistinct("pick").alias("n_picks"), F.count_if(F.col("pick") != F.col("pv")).alias("switches"), F.count(F.lit(1)).alias("n"))


@query("key_set_operations", f"""WITH {q.MONTHLY}, {q.STATEMENTS}, a AS (SELECT DISTINCT code, mi FROM monthly),
  b AS (SELECT DISTINCT code, year(avail_date) * 12 + month(avail_date) - 1 AS mi FROM statements)
 SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL
 SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL
 SELECT 'left_only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def _(spark, sf):
    a = t.monthly_panel(spark, sf).select("code", "mi").distinct()
    b = t.statements(spark, sf).select("code", month_index("avail_date").alias("mi")).distinct()
    parts = {"both": a.intersect(b), "either": a.union(b).distinct(), "left_only": a.join(b, ["code", "mi"], "left_anti")}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("stack_long", f"""WITH {q.MONTHLY} SELECT code, mi, field, {r('value', 4)} AS value FROM (
  SELECT code, mi, 'close' AS field, close AS value FROM monthly UNION ALL SELECT code, mi, 'turnover', turnover FROM monthly UNION ALL SELECT code, mi, 'volume', volume FROM monthly)""")
def _(spark, sf):
    m = t.monthly_panel(spark, sf).select("code", "mi", "close", "turnover", "volume")
    return m.unpivot(["code", "mi"], ["close", "turnover", "volume"], "field", "value").withColumn("value", r6("value", 4))


@query("union_books", f"""WITH {q.bars(60)} SELECT src, count(*) AS n, {r('sum(x)')} AS total FROM (
  SELECT 'range' AS src, high - low AS x FROM bars UNION ALL SELECT 'body', abs(close - open) FROM bars) GROUP BY src""")
def _(spark, sf):
    b = t.bars(t.ticks(spark, sf), 60)
    u = b.select(F.lit("range").alias("src"), (F.col("high") - F.col("low")).alias("x")).unionByName(
        b.select(F.lit("body").alias("src"), F.abs(F.col("close") - F.col("open")).alias("x"))
    )
    return u.groupBy("src").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("x")).alias("total"))


@query("tail_rows", f"WITH {q.DAILY} SELECT code, date, {r('close')} AS close FROM daily QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) <= 5")
def _(spark, sf):
    from pyspark.sql.window import Window

    d = t.daily_panel(spark, sf).withColumn("rn", F.row_number().over(Window.partitionBy("code").orderBy(F.col("date").desc())))
    return d.where("rn <= 5").select("code", "date", r6("close").alias("close"))


@query("worst_months", f"""WITH {q.MSIG}, m AS (SELECT mi, avg(mret) AS x FROM msig WHERE mret IS NOT NULL GROUP BY mi) SELECT mi, {r('x')} AS x FROM m ORDER BY m.x, mi LIMIT 10""")
def _(spark, sf):
    m = monthly_signals(spark, sf).where("mret IS NOT NULL").groupBy("mi").agg(F.avg("mret").alias("x"))
    return m.orderBy("x", "mi").limit(10).select("mi", r6("x").alias("x"))


@query("path_fan", f"""WITH {q.DAILY}, p AS (SELECT code, year(date) * 12 + month(date) - 1 AS mi, close / first_value(close) OVER k * 100 AS v, row_number() OVER k AS day_no
   FROM daily WINDOW k AS (PARTITION BY code, year(date) * 12 + month(date) - 1 ORDER BY date))
 SELECT day_no, count(*) AS n, {', '.join(f"{r(f'quantile_cont(v, {x / 100})')} AS p{x}" for x in (10, 25, 50, 75, 90))} FROM p GROUP BY day_no""")
def _(spark, sf):
    from pyspark.sql.window import Window
    from ..operators import xsec

    w = Window.partitionBy("code", "mi").orderBy("date")
    d = t.daily_panel(spark, sf).withColumn("mi", month_index("date"))
    d = d.select("code", "mi", (F.col("close") / F.first("close").over(w) * 100).alias("v"), F.row_number().over(w).cast("long").alias("day_no"))
    ps = [10, 25, 50, 75, 90]
    # day 1 pools every instrument and month at the value 100, so quantiles run over value-range splits
    qs = xsec.quantiles(d, "day_no", "v", [p / 100 for p in ps], "code", max(8, xsec.splits_for(t.instrument_count(spark, sf) * 100)))
    n = d.groupBy("day_no").agg(F.count(F.lit(1)).alias("n"))
    return qs.join(n, "day_no").select("day_no", "n", *[r6(F.col("q")[i]).alias(f"p{p}") for i, p in enumerate(ps)])
