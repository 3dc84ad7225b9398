"""Rolling, expanding and calendar-clock features per instrument."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import r6
from ..operators import rolling as ro
from ..operators.align import nearest_within
from ..operators.clock import Clock, with_calendar
from ..operators.orderstats import Quantiles, expanding_quantiles
from ..sources import tables as t
from . import query
from . import sqltext as q
from .panel import monthly_signals
from .sqltext import full, r

BAR = Clock("code", "pos")
MON = Clock("code", "mi")


def feature(name: str, cols: dict[str, str], build, base: str = q.RETS, src: str = "rets", key: str = "date", pos: str = "pos"):
    """Register a per-row feature plan: SQL columns over window ``k`` beside a DataFrame builder."""
    sel = ", ".join(f"{r(e)} AS {c}" for c, e in cols.items())
    sql = f"WITH {base} SELECT code, {key}, {sel} FROM {src} WINDOW k AS (PARTITION BY code ORDER BY {pos})"

    @query(name, sql)
    def _(spark, sf):
        df = build(spark, sf)
        return df.select("code", key, *[r6(c).alias(c) for c in cols])


def daily(fn):
    """Builder adding a dict of columns to the daily return panel."""
    return lambda spark, sf: t.daily_returns(spark, sf).withColumns(fn(BAR))


feature("returns_and_shifts", {"lret": "lret", "ret": "ret", "dclose": "close - lag(close) OVER k", "lag3": "lag(close, 3) OVER k", "lead5": "lead(close, 5) OVER k"},
        daily(lambda c: {"dclose": F.col("close") - c.at("close", -1), "lag3": c.at("close", -3), "lead5": c.at("close", 5)}))

feature("roll_std_20", {"mean20": full("avg(lret)", "lret", 20), "std20": full("stddev_samp(lret)", "lret", 20), "sum20": full("sum(lret)", "lret", 20),
                        "max20": full("max(close)", "close", 20), "min20": full("min(close)", "close", 20)},
        daily(lambda c: {"mean20": c.full(F.avg, "lret", 20), "std20": c.full(F.stddev_samp, "lret", 20), "sum20": c.full(F.sum, "lret", 20),
                         "max20": c.full(F.max, "close", 20), "min20": c.full(F.min, "close", 20)}))

CAL = q.DAILY + """, cald AS (SELECT code, date, close, cal FROM daily JOIN (
  SELECT date, row_number() OVER (ORDER BY date) - 1 AS cal FROM (SELECT DISTINCT date FROM daily)) USING (date))"""
CALC = Clock("code", "cal")
feature("roll_minobs_mean", {"mean252": full("avg(close)", "close", 252, 1, 40), "gap_mean3": full("avg(close)", "close", 3),
                             "prev_day": f"max(close) OVER (k {q.frame(-1, -1)})"},
        lambda spark, sf: with_calendar(t.daily_panel(spark, sf).select("code", "date", "close"), t.trading_days(spark, sf)).withColumns(
            {"mean252": CALC.full(F.avg, "close", 252, 1, 40), "gap_mean3": CALC.full(F.avg, "close", 3), "prev_day": CALC.at("close", -1)}),
        CAL, "cald", pos="cal")

feature("roll_quantile", {"q70": "CASE WHEN count(vol) OVER (k RANGE BETWEEN 251 PRECEDING AND CURRENT ROW) >= 20 THEN quantile_cont(vol, 0.7) OVER (k RANGE BETWEEN 251 PRECEDING AND CURRENT ROW) END", "vol": "vol"},
        lambda spark, sf: ro.rolling_quantile(
            t.daily_returns(spark, sf).select("code", "date", "pos", BAR.full(F.stddev_samp, "lret", 20).alias("vol")), BAR, "vol", 252, [0.7], 0, 20).withColumn("q70", F.col("q")[0]),
        q.RETS + f", v AS (SELECT *, {full('stddev_samp(lret)', 'lret', 20)} AS vol FROM rets WINDOW k AS (PARTITION BY code ORDER BY pos))", "v")

feature("expanding_median", {"mean": f"avg(lret) OVER (k RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "med": "median(close) OVER (k RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"},
        lambda spark, sf: expanding_quantiles(
            t.monthly_panel(spark, sf).select("code", "mi", "close").withColumn("lret", F.log(F.col("close") / MON.at("close", -1))).withColumn("mean", F.avg("lret").over(MON.to_date(1))),
            MON, [Quantiles("q", "close", None, (0.5,), lag=1)]).withColumn("med", F.col("q")[0]),
        q.MONTHLY + f", mm AS (SELECT *, ln(close / max(close) OVER (k {q.frame(-1, -1)})) AS lret FROM monthly WINDOW k AS (PARTITION BY code ORDER BY mi))", "mm", "mi", "mi")

feature("rolling_annualised", {"ann36": "exp(" + full("sum(ln(1 + mret))", "mret", 36) + " * 12.0 / 36) - 1"},
        lambda spark, sf: monthly_signals(spark, sf).withColumn("ann36", F.exp(MON.full(F.sum, F.log1p("mret"), 36) * 12.0 / 36) - 1),
        q.MSIG, "msig", "mi", "mi")

feature("mom_12_1", {"mom": "mom", "mret": "mret"}, lambda spark, sf: monthly_signals(spark, sf), q.MSIG, "msig", "mi", "mi")

feature("mom_daily_skip", {"mom": full("sum(lret)", "lret", 231, 21), "rev": "-" + "(" + full("sum(lret)", "lret", 200, 252) + ")"},
        daily(lambda c: {"mom": ro.skip_sum(c, "lret", 231, 21), "rev": -ro.skip_sum(c, "lret", 200, 252)}))

feature("realised_vol", {f"rv{n}": f"sqrt({full('avg(lret * lret)', 'lret * lret', n)} * 252) * 100" for n in (1, 5, 22)},
        daily(lambda c: {f"rv{n}": ro.realised_vol(c, "lret", n) for n in (1, 5, 22)}))

_ah = q.frame(1, 10)
feature("forward_outcomes", {"frv": f"sqrt(CASE WHEN count(lret) OVER (k {_ah}) = 10 THEN avg(lret * lret) OVER (k {_ah}) END * 252) * 100",
                             "fret10": f"ln(lead(close, 10) OVER k) - ln(close)", "fstd": f"CASE WHEN count(lret) OVER (k {_ah}) = 10 THEN stddev_samp(lret) OVER (k {_ah}) END"},
        lambda spark, sf: t.daily_returns(spark, sf).withColumn("lp", F.log("close")).withColumns(
            {"frv": ro.forward_realised_vol(BAR, "lret", 10), "fret10": ro.forward_return(BAR, "lp", 10), "fstd": BAR.full_ahead(F.stddev_samp, "lret", 10)}))

feature("trailing_vol_before", {"tvol": full("stddev_pop(lret)", "lret", 30, 1)}, daily(lambda c: {"tvol": c.full(F.stddev_pop, "lret", 30, 1)}))

feature("vol_state", {"vs": f"{full('stddev_samp(lret)', 'lret', 20, 1)} / {full('stddev_samp(lret)', 'lret', 100, 1)}"}, daily(lambda c: {"vs": ro.vol_state(c, "lret")}))

_TR = q.RETS + """, trs AS (SELECT *, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr,
   CASE WHEN prev IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr_null FROM rets)"""
feature("atr_simple", {"tr": "tr", "tr_null": "tr_null", "atr14": full("avg(tr)", "tr", 14), "atr22": full("avg(tr)", "tr", 22)},
        lambda spark, sf: t.daily_returns(spark, sf).withColumns({"tr": ro.true_range(BAR), "tr_null": ro.true_range(BAR, True)}).withColumns(
            {"atr14": BAR.full(F.avg, "tr", 14), "atr22": BAR.full(F.avg, "tr", 22)}), _TR, "trs")

feature("zscore_20", {"z": f"(close - {full('avg(close)', 'close', 20)}) / {full('stddev_samp(close)', 'close', 20)}"}, daily(lambda c: {"z": ro.zscore(c, "close", 20)}))

feature("reversion_z", {"gap": f"{full('avg(lret)', 'lret', 200)} - {full('avg(lret)', 'lret', 60)}",
                        "gz": f"({full('avg(lret)', 'lret', 200)} - {full('avg(lret)', 'lret', 60)}) / ({full('stddev_samp(lret)', 'lret', 60)} / sqrt(60.0))"},
        daily(lambda c: dict(zip(("gap", "gz"), ro.reversion(c, "lret", 60, 200)))))

LADDER = [5, 10, 20, 40, 80]


def _drift_sql():
    import math

    x = [math.log(n) for n in LADDER]
    m = sum(x) / len(x)
    den = sum((v - m) ** 2 for v in x)
    d = {f"drift_{n}": full("avg(lret0)", "lret0", n) for n in LADDER}
    d["slope"] = " + ".join(f"({full('avg(lret0)', 'lret0', n)}) * ({(v - m) / den!r})" for n, v in zip(LADDER, x))
    return d


feature("drift_term_structure", _drift_sql(),
        lambda spark, sf: ro.drift_by_prefix(t.daily_returns(spark, sf), BAR, "lret", LADDER).withColumn("slope", ro.slope_on_log_length(LADDER)),
        q.RETS + ", z0 AS (SELECT *, coalesce(lret, 0.0) AS lret0 FROM rets)", "z0")

_W60 = "(k RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)"
CHANNEL_SQL = q.RETS + f""", ch0 AS (SELECT *, count(close) OVER {_W60} AS n60, regr_slope(ln(close), pos) OVER {_W60} AS g, regr_intercept(ln(close), pos) OVER {_W60} AS i,
   regr_r2(ln(close), pos) OVER {_W60} AS rr, var_pop(ln(close)) OVER {_W60} AS vv FROM rets WINDOW k AS (PARTITION BY code ORDER BY pos)),
 ch AS (SELECT *, i + g * pos AS lm, sqrt(greatest(vv * (1 - rr), 0)) AS sg FROM ch0 WHERE n60 >= 60)"""


@query("channel_ols", f"""WITH {CHANNEL_SQL} SELECT code, date, {r('g')} AS gradient, {r('rr')} AS r2, {r('sg')} AS sigma, {r('lm')} AS log_mid,
   {r('lm + 2 * sg')} AS log_upper, {r('lm - 2 * sg')} AS log_lower FROM ch""")
def _(spark, sf):
    d = t.daily_returns(spark, sf).withColumn("lp", F.log("close"))
    d = ro.channel(d, BAR, "lp", 60).where("gradient IS NOT NULL")
    return d.select("code", "date", *[r6(c).alias(c) for c in ("gradient", "r2", "sigma")],
                    r6(F.log("mid")).alias("log_mid"), r6(F.log("upper")).alias("log_upper"), r6(F.log("lower")).alias("log_lower"))


feature("depth_drawdown", {"depth": f"{full('max(ln(close))', 'close', 60)} - {full('min(ln(close))', 'close', 60)}",
                           "dd_vol": f"({full('max(ln(close))', 'close', 60)} - ln(close)) / ({full('stddev_samp(lret)', 'lret', 60)} * sqrt(60.0))"},
        lambda spark, sf: t.daily_returns(spark, sf).withColumn("lp", F.log("close")).withColumns(
            {"depth": ro.drawdown_depth(BAR, "lp", 60), "dd_vol": ro.depth_in_vol(BAR, "lp", BAR.full(F.stddev_samp, "lret", 60), 60)}))

feature("efficiency_ratio", {"er": f"least(greatest(abs(close - lag(close, 20) OVER k) / {full('sum(abs(d))', 'd', 20)}, 0), 1)"},
        lambda spark, sf: t.daily_returns(spark, sf).withColumn("d_close", F.col("close") - BAR.at("close", -1)).withColumn("er", ro.efficiency_ratio(BAR, "close", 20)),
        q.RETS + ", dd AS (SELECT *, close - prev AS d FROM rets)", "dd")

feature("har_features", {"har_d": "lag(rv) OVER k", "har_w": full("avg(rv)", "rv", 5, 1), "har_m": full("avg(rv)", "rv", 22, 1)},
        lambda spark, sf: t.daily_returns(spark, sf).withColumn("rv", F.col("lret") * F.col("lret")).withColumns(ro.har(BAR, "rv")),
        q.RETS + ", rvs AS (SELECT *, lret * lret AS rv FROM rets)", "rvs")

_v3, _v12 = full("stddev_samp(mret)", "mret", 3), full("stddev_samp(mret)", "mret", 12)
feature("vol_change_ratio", {"vc": f"{_v3} / nullif({_v12}, 0) - 1", "avc": f"CASE WHEN {_v3} > 0 THEN abs(ln({_v3} / nullif({_v12}, 0))) END"},
        lambda spark, sf: monthly_signals(spark, sf).withColumns(dict(zip(("vc", "avc"), ro.vol_change(MON, "mret", 3, 12)))), q.MSIG, "msig", "mi", "mi")

feature("relative_volume", {"rel": f"volume / {full('median(volume)', 'volume', 20, 1)}"}, lambda spark, sf: ro.relative_volume(t.daily_returns(spark, sf).select("code", "date", "pos", "volume"), BAR, "volume"))

feature("overnight_intraday", {"onight": "ln(open / prev)", "intra": "ln(close / open)", "total_var": "power(ln(open / prev), 2) + power(ln(close / open), 2)"},
        lambda spark, sf: t.daily_returns(spark, sf).withColumns(dict(zip(("onight", "intra"), ro.overnight_intraday(BAR)))).withColumn(
            "total_var", F.pow("onight", F.lit(2)) + F.pow("intra", F.lit(2))))

_den = repr(3.0 - 2.0 * 2.0**0.5)
_CS = q.RETS + f""", c1 AS (SELECT *, power(ln(high / low), 2) AS h1, lag(high) OVER k AS ph, lag(low) OVER k AS pl, ln(lag(close) OVER k) AS lc,
   (ln(high) + ln(low)) / 2 AS m FROM rets WINDOW k AS (PARTITION BY code ORDER BY pos)),
 c2 AS (SELECT *, h1 + lag(h1) OVER k AS b, CASE WHEN ph IS NOT NULL THEN power(ln(greatest(high, ph) / least(low, pl)), 2) END AS g,
   (lc - lag(m) OVER k) * (lc - m) AS x FROM c1 WINDOW k AS (PARTITION BY code ORDER BY pos)),
 c3 AS (SELECT *, (sqrt(2 * b) - sqrt(b)) / {_den} - sqrt(g / {_den}) AS a FROM c2),
 c4 AS (SELECT *, CASE WHEN a IS NOT NULL THEN greatest(2 * (exp(a) - 1) / (exp(a) + 1), 0) END AS s FROM c3)"""
feature("corwin_schultz", {"cs_spread": full("avg(s)", "s", 60), "ar_spread": 
        f"CASE WHEN count(x) OVER (k RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) >= 60 THEN 2 * sqrt(greatest(avg(x) OVER (k RANGE BETWEEN 59 PRECEDING AND CURRENT ROW), 0)) END"},
        lambda spark, sf: ro.abdi_ranaldo(ro.corwin_schultz(t.daily_returns(spark, sf), BAR, 60), BAR, 60), _CS, "c4")

feature("cumulative_equity", {"log_eq": "sum(ln(1 + cret)) OVER (k RANGE UNBOUNDED PRECEDING)", "peak": "max(close) OVER (k RANGE UNBOUNDED PRECEDING)", "cum_vol": "sum(volume) OVER (k RANGE UNBOUNDED PRECEDING)"},
        lambda spark, sf: _book(spark, sf).withColumns({"log_eq": ro.log_wealth("cret", BAR), "peak": F.max("close").over(BAR.to_date()), "cum_vol": BAR.running_sum("volume")}),
        q.BOOKRET, "br")


def _book(spark, sf):
    from .panel import book_returns

    return book_returns(spark, sf)


@query("total_return_index", f"""WITH {q.RETS}, {q.STATEMENTS}, c AS (SELECT s.code, s.avail_date, s.cost, d.date,
    row_number() OVER (PARTITION BY s.code, s.avail_date ORDER BY abs(datediff('day', s.avail_date, d.date)), d.date) AS rn
   FROM statements s JOIN daily d ON s.code = d.code AND abs(datediff('day', s.avail_date, d.date)) <= 3),
  dv AS (SELECT code, date, sum(cost) / 1000 AS div FROM c WHERE rn = 1 GROUP BY ALL)
 SELECT code, date, {r('ln((close + coalesce(div, 0)) / prev)')} AS tr_lret, {r("sum(ln((close + coalesce(div, 0)) / prev)) OVER (PARTITION BY code ORDER BY pos)")} AS log_tri
 FROM rets LEFT JOIN dv USING (code, date) WHERE prev IS NOT NULL""")
def _(spark, sf):
    d = t.daily_returns(spark, sf)
    ev = t.statements(spark, sf).select("code", "avail_date", "cost")
    div = nearest_within(ev, d, "code", "avail_date", "date", 3).groupBy("code", F.col("snap_date").alias("date")).agg((F.sum("cost") / 1000).alias("div"))
    d = d.withColumn("prev", BAR.at("close", -1)).join(div, ["code", "date"], "left").where("prev IS NOT NULL")
    d = d.withColumn("tr", F.log((F.col("close") + F.coalesce("div", F.lit(0.0))) / F.col("prev")))
    return d.select("code", "date", r6("tr").alias("tr_lret"), r6(BAR.running_sum("tr")).alias("log_tri"))


@query("activity_share", f"""WITH {q.MSIG}, x AS (SELECT code, mi, {full('avg(mret * mret)', 'mret', 12)} AS a FROM msig WINDOW k AS (PARTITION BY code ORDER BY mi))
 SELECT code, mi, {r('a / sum(a) OVER (PARTITION BY mi)')} AS share FROM x WHERE a IS NOT NULL""")
def _(spark, sf):
    from ..operators import xsec

    m = monthly_signals(spark, sf).withColumn("a", MON.full(F.avg, F.col("mret") * F.col("mret"), 12)).where("a IS NOT NULL")
    m = xsec.with_stats(m, "mi", {"tot": F.sum("a")}, xsec.splits_for(t.instrument_count(spark, sf)))
    return m.select("code", "mi", r6(F.col("a") / F.col("tot")).alias("share"))


EPI = q.BOOKRET + """, m AS (SELECT date, ln(1 + avg(cret)) - 0.1304 AS x FROM br WHERE cret IS NOT NULL GROUP BY date),
 w AS (SELECT date, x, sum(x) OVER (ORDER BY date) AS lw FROM m),
 dd AS (SELECT date, exp(lw - max(lw) OVER (ORDER BY date)) - 1 AS d FROM w)"""


@query("drawdown_episodes", f"""WITH {EPI}, f AS (SELECT *, d < -0.15 AS inn, coalesce(lag(d) OVER (ORDER BY date) < -0.15, false) AS was FROM dd),
  g AS (SELECT *, sum(CASE WHEN inn AND NOT was THEN 1 ELSE 0 END) OVER (ORDER BY date) AS ep FROM f)
 SELECT CAST(ep AS BIGINT) AS episode, min(date) AS start, max(date) AS "end", count(*) AS n, {r('min(d)')} AS depth, arg_min(date, d) AS trough FROM g WHERE inn GROUP BY ep""")
def _(spark, sf):
    from ..operators.metrics import episodes

    return episodes(_dd_book(spark, sf), "dd", -0.15).select("episode", "start", "end", "n", r6("depth").alias("depth"), "trough")


def _dd_book(spark, sf):
    """Drawdown of the detrended equal-weight market: one row per date."""
    from .panel import market

    w = Window.orderBy("date")
    m = market(spark, sf).withColumn("lw", F.sum(F.log1p("mret") - 0.1304).over(w))
    return m.withColumn("dd", F.exp(F.col("lw") - F.max("lw").over(w)) - 1)


@query("touch_counts", f"""WITH {CHANNEL_SQL}, b AS (SELECT code, pos, ln(high) >= lm + 1.0 * sg AS hit FROM ch),
  e AS (SELECT code, pos, hit AND NOT coalesce(lag(hit) OVER (PARTITION BY code ORDER BY pos), false) AS start FROM b)
 SELECT code, count(*) FILTER (WHERE start) AS touches, min(pos) FILTER (WHERE start) AS first_touch, max(pos) FILTER (WHERE start) AS last_touch FROM e GROUP BY code""")
def _(spark, sf):
    from ..operators.metrics import touch_summary

    d = ro.channel(t.daily_returns(spark, sf).withColumn("lp", F.log("close")), BAR, "lp", 60).where("gradient IS NOT NULL")
    d = d.withColumn("hit", F.log("high") >= F.log("mid") + F.col("sigma"))
    out = touch_summary(d, "hit", "code", "pos")
    return out.select("code", "touches", F.col("first_touch").cast("long").alias("first_touch"), F.col("last_touch").cast("long").alias("last_touch"))


@query("holding_spells", f"""WITH {q.BOOKRET}, p AS (SELECT code, pos, date, cret, coalesce(lag(close > prev) OVER (PARTITION BY code ORDER BY pos), false) AS held FROM br),
  g AS (SELECT *, sum(CASE WHEN held AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY code ORDER BY pos) AS sp FROM (
    SELECT *, coalesce(lag(held) OVER (PARTITION BY code ORDER BY pos), false) AS was FROM p))
 SELECT code, CAST(sp AS BIGINT) AS spell, min(date) AS start, max(date) AS "end", count(*) AS n, {r('sum(ln(1 + cret))')} AS log_pnl FROM g WHERE held GROUP BY code, sp""")
def _(spark, sf):
    from ..operators.metrics import spells

    d = _book(spark, sf)
    d = d.withColumn("up", F.col("close") > BAR.at("close", -1))
    d = d.withColumn("held", F.coalesce(F.lag("up").over(BAR.ordered), F.lit(False)))
    out = spells(d, "held", "cret", ["code"], "pos", "date")
    return out.select("code", "spell", "start", "end", "n", r6(F.log1p("pnl")).alias("log_pnl"))
