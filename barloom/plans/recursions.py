"""Recursive features: exponential averages, hysteresis, regime filter, online learners."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import norm_ppf, r6
from ..operators import recursion as rec
from ..operators import rolling as ro
from ..operators.clock import Clock, with_position
from ..sources import tables as t
from . import query
from . import sqltext as q
from .panel import market
from .sqltext import full, r

BAR = Clock("code", "pos")


def ewma_sql(x: str, lam: float, part: str = "code", pos: str = "pos") -> str:
    """Closed form of the recursion as one running sum (short series only)."""
    w = f"CASE WHEN {pos} = 0 THEN 1.0 ELSE {1 - lam!r} END"
    return f"power({lam!r}, {pos}) * sum({w} * ({x}) * power({lam!r}, -{pos})) OVER (PARTITION BY {part} ORDER BY {pos})"


def gapless_returns(spark, sf):
    """Return rows only (the first bar has none), renumbered from zero."""
    d = t.daily_returns(spark, sf).where("lret IS NOT NULL")
    return d.withColumn("pos", F.col("pos") - 1)


GR = q.RETS + ", gr AS (SELECT * REPLACE (pos - 1 AS pos) FROM rets WHERE lret IS NOT NULL)"
SEED = "CASE WHEN pos = 59 THEN var_pop(CASE WHEN pos < 60 THEN lret END) OVER (PARTITION BY code) ELSE power(lag(lret) OVER (PARTITION BY code ORDER BY pos), 2){g} END"
EV = GR + ", sx AS (SELECT *, " + SEED.format(g="") + " AS x FROM gr), ev AS (SELECT *, " + ewma_sql("x", 0.94, pos="(pos - 59)") + " AS v FROM sx WHERE pos >= 59)"


@query("ewma_var", f"WITH {EV} SELECT code, date, {r('v')} AS v FROM ev")
def _(spark, sf):
    d = rec.ewma_variance(gapless_returns(spark, sf), "code", "pos", "lret", 0.94, 60, out="v").where("pos >= 59")
    return d.select("code", "date", r6("v").alias("v"))


@query("gjr_ewma_var", "WITH " + GR + ", sx AS (SELECT *, " + SEED.format(g=" * (1 + 0.5 * (lag(lret) OVER (PARTITION BY code ORDER BY pos) < 0)::INT)") +
       " AS x FROM gr), ev AS (SELECT *, " + ewma_sql("x", 0.97, pos="(pos - 59)") + f" AS v FROM sx WHERE pos >= 59) SELECT code, date, {r('v')} AS v FROM ev")
def _(spark, sf):
    d = rec.ewma_variance(gapless_returns(spark, sf), "code", "pos", "lret", 0.97, 60, gamma=0.5, out="v").where("pos >= 59")
    return d.select("code", "date", r6("v").alias("v"))


_lh = rec.halflife_lambda(10.0)


@query("ewma_now_and_adjusted", f"""WITH {GR}, e AS (SELECT code, date, {ewma_sql('lret * lret', 0.94)} AS v_now,
   sum(lret * power({_lh!r}, -pos)) OVER k / sum(power({_lh!r}, -pos)) OVER k AS m_adj FROM gr WINDOW k AS (PARTITION BY code ORDER BY pos))
 SELECT code, date, {r('v_now')} AS v_now, {r('m_adj')} AS m_adj FROM e""")
def _(spark, sf):
    d = rec.ewma_variance_now(gapless_returns(spark, sf), "code", "pos", "lret", 0.94, "v_now")
    d = rec.ewma(d, ["code"], "pos", [("m_adj", F.col("lret"), _lh)], adjust=True)
    return d.select("code", "date", r6("v_now").alias("v_now"), r6("m_adj").alias("m_adj"))


_lw = 13 / 14
WILDER = q.RETS + f""", trs AS (SELECT *, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr FROM rets),
 sw AS (SELECT *, CASE WHEN pos = 13 THEN avg(CASE WHEN pos < 14 THEN tr END) OVER (PARTITION BY code) ELSE tr END AS x FROM trs),
 wa AS (SELECT code, date, pos, {ewma_sql('x', _lw, pos='(pos - 13)')} AS atr FROM sw WHERE pos >= 13)"""


@query("wilder_atr", f"WITH {WILDER} SELECT code, date, {r('atr', 3)} AS atr FROM wa")
def _(spark, sf):
    d = t.daily_returns(spark, sf).withColumn("tr", ro.true_range(BAR))
    d = rec.wilder_atr(d, "code", "pos", "tr", 14).where("atr IS NOT NULL")
    return d.select("code", "date", r6("atr", 3).alias("atr"))


_f, _s, _g = rec.span_lambda(12), rec.span_lambda(26), rec.span_lambda(9)
MACD = q.BOOKRET + f""", m1 AS (SELECT *, {ewma_sql('close', _f)} - {ewma_sql('close', _s)} AS line FROM br),
 m2 AS (SELECT *, {ewma_sql('line', _g)} AS sig FROM m1),
 macd AS (SELECT *, line > sig AS state, coalesce(lag(line > sig) OVER (PARTITION BY code ORDER BY pos), false) AS long FROM m2)"""


def macd_panel(spark, sf):
    from .panel import book_returns

    return rec.macd(book_returns(spark, sf), "code", "pos", "close")


@query("macd_state", f"WITH {MACD} SELECT code, date, {r('line', 4)} AS line, {r('sig', 4)} AS signal, {r('line - sig', 4)} AS hist, long FROM macd")
def _(spark, sf):
    d = macd_panel(spark, sf)
    return d.select("code", "date", r6("macd_line", 4).alias("line"), r6("macd_signal", 4).alias("signal"), r6("macd_hist", 4).alias("hist"), F.col("macd_long").alias("long"))


_vol = full("stddev_samp(lret)", "lret", 20)
_w252 = "(k RANGE BETWEEN 251 PRECEDING AND CURRENT ROW)"


@query("vol_gated_state", f"""WITH {MACD}, v AS (SELECT *, {_vol} AS vol FROM macd WINDOW k AS (PARTITION BY code ORDER BY pos)),
  g AS (SELECT *, state AND coalesce(vol >= CASE WHEN count(vol) OVER {_w252} >= 20 THEN quantile_cont(vol, 0.5) OVER {_w252} END, false) AS on_ FROM v WINDOW k AS (PARTITION BY code ORDER BY pos))
 SELECT code, date, coalesce(lag(on_) OVER (PARTITION BY code ORDER BY pos), false) AS held FROM g""")
def _(spark, sf):
    d = macd_panel(spark, sf).withColumn("vol", BAR.full(F.stddev_samp, "lret", 20))
    d = ro.rolling_quantile(d.select("code", "pos", "date", "macd_state", "vol"), BAR, "vol", 252, [0.5], 0, 20)
    d = d.withColumn("on", F.col("macd_state") & F.coalesce(F.col("vol") >= F.col("q")[0], F.lit(False)))
    return d.select("code", "date", F.lag("on", 1, False).over(BAR.ordered).alias("held"))


@query("hysteresis", f"""WITH RECURSIVE {MACD}, s AS (SELECT code, pos, date, close > open AS e, line > 0 AS x FROM macd),
  h AS (SELECT code, pos, date, e AS held FROM s WHERE pos = 0 UNION ALL
        SELECT s.code, s.pos, s.date, CASE WHEN h.held THEN s.x ELSE s.e END FROM h JOIN s ON s.code = h.code AND s.pos = h.pos + 1)
 SELECT code, date, held FROM h""")
def _(spark, sf):
    d = macd_panel(spark, sf).withColumns({"e": F.col("close") > F.col("open"), "x": F.col("macd_line") > 0})
    return rec.hysteresis(d, ["code"], "pos", "e", "x").select("code", "date", "held")


@query("retrench", f"""WITH RECURSIVE {MACD}, u AS (SELECT code, pos, date, row_number() OVER (PARTITION BY code ORDER BY pos) AS n FROM (
    SELECT *, state AND NOT coalesce(lag(state) OVER (PARTITION BY code ORDER BY pos), true) AS up FROM macd) WHERE up),
  h AS (SELECT code, n, pos, date, pos AS armed, false AS entry FROM u WHERE n = 1 UNION ALL
   SELECT u.code, u.n, u.pos, u.date, CASE WHEN h.armed IS NOT NULL AND u.pos - h.armed <= 20 THEN NULL ELSE u.pos END, h.armed IS NOT NULL AND u.pos - h.armed <= 20
   FROM h JOIN u ON u.code = h.code AND u.n = h.n + 1)
 SELECT code, date FROM h WHERE entry""")
def _(spark, sf):
    return rec.second_cross(macd_panel(spark, sf), "code", "pos", "macd_state", 20).where("retrench").select("code", "date")


# Regime model used by the plans: calm and turbulent market states in return units.
MEANS, VARS, TRANS, START = [0.10, 0.20], [0.004, 0.03], [[0.95, 0.05], [0.10, 0.90]], [0.6, 0.4]


def _pdf(x, j):
    return f"exp(-0.5 * (ln(2 * pi() * {VARS[j]}) + power({x} - {MEANS[j]}, 2) / {VARS[j]}))"


HMM = GR + f""", z AS (SELECT code, pos, date, lret, {_pdf('0.15 * lret', 0)} AS f0, {_pdf('0.15 * lret', 1)} AS f1 FROM gr),
  h AS (SELECT code, pos, date, lret, {START[1]} * f1 / ({START[0]} * f0 + {START[1]} * f1) AS p FROM z WHERE pos = 0 UNION ALL
   SELECT z.code, z.pos, z.date, z.lret, z.f1 * ((1 - h.p) * {TRANS[0][1]} + h.p * {TRANS[1][1]}) /
     (z.f0 * ((1 - h.p) * {TRANS[0][0]} + h.p * {TRANS[1][0]}) + z.f1 * ((1 - h.p) * {TRANS[0][1]} + h.p * {TRANS[1][1]}))
   FROM h JOIN z ON z.code = h.code AND z.pos = h.pos + 1)"""


def regimes(spark, sf):
    d = gapless_returns(spark, sf).select("code", "pos", "date", "lret", (F.col("lret") * 0.15).alias("x"))
    return rec.regime_filter(d, "code", "pos", "x", MEANS, VARS, TRANS, START)


@query("hmm_filter", f"WITH RECURSIVE {HMM} SELECT code, date, {r('p')} AS p_turbulent FROM h")
def _(spark, sf):
    return regimes(spark, sf).select("code", "date", r6("p_1").alias("p_turbulent"))


REG = HMM + """, rg AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY code ORDER BY pos) >= 0.5, false) AS hot, pos < count(*) OVER (PARTITION BY code) // 2 AS train FROM h)"""


@query("regime_calibration", f"""WITH RECURSIVE {REG}, c AS (SELECT code, hot, stddev_pop(lret) AS sd FROM rg WHERE train GROUP BY code, hot),
   a AS (SELECT code, stddev_pop(lret) AS sd FROM rg WHERE train GROUP BY code)
 SELECT code, hot, {r('c.sd / a.sd')} AS width, {r('avg((abs(lret) > 1.2815515655446004 * c.sd)::INT)')} AS breach, count(*) AS n
 FROM rg JOIN c USING (code, hot) JOIN a USING (code) WHERE NOT train GROUP BY code, hot, c.sd, a.sd""")
def _(spark, sf):
    d = regimes(spark, sf)
    n = F.count(F.lit(1)).over(Window.partitionBy("code"))
    d = d.withColumns({"hot": F.coalesce(F.lag("p_1").over(BAR.ordered) >= 0.5, F.lit(False)), "train": F.col("pos") < F.floor(n / 2)})
    fit = d.where("train").groupBy("code", "hot").agg(F.stddev_pop("lret").alias("sd"))
    base = d.where("train").groupBy("code").agg(F.stddev_pop("lret").alias("sd_all"))
    z = norm_ppf([0.9])[0]
    test = d.where("NOT train").join(fit, ["code", "hot"]).join(base, "code")
    out = test.groupBy("code", "hot").agg(
        F.max(F.col("sd") / F.col("sd_all")).alias("width"), F.avg((F.abs("lret") > F.col("sd") * z).cast("double")).alias("breach"), F.count(F.lit(1)).alias("n")
    )
    return out.select("code", "hot", r6("width").alias("width"), r6("breach").alias("breach"), "n")


HORIZON, FEWEST = 20, 30  # outcome in days, and held-out days that each regime must have
STUDY = REG + f""", st AS (SELECT *, count(*) OVER (PARTITION BY code) AS bars, lag(p) OVER k AS before, sum(lret) OVER (k ROWS BETWEEN 1 FOLLOWING AND {HORIZON} FOLLOWING) AS fwd FROM h WINDOW k AS (PARTITION BY code ORDER BY pos)),
  te AS (SELECT *, pos < bars - {HORIZON} AS known, CASE WHEN coalesce(before, 0.5) < 0.5 THEN lret ELSE 0 END AS timed FROM st WHERE pos >= bars // 2),
  per AS (SELECT code, count(*) FILTER (known AND p >= 0.5) AS n_hot, count(*) FILTER (known AND p < 0.5) AS n_calm, avg(fwd) FILTER (known AND p >= 0.5) AS fwd_hot, avg(fwd) FILTER (known AND p < 0.5) AS fwd_calm,
    avg(lret) AS m_hold, stddev_pop(lret) AS s_hold, avg(timed) AS m_timed, stddev_pop(timed) AS s_timed FROM te GROUP BY code),
  study AS (SELECT code, n_hot, n_calm, fwd_hot, fwd_calm, CASE WHEN s_hold > 0 THEN m_hold / s_hold * sqrt(252.0) ELSE 0 END AS sharpe_hold, CASE WHEN s_timed > 0 THEN m_timed / s_timed * sqrt(252.0) ELSE 0 END AS sharpe_timed
    FROM per WHERE n_hot >= {FEWEST} AND n_calm >= {FEWEST})"""


def regime_study(d, horizon: int = HORIZON, fewest: int = FEWEST):
    """Held-out second half of each name: outcome of the next days by regime, and leaving while turbulent against holding.

    The outcome of a day is known if ``horizon`` days follow. The timed return is in the market if the day before was
    calm (0.5 before the first day, so not calm). Names with fewer than ``fewest`` known days of a regime are left out.
    """
    d = d.withColumns({
        "bars": F.count(F.lit(1)).over(Window.partitionBy("code")), "before": F.coalesce(F.lag("p_1").over(BAR.ordered), F.lit(0.5)),
        "fwd": F.sum("lret").over(BAR.ordered.rowsBetween(1, horizon)),
    }).where(F.col("pos") >= F.floor(F.col("bars") / 2))
    known, hot = F.col("pos") < F.col("bars") - horizon, F.col("p_1") >= 0.5
    timed = F.when(F.col("before") < 0.5, F.col("lret")).otherwise(0.0)
    sharpe = lambda x: F.when(F.stddev_pop(x) > 0, F.avg(x) / F.stddev_pop(x) * 252**0.5).otherwise(0.0)
    out = d.groupBy("code").agg(
        F.count(F.when(known & hot, 1)).alias("n_hot"), F.count(F.when(known & ~hot, 1)).alias("n_calm"),
        F.avg(F.when(known & hot, F.col("fwd"))).alias("fwd_hot"), F.avg(F.when(known & ~hot, F.col("fwd"))).alias("fwd_calm"),
        sharpe(F.col("lret")).alias("sharpe_hold"), sharpe(timed).alias("sharpe_timed"),
    )
    return out.where(f"n_hot >= {fewest} AND n_calm >= {fewest}")


@query("regime_study_by_name", f"""WITH RECURSIVE {STUDY} SELECT code, n_hot, n_calm, {r('fwd_hot')} AS fwd_hot, {r('fwd_calm')} AS fwd_calm, {r('sharpe_hold')} AS sharpe_hold, {r('sharpe_timed')} AS sharpe_timed FROM study""")
def _(spark, sf):
    return regime_study(regimes(spark, sf)).select("code", "n_hot", "n_calm", *[r6(c).alias(c) for c in ("fwd_hot", "fwd_calm", "sharpe_hold", "sharpe_timed")])


@query("regime_study_pooled", f"""WITH RECURSIVE {STUDY} SELECT count(*) AS names, {r('avg(fwd_calm)')} AS fwd_calm, {r('avg(fwd_hot)')} AS fwd_hot, {r('avg((fwd_hot < fwd_calm)::INT)')} AS leaving_helps,
  {r('avg(sharpe_hold)')} AS sharpe_hold, {r('avg(sharpe_timed)')} AS sharpe_timed, {r('avg((sharpe_timed > sharpe_hold)::INT)')} AS timing_wins FROM study""")
def _(spark, sf):
    s = regime_study(regimes(spark, sf))
    share = lambda c: F.avg(c.cast("int"))
    out = s.agg(
        F.count(F.lit(1)).alias("names"), F.avg("fwd_calm").alias("fwd_calm"), F.avg("fwd_hot").alias("fwd_hot"), share(F.col("fwd_hot") < F.col("fwd_calm")).alias("leaving_helps"),
        F.avg("sharpe_hold").alias("sharpe_hold"), F.avg("sharpe_timed").alias("sharpe_timed"), share(F.col("sharpe_timed") > F.col("sharpe_hold")).alias("timing_wins"),
    )
    return out.select("names", *[r6(c).alias(c) for c in out.columns if c != "names"])


BLK = GR + """, blk AS (SELECT code, pos // 5 AS block, sum(lret * lret) AS rv, avg(sign(lret)) AS mean_sign FROM gr GROUP BY code, pos // 5 HAVING count(*) = 5)"""


@query("block_variance", f"WITH {BLK} SELECT code, block, {r('rv')} AS rv, {r('mean_sign')} AS mean_sign FROM blk")
def _(spark, sf):
    b = rec.block_variance(gapless_returns(spark, sf), "code", "pos", "lret", 5)
    return b.select("code", "block", r6("rv").alias("rv"), r6("mean_sign").alias("mean_sign"))


_ls, _lm, _ll = (rec.halflife_lambda(rec.BLOCK_HALFLIVES[k]) for k in ("short", "mid", "leverage"))
EXPERTS = BLK + f""", e1 AS (SELECT *, {ewma_sql('rv', _ls, pos='block')} AS a, {ewma_sql('rv', _lm, pos='block')} AS b, {ewma_sql('rv', _ll, pos='block')} AS al FROM blk),
 dn AS (SELECT code, block, rv, row_number() OVER (PARTITION BY code ORDER BY block) - 1 AS kk FROM blk WHERE block = 0 OR mean_sign < 0),
 dn2 AS (SELECT code, block, {ewma_sql('rv', _ll, pos='kk')} AS dv FROM dn),
 e2 AS (SELECT e1.*, last_value(dv IGNORE NULLS) OVER (PARTITION BY code ORDER BY block ROWS UNBOUNDED PRECEDING) AS dv FROM e1 LEFT JOIN dn2 USING (code, block)),
 ex AS (SELECT code, block, rv, lag(a) OVER k AS x_short, lag(b) OVER k AS x_mid, avg(rv) OVER (k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x_long,
   CASE WHEN lag(a, 2) OVER k IS NOT NULL THEN greatest(2 * lag(a) OVER k - lag(a, 2) OVER k, 0) END AS x_mom, (lag(al) OVER k + lag(dv) OVER k) / 2 AS x_lev
  FROM e2 WINDOW k AS (PARTITION BY code ORDER BY block))"""
XS = ["x_short", "x_mid", "x_long", "x_mom", "x_lev"]


def experts(spark, sf):
    return rec.block_experts(rec.block_variance(gapless_returns(spark, sf), "code", "pos", "lret", 5), "code")


@query("block_experts", f"WITH {EXPERTS} SELECT code, block, {', '.join(f'{r(x)} AS {x}' for x in XS)} FROM ex")
def _(spark, sf):
    return experts(spark, sf).select("code", "block", *[r6(x).alias(x) for x in XS])


def _mix_step(p: str) -> str:
    """SQL of one mixture step: prediction and the next weights from the previous ones."""
    e = "list_transform(x, lambda v: power(v - rv, 2))"
    u = f"list_transform(range(1, 6), lambda j: ({p})[j] * exp(-5.0 * ({e})[j] / (list_avg({e}) + 1e-18)))"
    return f"list_dot_product({p}, x) AS pred, list_transform({u}, lambda v: v / list_sum({u})) AS p"


MIX = EXPERTS + f""", ms AS (SELECT code, block, rv, [{', '.join(XS)}] AS x, row_number() OVER (PARTITION BY code ORDER BY block) - 1 AS i FROM ex WHERE {' AND '.join(f'{x} IS NOT NULL' for x in XS)}),
 mh AS (SELECT code, block, i, {_mix_step('[0.2, 0.2, 0.2, 0.2, 0.2]::DOUBLE[]')} FROM ms WHERE i = 0 UNION ALL
  SELECT code, block, i, {_mix_step('q')} FROM (SELECT ms.*, mh.p AS q FROM mh JOIN ms ON ms.code = mh.code AND ms.i = mh.i + 1))"""


@query("expert_mixture", f"WITH RECURSIVE {MIX} SELECT code, block, {r('pred')} AS mix_pred, {', '.join(f'{r(f'p[{i + 1}]')} AS w_{x[2:]}' for i, x in enumerate(XS))} FROM ex LEFT JOIN mh USING (code, block)")
def _(spark, sf):
    d = rec.hedge_mixture(experts(spark, sf), "code", "block", XS, "rv", eta=5.0)
    return d.select("code", "block", r6("mix_pred").alias("mix_pred"), *[r6(F.col("mix_weights")[i]).alias(f"w_{x[2:]}") for i, x in enumerate(XS)])


@query("expert_mixture_adaptive")
def _(spark, sf):
    d = rec.hedge_mixture(experts(spark, sf), "code", "block", XS, "rv", eta=5.0, meta=0.1)
    return d.select("code", "block", r6("mix_pred").alias("mix_pred"))


NLMS_L = 2


@query("online_nlms", f"""WITH RECURSIVE {BLK}, s AS (SELECT code, block, rv AS y, lag(rv) OVER k AS a, lag(rv, 2) OVER k AS b FROM blk WINDOW k AS (PARTITION BY code ORDER BY block)),
  h AS (SELECT code, block, 0.0::DOUBLE AS pred, 0.1 * y / (1e-6 + 1 + a * a + b * b) AS w0, 0.1 * y * a / (1e-6 + 1 + a * a + b * b) AS w1, 0.1 * y * b / (1e-6 + 1 + a * a + b * b) AS w2 FROM s WHERE block = 2
   UNION ALL SELECT s.code, s.block, p, w0 + 0.1 * (y - p) / nn, w1 + 0.1 * (y - p) * a / nn, w2 + 0.1 * (y - p) * b / nn FROM (
     SELECT s.*, h.w0, h.w1, h.w2, h.w0 + h.w1 * s.a + h.w2 * s.b AS p, 1e-6 + 1 + s.a * s.a + s.b * s.b AS nn FROM h JOIN s ON s.code = h.code AND s.block = h.block + 1) s)
 SELECT code, block, {r('pred')} AS pred FROM h""")
def _(spark, sf):
    b = rec.block_variance(gapless_returns(spark, sf), "code", "pos", "lret", 5)
    d = rec.online_forecast(b, "code", "block", "rv", NLMS_L, lambda n: rec.Nlms(n, 0.1)).where("pred IS NOT NULL")
    return d.select("code", "block", r6("pred").alias("pred"))


@query("online_learner_skill")
def _(spark, sf):
    """Held-out skill of each online learner against a lagged rolling-mean baseline, per learner."""
    from ..operators.metrics import forecast_skill

    b = rec.block_variance(gapless_returns(spark, sf), "code", "pos", "lret", 5)
    w = Window.partitionBy("code")
    z = b.withColumns({"half": F.floor(F.count(F.lit(1)).over(w) / 2)})
    train = F.col("block") < F.col("half")
    z = z.withColumns({"mu": F.avg(F.when(train, F.col("rv"))).over(w), "sd": F.stddev_pop(F.when(train, F.col("rv"))).over(w)})
    z = z.withColumn("z", (F.col("rv") - F.col("mu")) / (F.col("sd") + 1e-12))
    z = z.withColumn("base", F.avg("z").over(w.orderBy("block").rowsBetween(-20, -1)))
    out = None
    for name, make in {
        "nlms": lambda n: rec.Nlms(n), "nlms_trend": lambda n: rec.TrendRateNlms(n), "idbd": lambda n: rec.Idbd(n), "idbd_meta": lambda n: rec.Idbd(n, meta=0.1),
    }.items():
        d = rec.online_forecast(z, "code", "block", "z", 5, make).where((F.col("block") >= F.col("half")) & F.col("pred").isNotNull())
        s = d.groupBy(F.lit(name).alias("learner")).agg(*[r6(e).alias(k) if k != "n" else e.alias(k) for k, e in forecast_skill("z", "pred", "base").items()])
        out = s if out is None else out.unionByName(s)
    return out


@query("market_regime", f"""WITH RECURSIVE {q.BOOKRET}, m AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, avg(cret) AS x FROM br WHERE cret IS NOT NULL GROUP BY date),
  z AS (SELECT *, {_pdf('x', 0)} AS f0, {_pdf('x', 1)} AS f1 FROM m),
  h AS (SELECT pos, date, {START[1]} * f1 / ({START[0]} * f0 + {START[1]} * f1) AS p FROM z WHERE pos = 0 UNION ALL
   SELECT z.pos, z.date, z.f1 * ((1 - h.p) * {TRANS[0][1]} + h.p * {TRANS[1][1]}) /
     (z.f0 * ((1 - h.p) * {TRANS[0][0]} + h.p * {TRANS[1][0]}) + z.f1 * ((1 - h.p) * {TRANS[0][1]} + h.p * {TRANS[1][1]})) FROM h JOIN z ON z.pos = h.pos + 1)
 SELECT date, {r('p')} AS p_turbulent FROM h""")
def _(spark, sf):
    m = with_position(market(spark, sf).withColumn("book", F.lit("market")), "book", "date")
    return rec.regime_filter(m.select("book", "pos", "date", "mret"), "book", "pos", "mret", MEANS, VARS, TRANS, START).select("date", r6("p_1").alias("p_turbulent"))
