"""Quantile forecasts and calibration plans."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import norm_ppf, r6, year_of
from ..operators import forecast as fo
from ..operators import recursion as rec
from ..operators import rolling, stats, xsec
from ..operators.clock import Clock
from ..session import materialise
from . import query
from . import sqltext as q
from .recursions import EV, GR, gapless_returns
from .sqltext import full, r

BAR = Clock("code", "pos")
LV = [0.05, 0.25, 0.5, 0.75, 0.95]
HS = [1, 5, 10]
Z = norm_ppf(LV)

YS = f"""ys AS (SELECT code, pos, unnest([1, 5, 10]) AS h, unnest([{', '.join(f"CASE WHEN count(lret) OVER (k {q.frame(1, h)}) = {h} THEN sum(lret) OVER (k {q.frame(1, h)}) END" for h in HS)}]) AS y FROM gr WINDOW k AS (PARTITION BY code ORDER BY pos))"""


@query("realised_paths", f"WITH {GR}, {YS} SELECT code, pos, h, {r('y')} AS y FROM ys WHERE y IS NOT NULL")
def _(spark, sf):
    d = fo.realised_paths(gapless_returns(spark, sf).select("code", "pos", "lret"), BAR, "lret", HS)
    return d.select("code", F.col("pos").cast("long").alias("pos"), "h", r6("y").alias("y"))


def ewma_origins(spark, sf):
    """Origins with the variance forecast for the next row, every tenth row after the burn-in."""
    d = gapless_returns(spark, sf).select("code", "pos", "date", "lret")
    d = rec.ewma_variance(d, "code", "pos", "lret", 0.94, 60, out="v")
    d = d.withColumn("sigma", F.sqrt(F.col("v") * 0.94 + F.col("lret") * F.col("lret") * 0.06)).where("pos >= 59")
    return fo.realised_paths(d, BAR, "lret", HS)


GQ = EV + f""", {YS}, go AS (SELECT ev.code, ev.date, ev.pos, h, y, sqrt(0.94 * v + 0.06 * lret * lret) * sqrt(h) AS s FROM ev JOIN ys ON ev.code = ys.code AND ev.pos = ys.pos WHERE y IS NOT NULL)"""


@query("gaussian_ewma_quantiles", f"WITH {GQ} SELECT code, pos, h, {', '.join(f'{r(f'({z!r}) * s')} AS q{round(p * 100)}' for p, z in zip(LV, Z))} FROM go")
def _(spark, sf):
    d = ewma_origins(spark, sf).withColumn("q", fo.gaussian_quantiles("sigma", "h", LV))
    return d.select("code", F.col("pos").cast("long").alias("pos"), "h", *[r6(F.col("q")[i]).alias(f"q{round(p * 100)}") for i, p in enumerate(LV)])


def _pin(qe, p):
    return f"CASE WHEN y - {qe} >= 0 THEN {p} * (y - {qe}) ELSE ({p} - 1) * (y - {qe}) END"


@query("crps_coverage", f"""WITH {GQ}, sc AS (SELECT h, 2 * ({' + '.join(_pin(f'({z!r}) * s', p) for p, z in zip(LV, Z))}) / {len(LV)} AS crps, (y >= {Z[0]!r} * s AND y <= {Z[-1]!r} * s)::INT AS hit90, (y >= {Z[1]!r} * s AND y <= {Z[3]!r} * s)::INT AS hit50 FROM go)
 SELECT h, count(*) AS n, {r('avg(crps)')} AS crps, {r('avg(hit50)')} AS cov_50, {r('avg(hit90)')} AS cov_90 FROM sc GROUP BY h""")
def _(spark, sf):
    d = ewma_origins(spark, sf).withColumn("q", fo.gaussian_quantiles("sigma", "h", LV))
    s = fo.summarise(fo.score(d, LV), ["h"])
    return s.select("h", "n", r6("crps").alias("crps"), r6("cov_50").alias("cov_50"), r6("cov_90").alias("cov_90"))


def pit_sql(qs: list[str]) -> str:
    out = f"CASE WHEN y < {qs[0]} THEN {LV[0]} WHEN y >= {qs[-1]} THEN {LV[-1]}"
    for i in range(len(qs) - 1):
        out += f" WHEN y < {qs[i + 1]} THEN {LV[i]} + ({LV[i + 1]} - {LV[i]}) * (y - {qs[i]}) / ({qs[i + 1]} - {qs[i]})"
    return out + " END"


@query("pit_values", f"WITH {GQ} SELECT code, pos, h, {r(pit_sql([f'({z!r}) * s' for z in Z]))} AS pit FROM go")
def _(spark, sf):
    d = fo.score(ewma_origins(spark, sf).withColumn("q", fo.gaussian_quantiles("sigma", "h", LV)), LV)
    return d.select("code", F.col("pos").cast("long").alias("pos"), "h", r6("pit").alias("pit"))


@query("forward_miscalibration", f"WITH {GQ}, p AS (SELECT code, pos, h, {pit_sql([f'({z!r}) * s' for z in Z])} AS pit FROM go) SELECT code, pos, {r('avg(2 * abs(pit - 0.5))')} AS miscal FROM p GROUP BY code, pos HAVING count(*) = 3")
def _(spark, sf):
    d = fo.score(ewma_origins(spark, sf).withColumn("q", fo.gaussian_quantiles("sigma", "h", LV)), LV)
    d = d.groupBy("code", "pos").agg(F.avg(fo.tail_level("pit")).alias("m"), F.count(F.lit(1)).alias("n")).where("n = 3")
    return d.select("code", F.col("pos").cast("long").alias("pos"), r6("m").alias("miscal"))


_n = "ROWS BETWEEN 99 PRECEDING AND CURRENT ROW"
EQ = GR + f""", eb AS (SELECT code, pos, date, quantile_cont(lret, [0.05, 0.25, 0.5, 0.75, 0.95]) OVER (PARTITION BY code ORDER BY pos {_n}) AS q, avg(lret) OVER (PARTITION BY code ORDER BY pos {_n}) AS m FROM gr QUALIFY count(*) OVER (PARTITION BY code ORDER BY pos {_n}) = 100)"""


def empirical(spark, sf):
    d = gapless_returns(spark, sf).select("code", "pos", "date", "lret")
    return fo.empirical_base(d, BAR, "lret", 100, LV)


@query("empirical_quantiles", f"WITH {EQ} SELECT code, pos, {', '.join(f'{r(f'(q[{i + 1}] - m) * sqrt(5.0)')} AS q{round(p * 100)}' for i, p in enumerate(LV))} FROM eb")
def _(spark, sf):
    d = empirical(spark, sf).where("base IS NOT NULL").withColumn("q", fo.scale_sqrt("base", F.lit(5)))
    return d.select("code", F.col("pos").cast("long").alias("pos"), *[r6(F.col("q")[i]).alias(f"q{round(p * 100)}") for i, p in enumerate(LV)])


@query("forecast_combination", f"""WITH {EQ}, {GQ[len(GR) + 2:]}, c AS (SELECT eb.code, eb.pos, (q[1] - m + ({Z[0]!r}) * s) / 2 AS q5, (q[5] - m + ({Z[4]!r}) * s) / 2 AS q95 FROM eb JOIN go ON eb.code = go.code AND eb.pos = go.pos AND h = 1)
 SELECT code, pos, {r('q5')} AS q5, {r('q95')} AS q95 FROM c""")
def _(spark, sf):
    a = empirical(spark, sf).where("base IS NOT NULL").select("code", "pos", F.col("base").alias("q"))
    b = ewma_origins(spark, sf).where("h = 1").withColumn("q", fo.gaussian_quantiles("sigma", "h", LV)).select("code", "pos", "q")
    both = a.join(b.select("code", "pos"), ["code", "pos"], "left_semi").unionByName(b.join(a.select("code", "pos"), ["code", "pos"], "left_semi"))
    d = fo.combine(both, ["code", "pos"])
    return d.select("code", F.col("pos").cast("long").alias("pos"), r6(F.col("q")[0]).alias("q5"), r6(F.col("q")[4]).alias("q95"))


@query("backward_distrust", f"""WITH {EQ}, bk AS (SELECT code, pos, {', '.join(f"sum(lret) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW) AS y{h}" for h in (1, 2, 3))} FROM gr),
 x AS (SELECT eb.code, eb.pos, {', '.join(f"2 * abs(({pit_sql([f'((q[{i + 1}] - m) * sqrt({h}.0))' for i in range(5)]).replace('y ', f'y{h} ').replace('(y -', f'(y{h} -')}) - 0.5) AS d{h}" for h in (1, 2, 3))} FROM eb JOIN bk USING (code, pos))
 SELECT code, pos, {r('(d1 + d2 + d3) / 3')} AS distrust FROM x""")
def _(spark, sf):
    d = empirical(spark, sf)
    d = d.withColumn("distrust", fo.backward_distrust(BAR, "lret", "base", LV, 3)).where("base IS NOT NULL")
    return d.select("code", F.col("pos").cast("long").alias("pos"), r6("distrust").alias("distrust"))


@query("regime_coverage", f"""WITH {GQ}, g AS (SELECT year(date) AS yr, abs(y) <= {norm_ppf([0.95])[0]!r} * s AS hit, s > avg(s) OVER (PARTITION BY code, h) AS hot FROM go WHERE h = 1)
 SELECT yr, hot, count(*) AS n, {r('avg(hit::INT)')} AS coverage, {r('1 - avg(hit::INT)')} AS breach FROM g GROUP BY yr, hot""")
def _(spark, sf):
    d = ewma_origins(spark, sf).where("h = 1")
    d = d.withColumns({"hot": F.col("sigma") > F.avg("sigma").over(Window.partitionBy("code", "h")), "hit": F.abs("y") <= F.col("sigma") * norm_ppf([0.95])[0]})
    c = F.avg(F.col("hit").cast("double"))
    return d.groupBy(year_of("date").alias("yr"), "hot").agg(F.count(F.lit(1)).alias("n"), r6(c).alias("coverage"), r6(1 - c).alias("breach"))


DT = EV + f""", dp AS (SELECT code, pos, date, ln(sqrt(v)) AS xe, ln(0.01 + {full('max(lp)', 'lp', 60)} - {full('min(lp)', 'lp', 60)}) AS xd, ln(sqrt(avg(lret * lret) OVER (k RANGE BETWEEN 1 FOLLOWING AND 10 FOLLOWING))) AS y,
   count(*) OVER (k RANGE BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS nf, count(*) OVER (k RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS np FROM (SELECT *, ln(close) AS lp FROM ev) WINDOW k AS (PARTITION BY code ORDER BY pos)),
 dq AS (SELECT *, pos < 300 AS tr FROM dp WHERE nf = 10 AND np = 60),
 fe AS (SELECT regr_slope(xd, xe) AS b, regr_intercept(xd, xe) AS a FROM dq WHERE tr), fy AS (SELECT regr_slope(y, xe) AS b, regr_intercept(y, xe) AS a FROM dq WHERE tr),
 rr AS (SELECT dq.*, xd - fe.a - fe.b * xe AS rd, y - fy.a - fy.b * xe AS ry FROM dq, fe, fy), bb AS (SELECT sum(rd * ry) / sum(rd * rd) AS beta FROM rr WHERE tr)"""


@query("depth_tilted_width", f"WITH {DT} SELECT code, date, {r('beta * rd')} AS log_tilt, {r('exp(xe) * exp(beta * rd)')} AS width FROM rr, bb WHERE NOT tr")
def _(spark, sf):
    """Volatility forecast tilted by log depth after removing what volatility already explains (fit on the training rows)."""
    d = gapless_returns(spark, sf).select("code", "pos", "date", "close", "lret")
    d = rec.ewma_variance(d, "code", "pos", "lret", 0.94, 60, out="v").where("pos >= 59").withColumn("lp", F.log("close"))
    d = d.withColumns({"xe": F.log(F.sqrt("v")), "xd": F.log(rolling.drawdown_depth(BAR, "lp", 60) + 0.01), "y": F.log(F.sqrt(BAR.full_ahead(F.avg, F.col("lret") * F.col("lret"), 10)))})
    d = d.where("xd IS NOT NULL AND y IS NOT NULL").withColumn("tr", F.col("pos") < 300)
    tr = d.where("tr")
    fit = tr.agg(F.regr_slope("xd", "xe").alias("b1"), F.regr_intercept("xd", "xe").alias("a1"), F.regr_slope("y", "xe").alias("b2"), F.regr_intercept("y", "xe").alias("a2"))
    d = d.join(F.broadcast(fit)).withColumns({"rd": F.col("xd") - F.col("a1") - F.col("b1") * F.col("xe"), "ry": F.col("y") - F.col("a2") - F.col("b2") * F.col("xe")})
    beta = d.where("tr").agg((F.sum(F.col("rd") * F.col("ry")) / F.sum(F.col("rd") * F.col("rd"))).alias("beta"))
    d = d.where("NOT tr").join(F.broadcast(beta)).withColumn("tilt", F.col("beta") * F.col("rd"))
    return d.select("code", "date", r6("tilt").alias("log_tilt"), r6(F.exp("xe") * F.exp("tilt")).alias("width"))


VX = ["v_short", "v_mid", "v_long", "v_mean", "v_lev"]


def _ev_sql():
    from .recursions import ewma_sql

    lam = {k: rec.halflife_lambda(v) for k, v in fo.EXPERT_HALFLIVES.items()}
    return GR + f""", e0 AS (SELECT *, lret * lret AS r2, lret * lret * 2 * (lret < 0)::INT AS dn FROM gr), e1 AS (SELECT *, coalesce(lag(r2) OVER k, r2) AS x, coalesce(lag(dn) OVER k, dn) AS xd FROM e0 WINDOW k AS (PARTITION BY code ORDER BY pos)),
 vx AS (SELECT code, pos, lret, {ewma_sql('x', lam['short'])} AS v_short, {ewma_sql('x', lam['mid'])} AS v_mid, {ewma_sql('x', lam['long'])} AS v_long, {ewma_sql('xd', lam['leverage'])} AS v_lev,
   coalesce(avg(r2) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r2) AS v_mean FROM e1)"""


@query("expert_variances", f"WITH {_ev_sql()} SELECT code, pos, {', '.join(f'{r(v)} AS {v}' for v in VX)} FROM vx")
def _(spark, sf):
    d = fo.expert_variances(gapless_returns(spark, sf).select("code", "pos", "lret"), "code", "pos", "lret")
    return d.select("code", F.col("pos").cast("long").alias("pos"), *[r6(v).alias(v) for v in VX])


def stack_coefficients(spark, sf):
    """Pooled least squares of the squared return on the expert variances: one tiny row."""
    return _pooled_fit(fo.expert_variances(gapless_returns(spark, sf).select("code", "pos", "lret"), "code", "pos", "lret"))


def _pooled_fit(ex):
    d = ex.where("pos >= 60").withColumn("r2", F.col("lret") * F.col("lret"))
    return stats.fit_ols(d, VX, "r2")


@query("pooled_expert_fit")
def _(spark, sf):
    return stack_coefficients(spark, sf).select(*[r6(F.col("coef")[i]).alias(n) for i, n in enumerate(["const", *VX])])


def _origin_windows(spark, sf, n=120, stride=40):
    d = gapless_returns(spark, sf).select("code", "pos", "lret")
    d = d.withColumn("win", F.collect_list("lret").over(BAR.back(n)))
    return d.where((F.col("pos") >= n - 1) & ((F.col("pos") - (n - 1)) % stride == 0))


def _outcomes(d, first, stride, horizons):
    """Realised paths of the origin rows only; the filter sits below the explode."""
    y = fo.realised_paths(d, BAR, "lret", horizons).select("code", "pos", "h", "y")
    return y.where((F.col("pos") >= first) & ((F.col("pos") - first) % stride == 0))


@query("bootstrap_quantiles")
def _(spark, sf):
    """Scores of the simulated forecasters on strided origins, one row per (model, horizon)."""
    d = gapless_returns(spark, sf).select("code", "pos", "lret")
    y = _outcomes(d, 119, 40, [1, 2, 3, 4, 5])
    g = fo.simulate_origins(_origin_windows(spark, sf).repartition("code"), "code", "pos", "win", 5, LV, list(fo.FORECASTERS), 300)
    s = fo.summarise(fo.score(g.join(y, ["code", "pos", "h"]), LV), ["model", "h"])
    return s.select("model", "h", "n", *[r6(c).alias(c) for c in ("crps", "cov_50", "cov_90")])


@query("filtered_simulation")
def _(spark, sf):
    """Walk-forward scores of the filtered simulations (EWMA, leverage EWMA, expert stack)."""
    base = gapless_returns(spark, sf).select("code", "pos", "lret")
    y = materialise(_outcomes(base, 149, 60, [1, 2, 3, 4, 5]))
    out = None
    ex = materialise(fo.expert_variances(base, "code", "pos", "lret"))  # read by the pooled fit and the simulation
    coef = [float(v) for v in _pooled_fit(ex).head()["coef"]]  # six numbers
    grids = {
        "ewma": fo.filtered_simulation(rec.ewma_variance(base, "code", "pos", "lret", 0.94, 60, out="v"), "code", "pos", "lret", "v", 5, LV, 60, 150, sims=300),
        "gjr": fo.filtered_simulation(rec.ewma_variance(base, "code", "pos", "lret", 0.94, 60, 0.5, out="v"), "code", "pos", "lret", "v", 5, LV, 60, 150, gamma=0.5, sims=300),
        "stack": fo.stack_simulation(ex, "code", "pos", "lret", coef, 5, LV, 60, 150, sims=300),
    }
    for name, g in grids.items():
        s = fo.summarise(fo.score(g.join(y, ["code", "pos", "h"]), LV), ["h"]).withColumn("model", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out.select("model", "h", "n", *[r6(c).alias(c) for c in ("crps", "cov_50", "cov_90")])
