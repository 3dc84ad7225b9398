"""Regressions, walk-forward selection, factor structure, bootstraps and permutation nulls."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import month_index, r6, r6_any, year_of
from ..operators import resampling as rs
from ..operators import rolling, stats, xsec
from ..operators.clock import Clock, with_position
from ..operators.replicas import correlation, draw_sql, follow_the_mean, moments_with, permuted_sums
from ..session import materialise
from ..sources import tables as t
from . import query
from . import sqltext as q
from .cross_section import AVG_RANK, splits
from .event_plans import ORB, orb
from .panel import market, monthly_signals
from .recursions import GR, ewma_sql, gapless_returns
from .sqltext import full, r

BAR = Clock("code", "pos")


def h_sql(*parts: str) -> str:
    """SQL twin of ``hash_int``."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 12))::BIGINT"


HAR = GR + f""", rv AS (SELECT *, ln(lret * lret + 0.01) AS y FROM gr), hf AS (SELECT *, lag(y) OVER k AS x1, {full('avg(y)', 'y', 10, 1)} AS x2 FROM rv WINDOW k AS (PARTITION BY code ORDER BY pos))"""


def har_frame(spark, sf):
    d = gapless_returns(spark, sf).withColumn("y", F.log(F.col("lret") * F.col("lret") + 0.01))
    return d.withColumns({"x1": BAR.at("y", -1), "x2": BAR.full(F.avg, "y", 10, 1)})


def two_reg(src: str, w: str = "", where: str = "") -> str:
    """Closed form of a two-regressor least squares from covariances."""
    o = f" OVER {w}" if w else ""
    f = f" FILTER (WHERE {where})" if where else ""
    c = {f"{a}{b}": f"covar_pop({a}, {b}){f}{o}" for a, b in (("x1", "x1"), ("x2", "x2"), ("x1", "x2"), ("x1", "y"), ("x2", "y"))}
    det = f"({c['x1x1']} * {c['x2x2']} - {c['x1x2']} * {c['x1x2']})"
    b1 = f"(({c['x1y']} * {c['x2x2']} - {c['x2y']} * {c['x1x2']}) / {det})"
    b2 = f"(({c['x2y']} * {c['x1x1']} - {c['x1y']} * {c['x1x2']}) / {det})"
    b0 = f"(avg(y){f}{o} - {b1} * avg(x1){f}{o} - {b2} * avg(x2){f}{o})"
    return f"{b0} AS b0, {b1} AS b1, {b2} AS b2"


@query("pooled_ols", f"WITH {HAR}, o AS (SELECT {two_reg('hf')} FROM hf WHERE x2 IS NOT NULL) SELECT {r('b0')} AS b0, {r('b1')} AS b1, {r('b2')} AS b2 FROM o")
def _(spark, sf):
    o = stats.fit_ols(har_frame(spark, sf), ["x1", "x2"], "y")
    return o.select(*[r6(F.col("coef")[i]).alias(f"b{i}") for i in range(3)])


@query("train_test_ols", f"""WITH {HAR}, n AS (SELECT *, pos < count(*) OVER (PARTITION BY code) // 2 AS tr FROM hf WHERE x2 IS NOT NULL), o AS (SELECT code, {two_reg('n')} FROM n WHERE tr GROUP BY code),
  p AS (SELECT code, y, b0 + b1 * x1 + b2 * x2 AS p FROM n JOIN o USING (code) WHERE NOT tr)
 SELECT code, count(*) AS n, {r('1 - sum(power(y - p, 2)) / (var_pop(y) * count(*))')} AS r2, {r('corr(y, p)')} AS corr FROM p GROUP BY code""")
def _(spark, sf):
    d = har_frame(spark, sf).where("x2 IS NOT NULL")
    d = d.withColumn("tr", F.col("pos") < F.floor(F.count(F.lit(1)).over(Window.partitionBy("code")) / 2))
    o = stats.fit_ols(d.where("tr"), ["x1", "x2"], "y", ["code"])
    p = d.where("NOT tr").join(o, "code").withColumn("p", stats.predict(F.col("coef"), [F.col("x1"), F.col("x2")]))
    e = F.col("y") - F.col("p")
    return p.groupBy("code").agg(F.count(F.lit(1)).alias("n"), r6(1 - F.sum(e * e) / (F.var_pop("y") * F.count(F.lit(1)))).alias("r2"), r6(F.corr("y", "p")).alias("corr"))


@query("walkforward_ols", f"""WITH {HAR}, g AS (SELECT * FROM hf WHERE x2 IS NOT NULL), o AS (SELECT code, date, x1, x2, count(*) OVER w AS n, {two_reg('g', 'w')} FROM g WINDOW w AS (PARTITION BY code ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND 5 PRECEDING))
 SELECT code, date, {r('b0 + b1 * x1 + b2 * x2', 5)} AS pred FROM o WHERE n >= 100""")
def _(spark, sf):
    d = stats.walk_forward_ols(har_frame(spark, sf).where("x2 IS NOT NULL"), ["code"], "pos", ["x1", "x2"], "y", 5, 100)
    return d.where("pred IS NOT NULL").select("code", "date", r6("pred", 5).alias("pred"))


@query("walkforward_ols_trailing", f"""WITH {HAR}, g AS (SELECT * FROM hf WHERE x2 IS NOT NULL), o AS (SELECT code, date, x1, x2, count(*) OVER w AS n, {two_reg('g', 'w')} FROM g WINDOW w AS (PARTITION BY code ORDER BY pos RANGE BETWEEN 154 PRECEDING AND 5 PRECEDING))
 SELECT code, date, {r('b0 + b1 * x1 + b2 * x2', 5)} AS pred FROM o WHERE n >= 100""")
def _(spark, sf):
    d = stats.walk_forward_ols(har_frame(spark, sf).where("x2 IS NOT NULL"), ["code"], "pos", ["x1", "x2"], "y", 5, 100, trailing=150)
    return d.where("pred IS NOT NULL").select("code", "date", r6("pred", 5).alias("pred"))


@query("forecast_skill", f"""WITH {HAR}, g AS (SELECT *, x1 AS p, avg(y) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS b FROM hf WHERE x2 IS NOT NULL)
 SELECT code, count(y) AS n, {r('corr(y, p)')} AS corr, {r('sqrt(sum(power(y - p, 2)) / count(y))')} AS rmse, {r('1 - sum(power(y - p, 2)) / (var_pop(y) * count(y))')} AS r2_vs_mean, {r('1 - sum(power(y - p, 2)) / sum(power(y - b, 2))')} AS skill_vs_base
 FROM g WHERE b IS NOT NULL GROUP BY code""")
def _(spark, sf):
    from ..operators.metrics import forecast_skill

    d = har_frame(spark, sf).where("x2 IS NOT NULL")
    d = d.withColumn("b", F.avg("y").over(BAR.ordered.rowsBetween(-20, -1))).where("b IS NOT NULL")
    return d.groupBy("code").agg(*[e.alias(k) if k == "n" else r6(e).alias(k) for k, e in forecast_skill("y", "x1", "b").items()])


BUCKETS = q.MSIG + """, v AS (SELECT * FROM msig WHERE mom IS NOT NULL AND fret IS NOT NULL), bk AS (SELECT mi, ntile(5) OVER (PARTITION BY mi ORDER BY mom, code) AS key, fret FROM v),
 kr AS (SELECT key, mi, avg(fret) AS ret, dense_rank() OVER (ORDER BY mi) - 1 AS step FROM bk GROUP BY key, mi)"""


@query("walkforward_select", f"""WITH {BUCKETS}, tr AS (SELECT *, CASE WHEN count(ret) OVER w = 12 THEN sum(ln(1 + ret)) OVER w END AS tr FROM kr WINDOW w AS (PARTITION BY key ORDER BY step ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
 pk AS (SELECT (step - 12) // 6 AS block, key FROM tr WHERE step >= 12 AND (step - 12) % 6 = 0 QUALIFY row_number() OVER (PARTITION BY step ORDER BY tr DESC, key) = 1)
 SELECT (step - 12) // 6 AS block, step, CAST(kr.key AS BIGINT) AS pick, {r('ret')} AS ret FROM kr JOIN pk ON pk.block = (step - 12) // 6 AND pk.key = kr.key WHERE step >= 12""")
def _(spark, sf):
    v = monthly_signals(spark, sf).where("mom IS NOT NULL AND fret IS NOT NULL")
    b = xsec.equal_split(v, "mi", "mom", 5, "code", "key", splits(spark, sf))
    kr = b.groupBy("key", "mi").agg(F.avg("fret").alias("ret"))  # five rows a month from here on
    kr = kr.withColumn("step", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("mi")) - 1)
    d = stats.walk_forward_select(kr, "key", "step", "ret", 12, 6)
    return d.select("block", F.col("step").cast("long").alias("step"), F.col("pick").cast("long").alias("pick"), r6("ret").alias("ret"))


@query("partial_ic", f"""WITH {q.MSIG}, v AS (SELECT * FROM msig WHERE mom IS NOT NULL AND fret IS NOT NULL), f AS (SELECT mi, regr_slope(mom, turnover) AS bx, regr_intercept(mom, turnover) AS ax, regr_slope(fret, turnover) AS b_y, regr_intercept(fret, turnover) AS ay FROM v GROUP BY mi),
 rr AS (SELECT code, v.mi, mom - ax - bx * turnover AS a, fret - ay - b_y * turnover AS b FROM v JOIN f USING (mi)), rk AS (SELECT mi, {AVG_RANK.format(x='a')} AS ra, {AVG_RANK.format(x='b')} AS rb FROM rr)
 SELECT mi, count(*) AS n, {r('corr(ra, rb)')} AS ic FROM rk GROUP BY mi""")
def _(spark, sf):
    v = monthly_signals(spark, sf)
    return stats.partial_spearman(v, ["mi"], "mom", "fret", "turnover", "code", splits(spark, sf)).select("mi", "n", r6("ic").alias("ic"))


@query("rank_auc", f"""WITH {q.MSIG}, v AS (SELECT *, row_number() OVER (ORDER BY mom, code * 100000 + mi) AS rk FROM msig WHERE mom IS NOT NULL AND fret IS NOT NULL), y AS (SELECT rk, (fret > 0)::INT AS y FROM v)
 SELECT {r('(sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y))')} AS auc, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg FROM y""")
def _(spark, sf):
    v = monthly_signals(spark, sf).where("mom IS NOT NULL AND fret IS NOT NULL").withColumns({"y": F.col("fret") > 0, "id": F.col("code") * 100000 + F.col("mi")})
    return stats.rank_auc(v.select("id", "y", "mom"), "y", "mom", "id").withColumn("auc", r6("auc"))


@query("logistic_auc")
def _(spark, sf):
    """Standardised logistic fit on the first half of months, scored on both halves."""
    v = monthly_signals(spark, sf).where("mom IS NOT NULL AND fret IS NOT NULL")
    v = v.withColumns({"y": F.col("fret") > 0, "liq": F.log("turnover"), "id": F.col("code") * 100000 + F.col("mi"), "train": F.col("mi") < 23982}).select("id", "y", "mom", "mret", "liq", "train")
    s = materialise(stats.logistic(materialise(v), ["mom", "mret", "liq"], "y", F.col("train")).select("id", "y", "score", "train"))
    parts = [stats.rank_auc(s.where(F.col("train") == f), "y", "score", "id").withColumn("is_train", F.lit(f)) for f in (True, False)]
    return parts[0].unionByName(parts[1]).withColumn("auc", r6("auc"))


def factor_series(spark, sf, level: str):
    """Mean daily return per nation or region: the small factor panel, one row per (date, factor)."""
    s = t.table(spark, sf, "supplier").join(t.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = {"nation": "n_name", "region": "r_name"}[level]
    s = s.select(F.col("s_suppkey").alias("code"), F.col(name).alias("factor"))
    d = t.daily_returns(spark, sf).where("lret IS NOT NULL").join(s, "code")
    return d.groupBy("date", "factor").agg(F.avg("lret").alias("x"))


FAC = q.RETS + """, fs AS (SELECT date, {name} AS factor, avg(lret) AS x FROM rets JOIN supplier ON s_suppkey = code JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE lret IS NOT NULL GROUP BY 1, 2)"""


@query("factor_correlations", f"WITH {FAC.format(name='r_name')} SELECT a.factor AS a, b.factor AS b, {r('corr(a.x, b.x)')} AS corr FROM fs a JOIN fs b USING (date) GROUP BY 1, 2")
def _(spark, sf):
    return stats.correlation_pairs(factor_series(spark, sf, "region"), "date", "factor", "x").withColumn("corr", r6("corr"))


def region_wide(spark, sf):
    """Complete dates of the factor panel in columns f0, f1, .., and the names of the factors (the rows of the dimension table)."""
    f = factor_series(spark, sf, "region")
    factors = [x["r_name"] for x in t.table(spark, sf, "region").select("r_name").distinct().orderBy("r_name").collect()]
    wide = f.groupBy("date").pivot("factor", factors).agg(F.first("x"))
    names = [f"f{i}" for i in range(len(factors))]
    return wide.toDF("date", *names).dropna(), names, factors


@query("pca_panel")
def _(spark, sf):
    """PCA of the standardised region panel: one row per (component, factor) with loading and variance share."""
    wide, names, factors = region_wide(spark, sf)
    _, load, var = stats.principal_components(materialise(wide), names, 3)
    rows = [(i + 1, name, float(load[i][j]), var[i]) for i in range(3) for j, name in enumerate(factors)]
    return spark.createDataFrame(rows, "component int, factor string, loading double, share double").select("component", "factor", r6("loading").alias("loading"), r6("share").alias("share"))


@query("factor_flows")
def _(spark, sf):
    """Raw returns projected on the PCA loadings, cumulated and oriented to end positive."""
    wide, names, _ = region_wide(spark, sf)
    wide = materialise(wide)
    _, load, _ = stats.principal_components(wide, names, 3)
    proj = F.array(*[F.struct(F.lit(i + 1).alias("component"), sum((F.col(n) * float(load[i][j]) for j, n in enumerate(names)), F.lit(0.0)).alias("pnl")) for i in range(3)])
    d = wide.select("date", F.explode(proj).alias("p")).select("date", "p.*")
    w = Window.partitionBy("component")
    d = d.withColumn("cum", F.sum("pnl").over(w.orderBy("date")))
    total = F.sum("pnl").over(w)
    return d.select("date", "component", r6(F.col("cum") * F.signum(total)).alias("flow"))


@query("embedding_pca")
def _(spark, sf):
    """Variance shares of the centred embedding vectors, whole; vectors of other lengths than the longest take no part."""
    e = t.table(spark, sf, "embeddings").where("embedding is not null")
    width = e.agg(F.max(F.size("embedding"))).first()[0]
    d = materialise(e.where(F.size("embedding") == width).select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(width)]))
    _, _, var = stats.principal_components(d, [f"e{i}" for i in range(width)], min(8, width), standardise=False)
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(var)], "component int, share double").withColumn("share", r6("share"))


@query("absorption_ratio")
def _(spark, sf):
    wide, names, _ = region_wide(spark, sf)
    d = stats.absorption_ratio(wide, "date", names, 126).where("absorption IS NOT NULL")
    return d.select("date", r6("absorption").alias("absorption"))


@query("lag_autocorrelation", f"""WITH {GR}, z AS (SELECT code, pos, abs(lret) - avg(abs(lret)) OVER (PARTITION BY code) AS z FROM gr), l AS (SELECT code, z, lag(z) OVER k AS l1, lag(z, 5) OVER k AS l5 FROM z WINDOW k AS (PARTITION BY code ORDER BY pos))
 SELECT code, {r('sum(z * l1) / (sum(z * z) + 1e-12)')} AS ac_1, {r('sum(z * l5) / (sum(z * z) + 1e-12)')} AS ac_5 FROM l GROUP BY code""")
def _(spark, sf):
    d = gapless_returns(spark, sf).withColumn("a", F.abs("lret"))
    return stats.lag_autocorrelation(d, ["code"], "pos", "a", [1, 5]).select("code", r6("ac_1").alias("ac_1"), r6("ac_5").alias("ac_5"))


_l20 = 2.0 ** (-1 / 20.0)


@query("residual_autocorrelation", f"""WITH {GR}, d AS (SELECT code, pos, lret - avg(lret) OVER (PARTITION BY code) AS d FROM gr), v AS (SELECT code, pos, abs(d / sqrt({ewma_sql('d * d', _l20)})) AS a FROM d),
 z AS (SELECT code, pos, a - avg(a) OVER (PARTITION BY code) AS z FROM v), l AS (SELECT code, z, lag(z) OVER k AS l1, lag(z, 5) OVER k AS l5 FROM z WINDOW k AS (PARTITION BY code ORDER BY pos))
 SELECT code, {r('sum(z * l1) / (sum(z * z) + 1e-12)')} AS ac_1, {r('sum(z * l5) / (sum(z * z) + 1e-12)')} AS ac_5 FROM l GROUP BY code""")
def _(spark, sf):
    """Autocorrelation of absolute volatility-standardised residuals: what clustering the filter leaves."""
    from ..operators.recursion import ewma, halflife_lambda

    d = gapless_returns(spark, sf)
    d = d.withColumn("d", F.col("lret") - F.avg("lret").over(Window.partitionBy("code")))
    d = ewma(d, ["code"], "pos", [("v", F.col("d") * F.col("d"), halflife_lambda(20.0))])
    d = d.withColumn("z", F.abs(F.col("d") / F.sqrt("v")))
    return stats.lag_autocorrelation(d, ["code"], "pos", "z", [1, 5]).select("code", r6("ac_1").alias("ac_1"), r6("ac_5").alias("ac_5"))


@query("rebalance_offset", f"""WITH {q.BOOKRET}, m AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, ln(1 + avg(cret)) AS x FROM br WHERE cret IS NOT NULL GROUP BY date),
 s AS (SELECT *, sum(x) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) AS f, count(*) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) AS n FROM m), o AS (SELECT unnest(range(21)) AS off)
 SELECT off AS "offset", count(*) AS n, {r('avg(f)')} AS mean_hold, {r('avg(f) / stddev_samp(f) * sqrt(12.0)')} AS sharpe FROM s JOIN o ON pos % 21 = off WHERE n = 21 GROUP BY off""")
def _(spark, sf):
    from ..operators.metrics import sharpe

    m = with_position(market(spark, sf).select("date", F.log1p("mret").alias("x"), F.lit("m").alias("book")), "book", "date")
    c = Clock("book", "pos")
    w = c.ahead(0, 20)
    m = m.withColumns({"f": F.sum("x").over(w), "n": F.count("x").over(w)}).where("n = 21")
    # every row belongs to exactly one offset, so all offsets are one grouping
    return m.groupBy((F.col("pos") % 21).cast("long").alias("offset")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("f")).alias("mean_hold"), r6(sharpe("f", 12)).alias("sharpe"))


@query("non_overlapping_sample", f"""WITH {GR} SELECT code, pos, {r('fwd')} AS fwd FROM (SELECT code, pos, sum(lret) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS fwd,
   count(*) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS n FROM gr) WHERE pos % 10 = 0 AND n = 10""")
def _(spark, sf):
    d = gapless_returns(spark, sf).withColumn("fwd", BAR.full_ahead(F.sum, "lret", 10))
    d = stats.every_nth(d, ["code"], "pos", 10).where("fwd IS NOT NULL")
    return d.select("code", F.col("pos").cast("long").alias("pos"), r6("fwd").alias("fwd"))


# ---- resampling ----------------------------------------------------------------------------------

@query("block_bootstrap", f"""WITH {q.RETS}, b AS (SELECT year(date) * 12 + month(date) - 1 AS blk, sum(lret) AS s, count(lret) AS n FROM rets WHERE lret IS NOT NULL GROUP BY 1),
 b2 AS (SELECT s, n, row_number() OVER (ORDER BY blk) - 1 AS idx FROM b), kk AS (SELECT count(*) AS k FROM b2),
 dr AS (SELECT rep, {h_sql('42', 'rep', 'draw')} % k AS idx FROM kk, (SELECT unnest(range(500)) AS rep), (SELECT unnest(range(200)) AS draw) WHERE draw < k),
 m AS (SELECT rep, sum(s) / sum(n) AS m FROM dr JOIN b2 USING (idx) GROUP BY rep)
 SELECT {r('(SELECT sum(s) / sum(n) FROM b)')} AS mean, {r('quantile_cont(m, 0.025)')} AS lo, {r('quantile_cont(m, 0.975)')} AS hi, {r('avg((m > 0)::INT)')} AS share_positive FROM m""")
def _(spark, sf):
    d = t.daily_returns(spark, sf).where("lret IS NOT NULL").withColumn("blk", month_index("date"))
    b = rs.block_bootstrap(spark, d, "blk", "lret", 500, 42, [0.025, 0.975])
    return b.select(r6("mean").alias("mean"), r6(F.col("q")[0]).alias("lo"), r6(F.col("q")[1]).alias("hi"), r6("share_positive").alias("share_positive"))


def mean_rule(part: str) -> str:
    return f"""CASE WHEN avg(x) OVER (PARTITION BY {part} ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) > 0 THEN x ELSE 0 END"""


REPLICAS = 200
HALF = 2.0 ** (-1 / 20.0)  # decay of the volatility that the residual surrogates keep


@query("permutation_null", f"""WITH {GR}, rp AS (SELECT rep, code, pos, lret FROM gr, (SELECT unnest(range({REPLICAS})) AS rep)),
 sl AS (SELECT *, row_number() OVER (PARTITION BY rep, code ORDER BY pos) AS slot, row_number() OVER (PARTITION BY rep, code ORDER BY {draw_sql(7, 'rep', 'code', 'pos')}, pos) AS pick FROM rp),
 pm AS (SELECT a.rep, a.code, a.pos, b.lret AS x FROM sl a JOIN sl b ON a.rep = b.rep AND a.code = b.code AND a.slot = b.pick),
 nl AS (SELECT rep, avg(s) AS stat FROM (SELECT rep, {mean_rule('rep, code')} AS s FROM pm) GROUP BY rep), ob AS (SELECT avg(s) AS obs FROM (SELECT {mean_rule('code')} AS s FROM (SELECT code, pos, lret AS x FROM gr)))
 SELECT rep, {r('stat')} AS stat, {r('obs')} AS observed, stat >= obs AS beats FROM nl, ob""")
def _(spark, sf):
    base = gapless_returns(spark, sf).select("code", "pos", "lret")
    null = permuted_sums(base, "code", "pos", "lret", follow_the_mean(5), ["s", "n"], REPLICAS, 7).select("rep", (F.col("s") / F.col("n")).alias("stat"))
    before = F.avg("lret").over(Window.partitionBy("code").orderBy("pos").rowsBetween(-5, -1))
    obs = base.select(F.when(before > 0, F.col("lret")).otherwise(0.0).alias("s")).agg(F.avg("s").alias("obs"))
    d = null.join(F.broadcast(obs))
    return d.select("rep", r6("stat").alias("stat"), r6("obs").alias("observed"), (F.col("stat") >= F.col("obs")).alias("beats"))


@query("label_permutation", f"""WITH {q.MSIG}, v AS (SELECT rep, code, mi, mom, fret FROM msig, (SELECT unnest(range({REPLICAS})) AS rep) WHERE mom IS NOT NULL AND fret IS NOT NULL),
 sl AS (SELECT *, row_number() OVER (PARTITION BY rep, mi ORDER BY code) AS slot, row_number() OVER (PARTITION BY rep, mi ORDER BY {draw_sql(11, 'rep', 'mi', 'code')}, code) AS pick FROM v),
 pm AS (SELECT a.rep, a.mom, b.fret FROM sl a JOIN sl b ON a.rep = b.rep AND a.mi = b.mi AND a.slot = b.pick), nl AS (SELECT rep, corr(mom, fret) AS c FROM pm GROUP BY rep), ob AS (SELECT corr(mom, fret) AS c FROM v WHERE rep = 0)
 SELECT {r('any_value(ob.c)')} AS observed, {r('avg(nl.c)')} AS null_mean, {r('stddev_pop(nl.c)')} AS null_sd, {r('(any_value(ob.c) - avg(nl.c)) / stddev_pop(nl.c)', 4)} AS z, {r('max(abs(nl.c))')} AS null_max FROM nl, ob""")
def _(spark, sf):
    v = monthly_signals(spark, sf).where("mom IS NOT NULL AND fret IS NOT NULL").select("code", "mi", "mom", "fret")
    sums = permuted_sums(v, "mi", "code", "fret", moments_with("mom"), ["n", "x", "xx", "y", "yy", "xy"], REPLICAS, 11, fixed=("mom",))
    null = sums.select("rep", correlation().alias("c"))
    d = null.agg(F.avg("c").alias("m"), F.stddev_pop("c").alias("s"), F.max(F.abs("c")).alias("mx")).join(F.broadcast(v.agg(F.corr("mom", "fret").alias("o"))))
    return d.select(r6("o").alias("observed"), r6("m").alias("null_mean"), r6("s").alias("null_sd"), r6((F.col("o") - F.col("m")) / F.col("s"), 4).alias("z"), r6("mx").alias("null_max"))


@query("signflip_null", f"""WITH {ORB}, rp AS (SELECT rep, gross / risk * CASE WHEN {h_sql('5', 'rep', 'code', 'session')} % 2 = 0 THEN 1 ELSE -1 END AS x FROM tr, (SELECT unnest(range(200)) AS rep)), n AS (SELECT rep, avg(x) AS m FROM rp GROUP BY rep)
 SELECT {r('(SELECT avg(gross / risk) FROM tr)')} AS observed, {r('avg(m)')} AS null_mean, {r('quantile_cont(m, 0.95)')} AS null_q95, {r('avg((m >= (SELECT avg(gross / risk) FROM tr))::INT)')} AS p_value FROM n""")
def _(spark, sf):
    tr = materialise(orb(spark, sf).select("code", "session", (F.col("gross") / F.col("risk")).alias("rr")))
    obs = tr.agg(F.avg("rr").alias("o"))
    d = rs.with_replicas(tr, 200).withColumn("x", F.col("rr") * rs.random_sign(5, F.col("rep"), F.col("code"), F.col("session")))
    n = d.groupBy("rep").agg(F.avg("x").alias("m")).join(F.broadcast(obs))
    out = n.agg(F.max("o").alias("o"), F.avg("m").alias("m"), F.percentile("m", F.lit(0.95)).alias("q"), F.avg((F.col("m") >= F.col("o")).cast("double")).alias("p"))
    return out.select(r6_any("o").alias("observed"), r6_any("m").alias("null_mean"), r6_any("q").alias("null_q95"), r6_any("p").alias("p_value"))


_rid = ("3", "rep", "code", "pos")
_unit = lambda part: f"(({h_sql(part, *_rid)} + 0.5) / 281474976710656.0)"
_x2 = f"CASE WHEN pos = 0 THEN warm * {HALF!r} + d * d * {1 - HALF!r} ELSE d * d END"
SURROGATES = GR + f""", rp AS (SELECT rep, code, pos, lret FROM gr, (SELECT unnest(range(2)) AS rep)),
 b AS (SELECT *, avg(lret) OVER k AS m, stddev_pop(lret) OVER k AS sd, lret - avg(lret) OVER k AS d FROM rp WINDOW k AS (PARTITION BY rep, code)),
 b2 AS (SELECT *, avg(CASE WHEN pos < 20 THEN d * d END) OVER (PARTITION BY rep, code) + 1e-8 AS warm, abs(d) * CASE WHEN {h_sql(*_rid)} % 2 = 0 THEN 1 ELSE -1 END AS f FROM b),
 b3 AS (SELECT *, {ewma_sql(_x2, HALF, part='rep, code')} AS v, row_number() OVER (PARTITION BY rep, code ORDER BY pos) AS slot, row_number() OVER (PARTITION BY rep, code ORDER BY {h_sql(*_rid)}, pos) AS pick FROM b2),
 su AS (SELECT 'shuffle' AS kind, x.rep, x.code, x.pos, y.lret AS sur FROM b3 x JOIN b3 y ON x.rep = y.rep AND x.code = y.code AND x.slot = y.pick
  UNION ALL SELECT 'signflip', rep, code, pos, m + f * (stddev_pop(d) OVER (PARTITION BY rep, code) / (stddev_pop(f) OVER (PARTITION BY rep, code) + 1e-12)) FROM b3
  UNION ALL SELECT 'normal', rep, code, pos, m + sd * sqrt(-2 * ln({_unit("'u'")})) * cos(2 * pi() * {_unit("'v'")}) FROM b3
  UNION ALL SELECT 'fhs', x.rep, x.code, x.pos, x.m + sqrt(x.v) * y.d / sqrt(y.v) FROM b3 x JOIN b3 y ON x.rep = y.rep AND x.code = y.code AND x.slot = y.pick),
 sz AS (SELECT *, abs(sur) - avg(abs(sur)) OVER (PARTITION BY kind, rep, code) AS z FROM su), sl1 AS (SELECT *, lag(z) OVER (PARTITION BY kind, rep, code ORDER BY pos) AS l1 FROM sz),
 sn AS (SELECT kind, rep, code, sum(z * l1) / (sum(z * z) + 1e-12) AS ac, stddev_pop(sur) AS sd FROM sl1 GROUP BY kind, rep, code)"""


@query("surrogate_series", f"WITH {SURROGATES} SELECT kind, rep, {r('avg(ac)')} AS abs_ac1, {r('avg(sd)')} AS sd FROM sn GROUP BY kind, rep")
def _(spark, sf):
    """Volatility clustering left in each kind of surrogate: mean lag-1 autocorrelation of absolute returns."""
    base = rs.with_replicas(gapless_returns(spark, sf).select("code", "pos", "lret"), 2)
    base = t.by_instrument(spark, sf, materialise(base))  # one shuffle, which all windows of all kinds share
    out = None
    for kind in ("shuffle", "signflip", "normal", "fhs"):
        s = rs.surrogates(base, ["code"], "pos", "lret", kind, 3).withColumn("a", F.abs("sur"))
        ac = stats.lag_autocorrelation(s, ["rep", "code"], "pos", "a", [1], {"sd": F.stddev_pop("sur")})
        one = ac.groupBy(F.lit(kind).alias("kind"), F.col("rep").cast("long").alias("rep")).agg(r6(F.avg("ac_1")).alias("abs_ac1"), r6(F.avg("sd")).alias("sd"))
        out = one if out is None else out.unionByName(one)
    return out


@query("signflip_surrogate", f"""WITH {GR}, d AS (SELECT code, pos, lret - avg(lret) OVER (PARTITION BY code) AS d, avg(lret) OVER (PARTITION BY code) AS m FROM gr), f AS (SELECT *, abs(d) * CASE WHEN {h_sql('3', '0', 'code', 'pos')} % 2 = 0 THEN 1 ELSE -1 END AS f FROM d)
 SELECT code, pos, {r('m + f * (stddev_pop(d) OVER (PARTITION BY code) / (stddev_pop(f) OVER (PARTITION BY code) + 1e-12))')} AS sur FROM f""")
def _(spark, sf):
    base = rs.with_replicas(gapless_returns(spark, sf).select("code", "pos", "lret"), 1)
    return rs.surrogates(base, ["code"], "pos", "lret", "signflip", 3).select("code", F.col("pos").cast("long").alias("pos"), r6("sur").alias("sur"))


@query("surrogate_path", f"""WITH {GR}, sl AS (SELECT code, pos, lret, row_number() OVER (PARTITION BY code ORDER BY pos) AS slot, row_number() OVER (PARTITION BY code ORDER BY {h_sql('9', '0', "code || '|' || pos")}, pos) AS pick FROM gr)
 SELECT a.code, a.pos, {r('sum(b.lret) OVER (PARTITION BY a.code ORDER BY a.pos)')} AS logp FROM sl a JOIN sl b ON a.code = b.code AND a.slot = b.pick""")
def _(spark, sf):
    base = rs.with_replicas(gapless_returns(spark, sf).select("code", "pos", "lret"), 1)
    s = rs.surrogates(base, ["code"], "pos", "lret", "shuffle", 9)
    return rs.rebuild_path(s, ["code"], "pos", "sur").select("code", F.col("pos").cast("long").alias("pos"), r6("logp").alias("logp"))
