"""Portfolio books, overlays and their metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import month_index, r6, year_of
from ..operators import align, book, clean, metrics, recursion, rolling, xsec
from ..operators.aggregate import with_grid
from ..operators.clock import Clock, with_calendar, with_position
from ..session import materialise
from ..sources import tables as t
from . import query
from . import sqltext as q
from .cross_section import COMPOSITE, composite_table, splits
from .panel import book_returns, market, monthly_signals
from .recursions import MACD, ewma_sql, macd_panel
from .sqltext import full, r

MON = Clock("code", "mi")
COST = 10.0


def turn_sql(w: str, step: str, keys: str = "", weight: str = "w") -> str:
    """Turnover per step as a full outer join of consecutive weight tables."""
    on = "".join(f" AND a.{k} = b.{k}" for k in keys.split(",") if k)
    ks = "".join(f"coalesce(a.{k}, b.{k}) AS {k}, " for k in keys.split(",") if k)
    return f"""(SELECT {ks}coalesce(a.{step}, b.{step} + 1) AS {step}, sum(abs(coalesce(a.{weight}, 0) - coalesce(b.{weight}, 0))) AS turnover,
      sum(greatest(coalesce(a.{weight}, 0) - coalesce(b.{weight}, 0), 0)) AS bought
      FROM {w} a FULL JOIN {w} b ON a.code = b.code AND a.{step} = b.{step} + 1{on} GROUP BY ALL)"""


LEGS = q.MSIG + """, v AS (SELECT * FROM msig WHERE mom IS NOT NULL AND fret IS NOT NULL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY mi ORDER BY mom DESC, code) AS up, row_number() OVER (PARTITION BY mi ORDER BY mom, code) AS dn,
   greatest(1, floor(count(*) OVER (PARTITION BY mi) * 0.2)) AS k FROM v),
 legs AS (SELECT code, mi, fret, k, CASE WHEN up <= k THEN 1 ELSE -1 END AS side, CASE WHEN up <= k THEN 1 ELSE -1 END / k AS w FROM rk WHERE up <= k OR dn <= k)"""
LS = LEGS + f""", tn AS (SELECT mi, sum(CASE WHEN side = 1 THEN turnover END) AS lt, sum(CASE WHEN side = -1 THEN turnover END) AS st FROM {turn_sql('legs', 'mi', 'side')} GROUP BY mi),
 u AS (SELECT mi, avg(fret) AS uni_ret, count(*) AS n_names FROM v GROUP BY mi),
 g AS (SELECT mi, avg(CASE WHEN side = 1 THEN fret END) AS long_ret, avg(CASE WHEN side = -1 THEN fret END) AS short_ret, max(k) AS k FROM legs GROUP BY mi),
 ls AS (SELECT *, long_ret - short_ret - (lt + st) * {COST} / 1e4 AS ls_net FROM g JOIN u USING (mi) JOIN tn USING (mi))"""


def momentum_book(spark, sf):
    n = splits(spark, sf)
    v = monthly_signals(spark, sf).where("mom IS NOT NULL AND fret IS NOT NULL").select("code", "mi", "mom", "fret")
    w = book.quintile_weights(v, "mi", "mom", 0.2, 1, "code", n)
    return book.long_short_book(w, v, "mi", "fret", COST)


@query("mom_long_short", f"""WITH {LS} SELECT mi, CAST(k AS BIGINT) AS k, n_names, {r('long_ret')} AS long_ret, {r('short_ret')} AS short_ret, {r('uni_ret')} AS uni_ret,
  {r('lt')} AS long_turnover, {r('st')} AS short_turnover, {r('ls_net')} AS ls_net FROM ls""")
def _(spark, sf):
    b = momentum_book(spark, sf)
    return b.select("mi", F.col("k").cast("long").alias("k"), "n_names", *[r6(c).alias(c) for c in ("long_ret", "short_ret", "uni_ret", "long_turnover", "short_turnover", "ls_net")])


def _timing(name, dense):
    den = "sum(long::INT) OVER (PARTITION BY cal)" if dense else "count(*) OVER (PARTITION BY cal)"
    sql = f"""WITH {MACD}, p AS (SELECT code, date, cret, long, dense_rank() OVER (ORDER BY date) AS cal FROM macd WHERE cret IS NOT NULL),
      w AS (SELECT *, coalesce(long::INT / nullif({den}, 0), 0) AS w FROM p),
      g AS (SELECT cal, min(date) AS date, sum(w * cret) AS gross, avg(cret) AS bnh, sum(long::INT)::BIGINT AS held FROM w GROUP BY cal)
     SELECT date, held, {r('gross - 0.001 * turnover')} AS strat, {r('bnh')} AS bnh, {r('turnover')} AS turnover FROM g JOIN {turn_sql('w', 'cal')} USING (cal)"""

    @query(name, sql)
    def _(spark, sf):
        d = macd_panel(spark, sf).where("cret IS NOT NULL").select("code", "date", "cret", "macd_long")
        days = t.trading_days(spark, sf)
        d = t.dealt(spark, sf, with_calendar(d, days), "cal")
        b = book.timing_book(d, "macd_long", "cret", "cal", 0.001, dense, splits(spark, sf))
        return b.join(days, "cal").select("date", "held", *[r6(c).alias(c) for c in ("strat", "bnh", "turnover")])


_timing("timing_book", False)
_timing("timing_book_concentrated", True)


@query("single_series_strategy", f"""WITH {MACD} SELECT code, date, {r('long::INT * coalesce(cret, 0) - 0.001 * abs(long::INT - coalesce(lag(long::INT) OVER (PARTITION BY code ORDER BY pos), 0))')} AS strat FROM macd""")
def _(spark, sf):
    s = book.single_strategy(F.col("macd_long").cast("int"), F.coalesce("cret", F.lit(0.0)), 0.001, ["code"], "pos")
    return macd_panel(spark, sf).select("code", "date", r6(s).alias("strat"))


TOP = COMPOSITE + """, el AS (SELECT * FROM comp WHERE score IS NOT NULL AND fret IS NOT NULL),
 rk2 AS (SELECT *, row_number() OVER (PARTITION BY mi ORDER BY score DESC, code) AS up, greatest(1, floor(count(*) OVER (PARTITION BY mi) * 0.2)) AS k FROM el),
 wts AS (SELECT code, mi, fret, 1.0 / k AS w FROM rk2 WHERE up <= k)"""


def composite_weights(spark, sf, frac=0.2):
    el = composite_table(spark, sf).where("score IS NOT NULL AND fret IS NOT NULL").select("code", "mi", "score", "fret", "turnover", "mret")
    el = materialise(el)  # one row per (name, month), read by weights, spreads and returns
    w = book.quintile_weights(el, "mi", "score", frac, 1, "code", splits(spark, sf)).where("leg = 1")
    return w, el


@query("tiered_cost_book", f"""WITH {TOP}, tb AS (SELECT mi, quantile_cont(turnover, 1.0/3) AS q1, quantile_cont(turnover, 2.0/3) AS q2 FROM el GROUP BY mi),
 sp AS (SELECT code, mi, CASE WHEN turnover >= q2 THEN 15.0 WHEN turnover >= q1 THEN 40.0 ELSE 80.0 END AS bps FROM el JOIN tb USING (mi)),
 md AS (SELECT mi, median(bps) AS med FROM sp GROUP BY mi),
 dw AS (SELECT coalesce(a.mi, b.mi + 1) AS mi, coalesce(a.code, b.code) AS code, abs(coalesce(a.w, 0) - coalesce(b.w, 0)) AS d FROM wts a FULL JOIN wts b ON a.code = b.code AND a.mi = b.mi + 1),
 ct AS (SELECT mi, sum(d * coalesce(bps, med) / 2 / 1e4) AS cost, sum(d) AS turnover FROM dw LEFT JOIN sp USING (mi, code) JOIN md USING (mi) GROUP BY mi),
 g AS (SELECT mi, avg(fret) AS gross FROM wts GROUP BY mi)
 SELECT mi, {r('gross')} AS gross, {r('cost', 8)} AS cost, {r('turnover')} AS turnover, {r('gross - cost')} AS net FROM g JOIN ct USING (mi)""")
def _(spark, sf):
    w, el = composite_weights(spark, sf)
    sp = xsec.cost_tier(el, "mi", "turnover", splits=splits(spark, sf)).select("code", "mi", "spread_bps")
    c = book.tiered_cost(w, sp, [], "mi")
    g = w.groupBy("mi").agg(F.avg("fret").alias("gross")).join(c, "mi")
    return g.select("mi", r6("gross").alias("gross"), r6("cost", 8).alias("cost"), r6("turnover").alias("turnover"), r6(F.col("gross") - F.col("cost")).alias("net"))


@query("stamp_duty_book", f"""WITH {TOP}, g AS (SELECT mi, avg(fret) AS gross FROM wts GROUP BY mi)
 SELECT mi, {r('bought')} AS bought, {r('gross - bought * 0.005')} AS net FROM g JOIN {turn_sql('wts', 'mi')} USING (mi)""")
def _(spark, sf):
    w, _ = composite_weights(spark, sf)
    b = align.turnover(w, [], step="mi").join(w.groupBy("mi").agg(F.avg("fret").alias("gross")), "mi")
    return b.select("mi", r6("bought").alias("bought"), r6(F.col("gross") - F.col("bought") * 0.005).alias("net"))


@query("breadth_sweep", f"""WITH {COMPOSITE}, el AS (SELECT * FROM comp WHERE score IS NOT NULL AND fret IS NOT NULL), fr AS (SELECT unnest([0.05, 0.1, 0.2, 0.3]) AS frac),
 rk2 AS (SELECT el.*, frac, row_number() OVER (PARTITION BY frac, mi ORDER BY score DESC, code) AS up, greatest(1, floor(count(*) OVER (PARTITION BY frac, mi) * frac)) AS k FROM el, fr),
 b AS (SELECT frac, mi, avg(fret) AS x FROM rk2 WHERE up <= k GROUP BY frac, mi)
 SELECT CAST(frac AS DOUBLE) AS frac, count(*) AS n, {r('avg(x)')} AS mean_ret, {r('avg(x) / stddev_samp(x) * sqrt(12.0)')} AS sharpe FROM b GROUP BY frac""")
def _(spark, sf):
    _, el = composite_weights(spark, sf)
    # ranks do not depend on the breadth, so rank once and attach the grid to the ranked rows
    n = splits(spark, sf)
    d = xsec.with_row_number(el, "mi", "score", "code", "up", True, n)
    d = with_grid(xsec.with_stats(d, "mi", {"nn": F.count(F.lit(1))}, n), frac=[0.05, 0.1, 0.2, 0.3])
    d = d.where(F.col("up") <= F.greatest(F.lit(1), F.floor(F.col("nn") * F.col("frac"))))
    b = d.groupBy("frac", "mi").agg(F.avg("fret").alias("x"))
    return b.groupBy("frac").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x")).alias("mean_ret"), r6(metrics.sharpe("x", 12)).alias("sharpe"))


@query("kmonth_rebalance", f"""WITH {q.MSIG}, v AS (SELECT *, min(mi) FILTER (WHERE mom IS NOT NULL) OVER () AS m0 FROM msig),
 rk AS (SELECT code, mi, row_number() OVER (PARTITION BY mi ORDER BY mom DESC, code) AS up, greatest(1, floor(count(*) OVER (PARTITION BY mi) * 0.2)) AS k FROM v WHERE mom IS NOT NULL AND (mi - m0) % 3 = 0),
 w AS (SELECT code, mi AS reb, 1.0 / k AS w FROM rk WHERE up <= k),
 x AS (SELECT v.mi, v.fret, w.w FROM v JOIN w ON v.code = w.code AND v.mi BETWEEN w.reb AND w.reb + 2 WHERE fret IS NOT NULL)
 SELECT mi, count(*) AS n, {r('sum(w * fret) / sum(w)')} AS ret FROM x GROUP BY mi""")
def _(spark, sf):
    d = monthly_signals(spark, sf)
    # first signal month: one value from the whole book, attached as a one-row broadcast
    m0 = d.where("mom IS NOT NULL").agg(F.min("mi").alias("m0"))
    d = d.join(F.broadcast(m0))
    sel = d.where((F.col("mom").isNotNull()) & ((F.col("mi") - F.col("m0")) % 3 == 0)).select("code", "mi", "mom")
    w = book.quintile_weights(sel, "mi", "mom", 0.2, 1, "code", splits(spark, sf)).where("leg = 1")
    hold = w.select("code", "w", F.explode(F.sequence(F.col("mi"), F.col("mi") + 2)).alias("mi"))
    x = hold.join(d.where("fret IS NOT NULL").select("code", "mi", "fret"), ["code", "mi"])
    return x.groupBy("mi").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("w") * F.col("fret")) / F.sum("w")).alias("ret"))


SIGV = q.MSIG + f""", sv0 AS (SELECT *, {full('stddev_samp(mret)', 'mret', 12)} AS vol FROM msig WINDOW k AS (PARTITION BY code ORDER BY mi)),
 sv AS (SELECT * FROM sv0 WHERE mom IS NOT NULL AND fret IS NOT NULL AND vol > 0)"""


def signal_vol(spark, sf):
    d = monthly_signals(spark, sf)
    return d.withColumn("vol", MON.full(F.stddev_samp, "mret", 12)).where("mom IS NOT NULL AND fret IS NOT NULL AND vol > 0").select("code", "mi", "mom", "fret", "vol", "mret")


@query("inverse_vol_book", f"""WITH {q.MSIG}, s0 AS (SELECT *, {full('stddev_samp(mret)', 'mret', 18)} AS vol FROM msig WINDOW k AS (PARTITION BY code ORDER BY mi)),
 v AS (SELECT *, row_number() OVER (PARTITION BY mi ORDER BY mom DESC, code) AS up, greatest(1, floor(count(*) OVER (PARTITION BY mi) * 0.2)) AS k FROM s0 WHERE mom IS NOT NULL AND fret IS NOT NULL),
 t AS (SELECT *, 1.0 / coalesce(CASE WHEN vol > 0 THEN vol END, median(CASE WHEN vol > 0 THEN vol END) OVER (PARTITION BY mi)) AS iv FROM v WHERE up <= k)
 SELECT code, mi, {r('iv / sum(iv) OVER (PARTITION BY mi)')} AS w FROM t WHERE iv IS NOT NULL""")
def _(spark, sf):
    n = splits(spark, sf)
    d = monthly_signals(spark, sf).withColumn("vol", MON.full(F.stddev_samp, "mret", 18)).where("mom IS NOT NULL AND fret IS NOT NULL")
    top = book.quintile_weights(d, "mi", "mom", 0.2, 1, "code", n).where("leg = 1").drop("w")
    return book.inverse_vol(top, ["mi"], "vol", n).where("w IS NOT NULL").select("code", "mi", r6("w").alias("w"))


@query("tail_ls_book", f"""WITH {SIGV}, rk AS (SELECT *, row_number() OVER (PARTITION BY mi ORDER BY mom DESC, code) AS up, row_number() OVER (PARTITION BY mi ORDER BY mom, code) AS dn,
   greatest(1, floor(count(*) OVER (PARTITION BY mi) * 0.2)) AS k, count(*) OVER (PARTITION BY mi) AS n FROM sv),
 l AS (SELECT *, CASE WHEN up <= k THEN 1 ELSE -1 END AS leg FROM rk WHERE (up <= k OR dn <= k) AND n >= 5),
 w AS (SELECT code, mi, fret, leg * (1 / vol) / sum(1 / vol) OVER (PARTITION BY mi, leg) AS w FROM l)
 SELECT mi, {r('sum(w * fret)')} AS ret, {r('sum(abs(w))')} AS gross, count(*) AS n FROM w GROUP BY mi""")
def _(spark, sf):
    w = book.tail_inverse_vol(signal_vol(spark, sf), "mi", "mom", "vol", 0.2, 5, splits(spark, sf))
    return w.groupBy("mi").agg(r6(F.sum(F.col("w") * F.col("fret"))).alias("ret"), r6(F.sum(F.abs("w"))).alias("gross"), F.count(F.lit(1)).alias("n"))


@query("gated_neutral_book", f"""WITH {SIGV}, z AS (SELECT *, (mom - avg(mom) OVER (PARTITION BY mi)) / stddev_samp(mom) OVER (PARTITION BY mi) AS z FROM sv),
 g AS (SELECT *, z / vol - avg(z / vol) OVER (PARTITION BY mi) AS d, count(*) OVER (PARTITION BY mi) AS n FROM z WHERE abs(z) >= 0.3),
 w AS (SELECT code, mi, fret, d / sum(abs(d)) OVER (PARTITION BY mi) AS w FROM g WHERE n >= 5),
 b AS (SELECT mi, sum(w * fret) AS gross FROM w GROUP BY mi)
 SELECT mi, {r('gross')} AS gross, {r('turnover')} AS turnover, {r('gross - 0.001 * turnover')} AS net FROM b JOIN {turn_sql('w', 'mi')} USING (mi)""")
def _(spark, sf):
    n = splits(spark, sf)
    z = xsec.zscore(signal_vol(spark, sf), "mi", "mom", "z", n)
    w = book.gated_neutral(z, "mi", "z", "vol", 0.3, 5, n).select("code", "mi", "w", "fret")
    b = w.groupBy("mi").agg(F.sum(F.col("w") * F.col("fret")).alias("gross")).join(align.turnover(w, [], step="mi"), "mi")
    return b.select("mi", r6("gross").alias("gross"), r6("turnover").alias("turnover"), r6(F.col("gross") - F.col("turnover") * 0.001).alias("net"))


@query("buffered_book", f"""WITH RECURSIVE {SIGV}, rk AS (SELECT *, row_number() OVER (PARTITION BY mi ORDER BY mom, code) AS rn, count(*) OVER (PARTITION BY mi) AS n, row_number() OVER (PARTITION BY code ORDER BY mi) AS i,
    lag(mi) OVER (PARTITION BY code ORDER BY mi) AS pm FROM sv),
 h AS (SELECT code, mi, i, rn > n * 0.8 AS held FROM rk WHERE i = 1 UNION ALL
  SELECT rk.code, rk.mi, rk.i, CASE WHEN h.held AND rk.pm = rk.mi - 1 THEN rk.rn > rk.n * 0.65 ELSE rk.rn > rk.n * 0.8 END FROM h JOIN rk ON rk.code = h.code AND rk.i = h.i + 1)
 SELECT mi, count(*) FILTER (WHERE held) AS n_held FROM h GROUP BY mi""")
def _(spark, sf):
    n = splits(spark, sf)
    d = xsec.with_row_number(signal_vol(spark, sf), "mi", "mom", "code", "rn", splits=n)
    d = xsec.with_stats(d, "mi", {"n": F.count(F.lit(1))}, n)
    w = Window.partitionBy("code").orderBy("mi")
    gap = F.coalesce((F.lag("mi").over(w) != F.col("mi") - 1).cast("int"), F.lit(1))
    d = d.withColumns({"e": F.col("rn") > F.col("n") * 0.8, "x": F.col("rn") > F.col("n") * 0.65, "gap": gap})
    d = d.withColumn("seg", F.sum("gap").over(w))  # a month outside the cross-section drops the name
    d = recursion.hysteresis(d, ["code", "seg"], "mi", "e", "x")
    return d.groupBy("mi").agg(F.count_if("held").alias("n_held"))


@query("blended_book")
def _(spark, sf):
    """Quarterly inverse-vol tail targets on an EWM-smoothed signal, approached by half and renormalised each time."""
    n = splits(spark, sf)
    d = with_position(signal_vol(spark, sf), "code", "mi")
    d = recursion.ewma(d, ["code"], "pos", [("sm", F.col("mom"), recursion.halflife_lambda(2.0))], adjust=True)
    d = d.where(F.col("mi") % 3 == 0).withColumn("step", (F.col("mi") / 3).cast("long"))
    tgt = book.tail_inverse_vol(d, "step", "sm", "vol", 0.2, 5, n).withColumn("w", F.col("w") / 2)
    w = book.blended_book(tgt.select("code", "step", "w"), 0.5)
    x = w.join(d.select("code", "step", "fret"), ["code", "step"], "left")
    out = align.turnover(x, [], step="step", sums={"gross": F.abs(F.col("w")), "ret": F.col("w") * F.coalesce("fret", F.lit(0.0))})
    return out.select("step", r6("gross").alias("gross"), r6("turnover").alias("turnover"), r6("ret").alias("ret"))


@query("rank_weight_rotation", f"""WITH {q.MSIG}, f AS (SELECT *, {full('sum(ln(close / p1))', 'p1', 12)} AS trail FROM msig WINDOW k AS (PARTITION BY code ORDER BY mi)),
 m0 AS (SELECT min(mi) AS m0 FROM f WHERE trail IS NOT NULL),
 s AS (SELECT code, mi, count(*) OVER (PARTITION BY mi) - row_number() OVER (PARTITION BY mi ORDER BY trail, code) AS wc, row_number() OVER (PARTITION BY mi ORDER BY trail, code) AS wm FROM f, m0 WHERE trail IS NOT NULL AND (mi - m0.m0) % 12 = 0),
 w AS (SELECT code, mi AS reb, wc / sum(wc) OVER (PARTITION BY mi) AS wc, wm / sum(wm) OVER (PARTITION BY mi) AS wm FROM s)
 SELECT f.mi, {r('sum(wc * fret)')} AS contrarian, {r('sum(wm * fret)')} AS momentum FROM f JOIN w ON f.code = w.code AND f.mi BETWEEN w.reb AND w.reb + 11 WHERE fret IS NOT NULL GROUP BY f.mi""")
def _(spark, sf):
    n = splits(spark, sf)
    f = monthly_signals(spark, sf).withColumn("trail", MON.full(F.sum, F.log(F.col("close") / MON.at("close", -1)), 12))
    f = f.join(F.broadcast(f.where("trail IS NOT NULL").agg(F.min("mi").alias("m0"))))
    s = f.where(F.col("trail").isNotNull() & ((F.col("mi") - F.col("m0")) % 12 == 0)).select("code", "mi", "trail")
    s = xsec.with_stats(xsec.with_row_number(s, "mi", "trail", "code", "rn", splits=n), "mi", {"n": F.count(F.lit(1))}, n)
    s = s.withColumns({"wc": (F.col("n") - F.col("rn")) / (F.col("n") * (F.col("n") - 1) / 2), "wm": F.col("rn") / (F.col("n") * (F.col("n") + 1) / 2)})
    hold = s.select("code", "wc", "wm", F.explode(F.sequence(F.col("mi"), F.col("mi") + 11)).alias("mi"))
    x = hold.join(f.where("fret IS NOT NULL").select("code", "mi", "fret"), ["code", "mi"])
    return x.groupBy("mi").agg(r6(F.sum(F.col("wc") * F.col("fret"))).alias("contrarian"), r6(F.sum(F.col("wm") * F.col("fret"))).alias("momentum"))


@query("rotation_pick_n", f"""WITH {q.MSIG}, f AS (SELECT *, {full('sum(ln(close / p1))', 'p1', 12)} AS trail FROM msig WINDOW k AS (PARTITION BY code ORDER BY mi)),
 m0 AS (SELECT min(mi) AS m0 FROM f WHERE trail IS NOT NULL),
 w AS (SELECT code, mi AS reb, 0.25 AS w FROM f, m0 WHERE trail IS NOT NULL AND (mi - m0.m0) % 12 = 0 QUALIFY row_number() OVER (PARTITION BY mi ORDER BY trail DESC, code) <= 4),
 st AS (SELECT code, (reb - min(reb) OVER ()) // 12 AS st, reb, w FROM w), tn AS (SELECT st, turnover FROM {turn_sql('st', 'st')}),
 b AS (SELECT f.mi, min(st) AS st, min(reb) AS reb, sum(w * fret) AS g FROM f JOIN st ON f.code = st.code AND f.mi BETWEEN st.reb AND st.reb + 11 WHERE fret IS NOT NULL GROUP BY f.mi)
 SELECT mi, {r('g - CASE WHEN mi = reb THEN 0.002 * turnover ELSE 0 END')} AS ret FROM b JOIN tn USING (st)""")
def _(spark, sf):
    f = monthly_signals(spark, sf).withColumn("trail", MON.full(F.sum, F.log(F.col("close") / MON.at("close", -1)), 12))
    f = f.join(F.broadcast(f.where("trail IS NOT NULL").agg(F.min("mi").alias("m0"))))
    s = f.where(F.col("trail").isNotNull() & ((F.col("mi") - F.col("m0")) % 12 == 0)).select("code", "mi", "m0", "trail")
    s = xsec.with_row_number(s, "mi", "trail", "code", "rn", True, splits(spark, sf)).where("rn <= 4")
    s = s.select("code", F.col("mi").alias("reb"), ((F.col("mi") - F.col("m0")) / 12).cast("long").alias("st"), F.lit(0.25).alias("w"))
    tn = align.turnover(s, [], step="st").select("st", "turnover")
    hold = s.select("code", "w", "st", "reb", F.explode(F.sequence(F.col("reb"), F.col("reb") + 11)).alias("mi"))
    x = hold.join(f.where("fret IS NOT NULL").select("code", "mi", "fret"), ["code", "mi"])
    b = x.groupBy("mi").agg(F.min("st").alias("st"), F.min("reb").alias("reb"), F.sum(F.col("w") * F.col("fret")).alias("g")).join(tn, "st")
    return b.select("mi", r6(F.col("g") - F.when(F.col("mi") == F.col("reb"), F.col("turnover") * 0.002).otherwise(0.0)).alias("ret"))


@query("carry_book", f"""WITH {q.MSIG}, c AS (SELECT *, max(turnover / volume / 1000) OVER (k {q.frame(-1, -1)}) AS diff FROM msig WINDOW k AS (PARTITION BY code ORDER BY mi)),
 rk AS (SELECT *, mret + diff / 12 AS total, row_number() OVER (PARTITION BY mi ORDER BY diff DESC, code) AS up, row_number() OVER (PARTITION BY mi ORDER BY diff, code) AS dn FROM c WHERE diff IS NOT NULL AND mret IS NOT NULL)
 SELECT mi, {r('avg(CASE WHEN up <= 4 THEN total END) - avg(CASE WHEN dn <= 4 THEN total END)')} AS ret FROM rk GROUP BY mi""")
def _(spark, sf):
    n = splits(spark, sf)
    d = monthly_signals(spark, sf).withColumn("yld", F.col("turnover") / F.col("volume") / 1000)
    d = d.withColumn("diff", MON.at("yld", -1)).where("diff IS NOT NULL AND mret IS NOT NULL").select("code", "mi", "diff", (F.col("mret") + F.col("diff") / 12).alias("total"))
    d = xsec.with_row_number(d, "mi", "diff", "code", "up", True, n)
    d = xsec.with_row_number(d, "mi", "diff", "code", "dn", False, n)
    return d.groupBy("mi").agg(r6(F.avg(F.when(F.col("up") <= 4, F.col("total"))) - F.avg(F.when(F.col("dn") <= 4, F.col("total")))).alias("ret"))


@query("vol_target_overlay", f"""WITH {LS}, s AS (SELECT mi, ls_net, coalesce(least(0.1 / (CASE WHEN count(ls_net) OVER p = 12 THEN stddev_samp(ls_net) OVER p END * sqrt(12.0)), 1.5), 1.0) AS sc FROM ls
   WINDOW p AS (ORDER BY mi ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
 SELECT mi, {r('sc')} AS scale, {r('sc * ls_net - 0.001 * abs(sc - coalesce(lag(sc) OVER (ORDER BY mi), sc))')} AS overlay FROM s""")
def _(spark, sf):
    b = book.vol_target(momentum_book(spark, sf), "ls_net", "mi", 0.1, 1.5, 12, 12, 0.001)
    return b.select("mi", r6("scale").alias("scale"), r6("overlay").alias("overlay"))


EWO = q.BOOKRET + f""", m AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, avg(cret) AS x FROM br WHERE cret IS NOT NULL GROUP BY date),
 sx AS (SELECT *, 'm' AS code, CASE WHEN pos = 59 THEN var_pop(CASE WHEN pos < 60 THEN x END) OVER () ELSE power(lag(x) OVER (ORDER BY pos), 2) END AS u FROM m),
 ev AS (SELECT date, pos, x, least(0.15 / (sqrt({ewma_sql('u', 0.94, pos='(pos - 59)')}) * sqrt(252.0)), 2.0) AS sc FROM sx WHERE pos >= 59)"""


@query("ewma_vol_target", f"WITH {EWO} SELECT date, {r('sc')} AS scale, {r('sc * x - 0.001 * abs(sc - coalesce(lag(sc) OVER (ORDER BY pos), sc))')} AS overlay FROM ev")
def _(spark, sf):
    m = with_position(market(spark, sf).withColumn("book", F.lit("m")), "book", "date")
    v = recursion.ewma_variance(m, "book", "pos", "mret", 0.94, 60, out="v").where("pos >= 59")
    v = v.withColumn("scale", F.least(F.lit(0.15) / (F.sqrt("v") * 252**0.5), F.lit(2.0)))
    return book.resize(v, "mret", "scale", "pos", 0.001, ["book"]).select("date", r6("scale").alias("scale"), r6("overlay").alias("overlay"))


@query("core_plus_sleeve", f"""WITH {LS}, c AS (SELECT mi, uni_ret AS core, ls_net AS sleeve FROM ls)
 SELECT 'core' AS stage, {r('avg(core) * 12')} AS ann, {r('avg(core) / stddev_pop(core) * sqrt(12.0)')} AS sharpe FROM c UNION ALL
 SELECT 'combined', {r('avg(core + 0.5 * sleeve) * 12')}, {r('avg(core + 0.5 * sleeve) / stddev_pop(core + 0.5 * sleeve) * sqrt(12.0)')} FROM c""")
def _(spark, sf):
    b = momentum_book(spark, sf).select("mi", F.array(
        F.struct(F.lit("core").alias("stage"), F.col("uni_ret").alias("x")),
        F.struct(F.lit("combined").alias("stage"), (F.col("uni_ret") + F.col("ls_net") * 0.5).alias("x"))).alias("s"))
    b = b.select("mi", F.explode("s").alias("s")).select("mi", "s.*")
    return b.groupBy("stage").agg(r6(F.avg("x") * 12).alias("ann"), r6(metrics.sharpe("x", 12, 0)).alias("sharpe"))


VIX = """vx AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS pos, v, v3 FROM (SELECT CAST(ts AS DATE) AS d, avg(CASE WHEN event_type IN ('click', 'view') THEN value END) AS v,
   avg(CASE WHEN event_type NOT IN ('click', 'view') THEN value END) AS v3 FROM events GROUP BY 1)),
 sv AS (SELECT *, lag(v) OVER k AS vl, lag(v3) OVER k AS v3l, CASE WHEN pos > 0 THEN greatest(lag(ln(v3 / v) / 63) OVER k - ln(v / lag(v) OVER k), -0.95) END AS sr,
   median(v) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS med FROM vx WINDOW k AS (ORDER BY pos))"""


def vol_curve(spark, sf):
    """Daily short- and longer-dated level proxies from the event stream: one row per date."""
    e = t.table(spark, sf, "events")
    near = F.col("event_type").isin("click", "view")
    d = e.groupBy(F.to_date("ts").alias("d")).agg(F.avg(F.when(near, F.col("value"))).alias("v"), F.avg(F.when(~near, F.col("value"))).alias("v3"))
    w = Window.orderBy("d")
    carry = F.lag(F.log(F.col("v3") / F.col("v")) / 63).over(w)
    return d.withColumns({
        "sr": book.short_vol_return(carry, F.log(F.col("v") / F.lag("v").over(w))), "vl": F.lag("v").over(w), "v3l": F.lag("v3").over(w),
        "med": F.percentile("v", F.lit(0.5)).over(w.rowsBetween(Window.unboundedPreceding, -1)),
    })


@query("short_vol_gates", f"WITH {VIX} SELECT d, {r('sr')} AS sr, coalesce(vl < med, false) AS low_gate, coalesce(v3l > vl, false) AS contango_gate, {r('CASE WHEN v3l > vl AND vl < med THEN sr ELSE 0 END')} AS combined FROM sv")
def _(spark, sf):
    d = vol_curve(spark, sf)
    low, con = F.coalesce(F.col("vl") < F.col("med"), F.lit(False)), F.coalesce(F.col("v3l") > F.col("vl"), F.lit(False))
    return d.select("d", r6("sr").alias("sr"), low.alias("low_gate"), con.alias("contango_gate"), r6(F.when(low & con, F.col("sr")).otherwise(0.0)).alias("combined"))


@query("variance_swap_pnl", f"WITH {VIX} SELECT d, {r('(v * v - v3 * v3) / (2 * v)')} AS pnl, {r('v - v3')} AS premium FROM sv")
def _(spark, sf):
    return vol_curve(spark, sf).select("d", r6(book.variance_swap_pnl(F.col("v"), F.col("v3"))).alias("pnl"), r6(F.col("v") - F.col("v3")).alias("premium"))


@query("execution_abc", f"""WITH {MACD}, x AS (SELECT date, long::INT AS p, coalesce(lag(long::INT) OVER k, 0) AS pl, cret, ln(open / prev) AS onr, ln(close / open) AS idr, lret FROM macd WINDOW k AS (PARTITION BY code ORDER BY pos))
 SELECT date, {r('avg(p * lret)')} AS same_close, {r('avg(pl * lret)')} AS next_close, {r('avg(pl * onr + p * idr)')} AS next_open FROM x WHERE lret IS NOT NULL GROUP BY date""")
def _(spark, sf):
    c = Clock("code", "pos")
    on, idr = rolling.overnight_intraday(c)
    d = macd_panel(spark, sf).withColumns({"p": F.col("macd_long").cast("int"), "onr": on, "idr": idr})
    d = d.withColumn("pl", F.lag("p", 1, 0).over(c.ordered)).where("lret IS NOT NULL")
    return d.groupBy("date").agg(r6(F.avg(F.col("p") * F.col("lret"))).alias("same_close"), r6(F.avg(F.col("pl") * F.col("lret"))).alias("next_close"),
                                 r6(F.avg(F.col("pl") * F.col("onr") + F.col("p") * F.col("idr"))).alias("next_open"))


@query("limit_fill_study", f"""WITH {q.RETS}, x AS (SELECT code, date, close, lead(low) OVER k AS l1, ln(lead(close, 10) OVER k / close) AS fwd, lret FROM rets WINDOW k AS (PARTITION BY code ORDER BY pos))
 SELECT year(date) AS yr, count(*) AS n, {r('avg((l1 <= close)::INT)')} AS fill_rate, {r('avg(CASE WHEN l1 <= close THEN fwd END)')} AS filled_fwd, {r('avg(CASE WHEN l1 > close THEN fwd END)')} AS skipped_fwd,
  {r('sum(CASE WHEN l1 <= close THEN exp(fwd) - 1 ELSE 0 END) / count(*)')} AS cash_ret FROM x WHERE lret < -0.5 AND fwd IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    c = Clock("code", "pos")
    d = t.daily_returns(spark, sf).withColumns({"l1": c.at("low", 1), "fwd": F.log(c.at("close", 10) / F.col("close"))}).where("lret < -0.5 AND fwd IS NOT NULL")
    fill = F.col("l1") <= F.col("close")
    return d.groupBy(year_of("date").alias("yr")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(fill.cast("double"))).alias("fill_rate"), r6(F.avg(F.when(fill, F.col("fwd")))).alias("filled_fwd"),
        r6(F.avg(F.when(~fill, F.col("fwd")))).alias("skipped_fwd"), r6(F.sum(F.when(fill, F.expm1("fwd")).otherwise(0.0)) / F.count(F.lit(1))).alias("cash_ret"))


QUAL = q.BOOKRET + f""", qs AS (SELECT code, date, cret, coalesce({full('avg(lret)', 'lret', 20)} > 0.02, false) AS qual, dense_rank() OVER (ORDER BY date) - 1 AS cal FROM br WINDOW k AS (PARTITION BY code ORDER BY pos)),
 mh AS (SELECT a.*, coalesce(b.qual, false)::INT AS h FROM qs a LEFT JOIN qs b ON a.code = b.code AND a.cal = b.cal + 1),
 hw AS (SELECT code, cal, 1.0 AS w FROM mh WHERE h = 1)"""


def qualified(spark, sf):
    d = book_returns(spark, sf)
    d = d.withColumn("qual", F.coalesce(Clock("code", "pos").full(F.avg, "lret", 20) > 0.02, F.lit(False)))
    return with_calendar(d.select("code", "date", "cret", "qual"), t.trading_days(spark, sf))


@query("membership_book", f"""WITH {QUAL}, g AS (SELECT cal, sum(h)::BIGINT AS n_held, sum(h * coalesce(cret, 0)) / nullif(sum(h), 0) AS gross FROM mh GROUP BY cal)
 SELECT cal, n_held, {r('coalesce(gross, 0) - coalesce(coalesce(turnover, 0) * 0.001 / nullif(n_held, 0), 0)')} AS net, {r('coalesce(turnover, 0)')} AS changes
 FROM g LEFT JOIN (SELECT * FROM {turn_sql('hw', 'cal')} WHERE cal IN (SELECT cal FROM hw)) USING (cal)""")
def _(spark, sf):
    b = book.membership_book(qualified(spark, sf), "qual", "cret", 0.001)
    return b.select(F.col("cal").cast("long").alias("cal"), "n_held", r6("net").alias("net"), r6("changes").alias("changes"))


@query("contribution_leave_out", f"""WITH {QUAL}, nn AS (SELECT cal, sum(h) AS n FROM mh GROUP BY cal), ct AS (SELECT code, sum(cret * h / n) AS contrib FROM mh JOIN nn USING (cal) WHERE n > 0 GROUP BY code),
 tp AS (SELECT code FROM ct ORDER BY contrib DESC, code LIMIT 3), n2 AS (SELECT cal, sum(h) AS n FROM mh WHERE code NOT IN (SELECT code FROM tp) GROUP BY cal)
 SELECT 'all' AS book, {r('sum(contrib)')} AS total FROM ct UNION ALL SELECT 'without_top3', {r('sum(cret * h / n)')} FROM mh JOIN n2 USING (cal) WHERE n > 0 AND code NOT IN (SELECT code FROM tp)""")
def _(spark, sf):
    d = qualified(spark, sf).withColumn("h", F.coalesce(Clock("code", "cal").at(F.col("qual").cast("int"), -1), F.lit(0))).where("h = 1 AND cret IS NOT NULL")
    n = splits(spark, sf)

    def contrib(x):
        return xsec.with_stats(x, "cal", {"n": F.count(F.lit(1))}, n).withColumn("c", F.col("cret") / F.col("n"))

    allc = contrib(d)
    top = allc.groupBy("code").agg(F.sum("c").alias("s")).orderBy(F.col("s").desc(), "code").limit(3).select("code")
    rest = contrib(d.join(top, "code", "left_anti"))
    return allc.agg(r6(F.sum("c")).alias("total")).select(F.lit("all").alias("book"), "total").unionByName(
        rest.agg(r6(F.sum("c")).alias("total")).select(F.lit("without_top3").alias("book"), "total"))


@query("monthly_formed_daily", f"""WITH {q.BOOKRET}, s AS (SELECT code, year(date) * 12 + month(date) - 1 AS mi, arg_max(lret, date) AS sig FROM br WHERE lret IS NOT NULL GROUP BY 1, 2),
 pk AS (SELECT code, mi + 1 AS mi FROM (SELECT *, row_number() OVER (PARTITION BY mi ORDER BY sig DESC, code) AS rn, greatest(1, floor(count(*) OVER (PARTITION BY mi) * 0.2)) AS k FROM s) WHERE rn <= k)
 SELECT date, count(*) AS n, {r('avg(cret)')} AS ret FROM br JOIN pk ON br.code = pk.code AND year(date) * 12 + month(date) - 1 = pk.mi WHERE cret IS NOT NULL GROUP BY date""")
def _(spark, sf):
    d = book_returns(spark, sf).where("cret IS NOT NULL").withColumn("mi", month_index("date"))
    s = d.groupBy("code", "mi").agg(F.max_by("lret", "date").alias("sig"))
    pick = xsec.tail_flags(s, "mi", "sig", "code", 0.2, 1, splits(spark, sf)).where("leg = 1").select("code", (F.col("mi") + 1).alias("mi"))
    return d.join(pick, ["code", "mi"]).groupBy("date").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("cret")).alias("ret"))


@query("ledger", f"""WITH {LS} SELECT mi, {r('uni_ret')} AS ret, {r('sum(ln(1 + uni_ret)) OVER (ORDER BY mi)')} AS log_value,
  {r('100 * (exp(uni_ret) - 1)')} AS pnl_per_100 FROM ls""")
def _(spark, sf):
    b = momentum_book(spark, sf)
    w = book.book_window(None, "mi")
    return b.select("mi", r6("uni_ret").alias("ret"), r6(F.sum(F.log1p("uni_ret")).over(w)).alias("log_value"), r6(F.expm1("uni_ret") * 100).alias("pnl_per_100"))


@query("contribution_value", f"""WITH {LS}, p AS (SELECT mi, uni_ret - 0.12 AS x, sum(ln(1 + uni_ret - 0.12)) OVER (ORDER BY mi) AS lp FROM ls),
 uu AS (SELECT mi, lp, 100.0 * exp(-(lp - ln(1 + x))) AS u FROM p) SELECT mi, {r('exp(lp) * sum(u) OVER (ORDER BY mi)', 3)} AS value FROM uu""")
def _(spark, sf):
    b = momentum_book(spark, sf).select("mi", (F.col("uni_ret") - 0.12).alias("x"), F.lit(100.0).alias("c"))
    return book.contribution_value(b, "x", "c", "mi").select("mi", r6("value", 3).alias("value"))


@query("whole_share_error", f"""WITH {q.MONTHLY}, w AS (SELECT *, round_even(20000 / close, 0) AS sh, row_number() OVER (PARTITION BY mi ORDER BY turnover DESC, code) AS lr FROM monthly),
 e AS (SELECT *, abs(sh * close - 20000) / 20000 AS err FROM w)
 SELECT mi, {r('avg(err)')} AS all_err, {r('avg(CASE WHEN lr <= 30 THEN 0 ELSE err END)')} AS real_err, count(*) FILTER (WHERE lr > 30) AS ws_n, count(*) FILTER (WHERE lr > 30 AND sh = 0) AS ws_drop FROM e GROUP BY mi""")
def _(spark, sf):
    m = xsec.with_row_number(t.monthly_panel(spark, sf), "mi", "turnover", "code", "lr", True, splits(spark, sf))
    n, err = book.whole_share_error(20000.0, F.col("close"))
    m = m.withColumns({"sh": n, "err": err})
    frac = F.col("lr") <= 30
    return m.groupBy("mi").agg(r6(F.avg("err")).alias("all_err"), r6(F.avg(F.when(frac, 0.0).otherwise(F.col("err")))).alias("real_err"),
                               F.count_if(~frac).alias("ws_n"), F.count_if(~frac & (F.col("sh") == 0)).alias("ws_drop"))


@query("snapshot_allocation", f"""WITH {q.RETS}, v AS (SELECT code, arg_max(close, pos) AS px, arg_max(vol, pos) AS vol FROM (SELECT *, {full('stddev_samp(lret)', 'lret', 60)} AS vol FROM rets WINDOW k AS (PARTITION BY code ORDER BY pos)) WHERE vol IS NOT NULL GROUP BY code),
 rk AS (SELECT *, row_number() OVER (ORDER BY vol, code) AS rn, greatest(1, floor(count(*) OVER () * 0.2)) AS k FROM v)
 SELECT code, {r('vol')} AS vol, {r('100000 / k')} AS alloc, {r('100000 / k / px')} AS shares FROM rk WHERE rn <= k""")
def _(spark, sf):
    d = t.daily_returns(spark, sf).withColumn("vol", Clock("code", "pos").full(F.stddev_samp, "lret", 60)).where("vol IS NOT NULL")
    s = d.groupBy("code").agg(F.max_by("close", "pos").alias("px"), F.max_by("vol", "pos").alias("vol")).withColumn("g", F.lit(0))
    s = xsec.tail_flags(s, "g", "vol", "code", 0.2, 1, splits(spark, sf)).where("leg = -1")
    return s.select("code", r6("vol").alias("vol"), r6(F.lit(100000.0) / F.col("k")).alias("alloc"), r6(F.lit(100000.0) / F.col("k") / F.col("px")).alias("shares"))


@query("breakeven_cost", f"""WITH {LS}, c AS (SELECT unnest([0.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0]) AS bps), p AS (SELECT bps, avg(long_ret - lt * bps / 1e4) AS y, min(tg) AS tg FROM ls, c, (SELECT avg(uni_ret) - 0.02 AS tg FROM ls) GROUP BY bps),
 s AS (SELECT *, lead(bps) OVER (ORDER BY bps) AS b1, lead(y) OVER (ORDER BY bps) AS y1 FROM p)
 SELECT {r('bps + (b1 - bps) * (y - tg) / (y - y1)', 4)} AS breakeven FROM s WHERE y >= tg AND y1 < tg""")
def _(spark, sf):
    b = with_grid(momentum_book(spark, sf), bps=[0.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0])
    p = b.groupBy("bps").agg(F.avg(F.col("long_ret") - F.col("long_turnover") * F.col("bps") / 1e4).alias("y"), (F.avg("uni_ret") - 0.02).alias("tg"))
    out = book.breakeven(p.withColumn("book", F.lit("long")), "bps", "y", "tg", ["book"])
    return out.select(r6("breakeven", 4).alias("breakeven"))


BA = LS + """, ba AS (SELECT mi, ls_net AS s, uni_ret - 0.14 AS m FROM ls), be AS (SELECT covar_samp(s, m) / var_pop(m) AS beta FROM ba),
 w AS (SELECT *, sum(ln(1 + s)) OVER (ORDER BY mi) AS ls_, sum(ln(1 + m)) OVER (ORDER BY mi) AS lm_ FROM ba),
 dd AS (SELECT *, exp(ls_ - max(ls_) OVER (ORDER BY mi)) - 1 AS ds, exp(lm_ - max(lm_) OVER (ORDER BY mi)) - 1 AS dm FROM w)"""


@query("beta_alpha_label", f"""WITH {BA} SELECT mi, {r('ds')} AS dd_s, {r('dm')} AS dd_m, {r('s - beta * m')} AS alpha_ret,
  CASE WHEN ds >= -0.15 THEN 'ok' WHEN dm <= -0.10 THEN 'BETA' ELSE 'ALPHA' END AS label FROM dd, be""")
def _(spark, sf):
    b = momentum_book(spark, sf).select("mi", F.col("ls_net").alias("s"), (F.col("uni_ret") - 0.14).alias("m"))
    beta = b.agg(metrics.beta_parity("s", "m").alias("beta"))
    d = metrics.drawdown(metrics.drawdown(b, "s", [], "mi", out="ds"), "m", [], "mi", out="dm").join(F.broadcast(beta))
    return d.select("mi", r6("ds").alias("dd_s"), r6("dm").alias("dd_m"), r6(F.col("s") - F.col("beta") * F.col("m")).alias("alpha_ret"),
                    book.beta_alpha_label(F.col("ds"), F.col("dm")).alias("label"))


@query("ts_reversion_hedged", f"""WITH {SIGV}, w AS (SELECT code, mi, fret, (-mom / vol) / sum(abs(mom / vol)) OVER (PARTITION BY mi) AS w FROM sv), mk AS (SELECT mi, avg(fret) AS m FROM sv GROUP BY mi)
 SELECT mi, {r('sum(w * fret) - sum(w) * max(m)')} AS hedged, {r('sum(w)')} AS net_exposure FROM w JOIN mk USING (mi) GROUP BY mi""")
def _(spark, sf):
    d = signal_vol(spark, sf).withColumn("raw", -F.col("mom") / F.col("vol"))
    d = xsec.with_stats(d, "mi", {"g": F.sum(F.abs("raw"))}, splits(spark, sf)).withColumn("w", F.col("raw") / F.col("g"))
    return d.groupBy("mi").agg(r6(F.sum(F.col("w") * F.col("fret")) - F.sum("w") * F.avg("fret")).alias("hedged"), r6(F.sum("w")).alias("net_exposure"))


# ---- metrics -------------------------------------------------------------------------------------

@query("sharpe_cagr_mdd", f"""WITH {LS}, x AS (SELECT *, sum(ln(1 + ls_net)) OVER (ORDER BY mi) AS lw, sum(ls_net) OVER (ORDER BY mi) AS aw FROM ls), d AS (SELECT *, exp(lw - max(lw) OVER (ORDER BY mi)) - 1 AS dd, aw - max(aw) OVER (ORDER BY mi) AS ad, exp(aw - max(aw) OVER (ORDER BY mi)) - 1 AS ld FROM x)
 SELECT count(*) AS n, {r('avg(ls_net) / stddev_samp(ls_net) * sqrt(12.0)')} AS sharpe, {r('avg(ls_net) / stddev_pop(ls_net) * sqrt(12.0)')} AS sharpe_pop, {r('exp(sum(ln(1 + ls_net)) * 12 / count(*)) - 1')} AS cagr,
  {r('min(dd)')} AS mdd, {r('min(ad)')} AS mdd_additive, {r('min(ld)')} AS mdd_log FROM d""")
def _(spark, sf):
    b = momentum_book(spark, sf).select("mi", "ls_net")
    for conv in ("simple", "additive", "log"):
        b = metrics.drawdown(b, "ls_net", [], "mi", conv, f"d_{conv}")
    return b.agg(F.count(F.lit(1)).alias("n"), r6(metrics.sharpe("ls_net", 12)).alias("sharpe"), r6(metrics.sharpe("ls_net", 12, 0)).alias("sharpe_pop"),
                 r6(metrics.cagr("ls_net", 12)).alias("cagr"), r6(F.min("d_simple")).alias("mdd"), r6(F.min("d_additive")).alias("mdd_additive"), r6(F.min("d_log")).alias("mdd_log"))


@query("cagr_year_basis", f"""WITH {LS} SELECT {r('exp(sum(ln(1 + uni_ret)) * 12 / count(*)) - 1')} AS cagr_rows, {r("exp(sum(ln(1 + uni_ret)) * 365.25 / datediff('day', min(d), max(d))) - 1")} AS cagr_calendar
 FROM (SELECT *, last_day(make_date(CAST(mi // 12 AS INT), CAST(mi % 12 + 1 AS INT), 1)) AS d FROM ls)""")
def _(spark, sf):
    from ..functions.columns import month_end

    b = momentum_book(spark, sf).withColumn("d", month_end("mi"))
    return b.agg(r6(metrics.cagr("uni_ret", 12)).alias("cagr_rows"), r6(metrics.cagr_calendar("uni_ret", "d")).alias("cagr_calendar"))


@query("beta_alpha", f"""WITH {LS}, m AS (SELECT count(*) AS n, covar_samp(ls_net, uni_ret) / var_pop(uni_ret) AS beta_parity, regr_slope(ls_net, uni_ret) AS b, regr_intercept(ls_net, uni_ret) AS a,
   regr_syy(ls_net, uni_ret) AS syy, regr_sxx(ls_net, uni_ret) AS sxx, avg(uni_ret) AS mx FROM ls)
 SELECT {r('beta_parity')} AS beta_parity, {r('b')} AS beta, {r('a')} AS alpha, {r('a / sqrt((syy - b * b * sxx) / (n - 2) * (1.0 / n + mx * mx / sxx))')} AS alpha_t FROM m""")
def _(spark, sf):
    b = momentum_book(spark, sf)
    y, x = "ls_net", "uni_ret"
    return b.agg(r6(metrics.beta_parity(y, x)).alias("beta_parity"), r6(F.regr_slope(y, x)).alias("beta"), r6(F.regr_intercept(y, x)).alias("alpha"), r6(metrics.alpha_t(y, x)).alias("alpha_t"))


@query("benchmark_win_rate", f"""WITH {MACD}, x AS (SELECT code, long::INT * cret AS s, cret FROM macd WHERE cret IS NOT NULL), c AS (SELECT code, sum(ln(1 + s)) AS ss, sum(ln(1 + cret)) AS bb,
   avg(s) / stddev_samp(s) AS sh, avg(cret) / stddev_samp(cret) AS bh, avg((s <> 0)::INT) AS tim FROM x GROUP BY code)
 SELECT count(*) AS names, {r('avg((ss > bb)::INT)')} AS win_return, {r('avg((sh > bh)::INT)')} AS win_sharpe, {r('median(ss)')} AS med_log_ret, {r('avg(tim)')} AS time_in_market FROM c""")
def _(spark, sf):
    d = macd_panel(spark, sf).where("cret IS NOT NULL").withColumn("s", F.col("macd_long").cast("int") * F.col("cret"))
    c = d.groupBy("code").agg(F.sum(F.log1p("s")).alias("ss"), F.sum(F.log1p("cret")).alias("bb"), (F.avg("s") / F.stddev_samp("s")).alias("sh"),
                              (F.avg("cret") / F.stddev_samp("cret")).alias("bh"), F.avg((F.col("s") != 0).cast("double")).alias("tim"))
    med = xsec.quantiles(c.withColumn("g", F.lit(0)), "g", "ss", [0.5], "code", splits(spark, sf)).select(F.col("q")[0].alias("med"))
    one = c.agg(F.count(F.lit(1)).alias("names"), r6(F.avg((F.col("ss") > F.col("bb")).cast("double"))).alias("win_return"),
                r6(F.avg((F.col("sh") > F.col("bh")).cast("double"))).alias("win_sharpe"), r6(F.avg("tim")).alias("time_in_market"))
    return one.join(F.broadcast(med)).withColumn("med_log_ret", r6("med")).drop("med")


@query("exposure_turnover", f"""WITH {QUAL}, g AS (SELECT cal, sum(h) AS n FROM mh GROUP BY cal)
 SELECT {r('avg(n)')} AS mean_held, {r('avg((n > 0)::INT)')} AS time_in_market, {r('(SELECT sum(turnover) FROM ' + turn_sql('hw', 'cal') + ' WHERE cal IN (SELECT cal FROM hw)) / avg(n) / (count(*) / 252.0)')} AS turnover_py FROM g""")
def _(spark, sf):
    b = book.membership_book(qualified(spark, sf), "qual", "cret", 0.001)
    return b.agg(r6(F.avg("n_held")).alias("mean_held"), r6(F.avg((F.col("n_held") > 0).cast("double"))).alias("time_in_market"),
                 r6(F.sum("changes") / F.avg("n_held") / (F.count(F.lit(1)) / 252.0)).alias("turnover_py"))


@query("capture_by_quartile", f"""WITH {MACD}, c AS (SELECT code, sum(ln(1 + long::INT * cret)) AS ss, sum(ln(1 + cret)) AS bb FROM macd WHERE cret IS NOT NULL GROUP BY code), qn AS (SELECT *, ntile(4) OVER (ORDER BY bb, code) AS qt FROM c)
 SELECT CAST(qt AS BIGINT) AS quartile, count(*) AS n, {r('sum(ss) / sum(bb)')} AS capture FROM qn GROUP BY qt""")
def _(spark, sf):
    d = macd_panel(spark, sf).where("cret IS NOT NULL").withColumn("s", F.col("macd_long").cast("int") * F.col("cret"))
    c = d.groupBy("code").agg(F.sum(F.log1p("s")).alias("ss"), F.sum(F.log1p("cret")).alias("bb")).withColumn("g", F.lit(0))
    c = xsec.equal_split(c, "g", "bb", 4, "code", "qt", splits(spark, sf))
    return c.groupBy(F.col("qt").cast("long").alias("quartile")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("ss") / F.sum("bb")).alias("capture"))


@query("factor_lag_pairs", f"""WITH {q.RETS}, {q.SYMBOLS}, f AS (SELECT nation AS fac, year(date) * 12 + month(date) - 1 AS mi, avg(lret) AS x FROM rets JOIN symbols USING (code) WHERE lret IS NOT NULL GROUP BY 1, 2)
 SELECT a.fac AS pred, b.fac AS target, count(*) AS n, {r('corr(a.x, b.x)')} AS c FROM f a JOIN f b ON b.mi = a.mi + 1 GROUP BY 1, 2""")
def _(spark, sf):
    s = t.symbols(spark, sf).select("code", "nation")
    f = t.daily_returns(spark, sf).where("lret IS NOT NULL").join(s, "code").groupBy(F.col("nation").alias("fac"), month_index("date").alias("mi")).agg(F.avg("lret").alias("x"))
    a = f.select(F.col("fac").alias("pred"), "mi", F.col("x").alias("xa"))
    b = f.select(F.col("fac").alias("target"), (F.col("mi") - 1).alias("mi"), F.col("x").alias("xb"))
    # factors are the 25 nations, so a month holds at most 25 rows a side
    return a.join(b, "mi").groupBy("pred", "target").agg(F.count(F.lit(1)).alias("n"), r6(F.corr("xa", "xb")).alias("c"))
