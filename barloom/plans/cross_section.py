"""Cross-sectional ranks, scores, buckets and information coefficients."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import positive_ratio, r6
from ..operators import align, clean, xsec
from ..operators.clock import Clock
from ..sources import tables as t
from . import query
from . import sqltext as q
from .panel import monthly_signals
from .sqltext import r

AVG_RANK = "rank() OVER (PARTITION BY mi ORDER BY {x}) + (count(*) OVER (PARTITION BY mi, {x}) - 1) / 2.0"


def splits(spark, sf) -> int:
    return xsec.splits_for(t.instrument_count(spark, sf))


def _mom(spark, sf):
    return monthly_signals(spark, sf).where("mom IS NOT NULL")


MOM = q.MSIG + ", v AS (SELECT * FROM msig WHERE mom IS NOT NULL)"


@query("rank_centred", f"WITH {MOM} SELECT code, mi, {r('(' + AVG_RANK.format(x='volume') + ' - 0.5) / count(*) OVER (PARTITION BY mi) - 0.5')} AS rk FROM v")
def _(spark, sf):
    return xsec.rank_centred(_mom(spark, sf), "mi", "volume", "code", "rk", splits(spark, sf)).select("code", "mi", r6("rk").alias("rk"))


@query("rank_pct", f"WITH {MOM} SELECT code, mi, {r('(' + AVG_RANK.format(x='mret') + ') / count(*) OVER (PARTITION BY mi)')} AS rk FROM v")
def _(spark, sf):
    return xsec.rank_pct(_mom(spark, sf), "mi", "mret", "code", "rk", splits(spark, sf)).select("code", "mi", r6("rk").alias("rk"))


@query("rank_pct_split", f"WITH {MOM} SELECT code, mi, {r('(' + AVG_RANK.format(x='mret') + ') / count(*) OVER (PARTITION BY mi)')} AS rk FROM v")
def _(spark, sf):
    """The same ranks through the many-tasks-per-cross-section path used for very wide universes."""
    return xsec.rank_pct(_mom(spark, sf), "mi", "mret", "code", "rk", 4).select("code", "mi", r6("rk").alias("rk"))


@query("zscore_xs", f"WITH {MOM} SELECT code, mi, {r('CASE WHEN stddev_samp(mret) OVER w > 0 THEN (mret - avg(mret) OVER w) / stddev_samp(mret) OVER w ELSE 0 END')} AS z FROM v WINDOW w AS (PARTITION BY mi)")
def _(spark, sf):
    return xsec.zscore(_mom(spark, sf), "mi", "mret", "z", splits(spark, sf)).select("code", "mi", r6("z").alias("z"))


@query("demean_xs", f"WITH {MOM} SELECT code, mi, {r('mret - avg(mret) OVER (PARTITION BY mi)')} AS x FROM v")
def _(spark, sf):
    return xsec.demean(_mom(spark, sf), "mi", "mret", "x", splits(spark, sf)).select("code", "mi", r6("x").alias("x"))


@query("topn_liquidity", f"WITH {q.MONTHLY} SELECT code, mi, row_number() OVER (PARTITION BY mi ORDER BY volume DESC, code) <= 35 AS eligible FROM monthly")
def _(spark, sf):
    return xsec.top_n(t.monthly_panel(spark, sf), "mi", "volume", 35, "code", splits=splits(spark, sf)).select("code", "mi", "eligible")


@query("tail_legs", f"""WITH {MOM}, x AS (SELECT code, mi, row_number() OVER (PARTITION BY mi ORDER BY mom DESC, code) AS up, row_number() OVER (PARTITION BY mi ORDER BY mom, code) AS dn,
   greatest(1, floor(count(*) OVER (PARTITION BY mi) * 0.1)) AS k FROM v)
 SELECT code, mi, CASE WHEN up <= k THEN 1 ELSE -1 END AS leg FROM x WHERE up <= k OR dn <= k""")
def _(spark, sf):
    return xsec.tail_flags(_mom(spark, sf), "mi", "mom", "code", 0.1, splits=splits(spark, sf)).where("leg <> 0").select("code", "mi", "leg")


FACT = MOM + ", " + q.STATEMENTS + """, f0 AS (SELECT m.*, s.sales, s.assets, s.cost, s.units FROM v m ASOF LEFT JOIN statements s ON m.code = s.code AND m.month >= s.avail_date),
 f1 AS (SELECT *, CASE WHEN assets > 0 THEN sales / assets END AS roe, CASE WHEN sales > 0 THEN (sales - cost) / sales END AS gpa,
   CASE WHEN close * units > 0 THEN sales / (close * units) END AS sp FROM f0)"""


def factor_table(spark, sf):
    """Momentum joined with the last available statements and three ratio factors."""
    m = _mom(spark, sf)
    f = align.asof_last(m, t.statements(spark, sf), "code", "month", "avail_date", ["sales", "assets", "cost", "units"])
    return f.withColumns(
        {
            "roe": positive_ratio("sales", "assets"),
            "gpa": positive_ratio(F.col("sales") - F.col("cost"), "sales"),
            "sp": positive_ratio("sales", F.col("close") * F.col("units")),
        }
    )


@query("ratio_factors", f"WITH {FACT} SELECT code, mi, {r('roe')} AS roe, {r('gpa')} AS gpa, {r('sp')} AS sp FROM f1")
def _(spark, sf):
    return factor_table(spark, sf).select("code", "mi", *[r6(c).alias(c) for c in ("roe", "gpa", "sp")])


def _z(x, part="mi"):
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN stddev_samp({x}) OVER (PARTITION BY {part}) > 0 THEN ({x} - avg({x}) OVER (PARTITION BY {part})) / stddev_samp({x}) OVER (PARTITION BY {part}) ELSE 0 END"


COMPOSITE = FACT + f""", z AS (SELECT *, {_z('mom')} AS z_mom, {_z('gpa')} AS z_gpa, {_z('sp')} AS z_sp FROM f1),
 comp AS (SELECT *, CASE WHEN z_mom IS NOT NULL THEN (coalesce(z_mom, 0) + coalesce(z_gpa, 0) + coalesce(z_sp, 0)) /
   ((z_mom IS NOT NULL)::INT + (z_gpa IS NOT NULL)::INT + (z_sp IS NOT NULL)::INT) END AS score FROM z)"""


def composite_table(spark, sf):
    n = splits(spark, sf)
    f = factor_table(spark, sf)
    for c in ("mom", "gpa", "sp"):
        f = xsec.zscore(f, "mi", c, f"z_{c}", n)
    return f.withColumn("score", xsec.composite([("z_mom", True), ("z_gpa", False), ("z_sp", False)]))


@query("composite_score", f"WITH {COMPOSITE} SELECT code, mi, {r('score')} AS score FROM comp")
def _(spark, sf):
    return composite_table(spark, sf).select("code", "mi", r6("score").alias("score"))


@query("xs_winsorise", f"""WITH {q.MSIG}, v AS (SELECT code, mi, greatest(close / p1 - 1, -1) AS x FROM msig WHERE p1 IS NOT NULL), b AS (SELECT mi, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM v GROUP BY mi)
 SELECT code, mi, {r('greatest(least(x, hi), lo)')} AS x FROM v JOIN b USING (mi)""")
def _(spark, sf):
    m = t.monthly_panel(spark, sf)
    m = m.withColumn("x", F.col("close") / Clock("code", "mi").at("close", -1) - 1).where("x IS NOT NULL")
    return xsec.winsorise_by_quantile(m, "mi", "x", 0.01, 0.99, -1.0, splits=splits(spark, sf)).select("code", "mi", r6("x").alias("x"))


@query("cost_tier", f"""WITH {q.MONTHLY}, b AS (SELECT mi, quantile_cont(turnover, 1.0/3) AS q1, quantile_cont(turnover, 2.0/3) AS q2 FROM monthly GROUP BY mi)
 SELECT code, mi, CASE WHEN turnover >= q2 THEN 15.0 WHEN turnover >= q1 THEN 40.0 ELSE 80.0 END::DOUBLE AS spread_bps FROM monthly JOIN b USING (mi)""")
def _(spark, sf):
    return xsec.cost_tier(t.monthly_panel(spark, sf), "mi", "turnover", splits=splits(spark, sf)).select("code", "mi", "spread_bps")


@query("qcut_bucket", f"""WITH {MOM}, b AS (SELECT mi, quantile_cont(mom, [0.2, 0.4, 0.6, 0.8]) AS e FROM v GROUP BY mi)
 SELECT code, mi, len(list_filter(e, lambda c: c < mom)) AS bucket FROM v JOIN b USING (mi)""")
def _(spark, sf):
    return xsec.qcut(_mom(spark, sf), "mi", "mom", 5, splits=splits(spark, sf)).select("code", "mi", F.col("bucket").cast("long").alias("bucket"))


@query("bucket_means", f"""WITH {MOM}, b AS (SELECT mi, quantile_cont(mom, [0.2, 0.4, 0.6, 0.8]) AS e FROM v GROUP BY mi)
 SELECT len(list_filter(e, lambda c: c < mom)) AS bucket, count(fret) AS n, {r('avg(fret)')} AS mean_fret FROM v JOIN b USING (mi) GROUP BY 1""")
def _(spark, sf):
    d = xsec.qcut(_mom(spark, sf), "mi", "mom", 5, splits=splits(spark, sf))
    return d.groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.count("fret").alias("n"), r6(F.avg("fret")).alias("mean_fret"))


@query("confidence_split", f"""WITH {MOM}, s AS (SELECT *, ntile(4) OVER (PARTITION BY mi ORDER BY abs(mom), code) AS part FROM v)
 SELECT mi, CAST(part AS BIGINT) AS part, count(*) AS n, {r('avg(fret)')} AS mean_fret FROM s GROUP BY ALL""")
def _(spark, sf):
    d = _mom(spark, sf).withColumn("conf", F.abs("mom"))
    d = xsec.equal_split(d, "mi", "conf", 4, "code", splits=splits(spark, sf))
    return d.groupBy("mi", F.col("part").cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("fret")).alias("mean_fret"))


IC = MOM + f""", p AS (SELECT *, {AVG_RANK.format(x='mom')} AS rx, {AVG_RANK.format(x='fret')} AS ry FROM v WHERE fret IS NOT NULL),
 ic AS (SELECT mi, count(*) AS n, corr(rx, ry) AS ic FROM p GROUP BY mi)"""


@query("xs_ic", f"WITH {IC} SELECT mi, n, {r('ic')} AS ic FROM ic")
def _(spark, sf):
    return xsec.spearman(_mom(spark, sf), "mi", "mom", "fret", "code", splits(spark, sf)).select("mi", "n", r6("ic").alias("ic"))


@query("xs_ic_tstat", f"WITH {IC} SELECT count(ic) AS n, {r('avg(ic)')} AS mean_ic, {r('avg(ic) / stddev_samp(ic) * sqrt(count(ic))')} AS t FROM ic")
def _(spark, sf):
    ic = xsec.spearman(_mom(spark, sf), "mi", "mom", "fret", "code", splits(spark, sf))
    return ic.agg(F.count("ic").alias("n"), r6(F.avg("ic")).alias("mean_ic"), r6(F.avg("ic") / F.stddev_samp("ic") * F.sqrt(F.count("ic"))).alias("t"))


@query("spearman_ordinal", f"""WITH {MOM}, p AS (SELECT *, row_number() OVER (PARTITION BY mi ORDER BY mom, code) AS rx, row_number() OVER (PARTITION BY mi ORDER BY fret, code) AS ry FROM v WHERE fret IS NOT NULL)
 SELECT mi, count(*) AS n, {r('corr(rx, ry)')} AS ic FROM p GROUP BY mi""")
def _(spark, sf):
    return xsec.spearman(_mom(spark, sf), "mi", "mom", "fret", "code", splits(spark, sf), ordinal=True).select("mi", "n", r6("ic").alias("ic"))


@query("top_share_lift", f"""WITH {MOM}, x AS (SELECT *, row_number() OVER (ORDER BY mom DESC, code * 100000 + mi) AS rn, count(*) OVER () AS nn FROM v WHERE fret IS NOT NULL)
 SELECT {r('avg(CASE WHEN rn <= floor(nn * 0.1) THEN (fret > 0)::INT END)')} AS top_rate, {r('avg((fret > 0)::INT)')} AS base_rate, count(*) FILTER (WHERE rn <= floor(nn * 0.1)) AS n_top,
   {r('avg(CASE WHEN rn <= floor(nn * 0.1) THEN (fret > 0)::INT END) - avg((fret > 0)::INT)')} AS lift FROM x""")
def _(spark, sf):
    d = _mom(spark, sf).where("fret IS NOT NULL").withColumns({"y": F.col("fret") > 0, "id": F.col("code") * 100000 + F.col("mi")})
    out = xsec.top_share_lift(d, "mom", "y", 0.1, "id", max(4, splits(spark, sf) * 100 if splits(spark, sf) > 1 else 4))
    return out.select(r6("top_rate").alias("top_rate"), r6("base_rate").alias("base_rate"), "n_top", r6("lift").alias("lift"))


@query("mom_lookback_grid", f"""WITH {q.MONTHLY}, g AS (SELECT * FROM (SELECT unnest([3, 6, 12]) AS l) CROSS JOIN (SELECT unnest([1, 2]) AS s)),
  x AS (SELECT code, mi, l, s, CASE s WHEN 1 THEN a1 ELSE a2 END / CASE l WHEN 3 THEN a3 WHEN 6 THEN a6 ELSE a12 END - 1 AS mom, fr FROM (
    SELECT *, {', '.join(f'max(close) OVER (k {q.frame(-n, -n)}) AS a{n}' for n in (1, 2, 3, 6, 12))}, ln(max(close) OVER (k {q.frame(1, 1)}) / close) AS fr FROM monthly WINDOW k AS (PARTITION BY code ORDER BY mi)), g)
 SELECT l, s, count(*) AS n, {r('corr(mom, fr)')} AS c FROM x WHERE mom IS NOT NULL AND fr IS NOT NULL GROUP BY l, s""")
def _(spark, sf):
    from ..operators.aggregate import with_grid
    from ..operators.rolling import momentum

    c = Clock("code", "mi")
    m = t.monthly_panel(spark, sf)
    moms = {f"m_{l}_{s}": momentum(c, "close", l, s) for l in (3, 6, 12) for s in (1, 2)}
    m = m.withColumns({**moms, "fr": F.log(c.at("close", 1) / F.col("close"))}).where("fr IS NOT NULL")
    m = with_grid(m.select("code", "fr", *moms), l=[3, 6, 12], s=[1, 2])
    pick = F.lit(None).cast("double")
    for l in (3, 6, 12):
        for s in (1, 2):
            pick = F.when((F.col("l") == l) & (F.col("s") == s), F.col(f"m_{l}_{s}")).otherwise(pick)
    m = m.withColumn("mom", pick).where("mom IS NOT NULL")
    return m.groupBy("l", "s").agg(F.count(F.lit(1)).alias("n"), r6(F.corr("mom", "fr")).alias("c"))
