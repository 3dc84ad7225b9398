"""Window and shape-learning plans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays as fa
from ..functions.columns import r6
from ..operators import resampling as rs
from ..operators import shapes, stats, xsec
from ..operators.clean import time_quantile_split
from ..operators.clock import Clock
from ..session import materialise
from ..sources import tables as t
from . import query
from . import sqltext as q
from .recursions import gapless_returns
from .sqltext import r

BAR = Clock("code", "pos")
L, P, STRIDE, H = 40, 16, 10, 10

LOGP = q.RETS + ", lp AS (SELECT code, pos, date, ln(close) AS lp, lret FROM rets)"
WIN = LOGP + f""", w AS (SELECT code, pos, list(lp) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW) AS win,
   lead(lp, {H}) OVER (PARTITION BY code ORDER BY pos) - lp AS fwd FROM lp QUALIFY pos >= {L - 1} AND (pos - {L - 1}) % {STRIDE} = 0)"""


def log_prices(spark, sf):
    return t.daily_returns(spark, sf).select("code", "pos", "date", "lret", F.log("close").alias("lp"))


def points(column: str, n: int):
    """All points of an array as columns p0, p1, ..."""
    return [r6(F.element_at(column, j + 1)).alias(f"p{j}") for j in range(n)]


@query("windows_znorm", f"""WITH {WIN}, m AS (SELECT code, pos, win, list_avg(win) AS m, list_stddev_pop(win) AS s FROM w)
 SELECT code, pos, {', '.join(f'{r(f"(win[{j + 1}] - m) / (s + 1e-9)")} AS p{j}' for j in range(L))} FROM m""")
def _(spark, sf):
    d = shapes.windows(log_prices(spark, sf), ["code"], "pos", "lp", L, STRIDE, znorm=True)
    return d.select("code", F.col("pos").cast("long").alias("pos"), *points("win", L))


def _res(j: int) -> str:
    at = j * (L - 1) / (P - 1)
    k = min(int(at), L - 2)
    return f"win[{k + 1}] + (win[{k + 2}] - win[{k + 1}]) * {at - k!r}"


RES = WIN + f", rw AS (SELECT code, pos, fwd, [{', '.join(_res(j) for j in range(P))}] AS sh FROM w)"


@query("windows_resampled", f"WITH {RES} SELECT code, pos, {', '.join(f'{r(f'sh[{j + 1}]')} AS p{j}' for j in range(P))} FROM rw")
def _(spark, sf):
    d = shapes.windows(log_prices(spark, sf), ["code"], "pos", "lp", L, STRIDE).withColumn("sh", fa.resample(F.col("win"), L, P))
    return d.select("code", F.col("pos").cast("long").alias("pos"), *points("sh", P))


VSW = LOGP + f""", v AS (SELECT *, CASE WHEN count(lret) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN {L - 1 + 29} PRECEDING AND {L - 1} PRECEDING) = 30 THEN stddev_pop(lret) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN {L - 1 + 29} PRECEDING AND {L - 1} PRECEDING) END AS v,
   list(lp) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW) AS raw, lead(lp, {H}) OVER (PARTITION BY code ORDER BY pos) - lp AS fwd FROM lp),
 vw AS (SELECT code, pos, date, fwd, v AS sig, raw, list_transform(raw, lambda x: (x - raw[1]) / (v * sqrt({L}.0))) AS win FROM v WHERE pos >= {L - 1} AND (pos - {L - 1}) % {STRIDE} = 0 AND v > 1e-9),
 vs AS (SELECT code, pos, date, fwd, sig, raw, [{', '.join(_res(j) for j in range(P))}] AS sh FROM vw)"""


def scaled(spark, sf):
    d = log_prices(spark, sf).withColumns({"fwd": BAR.at("lp", H) - F.col("lp")})
    return shapes.vol_scaled_windows(d, ["code"], "pos", "lp", L, P, STRIDE, 30)


@query("windows_vol_scaled", f"WITH {VSW} SELECT code, pos, {', '.join(f'{r(f'sh[{j + 1}]')} AS p{j}' for j in range(P))}, {r('sh[16]')} AS drift FROM vs")
def _(spark, sf):
    d = scaled(spark, sf)
    return d.select("code", F.col("pos").cast("long").alias("pos"), *points("shape", P), r6("drift").alias("drift"))


_FS = VSW + """, fi AS (SELECT *, list_transform(range(2, 17), lambda i: sh[i] - sh[i - 1]) AS inc FROM vs), fm AS (SELECT *, list_avg(inc) AS m, list_var_pop(inc) AS vv FROM fi)"""


@query("shape_features", f"""WITH {_FS} SELECT code, pos, {r('sh[16]')} AS f_drift, {r('list_sum(list_transform(inc, lambda x: power((x - m) / (sqrt(vv) + 1e-9), 3))) / 15')} AS f_skew,
   {r('list_sum(list_transform(range(1, 15), lambda i: (inc[i] - m) * (inc[i + 1] - m))) / 14 / (vv + 1e-12)')} AS f_ac1, {r('sh[9] - (sh[16] - sh[9])')} AS f_early_late, {r('list_max(sh) - list_min(sh)')} AS f_range FROM fm""")
def _(spark, sf):
    d = scaled(spark, sf).withColumns(shapes.shape_features(F.col("shape"), P))
    return d.select("code", F.col("pos").cast("long").alias("pos"), *[r6(c).alias(c) for c in ("f_drift", "f_skew", "f_ac1", "f_early_late", "f_range")])


@query("amplitude_features", f"""WITH {VSW} SELECT code, pos, {r(f'(list_max(raw) - list_min(raw)) / (sig * sqrt({L}.0))')} AS a_range, {r(f'(raw[{L}] - raw[1]) / (sig * sqrt({L}.0))')} AS a_net, {r('1 - exp(list_min(raw) - list_max(raw))')} AS a_depth,
   {r(f'(list_position(raw, list_min(raw)) - 1) / {L}.0')} AS a_argmin, {r(f'(list_position(raw, list_max(raw)) - 1) / {L}.0')} AS a_argmax FROM vs""")
def _(spark, sf):
    d = log_prices(spark, sf).withColumn("sig", BAR.full(F.stddev_pop, "lret", 30, lag=L - 1))
    d = shapes.windows(d, ["code"], "pos", "lp", L, STRIDE).where("sig > 1e-9")
    d = d.withColumns(shapes.amplitude_features(F.col("win"), F.col("sig"), L))
    return d.select("code", F.col("pos").cast("long").alias("pos"), *[r6(c).alias(c) for c in ("a_range", "a_net", "a_depth", "a_argmin", "a_argmax")])


@query("lag_matrix", f"""WITH {LOGP}, g AS (SELECT code, pos, {', '.join(f'lag(lret, {i}) OVER k AS l{i}' for i in range(1, 6))} FROM lp WINDOW k AS (PARTITION BY code ORDER BY pos))
 SELECT code, pos, {', '.join(f'{r(f'l{i}')} AS l{i}' for i in range(1, 6))} FROM g WHERE l5 IS NOT NULL""")
def _(spark, sf):
    d = t.daily_returns(spark, sf).withColumn("v", shapes.lag_vector(BAR, "lret", 5)).where("v IS NOT NULL")
    return d.select("code", F.col("pos").cast("long").alias("pos"), *[r6(F.element_at("v", i)).alias(f"l{i}") for i in range(1, 6)])


def split_shapes(spark, sf):
    """Vol-scaled windows with an outcome, split by time; written once because every fit reads them several times."""
    d = scaled(spark, sf).where("fwd IS NOT NULL")
    d = time_quantile_split(d, "date", 0.6)
    return materialise(d.select("code", "pos", "date", "shape", "fwd", "is_train"))


@query("kmeans_edge")
def _(spark, sf):
    d = split_shapes(spark, sf)
    model = shapes.fit_clusters(d.where("is_train"), "shape", 8)
    e = shapes.cluster_edges(shapes.assign(model, d, "shape"), "fwd", ["cluster", "is_train"])
    out = e.groupBy("cluster").pivot("is_train", [True, False]).agg(F.first("edge").alias("edge"), F.first("n").alias("n"))
    return out.select("cluster", r6("true_edge").alias("train_edge"), r6("false_edge").alias("test_edge"), F.col("true_n").alias("train_n"), F.col("false_n").alias("test_n"))


@query("multi_scale_consistency")
def _(spark, sf):
    """Cluster edges per window length and the share of agreeing signs: lengths are a key of one table."""
    out = None
    base = log_prices(spark, sf).withColumn("fwd", BAR.at("lp", H) - F.col("lp"))
    for n in (20, 40, 80):
        w = shapes.vol_scaled_windows(base, ["code"], "pos", "lp", n, P, STRIDE, 30).where("fwd IS NOT NULL").select("code", "pos", "date", "shape", "fwd", F.lit(n).alias("scale"))
        out = w if out is None else out.unionByName(w)
    d = materialise(time_quantile_split(out, "date", 0.6))
    sd = d.where("is_train").groupBy("scale").agg(F.stddev_pop("fwd").alias("sd"))
    model = shapes.fit_clusters(d.where("is_train"), "shape", 6)
    z = shapes.assign(model, d.where("is_train"), "shape").join(F.broadcast(sd), "scale").withColumn("fz", F.col("fwd") / (F.col("sd") + 1e-12))
    e = shapes.cluster_edges(z, "fz", ["cluster", "scale"])
    same = e.groupBy("cluster").agg(F.abs(F.sum(F.signum("edge"))).alias("agree"), F.count(F.lit(1)).alias("n_scales"), F.avg("edge").alias("pooled"))
    return same.select("cluster", (F.col("agree") == F.col("n_scales")).alias("consistent"), "n_scales", r6("pooled").alias("pooled_edge"))


@query("svd_components")
def _(spark, sf):
    d = split_shapes(spark, sf)
    comp, share = shapes.linear_shapes(d.where("is_train"), "shape", P, 4)
    d = d.withColumn("act", shapes.activations("shape", comp))
    d = d.select("code", "pos", "fwd", "is_train", F.posexplode("act").alias("component", "a"))
    out = d.groupBy("component", "is_train").agg(F.count(F.lit(1)).alias("n"), F.corr("a", "fwd").alias("c"), F.stddev_pop("a").alias("sd"))
    names = F.array(*[F.lit(float(s)) for s in share])
    return out.select((F.col("component") + 1).alias("component"), "is_train", "n", r6("c").alias("corr_fwd"), r6("sd").alias("activation_sd"), r6(F.element_at(names, F.col("component") + 1)).alias("share"))


@query("surrogate_detector")
def _(spark, sf):
    """Can a boosted classifier tell real windows from sign-flip surrogates? AUC and top-share lift on later windows."""
    base = log_prices(spark, sf)
    g = gapless_returns(spark, sf).select("code", "pos", "date", "lret")
    sur = rs.surrogates(rs.with_replicas(g, 1), ["code"], "pos", "lret", "signflip", 3)
    sur = rs.rebuild_path(sur, ["code"], "pos", "sur", out="lp").select("code", "pos", "date", "lp")
    real = shapes.vol_scaled_windows(base.select("code", "pos", "date", "lp"), ["code"], "pos", "lp", L, P, STRIDE, 30)
    fake = shapes.vol_scaled_windows(sur, ["code"], "pos", "lp", L, P, STRIDE, 30)
    d = real.select("code", "pos", "date", "shape", F.lit(1.0).alias("label")).unionByName(fake.select("code", "pos", "date", "shape", F.lit(0.0).alias("label")))
    d = materialise(time_quantile_split(d, "date", 0.6))
    s = shapes.boosted_detector(d.where("is_train"), d.where("NOT is_train"), "shape", "label")
    s = materialise(s.select("score", "label", (F.col("code") * 1000000 + F.col("pos") * 2 + F.col("label")).cast("long").alias("id")))
    auc = stats.rank_auc(s, "label", "score", "id")
    lift = xsec.top_share_lift(s.withColumn("y", F.col("label")), "score", "y", 0.05, "id", 4)
    return auc.join(F.broadcast(lift)).select(r6("auc").alias("auc"), "n_pos", "n_neg", r6("lift").alias("lift"), "n_top")


@query("residual_shapes")
def _(spark, sf):
    """Shape components left after the known features, with their outcome correlation per split."""
    d = split_shapes(spark, sf)
    feats = shapes.shape_features(F.col("shape"), P)
    d = materialise(d.withColumns(feats))
    d = shapes.residual_windows(d, "shape", P, list(feats), F.col("is_train"))
    comp, share = shapes.linear_shapes(d.where("is_train"), "resid", P, 4)
    d = d.withColumn("act", shapes.activations("resid", comp)).select("fwd", "is_train", F.posexplode("act").alias("component", "a"))
    out = d.groupBy("component", "is_train").agg(F.corr("a", "fwd").alias("c"), F.count(F.lit(1)).alias("n"))
    return out.select((F.col("component") + 1).alias("component"), "is_train", "n", r6("c").alias("corr_fwd"))


@query("shape_meaningfulness")
def _(spark, sf):
    """Do clusters and components fitted on two halves of the universe agree? Plus how sinusoidal the centroids are."""
    d = split_shapes(spark, sf)
    halves = [d.where(F.col("code") % 2 == k) for k in (0, 1)]
    cents = [np.array(shapes.fit_clusters(h, "shape", 6).clusterCenters()) for h in halves]
    comps = [shapes.linear_shapes(h, "shape", P, 4)[0] for h in halves]
    rows = [(stats.centroid_match(*cents), stats.subspace_alignment(*comps), stats.harmonic_r2(cents[0]))]
    out = spark.createDataFrame([tuple(float(v) for v in rows[0])], "centroid_match double, subspace_alignment double, harmonic_r2 double")
    return out.select(*[r6(c).alias(c) for c in out.columns])
