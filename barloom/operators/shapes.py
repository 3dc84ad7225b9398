"""Window extraction and shape learning on array columns and MLlib.

Windows are strided before anything is exploded, stay arrays until scored, and every fit goes through
MLlib or summed products, so only (points x points) matrices reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as fa
from .clock import Clock


def windows(df: DataFrame, keys: list[str], pos: str, x: str, length: int, stride: int, znorm: bool = False, out: str = "win") -> DataFrame:
    """Trailing windows of ``length`` values whose start is a multiple of ``stride``; kept at their last row.

    A bar is sent to the windows it is in, ceil(length / stride) at most, and each window is put together once; only
    its last bar brings the other columns along. Windows with a missing bar or value are none.
    """
    others = [c for c in df.columns if c not in (*keys, pos)]
    first = F.greatest(F.ceil((F.col(pos) - (length - 1)) / stride), F.lit(0)) * stride + (length - 1)
    last = F.col(pos) + length - 1
    ends = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"), F.lit(stride).cast("long")))
    sent = df.withColumn("__end", F.explode(ends))
    row = F.when(F.col(pos) == F.col("__end"), F.struct(pos, *others))
    sent = sent.select(*keys, "__end", F.struct(F.col(pos).alias("p"), F.col(x).alias("x")).alias("__b"), row.alias("__row")).where(F.col("__b.x").isNotNull())
    d = sent.groupBy(*keys, "__end").agg(F.collect_list("__b").alias("__b"), F.first("__row", ignorenulls=True).alias("__row")).where(F.size("__b") == length)
    values = F.transform(F.array_sort("__b"), lambda b: b["x"])
    return d.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns], (fa.znorm(values) if znorm else values).alias(out))


def vol_scaled_windows(df: DataFrame, keys: list[str], pos: str, logp: str, length: int, points: int, stride: int, lookback: int, out: str = "shape") -> DataFrame:
    """Anchored windows divided by (deviation before the window) * sqrt(length), resampled to ``points``.

    The deviation uses the ``lookback`` returns that end at the window's first point.
    """
    c = Clock(keys, pos)
    d = df.withColumn("__r", F.col(logp) - c.at(logp, -1))
    d = d.withColumn("__v", c.full(F.stddev_pop, "__r", lookback, lag=length - 1))
    d = windows(d, keys, pos, logp, length, stride, out="__w").where("__v > 1e-9")
    scaled = F.transform("__w", lambda v: (v - F.element_at("__w", 1)) / (F.col("__v") * F.sqrt(F.lit(float(length)))))
    d = d.withColumn("__s", scaled).withColumn(out, fa.resample(F.col("__s"), length, points))
    return d.withColumn("drift", F.element_at(out, -1)).drop("__r", "__v", "__w", "__s")


def shape_features(a: Column, points: int) -> dict[str, Column]:
    """Drift, increment skew, lag-1 autocorrelation of increments, early-minus-late move, range."""
    n = points - 1

    def moments(inc: Column) -> Column:
        stats = F.struct(fa.a_mean(inc).alias("m"), fa.a_var_pop(inc).alias("v"))

        def from_moments(b: Column) -> Column:
            m, v = b["m"], b["v"]
            skew = fa.a_sum(F.transform(inc, lambda x: F.pow((x - m) / (F.sqrt(v) + 1e-9), F.lit(3)))) / n
            pairs = F.zip_with(F.slice(inc, 1, n - 1), F.slice(inc, 2, n - 1), lambda x, y: (x - m) * (y - m))
            return F.struct(skew.alias("skew"), (fa.a_sum(pairs) / (n - 1) / (v + 1e-12)).alias("ac1"))

        return fa.let(stats, from_moments)

    shape = fa.let(fa.a_diff(a), moments)
    mid = F.element_at(a, points // 2 + 1)
    return {
        "f_drift": F.element_at(a, -1),
        "f_skew": shape["skew"],
        "f_ac1": shape["ac1"],
        "f_early_late": mid - (F.element_at(a, -1) - mid),
        "f_range": F.array_max(a) - F.array_min(a),
    }


def amplitude_features(a: Column, sigma: Column, length: int) -> dict[str, Column]:
    """Range and net move in vol units, peak-to-trough depth in price terms, relative positions of the extremes."""
    amp = sigma * float(length) ** 0.5
    lo, hi = F.array_min(a), F.array_max(a)
    return {
        "a_range": (hi - lo) / amp,
        "a_net": (F.element_at(a, -1) - F.element_at(a, 1)) / amp,
        "a_depth": 1 - F.exp(lo - hi),
        "a_argmin": fa.a_argmin(a) / length,
        "a_argmax": fa.a_argmax(a) / length,
    }


def lag_vector(c: Clock, x: str, n: int) -> Column:
    """Most recent first vector of the n previous values; NULL until complete."""
    w = c.back(n, 1)
    return F.when(F.count(x).over(w) == n, F.reverse(F.collect_list(x).over(w)))


def to_vector(df: DataFrame, arr: str, out: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn(out, array_to_vector(arr))


def fit_clusters(train: DataFrame, arr: str, k: int, seed: int = 7, max_iter: int = 20):
    from pyspark.ml.clustering import KMeans

    return KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="__f", predictionCol="cluster").fit(to_vector(train, arr, "__f"))


def assign(model, df: DataFrame, arr: str) -> DataFrame:
    return model.transform(to_vector(df, arr, "__f")).drop("__f")


def cluster_edges(df: DataFrame, outcome: str, by: list[str]) -> DataFrame:
    """Mean outcome and count per cluster (and any further key)."""
    return df.groupBy(*by).agg(F.avg(outcome).alias("edge"), F.count(outcome).alias("n"))


def linear_shapes(df: DataFrame, arr: str, points: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors of the uncentred window matrix and their variance shares.

    The Gram matrix (points x points) is a sum of products over rows; its eigenvectors are the shapes,
    oriented to rise from left to right.
    """
    pairs = [(i, j) for i in range(points) for j in range(i, points)]
    cols = [F.element_at(arr, i + 1) for i in range(points)]
    row = df.agg(F.array(*[F.sum(cols[i] * cols[j]) for i, j in pairs]).alias("g")).head()["g"]
    g = np.zeros((points, points))
    for (i, j), v in zip(pairs, row):
        g[i, j] = g[j, i] = v
    val, vec = np.linalg.eigh(g)
    order = np.argsort(val)[::-1][:k]
    comp = vec[:, order].T
    comp *= np.where(comp[:, -1] < comp[:, 0], -1.0, 1.0)[:, None]
    return comp, val[order] / val.sum()


def activations(arr: str | Column, comp: np.ndarray) -> Column:
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.array(*[fa.a_dot(a, fa.lit_array(c)) for c in comp])


def residual_windows(df: DataFrame, arr: str, points: int, feats: list[str], train: Column, out: str = "resid") -> DataFrame:
    """Windows minus their least-squares projection on known features, fitted on the training rows."""
    x = [F.lit(1.0), *[F.col(f) for f in feats]]
    p = len(x)
    y = [F.element_at(arr, i + 1) for i in range(points)]
    xx = F.array(*[F.sum(x[i] * x[j]) for i in range(p) for j in range(p)])
    xy = F.array(*[F.sum(a * b) for a in x for b in y])
    row = df.where(train).agg(xx.alias("xx"), xy.alias("xy")).head()
    beta = np.linalg.lstsq(np.array(row["xx"]).reshape(p, p), np.array(row["xy"]).reshape(p, points), rcond=None)[0]
    fit = [sum((x[i] * float(beta[i, k]) for i in range(p)), F.lit(0.0)) for k in range(points)]
    return df.withColumn(out, F.array(*[y[k] - fit[k] for k in range(points)]))


def boosted_detector(train: DataFrame, test: DataFrame, arr: str, label: str, rounds: int = 10, depth: int = 3):
    """Gradient-boosted real-versus-surrogate classifier; adds ``score`` to the test rows."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    gbt = GBTClassifier(featuresCol="__f", labelCol=label, maxIter=rounds, maxDepth=depth, seed=7)
    model = gbt.fit(to_vector(train, arr, "__f"))
    return model.transform(to_vector(test, arr, "__f")).withColumn("score", vector_to_array("probability")[1]).drop("__f", "rawPrediction", "probability", "prediction")
