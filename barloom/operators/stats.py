"""Regression, correlation, walk-forward and factor operators.

Least squares never gathers rows: products are summed where the data is, and only the small
(features x features) system of each group, date or row is solved, in an Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from ..functions.arrays import a_dot
from . import xsec


def gram(xs: list[Column], y: Column, over: WindowSpec | None = None) -> Column:
    """Sums of products needed by least squares with an intercept: [n, sx.., sxx.., sy, sxy..] as one array."""
    cols = [F.lit(1.0), *xs]
    ok = y.isNotNull()
    for x in xs:
        ok = ok & x.isNotNull()
    prods = [a * b for i, a in enumerate(cols) for b in cols[i:]] + [a * y for a in cols]
    sums = [F.sum(F.when(ok, p)) for p in prods]
    return F.array(*[s.over(over) if over is not None else s for s in sums])


def _solve_batch(flat: np.ndarray, p: int) -> np.ndarray:
    """Solve many small symmetric systems at once; each singular one, for itself, by its minimum-norm solution."""
    m = p * (p + 1) // 2
    upper = np.zeros((len(flat), p, p))
    i, j = np.triu_indices(p)
    upper[:, i, j] = flat[:, :m]
    a = upper + np.triu(upper, 1).transpose(0, 2, 1)
    rhs = flat[:, m:, None]
    # sums of products of one scale, so that the rank does not depend on the units of a regressor
    scale = np.sqrt(np.where(np.einsum("kii->ki", a) > 0, np.einsum("kii->ki", a), 1.0))
    unit = a / scale[:, :, None] / scale[:, None, :]
    regular = np.isfinite(unit).all(axis=(1, 2))
    regular[regular] = np.linalg.matrix_rank(unit[regular], hermitian=True) == p
    out = np.full((len(flat), p), np.nan)
    if regular.any():
        out[regular] = (np.linalg.solve(unit[regular], rhs[regular] / scale[regular][:, :, None])[:, :, 0]) / scale[regular]
    for k in np.flatnonzero(~regular):
        if np.isfinite(a[k]).all() and np.isfinite(rhs[k]).all():
            out[k] = np.linalg.lstsq(a[k], rhs[k], rcond=None)[0][:, 0]
    return out


def solve_gram(g: Column, features: int) -> Column:
    """Coefficients [intercept, b1, ..] from a ``gram`` array."""
    p = features + 1

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        known = s[s.notna()]
        if len(known):
            flat = np.stack(known.to_list()).astype(float)
            ok = np.isfinite(flat).all(axis=1)
            sol = iter(_solve_batch(flat[ok], p)) if ok.any() else iter(())
            for idx in known.index[ok]:
                out[idx] = next(sol)
        return out

    return solve(g)


def predict(coef: Column, xs: list[Column]) -> Column:
    return a_dot(coef, F.array(F.lit(1.0), *xs))


def fit_ols(df: DataFrame, xs: list[str], y: str, by: list[str] | None = None) -> DataFrame:
    """Coefficients per group (or one pooled row)."""
    g = df.groupBy(*(by or [])).agg(gram([F.col(x) for x in xs], F.col(y)).alias("__g"))
    return g.withColumn("coef", solve_gram(F.col("__g"), len(xs))).drop("__g")


def walk_forward_ols(df: DataFrame, keys: list[str], pos: str, xs: list[str], y: str, horizon: int, min_train: int, trailing: int | None = None, out: str = "pred") -> DataFrame:
    """At each row fit on rows at least ``horizon`` earlier (targets closed by now), then predict the row."""
    lo = Window.unboundedPreceding if trailing is None else -(trailing + horizon - 1)
    w = Window.partitionBy(*keys).orderBy(pos).rangeBetween(lo, -horizon)
    d = df.withColumn("__g", gram([F.col(x) for x in xs], F.col(y), w))
    ready = F.col("__g")[0] >= min_train
    for x in xs:
        ready = ready & F.col(x).isNotNull()
    d = d.withColumn("__g", F.when(ready, F.col("__g")))
    d = d.withColumn("__b", solve_gram(F.col("__g"), len(xs)))
    return d.withColumn(out, predict(F.col("__b"), [F.col(x) for x in xs])).drop("__g", "__b")


def walk_forward_select(df: DataFrame, key: str, step_col: str, ret: str, train: int, step: int) -> DataFrame:
    """Every ``step`` rows pick the key with the best trailing compounded return and trade it for the next block.

    ``df`` has one row per (key, step) with a gapless 0-based step; ties go to the smallest key.
    """
    w = Window.partitionBy(key).orderBy(step_col).rowsBetween(-train, -1)
    d = df.withColumn("__t", F.when(F.count(ret).over(w) == train, F.sum(F.log1p(ret)).over(w)))
    d = d.withColumn("block", F.floor((F.col(step_col) - train) / step))
    start = d.where((F.col(step_col) >= train) & ((F.col(step_col) - train) % step == 0))
    pick = start.groupBy("block").agg(F.min(F.struct(-F.col("__t"), F.col(key)))[key].alias(key))
    return d.where(F.col(step_col) >= train).join(pick, ["block", key]).select("block", step_col, F.col(key).alias("pick"), ret)


def partial_spearman(df: DataFrame, by: list[str], x: str, y: str, control: str, tie: str, splits: int = 1) -> DataFrame:
    """Rank correlation of x and y after removing a linear control from both, per group."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(control).isNotNull())
    fit = d.groupBy(*by).agg(
        F.regr_slope(x, control).alias("__bx"), F.regr_intercept(x, control).alias("__ax"), F.regr_slope(y, control).alias("__by"), F.regr_intercept(y, control).alias("__ay")
    )
    d = d.join(fit, by)
    d = d.withColumns({"__rx0": F.col(x) - F.col("__ax") - F.col("__bx") * F.col(control), "__ry0": F.col(y) - F.col("__ay") - F.col("__by") * F.col(control)})
    return xsec.spearman(d, by, "__rx0", "__ry0", tie, splits)


def rank_auc(df: DataFrame, label: str, score: str, tie: str, splits: int = 4) -> DataFrame:
    """Area under the ROC curve from ordinal ranks (one row)."""
    d = xsec.with_row_number(df.withColumn("__g", F.lit(0)), "__g", score, tie, "__r", splits=splits)
    y = F.col(label).cast("double")
    agg = d.agg(F.sum(F.col("__r") * y).alias("s"), F.sum(y).alias("p"), F.sum(1 - y).alias("n"))
    return agg.select(F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("n")).alias("auc"), F.col("p").cast("long").alias("n_pos"), F.col("n").cast("long").alias("n_neg"))


def logistic(df: DataFrame, features: list[str], label: str, train: Column, l2: float = 1e-3):
    """MLlib logistic fit on standardised features of the training rows; adds ``score`` to all rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = df.withColumns({"__y": F.col(label).cast("double"), "__tr": train})
    stages = [
        VectorAssembler(inputCols=features, outputCol="__x"),
        StandardScaler(inputCol="__x", outputCol="__z", withMean=True, withStd=True),
        LogisticRegression(featuresCol="__z", labelCol="__y", regParam=l2, elasticNetParam=0.0, maxIter=50, standardization=False, probabilityCol="__pr", rawPredictionCol="__raw", predictionCol="__cls"),
    ]
    model = Pipeline(stages=stages).fit(d.where("__tr"))
    return model.transform(d).withColumn("score", vector_to_array("__pr")[1]).drop("__x", "__z", "__raw", "__pr", "__cls")


def correlation_pairs(df: DataFrame, date: str, name: str, x: str) -> DataFrame:
    """Correlation of every pair of named series (the names are a small factor set, not instruments)."""
    a = df.select(date, F.col(name).alias("a"), F.col(x).alias("xa"))
    b = df.select(date, F.col(name).alias("b"), F.col(x).alias("xb"))
    return a.join(b, date).groupBy("a", "b").agg(F.corr("xa", "xb").alias("corr"))


def principal_components(df: DataFrame, cols: list[str], k: int, standardise: bool = True) -> tuple[DataFrame, list[list[float]], list[float]]:
    """MLlib PCA of a tall panel; returns scores, loadings (largest entry positive) and variance shares.

    The covariance is features x features; rows never leave the executors.
    """
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = VectorAssembler(inputCols=cols, outputCol="__x").transform(df.dropna(subset=cols))
    src = "__x"
    if standardise:
        d = StandardScaler(inputCol="__x", outputCol="__z", withMean=True, withStd=True).fit(d).transform(d)
        src = "__z"
    model = PCA(k=k, inputCol=src, outputCol="__s").fit(d)
    load = model.pc.toArray()
    sign = np.where(load[np.abs(load).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    scores = F.transform(vector_to_array("__s"), lambda v, i: v * F.element_at(F.array(*[F.lit(float(s)) for s in sign]), i + 1))
    return model.transform(d).withColumn("scores", scores).drop("__x", "__z", "__s"), (load * sign).T.tolist(), [float(v) for v in model.explainedVariance]


def absorption_ratio(df: DataFrame, order: str, cols: list[str], n: int) -> DataFrame:
    """Largest-eigenvalue share of the rolling correlation matrix of a few book-level series (one row per date)."""
    w = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(-(n - 1), 0)
    p = len(cols)
    pairs = [F.corr(cols[i], cols[j]).over(w) for i in range(p) for j in range(i + 1, p)]
    full = F.count(F.lit(1)).over(w) == n

    @F.pandas_udf(T.DoubleType())
    def top_share(s: pd.Series) -> pd.Series:
        def one(v):
            if v is None or not np.isfinite(np.asarray(v, float)).all():
                return None
            m = np.eye(p)
            m[np.triu_indices(p, 1)] = v
            e = np.linalg.eigvalsh(np.triu(m) + np.triu(m, 1).T)
            return float(e[-1] / e.sum())

        return s.map(one)

    d = df.withColumn("__c", F.when(full, F.array(*pairs)))
    return d.withColumn("absorption", top_share("__c")).drop("__c")


def lag_autocorrelation(df: DataFrame, keys: list[str], pos: str, x: str, lags: list[int], others: dict[str, Column] | None = None) -> DataFrame:
    """Sum z_t z_{t-k} / sum z^2 of the demeaned series, per key; ``others`` are further aggregates of the same rows."""
    from .clock import Clock

    s = Window.partitionBy(*keys)
    d = df.withColumn("__z", F.col(x) - F.avg(x).over(s))
    c = Clock(keys, pos)
    d = d.withColumns({f"__l{k}": F.col("__z") * c.at("__z", -k) for k in lags})
    den = F.sum(F.col("__z") * F.col("__z")) + 1e-12
    return d.groupBy(*keys).agg(*[(F.sum(f"__l{k}") / den).alias(f"ac_{k}") for k in lags], *[a.alias(k) for k, a in (others or {}).items()])


def every_nth(df: DataFrame, keys: list[str], pos: str, step: int, offset: int = 0) -> DataFrame:
    """Non-overlapping subsample of a clock."""
    return df.where((F.col(pos) - offset) % step == 0)


def subspace_alignment(a: np.ndarray, b: np.ndarray) -> float:
    """Mean cosine of the principal angles between two small orthonormal row bases."""
    return float(np.linalg.svd(a @ b.T, compute_uv=False).mean())


def centroid_match(a: np.ndarray, b: np.ndarray) -> float:
    """Mean best correlation of each row of ``a`` with a row of ``b``."""
    c = np.corrcoef(a, b)[: len(a), len(a):]
    return float(c.max(axis=1).mean())


def harmonic_r2(rows: np.ndarray, harmonics: int = 3) -> float:
    """Mean R2 of a truncated Fourier fit of each row."""
    t = np.linspace(0.0, 1.0, rows.shape[1])
    ang = 2 * np.pi * np.outer(np.arange(1, harmonics + 1), t)
    basis = np.vstack([np.ones_like(t)[None], np.sin(ang), np.cos(ang)]).T
    fit = basis @ np.linalg.lstsq(basis, rows.T, rcond=None)[0]
    dev = rows.T - rows.T.mean(axis=0)
    return float((1 - ((rows.T - fit) ** 2).sum(axis=0) / (dev**2).sum(axis=0)).mean())
