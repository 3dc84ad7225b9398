"""Book-level and trade-level metrics as aggregate expressions, plus run (spell/episode) extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import col
from .aggregate import compound


def runs(df: DataFrame, flag: str, keys: list[str], order: str, out: str = "run") -> DataFrame:
    """Rows where ``flag`` holds, numbered by the consecutive run they belong to."""
    w = Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)
    rising = F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))
    df = df.withColumn("__rise", rising.cast("int"))
    return df.withColumn(out, F.sum("__rise").over(w)).where(F.col(flag)).drop("__rise")


def spells(df: DataFrame, held: str, ret: str, keys: list[str], order: str, date: str) -> DataFrame:
    """One compounded return per maximal holding run."""
    r = runs(df, held, keys, order, "spell")
    return r.groupBy(*keys, "spell").agg(
        F.min(date).alias("start"), F.max(date).alias("end"), F.count(F.lit(1)).alias("n"), compound(ret).alias("pnl")
    )


def episodes(df: DataFrame, dd: str, trigger: float, keys: list[str] | None = None, date: str = "date") -> DataFrame:
    """Runs of drawdown below ``trigger`` with depth and trough date."""
    keys = keys or []
    r = runs(df.withColumn("__in", F.col(dd) < trigger), "__in", keys, date, "episode")
    return r.groupBy(*keys, "episode").agg(
        F.min(date).alias("start"), F.max(date).alias("end"), F.count(F.lit(1)).alias("n"), F.min(dd).alias("depth"), F.min_by(date, dd).alias("trough")
    )


def touch_summary(df: DataFrame, flag: str, key: str, order: str) -> DataFrame:
    """Rising edges per key: count, first and last position."""
    w = Window.partitionBy(key).orderBy(order)
    start = F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))
    d = df.withColumn("__s", start)
    return d.groupBy(key).agg(
        F.count_if("__s").alias("touches"), F.min(F.when(F.col("__s"), F.col(order))).alias("first_touch"), F.max(F.when(F.col("__s"), F.col(order))).alias("last_touch")
    )


def sharpe(ret: str | Column, periods: int, ddof: int = 1) -> Column:
    """Annualised mean over deviation; NULL without spread."""
    x = col(ret)
    sd = F.stddev_samp(x) if ddof == 1 else F.stddev_pop(x)
    return F.try_divide(F.avg(x), F.when(sd > 0, sd)) * (periods**0.5)


def cagr(ret: str | Column, periods: int) -> Column:
    """Compound growth per year from rows/periods years."""
    x = col(ret)
    return F.exp(F.sum(F.log1p(x)) * periods / F.count(x)) - 1


def cagr_calendar(ret: str | Column, date: str) -> Column:
    """Compound growth per year from calendar days / 365.25."""
    return F.exp(F.sum(F.log1p(col(ret))) * 365.25 / F.datediff(F.max(date), F.min(date))) - 1


def drawdown(df: DataFrame, ret: str, keys: list[str], order: str, convention: str = "simple", out: str = "dd") -> DataFrame:
    """Drawdown column. ``simple``: compounded wealth; ``additive``: running sum; ``log``: exp of summed log returns.

    The running peak starts at the first row, so a first-row loss is not a drawdown.
    """
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(order)
    step = F.log1p(ret) if convention == "simple" else F.col(ret)
    df = df.withColumn("__lw", F.sum(step).over(w))
    gap = F.col("__lw") - F.max("__lw").over(w)
    return df.withColumn(out, gap if convention == "additive" else F.exp(gap) - 1).drop("__lw")


def beta_parity(y: str, x: str) -> Column:
    """Sample covariance over population variance."""
    return F.covar_samp(y, x) / F.var_pop(x)


def alpha_t(y: str, x: str) -> Column:
    """t statistic of the regression intercept, from moments only."""
    n = F.count(F.lit(1))
    b, a = F.regr_slope(y, x), F.regr_intercept(y, x)
    sse = F.regr_syy(y, x) - b * b * F.regr_sxx(y, x)
    se = F.sqrt(sse / (n - 2) * (F.lit(1.0) / n + F.avg(x) * F.avg(x) / F.regr_sxx(y, x)))
    return a / se


def profit_factor(x: str | Column) -> Column:
    x = col(x)
    return F.try_divide(F.sum(F.when(x > 0, x)), -F.sum(F.when(x < 0, x)))


def trade_metrics(net: str | Column, risk: str | Column | None = None) -> dict[str, Column]:
    x = col(net)
    out = {
        "n": F.count(x),
        "win_rate": F.avg((x > 0).cast("double")),
        "mean_net": F.avg(x),
        "profit_factor": profit_factor(x),
    }
    if risk is not None:
        out["mean_r"] = F.avg(F.try_divide(x, col(risk)))
    return out


def concentration(df: DataFrame, group: str, value: str, top: int = 3) -> DataFrame:
    """Share of the total in the best ``top`` groups, group signs and the mean without them (one row)."""
    g = df.groupBy(group).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("m"))
    best = g.orderBy(F.col("s").desc(), group).limit(top).agg(F.sum("s").alias("top_s"), F.sum("m").alias("top_m"))
    tot = g.agg(F.sum("s").alias("s"), F.sum("m").alias("m"), F.count_if(F.col("s") > 0).alias("n_pos"), F.count_if(F.col("s") < 0).alias("n_neg"))
    both = tot.crossJoin(best)  # one row each
    return both.select(
        F.try_divide(F.col("top_s"), F.col("s")).alias("top_share"), "n_pos", "n_neg",
        F.try_divide(F.col("s") - F.col("top_s"), F.col("m") - F.col("top_m")).alias("mean_ex_top"),
    )


def forecast_skill(actual: str, pred: str, base: str) -> dict[str, Column]:
    """Correlation, RMSE, R2 against the mean and skill against a baseline in one aggregation."""
    a, p, b = F.col(actual), F.col(pred), F.col(base)
    sse = F.sum((a - p) * (a - p))
    n = F.count(a)
    return {
        "n": n,
        "corr": F.corr(a, p),
        "rmse": F.sqrt(sse / n),
        "r2_vs_mean": 1 - sse / (F.var_pop(a) * n),
        "skill_vs_base": 1 - sse / F.sum((a - b) * (a - b)),
    }
