"""Per-instrument rolling features as Column builders over a ``Clock``.

Every builder only reads ticks at or before the current one unless its name says ``forward``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import col, log_return
from .clock import Clock
from .orderstats import Quantiles, rolling_quantiles

ANNUAL = 252


def momentum(c: Clock, price: str, long: int, short: int) -> Column:
    """price[t-short] / price[t-long] - 1 (12-1 momentum with long=12, short=1)."""
    return F.try_divide(c.at(price, -short), c.at(price, -long)) - 1


def skip_sum(c: Clock, x: str, length: int, skip: int) -> Column:
    """Sum over ``length`` ticks ending ``skip`` ticks ago (daily momentum 231/21, reversal 1008/252)."""
    return c.full(F.sum, x, length, lag=skip)


def realised_vol(c: Clock, ret: str, n: int, scale: float = 100.0) -> Column:
    """sqrt(252 * mean squared return) over n ticks."""
    return F.sqrt(c.full(F.avg, F.col(ret) * F.col(ret), n) * ANNUAL) * scale


def forward_realised_vol(c: Clock, ret: str, horizon: int, scale: float = 100.0) -> Column:
    return F.sqrt(c.full_ahead(F.avg, F.col(ret) * F.col(ret), horizon) * ANNUAL) * scale


def forward_return(c: Clock, log_price: str, horizon: int) -> Column:
    return c.at(log_price, horizon) - F.col(log_price)


def vol_state(c: Clock, ret: str, short: int = 20, long: int = 100) -> Column:
    """Short over long deviation, known one tick earlier."""
    return F.try_divide(c.full(F.stddev_samp, ret, short, lag=1), c.full(F.stddev_samp, ret, long, lag=1))


def true_range(c: Clock, null_first: bool = False) -> Column:
    """Largest of high-low and the gaps to the previous close.

    ``null_first`` gives NULL on the first bar; otherwise the first bar uses high-low.
    """
    prev = c.at("close", -1)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    return F.when(prev.isNotNull(), tr) if null_first else tr


def zscore(c: Clock, x: str, n: int) -> Column:
    return F.try_divide(F.col(x) - c.full(F.avg, x, n), c.full(F.stddev_samp, x, n))


def reversion(c: Clock, ret: str, short: int, long: int) -> tuple[Column, Column]:
    """Long-run minus short-run mean return, and its z-score with the short-run standard error."""
    gap = c.full(F.avg, ret, long) - c.full(F.avg, ret, short)
    return gap, F.try_divide(gap, c.full(F.stddev_samp, ret, short) / F.sqrt(F.lit(float(short))))


def channel(df: DataFrame, c: Clock, log_price: str, n: int, k: float = 2.0) -> DataFrame:
    """Rolling least-squares line of log price on the clock: gradient, r2, sigma, bands at the last bar."""
    y, t = F.col(log_price), F.col(c.pos).cast("double")
    w = c.back(n)
    # the clock is an integer grid, so its own moments are constants and three sliding sums are enough
    full = F.count(y).over(w) == n
    df = df.withColumns({"__sy": F.when(full, F.sum(y).over(w)), "__syy": F.sum(y * y).over(w), "__sty": F.sum(t * y).over(w)})
    stt = n * (n * n - 1) / 12.0
    tm, ym = t - (n - 1) / 2.0, F.col("__sy") / n
    sty = F.col("__sty") - tm * F.col("__sy")
    syy = F.col("__syy") - ym * F.col("__sy")
    df = df.withColumns({"gradient": sty / stt, "__var": syy / n, "__m0": ym})
    fit = F.col("gradient") * F.col("gradient") * stt / n
    df = df.withColumn("r2", F.when(F.col("__var") > 0, fit / F.col("__var")).when(F.col("__var").isNotNull(), F.lit(1.0)))
    sigma = F.sqrt(F.greatest(F.col("__var") * (1 - F.col("r2")), F.lit(0.0)))
    mid = F.col("__m0") + F.col("gradient") * ((n - 1) / 2.0)
    df = df.withColumns({"sigma": F.when(F.col("r2").isNotNull(), sigma), "__mid": mid})
    return df.withColumns(
        {
            "mid": F.exp("__mid"),
            "upper": F.exp(F.col("__mid") + F.col("sigma") * k),
            "lower": F.exp(F.col("__mid") - F.col("sigma") * k),
            "annual_gradient": F.exp(F.col("gradient") * ANNUAL) - 1,
        }
    ).drop("__sy", "__syy", "__sty", "__var", "__m0", "__mid")


def drawdown_depth(c: Clock, log_price: str, n: int) -> Column:
    """Rolling max minus rolling min."""
    return c.full(F.max, log_price, n) - c.full(F.min, log_price, n)


def depth_in_vol(c: Clock, log_price: str, vol: Column, n: int) -> Column:
    """Distance below the rolling peak in units of vol * sqrt(n)."""
    return F.try_divide(c.full(F.max, log_price, n) - F.col(log_price), vol * F.sqrt(F.lit(float(n))))


def efficiency_ratio(c: Clock, x: str, n: int) -> Column:
    """Net move over path length on n increments, within [0, 1].

    Needs the increment column ``d_<x>`` (x minus its previous value) beside ``x``.
    """
    path = c.full(F.sum, F.abs(F.col(f"d_{x}")), n)
    return F.least(F.greatest(F.try_divide(F.abs(F.col(x) - c.at(x, -n)), path), F.lit(0.0)), F.lit(1.0))


def har(c: Clock, rv: str) -> dict[str, Column]:
    """Yesterday's value and the trailing 5- and 22-tick means, all lagged one tick."""
    return {
        "har_d": c.at(rv, -1),
        "har_w": c.full(F.avg, rv, 5, lag=1),
        "har_m": c.full(F.avg, rv, 22, lag=1),
    }


def vol_change(c: Clock, ret: str, short: int, long: int) -> tuple[Column, Column]:
    """Ratio of short to long deviation minus one, and the absolute log ratio."""
    r = F.try_divide(c.full(F.stddev_samp, ret, short), c.full(F.stddev_samp, ret, long))
    return r - 1, F.abs(F.log(r))


def rolling_quantile(df: DataFrame, c: Clock, x: str, n: int, probs: list[float], lag: int = 0, min_obs: int | None = None, out: str = "q") -> DataFrame:
    """Trailing quantiles as an array column (see orderstats)."""
    return rolling_quantiles(df, c, [Quantiles(out, x, n, tuple(probs), lag, min_obs)])


def relative_volume(df: DataFrame, c: Clock, volume: str, n: int = 20, out: str = "rel") -> DataFrame:
    """Volume over the median of the n previous ticks."""
    base = F.col("__q")[0]
    return rolling_quantile(df, c, volume, n, [0.5], lag=1, out="__q").withColumn(out, F.when(base > 0, F.col(volume) / base)).drop("__q")


def overnight_intraday(c: Clock) -> tuple[Column, Column]:
    """(log open - previous log close, log close - log open)."""
    return log_return("open", c.at("close", -1)), log_return("close", F.col("open"))


def corwin_schultz(df: DataFrame, c: Clock, n: int) -> DataFrame:
    """Trailing mean of the two-day high-low spread estimator, negatives clipped to zero."""
    # Fixed value: 3 - 2*sqrt(2) of the estimator.
    den = 3.0 - 2.0 * 2.0**0.5
    ph, pl = c.at("high", -1), c.at("low", -1)
    hl = F.log(F.col("high") / F.col("low"))
    df = df.withColumn("__h1", hl * hl)
    beta = F.col("__h1") + c.at("__h1", -1)
    two = F.log(F.greatest(F.col("high"), ph) / F.least(F.col("low"), pl))
    df = df.withColumns({"__b": beta, "__g": F.when(ph.isNotNull(), two * two)})
    alpha = (F.sqrt(F.col("__b") * 2) - F.sqrt("__b")) / den - F.sqrt(F.col("__g") / den)
    df = df.withColumn("__a", alpha)
    s = (F.exp("__a") - 1) * 2 / (F.exp("__a") + 1)
    df = df.withColumn("__s", F.when(F.col("__a").isNotNull(), F.greatest(s, F.lit(0.0))))
    return df.withColumn("cs_spread", c.full(F.avg, "__s", n)).drop("__h1", "__b", "__g", "__a", "__s")


def abdi_ranaldo(df: DataFrame, c: Clock, n: int) -> DataFrame:
    """Close-versus-midrange spread: 2 * sqrt of the mean of (c - mid)(c - next mid), clipped at zero."""
    df = df.withColumn("__m", (F.log("high") + F.log("low")) / 2)
    lc, lm = F.log(c.at("close", -1)), c.at("__m", -1)
    df = df.withColumn("__x", (lc - lm) * (lc - F.col("__m")))
    mean = c.full(F.avg, "__x", n)
    return df.withColumn("ar_spread", F.sqrt(F.greatest(mean, F.lit(0.0))) * 2 * F.when(mean.isNotNull(), 1)).drop("__m", "__x")


def log_wealth(ret: str | Column, c: Clock) -> Column:
    """Cumulative log of (1+r): equity in a form that neither overflows nor loses precision."""
    return c.running_sum(F.log1p(col(ret)))


def drift_by_prefix(df: DataFrame, c: Clock, ret: str, lengths: list[int]) -> DataFrame:
    """Mean return over several lookbacks from one running sum: O(1) per window length."""
    df = df.withColumn("__cs", c.running_sum(F.coalesce(F.col(ret), F.lit(0.0))))
    first = F.min(c.pos).over(Window.partitionBy(*c.keys))
    out = {}
    for n in lengths:
        base = F.coalesce(c.at("__cs", -n), F.when(F.col(c.pos) - n + 1 == first, F.lit(0.0)))
        out[f"drift_{n}"] = (F.col("__cs") - base) / n
    return df.withColumns(out).drop("__cs")


def slope_on_log_length(lengths: list[int]) -> Column:
    """Slope of the drift_N columns on log N (literal regressor, closed form)."""
    import math

    x = [math.log(n) for n in lengths]
    m = sum(x) / len(x)
    den = sum((v - m) ** 2 for v in x)
    return sum((F.col(f"drift_{n}") * F.lit((v - m) / den) for n, v in zip(lengths, x)), F.lit(0.0))
