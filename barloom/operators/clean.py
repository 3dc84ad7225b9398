"""Cleaning, gates and row filters over long panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import clip, col
from .clock import Clock


def wick_repair(df: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Pull a low/high that is absurdly far from the candle body back to the body."""
    bottom, top = F.least("open", "close"), F.greatest("open", "close")
    return df.withColumns(
        {
            "low": F.when(F.col("low") < bottom * ratio, bottom).otherwise(F.col("low")),
            "high": F.when(F.col("high") > top / ratio, top).otherwise(F.col("high")),
        }
    )


def wick_clamp(df: DataFrame, close: str = "close", lower: float = 0.5, upper: float = 2.0) -> DataFrame:
    """Keep low in [lower*close, close] and high in [close, upper*close]."""
    c = F.col(close)
    return df.withColumns({"low": clip("low", c * lower, c), "high": clip("high", c, c * upper)})


def winsorise(x: str | Column, cap: float = 0.6) -> Column:
    return clip(x, -cap, cap)


def series_quality(df: DataFrame, key: str = "code", ret: str = "lret") -> DataFrame:
    """Per series: observations and largest absolute return."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_obs"), F.max(F.abs(ret)).alias("max_abs_ret"))


def quality_gate(df: DataFrame, min_obs: int, max_abs_ret: float, key: str = "code", ret: str = "lret") -> DataFrame:
    """Rows of series that are long enough and free of glitches.

    Uses the whole history of each series, so it looks ahead by design; see the causal form below.
    """
    good = series_quality(df, key, ret).where((F.col("n_obs") >= min_obs) & (F.col("max_abs_ret") <= max_abs_ret))
    return df.join(good.select(key), key, "left_semi")


def causal_quality_gate(df: DataFrame, min_obs: int, max_abs_ret: float, key: str = "code", ret: str = "lret", pos: str = "pos") -> DataFrame:
    """As ``quality_gate`` but judged at each row on rows up to it."""
    w = Clock(key, pos).to_date()
    ok = (F.count(F.lit(1)).over(w) >= min_obs) & (F.max(F.abs(ret)).over(w) <= max_abs_ret)
    return df.withColumn("__ok", ok).where("__ok").drop("__ok")


def bad_print_flags(df: DataFrame, thr: float, resid: float, calm: float, key: str = "code", ret: str = "lret", pos: str = "pos") -> DataFrame:
    """Adds ``bad_print`` (large move reversed next bar) and ``iso_step`` (large move with calm neighbours)."""
    clock = Clock(key, pos)
    r, nxt, prv = F.col(ret), clock.at(ret, 1), clock.at(ret, -1)
    return df.withColumns(
        {
            "bad_print": F.coalesce((F.abs(r) > thr) & (F.abs(r + nxt) < resid), F.lit(False)),
            "iso_step": F.coalesce((F.abs(r) > thr) & (F.abs(prv) < calm) & (F.abs(nxt) < calm), F.lit(False)),
        }
    )


def clean_universe(flags: DataFrame, max_bad: int, max_steps: int, key: str = "code") -> DataFrame:
    """Per series counts and the kept/dropped verdict."""
    return (
        flags.groupBy(key)
        .agg(F.count_if("bad_print").alias("n_bad"), F.count_if("iso_step").alias("n_steps"))
        .withColumn("kept", (F.col("n_bad") <= max_bad) & (F.col("n_steps") <= max_steps))
    )


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Deduplicate on ``keys`` keeping the row with the greatest ``order``.

    An aggregate rather than a row_number window: duplicates collapse map-side, so a key that is
    repeated in a large share of the rows never reaches one task whole.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.col(order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, "__row.*")


def ever_true(df: DataFrame, flag: str, key: str = "code") -> DataFrame:
    """Rows of keys whose flag is true at least once."""
    return df.join(df.where(flag).select(key).distinct(), key, "left_semi")


def stale_or_pinned(df: DataFrame, as_of: Column, max_age: int = 7, tail: int = 40, min_range: float = 0.03,
                    key: str = "code", date: str = "date", price: str = "close") -> DataFrame:
    """Per series: last date, relative range over its last ``tail`` bars and the drop verdict."""
    w = Window.partitionBy(key).orderBy(F.col(date).desc())
    last = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= tail)
    return (
        last.groupBy(key)
        .agg(
            F.max(date).alias("last_date"),
            ((F.max(price) - F.min(price)) / F.avg(price)).alias("rel_range"),
        )
        .withColumn("dropped", (F.datediff(as_of, "last_date") > max_age) | (F.col("rel_range") < min_range))
    )


def contiguous_prefix(df: DataFrame, slot: str, keys: list[str], first_slot: int, min_bars: int) -> DataFrame:
    """Bars of each session from its opening slot up to the first missing slot.

    ``slot`` is an integer slot number. The prefix holds exactly where slot = first + row_number - 1.
    """
    w = Window.partitionBy(*keys).orderBy(slot)
    out = df.where(F.col(slot) >= first_slot).withColumn("bar_no", F.row_number().over(w) - 1)
    out = out.where(F.col(slot) == F.col("bar_no") + first_slot)
    return out.withColumn("n_bars", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("n_bars") >= min_bars)


def split_parts(df: DataFrame, parts: int, order: list[str], out: str = "part") -> DataFrame:
    """Contiguous equal parts by row order of a book-level (one row per date) frame."""
    return df.withColumn(out, F.ntile(parts).over(Window.orderBy(*order)))


def alternate_halves(df: DataFrame, key: str = "code", out: str = "half") -> DataFrame:
    """Even / odd instruments by sorted key, as two replications.

    The ordinal comes from one row per key, never from ranking the full panel in one task.
    """
    keys = df.select(key).distinct()
    ordinal = range_ordinal(keys, key)
    return df.join(ordinal.withColumn(out, F.col("__ord") % 2).drop("__ord"), key)


def range_ordinal(df: DataFrame, key: str, out: str = "__ord") -> DataFrame:
    """0-based global position of unique keys without a single-task window.

    Rows are range-partitioned by key; per-partition counts (one row per partition) are turned into
    offsets and added to the position inside the partition.
    """
    parts = df.repartitionByRange(key).withColumn("__p", F.spark_partition_id())
    local = parts.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(key)) - 1)
    # the bucket is identified by data (its smallest key), so the two reads of the plan need not agree on ids
    return _global_offset(local, key, out)


def _global_offset(local: DataFrame, key: str, out: str) -> DataFrame:
    from ..session import materialise

    local = materialise(local)
    counts = local.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__p", before.alias("__off"))
    return local.join(offsets, "__p").withColumn(out, F.col("__i") + F.col("__off")).drop("__p", "__i", "__off")


def time_quantile_split(df: DataFrame, date: str = "date", frac: float = 0.6, out: str = "is_train") -> DataFrame:
    """Train flag: date at or before the ``frac`` quantile of all row dates.

    Row counts per date are small and exact, so the cut is read from the cumulative count instead of
    pooling every row into one percentile buffer.
    """
    per_day = df.groupBy(date).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(date)
    per_day = per_day.withColumns(
        {"hi": F.sum("n").over(w) - 1, "total": F.sum("n").over(Window.partitionBy())}
    ).withColumn("lo", F.col("hi") - F.col("n") + 1)
    at = (F.col("total") - 1) * F.lit(frac)
    k, k1 = F.floor(at), F.ceil(at)
    day = F.unix_date(date)
    cut = per_day.agg(
        F.max(F.when((F.col("lo") <= k) & (k <= F.col("hi")), day)).alias("d0"),
        F.max(F.when((F.col("lo") <= k1) & (k1 <= F.col("hi")), day)).alias("d1"),
        F.max(at - k).alias("w"),
    ).select((F.col("d0") + (F.col("d1") - F.col("d0")) * F.col("w")).alias("__cut"))
    return df.join(F.broadcast(cut)).withColumn(out, F.unix_date(date) <= F.col("__cut")).drop("__cut")


def era_of(date: str | Column, eras: list[tuple[str, str, str]]) -> Column:
    """Label of the first [lo, hi] era holding the date; a literal CASE, no range join."""
    d, out = col(date), F.lit(None).cast("string")
    for name, lo, hi in reversed(eras):
        out = F.when(d.between(F.lit(lo).cast("date"), F.lit(hi).cast("date")), F.lit(name)).otherwise(out)
    return out
