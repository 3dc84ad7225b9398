"""Calendar resampling, compounding, quantile paths and grid neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, month_index, week_ending_friday


def compound(ret: str | Column) -> Column:
    """Product of (1+r) minus one as a mergeable aggregate; r <= -1 wipes the group out."""
    r = col(ret)
    return F.when(F.min(r) <= -1, F.lit(-1.0)).otherwise(F.exp(F.sum(F.when(r > -1, F.log1p(r)))) - 1)


def month_last(df: DataFrame, values: list[str], key: str = "code", date: str = "date") -> DataFrame:
    """Last non-null value of each column per calendar month."""
    aggs = [F.max_by(v, F.when(F.col(v).isNotNull(), F.col(date))).alias(v) for v in values]
    return df.groupBy(key, month_index(date).alias("mi")).agg(*aggs)


def week_last(df: DataFrame, value: str, key: str = "code", date: str = "date") -> DataFrame:
    return df.groupBy(key, week_ending_friday(date).alias("week")).agg(F.max_by(value, date).alias(value))


def phase_months(df: DataFrame, shifts: list[int], value: str, key: str = "code", date: str = "date") -> DataFrame:
    """Month-end resample after shifting the index by each number of days: the rebalance-phase test.

    The shift is an exploded literal column, so all phases run in one aggregation.
    """
    shifted = df.withColumn("shift", F.explode(F.array(*[F.lit(s) for s in shifts])))
    mi = month_index(F.date_sub(F.col(date), F.col("shift")))
    return shifted.groupBy("shift", key, mi.alias("mi")).agg(F.max_by(value, date).alias(value))


def with_grid(df: DataFrame, **axes: list) -> DataFrame:
    """Attach every combination of literal parameter values by exploding array literals."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def grid_neighbourhood(cells: DataFrame, axes: list[str], metric: str) -> DataFrame:
    """Min, max and mean of a metric over each cell's +-1 index neighbours.

    Every cell posts its metric to its (at most 3^d) neighbours and one aggregation collects them.
    """
    posted = cells
    for a in axes:
        posted = posted.withColumn(a, F.explode(F.array(F.col(a) - 1, F.col(a), F.col(a) + 1)))
    agg = posted.groupBy(*axes).agg(
        F.min(metric).alias("nb_min"), F.max(metric).alias("nb_max"), F.avg(metric).alias("nb_mean"), F.count(metric).alias("nb_n")
    )
    return cells.join(agg, axes)


def ohlc_session(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Session high, low and last close from intraday bars."""
    return df.groupBy(*keys).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", ts).alias("close"))
