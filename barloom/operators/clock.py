"""Integer clocks and gap-aware frames.

Rolling operators of the panel are defined on a union calendar on which an instrument may be missing.
Instead of building the dense date x instrument grid, frames here are RANGE frames over an integer
clock: a frame of n steps covers exactly n clock ticks, and comparing ``count`` with n detects gaps.
The same code serves two clocks: the instrument's own bar number, and the shared calendar index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.columns import col


def with_position(df: DataFrame, keys, order, out: str = "pos") -> DataFrame:
    """0-based row number per key: the bar clock."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w) - 1)


def calendar(dates: DataFrame, date: str = "date", out: str = "cal") -> DataFrame:
    """Union calendar: each distinct date and its 0-based position.

    One row per date, so the global window sees at most a few tens of thousands of rows.
    """
    return dates.select(date).distinct().withColumn(out, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(date)) - 1)


def with_calendar(df: DataFrame, days: DataFrame, date: str = "date") -> DataFrame:
    """Attach calendar positions. Build ``days`` from the cheapest table that has the dates, not from a derived panel."""
    return df.join(days, date)


class Clock:
    """Window factory over ``keys`` ordered by the integer column ``pos``."""

    def __init__(self, keys, pos: str = "pos"):
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.pos = pos

    @property
    def ordered(self) -> WindowSpec:
        # built on use: a window needs a running session, a clock may be a module constant
        return Window.partitionBy(*self.keys).orderBy(self.pos)

    def back(self, n: int, lag: int = 0) -> WindowSpec:
        """The last ``n`` ticks, ending ``lag`` ticks ago."""
        return self.ordered.rangeBetween(-(n - 1 + lag), -lag)

    def ahead(self, lo: int, hi: int) -> WindowSpec:
        return self.ordered.rangeBetween(lo, hi)

    def to_date(self, lag: int = 0) -> WindowSpec:
        return self.ordered.rangeBetween(Window.unboundedPreceding, -lag)

    def at(self, x: str | Column, step: int) -> Column:
        """Value exactly ``step`` ticks away; NULL when the instrument has no row there."""
        return F.max(col(x)).over(self.ordered.rangeBetween(step, step))

    def full(self, agg: Callable[[Column], Column], x: str | Column, n: int, lag: int = 0, min_obs: int | None = None) -> Column:
        """Rolling aggregate that is NULL until ``min_obs`` (default ``n``) values are present."""
        x, w = col(x), self.back(n, lag)
        return F.when(F.count(x).over(w) >= (min_obs or n), agg(x).over(w))

    def full_ahead(self, agg: Callable[[Column], Column], x: str | Column, horizon: int) -> Column:
        """Aggregate of the next ``horizon`` ticks only, NULL when any is missing."""
        x, w = col(x), self.ahead(1, horizon)
        return F.when(F.count(x).over(w) == horizon, agg(x).over(w))

    def running_sum(self, x: str | Column) -> Column:
        return F.sum(col(x)).over(self.to_date())
