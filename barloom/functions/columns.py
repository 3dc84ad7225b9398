"""Scalar column helpers: arithmetic, nulls, strings and dates."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix multipliers of abbreviated volumes.
UNIT_FACTORS = {"K": 1e3, "M": 1e6, "B": 1e9}


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r6(x: str | Column, places: int = 6) -> Column:
    """Output rounding, half up on the scaled binary value, so any engine with IEEE doubles agrees.

    The offset is a little above one half: exact ties then do not hang on the order of a sum.
    """
    scale = 10.0**places
    return F.floor(col(x) * scale + 0.5001) / scale


def r6_any(x: str | Column, places: int = 6) -> Column:
    """r6() that keeps NaN and infinities, which a floor to a whole number would turn into numbers."""
    x = col(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(r6(x, places))


def null_if_nan(x: str | Column) -> Column:
    """NaN and infinities become NULL, the only missing value used in panels."""
    x = col(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clip(x: str | Column, lo, hi) -> Column:
    """Clip that keeps NULL (``least``/``greatest`` alone would return the bound)."""
    x = col(x)
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(x.isNotNull(), F.greatest(F.least(x, hi), lo))


def ratio(num: str | Column, den: str | Column) -> Column:
    """NULL-safe division: a zero or missing denominator gives NULL."""
    return F.try_divide(col(num), col(den))


def ieee_ratio(num: str | Column, den: str | Column) -> Column:
    """Division of doubles as IEEE has it, without an error: x/0 is an infinity of the sign of x, 0/0 is NaN."""
    num, den = col(num), col(den)
    by_zero = F.when((num == 0) | F.isnan(num), float("nan")).when(num > 0, float("inf")).when(num < 0, float("-inf"))
    return F.when(den == 0, by_zero).otherwise(F.try_divide(num, den))


def stable_sum(x: str | Column) -> Column:
    """Sum of doubles that hangs on the order of the rows no more: whole 2**-20ths are added exactly, as longs.

    What is left of each value is below 2**-20, so the rounding of its sum lies far below the last bit of the total.
    Infinite, NaN and very large values are added as doubles.
    """
    x = col(x)
    fits = F.abs(x) < 2.0**30
    ticks = F.floor(F.when(fits, x) * 2.0**20)
    exact = F.coalesce(F.sum(ticks).cast("double") / 2.0**20, F.lit(0.0)) + F.coalesce(F.sum(F.when(fits, x) - ticks / 2.0**20), F.lit(0.0))
    return F.when(F.count(x) > 0, exact + F.coalesce(F.sum(F.when(~fits, x)), F.lit(0.0)))


def positive_ratio(num: str | Column, den: str | Column, same_unit: Column | None = None) -> Column:
    """Ratio factor that exists only for a positive denominator and matching units."""
    ok = col(den) > 0
    if same_unit is not None:
        ok = ok & same_unit
    return F.when(ok, ratio(num, den))


def norm_ppf(levels: list[float]) -> list[float]:
    """Standard normal quantiles for literal levels."""
    return [NormalDist().inv_cdf(p) for p in levels]


def locale_number(x: str | Column) -> Column:
    """``"14,216.0"`` -> 14216.0; anything unparsable is NULL."""
    clean = F.regexp_replace(F.trim(col(x)), "[,﻿\"]", "")
    return clean.try_cast("double")


def unit_number(x: str | Column) -> Column:
    """``"1.51M"`` -> 1510000.0, plain numbers pass through, bad text is NULL."""
    clean = F.upper(F.regexp_replace(F.trim(col(x)), ",", ""))
    suffix = F.regexp_extract(clean, "([KMB])$", 1)
    factor = F.lit(1.0)
    for unit, value in UNIT_FACTORS.items():
        factor = F.when(suffix == unit, F.lit(value)).otherwise(factor)
    return F.regexp_replace(clean, "[KMB]$", "").try_cast("double") * factor


def symbol_norm(x: str | Column) -> Column:
    """Upper-case ticker with dots mapped to dashes."""
    return F.translate(F.upper(F.trim(col(x))), ".", "-")


def slash_date(x: str | Column, day_first: Column) -> Column:
    """Parse ``dd/mm/yyyy`` or ``mm/dd/yyyy`` depending on ``day_first``; bad text is NULL."""
    parts = F.split(F.trim(col(x)), "[/-]")
    p = [F.try_element_at(parts, F.lit(i + 1)).try_cast("int") for i in range(3)]
    day = F.when(day_first, p[0]).otherwise(p[1])
    month = F.when(day_first, p[1]).otherwise(p[0])
    text = F.format_string("%04d-%02d-%02d", p[2], month, day)
    return F.when(p[2].isNotNull() & day.isNotNull() & month.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def month_index(d: str | Column) -> Column:
    """Months since year 0: the integer clock of monthly panels."""
    return (F.year(col(d)) * 12 + F.month(col(d)) - 1).cast("long")


def year_of(d: str | Column) -> Column:
    return F.year(col(d)).cast("long")


def month_end(mi: str | Column) -> Column:
    """Last calendar day of a month index."""
    mi = col(mi)
    return F.last_day(F.make_date(F.floor(mi / 12).cast("int"), (mi % 12).cast("int") + 1, F.lit(1)))


def week_ending_friday(d: str | Column) -> Column:
    return F.next_day(F.date_sub(col(d), 1), "FRI")


def log_return(x: str | Column, prev: Column) -> Column:
    return F.when((col(x) > 0) & (prev > 0), F.log(col(x) / prev))


def signed_return(direction: str | Column, entry: str | Column, exit_: str | Column) -> Column:
    """Gross fractional return of a LONG or SHORT trade."""
    gross = (col(exit_) - col(entry)) / col(entry)
    return F.when(F.upper(col(direction)) == "SHORT", -gross).otherwise(gross)


def trade_net(direction, entry, exit_, days, spread_bps, financing, gross: str | Column | None = None) -> Column:
    """Signed gross return (``gross``, if it is known) less two spread payments and pro-rata financing."""
    return (signed_return(direction, entry, exit_) if gross is None else col(gross)) - col(spread_bps) * 2 / 1e4 - col(financing) * col(days) / 365


# Candle geometry over columns named open/high/low/close.
def body(p: str = "") -> Column:
    return F.abs(F.col(p + "close") - F.col(p + "open"))


def candle_range(p: str = "") -> Column:
    return F.col(p + "high") - F.col(p + "low")


def upper_wick(p: str = "") -> Column:
    return F.col(p + "high") - F.greatest(F.col(p + "open"), F.col(p + "close"))


def lower_wick(p: str = "") -> Column:
    return F.least(F.col(p + "open"), F.col(p + "close")) - F.col(p + "low")


def bullish(p: str = "") -> Column:
    return F.col(p + "close") > F.col(p + "open")
