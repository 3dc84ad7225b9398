"""Convex-hull trend lines, breakout signals and trades per instrument.

Support is the lower hull of log lows from the running minimum rightwards, resistance the upper hull of
log highs from the running maximum. Both are kept incrementally while walking the bars, so the structure
known before each bar costs amortised constant time instead of a new hull per bar. The walk is a small
per-instrument helper on groups bounded by the calendar; Spark spreads instruments and parameter rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class RunningHull:
    """Lower hull of a growing series, restarted at every new minimum."""

    def __init__(self) -> None:
        self.x: list[int] = []
        self.y: list[float] = []

    def add(self, i: int, v: float) -> None:
        x, y = self.x, self.y
        if y and v < y[0]:
            x.clear()
            y.clear()
        while len(x) > 1:
            x0, y0 = x[-2], y[-2]
            # drop the middle vertex unless the path turns left through it
            if (y[-1] - y0) * (i - x0) < (v - y0) * (x[-1] - x0):
                break
            x.pop()
            y.pop()
        x.append(i)
        y.append(v)

    def line(self, min_span: int) -> tuple[int, int, float, float] | None:
        """Most recent edge spanning at least ``min_span`` bars: (a, b, value at a, slope)."""
        for k in range(len(self.x) - 1, 0, -1):
            a, b = self.x[k - 1], self.x[k]
            if b - a >= min_span:
                return a, b, self.y[k - 1], (self.y[k] - self.y[k - 1]) / (b - a)
        return None


def hull_edges(values: np.ndarray) -> list[tuple[int, int]]:
    """All edges of the lower hull of ``values``."""
    h = RunningHull()
    for i, v in enumerate(values):
        h.add(i, v)
    return list(zip(h.x, h.x[1:]))


def _lines(values: list[float], min_span: int) -> list[tuple | None]:
    """For each value RunningHull.line() of the values before it."""
    h, out, line = RunningHull(), [], None
    for i, v in enumerate(values):
        out.append(line)
        h.add(i, v)
        line = h.line(min_span)
    return out


def prior_lines(low: np.ndarray, high: np.ndarray, min_span: int) -> list[tuple]:
    """For each bar, the support and resistance line known from strictly earlier bars (log space)."""
    sup, res = _lines(np.log(low).tolist(), min_span), _lines((-np.log(high)).tolist(), min_span)
    return [(s, (r[0], r[1], -r[2], -r[3]) if r else None) for s, r in zip(sup, res, strict=True)]


def candidates(lines: list[tuple], low: np.ndarray, high: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Bars that may pass the first test of breakout_at(): all of its, and some that miss it by rounding."""
    nan = (math.nan,) * 4
    at = np.arange(len(lines))
    sup, res = (np.array([x[k] or nan for x in lines], float).reshape(-1, 4) for k in (0, 1))
    level_of = lambda x: np.exp(x[:, 2] + x[:, 3] * (at - x[:, 0]))
    slack = band - 1e-9 * (np.abs(high) + np.abs(low) + np.abs(band))
    with np.errstate(invalid="ignore", over="ignore"):
        s, r = level_of(sup), level_of(res)
        # what isn't surely below the band (an overflow, too) is left to breakout_at()
        known = ~np.isnan(sup[:, 0]) & ~np.isnan(res[:, 0])
        return known & ~((high - r <= slack - 1e-9 * r) & (s - low <= slack - 1e-9 * s))


def ray(line: tuple, at) -> np.ndarray:
    return np.exp(line[2] + line[3] * (np.asarray(at, float) - line[0]))


def level(line: tuple, at: int) -> float:
    return math.exp(line[2] + line[3] * (at - line[0]))


def touches(values: np.ndarray, line: tuple, band: np.ndarray, end: int) -> tuple[int, int, int]:
    """Episodes of ``values`` within ``band`` of the ray over [line start, end): count, first, last start."""
    a = line[0]
    near = np.abs(values[a:end] - ray(line, np.arange(a, end))) <= band[a:end]
    starts = np.flatnonzero(near & ~np.r_[False, near[:-1]]) + a
    return (len(starts), int(starts[0]), int(starts[-1])) if len(starts) else (0, -1, -1)


def breakout_at(i: int, lines: list, low, high, band, min_touches: int):
    """Direction and lines of a breakout on bar ``i``, LONG checked first; None without one."""
    sup, res = lines[i]
    if sup is None or res is None:
        return None
    for direction, action, safety, series, gap in (
        ("LONG", res, sup, high, high[i] - level(res, i)),
        ("SHORT", sup, res, low, level(sup, i) - low[i]),
    ):
        if gap > band[i]:  # the cheap test first: most bars break nothing
            n = touches(series, action, band, i)
            if n[0] >= min_touches:
                return direction, action, safety, n, gap
    return None


def bands(atr: np.ndarray, k: float) -> np.ndarray:
    """k*ATR with the leading gap filled from the first known value (it peeks inside the warm-up only)."""
    return pd.Series(k * atr).bfill().to_numpy()


TRADE_SCHEMA = (
    "signal_pos long, exit_pos long, entry_date date, exit_date date, direction string, entry double, exit double, days int, action_a long, action_b long, "
    "safety_a long, safety_b long, action_slope double, safety_slope double, separation double, touches int, touch_first long, touch_last long, "
    "safety_touches int, safety_touch_first long, safety_touch_last long, break_extent double, rel_volume double"
)
SIGNAL_SCHEMA = "signal_pos long, date date, direction string, action_a long, action_b long, safety_a long, safety_b long, touches int, break_extent double"


def _arrays(pdf: pd.DataFrame):
    return [pdf[c].to_numpy(float) for c in ("open", "high", "low", "close", "atr", "volume")]


def breakout_signals(df: DataFrame, keys: list[str], k: float = 0.5, min_touches: int = 3, min_span: int = 0, warmup: int = 60, pos: str = "pos") -> DataFrame:
    """Signal at every bar from data up to it."""
    schema = T.StructType([df.schema[x] for x in keys] + T.StructType.fromDDL(SIGNAL_SCHEMA).fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        _, high, low, _, atr, _ = _arrays(pdf)
        band, lines, rows = bands(atr, k), prior_lines(low, high, min_span), []
        dates = pdf["date"].to_numpy()
        for i in np.flatnonzero(candidates(lines, low, high, band)).tolist():
            hit = i >= warmup and breakout_at(i, lines, low, high, band, min_touches)
            if hit:
                d, act, saf, n, gap = hit
                rows.append((i, dates[i], d, act[0], act[1], saf[0], saf[1], n[0], gap / atr[i] if atr[i] > 0 else None))
        out = pd.DataFrame(rows, columns=[f.name for f in schema.fields[len(keys):]])
        for x in reversed(keys):
            out.insert(0, x, pdf[x].iloc[0])
        return out

    return df.select(*keys, pos, "date", "open", "high", "low", "close", "atr", "volume").groupBy(*keys).applyInPandas(run, schema)


def breakout_trades(df: DataFrame, keys: list[str], k: float = 0.5, min_touches: int = 3, min_span: int = 0, warmup: int = 60, stop_atr: float | None = 2.0, pos: str = "pos",
                    spans: dict[str, list[int]] | None = None) -> DataFrame:
    """One position at a time: next-open entry, stop ratcheting along the safety line, gap-aware fills.

    ``stop_atr`` sets the initial floor; ``None`` leaves the safety line alone. ``spans`` names a further
    key column and the minimum spans that it stands for; a series is read once for all of them.
    """
    axis, cells = next(iter(spans.items())) if spans else (None, [min_span])
    own = [T.StructField(axis, T.IntegerType())] if axis else []
    schema = T.StructType(own + [df.schema[x] for x in keys] + T.StructType.fromDDL(TRADE_SCHEMA).fields)

    def walk(series: list[np.ndarray], dates: np.ndarray, span: int) -> list[tuple]:
        opens, high, low, close, atr, vol = series
        band, lines, rows = bands(atr, k), prior_lines(low, high, span), []
        lows, highs = low.tolist(), high.tolist()
        n, free = len(close), warmup
        for i in np.flatnonzero(candidates(lines, low, high, band)).tolist():
            if i < free:  # a position is open
                continue
            if i >= n - 1:
                break
            hit = breakout_at(i, lines, low, high, band, min_touches)
            if not hit:
                continue
            direction, act, saf, tch, gap = hit
            up = direction == "LONG"
            sign, e = (1.0 if up else -1.0), i + 1
            # in signed prices both directions ratchet upwards
            stop = -np.inf if stop_atr is None else sign * opens[e] - stop_atr * atr[i]
            x, px = n - 1, close[-1]
            for j in range(e, n):
                safety = lines[j][0 if up else 1]
                if safety is not None:
                    stop = max(stop, sign * level(safety, j))
                worst = lows[j] if up else -highs[j]
                if worst <= stop:
                    x, px = j, sign * min(sign * opens[j], stop)
                    break
            base = np.median(vol[i - 20:i]) if i >= 20 else np.nan
            ts = touches(low if up else high, saf, band, i)
            rows.append((
                i, x, dates[e], dates[x], direction, opens[e], px, max(1, int((dates[x] - dates[e]) / np.timedelta64(1, "D"))),
                act[0], act[1], saf[0], saf[1], act[3], saf[3], abs(level(act, i) - level(saf, i)) / opens[e], *tch, *ts,
                gap / atr[i] if atr[i] > 0 else None, vol[i] / base if base > 0 else None,
            ))
            free = x + 1
        return rows

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        series, dates = _arrays(pdf), pd.to_datetime(pdf["date"]).to_numpy()
        first = [pdf[c].iloc[0] for c in keys]
        rows = [(*([span] if axis else []), *first, *r) for span in cells for r in walk(series, dates, span)]
        out = pd.DataFrame(rows, columns=schema.names)
        for c in ("entry_date", "exit_date"):
            out[c] = pd.to_datetime(out[c]).dt.date
        return out

    return df.select(*dict.fromkeys([*keys, pos, "date", "open", "high", "low", "close", "atr", "volume"])).groupBy(*keys).applyInPandas(run, schema)


def duration_features(trades: DataFrame) -> DataFrame:
    """Ages and spans of the action and safety lines and the log ratio of each pair (NULL unless both positive)."""
    s = F.col("signal_pos")

    def seen(last, value):
        return F.when(F.col(last) >= 0, value)

    pairs = {
        "span": (F.col("action_b") - F.col("action_a"), F.col("safety_b") - F.col("safety_a")),
        "age_a": (s - F.col("action_a"), s - F.col("safety_a")),
        "age_b": (s - F.col("action_b"), s - F.col("safety_b")),
        "touch_span": (seen("touch_last", F.col("touch_last") - F.col("touch_first")), seen("safety_touch_last", F.col("safety_touch_last") - F.col("safety_touch_first"))),
        "since_touch": (seen("touch_last", s - F.col("touch_last")), seen("safety_touch_last", s - F.col("safety_touch_last"))),
        "n_touch": (F.col("touches"), F.col("safety_touches")),
    }
    out = {}
    for name, (a, b) in pairs.items():
        out[f"{name}_action"], out[f"{name}_safety"] = a, b
        out[f"rel_{name}"] = F.when((a > 0) & (b > 0), F.log(a / b))
    return trades.withColumns(out)


def alignment(trades: DataFrame) -> DataFrame:
    """Slope of the older line in the trade's direction, and whether it agrees."""
    older = F.when(F.col("signal_pos") - F.col("action_a") >= F.col("signal_pos") - F.col("safety_a"), F.col("action_slope")).otherwise(F.col("safety_slope"))
    sign = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
    return trades.withColumns({"align_slope": sign * older, "aligned": (sign * F.signum(older) > 0)})
