"""First-passage and event-study operators: candles, opening ranges, fades, channel trades, forward lookups.

Sessions have at most one row per intraday slot and instruments one row per calendar tick, so the few
sequential walks below run on groups bounded by the session or the calendar.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import columns as fc
from .clock import Clock


def candle_flags(df: DataFrame, keys: list[str], order: str, wick_body: float = 2.0, wick_min: float = 0.5, opp_max: float = 0.10) -> DataFrame:
    """Adds star, hammer, bear_engulf, bull_engulf for each bar."""
    w = Window.partitionBy(*keys).orderBy(order)
    rng, bull = fc.candle_range(), fc.bullish()
    up, dn, body = fc.upper_wick(), fc.lower_wick(), fc.body()

    def rejection(long_wick, other):
        return (rng > 0) & (long_wick >= body * wick_body) & (long_wick >= rng * wick_min) & (other <= rng * opp_max)

    prev_bull = F.lag(bull).over(w)
    covers = (F.col("high") >= F.lag("high").over(w)) & (F.col("low") <= F.lag("low").over(w))
    return df.withColumns(
        {
            "star": ~bull & rejection(up, dn),
            "hammer": bull & rejection(dn, up),
            "bear_engulf": F.coalesce(prev_bull & ~bull & covers, F.lit(False)),
            "bull_engulf": F.coalesce(~prev_bull & bull & covers, F.lit(False)),
        }
    )


def opening_box(df: DataFrame, keys: list[str], bars: int = 3, order: str = "bar_no") -> DataFrame:
    """High, low and direction of the first ``bars`` bars of each session."""
    head = df.where(F.col(order) < bars)
    return head.groupBy(*keys).agg(
        F.max("high").alias("box_hi"), F.min("low").alias("box_lo"),
        (F.max_by("close", order) > F.min_by("open", order)).alias("box_up"),
    )


def opening_breakout(df: DataFrame, keys: list[str], bars: int = 3, box_bars: int = 15, hold: str = "box_end", order: str = "bar_no") -> DataFrame:
    """Follow the first touch of either box edge; stop at the other edge; exit at the box or session end.

    Everything is window aggregates over one (instrument, session) partitioning: one shuffle in all.
    Entered at a price of zero, a trade has infinite or undefined returns, as IEEE division gives them.
    """
    s = Window.partitionBy(*keys)
    b, o, h, lo, c = F.col(order), F.col("open"), F.col("high"), F.col("low"), F.col("close")
    d = df.withColumns(
        {
            "hi": F.max(F.when(b < bars, h)).over(s),
            "lo_": F.min(F.when(b < bars, lo)).over(s),
            "last": F.max(order).over(s),
        }
    ).withColumn("box_last", F.least(F.col("last"), F.lit(bars + box_bars - 1)))
    up, dn = h >= F.col("hi"), lo <= F.col("lo_")
    touch = b.between(F.lit(bars), F.col("box_last")) & (up | dn)
    d = d.withColumn("ei", F.min(F.when(touch, b)).over(s)).where("ei IS NOT NULL")
    long_ = F.when(up & dn, c >= o).otherwise(up)
    fill = F.when(long_, F.greatest(o, F.col("hi"))).otherwise(F.least(o, F.col("lo_")))
    at_entry = b == F.col("ei")
    d = d.withColumns({"long": F.max(F.when(at_entry, long_)).over(s), "entry": F.max(F.when(at_entry, fill)).over(s)})
    d = d.withColumn("stop", F.when(F.col("long"), F.col("lo_")).otherwise(F.col("hi")))
    d = d.withColumn("end", F.col("box_last") if hold == "box_end" else F.col("last"))
    live = b.between(F.col("ei"), F.col("end"))
    hit = live & F.when(F.col("long"), lo <= F.col("stop")).otherwise(h >= F.col("stop"))
    d = d.withColumn("si", F.min(F.when(hit, b)).over(s))
    sign = F.when(F.col("long"), 1.0).otherwise(-1.0)
    inside = b.between(F.col("ei"), F.coalesce("si", "end"))
    adverse = F.when(F.col("long"), lo).otherwise(h)
    favour = F.when(F.col("long"), h).otherwise(lo)

    def signed(px):
        return fc.ieee_ratio((px - F.col("entry")) * sign, "entry")

    out = d.groupBy(*keys).agg(
        F.first("hi").alias("box_hi"), F.first("lo_").alias("box_lo"), F.first("ei").alias("entry_bar"), F.first("long").alias("long"),
        F.first("entry").alias("entry"), F.first("stop").alias("stop"), F.first(F.coalesce("si", "end")).alias("exit_bar"),
        F.first(F.col("si").isNotNull()).alias("stopped"),
        F.max(F.when(b == F.col("end"), c)).alias("end_close"),
        F.max(F.when(inside, F.greatest(-signed(adverse), F.lit(0.0)))).alias("mae"),
        F.max(F.when(inside, F.greatest(signed(favour), F.lit(0.0)))).alias("mfe"),
    )
    out = out.withColumn("exit", F.when(F.col("stopped"), F.col("stop")).otherwise(F.col("end_close"))).drop("end_close")
    gain = F.when(F.col("long"), F.col("exit") - F.col("entry")).otherwise(F.col("entry") - F.col("exit"))
    out = out.withColumns({"risk": fc.ieee_ratio(F.abs(F.col("stop") - F.col("entry")), "entry"), "gross": fc.ieee_ratio(gain, "entry")})
    return out.where("risk > 0")


def non_overlapping(trades: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Greedy chain of candidate trades per key: the next one starts after the previous has ended.

    Runs on candidate rows only (one per signal), never on the bars.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(start)
        keep, free = [], None
        for s, e in zip(pdf[start], pdf[end]):
            ok = free is None or s > free
            keep.append(ok)
            free = e if ok else free
        return pdf[keep]

    return trades.groupBy(*keys).applyInPandas(run, trades.schema)


def zscore_fades(df: DataFrame, z: str, keys: list[str], pos: str = "pos", enter: float = 2.0, stop: float = 3.5, max_hold: int = 10, warmup: int = 100,
                 fixed_hold: bool = False, gate: Column | None = None) -> DataFrame:
    """Enter at the next open against a stretched z-score; leave at reversion, blow-out or after ``max_hold`` bars.

    With ``fixed_hold`` the exit is always ``max_hold`` bars after entry; ``gate`` restricts the signals.
    """
    c = Clock(keys, pos)
    horizon = c.ahead(1, max_hold + 1)
    last = F.max(pos).over(Window.partitionBy(*keys))
    d = df.withColumns(
        {
            "__path": F.collect_list(F.struct(F.col(pos).alias("i"), F.col(z).alias("z"), F.col("close").alias("c"), F.col("date").alias("d"))).over(horizon),
            "entry": c.at("open", 1),
            "entry_date": c.at("date", 1),
            "__last": last,
        }
    )
    sig = (F.abs(z) >= enter) & (F.col(pos) >= warmup) & (F.col(pos) < F.col("__last"))
    d = d.where(sig & gate if gate is not None else sig)
    long_ = F.col(z) <= -enter
    if fixed_hold:
        leave = F.element_at("__path", -1)
    else:
        done = F.filter("__path", lambda p: F.when(long_, (p["z"] >= 0) | (p["z"] <= -stop)).otherwise((p["z"] <= 0) | (p["z"] >= stop)))
        leave = F.coalesce(F.try_element_at(done, F.lit(1)), F.element_at("__path", -1))
    d = d.withColumns({"__x": leave, "direction": F.when(long_, "LONG").otherwise("SHORT")})
    out = d.select(
        *keys, F.col(pos).alias("signal_pos"), "entry_date", F.col("__x.d").alias("exit_date"), F.col("__x.i").alias("exit_pos"), "direction", "entry", F.col("__x.c").alias("exit")
    )
    out = non_overlapping(out, keys, "signal_pos", "exit_pos")
    days = F.greatest(F.lit(1), F.datediff("exit_date", "entry_date"))
    return out.withColumns({"days": days, "gross": fc.signed_return("direction", "entry", "exit")})


def channel_trades(df: DataFrame, keys: list[str], pos: str = "pos", g_min: float = 0.10, r2_min: float | None = None, frac: float = 0.25,
                   exit_rule: str = "top", break_frac: float = 0.0, entry_gate: Column | None = None) -> DataFrame:
    """Channel trades whose exit does not depend on the entry: buy near the lower band, leave at the band or on a break.

    ``top``: gradient below zero or close in the top quarter; ``break``: close below the lower band by
    ``break_frac`` widths; ``touch``: top, below the band, or gradient below zero. The exit bar is the next
    row meeting the rule (one reverse running minimum), so only the greedy chain is sequential.
    Positions are opened and closed on the following bar.
    """
    c = Clock(keys, pos)
    w = F.col("upper") - F.col("lower")
    px, grad = F.col("close"), F.col("annual_gradient")
    enter = (grad >= g_min) & (w > 0) & (px <= F.col("lower") + w * frac)
    if r2_min is not None:
        enter = enter & (F.col("r2") >= r2_min)
    if entry_gate is not None:
        enter = enter & entry_gate
    near_top = px >= F.col("upper") - w * frac
    rule = {"top": (grad < 0) | near_top, "break": px < F.col("lower") - w * break_frac, "touch": near_top | (px < F.col("lower")) | (grad < 0)}[exit_rule]
    last = F.max(pos).over(Window.partitionBy(*keys))
    nxt = Window.partitionBy(*keys).orderBy(pos).rowsBetween(1, Window.unboundedFollowing)
    d = df.withColumns({"__last": last, "__rule": F.coalesce(rule, F.lit(False)) & (F.col(pos) < last)})
    d = d.withColumns(
        {
            "__x": F.min(F.when(F.col("__rule"), F.col(pos))).over(nxt),
            "entry": c.at("open", 1),
            "entry_date": c.at("date", 1),
        }
    ).where(enter & (F.col(pos) < F.col("__last")))
    out = d.select(*keys, F.col(pos).alias("signal_pos"), F.coalesce(F.col("__x"), F.col("__last")).alias("exit_signal_pos"),
                   F.least(F.coalesce(F.col("__x") + 1, F.col("__last")), F.col("__last")).alias("exit_pos"), F.col("__x").isNull().alias("open_end"),
                   "entry_date", "entry", grad.alias("grad"))
    out = non_overlapping(out, keys, "signal_pos", "exit_signal_pos")
    bars = df.select(*keys, F.col(pos).alias("exit_pos"), F.col("date").alias("exit_date"), F.col("open").alias("__o"), F.col("close").alias("__c"))
    out = out.join(bars, [*keys, "exit_pos"])
    return out.withColumn("exit", F.when(F.col("open_end"), F.col("__c")).otherwise(F.col("__o"))).drop("__o", "__c")


RATCHET_SCHEMA = "signal_pos long, exit_pos long, entry double, exit double, grad double"


def channel_ratchet(df: DataFrame, keys: list[str], mode: str, pos: str = "pos", g_min: float = 0.10, frac: float = 0.25, arm: float = 0.25,
                    stop_frac: float = 0.5, m_atr: float = 3.0) -> DataFrame:
    """Channel trades with a stop that only rises after entry: ``width`` (band-based, once armed) or ``atr`` (from the peak close).

    A trade still open at the end leaves at the last open, as all other fills do.
    """
    schema = T.StructType([df.schema[k] for k in keys] + T.StructType.fromDDL(RATCHET_SCHEMA).fields)
    cols = ["open", "close", "upper", "lower", "annual_gradient", "atr"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        o, c, up, lo, g, a = (pdf[x].to_numpy(float) for x in cols)
        p = pdf[pos].to_numpy()
        rows, entry = [], None
        for i in range(len(p) - 1):
            if not np.isfinite(up[i]):
                continue
            width = up[i] - lo[i]
            if entry is None:
                if g[i] >= g_min and width > 0 and c[i] <= lo[i] + frac * width:
                    entry, stop, peak, armed = i, -np.inf, c[i], mode == "atr"
                continue
            peak = max(peak, c[i])
            armed = armed or c[i] >= up[i] - arm * width
            level = peak - m_atr * a[i] if mode == "atr" else up[i] - stop_frac * width
            stop = max(stop, level) if armed and np.isfinite(level) else stop
            if g[i] < 0 or c[i] < lo[i] or (armed and c[i] < stop):
                rows.append((p[entry], p[i + 1], o[entry + 1], o[i + 1], g[entry]))
                entry = None
        if entry is not None:
            rows.append((p[entry], p[-1], o[entry + 1], o[-1], g[entry]))
        out = pd.DataFrame(rows, columns=["signal_pos", "exit_pos", "entry", "exit", "grad"])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return df.select(*dict.fromkeys([*keys, pos, *cols])).groupBy(*keys).applyInPandas(run, schema)


def forward_book(df: DataFrame, keys: list[str], event: Column, side: Column, horizons: list[int], pos: str = "pos") -> DataFrame:
    """Next-open entry and signed forward return at each horizon for event rows, one output row per (event, horizon)."""
    c = Clock(keys, pos)
    cols = {f"__c{h}": c.at("close", 1 + h) for h in horizons} | {f"__d{h}": c.at("date", 1 + h) for h in horizons}
    d = df.withColumns({**cols, "entry": c.at("open", 1), "entry_date": c.at("date", 1), "__side": side, "__ev": event}).where("__ev")
    arr = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"__c{h}").alias("exit"), F.col(f"__d{h}").alias("exit_date")) for h in horizons])
    d = d.withColumn("__f", F.explode(arr)).select(*[x for x in df.columns], "entry", "entry_date", F.col("__side").alias("side"), "__f.*").where("exit IS NOT NULL")
    return d.withColumn("fwd", F.col("side") * (F.col("exit") / F.col("entry") - 1))


def benchmark_over_hold(trades: DataFrame, index: DataFrame, entry: str = "entry_date", exit_: str = "exit_date", date: str = "date", level: str = "level") -> DataFrame:
    """Benchmark return between entry and exit dates: two equi lookups on the small date table."""
    a = index.select(F.col(date).alias(entry), F.col(level).alias("__l0"))
    b = index.select(F.col(date).alias(exit_), F.col(level).alias("__l1"))
    return trades.join(a, entry, "left").join(b, exit_, "left").withColumn("bench", F.col("__l1") / F.col("__l0") - 1).drop("__l0", "__l1")
