"""Opening-range fade of a session, as one fold over the array of its bars.

What a bar shows (box, wicks, its neighbours) comes from windows over the session; then a session is one row with the
bars behind its box, which the session bounds. Parameters are further key columns, so a sweep is one job. Prices of a long fade are reflected, so that every session reads as a short fade of a rising box. The fold
carries a struct: searching for a trigger, waiting for an engulfing pattern's level, in a trade, or done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import let

SEARCH, WAIT, TRADE, DONE, VOID = range(5)
#: What the fold carries: phase, trigger, level and high of an engulfing pattern, the trade, and its excursions.
STATE = {
    "phase": "int", "pattern": "string", "level": "double", "peak": "double", "at": "int", "px": "double", "stop": "double", "live": "double",
    "trailed": "boolean", "k": "int", "leave": "double", "reason": "string", "worst": "double", "best": "double",
}
DEFAULTS = {"wick_body": 2.0, "wick_min": 0.5, "opp_max": 0.10, "stop_mult": 1.0}


def _with(state: Column, **fields: Column) -> Column:
    return F.struct(*[(fields[n] if n in fields else state[n]).cast(t).alias(n) for n, t in STATE.items()])


def _trigger(s: Column, x: Column) -> Column:
    """A bar outside the box while nothing is pending: a rejection enters at the next open, an engulfing bar waits."""
    px = x["next_o"]
    stop = px + F.col("stop_mult") * (x["h"] - px)
    free = (s["phase"] == SEARCH) & (x["h"] > F.col("top"))
    star = F.coalesce(free & x["reject"] & (px >= F.col("top")) & (stop > px) & (px > F.col("bottom")), F.lit(False))
    engulf = free & ~star & F.coalesce(x["engulf"] & (x["before_l"] >= F.col("top")), F.lit(False))
    keep = lambda name, a, b: F.when(star, a).when(engulf, b).otherwise(s[name])
    return _with(
        s, phase=keep("phase", F.lit(TRADE), F.lit(WAIT)), pattern=keep("pattern", F.lit("star"), F.lit("engulf")), at=keep("at", x["i"] + 1, s["at"]), px=keep("px", px, s["px"]),
        stop=keep("stop", stop, s["stop"]), live=keep("live", stop, s["live"]), level=keep("level", s["level"], x["before_l"]), peak=keep("peak", s["peak"], x["h"]),
    )


def _fill(s: Column, x: Column) -> Column:
    """A waiting level that is reached: the worse of it and the open, or nothing if the stop or target is passed already."""
    px = F.least(x["o"], s["level"])
    stop = px + F.col("stop_mult") * (s["peak"] - px)
    hit = (s["phase"] == WAIT) & (x["l"] <= s["level"])
    good = hit & (stop > px) & (px > F.col("bottom"))
    keep = lambda name, a: F.when(good, a).otherwise(s[name])
    return _with(s, phase=F.when(good, TRADE).when(hit, VOID).otherwise(s["phase"]), at=keep("at", x["i"]), px=keep("px", px), stop=keep("stop", stop), live=keep("live", stop))


def _hold(s: Column, x: Column) -> Column:
    """A bar of an open trade: the stop counts before the target, and the stop moves from the next bar on."""
    on = (s["phase"] == TRADE) & (x["i"] >= s["at"])
    stopped, reached = on & (x["h"] >= s["live"]), on & (x["l"] <= F.col("bottom"))
    trail = on & ~stopped & ~reached & ~s["trailed"] & (x["l"] <= F.col("trigger"))
    keep = lambda name, a: F.when(on, a).otherwise(s[name])
    return _with(
        s, phase=F.when(stopped | reached, DONE).otherwise(s["phase"]), k=keep("k", x["i"]),
        leave=keep("leave", F.when(stopped, s["live"]).when(reached, F.col("bottom")).otherwise(x["c"])),
        reason=keep("reason", F.when(stopped, F.when(s["trailed"], "trail").otherwise("stop")).when(reached, "target").otherwise("time")),
        worst=keep("worst", F.greatest(s["worst"], x["h"] - s["px"])), best=keep("best", F.greatest(s["best"], s["px"] - x["l"])),
        trailed=s["trailed"] | trail, live=F.when(trail, F.col("top")).otherwise(s["live"]),
    )


def opening_fade(
    df: DataFrame, keys: list[str], bars: int = 3, box_bars: int = 15, order: str = "bar_no", trail_frac: float = 0.5, params: dict[str, Column] | None = None, atr: Column | None = None
) -> DataFrame:
    """One row a session: how far it got (no_box, no_atr, no_signal, no_fill, traded) and its trade.

    The first ``bars`` bars are the box; in the ``box_bars`` after it a rejection or engulfing bar beyond the box is
    faded back to its far edge. Stops are assumed to fill before targets in one bar; after retracing ``trail_frac`` of
    the box the stop moves to the near edge from the next bar on. ``params`` overrides wick_body, wick_min, opp_max,
    stop_mult and box by row. With ``atr`` (constant in a session) a session without a positive one is left, and
    ``liq_ratio`` is the height of the box over it.
    """
    given = {**{k: F.lit(v) for k, v in DEFAULTS.items()}, "box": F.lit(box_bars), **(params or {})}
    measure = F.lit(None).cast("double") if atr is None else atr.cast("double")
    d = df.select(
        *keys, F.col(order).alias("__at"), *[F.col(c).cast("double").alias(c[0]) for c in ("open", "high", "low", "close")],
        measure.alias("atr"), *[v.cast("int" if k == "box" else "double").alias(k) for k, v in given.items()],
    )
    whole = Window.partitionBy(*keys)
    along = whole.orderBy("__at")
    i, short = F.col("i"), F.col("short")
    d = d.withColumns({"i": F.row_number().over(along) - 1, "n": F.count(F.lit(1)).over(whole)})
    rising = F.max(F.when(i == bars - 1, F.col("c"))).over(whole) > F.max(F.when(i == 0, F.col("o"))).over(whole)
    d = d.withColumns({"short": F.coalesce(rising, F.lit(True)), "last": F.least(F.col("n") - 1, F.lit(bars - 1) + F.col("box"))})
    down = F.when(short, F.col("c") <= F.col("o")).otherwise(F.col("c") > F.col("o"))
    d = d.withColumns({"down": down, **{a: F.when(short, F.col(a)).otherwise(-F.col(z)) for a, z in ("oo", "hl", "lh", "cc")}})
    d = d.withColumns({"top": F.max(F.when(i < bars, F.col("h"))).over(whole), "bottom": F.min(F.when(i < bars, F.col("l"))).over(whole)})
    d = d.withColumns({**{f"before_{k}": F.lag(k).over(along) for k in ("h", "l", "down")}, "next_o": F.when(i < F.col("last"), F.lead("o").over(along))})
    tall, upper, lower = F.col("h") - F.col("l"), F.col("h") - F.greatest("o", "c"), F.least("o", "c") - F.col("l")
    reject = F.col("down") & (tall > 0) & (upper >= F.col("wick_body") * F.abs(F.col("c") - F.col("o"))) & (upper >= F.col("wick_min") * tall) & (lower <= F.col("opp_max") * tall)
    engulf = (i > bars) & ~F.col("before_down") & F.col("down") & (F.col("h") >= F.col("before_h")) & (F.col("l") <= F.col("before_l"))
    bar = F.struct("i", "o", "h", "l", "c", reject.alias("reject"), engulf.alias("engulf"), "before_l", "next_o")
    walked = F.when((F.col("n") >= bars + 2) & i.between(F.lit(bars), F.col("last")), bar)
    d = d.groupBy(*keys).agg(F.array_sort(F.collect_list(walked)).alias("x"), *[F.first(c).alias(c) for c in ("n", "short", "top", "bottom", "atr", "stop_mult")])
    d = d.withColumn("trigger", F.col("top") - trail_frac * (F.col("top") - F.col("bottom")))
    start = {"phase": SEARCH, "trailed": False, "worst": 0.0, "best": 0.0}
    zero = F.struct(*[F.lit(start.get(n)).cast(t).alias(n) for n, t in STATE.items()])
    # a star enters on the next bar, so the bar that shows it is no bar of the trade; a level waits for the next bar too
    step = lambda s, x: let(_fill(s, x), lambda f: let(_trigger(f, x), lambda t: _hold(t, x)))
    d = d.withColumn("s", F.aggregate("x", zero, step))
    traded = F.col("s.phase").isin(TRADE, DONE)
    stage = F.when(F.col("n") < bars + 2, "no_box").when(F.lit(atr is not None) & ~F.coalesce(F.col("atr") > 0, F.lit(False)), "no_atr")
    stage = stage.when(traded, "traded").when(F.col("s.phase") == WAIT, "no_fill").otherwise("no_signal")
    d = d.withColumn("stage", stage)
    is_traded, sign = F.col("stage") == "traded", F.when(F.col("short"), 1.0).otherwise(-1.0)
    px, risk = F.col("s.px"), F.abs(F.col("s.stop") - F.col("s.px"))
    of_trade = lambda c: F.when(is_traded, c)
    signalled = F.col("stage").isin("traded", "no_fill")
    return d.select(
        *keys, "stage", F.when(signalled, F.when(F.col("short"), "short").otherwise("long")).alias("side"), F.when(signalled, F.col("s.pattern")).alias("pattern"),
        of_trade(F.col("s.at")).alias("entry_bar"), of_trade(sign * px).alias("entry"), of_trade(sign * F.col("s.stop")).alias("stop"), of_trade(sign * F.col("bottom")).alias("target"),
        of_trade(F.col("s.k")).alias("exit_bar"), of_trade(sign * F.col("s.leave")).alias("exit"), of_trade(F.col("s.reason")).alias("reason"),
        of_trade((px - F.col("s.leave")) / F.abs(px)).alias("gross"), of_trade((px - F.col("s.leave")) / risk).alias("r_multiple"),
        of_trade(F.col("s.worst") / F.abs(px)).alias("mae"), of_trade(F.col("s.best") / F.abs(px)).alias("mfe"),
        F.when(~F.col("stage").isin("no_box", "no_atr"), (F.col("top") - F.col("bottom")) / F.col("atr")).alias("liq_ratio"),
    )
