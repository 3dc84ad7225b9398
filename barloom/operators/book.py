"""Portfolio construction, turnover, costs and overlays.

A book is a weights table ``(book keys, step, code, w)`` plus one row per step after aggregation.
Windows ordered by step without instrument keys only ever see that one-row-per-step table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import clip, col
from . import align, xsec
from .clock import Clock


def book_window(keys: list[str] | None, order: str):
    return (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(order)


def timing_book(df: DataFrame, pos: str, ret: str, step: str = "cal", cost: float = 0.0, concentrate: bool = False, splits: int = 1) -> DataFrame:
    """Equal-weight timing book: weight = invested / (eligible or invested) count.

    A name is eligible on a step when it has a return. One row per step: strat, bnh, held, turnover.
    """
    d = df.where(F.col(ret).isNotNull()).withColumn("__in", F.col(pos).cast("double"))
    denom = F.sum("__in") if concentrate else F.count(F.lit(1))
    d = xsec.with_stats(d, step, {"__den": denom}, splits)
    d = d.withColumn("w", F.when(F.col("__den") > 0, F.col("__in") / F.col("__den")).otherwise(F.lit(0.0)))
    sums = {"gross": F.col("w") * F.col(ret), "__r": F.col(ret), "__n": F.lit(1.0), "held": F.col("__in")}
    out = align.turnover(d, [], step=step, sums=sums)
    return out.select(step, "turnover", "gross", (F.col("__r") / F.col("__n")).alias("bnh"), F.col("held").cast("long").alias("held")).withColumn(
        "strat", F.col("gross") - F.col("turnover") * cost
    )


def single_strategy(pos: Column, ret: Column, cost: float, keys: list[str], order: str) -> Column:
    """Position times return less cost on position changes (the first position is a change)."""
    w = Window.partitionBy(*keys).orderBy(order)
    p = pos.cast("double")
    return p * ret - F.abs(p - F.lag(p, 1, 0.0).over(w)) * cost


def quintile_weights(df: DataFrame, by: str, signal: str, frac: float, min_names: int = 1, tie: str = "code", splits: int = 1) -> DataFrame:
    """Long and short legs of +-1/k."""
    d = xsec.tail_flags(df, by, signal, tie, frac, min_names, splits).where("leg <> 0")
    return d.withColumn("w", F.col("leg") / F.col("k"))


def long_short_book(weights: DataFrame, universe: DataFrame, step: str, ret: str, cost_bps: float) -> DataFrame:
    """Per step: leg returns, universe mean, both turnovers and the net long/short return."""
    uni = universe.groupBy(step).agg(F.avg(ret).alias("uni_ret"), F.count(ret).alias("n_names"))
    side = align.turnover(weights.withColumn("side", F.col("leg")), ["side"], step=step, sums={"r": F.col(ret), "m": F.lit(1.0), "kk": F.col("k").cast("double")})

    def of(leg: int, x: Column) -> Column:
        return F.max(F.when(F.col("side") == leg, x))

    mean = F.col("r") / F.col("m")
    legs = side.groupBy(step).agg(
        of(1, mean).alias("long_ret"), of(-1, mean).alias("short_ret"), F.max(F.col("kk") / F.col("m")).cast("long").alias("k"),
        of(1, F.col("turnover")).alias("long_turnover"), of(-1, F.col("turnover")).alias("short_turnover"),
    )
    out = legs.join(uni, step)
    net = F.col("long_ret") - F.col("short_ret") - (F.col("long_turnover") + F.col("short_turnover")) * cost_bps / 1e4
    return out.withColumn("ls_net", net)


def tiered_cost(weights: DataFrame, spreads: DataFrame, book: list[str], step: str, spread: str = "spread_bps") -> DataFrame:
    """Sum of |dw| * spread/2 per step; names without a current spread pay the step's median."""
    moves = align.weight_changes(weights, [*book, "code"], step)
    med = spreads.groupBy(step).agg(F.percentile(spread, F.lit(0.5)).alias("med"))  # three distinct tiers per step
    priced = moves.join(spreads.select(step, "code", spread), [step, "code"], "left").join(med, step)
    px = F.coalesce(F.col(spread), F.col("med"))
    out = priced.groupBy(*book, step).agg(
        F.sum(F.abs("dw") * px / 2 / 1e4).alias("cost"), F.sum(F.abs("dw")).alias("turnover"), F.sum(F.greatest("dw", F.lit(0.0))).alias("bought"),
        F.max("__here").alias("__here"),
    )
    return out.where("__here = 1").drop("__here")  # not the step after the last book


def inverse_vol(df: DataFrame, by: list[str], vol: str, splits: int = 1, out: str = "w") -> DataFrame:
    """1/vol normalised within the group; a missing or zero vol takes the group's median."""
    v = F.when(F.col(vol) > 0, F.col(vol))
    d = df.withColumn("__v", v)
    med = xsec.quantiles(d, by, "__v", [0.5], "code", splits, "__q").select(*by, F.col("__q")[0].alias("__med"))
    d = d.join(med, by, "left").withColumn("__iv", 1.0 / F.coalesce("__v", "__med"))
    d = xsec.with_stats(d, by, {"__tot": F.sum("__iv")}, splits)
    return d.withColumn(out, F.col("__iv") / F.col("__tot")).drop("__v", "__med", "__iv", "__tot")


def tail_inverse_vol(df: DataFrame, by: str, signal: str, vol: str, frac: float = 0.2, min_names: int = 5, splits: int = 1) -> DataFrame:
    """Long the top tail, short the bottom, each leg summing to +-1 with inverse-vol sizes."""
    ok = df.where(F.col(signal).isNotNull() & (F.col(vol) > 0))
    d = xsec.tail_flags(ok, by, signal, "code", frac, min_names, splits).where("leg <> 0").withColumn("__iv", 1.0 / F.col(vol))
    d = xsec.with_stats(d, [by, "leg"], {"__tot": F.sum("__iv")}, splits)
    return d.withColumn("w", F.col("leg") * F.col("__iv") / F.col("__tot")).drop("__iv", "__tot")


def gated_neutral(df: DataFrame, by: str, z: str, vol: str, gate: float, min_gated: int, splits: int = 1) -> DataFrame:
    """Gate on |z|, size z/vol, demean, scale gross exposure to one."""
    g = df.where((F.abs(z) >= gate) & (F.col(vol) > 0)).withColumn("__r", F.col(z) / F.col(vol))
    g = xsec.with_stats(g, by, {"__n": F.count(F.lit(1)), "__m": F.avg("__r")}, splits).where(F.col("__n") >= min_gated)
    g = g.withColumn("__d", F.col("__r") - F.col("__m"))
    g = xsec.with_stats(g, by, {"__gross": F.sum(F.abs("__d"))}, splits)
    return g.withColumn("w", F.try_divide("__d", "__gross")).drop("__r", "__n", "__m", "__d", "__gross")


def blended_book(targets: DataFrame, alpha: float, key: str = "code", step: str = "step", weight: str = "w", parity: bool = True,
                 tol: float = 1e-10, max_passes: int = 200) -> DataFrame:
    """Partial adjustment towards target weights, renormalised to unit gross on every step.

    v_t = a*target_t + c*w_{t-1}, w_t = v_t / g_t with g_t = sum |v_t|; c is alpha*(1-alpha) in ``parity``
    mode and (1-alpha) otherwise. Names are coupled only through the one number g_t per step. For known
    g every name is a linear recursion, which is one running sum per name; the gross it implies is then
    one aggregation. The two are repeated until g stands still: the first step is exact after one pass,
    each pass fixes at least one more, and the error shrinks geometrically, so only the short (step, g)
    table travels between passes and no task ever sees the whole book.

    Returns (key, step, w) for every step at or after a name's first target; raises if g does not come to rest.
    """
    from ..session import materialise

    c = alpha * (1 - alpha) if parity else 1 - alpha
    steps = targets.agg(F.min(step).alias("lo"), F.max(step).alias("hi"))
    spans = targets.groupBy(key).agg(F.min(step).alias("__lo")).join(F.broadcast(steps))
    grid = spans.select(key, F.explode(F.sequence("__lo", "hi")).alias(step))
    base = grid.join(targets.select(key, step, F.col(weight).cast("double").alias("__t")), [key, step], "left").fillna(0.0, ["__t"])
    base = materialise(base.repartition(key))
    w = Window.partitionBy(key).orderBy(step)
    spark, w = targets.sparkSession, Window.partitionBy(key).orderBy(step)
    # one number per rebalance step: a few hundred, held as a literal table between passes
    g = {r[0]: r[1] or 1.0 for r in base.groupBy(step).agg(F.sum(F.abs(F.col("__t") * alpha))).collect()}
    for _ in range(max_passes):
        known, level = [], 0.0
        for s in sorted(g):
            level += math.log(c / g[s])
            known.append((s, g[s], level))
        table = spark.createDataFrame(known, f"{step} long, __g double, __l double")
        d = base.join(F.broadcast(table), step)
        run = F.sum(F.col("__t") * alpha / F.col("__g") * F.exp(-F.col("__l"))).over(w)
        d = d.withColumn("__w", run * F.exp("__l"))
        v = F.col("__t") * alpha + F.coalesce(F.lag("__w").over(w), F.lit(0.0)) * c
        new = {r[0]: r[1] or 1.0 for r in d.withColumn("__v", v).groupBy(step).agg(F.sum(F.abs("__v")).alias("n")).collect()}
        moved = max(abs(new[s] - g[s]) for s in new)
        g = new
        if moved <= tol:
            return d.select(key, step, F.col("__w").alias(weight))
    raise RuntimeError(f"the gross of a step still moves by {moved} after {max_passes} passes")


def carry_rebalance(df: DataFrame, key: str, step: str, value: Column, every: int, first: int) -> Column:
    """Value formed on rebalance steps ((step-first) % every == 0) and held until the next one."""
    formed = F.when((F.col(step) - first) % every == 0, value)
    w = Window.partitionBy(key).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(formed, ignorenulls=True).over(w)


def vol_target(df: DataFrame, ret: str, order: str, target: float, cap: float, n: int, periods: int, cost: float, keys: list[str] | None = None) -> DataFrame:
    """Scale by target over the lagged rolling volatility, capped; cost on scale changes."""
    w = book_window(keys, order)
    back = w.rowsBetween(-n, -1)
    sd = F.when(F.count(ret).over(back) == n, F.stddev_samp(ret).over(back))
    d = df.withColumn("scale", F.least(F.try_divide(F.lit(target), sd * periods**0.5), F.lit(cap)))
    d = d.withColumn("scale", F.coalesce("scale", F.lit(1.0)))
    moved = F.abs(F.col("scale") - F.coalesce(F.lag("scale").over(w), F.col("scale")))
    return d.withColumn("overlay", F.col("scale") * F.col(ret) - moved * cost)


def resize(df: DataFrame, ret: str, scale: str, order: str, cost: float, keys: list[str] | None = None, out: str = "overlay") -> DataFrame:
    """Apply a scale column and charge its changes (the first scale is free)."""
    w = book_window(keys, order)
    moved = F.abs(F.col(scale) - F.coalesce(F.lag(scale).over(w), F.col(scale)))
    return df.withColumn(out, F.col(scale) * F.col(ret) - moved * cost)


def membership_book(df: DataFrame, qualifies: str, ret: str, spread: float, key: str = "code", step: str = "cal") -> DataFrame:
    """Hold what qualified on the previous tick; mean member return less spread on membership changes / n."""
    c = Clock(key, step)
    d = df.withColumn("__h", F.coalesce(c.at(F.col(qualifies).cast("int"), -1), F.lit(0)))
    n = F.sum("__h")
    gross = d.groupBy(step).agg(n.alias("n_held"), F.try_divide(F.sum(F.col("__h") * F.coalesce(F.col(ret), F.lit(0.0))), n).alias("gross"))
    moves = align.turnover(d.where("__h = 1").select(key, step, F.lit(1.0).alias("w")), [], key, step).select(step, F.col("turnover").alias("changes"))
    out = gross.join(moves, step, "left").withColumn("changes", F.coalesce("changes", F.lit(0.0)))
    cost = F.coalesce(F.try_divide(F.col("changes") * spread, F.col("n_held")), F.lit(0.0))
    return out.withColumn("net", F.coalesce("gross", F.lit(0.0)) - cost)


def breakeven(points: DataFrame, x: str, y: str, target: str, keys: list[str]) -> DataFrame:
    """Linear crossing of a falling metric with its target over a cost grid; first crossing per key."""
    w = Window.partitionBy(*keys).orderBy(x)
    d = points.withColumns({"__x1": F.lead(x).over(w), "__y1": F.lead(y).over(w)})
    d = d.where((F.col(y) >= F.col(target)) & (F.col("__y1") < F.col(target)))
    at = F.col(x) + (F.col("__x1") - F.col(x)) * (F.col(y) - F.col(target)) / (F.col(y) - F.col("__y1"))
    return d.groupBy(*keys).agg(F.min_by(at, F.col(x)).alias("breakeven"))


def beta_alpha_label(dd_strategy: Column, dd_market: Column, trigger: float = -0.15, market_level: float = -0.10) -> Column:
    """ok / BETA (market down too) / ALPHA (strategy-specific)."""
    return F.when(dd_strategy >= trigger, "ok").when(dd_market <= market_level, "BETA").otherwise("ALPHA")


def short_vol_return(carry: Column, dlog: Column, floor: float = -0.95) -> Column:
    """Yesterday's roll carry minus today's log change of the level, floored."""
    return F.when(carry.isNotNull() & dlog.isNotNull(), F.greatest(carry - dlog, F.lit(floor)))


def variance_swap_pnl(implied: Column, realised: Column) -> Column:
    """(implied^2 - realised^2) / (2 * implied): vega-normalised variance payoff."""
    return F.try_divide(implied * implied - realised * realised, implied * 2)


def contribution_value(df: DataFrame, ret: str, contrib: str, order: str, keys: list[str] | None = None) -> DataFrame:
    """Value path V=(V+c)(1+r) in closed form: P_t * sum(c_i / P_{i-1}) with the running product P."""
    w = book_window(keys, order)
    d = df.withColumn("__lp", F.sum(F.log1p(ret)).over(w))
    prev = F.exp(-(F.col("__lp") - F.log1p(ret)))
    return d.withColumn("__u", F.col(contrib) * prev).withColumn("value", F.exp("__lp") * F.sum("__u").over(w)).drop("__lp", "__u")


def whole_share_error(target: float, price: Column) -> tuple[Column, Column]:
    """Whole shares by half-even rounding and the relative error of the rounded position."""
    n = F.bround(target / price, 0)
    return n, F.abs(n * price - target) / target


def slot_portfolio(trades: DataFrame, keys: list[str], slots: int, entry: str = "entry", exit_: str = "exit", name: str = "code", priority: str = "grad") -> DataFrame:
    """Trades accepted by a book of ``slots`` positions: best priority first, held names skipped, exits free their slot on their own date.

    Of the trades of one name and entry date only the best can be taken. On any date at most ``slots`` trades
    start and at most ``slots`` candidates are skipped because their name is held, so only the top 2*slots per entry date can ever be taken. That exact pre-selection runs
    distributed; the sequential walk then sees at most 2*slots rows per date and parameter cell.
    """
    rank = Window.partitionBy(*keys, entry).orderBy(F.col(priority).desc(), F.col(name).desc())
    same = Window.partitionBy(*keys, entry, name).orderBy(F.col(priority).desc(), F.col(exit_).asc())
    cand = trades.where(F.col(exit_) > F.col(entry)).withColumn("__r", F.row_number().over(same)).where("__r = 1")
    cand = cand.withColumn("__r", F.row_number().over(rank)).where(F.col("__r") <= 2 * slots)
    cols = [c for c in cand.columns if c != "__r"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict = {}
        taken = np.zeros(len(pdf), bool)
        pdf = pdf.sort_values([entry, "__r"]).reset_index(drop=True)
        for i, (day, leave, code) in enumerate(zip(pdf[entry], pdf[exit_], pdf[name])):
            held = {n: x for n, x in held.items() if x > day}
            if len(held) < slots and code not in held:
                held[code] = leave
                taken[i] = True
        return pdf.loc[taken, cols]

    return cand.groupBy(*keys).applyInPandas(run, cand.select(*cols).schema)
