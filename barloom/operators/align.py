"""Calendar alignment, as-of and nearest joins, holding-period carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import col


def densify(df: DataFrame, key: str, pos: str, until: Column | None = None) -> DataFrame:
    """Rows for every clock tick between an instrument's first and last one (or ``until``).

    The ticks come from ``sequence`` per instrument, so the work is linear in the output and no
    date x instrument cross join is planned. Missing cells are NULL; a delisted name is not carried.
    """
    end = F.max(pos) if until is None else until
    spans = df.groupBy(key).agg(F.min(pos).alias("__lo"), end.alias("__hi"))
    grid = spans.select(key, F.explode(F.sequence("__lo", "__hi")).alias(pos))
    return grid.join(df, [key, pos], "left")


def asof_last(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str],
              right_tie: str | None = None) -> DataFrame:
    """Backward as-of join: each left row gets the last right row with right_ts <= left_ts.

    Both sides are stacked and carried forward in one ordered pass: one shuffle, no range join.
    """
    tie = F.col(right_tie).cast("long") if right_tie else F.lit(0).cast("long")
    payload = F.struct(*[F.col(v) for v in values], F.col(right_ts).alias("__asof"))
    r = right.select(F.col(key), F.col(right_ts).alias("__t"), F.lit(0).alias("__side"), tie.alias("__tie"),
                     payload.alias("__r"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__l"))
    l = left.select(F.col(key), F.col(left_ts).alias("__t"), F.lit(1).alias("__side"), F.lit(0).cast("long").alias("__tie"),
                    F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.struct(*left.columns).alias("__l"))
    w = Window.partitionBy(key).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = r.unionByName(l).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return carried.select("__l.*", *[F.col(f"__r.{v}").alias(v) for v in values], F.col("__r.__asof").alias("asof_date"))


def nearest_within(events: DataFrame, days: DataFrame, key: str, event_date: str, day: str, tolerance: int) -> DataFrame:
    """Snap each event to the single nearest trading day within ``tolerance`` days (earlier wins ties).

    Equal events stay apart.

    The date difference is exploded into an equi key, then the best day is picked by an aggregate.
    """
    offs = F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance))).alias("__off")
    rest = events.columns
    cand = events.withColumn("__event", F.monotonically_increasing_id()).select("*", offs).withColumn("__day", F.date_add(F.col(event_date), F.col("__off")))
    d = days.select(F.col(key), F.col(day).alias("__day")).distinct()
    hit = cand.join(d, [key, "__day"])
    return (
        hit.groupBy(*rest, "__event")
        .agg(F.min_by("__day", F.abs("__off") * 2 + (F.col("__off") > 0).cast("int")).alias("snap_date"))
        .drop("__event")
    )


def carry_period(df: DataFrame, keys: list[str], order: str, period_id: Column, inclusive: bool = False) -> Column:
    """Last non-null period id strictly before (or at) each row: holding period -> daily rows."""
    w = Window.orderBy(order) if not keys else Window.partitionBy(*keys).orderBy(order)
    w = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return F.last(period_id, ignorenulls=True).over(w)


def forward_fill(x: str | Column, key: str, pos: str, limit: int) -> Column:
    """Carry the last value at most ``limit`` clock ticks."""
    w = Window.partitionBy(key).orderBy(pos).rangeBetween(-limit, 0)
    return F.last(col(x), ignorenulls=True).over(w)


def weight_changes(weights: DataFrame, keys: list[str], step: str, weight: str = "w", sums: dict[str, Column] | None = None) -> DataFrame:
    """Change of each name's weight per step, missing names counting as zero weight.

    Each weight is posted at its own step (+w) and at the next one (-w), so one grouping by (name, step)
    replaces a full outer self-join and the input is read once. ``sums`` are totalled over the rows of
    their own step. ``__here`` marks steps at which the book exists.
    """
    sums = sums or {}
    zero = [F.lit(0.0).alias(k) for k in sums]
    here = F.struct(F.col(step).alias("s"), F.col(weight).cast("double").alias("d"), F.lit(1).alias("h"), *[c.cast("double").alias(k) for k, c in sums.items()])
    nxt = F.struct((F.col(step) + 1).alias("s"), (-F.col(weight)).cast("double").alias("d"), F.lit(0).alias("h"), *zero)
    posted = weights.select(*keys, F.explode(F.array(here, nxt)).alias("__p"))
    return posted.groupBy(*keys, F.col("__p.s").alias(step)).agg(
        F.sum("__p.d").alias("dw"), F.max("__p.h").alias("__here"), *[F.sum(f"__p.{k}").alias(k) for k in sums]
    )


def turnover(weights: DataFrame, book: list[str], key: str = "code", step: str = "step", weight: str = "w",
             initial: bool = True, sums: dict[str, Column] | None = None) -> DataFrame:
    """Sum of absolute weight changes per step, with the bought part and any extra per-step sums.

    ``initial`` keeps or drops the first step's cost.
    """
    moves = weight_changes(weights, [*book, key], step, weight, sums)
    out = moves.groupBy(*book, step).agg(
        F.sum(F.abs("dw")).alias("turnover"),
        F.sum(F.greatest("dw", F.lit(0.0))).alias("bought"),
        F.max("__here").alias("__here"),
        *[F.sum(k).alias(k) for k in (sums or {})],
    )
    out = out.where("__here = 1").drop("__here")
    if not initial:
        w = Window.partitionBy(*book) if book else Window.partitionBy(F.lit(0))
        first = F.min(step).over(w) == F.col(step)
        out = out.withColumn("__f", first).withColumns(
            {c: F.when(F.col("__f"), F.lit(0.0)).otherwise(F.col(c)) for c in ("turnover", "bought")}
        ).drop("__f")
    return out
