"""Array helpers built from higher-order functions: quantile grids, interpolation, window shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col


def lit_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def let(value: Column, fn) -> Column:
    """Bind ``value`` once inside a larger expression.

    A mean used inside ``transform`` would be re-evaluated for every element; as the variable of a
    one-element ``transform`` it is evaluated once per row.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def a_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def a_mean(a: Column) -> Column:
    return a_sum(a) / F.size(a)


def a_var_pop(a: Column) -> Column:
    return let(a_mean(a), lambda m: a_sum(F.transform(a, lambda x: (x - m) * (x - m)))) / F.size(a)


def a_dot(a: Column, b: Column) -> Column:
    return a_sum(F.zip_with(a, b, lambda x, y: x * y))


def a_diff(a: Column) -> Column:
    """Increments, one element shorter than the input."""
    return F.transform(F.sequence(F.lit(2), F.size(a)), lambda i: F.element_at(a, i) - F.element_at(a, i - 1))


def a_cumsum(a: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: a_sum(F.slice(a, F.lit(1), i)))


def a_argmin(a: Column) -> Column:
    """0-based position of the first minimum."""
    return F.array_position(a, F.array_min(a)) - 1


def a_argmax(a: Column) -> Column:
    return F.array_position(a, F.array_max(a)) - 1


def znorm(a: Column, eps: float = 1e-9) -> Column:
    """Shape of a window: level and scale removed with the population deviation."""
    return let(
        F.struct(a_mean(a).alias("m"), (F.sqrt(a_var_pop(a)) + eps).alias("s")),
        lambda b: F.transform(a, lambda x: (x - b["m"]) / b["s"]),
    )


def resample(a: Column, length: int, points: int) -> Column:
    """Linear interpolation of a window of known ``length`` onto ``points`` equally spaced positions."""
    out = []
    for j in range(points):
        at = j * (length - 1) / (points - 1)
        k = min(int(at), length - 2)
        w = at - k
        left, right = F.element_at(a, k + 1), F.element_at(a, k + 2)
        out.append(left + (right - left) * F.lit(w))
    return F.array(*out)


def pinball(q: Column, y: Column, level: Column) -> Column:
    d = y - q
    return F.when(d >= 0, level * d).otherwise((level - 1.0) * d)


def crps(q: str | Column, y: str | Column, levels: list[float]) -> Column:
    """Twice the mean pinball loss over the level grid."""
    lv = lit_array(levels)
    return a_mean(F.zip_with(col(q), lv, lambda a, b: pinball(a, col(y), b))) * 2.0


def interval_hit(lo: Column, hi: Column, y: Column) -> Column:
    return (y >= lo) & (y <= hi)


def interp_clamped(x: str | Column, xs: str | Column, ys: str | Column) -> Column:
    """Piecewise-linear interpolation through non-decreasing ``xs``, flat beyond both ends."""
    ys = col(ys)

    def between(b: Column) -> Column:
        x_, xs_, k = b["x"], b["xs"], b["k"]
        x0, x1 = F.element_at(xs_, k), F.element_at(xs_, k + 1)
        y0, y1 = F.element_at(ys, k), F.element_at(ys, k + 1)
        return (
            F.when(x_.isNull() | xs_.isNull(), None)
            .when(k == 0, F.element_at(ys, 1))
            .when(k >= F.size(xs_), F.element_at(ys, -1))
            .otherwise(y0 + (y1 - y0) * (x_ - x0) / (x1 - x0))
        )

    def located(b: Column) -> Column:
        k = F.size(F.filter(b["xs"], lambda v: v <= b["x"]))
        return let(F.struct(b["x"].alias("x"), b["xs"].alias("xs"), k.alias("k")), between)

    return let(F.struct(col(x).alias("x"), col(xs).alias("xs")), located)


def pit(q: str | Column, y: str | Column, levels: list[float]) -> Column:
    """Predictive distribution function at the outcome, clamped to the end levels."""
    return interp_clamped(y, q, lit_array(levels))
