"""Causal keyed state over a stream: one small vector per key, updated in event-time order.

The output of a row is what was known before it. Rows older than the key's last processed timestamp are
dropped and counted. Ticks should be turned into bars first when a key is hot: then a key contributes one
row per bar, however many ticks it has.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[list[float] | None, float], tuple[list[float], float | None]]


def ewma_step(lam: float) -> Step:
    """Exponential average; emits the value before the row."""

    def step(s, x):
        return ([x] if s is None else [lam * s[0] + (1 - lam) * x]), (None if s is None else s[0])

    return step


def regime_step(means, variances, trans, start) -> Step:
    """Gaussian regime filter; emits the turbulent (last-state) probability before the row."""
    k = len(means)

    def step(s, x):
        prior = start if s is None else [sum(s[i] * trans[i][j] for i in range(k)) for j in range(k)]
        lp = [-0.5 * (math.log(2 * math.pi * v) + (x - m) ** 2 / v) for m, v in zip(means, variances)]
        top = max(lp)
        post = [p * math.exp(q - top) for p, q in zip(prior, lp)]
        total = sum(post)
        return [p / total for p in post], (None if s is None else s[-1])

    return step


def nlms_step(n_lags: int, rate: float = 0.1) -> Step:
    """NLMS forecast; state is weights followed by the lag buffer. Emits the forecast made before the row."""

    def step(s, x):
        s = s or [0.0] * (n_lags + 1)
        w, lags = s[: n_lags + 1], s[n_lags + 1:]
        if len(lags) < n_lags:
            return w + [x, *lags], None
        xb = [1.0, *lags]
        pred = sum(a * b for a, b in zip(w, xb))
        gain = rate * (x - pred) / (1e-6 + sum(b * b for b in xb))
        return [a + gain * b for a, b in zip(w, xb)] + [x, *lags[:-1]], pred

    return step


def drawdown_step() -> Step:
    """Log-wealth drawdown of a return stream; state is (wealth, peak). Emits the drawdown before the row."""

    def step(s, x):
        w = (s[0] if s else 0.0) + math.log1p(x)
        peak = w if s is None else max(s[1], w)
        return [w, peak], (None if s is None else math.exp(s[0] - s[1]) - 1)

    return step


def keyed_state(stream: DataFrame, key: str, ts: str, value: str, step: Step, out: str = "prior", tie: str | None = None) -> DataFrame:
    """Apply ``step`` per key; output columns key, ts, value, ``out`` and the number of rows dropped so far.

    For feeds in event-time order across micro-batches: rows before the key's last one can't be replayed into its
    state and are counted as dropped (a backlog in any order goes through bars.run_parts). Equal timestamps are all
    kept, in the order of ``tie`` (a long) where it is given.
    """
    schema = f"{key} {stream.schema[key].dataType.simpleString()}, {ts} timestamp, {value} double, {out} double, dropped long"

    def run(k, frames, state: GroupState):
        vec, last, last_tie, dropped = state.get if state.exists else (None, None, None, 0)
        vec = list(vec) if vec is not None else None
        pdf = pd.concat(list(frames)).sort_values([ts, "__tie"], kind="stable")
        rows = []
        for t, x, e in zip(pdf[ts], pdf[value], pdf["__tie"]):
            if last is not None and (t.value < last or (tie and t.value == last and e <= last_tie)):
                dropped += 1
                continue
            vec, prior = step(vec, float(x))
            last, last_tie = t.value, int(e)
            rows.append((k[0], t, float(x), prior, dropped))
        state.update((vec, last, last_tie, dropped))
        yield pd.DataFrame(rows, columns=[key, ts, value, out, "dropped"]).astype({out: "float64"})

    order = F.col(tie).cast("long") if tie else F.lit(0).cast("long")
    return stream.select(key, ts, F.col(value).cast("double").alias(value), order.alias("__tie")).groupBy(key).applyInPandasWithState(
        run, schema, "vec array<double>, last long, last_tie long, dropped long", "append", GroupStateTimeout.NoTimeout
    )
