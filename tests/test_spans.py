"""A sweep over minimum spans reads a series once and gives what a run for each span gives."""

import datetime as dt

import numpy as np

from barloom.operators import trendlines as tl


def test_spans_equal_single_runs(spark):
    rng, data = np.random.default_rng(8), []
    for code in range(3):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 300)))
        for i in range(300):
            o, w = c[i] * (1 + rng.normal(0, 0.005)), 0.01 * c[i] * rng.random()
            data.append((code, i, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(o), float(max(o, c[i]) + w), float(min(o, c[i]) - w), float(c[i]), None if i < 13 else float(0.02 * c[i]), 1.0 + i % 5))
    df = spark.createDataFrame(data, "code long, pos long, date date, open double, high double, low double, close double, atr double, volume double")
    got = tl.breakout_trades(df, ["code"], min_touches=2, spans={"span": [0, 5, 20]}).collect()
    assert {r["span"] for r in got} == {0, 5, 20}
    for span in (0, 5, 20):
        one = tl.breakout_trades(df, ["code"], min_touches=2, min_span=span).collect()
        assert sorted(tuple(r)[1:] for r in got if r["span"] == span) == sorted(tuple(r) for r in one)


def test_candidates_miss_no_breakout():
    rng = np.random.default_rng(9)
    for _ in range(20):
        c = 50 * np.exp(np.cumsum(rng.normal(0, 0.03, 200)))
        low, high = c * 0.99, c * 1.01
        band, lines = np.full(200, 0.3), tl.prior_lines(low, high, 0)
        maybe = tl.candidates(lines, low, high, band)
        hits = [i for i in range(200) if tl.breakout_at(i, lines, low, high, band, 1)]
        assert hits and maybe[hits].all() and maybe.sum() < 200
