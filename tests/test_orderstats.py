"""Moving and growing quantiles against a sort of every window."""

import datetime as dt
import random

import numpy as np
import pytest

from barloom.operators.clock import Clock
from barloom.operators.orderstats import Quantiles, expanding_quantiles, rolling_quantiles

BAR = Clock("code", "pos")


def panel(rng):
    """Series with gaps, missing values, ties and one long stretch, out of order, with columns of other types."""
    out = []
    for code, n in {"a": 1, "b": 40, "c": 130}.items():
        ticks = [t for t in range(n) if rng.random() < 0.8 or t == 0]
        out += [(code, t, rng.choice([None, 1.0, rng.random(), rng.random()]), rng.random(), dt.date(2020, 1, 1) + dt.timedelta(t), [t]) for t in ticks]
    rng.shuffle(out)
    return out


SCHEMA = "code string, pos long, x double, y double, date date, tag array<long>"


def plain(rows, s, column):
    want = {}
    for code, pos, *_ in rows:
        last = pos - s.lag
        first = -1 if s.n is None else last - s.n + 1
        seen = [r[column] for r in rows if r[0] == code and first <= r[1] <= last and r[column] is not None]
        want[code, pos] = [float(np.quantile(seen, p)) for p in s.probs] if len(seen) >= s.fewest else None
    return want


SPECS = [Quantiles("q", "x", 7, (0.5, 0.9), 0, 3), Quantiles("full", "y", 5, (0.25,)), Quantiles("behind", "x", 20, (0.0, 1.0), 2, 1)]


@pytest.mark.parametrize("chunk", [1, 25, 8192])
def test_rolling_quantiles_equal_sorted_windows(spark, chunk):
    rows = panel(random.Random(1))
    got = rolling_quantiles(spark.createDataFrame(rows, SCHEMA), BAR, SPECS, chunk)
    assert got.columns == ["code", "pos", "x", "y", "date", "tag", "q", "full", "behind"]
    got = got.collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(map(repr, rows))
    for s in SPECS:
        want = plain(rows, s, 2 if s.x == "x" else 3)
        for r in got:
            expected = want[r["code"], r["pos"]]
            assert r[s.out] == (None if expected is None else pytest.approx(expected, abs=1e-12)), (s, r)


def test_expanding_quantiles_equal_sorted_history(spark):
    rows = panel(random.Random(2))
    specs = [Quantiles("now", "x", None, (0.5,)), Quantiles("before", "x", None, (0.1, 0.5), 1)]
    got = expanding_quantiles(spark.createDataFrame(rows, SCHEMA), BAR, specs).collect()
    for s in specs:
        want = plain(rows, s, 2)
        for r in got:
            expected = want[r["code"], r["pos"]]
            assert r[s.out] == (None if expected is None else pytest.approx(expected, abs=1e-12)), (s, r)


def test_no_rows_and_no_lists(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert rolling_quantiles(d, BAR, SPECS).collect() == []
    assert expanding_quantiles(d, BAR, [Quantiles("q", "x", None, (0.5,))]).collect() == []
    assert "collect_list" not in rolling_quantiles(d, BAR, SPECS)._jdf.queryExecution().executedPlan().toString()
