"""Permutations inside arrays against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import replicas as rp


def plain_draw(seed, replica, series, order):
    u = (order + rp.BY_REPLICA * replica + rp.BY_SERIES * series + seed) % 2**32
    for shift in (13, 15):
        u = u * rp.MIX % 2**32
        u ^= u >> shift
    return u


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(8)
    return {s: sorted((int(o), float(v), float(w)) for o, v, w in zip(rng.choice(500, n, replace=False), rng.normal(size=n), rng.normal(size=n), strict=True)) for s, n in {3: 1, 70000: 40, 9: 173}.items()}


@pytest.mark.parametrize("blocks, step", [(1, rp.STEP), (4, 100)])
def test_sums_of_replicas_equal_plain_permutations(spark, series, monkeypatch, blocks, step):
    monkeypatch.setattr(rp, "STEP", step)
    data = [(s, *row) for s, rows in series.items() for row in rows] + [(9, 1000, None, 1.0)]
    d = spark.createDataFrame(data, "code long, at long, v double, w double").orderBy(F.rand(3))
    rule = {r["rep"]: r for r in rp.permuted_sums(d, "code", "at", "v", rp.follow_the_mean(3), ["s", "n"], 7, 5, blocks=blocks).collect()}
    corr = {r["rep"]: r["c"] for r in rp.permuted_sums(d, "code", "at", "v", rp.moments_with("w"), ["n", "x", "xx", "y", "yy", "xy"], 7, 5, ("w",), blocks).withColumn("c", rp.correlation()).collect()}
    assert sorted(rule) == sorted(corr) == list(range(7))
    for rep in range(7):
        total, xs, ys = 0.0, [], []
        for s, rows in series.items():
            pick = sorted(range(len(rows)), key=lambda i: (plain_draw(5, rep, s, rows[i][0]), i))
            new = [rows[i][1] for i in pick]
            total += sum(v for i, v in enumerate(new) if sum(new[max(i - 3, 0) : i]) > 0)
            xs += [w for _, _, w in rows]
            ys += new
        assert rule[rep]["n"] == len(xs) and rule[rep]["s"] == pytest.approx(total, abs=1e-9)
        assert corr[rep] == pytest.approx(np.corrcoef(xs, ys)[0, 1], abs=1e-9)


def test_draws_are_even():
    """Every element comes to every place about as often."""
    n, reps = 10, 4000
    picks = rp.permutations(1, np.arange(reps), 5, np.arange(n))
    assert (np.sort(picks, axis=1) == np.arange(n)).all()
    for place in range(n):
        share = np.bincount(picks[:, place], minlength=n) / reps
        assert np.abs(share - 1 / n).max() < 0.03


def test_no_rows_no_replicas(spark):
    d = spark.createDataFrame([], "code long, at long, v double")
    assert rp.permuted_sums(d, "code", "at", "v", rp.follow_the_mean(3), ["s", "n"], 7, 5).collect() == []
