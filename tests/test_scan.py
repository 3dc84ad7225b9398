"""Associative scans against loops over the rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import recursion as rec
from barloom.operators import scan


def loop(rows, trans, start):
    """Beliefs of one series of weight vectors."""
    out, b = [], start
    for t, f in enumerate(rows):
        if t:
            b = [sum(b[i] * trans[i][j] for i in range(len(b))) for j in range(len(b))]
        b = [p * w for p, w in zip(b, f, strict=True)]
        total = sum(b)
        b = [p / total for p in b]
        out.append(b)
    return out


MODELS = {
    "calm and turbulent": ([[0.95, 0.05], [0.1, 0.9]], [0.6, 0.4]),
    "three states": ([[0.8, 0.1, 0.1], [0.0, 0.5, 0.5], [0.3, 0.0, 0.7]], [1.0, 0.0, 0.0]),
    "no way back": ([[0.99, 0.01], [0.0, 1.0]], [1.0, 0.0]),
    "never a change": ([[1.0, 0.0], [0.0, 1.0]], [0.5, 0.5]),
    "one state": ([[1.0]], [1.0]),
}


@pytest.mark.parametrize("name", MODELS)
@pytest.mark.parametrize("size, levels", [(4, 1), (3, 2), (2, 3), (256, 1)])
def test_beliefs_equal_the_loop(spark, name, size, levels):
    trans, start = MODELS[name]
    rng = random.Random(3)
    series = {k: [[rng.random() + 1e-3 for _ in start] for _ in range(n)] for k, n in {"a": 1, "b": 7, "c": 33}.items()}
    rows = [(k, t, f, f"row {t}") for k, s in series.items() for t, f in enumerate(s)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "code string, pos int, f array<double>, note string")
    got = scan.beliefs(d, ["code"], "pos", F.col("f"), trans, start, "p", size, levels)
    assert got.columns == ["code", "pos", "f", "note", "p"]
    got = {(r["code"], r["pos"]): (r["note"], r["p"]) for r in got.collect()}
    assert len(got) == len(rows)
    for k, s in series.items():
        for t, p in enumerate(loop(s, trans, start)):
            assert got[k, t][0] == f"row {t}" and got[k, t][1] == pytest.approx(p, abs=1e-12)


def test_a_state_that_is_ruled_out_by_far_comes_back(spark):
    """Likelihoods of 1e-200 a row leave doubles within a block; the scale of each row of its matrix keeps them."""
    trans, start = MODELS["no way back"]
    rows = [("a", t, [1.0, 1e-200] if t < 6 else [1e-30, 1.0]) for t in range(12)]
    d = spark.createDataFrame(rows, "code string, pos long, f array<double>")
    got = [r["p"] for r in scan.beliefs(d, ["code"], "pos", F.col("f"), trans, start, "p", 4).orderBy("pos").collect()]
    for p, q in zip(got, loop([f for _, _, f in rows], trans, start), strict=True):
        assert p == pytest.approx(q, abs=1e-12)


def test_regime_filter_passes_over_missing_rows(spark):
    means, variances, trans, start = [0.0, 0.1], [1e-3, 1e-2], [[0.9, 0.1], [0.2, 0.8]], [0.5, 0.5]
    x = [0.01, None, 0.2, None, -0.3]
    d = spark.createDataFrame([("a", t, v) for t, v in enumerate(x)], "code string, pos int, x double")
    weights = [[1.0, 1.0] if v is None else [math.exp(-((v - m) ** 2) / (2 * s)) / math.sqrt(s) for m, s in zip(means, variances, strict=True)] for v in x]
    got = rec.regime_filter(d, "code", "pos", "x", means, variances, trans, start, size=2).orderBy("pos").collect()
    for row, p in zip(got, loop(weights, trans, start), strict=True):
        assert (row["p_0"], row["p_1"]) == pytest.approx(p, abs=1e-12)
    assert rec.regime_filter(d.where("false"), "code", "pos", "x", means, variances, trans, start).collect() == []


def test_regime_filter_stays_in_the_jvm(spark):
    d = spark.range(10).selectExpr("'a' as code", "id as pos", "0.1D as x")
    plan = rec.regime_filter(d, "code", "pos", "x", [0.0, 0.1], [1e-3, 1e-2], [[0.9, 0.1], [0.2, 0.8]], [0.5, 0.5])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
