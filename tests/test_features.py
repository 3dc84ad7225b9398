"""Clock frames, rolling features, recursions and the no-look-ahead harness."""

import math

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from barloom.operators import align, recursion as rec, rolling as ro, xsec
from barloom.operators.clock import Clock, with_position

BAR = Clock("code", "pos")


def path(spark, n=260, seed=1, codes=("a", "b")):
    rng = np.random.default_rng(seed)
    out = []
    for c in codes:
        px = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for i in range(n):
            o = px[i] * math.exp(rng.normal(0, 0.005))
            out.append((c, i, float(o), float(max(o, px[i]) * 1.01), float(min(o, px[i]) * 0.99), float(px[i]), float(rng.integers(1, 100))))
    pdf = pd.DataFrame(out, columns=["code", "pos", "open", "high", "low", "close", "volume"])
    pdf["lp"] = np.log(pdf.close)
    pdf["lret"] = pdf.groupby("code").lp.diff()
    pdf["d_close"] = pdf.groupby("code").close.diff()
    return pdf


def to_spark(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "code string, pos int, open double, high double, low double, close double, volume double, lp double, lret double, d_close double")


FEATURES = {
    "roll": lambda d: d.withColumn("y", BAR.full(F.stddev_samp, "lret", 20)),
    "quantile": lambda d: ro.rolling_quantile(d, BAR, "lret", 60, [0.7], 0, 20).withColumn("y", F.col("q")[0]),
    "mom": lambda d: d.withColumn("y", ro.momentum(BAR, "close", 12, 1)),
    "vol_state": lambda d: d.withColumn("y", ro.vol_state(BAR, "lret")),
    "z": lambda d: d.withColumn("y", ro.zscore(BAR, "close", 20)),
    "channel": lambda d: ro.channel(d, BAR, "lp", 40).withColumn("y", F.col("upper")),
    "er": lambda d: d.withColumn("y", ro.efficiency_ratio(BAR, "close", 20)),
    "relvol": lambda d: ro.relative_volume(d, BAR, "volume", out="y"),
    "cs": lambda d: ro.corwin_schultz(d, BAR, 20).withColumn("y", F.col("cs_spread")),
    "macd": lambda d: rec.macd(d, "code", "pos", "close").withColumn("y", F.col("macd_hist")),
    "gate": lambda d: rec.macd(d, "code", "pos", "close").withColumn("y", F.col("macd_long").cast("double")),
    "wilder": lambda d: rec.wilder_atr(d.withColumn("tr", ro.true_range(BAR)), "code", "pos", "tr", 14, "y"),
    "drift": lambda d: ro.drift_by_prefix(d, BAR, "lret", [5, 20]).withColumn("y", F.col("drift_20")),
    "retrench": lambda d: rec.second_cross(rec.macd(d, "code", "pos", "close"), "code", "pos", "macd_state", 20).withColumn("y", F.col("retrench").cast("double")),
    "regime": lambda d: rec.regime_filter(d.where("pos > 0").select("code", "pos", "lret"), "code", "pos", "lret", [0.0, 0.0], [1e-4, 1e-3], [[0.9, 0.1], [0.1, 0.9]], [0.5, 0.5]).withColumn("y", F.col("p_1")),
    "nlms": lambda d: rec.online_forecast(d.where("pos > 0").select("code", "pos", "lret"), "code", "pos", "lret", 3, lambda n: rec.Nlms(n), "y"),
}


@pytest.mark.parametrize("name", sorted(FEATURES))
def test_no_look_ahead(spark, name):
    base = path(spark, 260)
    bumped = base.copy()
    late = bumped.pos >= 180
    for c in ("open", "high", "low", "close", "volume"):
        bumped.loc[late, c] *= 1.7
    bumped["lp"] = np.log(bumped.close)
    bumped["lret"] = bumped.groupby("code").lp.diff()
    bumped["d_close"] = bumped.groupby("code").close.diff()
    past = []
    for pdf in (base, bumped):
        out = FEATURES[name](to_spark(spark, pdf)).where("pos < 180").select("code", "pos", "y")
        past.append(rows(out, "code", "pos"))
    assert len(past[0]) >= 350
    for a, b in zip(*past):
        assert a[:2] == b[:2]
        assert (a[2] is None) == (b[2] is None)
        if a[2] is not None:
            assert a[2] == pytest.approx(b[2], rel=1e-9, abs=1e-12)


def test_gap_nulls_the_window_on_the_calendar_clock(spark):
    d = spark.createDataFrame([("a", i, float(i)) for i in (0, 1, 2, 4, 5, 6)], "code string, cal int, x double")
    c = Clock("code", "cal")
    got = dict((r["cal"], (r["m"], r["l"])) for r in d.withColumns({"m": c.full(F.avg, "x", 3), "l": c.at("x", -1)}).collect())
    assert got[2] == (1.0, 1.0) and got[4] == (None, None) and got[5][0] is None and got[6] == (5.0, 5.0)


def test_densify_is_linear_and_leaves_gaps_null(spark):
    d = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0), ("b", 0, 3.0)], "code string, cal int, x double")
    assert rows(align.densify(d, "code", "cal"), "code", "cal") == [("a", 2, 1.0), ("a", 3, None), ("a", 4, None), ("a", 5, 2.0), ("b", 0, 3.0)]


@pytest.mark.parametrize("adjust", [False, True])
def test_ewma_matches_pandas_across_chunks(spark, adjust):
    pdf = path(spark, 700)
    lam = [0.5, 0.846, 0.94, 0.99]
    d = to_spark(spark, pdf)
    out = rec.ewma(d, ["code"], "pos", [(f"e{i}", F.col("close"), v) for i, v in enumerate(lam)], adjust=adjust).toPandas().sort_values(["code", "pos"])
    for i, v in enumerate(lam):
        want = pdf.groupby("code").close.transform(lambda s: s.ewm(alpha=1 - v, adjust=adjust).mean())
        assert np.allclose(out[f"e{i}"].to_numpy(), want.to_numpy(), rtol=1e-11)


def test_macd_matches_pandas(spark):
    pdf = path(spark, 300)
    out = rec.macd(to_spark(spark, pdf), "code", "pos", "close").toPandas().sort_values(["code", "pos"]).reset_index(drop=True)
    for c, g in pdf.groupby("code"):
        e = lambda s, n: s.ewm(span=n, adjust=False).mean()
        line = e(g.close, 12) - e(g.close, 26)
        state = line > e(line, 9)
        got = out[out.code == c]
        assert np.allclose(got.macd_line, line, atol=1e-10)
        assert (got.macd_long.to_numpy() == state.shift(1, fill_value=False).to_numpy()).all()


def test_hysteresis_fixture_and_random_against_loop(spark):
    d = spark.createDataFrame([("f", i, bool(e), bool(x)) for i, (e, x) in enumerate(zip([0, 1, 0, 0, 1], [1, 1, 1, 0, 1]))], "k string, i int, e boolean, x boolean")
    assert [r["held"] for r in rec.hysteresis(d, ["k"], "i", "e", "x").orderBy("i").collect()] == [False, True, True, False, True]
    rng = np.random.default_rng(0)
    data, want = [], {}
    for k in range(30):
        held = False
        for i in range(60):
            e, x = bool(rng.random() < 0.4), bool(rng.random() < 0.6)
            held = x if held else e
            data.append((str(k), i, e, x))
            want[(str(k), i)] = held
    got = rec.hysteresis(spark.createDataFrame(data, d.schema), ["k"], "i", "e", "x").collect()
    assert all(r["held"] == want[(r["k"], r["i"])] for r in got)
    same = rec.hysteresis(d.withColumn("x", F.col("e")), ["k"], "i", "e", "x").collect()
    assert all(r["held"] == r["e"] for r in same)


def test_second_cross_against_loop(spark):
    rng = np.random.default_rng(3)
    data, want = [], set()
    for k in range(30):
        c = rng.random(120) < 0.5
        armed = None
        for i in range(1, 120):
            if c[i] and not c[i - 1]:
                if armed is not None and i - armed <= 4:
                    want.add((str(k), i))
                    armed = None
                else:
                    armed = i
        data += [(str(k), i, bool(c[i])) for i in range(120)]
    d = spark.createDataFrame(data, "k string, pos int, s boolean")
    got = {(r["k"], r["pos"]) for r in rec.second_cross(d, "k", "pos", "s", 4).where("retrench").collect()}
    assert got == want


def test_wilder_atr_by_hand(spark):
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, 3.0, 7.0, 5.0])], "code string, pos int, tr double")
    got = [r["atr"] for r in rec.wilder_atr(d, "code", "pos", "tr", 3).orderBy("pos").collect()]
    assert got[:2] == [None, None] and got[2:] == pytest.approx([2.0, 11 / 3, (11 / 3 * 2 + 5) / 3])


def test_channel_on_exact_line(spark):
    d = spark.createDataFrame([("a", i, 1.0 + 0.01 * i) for i in range(50)], "code string, pos int, lp double")
    r = ro.channel(d, BAR, "lp", 20).orderBy(F.col("pos").desc()).head()
    assert r["gradient"] == pytest.approx(0.01) and r["r2"] == pytest.approx(1.0) and r["sigma"] == pytest.approx(0.0, abs=1e-6)


def test_first_true_range_options(spark):
    d = spark.createDataFrame([("a", 0, 5.0, 3.0, 4.0), ("a", 1, 9.0, 8.0, 8.5)], "code string, pos int, high double, low double, close double")
    got = rows(d.select("pos", ro.true_range(BAR).alias("a"), ro.true_range(BAR, True).alias("b")), "pos")
    assert got == [(0, 2.0, None), (1, 5.0, 5.0)]


def test_asof_picks_last_available(spark):
    import datetime as dt

    left = spark.createDataFrame([("a", dt.date(2024, 1, 31)), ("a", dt.date(2024, 3, 31)), ("b", dt.date(2024, 3, 31))], "code string, month date")
    right = spark.createDataFrame([("a", dt.date(2024, 2, 1), 1.0, 1), ("a", dt.date(2024, 3, 31), 2.0, 1), ("a", dt.date(2024, 3, 31), 3.0, 2)], "code string, avail date, v double, seq int")
    got = rows(align.asof_last(left, right, "code", "month", "avail", ["v"], "seq").select("code", "month", "v"), "code", "month")
    assert [g[2] for g in got] == [None, 3.0, None]


def test_nearest_pays_each_dividend_once(spark):
    import datetime as dt

    ev = spark.createDataFrame([("a", dt.date(2024, 1, 6))], "code string, ex date")
    days = spark.createDataFrame([("a", dt.date(2024, 1, x)) for x in (4, 5, 8, 9)], "code string, date date")
    assert [r["snap_date"].day for r in align.nearest_within(ev, days, "code", "ex", "date", 3).collect()] == [5]


def test_split_cross_section_equals_window(spark):
    rng = np.random.default_rng(5)
    data = [(m, i, float(v) if rng.random() > 0.1 else None) for m in range(3) for i, v in enumerate(rng.choice([0.0, 0.0, 0.0, 1.0, 2.0, 5.5, 7.0], 300) + rng.choice([0, 0.5], 300))]
    d = spark.createDataFrame(data, "m int, code int, x double")
    for desc in (False, True):
        a = rows(xsec.with_row_number(d, "m", "x", "code", "rn", desc, 1).select("m", "code", "rn"), "m", "code")
        b = rows(xsec.with_row_number(d, "m", "x", "code", "rn", desc, 5).select("m", "code", "rn"), "m", "code")
        assert a == b
    for fn in (lambda s: xsec.rank_pct(d, "m", "x", "code", "y", s), lambda s: xsec.zscore(d, "m", "x", "y", s), lambda s: xsec.equal_split(d, "m", "x", 7, "code", "y", s),
               lambda s: xsec.qcut(d, "m", "x", 4, "code", s, "y"), lambda s: xsec.top_n(d, "m", "x", 9, "code", "y", s)):
        a, b = (rows(fn(s).select("m", "code", F.col("y").cast("double").alias("y")), "m", "code") for s in (1, 5))
        assert len(a) == len(b) and all(p[:2] == q[:2] and (p[2] == q[2] or p[2] == pytest.approx(q[2])) for p, q in zip(a, b))
    q1, q5 = (rows(xsec.quantiles(d, "m", "x", [0.1, 0.5, 0.93], "code", s), "m") for s in (1, 5))
    assert [list(map(float, r[1])) for r in q1] == [pytest.approx(list(r[1])) for r in q5]


def test_positions(spark):
    d = spark.createDataFrame([("a", 5), ("a", 3)], "code string, date int")
    assert rows(with_position(d, "code", "date"), "date") == [("a", 3, 0), ("a", 5, 1)]
