"""Statistics, resampling, scoring, shapes and batch = stream equality."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from barloom.functions import arrays as fa
from barloom.functions.columns import norm_ppf
from barloom.operators import forecast as fo
from barloom.operators import recursion as rec
from barloom.operators import resampling as rs
from barloom.operators import shapes, stats
from barloom.operators.clock import Clock
from barloom.session import shared_dir
from barloom.streaming import bars, state


def test_ols_matches_numpy_pooled_and_walk_forward(spark):
    rng = np.random.default_rng(0)
    x, e = rng.normal(size=(120, 2)), rng.normal(size=120)
    y = 1 + x @ [2, -3] + e
    d = spark.createDataFrame([("a", i, *map(float, x[i]), float(y[i])) for i in range(120)], "k string, pos int, x1 double, x2 double, y double")
    X = np.c_[np.ones(120), x]
    assert stats.fit_ols(d, ["x1", "x2"], "y").head()["coef"] == pytest.approx(np.linalg.lstsq(X, y, rcond=None)[0].tolist())
    wf = {r["pos"]: r["pred"] for r in stats.walk_forward_ols(d, ["k"], "pos", ["x1", "x2"], "y", 3, 30).collect()}
    assert wf[20] is None
    for t in (40, 100):
        b = np.linalg.lstsq(X[: t - 2], y[: t - 2], rcond=None)[0]
        assert wf[t] == pytest.approx(float(X[t] @ b))


def test_walk_forward_select_switches(spark):
    data = [(k, i, (0.01 if (k == "A") == (i < 60) else -0.01)) for k in "AB" for i in range(120)]
    d = spark.createDataFrame(data, "key string, step int, ret double")
    picks = [r["pick"] for r in stats.walk_forward_select(d, "key", "step", "ret", 20, 10).orderBy("step").collect()]
    assert picks[0] == "A" and picks[-1] == "B" and len(picks) == 100


def test_auc(spark):
    d = spark.createDataFrame([(i, float(i), i >= 6) for i in range(10)], "id int, s double, y boolean")
    assert stats.rank_auc(d, "y", "s", "id").head()["auc"] == 1.0


def test_permutation_keeps_values_and_nulls(spark):
    d = spark.createDataFrame([("a", i, None if i % 7 == 0 else float(i)) for i in range(40)], "code string, pos int, x double")
    p = rs.permute_within(rs.with_replicas(d, 3), ["code"], "pos", "x", 1, out="y").toPandas()
    for _, g in p.groupby("rep"):
        assert sorted(g.y.dropna()) == sorted(g.x.dropna()) and (g.y.isna() == g.x.isna()).all() and not g.y.equals(g.x)


def test_hash_uniform_and_normal(spark):
    d = spark.range(20000).select(rs.hash_unit(1, F.col("id")).alias("u"), rs.hash_normal(1, F.col("id")).alias("z"), rs.random_sign(1, F.col("id")).alias("s")).toPandas()
    assert abs(d.u.mean() - 0.5) < 0.01 and abs(d.u.std() - 12**-0.5) < 0.01
    assert abs(d.z.mean()) < 0.03 and abs(d.z.std() - 1) < 0.03 and abs(d.s.mean()) < 0.03


def test_block_bootstrap_interval(spark):
    rng = np.random.default_rng(1)
    d = spark.createDataFrame([(int(i // 20), float(v)) for i, v in enumerate(rng.normal(0.5, 1, 2000))], "b int, v double")
    r = rs.block_bootstrap(spark, d, "b", "v", 400, 3, [0.025, 0.975]).head()
    assert r["q"][0] < r["mean"] < r["q"][1] and abs((r["q"][1] - r["q"][0]) - 2 * 1.96 / 2000**0.5) < 0.03


def test_surrogates_keep_their_invariants(spark):
    rng = np.random.default_rng(2)
    vol = np.repeat([0.5, 2.0], 150)
    r = rng.normal(size=300) * vol
    d = rs.with_replicas(spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(r)], "code string, pos int, lret double"), 1)
    out = {k: rs.surrogates(d, ["code"], "pos", "lret", k, 5).orderBy("pos").toPandas().sur.to_numpy() for k in ("shuffle", "signflip", "normal", "fhs")}
    assert np.allclose(np.sort(out["shuffle"]), np.sort(r))
    assert out["signflip"].std() == pytest.approx(r.std(), rel=1e-6)
    assert abs(out["normal"].std() / r.std() - 1) < 0.2
    half = lambda x: x[150:].std() / x[:150].std()
    assert half(out["fhs"]) > 2 and half(out["shuffle"]) < 2


def test_crps_closed_forms(spark):
    lv = fo.dense_levels()
    z = norm_ppf(lv)
    d = spark.createDataFrame([([2.0] * len(lv), 5.0), (z, 0.0)], "q array<double>, y double")
    got = [r["crps"] for r in fo.score(d, lv).collect()]
    assert got[0] == pytest.approx(3.0, abs=0.01) and got[1] == pytest.approx(0.2337, abs=0.002)


def test_interval_includes_bounds_and_pit_clamps(spark):
    d = spark.createDataFrame([(-2.0,), (0.0,), (0.5,), (1.0,), (9.0,)], "y double").withColumn("q", fa.lit_array([-1.0, 0.0, 1.0]))
    got = [r[0] for r in d.select(fa.pit("q", "y", [0.1, 0.5, 0.9])).collect()]
    assert got == pytest.approx([0.1, 0.5, 0.7, 0.9, 0.9])
    hit = [r[0] for r in d.select(fa.interval_hit(F.lit(0.0), F.lit(1.0), F.col("y"))).collect()]
    assert hit == [False, True, True, True, False]


def test_pit_uniform_for_true_model(spark):
    rng = np.random.default_rng(3)
    lv = fo.dense_levels(0.02)
    d = spark.createDataFrame([(float(v),) for v in rng.normal(size=3000)], "y double").withColumn("q", fa.lit_array(norm_ppf(lv)))
    p = np.array([r["pit"] for r in fo.score(d, lv).select("pit").collect()])
    assert abs(p.mean() - 0.5) < 0.02 and abs(np.quantile(p, 0.25) - 0.25) < 0.03


def test_combination_averages_grids(spark):
    d = spark.createDataFrame([("a", [0.0, 2.0]), ("a", [2.0, 4.0])], "k string, q array<double>")
    assert fo.combine(d, ["k"]).head()["q"] == [1.0, 3.0]


def test_simulated_forecasters_have_the_right_spread(spark):
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([("s", 1, rng.normal(0, 1, 400).tolist())], "series string, origin int, win array<double>")
    lv = [0.05, 0.5, 0.95]
    g = fo.simulate_origins(d, "series", "origin", "win", 4, lv, list(fo.FORECASTERS), 4000).toPandas()
    assert len(g) == 16
    for _, r in g.iterrows():
        assert abs(r.q[2] - r.q[0] - 2 * 1.645 * r.h**0.5) < 0.35 * 2 * 1.645 * r.h**0.5
    again = fo.simulate_origins(d.repartition(3), "series", "origin", "win", 4, lv, ["iid"], 4000).toPandas()
    assert np.array_equal(np.stack(again.q.tolist()), np.stack(g[g.model == "iid"].q.tolist()))


def test_expert_variances_against_loop(spark):
    rng = np.random.default_rng(5)
    r = rng.normal(size=80)
    d = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(r)], "code string, pos int, lret double")
    out = fo.expert_variances(d, "code", "pos", "lret").orderBy("pos").toPandas()
    a, v, lev = 1 - math.exp(-math.log(2) / 3.0), r[0] ** 2, 2 * r[0] ** 2 * (r[0] < 0)
    al = 1 - math.exp(-math.log(2) / 10.0)
    for i in range(1, 80):
        v, lev = (1 - a) * v + a * r[i - 1] ** 2, (1 - al) * lev + al * 2 * r[i - 1] ** 2 * (r[i - 1] < 0)
        assert out.v_short[i] == pytest.approx(v) and out.v_lev[i] == pytest.approx(lev)
        assert out.v_mean[i] == pytest.approx((r[:i] ** 2).mean())


def test_windows_anchor_and_positions(spark):
    rng = np.random.default_rng(7)
    lp = np.cumsum(rng.normal(0, 0.01, 500))
    d = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(lp)], "code string, pos int, lp double")
    w = shapes.vol_scaled_windows(d, ["code"], "pos", "lp", 60, 32, 5, 60).orderBy("pos").toPandas()
    assert ((w.pos - 59) % 5 == 0).all() and w.pos.min() >= 119
    r = np.diff(lp)
    for _, x in w.iloc[::20].iterrows():
        s = x.pos - 59
        sd = r[s - 60: s].std()
        want = np.interp(np.linspace(0, 1, 32), np.linspace(0, 1, 60), (lp[s: s + 60] - lp[s]) / (sd * 60**0.5))
        assert len(x["shape"]) == 32 and np.allclose(x["shape"], want)


def test_linear_shapes_match_svd(spark):
    rng = np.random.default_rng(8)
    w = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6))
    d = spark.createDataFrame([(x.tolist(),) for x in w], "a array<double>")
    comp, share = shapes.linear_shapes(d, "a", 6, 3)
    _, s, vt = np.linalg.svd(w, full_matrices=False)
    assert np.allclose(np.abs((comp * vt[:3]).sum(axis=1)), 1) and np.allclose(share, (s**2 / (s**2).sum())[:3])
    assert stats.subspace_alignment(comp, vt[:3]) == pytest.approx(1.0) and stats.harmonic_r2(np.sin(2 * np.pi * np.linspace(0, 1, 40))[None]) == pytest.approx(1.0)


def test_mixture_and_learners_against_plain_loops(spark):
    rng = np.random.default_rng(9)
    y = np.abs(rng.normal(1, 0.3, 60))
    e = np.c_[y + rng.normal(0, 0.1, 60), y + rng.normal(0, 0.5, 60)]
    d = spark.createDataFrame([("a", i, float(e[i, 0]), float(e[i, 1]), float(y[i])) for i in range(60)], "k string, pos int, a double, b double, y double")
    out = rec.hedge_mixture(d, "k", "pos", ["a", "b"], "y", eta=2.0).orderBy("pos").toPandas()
    assert out.mix_pred[0] == pytest.approx(e[0].mean()) and out.mix_weights.iloc[-1][0] > 0.9
    z = rec.online_forecast(d, "k", "pos", "y", 2, lambda n: rec.Idbd(n)).toPandas()
    assert z.pred.notna().sum() == 58
    err = (z.pred - z.y).abs()
    assert err.iloc[40:].mean() < err.iloc[2:12].mean()


# ---- streaming -----------------------------------------------------------------------------------

def _tick_files(spark, batches):
    folder = shared_dir(spark, "ticks")
    i = 0
    for n, b in enumerate(batches):
        out = []
        for code, ts, px in b:
            out.append((i, ts, 1, code, px, "{}"))
            i += 1
        spark.createDataFrame(out, bars.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder


T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def _run_in_two_steps(spark, build, first, second):
    """Feed one file, drain, feed a later one, drain again with the same checkpoint."""
    folder, out, ck = shared_dir(spark, "in"), shared_dir(spark, "out"), shared_dir(spark, "ck")
    res = None
    i = 0
    for part in (first, second):
        data = []
        for c, t, x in part:
            data.append((i, t, 1, c, x, "{}"))
            i += 1
        spark.createDataFrame(data, bars.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        res = bars.run_to_table(build(bars.tick_stream(spark, folder)), path=out, checkpoint=ck)
    return res


def test_late_row_is_dropped_by_the_watermark(spark):
    first = [("a", at(0), 1.0), ("a", at(3), 2.0), ("a", at(120), 9.0)]
    second = [("a", at(1), 100.0), ("a", at(121), 8.0), ("a", at(300), 1.0)]
    out = _run_in_two_steps(spark, lambda s: bars.window_bars(s, "5 minutes", "10 minutes"), first, second)
    got = {r["start"]: (r["high"], r["n"]) for r in out.collect()}
    assert got[at(0)] == (2.0, 2) and got[at(120)] == (9.0, 2)


def test_stream_ewma_continues_across_runs_and_drops_stale_rows(spark):
    rng = np.random.default_rng(0)
    x = [("a", at(i), float(v)) for i, v in enumerate(rng.random(30))]
    out = _run_in_two_steps(spark, lambda s: state.keyed_state(s, "code", "ts", "price", state.ewma_step(0.9)), x[:20], x[20:] + [("a", at(2), 5.0)])
    got = out.orderBy("ts").toPandas()
    want = pd.Series([v for _, _, v in x]).ewm(alpha=0.1, adjust=False).mean().shift(1)
    assert np.allclose(got.prior.to_numpy()[1:], want.to_numpy()[1:]) and got.dropped.max() == 1 and len(got) == 30


def test_stream_regime_and_drawdown_equal_batch(spark):
    rng = np.random.default_rng(1)
    x = [("a", at(i), float(v)) for i, v in enumerate(rng.normal(0, 0.02, 40))]
    args = ([0.0, 0.0], [1e-4, 1e-3], [[0.9, 0.1], [0.2, 0.8]], [0.5, 0.5])
    out = _run_in_two_steps(spark, lambda s: state.keyed_state(s, "code", "ts", "price", state.regime_step(*args)), x[:25], x[25:]).orderBy("ts").toPandas()
    d = spark.createDataFrame([("a", i, v) for i, (_, _, v) in enumerate(x)], "code string, pos int, x double")
    batch = rec.regime_filter(d, "code", "pos", "x", *args).orderBy("pos").toPandas()
    assert np.allclose(out.prior.to_numpy()[1:], batch.p_1.to_numpy()[:-1])
    dd = _run_in_two_steps(spark, lambda s: state.keyed_state(s, "code", "ts", "price", state.drawdown_step()), x[:25], x[25:]).orderBy("ts").toPandas()
    w = np.cumprod(1 + np.array([v for _, _, v in x]))
    assert np.allclose(dd.prior.to_numpy()[1:], (w / np.maximum.accumulate(w) - 1)[:-1])


def test_stream_nlms_equals_batch(spark):
    rng = np.random.default_rng(2)
    x = [("a", at(i), float(v)) for i, v in enumerate(rng.random(40))]
    out = _run_in_two_steps(spark, lambda s: state.keyed_state(s, "code", "ts", "price", state.nlms_step(3)), x[:11], x[11:]).orderBy("ts").toPandas()
    d = spark.createDataFrame([("a", i, v) for i, (_, _, v) in enumerate(x)], "code string, pos int, x double")
    batch = rec.online_forecast(d, "code", "pos", "x", 3, lambda n: rec.Nlms(n)).orderBy("pos").toPandas()
    assert np.allclose(out.prior.to_numpy()[3:], batch.pred.to_numpy()[3:])


def test_upsert_stream_last_write_wins(spark):
    folder, path, ck = shared_dir(spark, "in"), shared_dir(spark, "tab"), shared_dir(spark, "ck")
    for n, px in enumerate((1.0, 7.0)):
        data = [(0, at(5), 1, "a", px, "{}")] + ([(1, at(60 * 24 + 5), 1, "a", 3.0, "{}")] if n == 0 else [])
        spark.createDataFrame(data, bars.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        s = bars.tick_stream(spark, folder).withColumn("day", F.to_date("ts")).select("code", "ts", "price", "day")
        out = bars.run_upsert(s, ["code", "ts"], "day", path, ck)
    assert rows(out.select("ts", "price"), "ts") == [(at(5), 7.0), (at(60 * 24 + 5), 3.0)]


def test_batch_sessions_with_a_hot_key_equal_a_plain_walk(spark):
    rng = np.random.default_rng(3)
    data = [("hot", float(m)) for m in np.cumsum(rng.exponential(8, 600))] + [("b", float(m)) for m in np.cumsum(rng.exponential(60, 60))]
    df = spark.createDataFrame([(k, T0 + dt.timedelta(minutes=m), 1.0) for k, m in data], "k string, ts timestamp, price double")
    got = sorted((r["k"], r["n"]) for r in bars.batch_sessions(df, "k", 30, chunk_minutes=60).collect())
    want = []
    for k in ("hot", "b"):
        t = sorted(m for c, m in data if c == k)
        size = 1
        for a, b in zip(t, t[1:]):
            if b - a >= 30:
                want.append((k, size))
                size = 0
            size += 1
        want.append((k, size))
    assert got == sorted(want)


def test_stream_plans_do_not_depend_on_files_or_their_order(spark, tmp_path):
    """Events in 8 shuffled files of a folder, one or two a trigger, give the rows of one file, open windows and ties too."""
    rng = np.random.default_rng(7)
    data = [(i, at(float(m)), int(u), c, float(p), "{}") for i, (m, u, c, p) in enumerate(zip(rng.integers(0, 3000, 400), rng.integers(0, 4, 400), rng.choice(["a", "b"], 400), rng.random(400)))]
    one, many = str(tmp_path / "one.parquet"), str(tmp_path / "many.parquet")
    spark.createDataFrame(data, bars.EVENT_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "folder"))
    next((tmp_path / "folder").glob("part-*")).rename(one)
    for part in np.array_split(rng.permutation(400), 8):
        spark.createDataFrame([data[i] for i in part], bars.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(many)
    for part, merge in (
        (lambda b: bars.bar_parts(b, "30 minutes"), bars.merge_bar_parts),
        (lambda b: bars.bar_parts(b, "60 minutes", "30 minutes"), bars.merge_bar_parts),
        (lambda b: bars.session_parts(b, "user_id"), lambda p: bars.chain_sessions(p, "user_id", 120)),
    ):
        got = [sorted(map(str, merge(bars.run_parts(bars.tick_stream(spark, path, n), part)).withColumn("x", F.lit(0)).collect())) for path, n in ((one, 100), (many, 1), (many, 2))]
        assert [[r.split("total=")[0] for r in g] for g in got] == [[r.split("total=")[0] for r in got[0]]] * 3
    bar = bars.merge_bar_parts(bars.run_parts(bars.tick_stream(spark, many, 1), lambda b: bars.bar_parts(b, "30 minutes"))).collect()
    assert sum(r["n"] for r in bar) == 400
    r = bar[0]
    inside = sorted((t, i, p) for i, t, _, c, p, _ in data if c == r["code"] and r["start"] <= t < r["end"])
    assert (r["open"], r["close"]) == (inside[0][2], inside[-1][2])


def test_keyed_state_keeps_equal_timestamps(spark):
    x = [("a", at(0), 1.0), ("a", at(1), 2.0), ("a", at(1), 3.0)]
    out = _run_in_two_steps(spark, lambda s: state.keyed_state(s, "code", "ts", "price", state.ewma_step(0.5), tie="event_id"), x, [("a", at(1), 4.0), ("a", at(0), 9.0)])
    assert sorted(r["price"] for r in out.collect()) == [1.0, 2.0, 3.0, 4.0]


def test_intervals_need_their_levels(spark):
    d = spark.createDataFrame([([-2.0, -1.0, 0.0, 1.0, 2.0], 1.5)], "q array<double>, y double")
    grid = [0.05, 0.25, 0.5, 0.75, 0.95]
    assert [c for c in fo.score(d, grid).columns if c.startswith("hit_")] == ["hit_50", "hit_90"]
    row = fo.summarise(fo.score(d, grid), []).first().asDict()
    assert (row["cov_50"], row["cov_90"]) == (0.0, 1.0) and "cov_95" not in row
    with pytest.raises(ValueError):
        fo.score(d, grid, intervals=[0.95])


def test_a_singular_row_does_not_change_its_batch():
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(30), rng.normal(size=30), rng.normal(size=30) * 1e-7])
    y = rng.normal(size=30)

    def flat(x):
        a = x.T @ x
        return np.concatenate([a[np.triu_indices(3)], x.T @ y])

    alone = stats._solve_batch(flat(x)[None], 3)[0]
    twice = x.copy()
    twice[:, 2] = twice[:, 1]
    both = stats._solve_batch(np.stack([flat(x), flat(twice), np.full(9, np.nan)]), 3)
    assert np.array_equal(both[0], alone) and np.allclose(alone, np.linalg.lstsq(x, y, rcond=None)[0])
    assert np.allclose(both[1], np.linalg.lstsq(twice, y, rcond=None)[0]) and np.isnan(both[2]).all()
