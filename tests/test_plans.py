"""A cross-section of the registered plans against their SQL text on the smallest tables."""

import os
import subprocess
import sys

import pytest

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("PLAN_SF_DIR", "/root/testdata/sf0.001")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

NAMES = [
    "panel_daily_ohlcv", "scan_locale_prices", "asof_statements", "dividend_snap", "weekly_last", "roll_minobs_mean", "channel_ols", "macd_state",
    "composite_score", "mom_long_short", "timing_book", "tiered_cost_book", "orb_follow", "hmm_filter", "permutation_null", "pit_values", "shape_features",
    "stream_bars_tumbling", "batch_sessions", "fade_scalper", "surrogate_series", "scan_file_per_key", "windows_vol_scaled", "roll_quantile",
]


def test_registry_loads_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), len(o))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_plan_equals_sql(spark, name):
    import __spark_entry__ as entry
    from check_queries import TABLES, canon

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_scans_read_only_what_they_need(spark):
    from barloom import plans

    plans.load()
    plan = plans.QUERIES["scan_projection"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "l_comment" not in plan and "l_tax" not in plan
