"""Plans of the opening breakout against their SQL where a trade is entered at a price of zero, and sums in any order."""

import datetime as dt
import os
import sys

import pytest

duckdb = pytest.importorskip("duckdb")
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

NAMES = ["beta_neutral_trades", "concentration", "cost_grid_grouping", "orb_follow", "signflip_null", "trade_cost_model", "trade_metrics", "trades_with_state"]


@pytest.fixture(scope="module")
def zero_entry(spark, tmp_path_factory):
    """Four sessions of two codes; in one the price falls to zero and a short trade starts there."""
    path = str(tmp_path_factory.mktemp("zero"))
    rows, n = [], 0
    for code, shift in (("a", 0.0), ("b", 3.0)):
        for day in range(1, 5):
            for slot in range(9):
                for k in range(3):
                    px = 50.0 + shift + [0, 4, -4, 1, 6, -7, 2, 3, 5][slot] + k + day
                    if code == "a" and day == 2 and slot >= 3:
                        px = [0.0, 20.0, 30.0][k]
                    rows.append((n, dt.datetime(2024, 1, day, 14, 30) + dt.timedelta(minutes=30 * slot + 7 * k + 1), n % 5, code, px, "{}"))
                    n += 1
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_entry_at_zero_equals_sql(spark, zero_entry, name):
    import __spark_entry__ as entry
    from check_queries import canon

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT event_id, ts::TIMESTAMP AS ts, user_id, event_type, value, props FROM '{zero_entry}/events.parquet/*.parquet'")
    got, want = entry.queries()[name](spark, zero_entry).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert canon(got) == canon(want)
