"""Turnovers that are equal stay equal, in whatever order their prints come."""

import datetime as dt

from barloom.functions.columns import stable_sum
from barloom.operators import xsec
from barloom.sources import tables


def test_equal_turnovers_share_a_cost_tier(spark, tmp_path):
    amounts = [0.1, 0.2, 0.3, 0.7]
    orders = {1: amounts, 2: amounts[::-1], 3: [0.3, 0.1, 0.7, 0.2], 4: [0.2, 0.7, 0.1, 0.3]}
    data = [(i, 1, code, i, 1.0, x, dt.datetime(2000, 1, 1 + i)) for code, xs in orders.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(data, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp")
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = xsec.cost_tier(tables.monthly_panel(spark, str(tmp_path)), "mi", "turnover").collect()
    assert {r["turnover"] for r in out} == {1.3} and {r["spread_bps"] for r in out} == {15.0}


def test_stable_sum_of_odd_values(spark):
    d = spark.createDataFrame([(1, None), (2, 1e300), (2, 1.5), (3, float("inf")), (4, float("nan")), (5, -0.1), (5, -0.2), (5, None)], "k int, x double")
    got = {r["k"]: r["s"] for r in d.groupBy("k").agg(stable_sum("x").alias("s")).collect()}
    assert got[1] is None and got[2] == 1e300 and got[3] == float("inf") and got[4] != got[4] and abs(got[5] + 0.3) < 1e-15
