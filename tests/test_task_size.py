"""The tasks that hold an instrument's windows grow in number with the line items, not in size."""

import datetime as dt

import pytest
from conftest import rows

from barloom import plans
from barloom.plans import books
from barloom.sources import tables


@pytest.fixture(scope="module")
def items(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("items"))
    data = [(i, 1, i % 40, i % 7, 1.0 + i % 5, 10.0 + i * 37 % 101, dt.datetime(2000, 1, 1) + dt.timedelta(days=i // 40)) for i in range(4000)]
    df = spark.createDataFrame(data, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp")
    df.coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.mark.parametrize("name", ["macd_state", "expert_variances", "phase_shift_monthly"])
def test_tasks_grow_with_line_items(spark, items, monkeypatch, name):
    plans.load()
    order = ["code", "pos"] if name == "expert_variances" else ["code", "mi", "shift"] if name == "phase_shift_monthly" else ["code", "date"]
    want = rows(plans.QUERIES[name](spark, items), *order)
    monkeypatch.setattr(tables, "PRINTS_PER_TASK", 100, raising=False)
    got = plans.QUERIES[name](spark, items)
    assert got.rdd.getNumPartitions() == 40
    assert rows(got, *order) == want


def test_surrogates_share_one_shuffle(spark, items, monkeypatch):
    plans.load()
    want = rows(plans.QUERIES["surrogate_series"](spark, items), "kind", "rep")
    monkeypatch.setattr(tables, "PRINTS_PER_TASK", 100, raising=False)
    got = plans.QUERIES["surrogate_series"](spark, items)
    assert rows(got, "kind", "rep") == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the join of values to their places is an aggregation within the dealt series
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", ["execution_abc", "timing_book", "timing_book_concentrated"])
def test_prints_are_dealt_before_they_are_aggregated(spark, items, monkeypatch, name):
    plans.load()
    monkeypatch.setattr(books, "splits", lambda *_: 1)
    want = rows(plans.QUERIES[name](spark, items), "date")
    monkeypatch.setattr(tables, "PRINTS_PER_TASK", 100, raising=False)
    got = plans.QUERIES[name](spark, items)
    assert rows(got, "date") == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line for line in plan.splitlines() if "RepartitionByExpression" in line and line.rstrip().endswith("40")]
    # prints by (code, date), days by code and, for cross-sections, by calendar day
    assert len(dealt) >= (2 if name == "execution_abc" else 3), plan
