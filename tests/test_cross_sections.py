"""One result for every number of splits: text tie keys, NULL groups, NULL values and ties."""

import random

import pytest
from conftest import rows

from barloom.operators import xsec


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(6)
    data = [(rng.choice([1, 2, None]), f"T{i:03d}" if i else None, None if i % 11 == 0 else float(rng.randrange(12))) for i in range(150)]
    return spark.createDataFrame(data, "d int, ticker string, x double").repartition(3)


OPERATORS = {
    "with_stats": lambda d, n: xsec.with_stats(d, "d", {"out": xsec.F.count("x")}, n),
    "with_row_number": lambda d, n: xsec.with_row_number(d, "d", "x", "ticker", "out", splits=n),
    "with_row_number_down": lambda d, n: xsec.with_row_number(d, "d", "x", "ticker", "out", True, n),
    "rank_pct": lambda d, n: xsec.rank_pct(d, "d", "x", "ticker", "out", n),
    "top_n": lambda d, n: xsec.top_n(d, "d", "x", 9, "ticker", "out", n),
    "cost_tier": lambda d, n: xsec.cost_tier(d, "d", "x", tie="ticker", splits=n, out="out"),
    "equal_split": lambda d, n: xsec.equal_split(d, "d", "x", 4, "ticker", "out", n),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_splits_keep_every_row(spark, panel, name):
    one, seven = (rows(OPERATORS[name](panel, n).select("d", "ticker", "x", "out"), "ticker") for n in (1, 7))
    assert len(one) == panel.count() and any(r[0] is None for r in one)
    assert one == seven
