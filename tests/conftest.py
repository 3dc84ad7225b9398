import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.streaming.stateStore.stateSchemaCheck": "true"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df, *order):
    """Rows as tuples in a fixed order."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def approx(values, tol=1e-9):
    return pytest.approx(values, abs=tol, nan_ok=True)
