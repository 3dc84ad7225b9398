"""Named, ready-made plans over the base tables, each with an equivalent SQL text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan under ``name``."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def load() -> None:
    from . import (  # noqa: F401
        panel,
        features,
        cross_section,
        recursions,
        books,
        event_plans,
        statistics,
        forecasting,
        shape_plans,
        stream_plans,
    )
