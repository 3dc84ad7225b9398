"""Permutation nulls inside arrays: a series is one row, and its replicas never leave the task.

What is shuffled is the series once, as an array, and one row of sums for each replica of a task. The draw of an element
is a hash of (seed, replica, series, order), so a retried task repeats it and SQL can say it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements permuted at once, and the longest series (its places share a 63-bit number with a 32-bit hash).
STEP, LONGEST = 1 << 20, 1 << 30
#: Multiplier of the 32-bit mixer, and the steps that keep replicas and series apart.
MIX, BY_REPLICA, BY_SERIES = 1540483477, 1000003, 7919

Statistic = Callable[[np.ndarray, dict[str, np.ndarray]], dict[str, np.ndarray]]


def draw(seed: int, replica: np.ndarray, series: int, order: np.ndarray) -> np.ndarray:
    """32-bit hashes; all parts are non-negative."""
    u = (order.astype(np.uint64) + np.uint64(BY_REPLICA) * replica.astype(np.uint64) + np.uint64(BY_SERIES * series + seed)) & np.uint64(0xFFFFFFFF)
    for shift in (13, 15):
        u = (u * np.uint64(MIX)) & np.uint64(0xFFFFFFFF)
        u ^= u >> np.uint64(shift)
    return u


def draw_sql(seed: int, replica: str, series: str, order: str) -> str:
    """draw() in integer SQL."""
    u = f"(({order}) + {BY_REPLICA} * ({replica}) + {BY_SERIES} * ({series}) + {seed})::BIGINT % 4294967296"
    for shift in (13, 15):
        u = f"({u} * {MIX} % 4294967296)"
        u = f"xor({u}, {u} >> {shift})"
    return u


def permutations(seed: int, replicas: np.ndarray, series: int, order: np.ndarray) -> np.ndarray:
    """For each replica which place every element takes its value from: places by (hash, place)."""
    place = np.arange(len(order), dtype=np.uint64)
    keys = (draw(seed, replicas[:, None], series, order[None, :]) << np.uint64(30)) | place
    keys.sort(axis=1)
    return (keys & np.uint64(LONGEST - 1)).astype(np.int64)


def permuted_sums(
    df: DataFrame, series: str | Column, order: str | Column, value: str, statistic: Statistic, sums: list[str], replicas: int, seed: int, fixed: tuple[str, ...] = (), blocks: int = 1
) -> DataFrame:
    """(rep, ``sums``): ``statistic`` of ``value`` permuted within each series, added up over the series.

    ``series`` and ``order`` are non-negative longs that name a series and an element of it (distinct). ``statistic``
    takes a replicas x elements array of permuted values in the order of the series, and arrays of the ``fixed``
    columns, and gives one number for each replica and each of ``sums``. Rows without ``value`` keep their place by not
    taking part. With ``blocks`` the replicas of a series are dealt over so many tasks, for few and long series.
    """
    columns = [F.col(value).cast("double").alias("v"), *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(fixed)]]
    rows = df.where(F.col(value).isNotNull()).select(_long(series).alias("series"), _long(order).alias("o"), *columns)
    rows = rows.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("o", *[c for c in rows.columns[2:]]))).alias("a"))
    rows = rows.select("series", *[F.col(f"a.{c}").alias(c) for c in ("o", "v", *[f"f{i}" for i in range(len(fixed))])])
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if blocks > 1:
        rows = rows.repartition("series", "block")
    names = ["rep", *sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(sums), replicas))
        touched = np.zeros(replicas, bool)
        for batch in batches:
            for at, (name, block) in enumerate(zip(batch.column("series").to_pylist(), batch.column("block").to_pylist(), strict=True)):
                element = lambda c: batch.column(c)[at].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                order, values = element("o"), element("v")
                if len(order) >= LONGEST:
                    raise ValueError("a series is too long to permute in one task")
                others = {c: element(f"f{i}") for i, c in enumerate(fixed)}
                own = np.arange(block, replicas, blocks)
                for some in np.array_split(own, max(1, len(own) * len(order) // STEP)):
                    found = statistic(values[permutations(seed, some, name, order)], others)
                    for i, s in enumerate(sums):
                        totals[i, some] += found[s]
                touched[own] = True
        at = np.flatnonzero(touched)
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(t[at]) for t in totals]], names=names)

    parts = rows.mapInArrow(run, ", ".join(["rep long", *[f"{s} double" for s in sums]]))
    return parts.groupBy("rep").agg(*[F.sum(s).alias(s) for s in sums])


def _long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def follow_the_mean(n: int) -> Statistic:
    """Sum and count of what is earned by holding whenever the mean of the n values before is positive."""

    def statistic(x: np.ndarray, _: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        total = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x, axis=1)], axis=1)
        at = np.arange(x.shape[1])
        before = total[:, at] - total[:, np.maximum(at - n, 0)]
        return {"s": np.where(before > 0, x, 0.0).sum(axis=1), "n": np.full(len(x), float(x.shape[1]))}

    return statistic


def moments_with(other: str) -> Statistic:
    """Sums from which the correlation of the permuted value with the ``other`` column follows."""

    def statistic(y: np.ndarray, fixed: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x = fixed[other]
        same = lambda v: np.full(len(y), v)
        return {"n": same(float(len(x))), "x": same(x.sum()), "xx": same((x * x).sum()), "y": y.sum(axis=1), "yy": (y * y).sum(axis=1), "xy": y @ x}

    return statistic


def correlation() -> Column:
    """Correlation from the sums of moments_with()."""
    c = F.col
    return (c("xy") - c("x") * c("y") / c("n")) / F.sqrt((c("xx") - c("x") * c("x") / c("n")) * (c("yy") - c("y") * c("y") / c("n")))
