"""Associative scans: state that is multiplied along a key, without a loop over its rows.

A regime filter turns a belief (a row vector) into the next one by a matrix, so a stretch of rows is one matrix, and
matrices of neighbouring stretches multiply. A series is cut into blocks; each block is folded into its matrix by its
own task, the few matrices of a key give the belief before every block, and a last pass inside each block gives the
belief of every row. Longer series take blocks of blocks. No group holds more than one block of rows, or one key's
matrices of the topmost level.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let

#: A block's matrix, row by row: where the belief goes that was surely in this state, and the log of its likelihood.
ROW = "struct<v:array<double>,s:double>"


def _normal(u: Column, k: int, scale: Column) -> Column:
    """(u / sum of u, scale + log of the sum)."""
    total = lambda u: sum((F.get(u, F.lit(j)) for j in range(1, k)), F.get(u, F.lit(0)))
    row = lambda u: let(total(u), lambda t: F.struct(F.transform(u, lambda a: a / t).alias("v"), (scale + F.log(t)).alias("s")))
    return let(u, row)


def _step(v: Column, scale: Column, weights: Column, first: Column, trans: list[list[float]]) -> Column:
    """One row: a transition (not before the first row of a series), then the weights of the observation."""
    k = len(trans)
    at = [F.get(v, F.lit(i)) for i in range(k)]
    moved = [F.when(first, at[j]).otherwise(sum((at[i] * trans[i][j] for i in range(1, k)), at[0] * trans[0][j])) for j in range(k)]
    return _normal(F.array(*[m * F.get(weights, F.lit(j)) for j, m in enumerate(moved)]), k, scale)


def _through(v: Column, scale: Column, block: Column, k: int) -> Column:
    """A belief carried through a block; rows of the block that it can't reach don't count."""
    at = [F.get(v, F.lit(i)) for i in range(k)]
    rows = [F.get(block, F.lit(i)) for i in range(k)]
    seen = [F.when(a > 0, r["s"]) for a, r in zip(at, rows, strict=True)]
    top = F.greatest(*seen, F.lit(-math.inf)) if k > 1 else seen[0]
    share = [F.when(a > 0, a * F.exp(r["s"] - top)).otherwise(F.lit(0.0)) for a, r in zip(at, rows, strict=True)]
    u = F.array(*[sum((share[i] * F.get(rows[i]["v"], F.lit(j)) for i in range(1, k)), share[0] * F.get(rows[0]["v"], F.lit(j))) for j in range(k)])
    return _normal(u, k, scale + top)


def _units(k: int) -> Column:
    return F.array(*[F.struct(F.array(*[F.lit(float(i == j)) for j in range(k)]).alias("v"), F.lit(0.0).alias("s")) for i in range(k)]).cast(f"array<{ROW}>")


def _vectors(items: Column, start: Column, advance: Callable[[Column, Column], Column], before: bool) -> Column:
    """Belief before (or after) each item of an ordered array."""
    zero = F.struct(start.cast("array<double>").alias("v"), F.array().cast("array<array<double>>").alias("all"))

    def step(acc: Column, item: Column) -> Column:
        return let(advance(acc["v"], item), lambda v: F.struct(v.alias("v"), F.concat(acc["all"], F.array(acc["v"] if before else v)).alias("all")))

    return F.aggregate(items, zero, step, lambda acc: acc["all"])


def _before_blocks(blocks: DataFrame, keys: list[str], start: Column, k: int, size: int, levels: int) -> DataFrame:
    """(keys, b, v): belief before each block of ``blocks`` (keys, b, m)."""
    carry = lambda v, item: _through(v, F.lit(0.0), item["m"], k)["v"]
    wider = blocks.withColumn("__w", F.floor(F.col("b") / size).cast("long") if levels > 1 else F.lit(0).cast("long"))
    held = wider.groupBy(*keys, "__w").agg(F.array_sort(F.collect_list(F.struct("b", "m"))).alias("items"))
    if levels > 1:
        fold = lambda acc, item: F.transform(acc, lambda row: _through(row["v"], row["s"], item["m"], k))
        whole = held.select(*keys, F.col("__w").alias("b"), F.aggregate("items", _units(k), fold).alias("m"))
        above = _before_blocks(whole, keys, start, k, size, levels - 1)
        held = held.join(above.withColumnRenamed("b", "__w"), [*keys, "__w"]).withColumnRenamed("v", "start")
    else:
        held = held.withColumn("start", start)
    vectors = F.arrays_zip(F.transform("items", lambda i: i["b"]).alias("b"), _vectors(F.col("items"), F.col("start"), carry, True).alias("v"))
    return held.select(*keys, F.explode(vectors).alias("z")).select(*keys, "z.b", "z.v")


def beliefs(df: DataFrame, keys: list[str], pos: str, weights: Column, trans: list[list[float]], start: list[float], out: str, size: int = 256, levels: int = 1) -> DataFrame:
    """Adds ``out``, the normalised belief after each row of a series.

    belief_0 = start * weights_0 and belief_t = (belief_{t-1} x trans) * weights_t, elementwise in the weights (an array
    of non-negative numbers) and scaled to sum 1. ``pos`` counts from 0 without gaps; rows are equal at most if all
    their columns are orderable. With ``levels`` 1 a key's group holds pos / size matrices, with 2 pos / size**2.
    """
    k = len(trans)
    rest = [c for c in df.columns if c not in keys]
    rows = df.withColumns({"__p": F.col(pos).cast("long"), "__f": weights})
    rows = rows.groupBy(*keys, F.floor(F.col("__p") / size).cast("long").alias("b")).agg(F.array_sort(F.collect_list(F.struct("__p", "__f", *rest))).alias("rows"))
    begin = F.array(*[F.lit(float(p)) for p in start])
    fold = lambda acc, r: F.transform(acc, lambda row: _step(row["v"], row["s"], r["__f"], r["__p"] == 0, trans))
    blocks = rows.select(*keys, "b", F.aggregate("rows", _units(k), fold).alias("m"))
    before = _before_blocks(blocks, keys, begin, k, size, levels)
    walk = lambda v, r: _step(v, F.lit(0.0), r["__f"], r["__p"] == 0, trans)["v"]
    done = rows.join(before, [*keys, "b"]).select(*keys, F.explode(F.arrays_zip("rows", _vectors(F.col("rows"), F.col("v"), walk, False).alias(out))).alias("z"))
    return done.select(*[F.col(c) if c in keys else F.col(f"z.rows.{c}").alias(c) for c in df.columns], F.col(f"z.{out}").alias(out))
