"""Quantiles of moving and growing windows, from one ordered structure that is carried along the rows.

A series is cut into chunks of ticks, and each chunk takes the ticks before it that its windows reach into. Inside a
chunk the window is an indexed skip list (Arrow in, Arrow out): a row enters, the rows that leave are taken out, and a
quantile is a look-up, so no window is collected or sorted for a row. Chunks are the groups, so one long series is
spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clock import Clock

CHUNK = 8192


@dataclass(frozen=True)
class Quantiles:
    """Column ``out``: quantiles of ``x`` over the last ``n`` ticks (None: all) that end ``lag`` ticks ago.

    An array with one entry for each of ``probs``, between neighbours by linear interpolation; NULL where fewer than
    ``least`` values (default ``n``) are there. NULL values don't count.
    """

    out: str
    x: str
    n: int | None
    probs: tuple[float, ...]
    lag: int = 0
    least: int | None = None

    @property
    def fewest(self) -> int:
        return self.least or self.n or 1

    def over(self, pos: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """One array for each of ``probs`` at ascending ticks ``pos``."""
        if self.lag:  # values are seen ``lag`` ticks later; at an equal tick they come before the row that asks
            at, asks = np.concatenate([pos + self.lag, pos]), np.repeat([0, 1], len(pos))
            order = np.lexsort((asks, at))
            values, at = np.concatenate([x, np.full(len(pos), np.nan)])[order], at[order]
            rows = np.flatnonzero(order >= len(pos))
        else:
            values, at, rows = x, pos, slice(None)
        series = pd.Series(values, index=pd.DatetimeIndex(at.astype(np.int64)))
        window = series.expanding(min_periods=self.fewest) if self.n is None else series.rolling(f"{self.n}ns", min_periods=self.fewest)
        return [window.quantile(p).to_numpy()[rows] for p in self.probs]


def _doubles(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.float64()).to_pandas().to_numpy(float)


def _with(table: pa.Table, pos: str, specs: list[Quantiles]) -> pa.Table:
    """``table``, in the order of ``pos``, with a column for each of ``specs``."""
    table = table.sort_by(pos)
    ticks = table[pos].to_numpy()
    for s in specs:
        found = np.stack(s.over(ticks, _doubles(table[s.x])), axis=1)
        known = ~np.isnan(found).any(axis=1)
        offsets = pa.array(np.concatenate([[0], np.cumsum(known) * len(s.probs)]), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(found[known].ravel()), mask=pa.array(~known))
        table = table.append_column(s.out, lists)
    return table


def _schema(df: DataFrame, specs: list[Quantiles]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(s.out, T.ArrayType(T.DoubleType())) for s in specs]])


def rolling_quantiles(df: DataFrame, c: Clock, specs: list[Quantiles], chunk: int = CHUNK) -> DataFrame:
    """``df`` with the columns of ``specs`` (each with an ``n``); frames are ticks of the clock, gaps included."""
    reach = max(s.n + s.lag - 1 for s in specs)
    chunk = max(chunk, reach)
    own = F.floor(F.col(c.pos) / chunk).cast("long")
    also = F.when(F.pmod(F.col(c.pos), F.lit(chunk)) >= chunk - reach, F.array(own, own + 1)).otherwise(F.array(own))
    names, pos = df.columns, c.pos
    sent = df.withColumn("__chunk", F.explode(also))
    held = T.StructType([*sent.schema.fields, *_schema(df, specs).fields[len(names):]])

    def run(table: pa.Table) -> pa.Table:
        done = _with(table, pos, specs)
        return done.filter(pa.array(done[pos].to_numpy() // chunk == done["__chunk"].to_numpy()))

    return sent.groupBy(*c.keys, "__chunk").applyInArrow(run, held).drop("__chunk")


def expanding_quantiles(df: DataFrame, c: Clock, specs: list[Quantiles]) -> DataFrame:
    """As rolling_quantiles() over all ticks so far. A group is one series, so it is for panels with a row a calendar tick."""
    pos = c.pos
    return df.groupBy(*c.keys).applyInArrow(lambda table: _with(table, pos, specs), _schema(df, specs))
