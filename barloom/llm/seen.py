"""A bit set of ids of fixed size, by which a scan passes over rows that no join will need.

Ids outside it are surely absent; with very many ids it passes everything, and the join alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import U64, mix

BYTES = 1 << 22


def _slots(ids: pa.Array) -> np.ndarray:
    return (mix(ids.fill_null(0).to_numpy(zero_copy_only=False).view(U64)) % U64(BYTES * 8)).astype(np.int64)


def among(bits: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Whether each id may be in the set."""
    at = _slots(ids)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(BYTES * 8, bool)
    for batch in batches:
        bits[_slots(batch.column(0))] = True
    words = np.packbits(bits, bitorder="little").view(np.int64)
    full = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(words[full])], names=["at", "word"])


def seen(ids: DataFrame):
    """A broadcast variable with the set of the ids in the one column (long) of ``ids``."""
    rows = ids.mapInArrow(_of_task, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(BYTES // 8, np.int64)
    words[rows["at"].to_numpy()] = rows["word"].to_numpy()
    return ids.sparkSession.sparkContext.broadcast(words.tobytes())


def maybe(docs: DataFrame, bits, column: str = "doc_id", inside: bool = True) -> DataFrame:
    """The rows of ``docs`` whose id may be in the set, or those whose id is surely not."""
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            hit = among(own, batch.column(at).cast(pa.int64()))
            yield batch.filter(pa.array(hit if inside else ~hit))

    return docs.mapInArrow(run, docs.schema)
