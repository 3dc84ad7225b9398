"""Exact top-k inner products by columnar branch and bound.

Candidates are packed in blocks that hold one array for each dimension (vertical layout), with the norm of what
remains behind each cut of the dimensions. Every pair of a query block and a candidate block is one step of a task
that keeps each query's best k so far. A step adds up the first dimensions for all candidates, then, cut by cut,
drops the candidates whose sum so far plus the product of the remaining norms (the largest that the rest can add)
stays below the query's k-th score, and goes on with the ones left packed together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Vectors of a candidate block and of a query block; candidate blocks that a task group merges.
CANDIDATES, QUERIES, MERGED = 4096, 512, 64
#: Dimensions between two cuts.
STEP = 8
#: Candidates scored in full at the start of a query, to have a bound.
SEED = 64


def _pack(size: int):
    """Blocks of up to ``size`` vectors of one dimension: ids and the transposed matrix of 64-bit integers."""

    def block(dim: int, ids: list[int], rows: list[np.ndarray]) -> pa.RecordBatch:
        m = np.ascontiguousarray(np.stack(rows).T) if dim else np.zeros((0, len(ids)), np.int64)
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([m.astype(np.int64).tobytes()], pa.binary())], names=["dim", "ids", "matrix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, tuple[list[int], list[np.ndarray]]] = {}
        for batch in batches:
            ids = batch.column("vec_id").to_pylist()
            lists = batch.column("v")
            values, at = lists.flatten().to_numpy(zero_copy_only=False), 0
            for i, n in zip(ids, (lists.value_lengths()).to_pylist(), strict=True):
                own_ids, own_rows = open_blocks.setdefault(n, ([], []))
                own_ids.append(i), own_rows.append(values[at : at + n])
                at += n
                if len(own_ids) == size:
                    yield block(n, *open_blocks.pop(n))
        for n, (own_ids, own_rows) in open_blocks.items():
            yield block(n, own_ids, own_rows)

    return run


class Best:
    """The k best candidates of each query of a block so far."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, matrix, k  # matrix: dimensions x queries
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        self.cuts = np.arange(0, len(matrix) + STEP, STEP)
        self.rest = self._rest(matrix)

    def _rest(self, m: np.ndarray) -> np.ndarray:
        """Norms of what is left from each cut on, rounded up."""
        squares = (m.astype(np.float64) ** 2)[::-1].cumsum(axis=0)[::-1]
        return np.array([np.sqrt(squares[c]) if c < len(m) else np.zeros(m.shape[1]) for c in self.cuts]) * (1 + 1e-12)

    def _merge(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        old_ids, old_scores = self.found[i]
        ids, scores = np.concatenate([old_ids, ids]), np.concatenate([old_scores, scores])
        best = np.lexsort((ids, -scores))[: self.k]
        self.found[i] = ids[best], scores[best]

    def see(self, ids: np.ndarray, c: np.ndarray) -> None:
        """Take in a block of candidates (dimensions x candidates)."""
        rest = self._rest(c)
        for i in range(len(self.ids)):
            q = self.q[:, i]
            first = 0
            if len(self.found[i][0]) < self.k:
                first = min(len(ids), SEED + self.k)
                own = np.flatnonzero(ids[:first] != self.ids[i])
                self._merge(i, ids[own], q @ c[:, own])
            bound = self.found[i][1][-1] if len(self.found[i][0]) == self.k else None
            alive = first + np.flatnonzero(ids[first:] != self.ids[i])
            score = np.zeros(len(alive), np.int64)
            for s, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
                score = score + q[a:b] @ c[a:b][:, alive]
                if bound is not None:
                    stay = score + self.rest[s + 1][i] * rest[s + 1][alive] >= bound
                    alive, score = alive[stay], score[stay]
                if not len(alive):
                    break
            if len(alive):
                self._merge(i, ids[alive], score)

    def rows(self) -> pa.RecordBatch | None:
        n = [len(x) for x, _ in self.found]
        if not sum(n):
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n)), pa.array(np.concatenate([x for x, _ in self.found])), pa.array(np.concatenate([y for _, y in self.found]))], names=["query_id", "vec_id", "score"])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if (r["qb"], r["g"]) != now:
                    if best and (rows := best.rows()):
                        yield rows
                    ids = np.frombuffer(r["q_ids"], np.int64)
                    now, best = (r["qb"], r["g"]), Best(ids, np.frombuffer(r["q_matrix"], np.int64).reshape(r["dim"], len(ids)), k)
                ids = np.frombuffer(r["ids"], np.int64)
                best.see(ids, np.frombuffer(r["matrix"], np.int64).reshape(r["dim"], len(ids)))
        if best and (rows := best.rows()):
            yield rows

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` largest inner products of each query, ties to the smaller vec_id.

    Both tables have (vec_id long, v array of long); other columns are unread. Scores are 64-bit integers, exact
    as long as they fit. Null vectors and ids and vectors with a null component take no part; only vectors of equal
    length meet. Equal (vec_id, v) rows count once, and a query never finds its own vec_id. Fewer than k candidates
    give fewer rows, and empty tables none.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<long>").alias("v")).where("vec_id is not null and v is not null and not exists(v, x -> x is null)").dropDuplicates(["vec_id", "v"])
    packed = "dim int, ids binary, matrix binary"
    asked = scratch.keep(clean(queries), "asked")
    q = asked.repartition(asked.count() // QUERIES + 1).mapInArrow(_pack(QUERIES), packed)
    q = scratch.keep(q.withColumn("qb", F.monotonically_increasing_id()), "queries")
    q = q.select("qb", "dim", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    c = scratch.keep(clean(vectors).mapInArrow(_pack(CANDIDATES), packed).withColumn("cb", F.monotonically_increasing_id()), "candidates")
    spread = c.count() // MERGED + 1
    c = c.withColumn("g", F.pmod(F.xxhash64("cb"), F.lit(spread)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a stated set of queries against all rows, block by block: as many pairs of blocks as that takes
    pairs = c.join(q, "dim").repartition(parts, "qb", "g").sortWithinPartitions("qb", "g", "cb")
    found = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
