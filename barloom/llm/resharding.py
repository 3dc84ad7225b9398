"""Minimum-cost-flow resharding: move the fewest bytes from old shards to new capacities, rewrite affected files.

Rows of an old shard are dealt to blocks by the hash of their text, so equal texts of a shard move together; a
block heavy against a capacity is dealt once more by doc_id. Block sizes, a table of bounded size, go to the
driver. There a flow from old shard sizes to new capacities is solved, in which bytes that stay in the shard's own
place cost nothing and others one each, and blocks are chosen for its transfers. The rows follow in one scan: each
new shard that gains or loses a block is written anew, the others stay as they are.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Bounds of what the driver sees: old shards (further ones share a number) and blocks of all of them.
OLD_SHARDS, BLOCKS = 256, 32_768
#: A block of more than this part of a capacity is split, into parts of a quarter of it.
HEAVY = 64
#: Rows that are numbered in one group.
GROUP_ROWS = 512
#: The column that names a row's shard, and so the folders of shards.
SHARD = "dealt_shard"


def min_cost_flow(supply: list[int], demand: list[int], home: list[int | None]) -> dict[tuple[int, int], int]:
    """Flows (old, new) -> bytes that ship all supply into demand (of the same sum) with the fewest bytes leaving home.

    Successive shortest paths with potentials on the bipartite graph; each path empties a supply, fills a demand or
    takes back a flow.
    """
    n, m = len(supply), len(demand)
    flow: dict[tuple[int, int], int] = {}
    left, room = [*supply], [*demand]
    high = [0] * (n + m)
    cost = lambda i, j: 0 if home[i] == j else 1
    while any(left):
        dist, came = [float("inf")] * (n + m), [-1] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                dist[i] = 0
                heap.append((0, i))
        heapq.heapify(heap)
        while heap:
            d, v = heapq.heappop(heap)
            if d > dist[v]:
                continue
            if v < n:
                edges = [(n + j, cost(v, j)) for j in range(m)]
            else:
                edges = [(i, -cost(i, v - n)) for i in range(n) if flow.get((i, v - n))]
            for w, c in edges:
                reach = d + c + high[v] - high[w]
                if reach < dist[w]:
                    dist[w], came[w] = reach, v
                    heapq.heappush(heap, (reach, w))
        ends = [j for j in range(m) if room[j] and dist[n + j] < float("inf")]
        if not ends:
            raise ValueError("demand is below supply")
        end = min(ends, key=lambda j: (dist[n + j] + high[n + j], j))
        path, v = [n + end], n + end
        while came[v] >= 0:
            v = came[v]
            path.append(v)
        path.reverse()
        amount = min(left[path[0]], room[end])
        for a, b in zip(path, path[1:], strict=False):
            if a >= n:
                amount = min(amount, flow[b, a - n])
        for a, b in zip(path, path[1:], strict=False):
            key, sign = ((a, b - n), 1) if a < n else ((b, a - n), -1)
            flow[key] = flow.get(key, 0) + sign * amount
        left[path[0]] -= amount
        room[end] -= amount
        top = max((x for x in dist if x < float("inf")), default=0)
        high = [h + min(d, top) for h, d in zip(high, dist, strict=True)]
    return {k: v for k, v in flow.items() if v}


def plan_transfers(blocks: list[tuple[int, int, int, int]], shards: int) -> tuple[dict[tuple[int, int, int], int], dict[tuple[int, int], int]]:
    """(assignment of moved blocks, flow) for blocks (old, block, part, bytes).

    Capacities are equal. Blocks are taken largest first for each transfer while they fit; then blocks go from the
    fullest to the emptiest shard as long as that brings the two nearer. Blocks of an old shard without a place
    among the new ones are all assigned.
    """
    olds = sorted({b[0] for b in blocks})
    size = {o: 0 for o in olds}
    for old, _, _, n in blocks:
        size[old] += n
    total = sum(size.values())
    demand = [total // shards + (j < total % shards) for j in range(shards)]
    home = [o if o < shards else None for o in olds]
    flow = min_cost_flow([size[o] for o in olds], demand, home)
    flow = {(olds[i], j): v for (i, j), v in flow.items()}
    where: dict[tuple[int, int, int], int] = {}
    load = [0] * shards
    for old in olds:
        rest = sorted((b for b in blocks if b[0] == old), key=lambda b: (-b[3], b))
        wanted = sorted(((v, j) for (o, j), v in flow.items() if o == old and j != (old if old < shards else None)), reverse=True)
        for amount, j in wanted:
            kept = []
            for b in rest:
                if b[3] <= amount:
                    where[b[:3]] = j
                    amount -= b[3]
                    load[j] += b[3]
                else:
                    kept.append(b)
            rest = kept
        for b in rest:
            j = old if old < shards else min(range(shards), key=lambda k: (load[k] - demand[k], k))
            where[b[:3]] = j
            load[j] += b[3]
    own: list[list[tuple[int, tuple[int, int, int]]]] = [[] for _ in range(shards)]
    for b in blocks:
        own[where[b[:3]]].append((b[3], b[:3]))
    for x in own:
        x.sort()
    for _ in range(64 * shards):
        full, low = max(range(shards), key=lambda k: (load[k], k)), min(range(shards), key=lambda k: (load[k], -k))
        gap = load[full] - load[low]
        fits = [i for i, (n, _) in enumerate(own[full]) if 0 < n < gap]
        if not fits:
            break
        i = min(fits, key=lambda i: (abs(gap - 2 * own[full][i][0]), i))
        n, b = own[full].pop(i)
        where[b] = low
        load[full] -= n
        load[low] += n
        own[low].append((n, b))
        own[low].sort()
    return {b: j for b, j in where.items() if j != b[0]}, flow


def n_bytes(text: Column) -> Column:
    """Size of a row: the bytes of its text (none if null) and one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def file_shards(docs: DataFrame) -> DataFrame:
    """``docs`` read from files, with ``__old``: the place of a row's file among the file names (by hash if they are many)."""
    files = sorted({f.rsplit("/", 1)[-1] for f in docs.inputFiles()})
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    if len(files) > OLD_SHARDS:
        return docs.withColumn("__old", F.pmod(F.xxhash64(file), F.lit(OLD_SHARDS)).cast("int"))
    return docs.withColumn("__old", (F.array_position(F.array(*[F.lit(f) for f in files] or [F.lit("")]), file) - 1).cast("int"))


class Resharding:
    """``docs`` with a column ``__old`` (int) dealt to ``shards`` of near equal bytes below ``folder``."""

    def __init__(self, docs: DataFrame, shards: int, scratch: Scratch):
        self.docs, self.shards, self.scratch = docs, shards, scratch
        text = F.col("text").cast("string")
        per_old = max(1, BLOCKS // OLD_SHARDS)
        olds = [r[0] for r in docs.select("__old").distinct().orderBy("__old").limit(OLD_SHARDS + 1).collect()]
        if len(olds) > OLD_SHARDS:
            raise ValueError(f"more than {OLD_SHARDS} old shards")
        per_old = max(per_old, BLOCKS // max(1, len(olds)))
        block = F.pmod(F.xxhash64(text), F.lit(per_old)).cast("int")
        rows = docs.withColumn("__block", block).withColumn("__size", n_bytes(text))
        sums = rows.groupBy("__old", "__block").agg(F.sum("__size").alias("n")).collect()
        limit = max(1, sum(r["n"] for r in sums) // shards // HEAVY)
        splits = {(r["__old"], r["__block"]): 4 * r["n"] // limit + 1 for r in sums if r["n"] > limit}
        # at most HEAVY heavy blocks for each new shard
        heavy = F.lit(1) if not splits else F.coalesce(F.element_at(F.create_map(*[x for (o, b), k in splits.items() for x in (F.lit(o * per_old + b), F.lit(k))]), F.col("__old") * per_old + F.col("__block")), F.lit(1))
        self.rows = rows.withColumn("__part", F.pmod(F.xxhash64("doc_id", F.lit(7)), heavy).cast("int"))
        parts = sums if not splits else self.rows.groupBy("__old", "__block", "__part").agg(F.sum("__size").alias("n")).collect()
        blocks = [(r["__old"], r["__block"], r["__part"] if splits else 0, r["n"]) for r in parts]
        self.moved, self.flow = plan_transfers(blocks, shards) if blocks else ({}, {})
        leaving, joining = {b[0] for b in self.moved}, set(self.moved.values())
        self.affected = sorted({j for j in leaving | joining if j < shards})

    def assigned(self) -> DataFrame:
        """Rows with their shard: the block's new one, or the old one. Moved blocks are bounded by the driver's table."""
        spark = self.docs.sparkSession
        to = spark.createDataFrame([(*b, j) for b, j in self.moved.items()], f"__old int, __block int, __part int, {SHARD} int")
        rows = self.rows.join(F.broadcast(to), ["__old", "__block", "__part"], "left")
        return rows.withColumn(SHARD, F.coalesce(SHARD, "__old")).drop("__old", "__block", "__part", "__size")

    def rewrite(self) -> DataFrame:
        """All rows with their shard: affected shards from files written anew, others from where they were."""
        rows = self.assigned()
        rows.where(F.col(SHARD).isin(self.affected)).write.partitionBy(SHARD).parquet(self.scratch.path("shards"), compression="zstd")
        written = self.docs.sparkSession.read.schema(rows.schema).parquet(self.scratch.path("shards"))
        still = sorted(set(range(self.shards)) - set(self.affected))
        return written if not still else written.unionByName(rows.where(F.col(SHARD).isin(still)))


def numbered(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """With ``slot``, the place of a row within its shard from 0 on, by hashed groups and then ``order``.

    A shard is numbered in groups of about GROUP_ROWS rows, on top of the counts of the groups before.
    """
    rows = scratch.keep(rows, "digests")
    groups = rows.count() // (16 * GROUP_ROWS) + 1
    rows = rows.withColumn("__g", F.pmod(F.xxhash64(*order), F.lit(groups)))
    before = Window.partitionBy("shard").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "__g").agg(F.count(F.lit(1)).alias("k")).withColumn("__before", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    own = Window.partitionBy("shard", "__g").orderBy(*order)
    return rows.join(counts, ["shard", "__g"]).withColumn("slot", F.col("__before") + F.row_number().over(own) - 1).drop("__g", "__before")


def reshard_digests(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard) of the rewritten shards of ``docs``.

    ``docs`` (doc_id, text; other columns are kept in the files) has ``__old``, or is read from files, each an old
    shard. The law is ``bytes``: sizes are near equal, to about a 256th of a shard or the largest row. A null text
    has size 1 and the checksum of no bytes. Repeated rows and null doc_ids are kept; an empty table has no shards.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    docs = docs if "__old" in docs.columns else file_shards(docs)
    rows = Resharding(docs, shards, scratch).rewrite()
    text = F.col("text").cast("string")
    digests = rows.select(F.col("doc_id").cast("long").alias("doc_id"), n_bytes(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.col(SHARD).cast("int").alias("shard"))
    out = numbered(digests, ["doc_id", "text_crc32", "size"], scratch)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
