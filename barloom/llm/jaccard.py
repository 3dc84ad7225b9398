"""N-gram Jaccard join: size-banded tiles, hashed bitmaps whose bit counts bound the overlap, exact intersection.

Documents with equal shingle sets are one node. Two nodes with Jaccard similarity t or more share one of the
first n - ceil(t * n) + 1 shingles of each in any common order, so the rows dealt out are (shingle, node) for
those. The order puts shingles last that very many documents hold; which ones those are affects only the work.
A tile is what shares a shingle; a large one is cut into blocks by size band and hash, and only pairs of blocks
in equal or neighbouring bands meet, each in a task group of bounded size. Inside, sizes, then bit counts
(a bit that only one side has proves an element that only this side has) bound the overlap from above, and the
pairs left are verified on the sorted sets. Pairs already connected are skipped, so that a large group of near
copies costs a few pairs for each member and not all of them: first every node meets its next neighbours by size
in each of its tiles and is verified against the one that the bit counts favour most, and only then do tiles give
every pair of different components that the bounds allow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .textarrays import U64, mix, shingle_set, slices, word_hashes

#: Rows of a tile block; a task holds two blocks of a tile at a time.
BLOCK = 1024
#: Shingles that an order can put last (8 bytes each are broadcast), and the documents that make one of them.
HOT_KEPT, HOT_FROM = 1 << 18, 64
#: Tiles with the same first node mostly hold the same group; they are dealt to so many tasks, where a pair counts once.
SPREAD = 2
#: Neighbours in a tile, in order of size, that a row meets in the first pass.
CHAIN = 8
#: Bytes of rows that a task gathers before it works on the tiles that are whole.
HELD_BYTES = 16 << 20
#: Bytes of text hashed at once.
SLICE = 1 << 20
#: Pairs that a task remembers as already emitted.
REMEMBERED = 1 << 19
#: Bytes of the bit set by which a scan skips documents that no pair names.
SEEN_BYTES = 1 << 22


def _log2(n: int) -> int:
    return max(10, int(2 * n - 1).bit_length())


def bitmap(s: np.ndarray) -> bytes:
    """Bit h >> (64 - k) for each element, 2**k bits, at least twice as many as elements and 1024."""
    k = _log2(len(s))
    bits = np.zeros(1 << k, bool)
    bits[(s >> U64(64 - k)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed integers."""
    low = int(mix(s).sum(dtype=U64))
    high = int(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64))
    return low - (1 << 64) * (low >> 63), high - (1 << 64) * (high >> 63)


def _needed(n: int, percent: int) -> int:
    """Smallest overlap with which a set of n elements can link."""
    return -(-percent * n // 100)


_SETS = "doc_id long, n int, lo long, hi long, bits binary, shingle long, held long"


def _summaries(width: int):
    """Per document its size, identity and bitmap; per batch the shingles that several texts hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for s in slices(batch.column(1)):
                h, o = word_hashes(s, lower=True)
                n, lo, hi, bits, low = [], [], [], [], []
                for i in range(len(s.texts)):
                    e = shingle_set(h[o[i] : o[i + 1]], width)
                    a, b = identity(e)
                    n.append(len(e)), lo.append(a), hi.append(b)
                    bits.append(bitmap(e) if len(e) else None)
                    low.append(e[: max(1, len(e) // 2)])
                k, c = np.unique(np.concatenate(low), return_counts=True)
                k, c = k[c >= 4].view(np.int64), c[c >= 4]
                docs, hot = len(n), len(k)
                none = lambda m, t: pa.nulls(m, t)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([ids.slice(s.first, docs).cast(pa.int64()), none(hot, pa.int64())]),
                        pa.concat_arrays([pa.array(n, pa.int32()), none(hot, pa.int32())]),
                        pa.concat_arrays([pa.array(lo, pa.int64()), none(hot, pa.int64())]),
                        pa.concat_arrays([pa.array(hi, pa.int64()), none(hot, pa.int64())]),
                        pa.concat_arrays([pa.array(bits, pa.binary()), none(hot, pa.binary())]),
                        pa.concat_arrays([none(docs, pa.int64()), pa.array(k)]),
                        pa.concat_arrays([none(docs, pa.int64()), pa.array(c, pa.int64())]),
                    ],
                    names=["doc_id", "n", "lo", "hi", "bits", "shingle", "held"],
                )

    return run


def _prefixes(width: int, percent: int, hot):
    """(shingle, pos, lo) for the shingles of each distinct set of a batch that a link must share one of.

    pos is the place in the order. Two linked sets have a first shared shingle, and behind its places there is room
    for the whole overlap that they need; tiles skip pairs for which there is none.

    lo is half of the identity: two sets that share it only give more pairs to verify.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = hot.value
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            for s in slices(batch.column(0), SLICE):
                h, o = word_hashes(s, lower=True)
                keys, nodes, counts = [], [], []
                for i in range(len(s.texts)):
                    e = shingle_set(h[o[i] : o[i + 1]], width)
                    if not len(e) or (node := identity(e)) in seen:
                        continue
                    seen.add(node)
                    p = len(e) - _needed(len(e), percent) + 1
                    if len(last):
                        at = np.minimum(np.searchsorted(last, e), len(last) - 1)
                        common = last[at] == e
                        e = np.concatenate([e[~common], e[common]])
                    keys.append(e[:p]), nodes.append(node), counts.append(p)
                if keys:
                    owner = np.repeat(np.array([x[0] for x in nodes], np.int64), counts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate([np.arange(c, dtype=np.int32) for c in counts])), pa.array(owner)], names=["shingle", "pos", "lo"])

    return run


def _halved(words: np.ndarray) -> np.ndarray:
    """Bitmaps folded to half their bits: neighbouring bits share all but the last bit of their position."""
    x = words.byteswap()  # the first bit of a bitmap is the highest of its first byte
    x = (x | x >> U64(1)) & U64(0x5555555555555555)
    for k, keep in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | x >> U64(k)) & U64(keep)
    return x.astype(np.uint32).byteswap()


class Bitmaps:
    """Bitmaps of some rows as 64-bit words, read where Arrow has them."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        self.whole = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(U64)
        self.at = (at - at[0]) // 8
        self.words = np.diff(self.at)

    def only(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of rows: the bits only a has, and only b has; sizes within a factor two are compared.

        A fourth of the bits is counted first, and the rest only where a link of ``percent`` is still possible.
        """
        x, y = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        wa, wb = self.words[a], self.words[b]
        for ka, kb in {*zip(wa.tolist(), wb.tolist(), strict=True)}:
            k = min(ka, kb)
            if max(ka, kb) > 2 * k:
                continue
            rows = np.flatnonzero((wa == ka) & (wb == kb))
            step = max(1, (1 << 21) // (8 * k))
            for part in (rows[i : i + step] for i in range(0, len(rows), step)):
                for lo, hi in ((0, k // 4), (k // 4, k)):
                    p, q = self._rows(a[part], ka == k, lo, hi), self._rows(b[part], kb == k, lo, hi)
                    x[part] += np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64)
                    y[part] += np.bitwise_count(q & ~p).sum(axis=1, dtype=np.int64)
                    most = most_shared(n_a[part], n_b[part], x[part], y[part])
                    part = part[100 * most >= percent * (n_a[part] + n_b[part] - most)]
        return x, y

    def _rows(self, rows: np.ndarray, whole: bool, lo: int, hi: int) -> np.ndarray:
        """Words lo to hi of some rows, or of their folded forms."""
        at = self.at[:-1][rows][:, None]
        if whole:
            return self.whole[at + np.arange(lo, hi)].view(np.uint32)
        return _halved(self.whole[at + np.arange(2 * lo, 2 * hi)])


def most_shared(n_a: np.ndarray, n_b: np.ndarray, only_a: np.ndarray, only_b: np.ndarray) -> np.ndarray:
    """The largest overlap that bit counts allow: a bit of one side alone is an element of one side alone."""
    return np.minimum(n_a - only_a, n_b - only_b)


_PAIR = "a long, b long"


def _tiles(percent: int, best: bool):
    """Pairs of nodes within each tile block that sizes, positions, labels and bit counts allow.

    Rows come sorted by (tile, size). Row i meets i + 1, i + 2, ... for all rows at once, as long as the tile is
    the same and the larger size is in reach, so the work is the number of such pairs and none is emitted before
    its bit counts are seen. ``best``: rows meet the next CHAIN ones alone, and each gives the partner that the bound
    on the overlap favours most; the work is linear in the rows.
    """

    def of(t: pa.Table, seen: set[tuple[int, int]]) -> pa.RecordBatch:
        tile = np.stack([t.column(c).to_numpy() for c in ("shingle", "block")])
        node, label, n, side, pos = (t.column(c).to_numpy().astype(np.int64) for c in ("node", "label", "n", "side", "pos"))
        edge = np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(axis=0)) + 1
        last = np.repeat(np.append(edge, len(node)), np.diff(np.concatenate([[0], edge, [len(node)]])))
        maps = Bitmaps(t.column("bits").combine_chunks())
        a_out, b_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        partner, favour = np.full(len(node), -1), np.zeros(len(node))
        left, d = np.arange(len(node)), 1
        while len(left) and not (best and d > CHAIN):
            left = left[left + d < last[left]]
            left = left[100 * n[left] >= percent * n[left + d]]
            other = left + d
            need = -(-percent * (n[left] + n[other]) // (100 + percent))
            new = (label[left] != label[other]) & (node[left] != node[other]) & ((side[left] == 0) | (side[left] != side[other]))
            new &= (n[left] - pos[left] >= need) & (n[other] - pos[other] >= need)
            a, b = left[new], other[new]
            if len(a):
                most = most_shared(n[a], n[b], *maps.only(a, b, n[a], n[b], percent))
                fits = 100 * most >= percent * (n[a] + n[b] - most)
                a, b, likely = a[fits], b[fits], (most / (n[a] + n[b] - most))[fits]
                if best:  # within one step a row is at most once on either side
                    for x, y in ((a, b), (b, a)):
                        up = likely > favour[x]
                        favour[x[up]], partner[x[up]] = likely[up], y[up]
                else:
                    a_out.append(node[a]), b_out.append(node[b])
            d += 1
        if best:
            a = np.flatnonzero(partner >= 0)
            a_out, b_out = [node[a]], [node[partner[a]]]
        a, b = np.concatenate(a_out), np.concatenate(b_out)
        pairs = {*zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)} - seen
        if len(seen) > REMEMBERED:
            seen.clear()
        seen |= pairs
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows < 8 * BLOCK and size < HELD_BYTES:
                continue
            t = pa.Table.from_batches(held)
            s, k = t.column("shingle").to_numpy(), t.column("block").to_numpy()
            whole = np.flatnonzero((s[1:] != s[:-1]) | (k[1:] != k[:-1]))
            if len(whole):
                cut = int(whole[-1]) + 1
                yield of(t.slice(0, cut), seen)
                held, rows = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
                size = sum(x.nbytes for x in held)
        if held:
            yield of(pa.Table.from_batches(held), seen)

    return run


def _exact_sets(width: int, seen):
    """Sorted sets, once a batch, of the documents whose identity the bit set ``seen`` may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(seen.value, np.uint8)
        for batch in batches:
            chosen = batch.filter(pa.array(_among(bits, batch.column(0))))
            for s in slices(chosen.column(1), SLICE):
                h, o = word_hashes(s, lower=True)
                sets = [shingle_set(h[o[i] : o[i + 1]], width) for i in range(len(s.texts))]
                keys = [identity(e) for e in sets]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([e.tobytes() for e in sets], pa.binary())], names=["lo", "hi", "elements"])

    return run


def _slots(ids: pa.Array) -> np.ndarray:
    return (mix(ids.fill_null(0).to_numpy(zero_copy_only=False).view(U64)) % U64(SEEN_BYTES * 8)).astype(np.int64)


def _among(bits: np.ndarray, ids: pa.Array) -> np.ndarray:
    at = _slots(ids)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _bit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bit set for all ids of a task."""
    bits = np.zeros(SEEN_BYTES * 8, bool)
    for batch in batches:
        bits[_slots(batch.column(0))] = True
    at = np.packbits(bits, bitorder="little").view(np.int64)
    full = np.flatnonzero(at)
    yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(at[full])], names=["at", "word"])


def _intersect(percent: int):
    """Pairs whose sorted sets overlap enough, with the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


class JaccardJoin:
    """Components of documents linked by ``percent`` per cent or more of shared shingles of ``width`` words."""

    def __init__(self, docs: DataFrame, width: int = 5, percent: int = 80):
        self.spark, self.width, self.percent = docs.sparkSession, width, percent
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.scratch = Scratch(self.spark, "jaccard")

    def _hot(self, summaries: DataFrame) -> np.ndarray:
        rows = summaries.where("shingle is not null").groupBy("shingle").agg(F.sum("held").alias("held")).where(F.col("held") >= HOT_FROM)
        top = rows.orderBy(F.desc("held"), "shingle").limit(HOT_KEPT).select("shingle").toArrow()["shingle"]
        return np.sort(top.to_numpy().view(U64))

    def _verified(self, pairs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b of nodes) that link, by exact intersection; only documents named by a pair are scanned for sets."""
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        named = nodes.select("node", "lo", "hi", "rep").join(ends, "node")
        words = named.select("rep").mapInArrow(_bit_rows, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
        bits = np.zeros(SEEN_BYTES // 8, np.int64)
        bits[words["at"].to_numpy()] = words["word"].to_numpy()
        seen = self.spark.sparkContext.broadcast(bits.tobytes())
        sets = self.docs.mapInArrow(_exact_sets(self.width, seen), "lo long, hi long, elements binary").dropDuplicates(["lo", "hi"])
        sets = self.scratch.keep(named.join(sets, ["lo", "hi"]).select("node", "elements"), f"sets-{name}")
        with_x = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a")
        with_y = with_x.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
        return with_y.mapInArrow(_intersect(self.percent), _PAIR)

    def _blocks(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows (shingle, node, ...) dealt to tile blocks.

        A tile of up to BLOCK rows is one block. A larger one is cut by size band and then by node; each row then
        goes to every pair of blocks that its own block forms with one of the same or a neighbouring band.
        """
        base = math.log(100 / self.percent) * 1.001
        band: Column = F.floor(F.log(F.col("n").cast("double")) / F.lit(base)).cast("int")
        counts = rows.groupBy("shingle", band.alias("band")).agg(F.count(F.lit(1)).alias("k"))
        counts = self.scratch.keep(counts.join(counts.groupBy("shingle").agg(F.sum("k").alias("total")), "shingle").where(F.col("total") > BLOCK), f"large-{name}")
        w = Window.partitionBy("shingle").orderBy("band")
        cuts = F.ceil(F.col("k") / BLOCK).cast("int")
        near = lambda f, step: F.when(f("band").over(w) == F.col("band") + step, f("cuts").over(w))
        plan = counts.withColumn("cuts", cuts).withColumn("above", near(F.lead, 1)).withColumn("below", near(F.lag, -1)).select("shingle", "band", "cuts", "above", "below")
        rows = rows.withColumn("band", band).join(plan, ["shingle", "band"], "left")
        own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
        same = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.struct(F.xxhash64(F.lit(0), F.col("band"), F.least(own, j), F.greatest(own, j)).alias("block"), F.when(own == j, 0).when(own < j, 1).otherwise(2).alias("side")))
        up = F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda j: F.struct(F.xxhash64(F.lit(1), F.col("band"), own, j).alias("block"), F.lit(1).alias("side")))
        down = F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda j: F.struct(F.xxhash64(F.lit(1), F.col("band") - 1, j, own).alias("block"), F.lit(2).alias("side")))
        empty = F.array().cast("array<struct<block:bigint,side:int>>")
        all_blocks = F.when(F.col("cuts").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("block"), F.lit(0).alias("side")))).otherwise(F.concat(same, F.coalesce(up, empty), F.coalesce(down, empty)))
        return rows.withColumn("at", F.explode(all_blocks)).select("shingle", F.col("at.block").alias("block"), F.col("at.side").alias("side"), "deal", "pos", "node", "label", "n")

    def _tile_pairs(self, rows: DataFrame, nodes: DataFrame, label: DataFrame, best: bool) -> DataFrame:
        """Pairs (a < b) that tiles give between nodes of different labels (a node without one is its own)."""
        rows = rows.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        several = rows.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("node").alias("first")).where("x != y")
        several = several.select("shingle", F.xxhash64("first", F.pmod("shingle", F.lit(SPREAD))).alias("deal"))
        rows = self._blocks(rows.join(several, "shingle"), "best" if best else "all").join(nodes.select("node", "bits"), "node")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        tiles = rows.repartition(parts, "deal", "block").sortWithinPartitions("deal", "block", "shingle", "n", "node")
        return tiles.mapInArrow(_tiles(self.percent, best), _PAIR).distinct()

    def run(self) -> tuple[DataFrame, DataFrame]:
        """(documents, roots): rows (doc_id, n, lo, hi) of all documents, and (lo, hi, component_id) of linked nodes."""
        keep = self.scratch.keep
        summaries = keep(self.docs.mapInArrow(_summaries(self.width), _SETS), "summaries")
        documents = summaries.where("n is not null").select("doc_id", "n", "lo", "hi")
        nodes = summaries.where("n > 0").groupBy("lo", "hi").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"))
        nodes = keep(nodes.where("rep is not null").withColumn("node", F.monotonically_increasing_id()), "nodes")
        hot = self.spark.sparkContext.broadcast(self._hot(summaries))
        rows = keep(self.docs.select("text").mapInArrow(_prefixes(self.width, self.percent, hot), "shingle long, pos int, lo long"), "prefixes")
        shared = rows.groupBy("shingle").agg(F.min("lo").alias("x"), F.max("lo").alias("y")).where("x != y").select("shingle")
        rows = rows.join(shared, "shingle", "left_semi").distinct()
        rows = keep(rows.join(nodes.select("lo", "node", "n"), "lo").select("shingle", "pos", "node", "n"), "rows")
        self.scratch.drop("prefixes")
        alone = nodes.select("node", F.col("node").alias("label")).limit(0)
        first = keep(self._tile_pairs(rows, nodes, alone, best=True), "best")
        edges = keep(self._verified(first, nodes, "best"), "edges")
        label = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), self.scratch, "some").withColumnRenamed("root", "label")
        pairs = keep(self._tile_pairs(rows, nodes, label, best=False).join(first, ["a", "b"], "left_anti"), "pairs")
        edges = edges.unionByName(self._verified(pairs, nodes, "pairs"))
        root = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), self.scratch)
        low = root.join(nodes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("component_id"))
        member = nodes.select("node", "lo", "hi", "rep").join(root, "node", "left").join(low, "root", "left")
        return documents, member.select("lo", "hi", F.coalesce("component_id", "rep").alias("component_id"))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of ``docs`` (doc_id, text; other columns unread).

    Words are lower-cased for A-Z and cut at 0x20 and 0x09-0x0D. A null or empty text, or one without words, has
    no shingles and its own doc_id as component. Fewer words than ``width`` are one shingle. component_id is the
    smallest doc_id reachable by links; repeated rows and ids are kept, and a null doc_id only takes part as a
    text: its component is that of equal texts with an id, or null. An empty table gives an empty result.
    """
    documents, member = JaccardJoin(docs, width, percent).run()
    out = documents.join(member, ["lo", "hi"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
