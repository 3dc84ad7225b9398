"""Mixing sources to target weights by entropy balancing.

Every document has a rate, the copies it should have on average, between 0 and ``ceiling``. It starts from one
copy (half the ceiling, if that is less). Among the rates that give each source its target of words, the ones of
least relative entropy against the start are exponentially tilted odds, ``rate = ceiling / (1 + exp(-(a + b * x)))``
with x the document's size over its source's mean and a from the start, so long documents carry more of the change
than short ones, and one without words keeps its start. The number b of each source solves a convex dual by Newton
steps, halved back into the interval known to hold it; gradient and curvature are sums over a histogram of (source,
size), which is all that the steps read. Rates become copies by systematic rounding along the sizes of a source:
the running sum of fractions passes a whole number once for each extra copy, so the words taken miss the target
by less than one document; of some starts of the sum the one that misses least is taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one (source, size) that are numbered in one group; more are split by hash.
GROUP_ROWS = 512
STEPS, TOLERANCE = 80, 1e-9
#: Starts of a source's running sum that are tried.
STARTS = 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...], share: float, ceiling: float) -> DataFrame:
    """``totals`` (source, source_size, ...) with ``target``: ``share`` of all sizes dealt out by repeating weights.

    A target stops at ``ceiling`` times its source's size. With sources in order of ceiling over weight, the level
    is what remains behind the stopped ones over the remaining weights, at the first source that does not stop;
    that is where repeated resharing ends. One row for each source is ordered.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (k + 1).cast("int"))
    rows = totals.withColumn("weight", w).withColumn("cap", ceiling * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0.0)
    rows = rows.withColumn("level", (share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), zero)) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), zero)))
    rows = rows.withColumn("free", F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level")))
    # the level stays the same or falls past the first source that doesn't stop, so that one has the largest
    rows = rows.withColumn("found", F.max("free").over(all_rows))
    return rows.withColumn("target", F.least("cap", F.coalesce(F.col("found") * F.col("weight"), F.col("cap")))).drop("cap", "level", "free", "found", "weight")


class Mixer:
    def __init__(self, docs: DataFrame, weights: tuple[float, ...], share: float, ceiling: float):
        self.scratch, self.ceiling = Scratch(docs.sparkSession, "mixing"), ceiling
        source, text = F.col("source").cast("string"), F.col("text").cast("string")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.xxhash64(text, source).alias("body"), n_words(text).alias("size"))
        rows = rows.withColumn("named", F.col("source").isNotNull()).withColumn("key", F.coalesce("source", F.lit("")))
        self.rows = self.scratch.keep(rows, "rows")
        self.bars = self.scratch.keep(self.rows.groupBy("named", "key", "size").agg(F.count(F.lit(1)).alias("m"), F.first("source").alias("source")), "bars")
        totals = self.bars.groupBy("named", "key", "source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("docs"))
        self.sources = self.scratch.keep(targets(totals, weights, share, ceiling), "sources")

    def _rate(self) -> Column:
        even = F.col("target") / F.col("source_size")
        base = min(1.0, self.ceiling / 2)
        tilted = self.ceiling / (1 + F.exp(-(math.log(base / (self.ceiling - base)) + F.col("b") * F.col("x"))))
        return F.when(F.col("source_size") == 0, F.lit(1.0)).when(even >= self.ceiling, F.lit(float(self.ceiling))).when(even <= 0, F.lit(0.0)).otherwise(tilted)

    def rates(self) -> DataFrame:
        """The histogram with each bar's rate, after Newton steps on the dual of every source at once."""
        start = self.sources.withColumn("b", F.lit(0.0))
        for end in ("low", "high"):  # of the interval that is known to hold b
            start = start.withColumn(end, F.lit(None).cast("double"))
        bars = self.bars.drop("source")
        x = F.col("size") / (F.col("source_size") / F.col("docs"))
        for step in range(1, STEPS):
            at = bars.join(start, ["named", "key"]).where("source_size > 0").withColumn("x", x).withColumn("r", self._rate())
            h = F.col("m") * F.col("r") * (1 - F.col("r") / self.ceiling) * F.col("x") * F.col("x")
            sums = at.groupBy("named", "key").agg(F.sum(F.col("m") * F.col("r") * F.col("x")).alias("words"), (F.sum(h) + 1e-9).alias("h"))
            wanted = F.col("docs") * F.col("target") / F.col("source_size")  # words over the mean length
            inner = (F.col("target") < self.ceiling * F.col("source_size")) & (F.col("target") > 0)
            moved = start.join(sums, ["named", "key"], "left").withColumn("g", F.when(inner, wanted - F.col("words"))).withColumn("off", F.abs("g") / wanted)
            moved = moved.withColumn("low", F.when(F.col("g") > 0, F.col("b")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("g") < 0, F.col("b")).otherwise(F.col("high")))
            newton = F.col("b") + F.col("g") / F.col("h")
            held = F.when((newton >= F.col("high")) & (F.col("g") > 0) | (newton <= F.col("low")) & (F.col("g") < 0), (F.col("low") + F.col("high")) / 2).otherwise(newton)
            moved = moved.withColumn("b", F.when(F.col("off") >= TOLERANCE, held).otherwise(F.col("b")))
            start = self.scratch.keep(moved.select(*start.columns, *([] if "off" in start.columns else ["off"])), f"dual-{step}")
            worst = start.agg(F.max("off")).first()[0]
            if worst is None or worst < TOLERANCE:
                break
        else:
            raise RuntimeError(f"the dual did not settle: {worst}")
        return bars.join(start.drop("off", "low", "high"), ["named", "key"]).withColumn("x", F.when(F.col("source_size") > 0, x).otherwise(F.lit(0.0))).withColumn("rate", self._rate())

    def _started(self, bars: DataFrame) -> DataFrame:
        """With the start of each source's running sum that lets the words taken come nearest to the target.

        What a bar takes follows from the sums at its two ends, so the starts are compared on the histogram alone.
        """
        at = bars.withColumn("start", F.explode(F.array(*[F.lit(k / STARTS) for k in range(STARTS)])))
        extra = F.floor(F.col("before") + F.col("m") * F.col("part") + F.col("start")) - F.floor(F.col("before") + F.col("start"))
        off = at.groupBy("named", "key", "start").agg(F.abs(F.sum(F.col("size") * (extra - F.col("m") * F.col("part")))).alias("off"))
        return bars.join(off.groupBy("named", "key").agg(F.min_by("start", F.struct("off", "start")).alias("start")), ["named", "key"])

    def copies(self) -> DataFrame:
        """Rows (doc_id, source, body, size, source_size, target, copies), one for each document."""
        part = F.col("rate") - F.floor("rate")
        by_size = Window.partitionBy("named", "key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
        bars = self.rates().withColumn("part", part).withColumn("before", F.coalesce(F.sum(F.col("m") * F.col("part")).over(by_size), F.lit(0.0)))
        bars = bars.select("named", "key", "size", "source_size", "target", "m", F.floor("rate").alias("whole"), "part", "before", F.ceil(F.col("m") / GROUP_ROWS).alias("splits"))
        bars = self.scratch.keep(self._started(bars), "rates")
        order = F.xxhash64("doc_id", "body")
        rows = self.rows.join(bars.drop("m"), ["named", "key", "size"]).withColumn("split", F.pmod(order, F.col("splits"))).withColumn("order", order)
        counts = rows.groupBy("named", "key", "size", "split").agg(F.count(F.lit(1)).alias("here"))
        earlier = Window.partitionBy("named", "key", "size").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("skipped", F.coalesce(F.sum("here").over(earlier), F.lit(0))).drop("here")
        own = Window.partitionBy("named", "key", "size", "split").orderBy("order", "doc_id", "body")
        rows = rows.join(counts, ["named", "key", "size", "split"]).withColumn("i", F.col("skipped") + F.row_number().over(own))
        passed = lambda i: F.floor(F.col("before") + i * F.col("part") + F.col("start"))
        copies = F.col("whole") + passed(F.col("i")) - passed(F.col("i") - 1)
        return rows.select("doc_id", "source", "body", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """Rows (doc_id, source, body, size, source_size, target, copies), one for each row of ``docs`` (doc_id, text, source).

    Sources are in code point order, null last, with ``weights`` repeating; together they get ``share`` of all
    words, none more than ``ceiling`` times its own. ``body`` is a hash of text and source. A null or empty text has
    size 0 and the rate that tilting starts from (1, or half the ceiling), or that of its source where this stops.
    Repeated rows count each; which of equal rows gets a copy does not show. Null doc_ids are kept; columns other than the three are unread; an empty table gives an empty result.
    """
    return Mixer(docs, weights, share, ceiling).copies()


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """``docs`` with every row as often as mix() says. Equal (doc_id, source, text) rows share their copies."""
    names, inner = docs.columns, docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no column can clash
    text, source, doc = (F.col(f"c{names.index(c)}") for c in ("text", "source", "doc_id"))
    taken = mix(docs, weights, share, ceiling).groupBy("doc_id", "body").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    one = inner.withColumn("own_body", F.xxhash64(text.cast("string"), source.cast("string"))).withColumn("own_id", doc.cast("long"))
    joined = one.join(taken, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_body") == F.col("body"))).drop("own_body", "own_id")
    # the first of equal rows takes the copies that don't divide
    each = F.floor(F.col("copies") / F.col("rows"))
    several = joined.where("rows > 1").withColumn("i", F.row_number().over(Window.partitionBy("doc_id", "body").orderBy("doc_id")))
    rows = joined.where("rows = 1").withColumn("i", F.lit(1)).unionByName(several)
    count = (each + (F.col("i") <= F.col("copies") - F.col("rows") * each).cast("long")).cast("int")
    return rows.where(count > 0).withColumn("copy", F.explode(F.array_repeat(F.lit(1), count))).select(*inner.columns).toDF(*names)
