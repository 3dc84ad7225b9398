"""Collocations: phrases of two to four words that a language uses often, found by Rabin-Karp fingerprints.

The words of a slice of texts are hashed from their bytes, and prefix sums of ``hash * B**i`` modulo 2**64 give the
fingerprint of every phrase by one subtraction and one product (B is odd, so its powers have inverses). A second
fingerprint with another base checks the first. What is shuffled is one row for each fingerprint of a slice: its count,
the least and greatest check and the least key of a text that holds it, the pointer to an occurrence. A phrase can be
frequent only if the phrases in it are, so words are counted first, then pairs of frequent words, then the phrases of
three and four words whose pairs are frequent; bit sets of fixed size tell them apart on the way, and let a few
infrequent ones through, never the other way round.

Fingerprints with several checks are collisions: their phrases are counted again by their text. All others are read
at their pointer: the texts pointed to (few, as the least keys are the same for many phrases) are hashed again, and
only frequent phrases become strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .seen import among, seen
from .textarrays import CHECKS, LOWER, U64, WORDS, Slice, hash_pairs, mix, slices, stream

LONGEST = 4
#: Bytes of text hashed at once, texts looked at together, and phrases of a task that are counted before they are shuffled.
SLICE_BYTES, TEXTS, HELD = 1 << 20, 1000, 3 << 19
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
BETWEEN = BREAK.copy()
BETWEEN[[0x20, 0x09]] = True


class Rolling:
    """Fingerprints of all runs of k items of a sequence of hashes, from one prefix polynomial."""

    def __init__(self, seed: int):
        self.base = int(stream(seed, 1)[0]) | 1
        self.up = self.down = np.ones(1, U64)

    def _powers(self, n: int) -> None:
        while len(self.up) < n:
            by = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(self.base, by, 2**64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(self.base, -by, 2**64))])

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        self._powers(len(hashes) + 1)
        return np.concatenate([np.zeros(1, U64), np.cumsum(hashes * self.up[: len(hashes)], dtype=U64)])

    def of(self, prefix: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """Fingerprint of the k items from each place ``at``."""
        return mix((prefix[at + k] - prefix[at]) * self.down[at] + U64(k))


ONE, TWO = Rolling(501), Rolling(502)


class Grams:
    """Words of a slice of texts and the fingerprints of its phrases."""

    def __init__(self, s: Slice, bits: int):
        self.s, self.mask = s, U64(2**bits - 1)
        word = ~BETWEEN[s.buf]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.piece = np.cumsum(BREAK[s.buf], dtype=np.int32)[self.starts]
        self.text = np.searchsorted(s.end, self.starts)
        if len(self.starts):
            one, two = hash_pairs(WORDS, CHECKS, s.buf, self.starts, self.ends, LOWER)
            self.one, self.two = ONE.prefix(one), TWO.prefix(two)

    def places(self, k: int) -> np.ndarray:
        """Where k words of one piece begin."""
        n = len(self.starts) - k + 1
        return np.flatnonzero(self.piece[k - 1 :] == self.piece[:n]) if n > 0 else np.zeros(0, np.int64)

    def prints(self, at: np.ndarray, k: int) -> np.ndarray:
        return ONE.of(self.one, at, k) & self.mask

    def checks(self, at: np.ndarray, k: int) -> np.ndarray:
        return TWO.of(self.two, at, k)

    def inside(self, at: np.ndarray, k: int, part: int, bits: np.ndarray) -> np.ndarray:
        """The places whose k words hold only runs of ``part`` words that may be frequent."""
        if not len(at):
            return at
        whole = np.zeros(len(self.starts), bool)
        all_ = self.places(part)
        whole[all_] = among(bits, pa.array(self.prints(all_, part).view(np.int64)))
        for j in range(k - part + 1):
            at = at[whole[at + j]]
        return at

    def phrase(self, at: int, k: int) -> bytes:
        return b" ".join(self.s.buf[a:b].tobytes() for a, b in zip(self.starts[at : at + k], self.ends[at : at + k], strict=True)).lower()


def _by_language(batch: pa.RecordBatch, bits: int) -> Iterator[tuple[str, Grams, np.ndarray]]:
    """(lang, grams of a slice, keys of its texts) of a batch (lang, text, key)."""
    for at in range(0, batch.num_rows, TEXTS):
        some = batch.slice(at, TEXTS)
        column = some.column(0).dictionary_encode()
        codes = column.indices.to_numpy(zero_copy_only=False)
        for code, lang in enumerate(column.dictionary.to_pylist()):
            own = some.filter(pa.array(codes == code))
            keys = own.column(2).to_numpy(zero_copy_only=False)
            for s in slices(own.column(1), SLICE_BYTES):
                g = Grams(s, bits)
                if len(g.starts):
                    yield lang, g, keys[s.first : s.first + len(s.texts)]


COUNTS = "lang string, print long, n long, low long, high long, key long"


def _grouped(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
    """One row (see COUNTS) for each fingerprint of each language, of lists of (prints, checks, keys)."""
    names = [f.split()[0] for f in COUNTS.split(", ")]
    for lang, parts in held.items():
        prints, checks, keys = (np.concatenate(c) for c in zip(*parts, strict=True))
        if not len(prints):
            continue
        order = np.argsort(prints)
        prints, checks, keys = prints[order], checks[order], keys[order]
        first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
        n = np.diff(np.concatenate([first, [len(prints)]]))
        columns = [prints[first], n, np.minimum.reduceat(checks, first), np.maximum.reduceat(checks, first), np.minimum.reduceat(keys, first)]
        yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(first), np.int64))), *map(pa.array, columns)], names=names)


def _counted(texts: DataFrame, lengths: tuple[int, ...], part: int, frequent, bits: int) -> DataFrame:
    """Counts (see COUNTS) of the phrases of these lengths whose runs of ``part`` words are all in ``frequent``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(frequent.value, np.uint8) if frequent else None
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            for lang, g, keys in _by_language(batch, bits):
                for k in lengths:
                    at = g.places(k) if known is None else g.inside(g.places(k), k, part, known)
                    held.setdefault(lang, []).append((g.prints(at, k).view(np.int64), g.checks(at, k).view(np.int64), keys[g.text[at]]))
                    size += len(at)
                if size >= HELD:
                    yield from _grouped(held)
                    held, size = {}, 0
        yield from _grouped(held)

    rows = texts.mapInArrow(run, COUNTS)
    return rows.groupBy("lang", "print").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("key").alias("key"))


def _recounted(texts: DataFrame, mixed: DataFrame, least: int, bits: int) -> DataFrame:
    """(lang, phrase, n) of the phrases whose fingerprints are in ``mixed`` (lang, print), counted by their text."""
    some = seen(mixed.select("print"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(some.value, np.uint8)
        for batch in batches:
            for lang, g, _ in _by_language(batch, bits):
                for k in range(1, LONGEST + 1):
                    at = g.places(k)
                    prints = g.prints(at, k).view(np.int64)
                    hit = among(known, pa.array(prints))
                    rows = [(p, g.phrase(a, k)) for p, a in zip(prints[hit].tolist(), at[hit].tolist(), strict=True)]
                    if rows:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(rows)), pa.array([p for p, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.binary()).cast(pa.string())],
                            names=["lang", "print", "phrase"],
                        )

    rows = texts.mapInArrow(run, "lang string, print long, phrase string").groupBy("lang", "print", "phrase").agg(F.count(F.lit(1)).alias("n"))
    return rows.where(F.col("n") >= least).join(mixed, ["lang", "print"], "left_semi").select("lang", "phrase", "n")


def _read(texts: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """(lang, phrase, n) of ``wanted`` (lang, print, n, low, key), each read in a text with its key."""
    some = seen(wanted.select("key"))

    def pointed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(some.value, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(among(known, batch.column(2))))

    held = wanted.groupBy("lang", "key").agg(F.collect_list(F.struct("print", "low", "n")).alias("held"))
    own = texts.mapInArrow(pointed, texts.schema).distinct().join(held, ["lang", "key"]).select("lang", "text", "key", "held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                lists = one.column(3).flatten()
                prints, low, n = (lists.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                for lang, g, _ in _by_language(one.select([0, 1, 2]), bits):
                    phrases, counts = [], []
                    for k in range(1, LONGEST + 1):
                        at = g.places(k)
                        found, first = np.unique(g.prints(at, k).view(np.int64), return_index=True)
                        here = np.searchsorted(found, prints)
                        ok = (here < len(found)) & (found[np.minimum(here, len(found) - 1)] == prints) if len(found) else np.zeros(len(prints), bool)
                        place = at[first[here[ok]]]
                        same = g.checks(place, k).view(np.int64) == low[ok]
                        phrases += [g.phrase(a, k) for a in place[same].tolist()]
                        counts += n[ok][same].tolist()
                    if phrases:
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "phrase", "n"])

    return own.mapInArrow(run, "lang string, phrase string, n long").distinct()


def frequent_phrases(docs: DataFrame, least: int = 30, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of all phrases of one to four words said ``least`` times or more, and (lang, n) of all words.

    ``bits`` shortens the fingerprints, for tests of collisions; the result is the same.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("key", F.xxhash64("lang", "text"))
    words = scratch.keep(_counted(texts, (1,), 0, None, bits), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    often = F.col("n") >= least
    pairs = scratch.keep(_counted(texts, (2,), 1, seen(words.where(often).select("print")), bits).where(often), "pairs")
    longer = scratch.keep(_counted(texts, (3, 4), 2, seen(pairs.select("print")), bits).where(often), "longer")
    # lengths stay apart, so that a fingerprint shared by phrases of two lengths is a collision as well
    levels = scratch.keep(words.where(often).unionByName(pairs).unionByName(longer), "levels")
    both = levels.groupBy("lang", "print").agg(F.max("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("key").alias("key"))
    single, mixed = both.where("low = high"), both.where("low != high").select("lang", "print")
    found = scratch.keep(_read(texts, single, bits), "found")
    if not mixed.isEmpty():
        found = scratch.keep(found.unionByName(_recounted(texts, mixed, least, bits)), "all")
    scratch.drop("pairs", "longer", "levels")
    return found, totals


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, covered: int = 80, salts: int = 64, bits: int = 64) -> DataFrame:
    """The ``top`` phrases of each language by how much more they are said than their parts allow.

    Rows (lang, rank, phrase, a, l, r, n, score): a phrase of two to four words said a >= ``least`` times, its weakest
    cut into parts said l and r times, score floor(2000000 * a / (l + r)), n words of the language. A phrase inside a
    longer one that is said at least ``covered`` percent as often is left out. Ties go to the larger a, then to the
    smaller phrase in UTF-8 order. ``docs`` has (lang, text), other columns are unread. Texts (null: empty) have A-Z
    folded and are cut into pieces at ``[.,;:!?\\x0A-\\x0D]``, these into words at 0x20 and 0x09; a null lang is
    ``und``. Empty texts, texts without words and empty tables add nothing; repeated rows count each time; one text is
    hashed in one task, whatever its length.
    """
    found, totals = frequent_phrases(docs, least, bits)
    word = F.split("phrase", " ")
    candidates = found.withColumn("words", word).withColumn("k", F.size("words")).where("k > 1")
    cuts = candidates.select("lang", "phrase", "words", "k", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("first", F.array_join(F.slice("words", 1, F.col("cut")), " ")).withColumn("rest", F.array_join(F.slice("words", F.col("cut") + 1, F.col("k")), " "))
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr("2000000 * cast(a as decimal(25, 0)) div (cast(l as decimal(25, 0)) + r)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("weakest"))
    inner = candidates.where("k > 2").select("lang", "words", "k", "n", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inner = inner.select("lang", "words", "n", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at"))
    inner = inner.select("lang", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("phrase"), "n")
    longest = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = scored.join(longest, ["lang", "phrase"], "left").where(f"longer is null or 100 * cast(longer as decimal(25, 0)) < {covered} * cast(a as decimal(25, 0))")
    kept = kept.select("lang", "phrase", "a", "weakest.l", "weakest.r", "weakest.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    some = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql(least: int = 30, top: int = 2000, covered: int = 80) -> str:
    """collocations() over the table ``documents``, phrases as text, for DuckDB."""
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i : i + {k - 1}], ' '))) AS phrase FROM pieces" for k in range(1, LONGEST + 1)
    )
    return f"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts)),
counts AS (SELECT lang, k, phrase, count(*) AS n FROM ({grams}) GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE n >= {least}),
cuts AS (SELECT lang, phrase, w, k, n AS a, unnest(range(1, k)) AS cut FROM often WHERE k > 1),
scored AS (
  SELECT c.lang, c.phrase, c.a, min({{'s': CAST(2000000 * c.a::HUGEINT // (l.n::HUGEINT + r.n) AS BIGINT), 'cut': c.cut, 'l': l.n, 'r': r.n}}) AS b
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.cut], ' ') AND l.k = c.cut
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1 :], ' ') AND r.k = c.k - c.cut GROUP BY ALL),
spots AS (SELECT lang, w, k, n, unnest(range(2, k)) AS size FROM often WHERE k > 2),
inside AS (SELECT lang, w, n, size, unnest(range(1, k - size + 2)) AS spot FROM spots),
longest AS (SELECT lang, array_to_string(w[spot : spot + size - 1], ' ') AS phrase, max(n) AS n FROM inside GROUP BY ALL),
kept AS (
  SELECT s.* FROM scored s LEFT JOIN longest g ON g.lang = s.lang AND g.phrase = s.phrase WHERE g.n IS NULL OR 100 * g.n::HUGEINT < {covered} * s.a::HUGEINT),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY b.s DESC, a DESC, phrase) AS rank FROM kept)
SELECT k.lang, rank, phrase, a, b.l AS l, b.r AS r, t.n AS n, b.s AS score FROM ranked k JOIN totals t ON t.lang = k.lang WHERE rank <= {top}
"""
