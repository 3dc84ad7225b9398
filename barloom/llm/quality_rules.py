"""Quality rules: counted text statistics with fixed limits, and a trained score with a fixed threshold.

The score is a logistic regression on hashed word and character n-grams. Its weights are fitted on a sample of the
labelled rows of at most ``max_rows`` rows of each label (those with the smallest hash of doc_id), in one task, by
mini-batch gradient steps; a slope and an intercept then calibrate its margin to a probability on the fourth of
the sample that the steps did not use, shifted by the shares of the labels in all labelled rows. Scoring is one pass of Arrow batches: a text's margin is the mean weight
of its word n-grams plus the mean weight of its character n-grams, so it does not grow with the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .samples import calibrate, labelled_sample, shift
from .textarrays import CHECKS, SEPARATOR, U64, WORDS, Slice, mix, shingle_hashes, slices, stream, word_hashes

#: Fixed limits of the counted statistics.
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: A text whose probability of label 1 is below this is rejected.
THRESHOLD = 0.3
#: Buckets of word n-grams and of character n-grams (each).
BUCKET_BITS = 17
WORD_ORDERS, CHAR_ORDERS = (1, 2), (2, 3, 4)
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def repeated(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For hashes of several texts: whether each occurs again in its own text."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keys = mix(hashes ^ mix(owner.astype(U64)))
    _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[which] > 1


def counted(s: Slice) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a slice."""
    starts, ends, offsets = s.words()
    docs = len(s.texts)
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[np.concatenate([[0], s.end + 1])])
    code_points = ((s.buf & 0xC0) != 0x80) & ~SEPARATOR[s.buf]
    words = WORDS.segments(s.buf, starts, ends)
    n_words = np.diff(offsets)
    windows = shingle_hashes(words, REPEAT_WINDOW)
    doc = np.repeat(np.arange(docs), n_words)
    n_repeat = np.zeros(docs, np.int64)
    if len(windows):
        inside = doc[: len(windows)] == doc[REPEAT_WINDOW - 1 :]
        at = np.flatnonzero(inside)
        count = np.maximum(n_words - REPEAT_WINDOW + 1, 0)
        again = at[repeated(windows[at], np.concatenate([[0], np.cumsum(count)]))]
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + REPEAT_WINDOW, -1)
        n_repeat = np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=docs)
    lines, line_ends, line_offsets = s.lines()
    has_word = np.add.reduceat(np.append(~SEPARATOR[s.buf], False).astype(np.int64), np.minimum(lines, len(s.buf))) > 0
    has_word &= line_ends > lines
    line_doc = np.repeat(np.arange(docs), np.diff(line_offsets))
    keys = mix(CHECKS.segments(s.buf, lines, line_ends) ^ mix(line_doc.astype(U64)))
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    n_dup = np.bincount(line_doc[has_word & ~first], minlength=docs)
    return {"n_words": n_words, "word_chars": per(code_points), "n_symbols": per(SYMBOLS[s.buf]), "n_dup_lines": n_dup, "n_repeat_words": n_repeat}


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - BUCKET_BITS)).astype(np.int32)


def features(s: Slice) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, offsets of the texts) for each n-gram order: words first, then bytes of the lower-cased text.

    The byte n-grams of a text include its closing line feed, so every text has at least one of order 2.
    """
    words, offsets = word_hashes(s, lower=True)
    docs, out = len(s.texts), []
    n = np.diff(offsets)
    doc = np.repeat(np.arange(docs), n)
    for k, order in enumerate(WORD_ORDERS):
        h = shingle_hashes(words, order)
        inside = doc[: len(h)] == doc[order - 1 :] if len(h) else np.zeros(0, bool)
        count = np.maximum(n - order + 1, 0)
        out.append((_buckets(mix(h[inside] + U64(k))), np.concatenate([[0], np.cumsum(count)])))
    letters = np.arange(256)
    letters[65:91] += 32
    codes = stream(9, 256)[letters][s.buf]
    bounds = np.concatenate([[0], s.end + 1])
    for order in CHAR_ORDERS:
        factors = stream(10 + order, order) | U64(1)
        size = max(len(codes) - order + 1, 0)
        h = np.zeros(size, U64)
        for j in range(order):
            h += codes[j : j + size] * factors[j]
        out.append((_buckets(h), np.minimum(bounds, size)))
    return out


def _margins(s: Slice, weights: np.ndarray) -> np.ndarray:
    """Sum over n-gram orders of the mean weight of a text's n-grams of that order."""
    total = np.zeros(len(s.texts))
    for k, (buckets, offsets) in enumerate(features(s)):
        sums = np.concatenate([[0.0], np.cumsum(weights[k][buckets], dtype=np.float64)])[offsets]
        total += np.diff(sums) / np.maximum(np.diff(offsets), 1)
    return total


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 20, rate: float = 40.0, penalty: float = 1e-6) -> np.ndarray:
    """Weights (orders x buckets, float32) with the calibrated slope and intercept in two cells behind them."""
    orders = len(WORD_ORDERS) + len(CHAR_ORDERS)
    size = 1 << BUCKET_BITS
    weights = np.zeros((orders, size))
    rows: list[list[np.ndarray]] = []
    for s in slices(pa.array(texts, pa.binary())):
        per_order = features(s)
        for i in range(len(s.texts)):
            keys, values = [], []
            for k, (buckets, offsets) in enumerate(per_order):
                b, c = np.unique(buckets[offsets[i] : offsets[i + 1]], return_counts=True)
                keys.append(b.astype(np.int32) + k * size), values.append((c / max(c.sum(), 1)).astype(np.float32))
            rows.append([np.concatenate(keys), np.concatenate(values)])
    flat = weights.reshape(-1)
    held = np.arange(len(rows)) % 4 == 3
    fit = np.flatnonzero(~held)
    share = np.clip(labels[fit].mean(), 1e-3, 1 - 1e-3) if len(fit) else 0.5
    bias = np.log(share / (1 - share))
    order = np.argsort(stream(3, len(fit)))
    squares = np.full(flat.shape, 1e-8)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for batch in np.array_split(fit[order], max(1, len(fit) // 64)):
            if not len(batch):
                continue
            keys = np.concatenate([rows[i][0] for i in batch])
            values = np.concatenate([rows[i][1] for i in batch])
            n = np.array([len(rows[i][0]) for i in batch])
            doc = np.repeat(np.arange(len(batch)), n)
            margin = np.bincount(doc, flat[keys] * values, len(batch)) + bias
            error = labels[batch] - 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            used, at = np.unique(keys, return_inverse=True)
            g = np.bincount(at, error[doc] * values, len(used)) / len(batch) - penalty * flat[used]
            squares[used] += g * g
            flat[used] += step * 0.01 * g / np.sqrt(squares[used])
    rest = np.flatnonzero(held)
    m = np.array([float((flat[rows[i][0]] * rows[i][1]).sum()) for i in rest])
    slope, intercept = calibrate(m, labels[rest], bias)
    return np.concatenate([flat, [slope, intercept]]).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 2500, max_bytes: int = 8000) -> np.ndarray:
    """Weights from the rows of ``docs`` (doc_id, text) with a ``labels`` row (doc_id, label 0 or 1).

    The sample is that of labelled_sample(). Without two labels all weights are 0 and every score is the share of
    label 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        t = pa.Table.from_batches(got).sort_by([("order", "ascending"), ("text", "ascending")]) if got else None
        y = t.column("label").to_numpy().astype(float) if got else np.zeros(0)
        if got and 0 < y.mean() < 1:
            w = train(t.column("text").cast(pa.large_binary()).to_pylist(), y)
        else:
            share = np.clip(y.mean(), 0.01, 0.99) if got else 0.5
            w = np.zeros(((len(WORD_ORDERS) + len(CHAR_ORDERS)) << BUCKET_BITS) + 2, np.float32)
            w[-1] = np.log(share / (1 - share))
        counts = [pa.array([int((y == 0).sum())]), pa.array([int((y == 1).sum())])]
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), *counts], names=["weights", "n0", "n1"])

    one = labelled_sample(docs, labels, max_rows, max_bytes).coalesce(1).mapInArrow(run, "weights binary, n0 long, n1 long").first()
    if one is None:  # no sample at all: even odds
        return np.zeros(((len(WORD_ORDERS) + len(CHAR_ORDERS)) << BUCKET_BITS) + 2, np.float32)
    weights = np.frombuffer(one["weights"], np.float32).copy()
    weights[-1] += shift(labels, (one["n0"], one["n1"]))
    return weights


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns unread): counts, base_failed, kept, score.

    A null or empty text has no words, so it fails the base limits. Texts are read whole; repeated rows and null
    doc_ids are kept; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = shared.value
        table, slope, intercept = flat[:-2].reshape(-1, 1 << BUCKET_BITS), float(flat[-2]), float(flat[-1])
        for batch in batches:
            for s in slices(batch.column(1)):
                c = counted(s)
                failed = base_failed(c)
                p = 1 / (1 + np.exp(-np.clip(slope * _margins(s, table) + intercept, -30, 30)))
                numbers = [pa.array(c[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                ids = batch.column(0).slice(s.first, len(s.texts)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *numbers, pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def quality_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """fit() on the labelled rows of ``docs`` and score() of all; ``labels`` has doc_id and quality."""
    return score(docs, fit(docs, labels.select("doc_id", F.col("quality").alias("label"))))
