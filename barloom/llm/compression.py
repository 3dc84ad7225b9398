"""Compression classifier: a text is like the labelled texts whose zstandard dictionary compresses it better.

One dictionary is built from texts of label 1 and one from texts of label 0. Every text is cut into pieces (short
ones, so that a dictionary and not the text itself explains a piece), and each piece is compressed with both. The
difference of the two sums of sizes for each byte of text is the margin, and a logistic slope and intercept fitted
on sampled rows that the dictionaries did not see, and shifted by the shares of the labels in all labelled rows,
turn it into the probability of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import calibrate, labelled_sample, shift

PIECE, DICTIONARY, LEVEL = 1024, 112_640, 3
THRESHOLD = 0.3
#: Rows whose labels are kept for testing, as a condition on doc_id.
HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"


def pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


class Scorer:
    """Margins of texts from the dictionaries of label 0 and of label 1."""

    def __init__(self, dictionaries: list[bytes]):
        self.codecs = []
        for raw in dictionaries:
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.codecs.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False))

    def margin(self, text: bytes) -> float:
        """Bytes that label 1's dictionary saves over label 0's, for each hundred bytes of text; 0 for an empty one."""
        if not text:
            return 0.0
        bad, good = (sum(len(c.compress(p)) for p in pieces(text)) for c in self.codecs)
        return 100 * (bad - good) / len(text)


def train(texts: list[bytes], labels: np.ndarray) -> tuple[list[bytes], float, float] | None:
    """Dictionaries of labels 0 and 1, slope and intercept; None if a label has too little text for a dictionary."""
    held = np.arange(len(texts)) % 4 == 3
    dictionaries = []
    for label in (0, 1):
        own = [p for t, y, h in zip(texts, labels, held, strict=True) if y == label and not h for p in pieces(t)]
        size = min(DICTIONARY, sum(map(len, own)) // 8)
        try:
            dictionaries.append(zstandard.train_dictionary(size, own, k=64, d=8, level=LEVEL).as_bytes())
        except (zstandard.ZstdError, ValueError):
            return None
    scorer = Scorer(dictionaries)
    rest = np.flatnonzero(held)
    margins = np.array([scorer.margin(texts[i]) for i in rest])
    return dictionaries, *calibrate(margins, labels[rest])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 2500, max_bytes: int = 8000) -> dict:
    """A model from the rows of ``docs`` (doc_id, text) labelled by ``labels`` (doc_id, label 0 or 1).

    Trained in one task on the sample of labelled_sample(), up to ``max_rows`` texts of each label and
    ``max_bytes`` bytes each. With too little text of a label there are no dictionaries, and every text gets the
    share of label 1 as its score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        texts, y = [], np.zeros(0)
        if got:
            t = pa.Table.from_batches(got).sort_by([("order", "ascending"), ("text", "ascending")])
            texts, y = t.column("text").cast(pa.large_binary()).to_pylist(), t.column("label").to_numpy().astype(float)
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        d, slope, intercept = train(texts, y) or ([], 0.0, float(np.log(share / (1 - share))))
        numbers = [pa.array([slope]), pa.array([intercept]), pa.array([int((y == 0).sum())]), pa.array([int((y == 1).sum())])]
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.list_(pa.binary())), *numbers], names=["dictionaries", "slope", "intercept", "n0", "n1"])

    schema = "dictionaries array<binary>, slope double, intercept double, n0 long, n1 long"
    found = labelled_sample(docs, labels, max_rows, max_bytes).coalesce(1).mapInArrow(run, schema).first()
    model = found.asDict() if found else {"dictionaries": [], "slope": 0.0, "intercept": 0.0, "n0": 0, "n1": 0}
    model["intercept"] += shift(labels, (model["n0"], model["n1"]))
    return model


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of ``docs`` (doc_id, text; other columns unread).

    Texts are read whole. A null or empty text has margin 0, so its score is what the intercept alone gives.
    Repeated rows and null doc_ids are kept (held_out is then null); an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer([bytes(d) for d in m["dictionaries"]]) if m["dictionaries"] else None
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            margins = np.array([scorer.margin(t or b"") if scorer else 0.0 for t in texts], float)
            p = 1 / (1 + np.exp(-np.clip(m["slope"] * margins + m["intercept"], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.expr(HELD_OUT).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
