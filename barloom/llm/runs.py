"""Periodic runs of words, from branching squares of an enhanced suffix array.

The words of a slice of texts get one suffix array by prefix doubling (texts never share a rank, suffixes that are told
apart leave the later rounds) and its LCP array. An LCP interval of depth d is split at each of its boundaries into the
part before and the part behind; for every suffix i of the smaller part, a square of period d starts at i or i - d if
the inverse suffix array puts i + d or i - d in the other part. Such a square branches: the word behind it breaks the
period, so it ends its run, and rotating it to the left as long as the period holds gives the start. Runs found with
several periods have one start and end; the smallest period is theirs. Intervals are ranges of positions, no tree is
built, and each word is looked at O(log n) times.

A text is worked on in one task, as the definition needs all of it: about 8 * log2(n) + 100 bytes a word of the slice
or, where that is longer, of the one text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in one suffix array; a longer text has its own.
SLICE_BYTES = 2 << 20
#: Suffixes tested at once.
STEP = 1 << 20


def _ranks(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array, and for h = 1, 2, 4, ... ranks that are equal where the first h words are equal (padded by -1)."""
    n = len(codes)
    text = np.repeat(np.arange(len(begin), dtype=np.int64), end - begin)
    stop = np.repeat(end, end - begin)
    key = text * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    at = np.arange(n)
    head = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, at, 0))
    rank[n] = -1
    levels = [rank.astype(np.int32)]
    h = 1
    while True:
        alone = head & np.concatenate([head[1:], [True]])
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return order, levels
        suffix = order[open_]
        behind = np.where(suffix + h < stop[suffix], rank[np.minimum(suffix + h, n)] + 1, 0)
        key = rank[suffix] * (n + 1) + behind
        by = np.argsort(key, kind="stable")
        key, suffix = key[by], suffix[by]
        order[open_] = suffix
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        head[open_] = fresh
        rank[suffix] = np.maximum.accumulate(np.where(fresh, open_, 0))
        levels.append(rank.astype(np.int32))
        h *= 2


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of words that the suffixes a and b share."""
    n = len(levels[0]) - 1
    out = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        rank = levels[level]
        same = rank[np.minimum(a + out, n)] == rank[np.minimum(b + out, n)]
        out[same] += 1 << level
    return out


def _common_before(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of words that end before a and before b and are the same, none of them before ``first``."""
    out = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        h = 1 << level
        rank = levels[level]
        left = a - out - h
        same = (left >= first) & (rank[np.maximum(left, 0)] == rank[np.maximum(b - out - h, 0)])
        out[same] += h
    return out


def _parts(lcp: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position of the part before and last position of the part behind each boundary of ``nodes``.

    The part before reaches over boundaries at least as deep, the part behind over deeper ones, so that two suffixes
    with d words in common are on both sides of exactly one boundary of depth d.
    """
    n = len(lcp)
    mins = [lcp]
    while 2 << (len(mins) - 1) <= n:
        h = 1 << (len(mins) - 1)
        mins.append(np.minimum(mins[-1][:-h], mins[-1][h:]))
    depth = lcp[nodes]
    left, right = nodes - 1, nodes + 1
    for level in range(len(mins) - 1, -1, -1):
        h, low = 1 << level, mins[level]
        start = left - h + 1
        ok = (start >= 0) & (low[np.clip(start, 0, len(low) - 1)] >= depth)
        left = np.where(ok, left - h, left)
        ok = (right + h <= n) & (low[np.minimum(right, len(low) - 1)] > depth)
        right = np.where(ok, right + h, right)
    return left, right - 1


def branching_squares(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts and periods of the squares that end their runs, and the rank levels."""
    order, levels = _ranks(codes, begin, end)
    n = len(codes)
    base = levels[0]
    nodes = np.flatnonzero(base[order[1:]] == base[order[:-1]]) + 1
    lcp = np.zeros(n, np.int32)
    lcp[nodes] = _common(levels, order[nodes - 1], order[nodes])
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    left, right = _parts(lcp, nodes)
    depth = lcp[nodes].astype(np.int64)
    before, behind = nodes - left, right - nodes + 1
    small = before <= behind
    lo, size = np.where(small, left, nodes), np.minimum(before, behind)
    other_lo, other_hi = np.where(small, nodes, left), np.where(small, right, nodes - 1)
    # boundaries with very large parts are cut into several pieces, small ones are taken together
    pieces = -(-size // STEP)
    owner = np.repeat(np.arange(len(nodes)), pieces)
    offset = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STEP
    held = np.minimum(size[owner] - offset, STEP)
    turn = np.cumsum(held) // STEP
    starts, periods = [], []
    for first, stop in zip(np.searchsorted(turn, np.unique(turn)), np.searchsorted(turn, np.unique(turn), side="right"), strict=True):
        count, node = held[first:stop], owner[first:stop]
        within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        i = order[np.repeat(lo[node] + offset[first:stop], count) + within]
        node = np.repeat(node, count)
        d = depth[node]
        for j in (i + d, i - d):
            there = inverse[np.clip(j, 0, n - 1)]
            hit = (j >= 0) & (j < n) & (there >= other_lo[node]) & (there <= other_hi[node])
            starts.append(np.minimum(i, j)[hit])
            periods.append(d[hit])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *periods]), levels


def find_runs(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run of at least ``least`` words and ``times`` periods, by text, start, period.

    ``codes`` are the word numbers of all texts one after the other, text t has [begin[t], end[t]); starts count from
    the text's first word.
    """
    if not len(codes):
        return (np.zeros(0, np.int64),) * 4
    square, period, levels = branching_squares(codes, begin, end)
    text = np.searchsorted(begin, square, side="right") - 1
    start = square - _common_before(levels, square, square + period, begin[text])
    length = square + 2 * period - start
    by = np.lexsort((period, length, start))
    text, start, length, period = text[by], start[by], length[by], period[by]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    first &= length >= np.maximum(least, times * period)
    text, start, length, period = text[first], start[first], length[first], period[first]
    by = np.lexsort((period, start))
    return text[by], (start - begin[text])[by], length[by], period[by]


def _planted(doc_ids: list, n: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Which word stands at every place: its own, or for one doc_id in ten one of a stretch that is repeated."""
    source = np.arange(int(n.sum()))
    for t, doc_id in enumerate(doc_ids):
        if doc_id is None or not n[t]:
            continue
        h = zlib.crc32(str(doc_id).encode())
        if h % 10:
            continue
        g = h // 10
        a = g % int(n[t])
        p = 1 + (int(n[t]) - a) // (3 + g % 8)
        i = np.arange(a, int(n[t]))
        source[begin[t] + i] = begin[t] + a + (i - a) % p
    return source


class Words:
    """The words of some texts (null: none), one after the other."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        flat, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(full)])
        edge = total[np.concatenate([[0], np.cumsum(n)])]
        self.words, self.begin, self.end = flat.filter(pa.array(full)), edge[:-1], edge[1:]

    def joined(self, keep: np.ndarray) -> list[bytes]:
        """The kept words of each text with one space between."""
        total = np.concatenate([[0], np.cumsum(keep)])
        edge = np.concatenate([total[self.begin], total[self.end[-1:]]])
        lists = pa.LargeListArray.from_arrays(pa.array(edge, pa.int64()), self.words.filter(pa.array(keep)))
        return pc.binary_join(lists.cast(pa.list_(pa.large_string())), pa.scalar(" ", pa.large_string())).cast(pa.large_binary()).to_pylist()


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, b in enumerate(size):
        held += int(b)
        if held >= SLICE_BYTES:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(size):
        yield first, len(size)


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, planted: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): number of runs, the longest one, digests of all and of the rest.

    Words are the runs of characters other than 0x20 and 0x09-0x0D, compared as they are. A run is a stretch with
    smallest period q of at least ``least`` words and ``times`` * q that can't be extended. ``runs_sha256`` digests the
    lines ``start,length,period``, ``collapsed_sha256`` the words left when each run keeps its first q, joined by a
    space. ``planted`` first repeats a stretch of words in one doc_id of ten, by the crc32 of the doc_id.
    Null and empty texts have no words: no run, four nulls, digests of nothing. Null doc_ids are kept (and not planted),
    repeated rows each give their row, other columns are unread, an empty table gives an empty one.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop in _slices(batch.column(1)):
                yield _digests(batch.column(0)[first:stop], batch.column(1)[first:stop], least, times, planted)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, SCHEMA)


def _digests(ids: pa.Array, texts: pa.Array, least: int, times: int, planted: bool) -> pa.RecordBatch:
    w = Words(texts)
    doc_ids, n = ids.to_pylist(), w.end - w.begin
    if planted:
        w.words = w.words.take(pa.array(_planted(doc_ids, n, w.begin)))
    codes = w.words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text, start, length, period = find_runs(codes, w.begin, w.end, least, times)
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, w.begin[text] + start + period, 1)
    np.add.at(change, w.begin[text] + start + length, -1)
    kept = w.joined(np.cumsum(change[:-1]) == 0)
    edge = np.searchsorted(text, np.arange(len(doc_ids) + 1))
    rows: list[list] = [[] for _ in range(7)]
    for t in range(len(doc_ids)):
        own = slice(edge[t], edge[t + 1])
        runs = list(zip(start[own].tolist(), length[own].tolist(), period[own].tolist(), strict=True))
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        found = (len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2])
        for column, value in zip(rows, (*found, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept[t] or b"").hexdigest()), strict=True):
            column.append(value)
    arrays = [ids, *(pa.array(c, pa.int64()) for c in rows[:5]), *(pa.array(c, pa.string()) for c in rows[5:])]
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in SCHEMA.split(", ")])


def runs_sql(least: int = 6, times: int = 4) -> str:
    """periodic_runs(planted=True) over ``documents`` for DuckDB: every period of every text, islands of equal words."""
    return f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS h
  FROM documents, crc),
shape AS (SELECT *, len(w) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS hit FROM docs),
cut AS (SELECT *, CASE WHEN hit THEN g % n END AS a, CASE WHEN hit THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM shape),
words AS (
  SELECT r, doc_id, n, CASE WHEN hit THEN list_transform(range(n), lambda i: w[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) ELSE w END AS w FROM cut),
periods AS (SELECT r, n, w, unnest(range(1, n // {times} + 1)) AS q FROM words),
same AS (SELECT r, q, unnest(list_filter(range(n - q), lambda i: w[i + 1] = w[i + q + 1])) AS i FROM periods),
islands AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same) GROUP BY r, q, island),
runs AS (
  SELECT r, start, length, min(q) AS period FROM islands WHERE length >= 2 * q GROUP BY r, start, length HAVING length >= greatest({least}, {times} * min(q))),
per AS (
  SELECT r, count(*) AS n_runs, min({{'l': -length, 's': start, 'p': period}}) AS top,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
gone_of AS (SELECT r, list(i) AS i FROM gone GROUP BY r),
kept AS (
  SELECT words.r, array_to_string(CASE WHEN g.i IS NULL THEN w ELSE list_transform(list_filter(range(n), lambda i: NOT list_contains(g.i, i)), lambda i: w[i + 1]) END, ' ') AS body
  FROM words LEFT JOIN gone_of g ON g.r = words.r)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, -top.l AS length, top.p AS period, (1000 * -top.l) // top.p AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM words d LEFT JOIN per ON per.r = d.r JOIN kept k ON k.r = d.r
"""
