"""Words, lines and their hashes for a whole Arrow batch of texts at once, in numpy.

A batch of texts becomes one byte buffer in which every text is followed by a line feed. Words are the
maximal runs of bytes other than 0x20 and 0x09-0x0D, which is also right for UTF-8. A hash is
``sum(T[byte] * P**i)`` modulo 2**64 followed by a bit mixer, so equal byte strings have equal hashes
everywhere, and different ones of a collection of n differ with probability 1 - n*n/2**65.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers (the SplitMix64 finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit integers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed * 0x632BE59BD9B4E019 & (2**64 - 1)))


class Hasher:
    """Hashes of segments of a byte buffer."""

    def __init__(self, seed: int):
        self.table = stream(seed, 256)
        self.base = int(stream(seed + 1000, 1)[0]) | 1
        self.powers = np.ones(1, U64)

    def power(self, n: int) -> np.ndarray:
        """base**i for i < n."""
        while len(self.powers) < n:
            step = U64(pow(self.base, len(self.powers), 2**64))
            self.powers = np.concatenate([self.powers, self.powers * step])
        return self.powers

    def segments(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        """One hash for each of the ascending, disjoint segments [start, end); an empty one hashes as 0 mixed."""
        out = np.zeros(len(starts), U64)
        lens = ends - starts
        full = lens > 0
        if full.any():
            s, n = starts[full], lens[full]
            first = np.cumsum(n) - n
            within = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
            values = (self.table if table is None else table)[buf[within + np.repeat(s, n)]]
            values *= self.power(int(n.max()))[within]
            out[full] = np.add.reduceat(values, first)
        return mix(out + (lens.astype(U64) << U64(32)))


def hash_pairs(one: Hasher, two: Hasher, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold=slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """segments() of two hashers for segments that are not empty, with bytes read as ``fold`` says."""
    n = ends - starts
    first = np.cumsum(n) - n
    within = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
    letters = buf[within + np.repeat(starts, n)]
    out = []
    for h in (one, two):
        values = h.table[fold][letters]
        values *= h.power(int(n.max()))[within]
        out.append(mix(np.add.reduceat(values, first) + (n.astype(U64) << U64(32))))
    return out[0], out[1]


WORDS = Hasher(1)
CHECKS = Hasher(2)
LOWER = np.arange(256)
LOWER[65:91] += 32


class Slice:
    """Some consecutive texts of a batch: ``buf`` with a line feed after each, text i at [begin[i], end[i])."""

    def __init__(self, first: int, texts: list[bytes]):
        self.first, self.texts = first, texts
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        n = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.end = np.cumsum(n + 1) - 1
        self.begin = self.end - n

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and offsets into them: text i has words [offsets[i], offsets[i + 1])."""
        word = ~SEPARATOR[self.buf]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[0::2], edge[1::2]
        return starts, ends, np.concatenate([[0], np.searchsorted(starts, self.end)])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As words(), for the lines between line feeds (an empty text has one empty line)."""
        ends = np.flatnonzero(self.buf == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        return starts, ends, np.concatenate([[0], np.searchsorted(ends, self.end) + 1])


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on through later stages, and idle ones would hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not every C library has it
        pass


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """A text column (null: empty) in slices of about ``limit`` bytes, whole texts each."""
    texts = column.cast(pa.large_binary()).to_pylist()
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if t is None:
            texts[i] = t = b""
        size += len(t)
        if size >= limit:
            yield Slice(begin, texts[begin : i + 1])
            begin, size = i + 1, 0
    if begin < len(texts):
        yield Slice(begin, texts[begin:])
    del texts
    give_back()


def word_hashes(s: Slice, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the offsets of the texts; ``lower`` folds A-Z."""
    starts, ends, offsets = s.words()
    return WORDS.segments(s.buf, starts, ends, WORDS.table[LOWER] if lower else None), offsets


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words (none if there are fewer)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    factors = stream(77, width) | U64(1)
    out = np.zeros(n, U64)
    for j in range(width):
        out += words[j : j + n] * factors[j]
    return mix(out)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles; with fewer words than ``width`` the whole sequence is one; none without words."""
    if 0 < len(words) < width:
        factors = stream(77, width) | U64(1)
        return mix((words * factors[: len(words)]).sum(dtype=U64, keepdims=True) + U64(len(words)))
    return np.unique(shingle_hashes(words, width))


def ragged(values: np.ndarray, offsets: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``take`` of a ragged array one after the other, and their lengths."""
    n = (offsets[1:] - offsets[:-1])[take]
    within = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
    return values[within + np.repeat(offsets[:-1][take], n)], n
