"""Token ids of whole texts from the ids of their distinct chunks.

A chunk is a piece of text whose tokens depend on nothing outside it. Each distinct chunk of a batch is encoded
once, and a bounded table in each Python worker keeps what earlier batches met. Two 64-bit hashes identify a
chunk; if the first is equal and the second is not, the slice is encoded chunk by chunk instead.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .textarrays import CHECKS, LOWER, SEPARATOR, U64, WORDS, Slice, hash_pairs, ragged

#: Chunks a worker keeps (some 40 bytes each).
KEPT = 3 << 19
LETTER, STOP = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
STOP[[ord(c) for c in "!\"#$%&()*,.:;?"]] = True


def words(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks for tokenizers that drop white space: the words, cut before ASCII marks that follow an ASCII letter.

    No token of a pattern that matches letters and marks apart spans such a place, and none of the marks can begin
    a contraction or stand in an added token. Returns starts, ends and the offsets of the texts.
    """
    starts, ends, _ = s.words()
    cut = np.flatnonzero(STOP[s.buf[1:]] & LETTER[s.buf[:-1]]) + 1
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.concatenate([[0], np.searchsorted(starts, s.end)])


def spaced_words(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks for tokenizers that keep white space: white space and the word after it.

    They are cut before ASCII white space that follows anything that isn't white space, of which no token of a
    byte-level splitting pattern spans more than the side it is on. After lead bytes of wider spaces nothing is cut.
    """
    b = s.buf
    space = SEPARATOR[b]
    cut = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    one, two, three = b[cut - 1], b[np.maximum(cut - 2, 0)], b[np.maximum(cut - 3, 0)]
    wide = ((two == 0xC2) & (one <= 0xA0)) | ((one >= 0x80) & ((three == 0xE1) | (three == 0xE3) | ((three == 0xE2) & (two <= 0x81))))
    cut = cut[~wide]
    is_end = np.zeros(len(b), bool)
    is_end[s.end] = True
    starts = np.sort(np.concatenate([s.begin[s.end > s.begin], cut[~is_end[cut]]]))
    offsets = np.concatenate([[0], np.searchsorted(starts, s.end)])
    ends = np.append(starts[1:], 0)
    last = offsets[1:][np.diff(offsets) > 0] - 1
    ends[last] = s.end[np.diff(offsets) > 0]
    return starts, ends, offsets


class Ids:
    """Ids of chunks, remembered between batches.

    ``encode`` takes a list of byte strings and returns their ids one after the other, and how many each has.
    ``literal``: for tokenizers that lower-case all text but some literal strings, these strings. Chunks that differ
    in A-Z alone are then one, except in slices where such a string occurs in any case.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], literal: list[bytes] | None = None):
        self.encode, self.literal = encode, literal
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks, self.rows = np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64)
        self.offsets, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _add(self, keys: np.ndarray, checks: np.ndarray, chunks: list[bytes]) -> None:
        new, n = self.encode(chunks)
        rows = len(self.offsets) - 1 + np.arange(len(n))
        self.ids = np.concatenate([self.ids, new])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(n)])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.checks, self.rows = keys[order], np.concatenate([self.checks, checks])[order], np.concatenate([self.rows, rows])[order]

    def of(self, s: Slice, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks one after the other, and how many each has."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        view = s.buf.tobytes()
        small = view.lower() if self.literal else b""
        fold = LOWER if self.literal is not None and not any(x.lower() in small for x in self.literal) else slice(None)
        hashes, checks = hash_pairs(WORDS, CHECKS, s.buf, starts, ends, fold)
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > KEPT:
            self.clear()
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if (checks != checks[first][which]).any() or (known.any() and (self.checks[at[known]] != checks[first][known]).any()):
            return self.encode([s.buf[a:b].tobytes() for a, b in zip(starts, ends, strict=True)])
        new = first[~known]
        if len(new):
            self._add(keys[~known], checks[new], [view[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        rows = self.rows[np.searchsorted(self.keys, keys)]
        return ragged(self.ids, self.offsets, rows[which])
