"""Byte-pair encoding and decoding by a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that the merges give. It starts with one state and an arc back
to it for every byte. The merges are taken in order, and each puts in a gadget: for u + v = w, the state that u
leads to is split off for u alone and loses its arc v, and every state with an arc u gets an arc w to where v
led. All arcs with one label therefore lead to one state, so the automaton is the state of each label and, for
each state, its arcs; those are kept as the arcs lost, with the merge that took them, on top of the state that
it was split from. A text has one accepted sequence, and each of its prefixes has one too, so the last token of
every prefix is found from left to right by the table of arcs. Decoding writes the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from .textarrays import ragged, slices

NEVER = 1 << 30


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled from labels (bytes by id) and merges (id, id, id) in order."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[bytes, int]):
        size = max([*labels, *special.values()]) + 1
        self.labels, self.special = labels, special
        self.left = np.full(size, -1, np.int64)
        self.time = np.zeros(size, np.int64)
        self.target = dict.fromkeys(labels, 0)
        self.parent, self.born, self.lost = [-1], [0], [{}]
        leads = [len(labels) - len({w for _, _, w in merges})]
        for now, (u, v, w) in enumerate(merges, 1):
            if self.left[w] >= 0 or len(labels[w]) < 2:
                raise ValueError(f"two merges make token {w}")
            self.left[w], self.time[w] = u, now
            q, r = self.target[u], self.target[v]
            self.target[w] = r
            leads[r] += 1
            if not self._has(q, v):
                continue
            if u == v or leads[q] > 1:
                leads[q] -= 1
                self.parent.append(q), self.born.append(now), self.lost.append({}), leads.append(1)
                q = self.target[u] = len(leads) - 1
            self.lost[q][v] = now
        self.tokens = {b: i for i, b in labels.items()}
        if not all(bytes([b]) in self.tokens for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.single = np.array([i for i in labels if self.left[i] < 0])
        depth, levels = dict.fromkeys((i for i in labels if self.left[i] < 0), 0), []
        for _, _, w in merges:
            d = depth[w] = depth[int(self.left[w])] + 1
            if len(levels) < d:
                levels.append([])
            levels[d - 1].append(w)
        self.levels = [np.array(x) for x in levels]
        self.losses = [(np.fromiter(x, np.int64, len(x)), np.fromiter(x.values(), np.int64, len(x))) for x in self.lost]
        self._flat()
        self._spell()

    def _flat(self) -> None:
        n = len(self.left)
        text = [self.labels.get(i, b"") for i in range(n)]
        for b, i in self.special.items():
            text[i] = b
        self.label_offsets = np.concatenate([[0], np.cumsum([len(x) for x in text])])
        self.label_bytes = np.frombuffer(b"".join(text), np.uint8)

    def _spell(self) -> None:
        """The tree of label prefixes as a hash table of (node, byte) -> node, and the label that ends at each node."""
        step: dict[int, int] = {}
        ends = {}
        for label, text in self.labels.items():
            at = 0
            for b in text:
                at = step.setdefault(at << 8 | b, len(step) + 1)
            ends[at] = label
        self.ends = np.full(len(step) + 1, -1, np.int32)
        self.ends[list(ends)] = list(ends.values())
        keys, values = np.array(list(step), np.int32), np.array(list(step.values()), np.int32)
        self.mask = (1 << (8 * len(keys)).bit_length()) - 1
        self.step_keys, self.step_values = np.full(self.mask + 1, -1, np.int32), np.zeros(self.mask + 1, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.step_keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[free[first]]
            self.step_keys[slot[first]], self.step_values[slot[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + (~free[rest])) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.int64) * 0x9E3779B1 >> 8) & self.mask

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The node after each node by a byte, or -1."""
        keys = nodes << 8 | letters
        slot = self._slot(keys)
        found = self.step_keys[slot]
        out = np.where(found == keys, self.step_values[slot], -1)
        again = np.flatnonzero((found != keys) & (found >= 0))
        while len(again):
            slot[again] = (slot[again] + 1) & self.mask
            found = self.step_keys[slot[again]]
            hit = found == keys[again]
            out[again[hit]] = self.step_values[slot[again[hit]]]
            again = again[~hit & (found >= 0)]
        return out

    def _lost_at(self, q: int, label: int) -> int:
        before = NEVER
        while q >= 0:
            t = self.lost[q].get(label, NEVER)
            if t < before:
                return t
            before, q = self.born[q], self.parent[q]
        return NEVER

    def _has(self, q: int, label: int) -> bool:
        """Whether state q has an arc now: it was never lost, nor was, before the merge, the arc it came with."""
        before = NEVER
        while label >= 0:
            if self._lost_at(q, label) <= min(before, NEVER - 1):
                return False
            before, label = int(self.time[label]), int(self.left[label])
        return True

    def row(self, q: int) -> np.ndarray:
        """The arcs of state q as a bit for each label."""
        lost = np.full(len(self.left), NEVER, np.int64)
        at, before = q, NEVER
        while at >= 0:
            labels, times = self.losses[at]
            on = times < before
            lost[labels[on]] = np.minimum(lost[labels[on]], times[on])
            before, at = self.born[at], self.parent[at]
        has = np.zeros(len(lost), bool)
        has[self.single] = True
        for w in self.levels:
            u = self.left[w]
            has[w] = has[u] & (lost[u] > self.time[w])
        return np.packbits(has & (lost == NEVER), bitorder="little")

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The labels of ids one after the other, and their lengths."""
        return ragged(self.label_bytes, self.label_offsets, ids.astype(np.int64))


def compile_tokenizer(path: str) -> Automaton:
    """The automaton of a byte-level BPE tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, letters = spec["model"], byte_letters()
    if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or model["end_of_word_suffix"] or model["continuing_subword_prefix"] or model["ignore_merges"]:
        raise ValueError(f"{path} isn't a plain byte-level BPE")
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"]):
        raise ValueError("added tokens must match literally")
    special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
    ids = model["vocab"]
    labels = {i: bytes(letters[c] for c in t) for t, i in ids.items() if i not in special.values()}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return Automaton(labels, [(ids[a], ids[b], ids[a + b]) for a, b in merges], special)


#: Bytes of text encoded at once.
SLICE = 1 << 20

#: The splitting pattern of byte-level vocabularies, for ASCII alone; other chunks are split by the library.
ASCII_SPLIT = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


#: The same where all letters beyond ASCII are of the Latin blocks that every Unicode version has as letters.
LATIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-ſ]*")
LATIN_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ſ]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9À-ÖØ-öø-ſ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


class Words:
    """Tokens of many words at once, by the table of arcs."""

    def __init__(self, automaton: Automaton):
        self.automaton = a = automaton
        self.target = np.zeros(len(a.left), np.int64)
        self.target[list(a.target)] = list(a.target.values())
        self.size = np.diff(a.label_offsets)
        self.place = np.full(len(a.parent), -1, np.int64)
        self.arcs = np.zeros((len(a.parent), (len(a.left) + 7) // 8), np.uint8)  # untouched rows take no memory
        self.used = 0

    def _rows(self, states: np.ndarray) -> np.ndarray:
        """Where the table has the arcs of each state; new rows are filled in."""
        for q in np.unique(states[self.place[states] < 0]).tolist():
            self.arcs[self.used], self.place[q] = self.automaton.row(q), self.used
            self.used += 1
        return self.place[states]

    def block(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids one after the other and their counts, for words of similar lengths (the longest sets the width)."""
        a = self.automaton
        n = np.fromiter(map(len, words), np.int64, len(words))
        wide = int(n.max())
        text = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(len(words), wide).astype(np.int32)
        last = np.full((len(words), wide + 1), -1, np.int32)
        for i in range(wide):
            at = np.flatnonzero(n > i)
            row = self._rows(self.target[last[at, i]] if i else np.zeros(len(at), np.int64))
            node = np.zeros(len(at), np.int32)
            for j in range(i, wide):
                node = a.step(node, text[at, j])
                on = node >= 0
                at, row, node = at[on], row[on], node[on]
                label = a.ends[node]
                ok = label >= 0
                ok[ok] = self.arcs[row[ok], label[ok] >> 3] >> (label[ok] & 7).astype(np.uint8) & 1 == 1
                last[at[ok], j + 1] = label[ok]
                more = n[at] > j + 1
                at, row, node = at[more], row[more], node[more]
                if not len(at):
                    break
        back, left = np.full((len(words), wide), -1, np.int32), n.copy()
        rows = np.arange(len(words))
        for k in range(wide - 1, -1, -1):
            rows = rows[left[rows] > 0]
            if not len(rows):
                break
            back[rows, k] = last[rows, left[rows]]
            left[rows] -= self.size[back[rows, k]]
        full = back >= 0
        return back[full].astype(np.uint32), full.sum(axis=1)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(n, kind="stable")
        ids, counts = [np.zeros(0, np.uint32)], np.zeros(len(words), np.int64)
        begin = 0
        while begin < len(words):
            # lengths of a block within a factor of 1.5, and a bounded table
            most = max(8, int(n[order[begin]] * 3 // 2))
            end = min(int(np.searchsorted(n[order], most, "right")), begin + max(1, (1 << 20) // most))
            x, c = self.block([words[i] for i in order[begin:end]])
            ids.append(x)
            counts[order[begin:end]] = c
            begin = end
        at = np.concatenate([[0], np.cumsum(counts[order])])
        where = np.empty(len(words), np.int64)
        where[order] = np.arange(len(words))
        return ragged(np.concatenate(ids), at, where)


class Encoder:
    """Chunks to ids: special strings first, then the splitting pattern, then the automaton."""

    def __init__(self, automaton: Automaton):
        from tokenizers import pre_tokenizers

        self.words, self.automaton = Words(automaton), automaton
        self.pre = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.letters = str.maketrans({k: chr(v) for k, v in byte_letters().items()})
        self.special = sorted(automaton.special, key=len, reverse=True)

    def split(self, text: bytes) -> list[bytes]:
        if text.isascii():
            return ASCII_SPLIT.findall(text)
        if LATIN.fullmatch(u := text.decode("utf-8", "replace")):
            return [x.encode() for x in LATIN_SPLIT.findall(u)]
        return [x.translate(self.letters).encode("latin-1") for x, _ in self.pre(u)]

    def pieces(self, text: bytes) -> list[bytes | int]:
        for s in self.special:
            if (at := text.find(s)) >= 0:
                return [*self.pieces(text[:at]), self.automaton.special[s], *self.pieces(text[at + len(s) :])]
        return self.split(text) if text else []

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        index: dict[bytes | int, int] = {}
        pieces = [self.pieces(t) for t in texts]
        which = np.fromiter((index.setdefault(x, len(index)) for p in pieces for x in p), np.int64)
        words = [x for x in index if isinstance(x, bytes)]
        ids, n = self.words(words)
        # special strings are rows of one id behind the words
        row, at = np.zeros(len(index), np.int64), 0
        special = [x for x in index if not isinstance(x, bytes)]
        for i, x in enumerate(index):
            if isinstance(x, bytes):
                row[i], at = at, at + 1
            else:
                row[i] = len(words) + special.index(x)
        ids, n = np.concatenate([ids, np.array(special, np.uint32)]), np.concatenate([n, np.ones(len(special), np.int64)])
        out, lens = ragged(ids, np.concatenate([[0], np.cumsum(n)]), row[which])
        k = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.concatenate([[0], np.cumsum(lens)])[np.cumsum(k)]
        return out, np.diff(np.concatenate([[0], ends]))


_WORKER: dict[str, tuple[Automaton, chunks.Ids]] = {}


def _digests(tables, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _WORKER:
            _WORKER.clear()
            _WORKER[name] = (tables.value, chunks.Ids(Encoder(tables.value)))
        automaton, ids_of = _WORKER[name]
        for batch in batches:
            for s in slices(batch.column(1), SLICE):
                starts, ends, offsets = chunks.spaced_words(s)
                ids, n = ids_of.of(s, starts, ends)
                first = np.concatenate([[0], np.cumsum(n)])[offsets]
                text, lens = automaton.decode(ids)
                at = np.concatenate([[0], np.cumsum(lens)])[first]
                little, text = ids.astype("<u4").tobytes(), text.tobytes()
                docs = len(s.texts)
                sha = lambda x: hashlib.sha256(x).hexdigest()
                decoded = [text[at[i] : at[i + 1]].decode("utf-8", "replace") for i in range(docs)]
                columns = [
                    batch.column(0).slice(s.first, docs).cast(pa.int64()),
                    pa.array(np.diff(first)),
                    pa.array([sha(little[4 * first[i] : 4 * first[i + 1]]) for i in range(docs)], pa.string()),
                    pa.array([sha(t.encode()) for t in decoded], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(tables, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _WORKER:
            _WORKER.clear()
            _WORKER[name] = (tables.value, chunks.Ids(Encoder(tables.value)))
        automaton, ids_of = _WORKER[name]
        for batch in batches:
            for s in slices(batch.column(1), SLICE):
                starts, ends, offsets = chunks.spaced_words(s)
                ids, n = ids_of.of(s, starts, ends)
                first = np.concatenate([[0], np.cumsum(n)])[offsets]
                text, lens = automaton.decode(ids)
                at = np.concatenate([[0], np.cumsum(lens)])[first]
                text, docs = text.tobytes(), len(s.texts)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))
                decoded = pa.array([text[at[i] : at[i + 1]].decode("utf-8", "replace") for i in range(docs)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, docs).cast(pa.int64()), lists, decoded], names=["doc_id", "ids", "decoded"])

    return run


def _mapped(docs: DataFrame, path: str, run, schema: str) -> DataFrame:
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast(compile_tokenizer(path))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run(tables, path), schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, ids, decoded), one for each row of ``docs`` (doc_id, text; other columns unread).

    ``path`` is a byte-level BPE tokenizer file, compiled on the driver and broadcast (its size is fixed by the
    vocabulary). A null or empty text has no ids and decodes to an empty text. Texts are taken whole; repeated
    rows and null doc_ids are kept; an empty table gives an empty result. The literal text of an added token is
    that token.
    """
    return _mapped(docs, path, _encoded, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """As encode(), with counts and digests in place of ids and texts: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return _mapped(docs, path, _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
