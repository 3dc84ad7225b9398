"""Token ids in files of independent zstandard frames with a trailing seek table.

File, from its start:

* data frames, each a whole zstandard frame with its own checksum, holding the ids of some whole documents one
  after the other as little-endian unsigned 32-bit integers;
* one skippable frame (magic 0x184D2A50) with the document index, itself compressed: three arrays of as many
  entries as documents, doc_id (64 bits), count of ids (64 bits), 1 if the doc_id is null (8 bits);
* the seek table of the public seekable format, a skippable frame (magic 0x184D2A5E): for each frame before it
  its compressed size, decompressed size (0 for the index) and the low 32 bits of the XXH64 of its content, then
  the number of frames, a descriptor (0x80: with checksums) and the magic 0x8F92EAB1.

A reader takes the end of the file, then the index, then only the frames that hold the documents asked for. Files
are numbered in ascending doc_id order.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import chunks
from .textarrays import slices

#: Bytes of ids after which a frame ends; a document is never split.
FRAME_BYTES = 1 << 20
#: Words that the library encodes as one text.
JOINED = 128
#: Fixed values of the public zstandard frame and seekable formats.
INDEX_MAGIC, TABLE_MAGIC, SEEK_MAGIC, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


class Writer:
    """One file; documents come in the order in which they are to be read. Memory holds one frame and the index."""

    def __init__(self, sink, level: int = 3):
        self.sink, self.codec = sink, zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.part: list[bytes] = []
        self.size = 0
        self.ids, self.counts, self.nulls = [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id or 0), self.counts.append(len(ids) // 4), self.nulls.append(doc_id is None)
        self.part.append(ids)
        self.size += len(ids)
        if self.size >= FRAME_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.part:
            raw = b"".join(self.part)
            packed = self.codec.compress(raw)
            self.sink.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.part, self.size = [], 0

    def close(self) -> None:
        self._flush()
        raw = np.array(self.ids, "<i8").tobytes() + np.array(self.counts, "<u8").tobytes() + np.array(self.nulls, np.uint8).tobytes()
        packed = self.codec.compress(raw)
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(packed)) + packed)
        self.frames.append((len(packed) + 8, 0, xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.sink.write(struct.pack("<II", TABLE_MAGIC, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), WITH_CHECKSUMS, SEEK_MAGIC))


class Reader:
    """Random access to one file."""

    def __init__(self, path: str):
        fs, at = _open(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError(f"{path} has no seek table")
        table = self.file.read_at(12 * count, size - 9 - 12 * count)
        self.frames = np.frombuffer(table, "<u4").reshape(-1, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        raw = self._frame(count - 1, 8)
        n = len(raw) // 17
        self.doc_ids, self.counts = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n)
        self.nulls = np.frombuffer(raw, np.uint8, n, 16 * n).astype(bool)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        ends = np.cumsum(self.frames[:-1, 1]) // 4
        #: The frame of each document: the one in which its ids end (an empty document has no ids to read).
        self.frame = np.minimum(np.searchsorted(ends, self.first[1:], "left"), max(count - 2, 0))
        self.begin = np.concatenate([[0], ends])

    def _frame(self, k: int, skip: int = 0) -> bytes:
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(int(self.frames[k, 0]) - skip, int(self.at[k]) + skip))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(position in the file, ids as bytes) of all documents or of those with a wanted doc_id, in order."""
        chosen = np.arange(len(self.doc_ids)) if wanted is None else np.flatnonzero(np.isin(self.doc_ids, np.array([*wanted], np.int64)) & ~self.nulls)
        now, raw = -1, b""
        for i in chosen.tolist():
            if self.counts[i] and now != self.frame[i]:
                now = int(self.frame[i])
                raw = self._frame(now)
            at = 4 * int(self.first[i] - self.begin[now]) if self.counts[i] else 0
            yield i, raw[at : at + 4 * int(self.counts[i])]


_WORKER: dict[str, chunks.Ids] = {}


def _library(spec: str):
    """Encodes distinct words by the tokenizers library, many at a time with a special token between them.

    The library cuts a text at such a token before it does anything else, so each word is encoded by itself.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    plain = [t for t in json.loads(spec)["added_tokens"] if t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])]
    mark, mark_id = (plain[0]["content"], plain[0]["id"]) if plain else ("", -1)

    def singly(words: list[str]) -> tuple[np.ndarray, list[int]]:
        found = [x.ids for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([*chain.from_iterable(found)], np.uint32), [*map(len, found)]

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode("utf-8", "replace") for w in words]
        ids, counts = [np.zeros(0, np.uint32)], []
        for i in range(0, len(texts), 4096):
            some = texts[i : i + 4096]
            groups = [some[k : k + JOINED] for k in range(0, len(some), JOINED)] if mark else []
            found = [np.array(x.ids, np.uint32) for x in tokenizer.encode_batch_fast([mark.join(g) for g in groups], add_special_tokens=False)] if mark else []
            ends = [np.flatnonzero(x == mark_id) for x in found]
            if not mark or any(len(e) != len(g) - 1 for e, g in zip(ends, groups, strict=True)):  # a word holds the mark
                flat, n = singly(some)
                ids.append(flat), counts.extend(n)
                continue
            for x, e in zip(found, ends, strict=True):
                ids.append(np.delete(x, e))
                counts.extend((np.diff(np.concatenate([[-1], e, [len(x)]])) - 1).tolist())
        return np.concatenate(ids), np.array(counts, np.int64)

    return encode


def _literal(spec: str) -> list[bytes] | None:
    """The strings that a lower-casing tokenizer leaves as they are; None for others."""
    rules = json.loads(spec)
    steps = (rules["normalizer"] or {}).get("normalizers", [rules["normalizer"] or {}])
    return [t["content"].encode() for t in rules["added_tokens"]] if any(x.get("type") == "Lowercase" for x in steps) else None


def _write(spec, folder: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if "ids" not in _WORKER:
            _WORKER["ids"] = chunks.Ids(_library(spec.value), _literal(spec.value))
        ids_of = _WORKER["ids"]
        part = TaskContext.get().partitionId()
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        temp, final = f"{root}/tmp-{uuid.uuid4().hex}", f"{root}/part-{part:06d}.ids"
        docs = tokens = 0
        with fs.open_output_stream(temp) as sink:
            writer = Writer(sink)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for s in slices(batch.column(1)):
                    starts, ends, offsets = chunks.words(s)
                    flat, n = ids_of.of(s, starts, ends)
                    first = np.concatenate([[0], np.cumsum(n)])[offsets]
                    end = np.full(len(s.texts), end_id, np.uint32)
                    little = np.insert(flat, first[1:], end).astype("<u4").tobytes()
                    at = 4 * (first + np.arange(len(first)))
                    for i in range(len(s.texts)):
                        writer.add(ids[s.first + i], little[at[i] : at[i + 1]])
                    docs, tokens = docs + len(s.texts), tokens + (at[-1] // 4)
            writer.close()
        if docs:
            fs.move(temp, final)  # a repeated task writes the same bytes again
        else:
            fs.delete_file(temp)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{folder}/part-{part:06d}.ids"]), pa.array([docs]), pa.array([int(tokens)])], names=["part", "path", "docs", "tokens"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int) -> DataFrame:
    """Encode ``docs`` (doc_id, text; other columns unread) into files below ``folder``; returns their manifest.

    ``tokenizer`` is a file of the tokenizers library that drops white space, so that a text has the ids of its
    words; truncation and padding are off. ``end_id`` follows every document. ``folder`` must be reachable from
    all executors, with a scheme that pyarrow opens. Null texts count as empty and hold the end id alone; null
    doc_ids come first; equal doc_ids stay together in the order of their texts. An empty table has no files.

    Manifest rows: part, path, docs, tokens, start (ids in all files before).
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    found = rows.mapInArrow(_write(spec, folder, end_id), "part int, path string, docs long, tokens long").where("docs > 0")
    manifest = f"{folder}-manifest"
    found.write.parquet(manifest)
    files = spark.read.schema(found.schema).parquet(manifest)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch], wanted: list[int] | None, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            reader = Reader(path)
            rows: list[tuple] = []
            size = 0
            for i, raw in reader.documents(wanted):
                doc = None if reader.nulls[i] else int(reader.doc_ids[i])
                rows.append((doc, start + int(reader.first[i]), len(raw) // 4, zlib.crc32(raw) if digest else np.frombuffer(raw, "<u4").astype(np.int32)))
                size += 64 if digest else len(raw)
                if size > FRAME_BYTES:
                    yield _batch(rows, digest)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, digest)


def _batch(rows: list[tuple], digest: bool) -> pa.RecordBatch:
    a, b, c, d = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64() if digest else pa.list_(pa.int32()))], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])


def read_tokens(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of all documents, or of those in the short list ``wanted`` of doc_ids."""
    return _dealt(manifest).mapInArrow(lambda b: _read(b, wanted, False), "doc_id long, start long, n_tokens long, ids array<int>")


def read_digests(manifest: DataFrame) -> DataFrame:
    """As read_tokens(), with ids_crc32 (of the ids as little-endian unsigned 32-bit integers) in place of ids."""
    return _dealt(manifest).mapInArrow(lambda b: _read(b, None, True), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _dealt(manifest: DataFrame) -> DataFrame:
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("part", "path", "start").repartitionByRange(parts, "part")
