"""A folder with a file for each key as a Spark data source: partitioned scan, and a writer that commits by manifest.

``spark.read.format("keyed_files").load(folder)`` gives the columns of the files and the key from their names;
``df.write.format("keyed_files").option("key", "code").mode("append").save(folder)`` writes them. Names are
``<key>.parquet``, or ``<key>~<anything>.parquet`` where a key has several files; names that start with an underscore
are skipped. Tasks write files of new names, which nobody sees until the driver replaces the one manifest that lists
what belongs to the table, so lost tasks and aborted jobs leave no rows behind. Folders without a manifest are listed.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

MANIFEST = "_manifest.json"
#: Names that the writer gives; without a manifest their job has not ended.
OURS = re.compile(r"~[0-9a-f]{32}-\d+\.parquet$")
#: Bytes of files read by one task, and rows of a row group.
SPLIT, ROWS = 64 << 20, 1 << 17


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder) if ":/" in folder else (pyarrow.fs.LocalFileSystem(), folder)


def key_of(name: str) -> str:
    """Key of a file name without its folder."""
    return unquote(name.removesuffix(".parquet").split("~")[0])


def _listed(fs: pyarrow.fs.FileSystem, root: str) -> list[str] | None:
    """Names in the manifest, or None where there is none."""
    path = f"{root}/{MANIFEST}"
    if fs.get_file_info(path).type != pyarrow.fs.FileType.File:
        return None
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


def _files(folder: str) -> list[tuple[str, int]]:
    """(name, bytes) of the table's files, by name."""
    fs, root = _open(folder)
    names = _listed(fs, root)
    found = {i.base_name: i.size for i in fs.get_file_info(pyarrow.fs.FileSelector(root)) if i.type == pyarrow.fs.FileType.File}
    if names is None:
        names = [n for n in found if n.endswith(".parquet") and not n.startswith("_") and not OURS.search(n)]
    return [(n, found[n]) for n in sorted(names)]


@dataclass
class Files(InputPartition):
    names: list[str]


class KeyedReader(DataSourceReader):
    def __init__(self, folder: str, key: str, keys: list[str] | None, schema: StructType, split: int):
        self.folder, self.key, self.keys, self.split = folder, key, keys, split
        self.columns = schema.names

    def partitions(self) -> list[InputPartition]:
        """Files of the wanted keys, packed to about ``split`` bytes a task."""
        wanted = None if self.keys is None else set(self.keys)
        packs: list[list[str]] = [[]]
        held = 0
        for name, size in _files(self.folder):
            if wanted is not None and key_of(name) not in wanted:
                continue
            if packs[-1] and held + size > self.split:
                packs.append([])
                held = 0
            packs[-1].append(name)
            held += size
        return [Files(p) for p in packs if p] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, root = _open(self.folder)
        for name in partition.names:
            file = pq.ParquetFile(f"{root}/{name}", filesystem=fs)
            for batch in file.iter_batches(columns=[c for c in self.columns if c != self.key]):
                key = pa.array([key_of(name)]).take(pa.array([0] * batch.num_rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([key if c == self.key else batch.column(c) for c in self.columns], names=self.columns)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class KeyedWriter(DataSourceArrowWriter):
    """One file is open in a task, so rows should be dealt and sorted by key; a hot key may be dealt over several tasks.

    A key that comes again after others gets one more file.
    """

    def __init__(self, folder: str, key: str, overwrite: bool):
        self.folder, self.key, self.overwrite = folder, key, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _open(self.folder)
        fs.create_dir(root, recursive=True)
        task = uuid.uuid4().hex
        current, writer, names = None, None, []
        try:
            for batch in iterator:
                column = batch.column(self.key)
                rest = batch.drop_columns([self.key])
                for key in pc.unique(column).to_pylist():
                    if key is None or not str(key) or str(key).startswith("_"):
                        raise ValueError(f"no file can be named after the key {key!r}")
                    if writer is None or key != current:
                        if writer is not None:
                            writer.close()
                        names.append(f"{quote(str(key), safe='').replace('~', '%7E')}~{task}-{len(names)}.parquet")
                        current, writer = key, pq.ParquetWriter(f"{root}/{names[-1]}", rest.schema, filesystem=fs, compression="zstd")
                    writer.write_batch(rest.filter(pc.equal(column, key)), row_group_size=ROWS)
        finally:
            if writer is not None:
                writer.close()
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open(self.folder)
        fs.create_dir(root, recursive=True)
        old = [name for name, _ in _files(self.folder)]
        new = [name for m in messages if m for name in m.names]
        fresh = f"{root}/_{uuid.uuid4().hex}.json"
        with fs.open_output_stream(fresh) as f:
            f.write(json.dumps(new if self.overwrite else old + new).encode())
        fs.move(fresh, f"{root}/{MANIFEST}")
        if self.overwrite:
            for name in old:
                fs.delete_file(f"{root}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open(self.folder)
        for name in [name for m in messages if m for name in m.names]:
            fs.delete_file(f"{root}/{name}")


class KeyedFiles(DataSource):
    """Options: key (column of the file names, default code), keys (JSON list of those to read), split (bytes a task)."""

    @classmethod
    def name(cls) -> str:
        return "keyed_files"

    @property
    def key(self) -> str:
        return self.options.get("key", "code")

    def schema(self) -> StructType:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no files in {self.options['path']}; give a schema")
        fs, root = _open(self.options["path"])
        schema = from_arrow_schema(pq.read_schema(f"{root}/{files[0][0]}", filesystem=fs))
        return StructType([*StructType().add(self.key, "string").fields, *schema.fields])

    def reader(self, schema: StructType) -> DataSourceReader:
        keys = json.loads(self.options["keys"]) if "keys" in self.options else None
        return KeyedReader(self.options["path"], self.key, keys, schema, int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return KeyedWriter(self.options["path"], self.key, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(KeyedFiles)
