"""Records in packs of a fixed number, as a Spark data source: `packs`.

A pack is one file: its rows' keys and places first, then the records, so any record is two short reads. Columns: key, pack, index and record
(bytes). Packs are written beside their names by tasks and take them when the whole job is committed, so tasks that are lost or run twice
leave nothing half done, and a job that is broken off can be taken up: packs that are there are not written again. Filters on pack and
index are pushed down: other packs are not opened, other records not read. Files are reached through Arrow's file systems, in any store
that has one (a local path, file, hdfs, s3, gs).
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from evseq.operators.ranks import row_index

SIZE = 1024
SCHEMA = "key long, pack long, index int, record binary"
_MAGIC, _HEAD, _ENTRY = b"EVPACK1\0", struct.Struct("<8sI"), struct.Struct("<qQI")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def name(pack: int) -> str:
    return f"pack-{pack:09d}.bin"


def number(path: str) -> int | None:
    base = path.rpartition("/")[2]
    return int(base[5:-4]) if base.startswith("pack-") and base.endswith(".bin") else None


def present(path: str) -> list[int]:
    """Numbers of the packs in a folder; none if there is no folder. Names alone are listed."""
    files, at = opened(path)
    every = (number(f.path) for f in files.get_file_info(fs.FileSelector(at, allow_not_found=True)))
    return sorted(n for n in every if n is not None)


def pack_bytes(keys: list[int], records: list[bytes]) -> bytes:
    at, entries = _HEAD.size + _ENTRY.size * len(keys), []
    for key, r in zip(keys, records, strict=True):
        entries.append(_ENTRY.pack(key, at, len(r)))
        at += len(r)
    return b"".join([_HEAD.pack(_MAGIC, len(keys)), *entries, *records])


def read_pack(files: fs.FileSystem, path: str, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, int, bytes]]:
    """key, index, record of a pack, or of the wanted indices that it has: only those records are read."""
    with files.open_input_file(path) as f:
        magic, n = _HEAD.unpack(f.read_at(_HEAD.size, 0))
        if magic != _MAGIC:
            raise ValueError(f"{path} is no pack")
        entries = list(_ENTRY.iter_unpack(f.read_at(_ENTRY.size * n, _HEAD.size)))
        for i in range(n) if wanted is None else sorted(set(wanted)):
            if 0 <= i < n:
                key, at, size = entries[i]
                yield key, i, f.read_at(size, at)


class PackPartition(InputPartition):
    def __init__(self, pack: int):
        self.pack = pack


class PackReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.packs: set[int] | None = None
        self.indices: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("pack",):
                self.packs = values if self.packs is None else self.packs & values
            elif values is not None and f.attribute == ("index",):
                self.indices = values if self.indices is None else self.indices & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [PackPartition(n) for n in present(self.path) if self.packs is None or n in self.packs]

    def read(self, partition: PackPartition) -> Iterator[tuple]:
        files, at = opened(self.path)
        for key, i, record in read_pack(files, f"{at}/{name(partition.pack)}", self.indices):
            yield key, partition.pack, i, record


@dataclass
class Written(WriterCommitMessage):
    folder: str
    packs: list[int]


class PackWriter(DataSourceArrowWriter):
    """Rows come by pack and index; a pack is held by one task, so its memory is one pack."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, at = opened(self.path)
        folder, packs = f"{at}/_writing-{self.job}/{uuid.uuid4().hex}", []
        files.create_dir(folder)
        pack, keys, records = None, [], []

        def end() -> None:
            with files.open_output_stream(f"{folder}/{name(pack)}") as f:
                f.write(pack_bytes(keys, records))
            packs.append(pack)

        for batch in iterator:
            for key, p, i, r in zip(*(batch[c].to_pylist() for c in ("key", "pack", "index", "record")), strict=True):
                if p != pack:
                    if pack is not None:
                        end()
                    pack, keys, records = p, [], []
                if i != len(keys) or key is None:
                    raise ValueError(f"pack {p}: index {i} where {len(keys)} is due, or no key")
                keys.append(key)
                records.append(r or b"")
        if pack is not None:
            end()
        return Written(folder, packs)

    def commit(self, messages: list[Written | None]) -> None:
        files, at = opened(self.path)
        new = {n: m.folder for m in messages if m is not None for n in m.packs}
        if self.overwrite:
            for n in set(present(self.path)) - set(new):
                files.delete_file(f"{at}/{name(n)}")
        for n, folder in new.items():
            files.move(f"{folder}/{name(n)}", f"{at}/{name(n)}")
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        files, at = opened(self.path)
        if files.get_file_info(f"{at}/_writing-{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{at}/_writing-{self.job}")


class PackSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PackReader:
        return PackReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> PackWriter:
        return PackWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackSource)


def placed(df: DataFrame, key: str, size: int = SIZE) -> DataFrame:
    """df with pack and index: `size` rows to a pack, in the order of the key. Rows without a key are left out; ties are placed anyhow."""
    n = row_index(df.where(F.col(key).isNotNull()), [key], "_at")
    return n.withColumns({"pack": F.floor(F.col("_at") / size).cast("long"), "index": (F.col("_at") % size).cast("int")}).drop("_at")


def write(df: DataFrame, path: str, key: str, record: str, size: int = SIZE, resume: bool = False) -> None:
    """The records (bytes; null: empty) in packs of `size` in the order of the key. resume: packs that are there stay as they are, the rest is
    written; the rows must be the same as before. Otherwise packs of before are replaced. Empty table: no packs."""
    spark = df.sparkSession
    register(spark)
    d = placed(df.select(F.col(key).cast("long").alias("key"), F.col(record).alias("record")), "key", size).select("key", "pack", "index", "record")
    if resume and (done := present(path)):
        d = d.join(spark.createDataFrame([(n,) for n in done], "pack long"), "pack", "left_anti").select("key", "pack", "index", "record")
    d.repartition("pack").sortWithinPartitions("pack", "index").write.format("packs").mode("append" if resume else "overwrite").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """key, pack, index, record; filters on pack and index by equality or lists reach the files."""
    register(spark)
    return spark.read.format("packs").load(path)


def fetched(wanted: DataFrame, path: str) -> DataFrame:
    """wanted (pack, index and any other columns) with record: each pack that is asked for is opened once and only those records are read; a
    place that is not there, or a null one, has a null record. However many are wanted, they are dealt out by pack."""
    columns, schema = wanted.columns, wanted.select("*", F.lit(None).cast("binary").alias("record")).schema

    def fetch(key: tuple, table: pa.Table) -> pa.Table:
        pack, at = key[0].as_py(), table["index"].to_pylist()
        files, folder = opened(path)
        there = pack is not None and files.get_file_info(f"{folder}/{name(pack)}").type == fs.FileType.File
        got = {i: r for _, i, r in read_pack(files, f"{folder}/{name(pack)}", (i for i in at if i is not None))} if there else {}
        return table.select(columns).append_column("record", pa.array([got.get(i) for i in at], pa.binary()))

    return wanted.groupBy("pack").applyInArrow(fetch, schema)


def from_floats(df: DataFrame, column: str, record: str = "record") -> DataFrame:
    """df with an array of floats as record: four bytes each, little-endian; null: null. Null elements are NaN."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            made = [None if x is None else np.array(x, "<f4").tobytes() for x in b[column].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], [*b.schema.names, record])

    return df.mapInArrow(run, df.select("*", F.lit(None).cast("binary").alias(record)).schema)


def to_floats(df: DataFrame, record: str = "record", column: str = "vector") -> DataFrame:
    """The way back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            made = [None if x is None else np.frombuffer(x, "<f4").tolist() for x in b[record].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.float32()))], [*b.schema.names, column])

    return df.mapInArrow(run, df.select("*", F.lit(None).cast("array<float>").alias(column)).schema)
