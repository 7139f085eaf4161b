"""A data source of framed records: each is its length, a checksum of that, its bytes and a checksum of these.

A record is a row as a JSON object. Files may hold any number of records and
are read one a task. ``max_entries`` bounds the records over all files: only as
many frames are counted beforehand as it asks for.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, FractionalType, IntegralType, StringType, StructType

from ledgerlens.session import ship

NAME = "framed_records"
#: Length and its checksum before a record, checksum after it; all little-endian.
HEAD, TAIL = struct.Struct("<QI"), struct.Struct("<I")
#: Records of a batch.
BATCH = 4096


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def files_of(path: str) -> list[str]:
    """The record files at a URI, in order: itself, or those below it whose names begin with neither _ nor a dot."""
    from pyarrow import fs

    store, name = _store(path)
    info = store.get_file_info(name)
    if info.type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(name, recursive=True))
    prefix = path.rstrip("/")
    return sorted(prefix + f.path[len(name.rstrip("/")) :] for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_.")


def _exactly(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise ValueError("a record is cut off")
    return data


def frames(path: str, most: int | None = None, skip: bool = False) -> Iterator[bytes | int]:
    """The bytes of a file's records, at most ``most``; with ``skip`` their lengths, without reading them."""
    store, name = _store(path)
    with store.open_input_file(name) as f:
        size, seen = f.size(), 0
        while f.tell() < size and (most is None or seen < most):
            head = _exactly(f, HEAD.size)
            length, check = HEAD.unpack(head)
            if zlib.crc32(head[:8]) != check:
                raise ValueError(f"{path}: a length doesn't have its checksum")
            if skip:
                f.seek(f.tell() + length + TAIL.size)
                yield length
            else:
                data = _exactly(f, length)
                if zlib.crc32(data) != TAIL.unpack(_exactly(f, TAIL.size))[0]:
                    raise ValueError(f"{path}: a record doesn't have its checksum")
                yield data
            seen += 1


def framed(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return length + TAIL.pack(zlib.crc32(length)) + data + TAIL.pack(zlib.crc32(data))


def _checked(value, field):
    """The value, if it is of its column's type; a column never changes its type from one record to the next."""
    kind = field.dataType
    if value is None:
        return None
    if isinstance(kind, BooleanType):
        fine = isinstance(value, bool)
    elif isinstance(kind, IntegralType):
        fine = isinstance(value, int) and not isinstance(value, bool)
    elif isinstance(kind, FractionalType):
        fine = isinstance(value, (int, float)) and not isinstance(value, bool)
    elif isinstance(kind, StringType):
        fine = isinstance(value, str)
    else:
        raise ValueError(f"column {field.name}: records hold numbers, texts and booleans")
    if not fine:
        raise ValueError(f"column {field.name} is {kind.simpleString()}, but a record has {type(value).__name__}")
    return float(value) if isinstance(kind, FractionalType) else value


@dataclass
class Part(InputPartition):
    path: str
    most: int | None


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.path = schema, options["path"]
        self.most = int(options["max_entries"]) if "max_entries" in options else None

    def partitions(self) -> list[Part]:
        files = files_of(self.path)
        if self.most is None:
            return [Part(f, None) for f in files]
        out, left = [], self.most
        for f in files:
            if left <= 0:
                break
            n = sum(1 for _ in frames(f, left, skip=True))
            out.append(Part(f, n))
            left -= n
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows = to_arrow_schema(self.columns), []
        for data in frames(partition.path, partition.most):
            row = json.loads(data)
            rows.append({f.name: _checked(row.get(f.name), f) for f in self.columns})
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class Written(WriterCommitMessage):
    path: str
    final: str


class Writer(DataSourceArrowWriter):
    """One file a task under a name that readers skip, renamed when the job ends, so that failed attempts leave nothing to read."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        name = f"part-{uuid.uuid4().hex}.records"
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/_{name}") as out:
            for batch in batches:
                for row in batch.to_pylist():
                    out.write(framed(json.dumps(row, ensure_ascii=False, sort_keys=True).encode()))
        return Written(f"{folder}/_{name}", f"{folder}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        if self.overwrite:
            for old in files_of(self.path):
                store.delete_file(_store(old)[1])
        for m in messages:
            if m:
                store.move(m.path, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m:
                store.delete_file(m.path)


class RecordSource(DataSource):
    """``spark.read.format("framed_records").schema(...).load(path)``, with option ``max_entries``; path is a URI that all tasks reach."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError("give the schema: records don't tell it")

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the source known to the session, and its code to the executors."""
    ship(spark)
    spark.dataSource.register(RecordSource)


def write_framed(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    register(df.sparkSession)
    df.write.format(NAME).mode(mode).save(path)


def read_framed(spark: SparkSession, path: str, schema: StructType | str, max_entries: int | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format(NAME).schema(schema)
    return (reader if max_entries is None else reader.option("max_entries", max_entries)).load(path)
