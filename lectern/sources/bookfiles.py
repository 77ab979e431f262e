"""FictionBook files as a data source: ``spark.read.format("fb2")``, batch and stream.

Partitions are packed by size, so that a task reads some ``PARTITION_BYTES`` however small its
files are. Only the columns of the schema are built: without ``blocks`` and ``reject`` the
bodies are not walked. Files are listed and read through pyarrow's file systems, so a path is
local, as on shared storage, or a URI that these know.

As a stream, a file is taken once it is ``SETTLE`` seconds old, by its time of change; the
offset is the time up to which files have been taken.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, InputPartition,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lectern.sources.fictionbook import MAX_FILE_BYTES, OUTPUT_BYTES, SCHEMA, read_book

PARTITION_BYTES = 128 << 20
#: What opening a file counts for in a partition. Starting a task takes as long as reading some
#: hundred small books, so that it has a thousand of them.
OPEN_BYTES = 128 << 10
SETTLE = 2


@dataclass
class Files(InputPartition):
    """Paths and sizes of the files that one task reads."""

    files: list[tuple[str, int]]


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> list[fs.FileInfo]:
    """The FictionBook files below a folder, by path."""
    system, folder = file_system(path)
    found = system.get_file_info(fs.FileSelector(folder, recursive=True))
    return sorted((x for x in found if x.is_file and x.extension == "fb2"), key=lambda x: x.path)


def packed(files: list[fs.FileInfo], most: int) -> list[Files]:
    out, size = [], most
    for file in files:
        cost = OPEN_BYTES + min(file.size, MAX_FILE_BYTES)
        if size + cost > most:
            out.append(Files([]))
            size = 0
        out[-1].files.append((file.path, file.size))
        size += cost
    return out


def read_files(path: str, part: Files, schema: StructType) -> Iterator[pa.RecordBatch]:
    """Batches of the wanted columns; files over the size limit are not opened."""
    system, _ = file_system(path)
    shape = to_arrow_schema(schema)
    walk = bool({"blocks", "reject"} & set(schema.names))
    rows, held = [], 0
    for name, size in part.files:
        if size > MAX_FILE_BYTES:
            book = {"reject": "too_large"}
        else:
            with system.open_input_stream(name) as file:
                book = read_book(file.read(), walk)
            held += size
        book |= {"path": name, "length": size}
        rows.append({column: book.get(column) for column in schema.names})
        if held > OUTPUT_BYTES:
            yield pa.RecordBatch.from_pylist(rows, schema=shape)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=shape)


class BookReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, most: int) -> None:
        self.path, self.schema, self.most = path, schema, most

    def partitions(self) -> list[Files]:
        return packed(listed(self.path), self.most)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return read_files(self.path, partition, self.schema)


class BookStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType, most: int) -> None:
        self.path, self.schema, self.most = path, schema, most

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        settled = time.time_ns() - SETTLE * 10 ** 9
        times = [x.mtime_ns for x in listed(self.path) if x.mtime_ns <= settled]
        return {"until": max(times, default=0)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        new = [x for x in listed(self.path) if start["until"] < x.mtime_ns <= end["until"]]
        return packed(new, self.most)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return read_files(self.path, partition, self.schema)


class BookSource(DataSource):
    """Options: ``path`` (that of ``load``), ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "fb2"

    def schema(self) -> str:
        return f"path string, length long, {SCHEMA}"

    def _arguments(self, schema: StructType) -> tuple:
        return (self.options["path"], schema,
                int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def reader(self, schema: StructType) -> BookReader:
        return BookReader(*self._arguments(schema))

    def streamReader(self, schema: StructType) -> BookStreamReader:
        return BookStreamReader(*self._arguments(schema))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BookSource)
