"""A folder's files as a data source: spark.read.format("document_folder").load(folder).

The folder is listed where it is read, in tasks, by a file system of Arrow, so it may lie on any
store.  Every task lists the names and opens those of its share.  Hidden and empty files
are there; subfolders, whatever their names, and what is in them are not.

As a stream, each batch has the files whose modification time is later than those of the batch
before, so a file that is replaced comes again; files younger than ``settle`` seconds wait.

Options: ``suffixes``, a comma-separated list of those wanted, lower case, all without it;
``content``, false for a listing only; ``shards``, the number of tasks.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from auditlake.shared import open_store

LISTED = "path string, modificationTime timestamp, length long"
SHARDS = 8
#: Bytes of files that go on together.
BATCH_BYTES = 16 << 20


@dataclass
class Shard(InputPartition):
    """A share of the files, of those modified after one time and up to another, in microseconds."""

    number: int
    after: int = -1
    upto: int = 1 << 62


def suffix_of(name: str) -> str:
    """The lower-cased last suffix; dots at the start belong to the name."""
    stem, dot, last = name.lower().rpartition(".")
    return dot + last if stem.strip(".") else ""


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.shards = int(options.get("shards", SHARDS))
        self.content = options.get("content", "true").lower() != "false"
        self.suffixes = tuple(x for x in options.get("suffixes", "").split(",") if x)

    def partitions(self) -> list[Shard]:
        return [Shard(k) for k in range(self.shards)]

    def wanted(self, info) -> bool:
        return info.is_file and (not self.suffixes or suffix_of(info.base_name) in self.suffixes)

    def read(self, shard: Shard) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = open_store(self.folder)
        if store.get_file_info(base).type != fs.FileType.Directory:
            return
        rows, size = [], 0
        for info in store.get_file_info(fs.FileSelector(base)):
            if not self.wanted(info) or not shard.after < info.mtime_ns // 1000 <= shard.upto or zlib.crc32(info.base_name.encode()) % self.shards != shard.number:
                continue
            row = [f"{self.folder.rstrip('/')}/{info.base_name}", info.mtime, info.size]
            if self.content:
                with store.open_input_stream(info.path, compression=None) as f:
                    row.append(f.read())
                size += info.size
            rows.append(row)
            if size >= BATCH_BYTES:
                yield self.batch(rows)
                rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.binary()]
        names = ["path", "modificationTime", "length", "content"]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=False)], names[: len(rows[0])])


class FolderStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.reader, self.settle = FolderReader(options), float(options.get("settle", 0))

    def initialOffset(self) -> dict:
        return {"time": -1}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, base = open_store(self.reader.folder)
        found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        settled = (time.time() - self.settle) * 1e6
        return {"time": max([x.mtime_ns // 1000 for x in found if self.reader.wanted(x) and x.mtime_ns / 1000 <= settled], default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        return [Shard(k, start["time"], max(start["time"], end["time"])) for k in range(self.reader.shards)]

    def read(self, shard: Shard) -> Iterator[pa.RecordBatch]:
        return self.reader.read(shard)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_folder"

    def schema(self) -> str:
        return LISTED + (", content binary" if self.options.get("content", "true").lower() != "false" else "")

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(dict(self.options))

    def streamReader(self, schema: StructType) -> FolderStream:
        return FolderStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderSource)
