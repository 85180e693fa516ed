"""Byte ranges of files as a data source: heads, parts and digests of files of any size.

A partition is a list of (file, begin, length); a task reads these bytes and no others, and never holds more than a part. Stores
are those that Arrow can open by their address (local and shared folders, object stores).
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length bigint, start bigint, size bigint, content binary, sha256 string"
#: Bytes of a part, of a step when a whole file is digested, and of a task's share; files whose heads one task reads.
PART, STEP, SHARE, HEADS = 64 << 20, 8 << 20, 128 << 20, 1_000


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def can_open(path: str) -> bool:
    try:
        store, at = store_of(path)
        return store.get_file_info(at).type != fs.FileType.NotFound
    except (OSError, pa.ArrowException, ImportError):
        return False


def can_write(path: str) -> bool:
    """Whether Arrow knows the store; the path need not exist."""
    try:
        return bool(store_of(path))
    except (OSError, pa.ArrowException, ImportError):
        return False


class Ranges(InputPartition):
    def __init__(self, files: list[tuple[str, int, int, int]]):
        super().__init__(None)
        self.files = files


class RangeReader(DataSourceReader):
    """``mode``: head (the first ``part`` bytes), parts (digests of all parts), or whole (a digest of all bytes in order)."""

    def __init__(self, options: dict):
        self.path, self.pattern, self.mode = options["path"], options.get("pattern", "*"), options["mode"]
        self.part = int(options.get("part", PART))

    def files(self) -> list[tuple[str, int]]:
        store, at = store_of(self.path)
        found = store.get_file_info(fs.FileSelector(at, recursive=True)) if store.get_file_info(at).type == fs.FileType.Directory else [store.get_file_info(at)]
        hidden = lambda p: any(x[:1] in "_." and "=" not in x for x in p[len(at) :].split("/") if x)
        return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f.path) and fnmatch.fnmatch(f.base_name, self.pattern))

    def partitions(self) -> list[Ranges]:
        ranges = []
        for path, size in self.files():
            step = self.part if self.mode == "parts" else max(size, 1)
            ends = [(0, min(size, self.part))] if self.mode == "head" else [(b, min(step, size - b)) for b in range(0, max(size, 1), step)]
            ranges += [(path, size, b, n) for b, n in ends]
        out, held, n = [], [], 0
        for r in ranges:
            held.append(r)
            n += r[3] + SHARE // HEADS
            if n >= SHARE:
                out.append(Ranges(held))
                held, n = [], 0
        return [*out, Ranges(held)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        for path, length, start, size in partition.files:
            content, digest = None, hashlib.sha256()
            with store.open_input_file(path) as f:
                if self.mode == "head":
                    content, digest = f.read_at(size, 0), None
                else:
                    for at in range(start, start + size, STEP):
                        digest.update(f.read_at(min(STEP, start + size - at), at))
            row = [path, length, start, size, content, digest and digest.hexdigest()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["path", "length", "start", "size", "content", "sha256"])


class ByteRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(dict(self.options))


def read_ranges(spark: SparkSession, path: str, mode: str, pattern: str = "*", part: int = PART) -> DataFrame:
    spark.dataSource.register(ByteRanges)
    return spark.read.format("byte_ranges").options(path=path, mode=mode, pattern=pattern, part=str(part)).load()


def heads(spark: SparkSession, path: str, pattern: str = "*", head: int = 1024) -> DataFrame:
    """(path, content) of the first ``head`` bytes of each file."""
    return read_ranges(spark, path, "head", pattern, head).select("path", "content")


def whole_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content_sha256) of files of any size; a task goes through a file in steps."""
    return read_ranges(spark, path, "whole", pattern).select("path", "length", F.col("sha256").alias("content_sha256"))


def part_digests(spark: SparkSession, path: str, pattern: str = "*", part: int = PART) -> DataFrame:
    """(path, length, parts, parts_sha256): many tasks for a file; the digest is that of the hex digests of all its parts, in order."""
    got = read_ranges(spark, path, "parts", pattern, part)
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "sha256"))), lambda p: p["sha256"]), "")
    return got.groupBy("path", "length").agg(F.count(F.lit(1)).alias("parts"), F.sha2(ordered, 256).alias("parts_sha256"))
