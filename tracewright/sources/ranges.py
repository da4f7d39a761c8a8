"""Lines of text files by byte ranges and offsets (A1, A9, A15), as a data source for batches and streams.

A file is cut into ranges, each of which a task reads; a line belongs to the range in which it begins. Incremental reads begin at a
file's offset, at 0 where the file got shorter, and end with its last line feed: a torn last line is left for the next time.
A task holds a block and the longest line. Offsets are a number a file; of a stream they are in its checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RANGE_BYTES = 64 << 20
BLOCK = 1 << 20
BATCH_BYTES, BATCH_LINES = 8 << 20, 10_000
SCHEMA = "path string, range_no long, line_in_range long, offset long, next_offset long, value string, size long, mtime timestamp"
KINDS = pa.schema([("path", pa.string()), ("range_no", pa.int64()), ("line_in_range", pa.int64()), ("offset", pa.int64()), ("next_offset", pa.int64()), ("value", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", tz="UTC"))])


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def listed(root: str, suffix: str) -> list[tuple[str, int, float]]:
    """(path below ``root`` as that is written, size, time of change) of the files of a folder whose names end so, hidden ones left out."""
    fs, at = opened(root.rstrip("/"))
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
    return sorted((root.rstrip("/") + x.path[len(at) :], x.size, x.mtime.timestamp()) for x in found if x.is_file and x.base_name.endswith(suffix) and not x.base_name.startswith((".", "_")))


def last_line_end(path: str, size: int, low: int = 0) -> int:
    """The offset behind the last line feed of a file's first ``size`` bytes, ``low`` if there is none from there on."""
    fs, at = opened(path)
    with fs.open_input_file(at) as f:
        high = size
        while high > low:
            start = max(low, high - BLOCK)
            f.seek(start)
            found = f.read(high - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            high = start
    return low


@dataclass
class Range(InputPartition):
    """Lines of ``path`` that begin in [start, end), of those below ``limit`` (the end of what is read, before a torn line)."""

    path: str
    number: int
    start: int
    end: int
    first: int
    limit: int
    size: int
    mtime: float


@dataclass
class Ranges(InputPartition):
    """The ranges that one task reads, one after the other."""

    ranges: list[Range]


#: Fixed value: small ranges are put together for at least so many tasks.
LEAST_TASKS = 96


def packed(found: list[Range]) -> list[InputPartition]:
    """Ranges in tasks: a task's start costs more than reading a few kilobytes, so small ranges that follow each other share one, of up to RANGE_BYTES."""
    most = min(RANGE_BYTES, sum(r.end - r.start for r in found) // LEAST_TASKS)
    out, size = [Ranges([])], 0
    for r in found:
        if out[-1].ranges and size + r.end - r.start > most:
            out.append(Ranges([]))
            size = 0
        out[-1].ranges.append(r)
        size += r.end - r.start
    return out


def ranges(path: str, low: int, limit: int, size: int, mtime: float, bytes_: int) -> list[Range]:
    return [Range(path, k, a, min(limit, a + bytes_), low, limit, size, mtime) for k, a in enumerate(range(low, limit, bytes_))]


def lines_of(r: Range) -> Iterator[tuple[int, int, bytes]]:
    """(offset, offset behind, line) of the lines that begin in a range."""
    fs, path = opened(r.path)
    with fs.open_input_file(path) as f:
        # one byte earlier: a line feed there means that a line begins with the range
        at = r.start if r.start == r.first else r.start - 1
        f.seek(at)
        held, skip = b"", at != r.start
        while at < r.end or held or skip:
            block = f.read(min(BLOCK, r.limit - at - len(held)))
            if not block:
                break
            parts = (held + block).split(b"\n")
            held = parts.pop()
            for line in parts:
                begin, at = at, at + len(line) + 1
                if skip:
                    skip = False
                elif begin < r.end:
                    yield begin, at, line
                if at >= r.end:
                    return
        if held and not skip and at < r.end:
            # a last line without a line feed
            yield at, at + len(held), held


def batches_of(r: Range) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0

    def out() -> pa.RecordBatch:
        n = len(rows)
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array([r.path] * n), pa.array([r.number] * n, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))), pa.array([r.size] * n, pa.int64()), pa.array([int(r.mtime * 1e6)] * n, pa.timestamp("us", tz="UTC"))], schema=KINDS)

    for k, (begin, after, line) in enumerate(lines_of(r)):
        rows.append((k, begin, after, line.removesuffix(b"\r").decode(errors="replace")))
        size += len(line)
        if size > BATCH_BYTES or len(rows) >= BATCH_LINES:
            yield out()
            rows, size = [], 0
    if rows:
        yield out()


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.bytes, self.whole = int(options.get("rangebytes", RANGE_BYTES)), options.get("offsets") is None
        self.offsets: dict[str, int] = json.loads(options.get("offsets") or "{}")

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, size, mtime in listed(self.root, self.suffix):
            low = self.offsets.get(path, 0)
            low = low if low <= size else 0
            limit = size if self.whole else last_line_end(path, size, low)
            out += ranges(path, low, limit, size, mtime, self.bytes)
        return packed(out)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for r in partition.ranges:
            yield from batches_of(r)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.suffix, self.bytes = options["path"], options.get("suffix", ".jsonl"), int(options.get("rangebytes", RANGE_BYTES))
        self.ends: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        now = {}
        for path, size, _ in listed(self.root, self.suffix):
            before, end = self.ends.get(path, (-1, 0))
            if before != size:
                end = last_line_end(path, size)
                self.ends[path] = (size, end)
            now[path] = end
        return now

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, limit in end.items():
            low = start.get(path, 0)
            low = low if low <= limit else 0
            out += ranges(path, low, limit, limit, 0.0, self.bytes)
        return packed(out)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for r in partition.ranges:
            yield from batches_of(r)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class Lines(DataSource):
    """Options: path, suffix (of file names), rangebytes, and for batches offsets (JSON, by path): with them torn last lines are left."""

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(self.options)


def _options(root: str, suffix: str, range_bytes: int) -> dict[str, str]:
    return {"path": root, "suffix": suffix, "rangebytes": str(range_bytes)}


def scan(spark: SparkSession, root: str, suffix: str = ".jsonl", range_bytes: int = RANGE_BYTES, offsets: dict[str, int] | None = None) -> DataFrame:
    """A1: the lines of files below a folder; with ``offsets`` (by path) what is new since, complete lines only."""
    spark.dataSource.register(Lines)
    reader = spark.read.format("line_ranges").options(**_options(root, suffix, range_bytes))
    return (reader if offsets is None else reader.option("offsets", json.dumps(offsets))).load()


def numbered(lines: DataFrame) -> DataFrame:
    """A whole scan with line_no, from 1 in each file: a range's lines follow those of the ranges before it. Blank lines count and are dropped."""
    sizes = lines.groupBy("path", "range_no").agg((F.max("line_in_range") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = lines.join(sizes.select("path", "range_no", before.alias("before")), ["path", "range_no"])
    return rows.where(F.trim("value") != "").select("path", (F.col("before") + F.col("line_in_range") + 1).alias("line_no"), "value", "size", "mtime")


def advanced(lines: DataFrame, offsets: dict[str, int]) -> dict[str, int]:
    """The offsets after the lines of a scan with ``offsets``: one number a file comes to the driver."""
    return offsets | {r.path: r.at for r in lines.groupBy("path").agg(F.max("next_offset").alias("at")).collect()}


def stream(spark: SparkSession, root: str, suffix: str = ".jsonl", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The lines of files below a folder as they grow."""
    spark.dataSource.register(Lines)
    return spark.readStream.format("line_ranges").options(**_options(root, suffix, range_bytes)).load()
