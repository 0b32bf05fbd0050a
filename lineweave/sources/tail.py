"""Line logs as a data source of Spark, ``line_log``, for batches and streams.

A file is split into byte ranges that end at line ends, so many tasks read one large log; ``pos`` is the byte at which a
line begins, which orders the lines of a file. A stream keeps for each file the byte up to which it was read: only whole
lines count, so a line that is still being written comes with a later batch, once; a file that has become shorter was
written anew and is read from its begin. Files are reached by pyarrow (local and shared folders, HDFS, S3); where only
Spark can open them, batches can use ``lines_by_spark``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SPLIT_BYTES = 32 << 20
#: Lines go on in batches of about so many bytes; the end of a file is searched for its last line end in blocks of so many.
BATCH_BYTES, BLOCK = 4 << 20, 1 << 16
#: Ranges of small files go to a task together; opening a file counts as reading so many bytes.
OPEN_BYTES = 1 << 16
LINES = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("line", pa.string())])


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> dict[str, int]:
    """The log files at a path, itself one or a folder of some at any depth, with their sizes. Names with _ or . in front aren't logs."""
    fs, at = opened(path)
    info = fs.get_file_info(at)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True)) if info.type == pafs.FileType.Directory else []
    hidden = lambda x: any(part[:1] in ("_", ".") for part in x.path[len(at) :].split("/") if part)
    return {x.path: x.size for x in found if x.type == pafs.FileType.File and not hidden(x)}


def whole_lines(fs: pafs.FileSystem, file: str, size: int, known: int = 0) -> int:
    """The byte after the last line end among the first ``size``; ``known``, a line's begin, if there is none after it."""
    with fs.open_input_file(file) as f:
        end = size
        while end > known:
            begin = max(known, end - BLOCK)
            at = f.read_at(end - begin, begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return known


class Range(InputPartition):
    """Lines of a file that begin at or after ``begin`` and before ``end``; whole ones only, if the file may still grow."""

    def __init__(self, file: str, begin: int, end: int):
        super().__init__((file, begin, end))


class Ranges(InputPartition):
    """(file, begin, end) of ranges that one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        super().__init__(ranges)


def ranges(file: str, begin: int, end: int, split: int) -> list[Range]:
    return [Range(file, at, min(end, at + split)) for at in range(begin, end, split)]


def packed(each: list[Range], split: int) -> list[Ranges]:
    """Ranges in their order, as many to a task as make ``split`` bytes."""
    out, size = [], split
    for file, begin, end in (r.value for r in each):
        size += end - begin + OPEN_BYTES
        if size > split or not out:
            out.append([])
            size = end - begin + OPEN_BYTES
        out[-1].append((file, begin, end))
    return [Ranges(x) for x in out or [[]]]


def lines_in(fs: pafs.FileSystem, file: str, begin: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """pos and line of the lines that begin in [begin, end) of a file that is read up to ``size``."""
    with fs.open_input_file(file) as f:
        at = max(0, begin - 1)  # a line that began before is the range's before
        skip, pos, held = begin > 0, at, []
        while True:
            block = f.read_at(min(BATCH_BYTES, size - at), at) if at < size else b""
            at += len(block)
            if block and b"\n" not in block:
                if skip and at >= end:
                    return  # the line that goes through this range ends behind it
                held += [] if skip else [block]
                pos += len(block) if skip else 0
                continue
            parts = b"".join([*held, block]).split(b"\n")
            for line in parts[:-1]:
                if not skip:
                    yield pos, line
                skip, pos = False, pos + len(line) + 1
                if pos >= end:
                    return
            held = [parts[-1]]
            if not block:
                if parts[-1] and not skip:  # the last line has no end
                    yield pos, parts[-1]
                return


def _batches(path: str, where: Ranges) -> Iterator[pa.RecordBatch]:
    """A range's last line reads on to the end that its file has now; a stream's ends at a line end."""
    fs, _ = opened(path)
    held, bytes_ = [], 0
    for file, begin, end in where.value:
        for pos, line in lines_in(fs, file, begin, end, fs.get_file_info(file).size):
            held.append((file, pos, line.decode("utf-8", "replace")))
            bytes_ += len(line) + 32
            if bytes_ >= BATCH_BYTES:
                yield _batch(held)
                held, bytes_ = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), LINES, strict=True)], schema=LINES)


class _Batch(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Ranges]:
        return packed([r for file, size in sorted(files_of(self.path).items()) for r in ranges(file, 0, size, self.split)], self.split)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from _batches(self.path, partition)


class _Tail(DataSourceStreamReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, _ = opened(self.path)
        return {file: whole_lines(fs, file, size) for file, size in sorted(files_of(self.path).items())}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        out = []
        for file, upto in end.items():
            since = start.get(file, 0)
            out += ranges(file, since if since <= upto else 0, upto, self.split)
        return packed(out, self.split)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from _batches(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class LineLog(DataSource):
    """Options: path, a file or a folder; splitbytes, the most that a task reads."""

    @classmethod
    def name(cls) -> str:
        return "line_log"

    def schema(self) -> str:
        return "file string, pos long, line string"

    def _asked(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES))

    def reader(self, schema: object) -> _Batch:
        return _Batch(*self._asked())

    def streamReader(self, schema: object) -> _Tail:
        return _Tail(*self._asked())


@contextmanager
def _by_value():
    """Workers that plan a source don't search the driver's module path, so its classes go to them by value."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])


def register(spark: SparkSession) -> None:
    with _by_value():
        spark.dataSource.register(LineLog)


def read_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file, pos, line of the lines of log files, without empty ones; the last one also if it has no end."""
    register(spark)
    return spark.read.format("line_log").option("splitbytes", split_bytes).load(path).where("line <> ''")


def tailed(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A stream of file, pos, line of the whole lines that log files gain."""
    register(spark)
    return spark.readStream.format("line_log").option("splitbytes", split_bytes).load(path).where("line <> ''")


def lines_by_spark(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, line by Spark's own text reader, for stores that only it reaches: it splits files too, and pos has the block
    and the number of the line in it, which order a file's lines but don't count bytes."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    return rows.select("file", (F.shiftleft("_block", 20) + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("pos"), "line").where("line <> ''")
