"""How new log readers and SQL table functions are added."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from lineweave.operators.tables import union_all


class Readers:
    """Named functions from a session to edits, batch or stream; their union is the edit table."""

    def __init__(self) -> None:
        self.by_name: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def add(self, name: str, read: Callable[[SparkSession], DataFrame]) -> None:
        if name in self.by_name:
            raise ValueError(f"a reader is named {name} already")
        self.by_name[name] = read

    def edits(self, spark: SparkSession) -> DataFrame:
        return union_all(*[read(spark) for read in self.by_name.values()])


#: Lines of a result go on in tables of so many.
LINES_AT_ONCE = 50_000
_LINES = pa.schema([("key", pa.int64()), ("path", pa.string()), ("line_no", pa.int32()), ("content", pa.string())])


def _added(diff: str) -> Iterator[tuple[str | None, int, str]]:
    """path, line_no, content of the lines that a unified diff adds, over all of its files; renamed ones by their new path."""
    path, at, old, new = None, 0, 0, 0
    for line in diff.split("\n"):
        if old > 0 or new > 0:  # inside a hunk whose header said how many lines are to come
            sign = line[:1]
            if sign == "+":
                yield path, at, line[1:]
            at += sign in ("+", " ")
            new -= sign in ("+", " ")
            old -= sign in ("-", " ")
        elif line.startswith("+++ "):
            path = re.sub(r"^b/", "", line[4:].split("\t")[0])
        elif line.startswith("rename to "):
            path = line[10:]
        elif head := re.match(r"@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line):
            old, at, new = int(head[1] or 1), int(head[2]), int(head[3] or 1)


@arrow_udtf(returnType=StructType().add("key", LongType()).add("path", StringType()).add("line_no", IntegerType()).add("content", StringType()))
class AddedLines:
    """added_lines(table(diffs)): key, path, line_no and content of the lines that unified diffs add. diffs: key, diff."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        rows: list[tuple] = []
        for key, diff in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for line in _added(diff.as_py() or ""):
                rows.append((key, *line))
                if len(rows) >= LINES_AT_ONCE:
                    yield _table(rows)
                    rows = []
        if rows:
            yield _table(rows)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LINES, strict=True)], schema=_LINES)


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL."""
    spark.udtf.register("added_lines", AddedLines)
