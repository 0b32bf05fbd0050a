"""Aggregate functions, for agg() and, once register() was called, for SQL: runs of lines, and the replay of a file's edits.

``collapse_ranges(line_no)`` gives the runs of neighbouring lines of a group, ``merge_ranges(ranges)`` joins such results
of parts of a group, so that a large group is collapsed in parts first. An aggregate is called once for each group; where
groups are many and small, ``line_ranges(collect_list(line_no))`` and ``union_ranges(flatten(collect_list(ranges)))`` give
the same for all groups of a batch at once. ``replay(ts, id, content, author_type, tool)``
gives the authors of a file's lines after its edits; a group's edits are held together, so files with a long history
belong to ``align.fold``, which streams them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from lineweave.operators.align import attribute

RANGES = ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()))
LINES = ArrayType(StructType().add("line_no", IntegerType()).add("author_type", StringType()).add("tool", StringType()).add("overrode", StringType()))
_RANGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_LINES = pa.list_(pa.struct([("line_no", pa.int32()), ("author_type", pa.string()), ("tool", pa.string()), ("overrode", pa.string())]))


def _as_ranges(starts: np.ndarray, ends: np.ndarray) -> pa.Scalar:
    return pa.scalar([{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], _RANGES)


@F.arrow_udf(RANGES)
def collapse_ranges(line_no: pa.Array) -> pa.Scalar:
    """The runs of neighbouring lines, in order; nulls and repeats don't count."""
    lines = np.unique(line_no.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
    cut = np.flatnonzero(np.diff(lines) > 1)
    return _as_ranges(lines[np.append(0, cut + 1)], lines[np.append(cut, len(lines) - 1)]) if len(lines) else _as_ranges(lines, lines)


@F.arrow_udf(RANGES)
def merge_ranges(ranges: pa.Array) -> pa.Scalar:
    """Runs of parts of a group as runs of the whole: those that touch or overlap become one."""
    flat = ranges.drop_null().flatten()
    starts, ends = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(order) else ends
    fresh = np.flatnonzero(np.append(True, starts[1:] > ends[:-1] + 1)) if len(order) else np.zeros(0, np.int64)
    return _as_ranges(starts[fresh], ends[np.append(fresh[1:], len(ends)) - 1]) if len(order) else _as_ranges(starts, ends)


def _ranges_by_row(rows: pa.Array, of: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of each row's parts (numbers of 32 bits), of which ``of`` names the row: as numbers that begin with it, so rows never touch."""
    base, low = of.astype(np.int64) << 34, 1 << 31
    starts, ends = base + starts + low, base + ends + low
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(order) else ends
    fresh = np.flatnonzero(np.append(True, starts[1:] > ends[:-1] + 1)) if len(order) else np.zeros(0, np.int64)
    starts, ends = starts[fresh], ends[np.append(fresh[1:], len(ends))[: len(fresh)] - 1]
    offsets = np.append(0, np.cumsum(np.bincount(starts >> 34, minlength=len(rows)))).astype(np.int32)
    line = lambda x: pa.array(((x & ((1 << 34) - 1)) - low).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([line(starts), line(ends)], ["start", "end"]))


@F.arrow_udf(RANGES)
def line_ranges(lines: pa.Array) -> pa.Array:
    """collapse_ranges() of each row's array of lines."""
    flat, of = lines.flatten(), pc.list_parent_indices(lines)
    known = flat.is_valid()
    at = flat.filter(known).to_numpy(zero_copy_only=False).astype(np.int64)
    return _ranges_by_row(lines, of.filter(known).to_numpy(zero_copy_only=False), at, at)


@F.arrow_udf(RANGES)
def union_ranges(ranges: pa.Array) -> pa.Array:
    """merge_ranges() of each row's array of runs."""
    flat = ranges.flatten()
    starts, ends = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    return _ranges_by_row(ranges, pc.list_parent_indices(ranges).to_numpy(zero_copy_only=False), starts, ends)


@F.arrow_udf(LINES)
def replay(ts: pa.Array, id_: pa.Array, content: pa.Array, author_type: pa.Array, tool: pa.Array) -> pa.Scalar:
    """The lines after all edits of a file that began empty, in order of ts and id, with their authors."""
    prior, over, before = [], [], ""
    for _, _, k in sorted(zip(ts.to_pylist(), id_.to_pylist(), range(len(ts)), strict=True)):
        text = content[k].as_py() or ""
        prior, over, _ = attribute(prior, before, text, (author_type[k].as_py() or "", tool[k].as_py() or "", "", "", ""))
        before = text
    return pa.scalar([{"line_no": n, "author_type": a[0], "tool": a[1], "overrode": o[0] if o else None} for n, (a, o) in enumerate(zip(prior, over, strict=True), 1)], _LINES)


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL."""
    for f in (collapse_ranges, merge_ranges, line_ranges, union_ranges, replay):
        spark.udf.register(f.__name__, f)
