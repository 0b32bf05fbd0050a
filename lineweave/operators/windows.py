"""Runs, neighbours and orders inside a file, a session or a log."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions.text import is_blank
from lineweave.session import dealt


def same(columns: list[str], window) -> Column:
    """Whether all of these are as in the row before; nulls are equal."""
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lag(c).over(window)) for c in columns), F.lit(True))


def collapse_ranges(lines: DataFrame, keys: list[str], identity: list[str], line: str = "line_no") -> DataFrame:
    """keys, start_line, end_line, identity: runs of neighbouring lines of one identity (gaps and islands)."""
    order = Window.partitionBy(*keys).orderBy(line, *identity)
    joined = same(identity, order) & (F.col(line) == F.lag(line).over(order) + 1)
    run = F.sum(F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).over(order)
    return lines.withColumn("_run", run).groupBy(*keys, "_run", *identity).agg(F.min(line).alias("start_line"), F.max(line).alias("end_line")).drop("_run")


def inherit_blank(lines: DataFrame, keys: list[str], within_run: bool = True) -> DataFrame:
    """Blank lines of a person take the author of the nearest other line, above first, if that is an AI.

    lines: keys, line_no, content, author_type, tool, model, gen_type. With ``within_run`` the neighbour must stand in
    the same unbroken run of lines. A column ``_blank`` says which are blank, where there is one.
    """
    blank = F.col("_blank") if "_blank" in lines.columns else is_blank(F.col("content"))
    by_line = Window.partitionBy(*keys).orderBy("line_no")
    rows = lines.withColumn("_island", F.col("line_no") - F.row_number().over(by_line)) if within_run else lines.withColumn("_island", F.lit(0))
    order = Window.partitionBy(*keys, "_island").orderBy("line_no")
    who = F.struct("author_type", "tool", "model", "gen_type")
    full = F.when(~blank, who)
    above = F.last(full, True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    below = F.last(full, True).over(Window.partitionBy(*keys, "_island").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_from", F.coalesce(above, below))
    takes = blank & (F.col("author_type") != "AI") & F.coalesce(F.col("_from.author_type") == "AI", F.lit(False))
    parts = ("author_type", "tool", "model", "gen_type")
    return rows.withColumns({c: F.when(takes, F.col(f"_from.{c}")).otherwise(F.col(c)) for c in parts}).drop("_island", "_from")


def last_turns(turns: DataFrame, session: str, order: str, most: int = 12, chars: int = 300, across: list[str] | None = None) -> DataFrame:
    """The last turns of each session, texts over ``chars`` cut and marked; ``across`` bounds their number over sessions."""
    back = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    rows = turns.withColumn("_back", back).where(F.col("_back") <= most).drop("_back")
    rows = rows.withColumn("text", F.when(F.length("text") > chars, F.concat(F.substring("text", 1, chars), F.lit("…"))).otherwise(F.col("text")))
    if across is None:
        return rows
    nth = F.row_number().over(Window.partitionBy(*across).orderBy(session, order))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth")


def carry_forward(rows: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """The last non-blank value so far."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(F.nullif(F.col(value), F.lit("")), True).over(so_far))


def pull_back(rows: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """The next non-zero value from here on; null if there is none."""
    ahead = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)  # from the end, so each row is looked at once
    return rows.withColumn(name, F.last(F.nullif(F.col(value), F.lit(0)), True).over(ahead))


def first_gets(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The value stays on the first row of a key and is null on the others."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(value, F.when(nth == 1, F.col(value)))


def first_seen(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """One row of each key: the first."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def previous_value(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """The largest smaller value of ``order`` in the key (not merely the row before, which may be equal); 0 if none."""
    before = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.max(order).over(before), F.lit(0)))


def append_index(rows: DataFrame, keys: list[str], order: str, size: str, name: str = "first_index") -> DataFrame:
    """Where each append begins: the sizes of all appends before it."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(size).over(so_far) - F.col(size))


def shares(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``pct`` of the key's total and ``width`` against its largest value, in percent with one digit."""
    by = Window.partitionBy(*keys)
    pct = lambda of: F.round(F.col(value) * 1000.0 / F.when(of == 0, 1).otherwise(of)) / 10
    return rows.withColumns({"pct": pct(F.sum(value).over(by)), "width": pct(F.max(value).over(by))})


def ranked(rows: DataFrame, keys: list[str], value: str, *ties: str, name: str = "rank") -> DataFrame:
    """Rank by value, largest first, ties in the order of ``ties``."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), *ties)))


def blocks_of_copies(lines: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """The rule for repeated blocks: where a run of ``least`` lines repeats an earlier one that holds a person's line, the
    earlier becomes AI and the later a person's. lines: keys, line_no, content, author_type. The rule walks a file in
    order, so a file is one group; files come one after the other from a sort, and one is held."""
    names = [*keys, "line_no", "content", "author_type"]
    schema = ", ".join(f"`{c}` {t}" for c, t in lines.select(*names).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, key, file, out = [], None, [], []
        for batch in batches:
            types = types or [batch.schema.field(c).type for c in names]
            for row in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if (own := row[: len(keys)]) != key:
                    out += _judged(file, least)
                    key, file = own, []
                    if len(out) >= JUDGED_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out = []
                file.append(row)
        out += _judged(file, least)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return dealt(lines.select(*names), *keys).sortWithinPartitions(*keys, "line_no").mapInArrow(run, schema)


#: Rows of a result go on in batches of so many.
JUDGED_ROWS = 20_000


def _judged(rows: list[tuple], least: int) -> list[tuple]:
    """The lines of one file, in order, with the authors that blocks_of_copies() gives them. Rows end with content and author."""
    text, who = [r[-2] for r in rows], [r[-1] for r in rows]
    seen: dict[tuple, int] = {}
    at = 0
    while at + least <= len(text):
        window = tuple(text[at : at + least])
        first = seen.get(window)
        if first is None or first + least > at:
            seen.setdefault(window, at)
            at += 1
            continue
        n = least
        while at + n < len(text) and first + n < at and text[first + n] == text[at + n]:
            n += 1
        if "Human" in who[first : first + n] and "AI" in who[first : first + n] + who[at : at + n]:
            who[first : first + n] = ["AI"] * n
            who[at : at + n] = ["Human"] * n
        at += n
    return [(*r[:-1], a) for r, a in zip(rows, who, strict=True)]
