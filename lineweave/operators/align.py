"""Line alignment and the fold that carries authors through a file's edits.

The alignment is a longest common subsequence of lines without white space; where ties leave a choice, the old line is
passed over first. It runs per file and edit inside ``applyInPandas``, so Spark partitions the work. Of the table only
every sqrt(n)-th row is kept and the rows between are computed again while walking it, so a file of 10,000 lines takes
some megabytes; there is no size at which another method takes over.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.session import dealt

AUTHOR = ("author_type", "tool", "model", "gen_type", "session")
HUMAN = ("Human", "", "", "", "")


def lines_of(text: str | None) -> list[str]:
    if not text:
        return []
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    return [x[:-1] if x.endswith("\r") else x for x in lines]


def stripped(line: str) -> str:
    return "".join(line.split())


def align(old: list[str], new: list[str]) -> list[int]:
    """For each new line the old line it continues, or -1."""
    n, m, head = len(old), len(new), 0
    matched = [-1] * m
    while head < min(n, m) and old[head] == new[head]:
        matched[head] = head
        head += 1
    for i, j in common_subsequence(old[head:], new[head:]):
        matched[head + j] = head + i
    return matched


def common_subsequence(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence; of equally good ways the one that passes over old lines first."""
    shared = set(old) & set(new)
    if not shared:
        return []
    names = {x: k for k, x in enumerate(dict.fromkeys(new))}
    p, q = [names[x] if x in shared else -1 for x in old], np.array([names[x] for x in new])
    n, m, step = len(p), len(q), max(32, isqrt(len(p)))

    def row_before(row: np.ndarray, i: int) -> np.ndarray:
        """The row of old line i from that of line i + 1; the same row if no new line equals line i."""
        if p[i] < 0:
            return row
        best = np.where(q == p[i], row[1:] + 1, row[:-1])
        return np.append(np.maximum.accumulate(best[::-1])[::-1], np.int32(0))

    row = np.zeros(m + 1, np.int32)
    kept = {n: row}
    for i in range(n - 1, -1, -1):
        row = row_before(row, i)
        if i % step == 0:
            kept[i] = row
    pairs, i, j = [], 0, 0
    while i < n and j < m:
        first, end = i - i % step, min(n, i - i % step + step)
        rows = [kept[end]]
        for k in range(end - 1, first - 1, -1):
            rows.append(row_before(rows[-1], k))
        rows.reverse()
        while i < end and j < m:
            if p[i] == q[j]:
                pairs.append((i, j))
                i, j = i + 1, j + 1
            elif p[i] < 0 or rows[i + 1 - first][j] >= rows[i - first][j + 1]:
                i += 1
            else:
                j += 1
    return pairs


def by_counts(old: list[str], new: list[str]) -> list[int]:
    """For each new line an old line of equal content, each once, the earliest first; or -1."""
    free: dict[str, list[int]] = {}
    for i in range(len(old) - 1, -1, -1):
        free.setdefault(old[i], []).append(i)
    return [free[x].pop() if free.get(x) else -1 for x in new]


def moves(old: list[str], new: list[str], matched: list[int]) -> list[int]:
    """For each unmatched new line the first free old line of equal content, or -1."""
    taken = set(matched)
    free: dict[str, list[int]] = {}
    for i in range(len(old) - 1, -1, -1):
        if i not in taken:
            free.setdefault(old[i], []).append(i)
    return [free[x].pop() if k < 0 and free.get(x) else -1 for x, k in zip(new, matched, strict=True)]


def replaced(matched: list[int], moved: list[int], n_old: int) -> list[int]:
    """For each new line the old line it replaces, or -1: in each gap between matches the k-th free line the k-th free one."""
    out = [-1] * len(matched)
    gone = {i for i in moved if i >= 0}
    fresh: list[int] = []
    start = 0
    for j, at in enumerate([*matched, n_old]):
        last = j == len(matched)
        if not last and at < 0:
            if moved[j] < 0:
                fresh.append(j)
            continue
        if fresh or last or (j and matched[j - 1] < 0):
            for new, old in zip(fresh, (i for i in range(start, at) if i not in gone), strict=False):
                out[new] = old
        fresh, start = [], at + 1
    return out


def attribute(prior: list[tuple], baseline: str | None, new: str | None, author: tuple) -> tuple[list[tuple], list[tuple | None], list[str]]:
    """Authors of the new lines, the authors they overrode, and the baseline lines that went."""
    before, after = lines_of(baseline), lines_of(new)
    old, now = [stripped(x) for x in before], [stripped(x) for x in after]
    matched = align(old, now)
    moved = moves(old, now, matched)
    of = lambda i: prior[i] if i < len(prior) else HUMAN
    authors = [of(m if m >= 0 else v) if max(m, v) >= 0 else author for m, v in zip(matched, moved, strict=True)]
    over = [of(i) if i >= 0 and of(i)[0] != author[0] else None for i in replaced(matched, moved, len(old))]
    kept = set(matched) | set(moved)
    return authors, over, [x for i, x in enumerate(before) if i not in kept]


FOLD = "line_no int, author_type string, tool string, model string, gen_type string, session string, overrode string"
#: Rows of a result go on in batches of so many.
FOLDED_ROWS = 20_000


def fold(edits: DataFrame, keys: list[str], seed: DataFrame | None = None) -> DataFrame:
    """keys, line_no, author..., overrode: the authors of each file's lines after its edits, in order of ts and id.

    edits: keys, ts, id, content (the file after the edit), baseline (before the first; null is empty), author_type,
    tool, model, gen_type, session. seed: keys, authors (array of type, tool, model, gen_type, session by line).
    A file's versions come one after the other from a sort that can spill; two of them and the authors by line are held.
    """
    kinds = dict(edits.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + FOLD
    authors = "array<struct<author_type: string, tool: string, model: string, gen_type: string, session: string>>"
    rows = edits.select(*keys, F.lit(1).alias("_side"), "ts", "id", "content", *[F.coalesce(c, F.lit("")).alias(c) for c in AUTHOR], F.coalesce("baseline", F.lit("")).alias("baseline"), F.lit(None).cast(authors).alias("_authors"))
    if seed is not None:
        first = seed.select(*keys, F.lit(0).alias("_side"), F.transform("authors", lambda x: F.struct(*[x[c].alias(c) for c in AUTHOR])).cast(authors).alias("_authors"))
        rows = rows.unionByName(first, allowMissingColumns=True)
    order = [*keys, "_side", "ts", "id", "content", *AUTHOR]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, prior, over, before, some, out, types = None, [], [], None, False, [], []

        def told() -> list[tuple]:
            return [(*key, i + 1, *a, o[0] if o else None) for i, (a, o) in enumerate(zip(prior, over, strict=True))] if some else []

        for batch in batches:
            types = types or [batch.schema.field(k).type for k in keys] + [pa.int32()] + [pa.string()] * (1 + len(AUTHOR))
            columns = [batch.column(c) for c in (*keys, "_side", "content", "baseline", "_authors", *AUTHOR)]
            for i in range(len(batch)):
                values = [c[i].as_py() for c in columns]
                if (own := tuple(values[: len(keys)])) != key:
                    out += told()
                    key, prior, over, before, some = own, [], [], None, False
                    if len(out) >= FOLDED_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out = []
                side, content, baseline, first, *author = values[len(keys) :]
                if not side:
                    prior = [tuple(x[c] or "" for c in AUTHOR) for x in first or ()]
                    continue
                prior, over, _ = attribute(prior, before if some else baseline, content, tuple(author))
                before, some = content or "", True
        out += told()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    names = [*keys, *[c.split()[0] for c in FOLD.split(", ")]]
    return dealt(rows, *keys).sortWithinPartitions(*order).select(*keys, "_side", "content", "baseline", "_authors", *AUTHOR).mapInArrow(run, schema)


def aligned(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, new_pos, old_pos, moved: for each new line of (old_text, new_text) the line it continues, or null."""
    return _by_new_line(pairs, keys, "old_pos int, moved boolean", _continued)


def _continued(old_text: str | None, new_text: str | None) -> list[tuple]:
    old, new = ([stripped(x) for x in lines_of(t)] for t in (old_text, new_text))
    matched = align(old, new)
    return [(m if m >= 0 else v if v >= 0 else None, v >= 0) for m, v in zip(matched, moves(old, new, matched), strict=True)]


def _by_new_line(pairs: DataFrame, keys: list[str], columns: str, of) -> DataFrame:
    """keys, new_pos and what ``of(old_text, new_text)`` says of each new line."""
    schema = ", ".join(f"{k} {t}" for k, t in pairs.select(*keys).dtypes) + f", new_pos int, {columns}"
    names = [*keys, "new_pos", *[c.split()[0] for c in columns.split(", ")]]
    kinds = [pa.int32(), *[pa.int32() if c.endswith(" int") else pa.bool_() for c in columns.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types, out = [*[batch.schema.field(k).type for k in keys], *kinds], []
            columns_ = [batch.column(c) for c in (*keys, "old_text", "new_text")]
            for i in range(len(batch)):  # a text at a time, and its lines go on before there are many
                *key, old, new = (c[i].as_py() for c in columns_)
                out += ((*key, j, *x) for j, x in enumerate(of(old, new)))
                if out and (len(out) >= FOLDED_ROWS or i == len(batch) - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return pairs.select(*keys, "old_text", "new_text").mapInArrow(run, schema)


def added_or_moved(pairs: DataFrame, keys: list[str], most_cells: int | None = None) -> DataFrame:
    """keys, line_no, content, exact of the new lines that no old line at the same place in the order continues.

    Raw lines are compared, in order at every size. Only a caller who wants the surveyed readers' own rule gives ``most_cells``, old lines
    times new lines beyond which counts of equal lines decide and exact is false.
    """
    from lineweave.operators.diff import explode_lines

    def told(old_text: str | None, new_text: str | None) -> list[tuple]:
        old, new = lines_of(old_text), lines_of(new_text)
        exact = most_cells is None or len(old) * len(new) <= most_cells
        return [(m < 0, exact) for m in (align if exact else by_counts)(old, new)]

    found = _by_new_line(pairs, keys, "added boolean, exact boolean", told).where("added").select(*keys, "new_pos", "exact")
    lines = explode_lines(pairs, "new_text", *keys).withColumnRenamed("pos", "new_pos")
    return found.join(lines, [*keys, "new_pos"]).select(*keys, (F.col("new_pos") + 1).alias("line_no"), "content", "exact")


def narrowed(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The changed lines of replaced spans, at file positions: keys, line_no, content.

    spans: keys, old_text, new_text, start_line. A span without new lines counts whole.
    """
    from lineweave.operators.diff import explode_lines

    some = added_or_moved(spans, keys)
    whole = explode_lines(spans, "new_text", *keys).join(some.select(*keys).distinct(), keys, "left_anti").select(*keys, (F.col("pos") + 1).alias("line_no"), "content")
    return some.drop("exact").unionByName(whole).join(spans.select(*keys, "start_line"), keys).select(*keys, (F.col("line_no") + F.col("start_line") - 1).alias("line_no"), "content")
