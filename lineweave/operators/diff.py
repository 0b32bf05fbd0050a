"""Differences of line tables as joins on ranks. A line table has the caller's keys, ``pos`` and ``content``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions.text import digest, is_blank, line_sha, line_sha_norm, similar, split_lines, strip_space, undigest


def explode_lines(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row per line of a text column: keys, pos (from 0), content."""
    return df.select(*keys, F.posexplode(split_lines(F.col(text))).alias("pos", "content"))


def beyond(rows: DataFrame, other: DataFrame, keys: list[str], value: str = "content", order: str = "pos") -> DataFrame:
    """The rows that the other side's occurrences of the same value don't cover, the earliest being covered first."""
    covered = other.groupBy(*keys, value).agg(F.count("*").alias("_covered"))
    nth = F.row_number().over(Window.partitionBy(*keys, value).orderBy(order))
    return rows.withColumn("_nth", nth).join(covered, [*keys, value], "left").where(F.col("_nth") > F.coalesce("_covered", F.lit(0))).drop("_nth", "_covered")


def added_lines(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset difference: lines of ``new`` beyond those of ``old``."""
    return beyond(new, old, keys)


def removed_hashes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, content_sha, content_sha_norm of the lines of ``old`` beyond those of ``new``; blank lines are left out."""
    gone = beyond(old, new, keys).where(~is_blank(F.col("content")))
    return gone.select(*keys, "pos", line_sha(F.col("content")).alias("content_sha"), line_sha_norm(F.col("content")).alias("content_sha_norm"))


def edit_totals(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, added, deleted: what an alignment with moves would credit and delete, by counts of stripped content alone."""
    count = lambda df, name: df.groupBy(*keys, strip_space(F.col("content")).alias("stripped")).agg(F.count("*").alias(name))
    both = count(old, "n_old").join(count(new, "n_new"), [*keys, "stripped"], "full")
    n_old, n_new = F.coalesce("n_old", F.lit(0)), F.coalesce("n_new", F.lit(0))
    return both.groupBy(*keys).agg(F.sum(F.greatest(n_new - n_old, F.lit(0))).alias("added"), F.sum(F.greatest(n_old - n_new, F.lit(0))).alias("deleted"))


def net_unchanged(lines: DataFrame, removed: DataFrame, edit: str = "edit_id", sha: str = "content_sha", order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """Within an edit, added and removed lines of one hash cancel out, the earliest first; empty hashes never do."""

    def rest(a: DataFrame, b: DataFrame) -> DataFrame:
        hashed = F.coalesce(F.col(sha), F.lit("")) != ""
        short = lambda df: df.where(hashed).withColumn(sha, digest(F.col(sha)))
        return beyond(short(a), short(b), [edit], sha, order).withColumn(sha, undigest(F.col(sha))).select(*a.columns).unionByName(a.where(~hashed))

    return rest(lines, removed), rest(removed, lines)


def line_rows(df: DataFrame, text: str, *keys: str, most: int | None = 4000, blanks: bool = True) -> DataFrame:
    """keys, line_no, content_sha, content_sha_norm of the first ``most`` lines of a text (of the non-blank ones, if ``blanks``
    is false), or of all with None. lines_cut() tells what a limit leaves out."""
    lines = explode_lines(df, text, *keys)
    if not blanks:
        lines = lines.where(~is_blank(F.col("content")))
    if most is not None:
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
        lines = lines.withColumn("_nth", nth).where(F.col("_nth") <= most)
    sha = F.when(is_blank(F.col("content")), "").otherwise(line_sha(F.col("content")))
    return lines.select(*keys, (F.col("pos") + 1).alias("line_no"), sha.alias("content_sha"), line_sha_norm(F.col("content")).alias("content_sha_norm"))


def lines_cut(df: DataFrame, text: str, *keys: str, most: int = 4000) -> DataFrame:
    """keys, n_cut: how many lines of a text lie beyond the first ``most``; texts that keep all are left out."""
    return df.select(*keys, (F.size(split_lines(F.col(text))) - most).alias("n_cut")).where("n_cut > 0")


def range_lines(df: DataFrame, start: str = "start_line", end: str = "end_line", line: str = "line_no") -> DataFrame:
    """One row per line of each range; ranges that end before they start give none."""
    return df.where(F.col(end) >= F.col(start)).withColumn(line, F.explode(F.sequence(start, end))).drop(start, end)


HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def hunk_lines(diffs: DataFrame, text: str, *keys: str) -> DataFrame:
    """Lines inside the hunks of unified diffs.

    keys, path_old, path_new, hunk, pos, sign (``+``, ``-`` or space), content, line_no (in the new file for ``+`` and
    context, in the old one for ``-``). Text before the first hunk of a file is header; a TAB ends a path.
    """
    rows = diffs.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "raw"))
    by = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    raw = F.col("raw")
    head = raw.startswith("diff --git ")
    name = lambda mark: F.when(raw.startswith(mark), F.regexp_replace(F.regexp_replace(F.substring(raw, 5, 1 << 20), "\t.*$", ""), "^[ab]/", ""))
    rows = rows.withColumn("file", F.sum(head.cast("int")).over(by)).withColumn("is_hunk", raw.rlike(HUNK))
    inside = Window.partitionBy(*keys, "file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hunk", F.sum(F.col("is_hunk").cast("int")).over(inside))
    header = F.col("hunk") == 0
    for column, mark in (("path_old", "--- "), ("path_new", "+++ ")):
        rows = rows.withColumn(column, F.last(F.when(header, name(mark)), True).over(inside))
    number = lambda k: F.when(F.col("is_hunk"), F.regexp_extract(raw, HUNK, k).cast("int"))
    rows = rows.withColumns({"a": F.last(number(1), True).over(inside), "c": F.last(number(3), True).over(inside), "sign": F.substring(raw, 1, 1)})
    lines = rows.where((F.col("hunk") > 0) & ~F.col("is_hunk") & F.col("sign").isin("+", "-", " "))
    within = Window.partitionBy(*keys, "file", "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    so_far = lambda keep: F.sum(F.when(F.col("sign").isin(*keep), 1).otherwise(0)).over(within)
    at = F.when(F.col("sign") == "-", F.col("a") + so_far("- ") - 1).otherwise(F.col("c") + so_far("+ ") - 1)
    return lines.select(*keys, "path_old", "path_new", "hunk", "pos", "sign", F.substring(raw, 2, 1 << 30).alias("content"), at.cast("int").alias("line_no"))


def file_changes(diffs: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, path_old, path, kind: ADDED, DELETED, RENAMED, COPIED or MODIFIED for each file of a unified diff."""
    parts = diffs.select(*keys, F.explode(F.slice(F.split(F.concat(F.lit("\n"), F.col(text)), "\ndiff --git "), 2, 1 << 30)).alias("part"))
    get = lambda pattern: F.nullif(F.regexp_extract("part", pattern, 1), F.lit(""))
    old = F.coalesce(get(r"\n(?:rename|copy) from ([^\n]+)"), get(r"\n--- a/([^\t\n]+)"), get(r"^a/(.+) b/[^\n]+"))
    new = F.coalesce(get(r"\n(?:rename|copy) to ([^\n]+)"), get(r"\n\+\+\+ b/([^\t\n]+)"), get(r"^a/.+ b/([^\n]+)"))
    has = lambda text: F.col("part").contains(f"\n{text}")
    kind = F.when(has("new file mode"), "ADDED").when(has("deleted file mode"), "DELETED").when(has("rename from"), "RENAMED").when(has("copy from"), "COPIED").otherwise("MODIFIED")
    return parts.select(*keys, old.alias("path_old"), F.when(kind == "DELETED", old).otherwise(new).alias("path"), kind.alias("kind"))


def changed_lines(lines: DataFrame, *keys: str) -> DataFrame:
    """Added and deleted lines from hunk_lines(), the k-th ``-`` of a hunk against its k-th ``+``.

    Equal content: neither counts. Similar content: only the addition. Else both. Extras on either side stay.
    """
    by = Window.partitionBy(*keys, "path_new", "path_old", "hunk", "sign").orderBy("pos")
    ranked = lines.where(F.col("sign") != " ").withColumn("k", F.row_number().over(by))
    on = [*keys, "path_new", "path_old", "hunk", "k"]
    side = lambda sign, name: ranked.where(F.col("sign") == sign).select(*on, F.struct("content", "line_no").alias(name))
    pair = side("-", "del").join(side("+", "add"), on, "full")
    pair = pair.withColumn("alike", F.coalesce(similar(F.col("del.content"), F.col("add.content")), F.lit(False)))
    same = F.coalesce(F.col("del.content") == F.col("add.content"), F.lit(False))
    one = lambda side, path, keep: F.when(keep, F.struct(F.lit(side).alias("side"), F.col(path).alias("path"), F.col(f"{side}.line_no").alias("line_no"), F.col(f"{side}.content").alias("content")))
    out = F.array(one("add", "path_new", F.col("add").isNotNull() & ~same), one("del", "path_old", F.col("del").isNotNull() & ~same & ~F.col("alike")))
    return pair.select(*keys, F.explode(F.array_compact(out)).alias("c")).select(*keys, "c.*")


def hunk_removed(lines: DataFrame, *keys: str) -> DataFrame:
    """removed_hashes() within each hunk: lines of its old side beyond its new side."""
    on = [*keys, "path_new", "path_old", "hunk"]
    return removed_hashes(lines.where(F.col("sign") != "+"), lines.where(F.col("sign") != "-"), on)


def hunk_new_lines(headers: DataFrame, header: str, *keys: str) -> DataFrame:
    """keys, line_no of each new-side line that hunk headers name; an absent length is 1, a length of 0 names none."""
    get = lambda k: F.regexp_extract(header, HUNK, k)
    start, n = get(3).cast("int"), F.when(get(4) == "", 1).otherwise(get(4).cast("int"))
    rows = headers.where(F.col(header).rlike(HUNK)).select(*keys, start.alias("_s"), n.alias("_n")).where("_n > 0")
    return rows.select(*keys, F.explode(F.sequence(F.col("_s"), F.col("_s") + F.col("_n") - 1)).alias("line_no"))


def pair_moves(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Unmatched lines of both sides (keys, pos, content): new_pos takes the first free old_pos of equal stripped content."""

    def ranked(df: DataFrame, name: str) -> DataFrame:
        s: Column = strip_space(F.col("content"))
        return df.withColumn("stripped", s).withColumn("k", F.row_number().over(Window.partitionBy(*keys, "stripped").orderBy("pos"))).select(*keys, "stripped", "k", F.col("pos").alias(name))

    return ranked(new, "new_pos").join(ranked(old, "old_pos"), [*keys, "stripped", "k"]).select(*keys, "new_pos", "old_pos")
