"""Edit events: validation, normalisation, storage as three tables, and the small text sources around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineweave import schemas
from lineweave.functions import rules
from lineweave.functions.text import clean_path

#: Places of a blame output that are carried along together.
SLOT = 1 << 16


def read_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON lines of edit events; lines that don't parse land in _corrupt."""
    reader = (spark.readStream if stream else spark.read).schema(f"{schemas.EDIT_EVENT}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt")
    return reader.json(path)


def bad_range(r: Column) -> Column:
    return (r["start"] <= 0) | (r["end"] < r["start"])


def strict(events: DataFrame) -> DataFrame:
    """Events as edits, with reject_reason on those that can't be stored.

    Repository and file are required, the tool is lower-cased and must be known, or blank with a person's mode; blank
    modes are unknown, a blank confidence is the tool's default, a bad line range rejects the event, removed lines
    without hash are left out.
    """
    tool = F.lower(F.coalesce("tool", F.lit("")))
    mode = F.coalesce(F.nullif(F.lower("gen_type"), F.lit("")), F.lit("unknown"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = (
        F.when(blank("repo_path") | blank("file_path"), "repo_path and file_path required")
        .when((tool == "") & (mode != "human"), "tool required")
        .when(~tool.isin("", *rules.TOOLS), "unknown tool")
        .when(F.coalesce(F.exists("lines", bad_range), F.lit(False)), "invalid line range")
    )
    rows = events.withColumn("reject_reason", reason)
    return rows.withColumns({
        "file_path": clean_path(F.col("file_path")), "tool": tool, "gen_type": mode, "confidence": rules.default_confidence(F.col("confidence"), tool),
        "lines": F.coalesce("lines", F.array()), "removed": F.filter(F.coalesce("removed", F.array()), lambda r: F.coalesce(r["content_sha"], F.lit("")) != ""),
    })


def lenient(events: DataFrame) -> DataFrame:
    """Tailed events as edits: those without repository are dropped, bad ranges one by one; the tool stays as written."""
    rows = events.where(F.coalesce("repo_path", F.lit("")) != "")
    return rows.withColumns({
        "file_path": clean_path(F.col("file_path")), "gen_type": F.coalesce(F.nullif("gen_type", F.lit("")), F.lit("unknown")),
        "confidence": rules.default_confidence(F.col("confidence"), F.col("tool")), "lines": F.filter(F.coalesce("lines", F.array()), lambda r: ~bad_range(r)),
        "removed": F.filter(F.coalesce("removed", F.array()), lambda r: F.coalesce(r["content_sha"], F.lit("")) != ""),
    })


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reject_reason").isNull()).drop("reject_reason")


def quarantine(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reject_reason").isNotNull())


def tables(edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """edits (blank branch, session and normalised hash as null), edit_lines, edit_removed_lines."""
    head = edits.drop("lines", "removed").withColumns({c: F.nullif(c, F.lit("")) for c in ("branch", "session_id") if c in edits.columns})
    lines = edits.select(F.col("id").alias("edit_id"), F.posexplode("lines").alias("ord", "l"))
    lines = lines.select("edit_id", "ord", F.col("l.start").alias("start_line"), F.col("l.end").alias("end_line"), "l.content_sha", F.nullif("l.content_sha_norm", F.lit("")).alias("content_sha_norm"))
    removed = edits.select(F.col("id").alias("edit_id"), F.posexplode("removed").alias("ord", "r"))
    removed = removed.select("edit_id", "ord", "r.content_sha", F.nullif("r.content_sha_norm", F.lit("")).alias("content_sha_norm"))
    return head, lines, removed


def write(edits: DataFrame, folder: str) -> None:
    """Three Parquet tables; edits lie by repository and day, where all windows and scopes look first."""
    head, lines, removed = tables(edits)
    day = F.to_date(F.timestamp_seconds(F.col("ts_ns") / 1_000_000_000))
    head.withColumn("day", day).write.mode("append").partitionBy("day").parquet(f"{folder}/edits")
    lines.write.mode("append").parquet(f"{folder}/edit_lines")
    removed.write.mode("append").parquet(f"{folder}/edit_removed_lines")


def status_files(lines: DataFrame, raw: str = "line") -> DataFrame:
    """Changed source files of short status lines: path (the new one of a rename), deleted."""
    path = F.trim(F.translate(F.element_at(F.split(F.substring(F.col(raw), 4, 1 << 20), " -> "), -1), '"', ""))
    rows = lines.select(path.alias("path"), F.substring(raw, 1, 2).contains("D").alias("deleted"))
    return rows.where((F.col("path") != "") & rules.is_source_name(F.col("path")))


def exclude_rules(lines: DataFrame, raw: str = "line") -> DataFrame:
    """kind, pattern of ignore-file lines; blanks, comments and negations are no rules. A leading slash anchors, a
    trailing one doesn't matter."""
    text = F.trim(F.col(raw))
    rows = lines.select(text.alias("t")).where((F.col("t") != "") & ~F.col("t").startswith("#") & ~F.col("t").startswith("!"))
    anchored = F.col("t").startswith("/")
    body = F.regexp_replace(F.regexp_replace("t", "^/", ""), "/$", "")
    kind = F.when(anchored, "anchored").when(body.rlike(r"[*?\[]") & ~body.contains("/"), "glob").when(~body.contains("/"), "component").otherwise("anywhere")
    return rows.select(kind.alias("kind"), body.alias("pattern")).where("pattern <> ''").distinct()


def rewrite_pairs(lines: DataFrame, raw: str = "line") -> DataFrame:
    """old, new of lines with two ids of 40 characters or more."""
    parts = F.split(F.trim(raw), r"\s+")
    rows = lines.select(parts.alias("p")).where((F.size("p") >= 2) & (F.length(F.col("p")[0]) >= 40) & (F.length(F.col("p")[1]) >= 40))
    return rows.select(F.col("p")[0].alias("old"), F.col("p")[1].alias("new"))


def blame_lines(lines: DataFrame, keys: list[str], order: str = "pos", raw: str = "line") -> DataFrame:
    """keys, final_line, sha, origin_line, author, author_time, content of porcelain blame output.

    A commit's details come once, with its first line; they are carried to the others by sha. A file's lines are carried along in
    stretches of SLOT places, each of which begins with the last head before it, so a large file is many tasks' work.
    """
    head = r"^([0-9a-f]{40,64}) (\d+) (\d+)"
    text = F.col(raw)
    get = lambda k: F.regexp_extract(text, head, k)
    is_head = F.when(text.rlike(head), F.struct(get(1).alias("sha"), get(2).cast("int").alias("origin_line"), get(3).cast("int").alias("final_line")))
    field = lambda name: F.when(text.startswith(f"{name} "), F.substring(text, len(name) + 2, 1 << 20))
    rows = lines.select(*keys, F.floor(F.col(order) / SLOT).alias("_slot"), F.col(order).alias("_at"), text.alias(raw)).withColumn("_head", is_head)
    ends = rows.groupBy(*keys, "_slot").agg(F.max_by("_head", F.when(F.col("_head").isNotNull(), F.col("_at"))).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_slot", F.last("_last", True).over(earlier).alias("_before"))
    so_far = Window.partitionBy(*keys, "_slot").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    of = F.coalesce(F.last("_head", True).over(so_far), F.col("_before"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in (*keys, "_slot")]
    rows = rows.alias("r").join(ends.alias("e"), same, "left").select("r.*", "e._before").withColumn("_of", of)
    rows = rows.withColumns({"sha": F.col("_of.sha"), "origin_line": F.col("_of.origin_line"), "final_line": F.col("_of.final_line"), "_author": field("author"), "_time": field("author-time")})
    by_sha = Window.partitionBy(*keys, "sha")
    rows = rows.withColumns({"author": F.max("_author").over(by_sha), "author_time": F.max("_time").over(by_sha).cast("long")})
    return rows.where(text.startswith("\t")).select(*keys, "final_line", "sha", "origin_line", "author", "author_time", F.substring(text, 2, 1 << 20).alias("content"))
