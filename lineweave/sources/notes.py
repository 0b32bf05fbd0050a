"""Notes, working logs and deletion logs: JSON documents as tables and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave import schemas


def new_or_old(new: Column, old: Column) -> Column:
    """A counter under its present key, or under the key it had, where that is 0."""
    return F.when(F.coalesce(new, F.lit(0)) == 0, F.coalesce(old, F.lit(0))).otherwise(new)


def notes(rows: DataFrame, text: str = "note") -> DataFrame:
    """sha and the parsed note as ``n``; texts that don't parse give null."""
    return rows.select("sha", F.from_json(text, schemas.NOTE).alias("n"))


def note_totals(parsed: DataFrame) -> DataFrame:
    """sha, ai_lines, human_lines, added_lines, deleted_lines; an absent number of added lines is the sum of both."""
    t = F.col("n.totals")
    ai, human = F.coalesce(t["ai_lines"], F.lit(0)), F.coalesce(t["human_lines"], F.lit(0))
    added = new_or_old(t["added_lines"], t["added"])
    return parsed.where(t.isNotNull()).select("sha", ai.alias("ai_lines"), human.alias("human_lines"), F.when(added == 0, ai + human).otherwise(added).alias("added_lines"), new_or_old(t["deleted_lines"], t["deleted"]).alias("deleted_lines"))


def note_tools(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("sha", F.explode("n.by_tool").alias("tool", "t"))
    return rows.select("sha", "tool", new_or_old(F.col("t.lines"), F.col("t.ai_lines")).alias("lines"), F.coalesce("t.accepted_lines", F.lit(0)).alias("accepted_lines"), F.coalesce("t.deleted_lines", F.lit(0)).alias("deleted_lines"))


def note_ranges(parsed: DataFrame) -> DataFrame:
    """sha, path, side, start_line, end_line, author_type, tool, model, gen_type."""
    rows = parsed.select("sha", F.explode("n.files").alias("f")).select("sha", "f.path", F.explode("f.lines").alias("l"))
    return rows.select("sha", "path", F.col("l.type").alias("side"), F.col("l.start").alias("start_line"), F.col("l.end").alias("end_line"), "l.author_type", "l.tool", "l.model", "l.gen_type")


def write_notes(documents: DataFrame, path: str) -> None:
    """One folder for each commit's first characters, so a run again replaces the folders it writes and no others."""
    shard = documents.withColumn("shard", F.substring("sha", 1, 2))
    shard.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def working_logs(rows: DataFrame, keys: list[str], text: str = "log") -> DataFrame:
    """keys, file, line_no, author_type, tool, model, gen_type, session of each line; unreadable logs give none."""
    log = rows.select(*keys, F.from_json(text, schemas.WORKING_LOG).alias("w")).where(F.col("w.file").isNotNull())
    r = log.select(*keys, "w.file", F.explode("w.lines").alias("l")).where("l.end >= l.start")
    return r.select(*keys, "file", F.explode(F.sequence("l.start", "l.end")).alias("line_no"), F.col("l.author").alias("author_type"), "l.tool", "l.model", "l.gen_type", "l.session")


def working_log_documents(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, log: the JSON form of ranges (keys, file, base_sha, start_line, end_line, author_type, tool, model, gen_type, session)."""
    line = F.struct(F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.col("author_type").alias("author"), F.nullif("tool", F.lit("")).alias("tool"), F.nullif("model", F.lit("")).alias("model"), F.nullif("gen_type", F.lit("")).alias("gen_type"), F.nullif("session", F.lit("")).alias("session"))
    rows = ranges.groupBy(*keys, "file", "base_sha").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return rows.select(*keys, F.to_json(F.struct(F.lit("1").alias("schema"), "file", "base_sha", "lines")).alias("log"))


def deletions(rows: DataFrame, keys: list[str], order: str, text: str = "line") -> DataFrame:
    """keys, file, content, author_type, tool of appended deletion records: the last of each (file, content)."""
    d = rows.select(*keys, order, F.from_json(text, schemas.DELETION).alias("d")).where(F.col("d.file").isNotNull())
    d = d.select(*keys, order, "d.file", "d.content", F.col("d.author.author").alias("author_type"), F.col("d.author.tool").alias("tool"))
    nth = F.row_number().over(Window.partitionBy(*keys, "file", "content").orderBy(F.desc(order)))
    return d.withColumn("_n", nth).where("_n = 1").drop("_n", order)
