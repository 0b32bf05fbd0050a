"""Totals of commits, files, tools, sessions and histories.

``lines`` has one row per line of a commit: sha, path, side (add or del), line_no, author_type, tool, model, gen_type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions.rules import GEN_TYPES, author_type, confidence_rank
from lineweave.functions.text import digest, share, undigest
from lineweave.operators.joins import SECOND, bucket_of

HOUR = 3600 * SECOND
TOOL_ORDER = ("claude", "cursor", "codex", "copilot", "gemini", "human")


def when_sum(condition: Column, value: Column | int = 1) -> Column:
    return F.sum(F.when(condition, value).otherwise(0))


def gen_bucket() -> Column:
    """The mode a line counts under: a person's is human, an AI's without a known mode unknown."""
    known = F.col("gen_type").isin("chat", "cli", "completion")
    return F.when(F.col("author_type") != "AI", "human").when(known, F.col("gen_type")).otherwise("unknown")


def added_totals(lines: DataFrame) -> DataFrame:
    """sha, ai_lines, human_lines, added_lines, chat, cli, completion, human, unknown over added lines."""
    add = lines.where(F.col("side") == "add").withColumn("_g", gen_bucket())
    ai = F.col("author_type") == "AI"
    modes = [when_sum(F.col("_g") == g).alias(g) for g in GEN_TYPES]
    return add.groupBy("sha").agg(when_sum(ai).alias("ai_lines"), when_sum(~ai).alias("human_lines"), F.count("*").alias("added_lines"), *modes)


def tool_totals(lines: DataFrame) -> DataFrame:
    """sha, tool, lines, accepted_lines, deleted_lines: lines with a tool's tag, also a person's; tools that only deleted have 0."""
    tagged = lines.where((F.coalesce(F.col("tool"), F.lit("")) != "") & ((F.col("side") == "add") | (F.col("author_type") == "AI")))
    add = F.col("side") == "add"
    return tagged.groupBy("sha", "tool").agg(when_sum(add).alias("lines"), when_sum(add).alias("accepted_lines"), when_sum(~add).alias("deleted_lines"))


def model_totals(lines: DataFrame) -> DataFrame:
    """sha, model, lines of an AI's added lines with a model."""
    some = lines.where((F.col("side") == "add") & (F.col("author_type") == "AI") & (F.coalesce(F.col("model"), F.lit("")) != ""))
    return some.groupBy("sha", "model").agg(F.count("*").alias("lines"))


def gen_type_totals(lines: DataFrame) -> DataFrame:
    """sha and a column for each mode, over added and deleted lines."""
    return lines.withColumn("_g", gen_bucket()).groupBy("sha").pivot("_g", list(GEN_TYPES)).count().na.fill(0)


def file_split(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """sha, path, ai and human lines added and deleted. An AI's are at most the file's total, the rest is a person's.

    totals: sha, path, added, deleted.
    """
    ai = F.col("author_type") == "AI"
    got = lines.groupBy("sha", "path").agg(when_sum(ai & (F.col("side") == "add")).alias("_a"), when_sum(ai & (F.col("side") == "del")).alias("_d"))
    rows = totals.join(got, ["sha", "path"], "left")
    a, d = F.least(F.coalesce("_a", F.lit(0)), "added"), F.least(F.coalesce("_d", F.lit(0)), "deleted")
    return rows.select("sha", "path", a.alias("ai_added"), (F.col("added") - a).alias("human_added"), d.alias("ai_deleted"), (F.col("deleted") - d).alias("human_deleted"))


def deleted_totals(lines: DataFrame) -> DataFrame:
    gone = lines.where(F.col("side") == "del")
    ai = F.col("author_type") == "AI"
    return gone.groupBy("sha").agg(F.count("*").alias("deleted_lines"), when_sum(ai).alias("ai_deleted"), when_sum(~ai).alias("human_deleted"))


def token_totals(edits: DataFrame, contributing: DataFrame) -> DataFrame:
    """sha, tool and four token sums. An assistant's turn writes its usage on all its edits, so each (tool, time) counts
    once: from the first file, then by confidence and id. edits: sha, file_path, id, tool, ts_ns, confidence, tokens.
    contributing: sha, tool of tools that the commit credits."""
    names = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
    used = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in names]) > 0
    rows = edits.where(used & (author_type(F.col("tool")) == "AI")).join(contributing.select("sha", "tool").distinct(), ["sha", "tool"], "left_semi")
    order = Window.partitionBy("sha", "tool", "ts_ns").orderBy("file_path", F.desc(confidence_rank(F.col("confidence"))), "id")
    rows = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return rows.groupBy("sha", "tool").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in names])


def suggested_totals(edits: DataFrame) -> DataFrame:
    """sha, tool, suggested_lines: each edit of a commit once, positive numbers only."""
    rows = edits.where(F.col("suggested_lines") > 0).dropDuplicates(["sha", "id"])
    return rows.groupBy("sha", "tool").agg(F.sum("suggested_lines").alias("suggested_lines"))


def with_session_usage(tools: DataFrame, usage: DataFrame) -> DataFrame:
    """Tool rows of commits with the usage of their chat sessions added, and the session's model where there is none.

    tools: sha, tool, model, input_tokens, output_tokens. usage: sha, tool, session_id, ts_ns, model, input_tokens, output_tokens.
    """
    got = usage.groupBy("sha", "tool").agg(F.sum("input_tokens").alias("_i"), F.sum("output_tokens").alias("_o"), F.max_by("model", F.when(F.coalesce(F.col("model"), F.lit("")) != "", F.struct("ts_ns", "model"))).alias("_m"))
    rows = tools.join(got, ["sha", "tool"], "left")
    add = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return rows.select("sha", "tool", F.coalesce("model", "_m").alias("model"), add(F.col("input_tokens"), F.col("_i")).alias("input_tokens"), add(F.col("output_tokens"), F.col("_o")).alias("output_tokens"))


def merged_source_tokens(pairs: DataFrame, source: DataFrame, credited: DataFrame) -> DataFrame:
    """Tokens of rewritten commits: sums over their source notes for tools that the new note credits.

    pairs: new, old. source: sha, tool, input_tokens, output_tokens. credited: sha, tool.
    """
    rows = pairs.join(source, pairs["old"] == source["sha"]).select(F.col("new").alias("sha"), "tool", "input_tokens", "output_tokens")
    rows = rows.join(credited.select("sha", "tool").distinct(), ["sha", "tool"], "left_semi")
    return rows.groupBy("sha", "tool").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def coding_time(commits: DataFrame, edits: DataFrame, look_back: int = 8 * HOUR) -> DataFrame:
    """sha, coding_ns: from the first edit since the last commit, or in the last eight hours, to the commit; 0 without one.

    Edits are summed up by bucket of the look-back, so a commit meets two buckets' edits. commits: sha, repo_path, ts_ns, prev_ns.
    """
    c = commits.withColumn("_lo", F.greatest(F.col("prev_ns"), F.col("ts_ns") - look_back)).withColumn("_b", F.explode(F.array(bucket_of(F.col("ts_ns"), look_back) - 1, bucket_of(F.col("ts_ns"), look_back))))
    e = edits.where(F.coalesce(F.col("file_path"), F.lit("")) != "").select("repo_path", F.col("ts_ns").alias("_ts"), bucket_of(F.col("ts_ns"), look_back).alias("_b"))
    got = c.join(e, ["repo_path", "_b"]).where((F.col("_ts") > F.col("_lo")) & (F.col("_ts") <= F.col("ts_ns")))
    first = got.groupBy("sha").agg((F.max("ts_ns") - F.min("_ts")).alias("coding_ns"))
    return commits.select("sha").join(first, "sha", "left").na.fill(0, ["coding_ns"])


def latest_usage(turns: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last assistant turn of a transcript that has a model and any tokens: keys, model, input_tokens, output_tokens."""
    used = F.coalesce(F.col("input_tokens"), F.lit(0)) + F.coalesce(F.col("output_tokens"), F.lit(0)) > 0
    some = turns.where((F.coalesce(F.col("model"), F.lit("")) != "") & used)
    last = some.groupBy(*keys).agg(F.max_by(F.struct("model", "input_tokens", "output_tokens"), order).alias("u"))
    return last.select(*keys, "u.*")


def backfilled_usage(edits: DataFrame, readers: list[DataFrame]) -> DataFrame:
    """Edits (id, session_id, model, input_tokens, output_tokens) filled from the first reader that knows the session:
    the model only if blank, tokens only if positive and not there yet."""
    found = None
    rows = edits
    for k, r in enumerate(readers):
        rows = rows.join(r.select("session_id", F.struct("model", "input_tokens", "output_tokens").alias(f"_r{k}")), "session_id", "left")
        found = F.col(f"_r{k}") if found is None else F.coalesce(found, F.col(f"_r{k}"))
    positive = lambda name: F.when(found[name] > 0, found[name])
    return rows.select(
        "id", "session_id", F.coalesce(F.nullif("model", F.lit("")), found["model"]).alias("model"),
        F.coalesce("input_tokens", positive("input_tokens")).alias("input_tokens"), F.coalesce("output_tokens", positive("output_tokens")).alias("output_tokens"),
    )


def cumulative_usage(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The newest counters of each key: counters run on, so the last ones stand for all."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(order, *values)).alias("u"), F.max(order).alias(order)).select(*keys, order, "u.*")


def hash_counts(lines: DataFrame, edit: str = "edit_id") -> DataFrame:
    """Units by edit and hash, exact and normalised: edit, kind, hash, n."""
    # a line goes to its edit's task once, with both hashes as bytes, and becomes two rows there
    rows = lines.select(edit, digest(F.col("content_sha")).alias("exact"), digest(F.col("content_sha_norm")).alias("norm")).repartition(edit)
    both = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("hash")) for kind in ("exact", "norm")]))
    counts = rows.select(edit, both.alias("h")).select(edit, "h.*").where(F.coalesce(F.octet_length("hash"), F.lit(0)) > 0).groupBy(edit, "kind", "hash").agg(F.count("*").alias("n"))
    return counts.withColumn("hash", undigest(F.col("hash")))


def dominant_gen_type(lines: DataFrame) -> DataFrame:
    """sha, tool, gen_type: the mode with most of the tool's added lines, ties to the smaller name."""
    n = lines.where((F.col("side") == "add") & (F.coalesce(F.col("tool"), F.lit("")) != "") & (F.coalesce(F.col("gen_type"), F.lit("")) != "")).groupBy("sha", "tool", "gen_type").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("sha", "tool").orderBy(F.desc("_n"), "gen_type")
    return n.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("sha", "tool", "gen_type")


def file_breakdown(lines: DataFrame) -> DataFrame:
    """sha, path, breakdown: ``tool n`` for each tool with added lines, in the tools' fixed order."""
    n = lines.where((F.col("side") == "add") & F.col("tool").isin(*TOOL_ORDER)).groupBy("sha", "path", "tool").agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*map(F.lit, TOOL_ORDER)), F.col("tool"))
    part = F.struct(place.alias("o"), F.concat_ws(" ", "tool", "n").alias("t"))
    return n.groupBy("sha", "path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["t"]), " · ").alias("breakdown"))


def leaderboard(models: DataFrame, tools: DataFrame, totals: DataFrame) -> DataFrame:
    """sha, rank, name, lines, is_model.

    Models have their added lines and a share of the AI's deletions: in order of names each gets the floor of its
    part and the last the rest. Without models the tools stand there, without tools one row for the AI's deletions. A
    person has added and deleted lines. models: sha, model, lines. tools: sha, tool, lines (an AI's, deletions too).
    totals: sha, author, human_lines, deleted_lines, ai_deleted.
    """
    by = Window.partitionBy("sha")
    m = models.join(totals.select("sha", "ai_deleted"), "sha")
    part = F.expr("ai_deleted * lines div sum(lines) over (partition by sha)")
    last = F.row_number().over(by.orderBy(F.desc("model"))) == 1
    m = m.withColumns({"_p": part, "_last": last})
    m = m.withColumn("_s", F.when(F.col("_last"), F.col("ai_deleted") - F.coalesce(F.sum(F.when(~F.col("_last"), F.col("_p"))).over(by), F.lit(0))).otherwise(F.col("_p")))
    rows = m.select("sha", F.col("model").alias("name"), (F.col("lines") + F.col("_s")).alias("lines"), F.lit(True).alias("is_model"), F.lit(0).alias("_o"))
    t = tools.where("lines > 0").join(models.select("sha").distinct(), "sha", "left_anti").select("sha", F.col("tool").alias("name"), "lines", F.lit(True).alias("is_model"), F.lit(0).alias("_o"))
    rest = totals.join(rows.select("sha").union(t.select("sha")).distinct(), "sha", "left_anti").where("ai_deleted > 0")
    only = rest.select("sha", F.lit("AI").alias("name"), F.col("ai_deleted").alias("lines"), F.lit(True).alias("is_model"), F.lit(0).alias("_o"))
    n = F.col("human_lines") + F.col("deleted_lines") - F.col("ai_deleted")
    person = totals.where(n > 0).select("sha", F.col("author").alias("name"), n.alias("lines"), F.lit(False).alias("is_model"), F.lit(1).alias("_o"))
    every = rows.unionByName(t).unionByName(only).unionByName(person)
    return every.withColumn("rank", F.row_number().over(by.orderBy(F.desc("lines"), "_o", "name"))).select("sha", "rank", "name", "lines", "is_model")


def acceptance(tools: DataFrame) -> DataFrame:
    """sha, top_tool, accepted_pct: of tools with suggestions, the one with most lines, and what part was accepted (100 at most)."""
    some = tools.where("suggested_lines > 0").withColumn("accepted_pct", F.least(F.floor(100 * F.col("accepted_lines") / F.col("suggested_lines")), F.lit(100)))
    order = Window.partitionBy("sha").orderBy(F.desc("lines"), "tool")
    return some.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("sha", F.col("tool").alias("top_tool"), "accepted_pct")


def headline(totals: DataFrame) -> DataFrame:
    """sha, ai_touched, human_touched, ai_pct, human_pct: touched is added and deleted; the shares sum to 100."""
    ai = F.col("ai_lines") + F.col("ai_deleted")
    human = F.col("human_lines") + F.col("human_deleted")
    pct = share(ai, ai + human)
    return totals.select("sha", ai.alias("ai_touched"), human.alias("human_touched"), pct.alias("ai_pct"), (F.round((100 - pct) * 10) / 10).alias("human_pct"))


def history_totals(commits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums over noted commits: commits, added, deleted, ai, human, chat, cli, completion, coding time, first and last time."""
    names = ("added_lines", "deleted_lines", "ai_lines", "human_lines", "chat", "cli", "completion", "coding_ns")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]
    return commits.groupBy(*(by or [])).agg(F.count("*").alias("commits"), *sums, F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def history_by_tool(tools: DataFrame) -> DataFrame:
    """tool, lines, input_tokens, output_tokens, model (of the newest commit that has one); tools without lines are left out."""
    model = F.max_by("model", F.when(F.coalesce(F.col("model"), F.lit("")) != "", F.struct("ts_ns", "sha")))
    rows = tools.groupBy("tool").agg(F.sum("lines").alias("lines"), F.sum(F.coalesce(F.col("input_tokens"), F.lit(0))).alias("input_tokens"), F.sum(F.coalesce(F.col("output_tokens"), F.lit(0))).alias("output_tokens"), model.alias("model"))
    return rows.where("lines > 0")


def cube(lines: DataFrame, *dimensions: str) -> DataFrame:
    """Lines, and an AI's lines, over every combination of the dimensions; ``level`` tells which are summed over."""
    ai = when_sum(F.col("author_type") == "AI")
    return lines.cube(*dimensions).agg(F.grouping_id().alias("level"), F.count("*").alias("lines"), ai.alias("ai_lines"))


def distinct_repositories(edits: DataFrame) -> DataFrame:
    return edits.where(F.coalesce(F.col("repo_path"), F.lit("")) != "").select("repo_path").distinct()


def note_documents(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """sha, note: a JSON document for each commit with totals, tools and files in order of path; absent fields are left out."""
    totals = added_totals(lines).select("sha", F.struct("added_lines", "ai_lines", "human_lines").alias("totals"))
    tools = tool_totals(lines).groupBy("sha").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tool", F.struct("lines", "accepted_lines", "deleted_lines"))))).alias("by_tool"))
    entry = F.struct("start_line", "end_line", "author_type", F.nullif("tool", F.lit("")).alias("tool"), "model", "gen_type")
    files = ranges.groupBy("sha", "path").agg(F.sort_array(F.collect_list(entry)).alias("lines"))
    files = files.groupBy("sha").agg(F.sort_array(F.collect_list(F.struct("path", "lines"))).alias("files"))
    note = F.to_json(F.struct("totals", "by_tool", "files"), {"ignoreNullFields": "true"})
    return totals.join(tools, "sha", "left").join(files, "sha", "left").select("sha", note.alias("note"))
