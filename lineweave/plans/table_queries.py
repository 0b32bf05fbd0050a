"""Queries for table upkeep (D rows) and for edit ingest and small sources (S01-S03, S20-S27)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.operators import tables, windows
from lineweave.plans.registry import Tables, query
from lineweave.sources import edits, notes

c = F.col


@query("d01_upsert_commits", "select sha, repo_path, case when n % 20 = 0 then ts_ns else ts_ns + 7 end as ts_ns, cast(case when n % 30 = 0 or n % 20 <> 0 then 1 else 0 end as int) as note_written from commits_v where n % 20 = 0 or n % 30 = 10")
def d01(t: Tables) -> DataFrame:
    known = t.commits_v.where("n % 20 = 0").select("sha", "repo_path", "ts_ns", F.lit(0).alias("note_written"))
    noted = t.commits_v.where("n % 30 = 0 and n % 20 = 0 or n % 30 = 10 and n % 20 <> 0").select("sha", "repo_path", (c("ts_ns") + 7).alias("ts_ns"))
    return tables.note_commits(known, noted)


@query("d02_upsert_prompts", "select session_id, turn, case when turn % 2 = 0 then 'new' else 'old' end as text from turns_v where role = 'user'")
def d02(t: Tables) -> DataFrame:
    user = t.turns_v.where("role = 'user'").select("session_id", "turn", "ts_ns")
    return tables.upsert(user.withColumn("text", F.lit("old")), user.where("turn % 2 = 0").withColumn("text", F.lit("new")), ["session_id", "turn"], "ts_ns").select("session_id", "turn", "text")


@query("d03_upsert_snapshots", "select repo_path, file_path, arg_max(id, ts_ns) as content_id from edits_v group by all")
def d03(t: Tables) -> DataFrame:
    return tables.upsert(t.edits_v.where("id % 2 = 0"), t.edits_v.where("id % 2 = 1"), ["repo_path", "file_path"], "ts_ns").select("repo_path", "file_path", c("id").alias("content_id"))


@query("d04_soft_delete_restore", "select id, case when repo_path = 'repo1' and file_path = 'src/f1.py' and id % 2 = 1 then 1 when repo_path = 'repo2' and id % 2 = 1 then 5 end as deleted_at from edits_v")
def d04(t: Tables) -> DataFrame:
    e = t.edits_v.withColumn("deleted_at", F.when(c("id") % 2 == 1, F.lit(1)).cast("long"))
    e = e.withColumn("deleted_at", F.when((c("repo_path") == "repo1") & (c("file_path") == "src/f1.py"), c("deleted_at")))
    hit = t.edits_v.where("repo_path = 'repo2' and id % 2 = 1").select("repo_path", "file_path").distinct().withColumn("at_ns", F.lit(5).cast("long"))
    got = tables.soft_deleted(e, hit)
    back = t.edits_v.where("repo_path = 'repo2'").select("repo_path", "file_path").distinct()
    even = tables.restored(got.where("id % 2 = 0"), back.unionByName(t.edits_v.where("repo_path <> 'repo2'").select("repo_path", "file_path").distinct()))
    return got.where("id % 2 = 1").unionByName(even.select(*got.columns)).select("id", "deleted_at").withColumn("deleted_at", c("deleted_at").cast("int"))


@query("d05_move", "select id, case when repo_path = 'repo1' and file_path = 'src/f0.py' then 'lib/f0.py' else file_path end as file_path, cast(case when repo_path = 'repo1' and file_path = 'src/f0.py' then null else 1 end as bigint) as deleted_at from edits_v")
def d05(t: Tables) -> DataFrame:
    moves = t.spark.createDataFrame([("repo1", "src/f0.py", "lib/f0.py"), ("repo2", "src/f1.py", "src/f1.py")], "repo_path string, old_path string, new_path string")
    return tables.moved(t.edits_v.withColumn("deleted_at", F.lit(1).cast("long")), moves).select("id", "file_path", "deleted_at")


@query("d06_copy", "select repo_path, file_path, count(*) as n from (select repo_path, file_path from edits_v where not (repo_path = 'repo1' and file_path = 'src/f2.py') union all select repo_path, 'src/f2.py' from edits_v where repo_path = 'repo1' and file_path = 'src/f1.py' and id % 3 <> 0) group by all")
def d06(t: Tables) -> DataFrame:
    copies = t.spark.createDataFrame([("repo1", "src/f1.py", "src/f2.py")], "repo_path string, src_path string, dst_path string")
    e = t.edits_v.withColumn("deleted_at", F.when(c("id") % 3 == 0, F.lit(1)).cast("long"))
    again = tables.copied(tables.copied(e, copies), copies)
    return again.groupBy("repo_path", "file_path").agg(F.count("*").alias("n"))


@query("d07_file_event_dispatch", """
select id, case when repo_path = '' then null when kind = 'delete' then 'delete' when kind = 'create' then 'restore' when lower(kind) in ('rename', 'move') and new_path <> '' then 'move' when kind = 'copy' then 'copy' end as action,
  case when repo_path = '' then 'repo_path required' when kind = 'chmod' then 'unknown kind' when lower(kind) in ('rename', 'move') and new_path = '' then 'path required' end as reject_reason from fs_v""")
def d07(t: Tables) -> DataFrame:
    return tables.dispatched(t.fs_v).select("id", "action", "reject_reason")


@query("d08_path_backfill", "select id, file_path from edits_v")
def d08(t: Tables) -> DataFrame:
    return tables.slashed(t.edits_v.select("id", F.translate("file_path", "/", "\\").alias("file_path")))


@query("d09_log_carry_forward", "select repo_path, branch, case when n % 20 = 0 and n % 3 <> 0 then concat('next', base_sha) else base_sha end as base_sha, file from logs_v")
def d09(t: Tables) -> DataFrame:
    logs = t.logs_v.select("repo_path", "branch", "base_sha", "file")
    steps = t.logs_v.where("n % 20 = 0").select("repo_path", "branch", c("base_sha").alias("old_base"), F.concat(F.lit("next"), "base_sha").alias("new_base"))
    committed = t.logs_v.where("n % 3 = 0").select("repo_path", "branch", c("base_sha").alias("old_base"), "file")
    return tables.carried_forward(logs, steps, committed)


@query("d10_log_retention", "select repo_path, file, n from logs_v where n % 40 = 10 or n % 40 = 0 or n % 40 = 20 and n % 3 <> 0")
def d10(t: Tables) -> DataFrame:
    key = F.expr("case when n % 40 = 10 then 'pending' else sha2(base_sha, 256) end")
    logs = t.logs_v.withColumn("base_sha", key)
    ancestry = logs.where("n % 40 in (0, 20)").select("repo_path", "base_sha", F.expr("case when n % 40 = 0 then 10 when n % 3 = 0 then 900 end").alias("behind"))
    return tables.retained(logs, ancestry).select("repo_path", "file", "n")


@query("d12_rewrite_rekey", "select concat('n', cast(g as varchar)) as new, cast(count(*) as int) as n_old, case when count(*) = 1 and max(n % 3) = 1 then 'keep' else 'rebuild' end as action from (select n, case when n % 40 = 0 then n else n // 100 * 100 + 1 end as g from commits_v) group by g")
def d12(t: Tables) -> DataFrame:
    pairs = t.commits_v.select(F.expr("concat('n', case when n % 40 = 0 then n else n div 100 * 100 + 1 end)").alias("new"), c("sha").alias("old"))
    return tables.rewrites(pairs, t.commits_v.where("n % 3 = 1").select("sha"))


EVENT = """select id, case when id % 11 = 0 then '' else repo_path end as repo_path, concat('./', file_path) as file_path, case when id % 7 = 0 then upper(tool) when id % 13 = 0 then 'robot' else tool end as tool,
  case when id % 2 = 0 then '' else confidence end as confidence, case when id % 5 = 0 then '' else gen_type end as gen_type, branch, session_id, ts_ns, id % 4 as a, id % 6 as b from edits_v"""


def events(t: Tables) -> DataFrame:
    one = lambda s, e: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), F.lit("x").alias("content_sha"), F.lit("").alias("content_sha_norm"))
    hash_ = lambda v: F.struct(v.alias("content_sha"), F.lit("").alias("content_sha_norm"))
    rows = t.sql(EVENT)
    return rows.withColumns({"lines": F.array(one(c("a"), c("b")), one(F.lit(1), F.lit(3))), "removed": F.array(hash_(F.lit("")), hash_(c("tool")))}).drop("a", "b")


@query("s01_edit_event_ingest_strict", f"""
with e as ({EVENT}), g as (select *, lower(tool) as lt, coalesce(nullif(gen_type, ''), 'unknown') as g from e)
select id, case when repo_path = '' then 'repo_path and file_path required' when lt = '' and g <> 'human' then 'tool required' when lt not in ('', 'claude', 'cursor', 'codex', 'copilot', 'gemini', 'human', 'copypaste') then 'unknown tool' when a <= 0 or b < a then 'invalid line range' end as reject_reason,
  substr(file_path, 3) as file_path, lt as tool, g as gen_type, coalesce(nullif(confidence, ''), case when lt = 'copilot' then 'low' else 'high' end) as confidence, cast(case when tool = '' then 0 else 1 end as int) as n_removed from g""")
def s01(t: Tables) -> DataFrame:
    return edits.strict(events(t)).select("id", "reject_reason", "file_path", "tool", "gen_type", "confidence", F.size("removed").alias("n_removed"))


@query("s02_edit_event_ingest_lenient", f"with e as ({EVENT}) select id, tool, coalesce(nullif(gen_type, ''), 'unknown') as gen_type, cast(1 + case when a > 0 and b >= a then 1 else 0 end as int) as n_lines from e where repo_path <> ''")
def s02(t: Tables) -> DataFrame:
    return edits.lenient(events(t)).select("id", "tool", "gen_type", F.size("lines").alias("n_lines"))


@query("s03_edit_fact_storage", f"with e as ({EVENT}) select id as edit_id, 'line' as part, unnest([0, 1]) as ord, cast(null as varchar) as norm from e union all select id, 'removed', unnest([0, 1]), null from e union all select id, 'head', 0, session_id from e")
def s03(t: Tables) -> DataFrame:
    head, lines, removed = edits.tables(events(t))
    part = lambda df, name: df.select("edit_id", F.lit(name).alias("part"), "ord", c("content_sha_norm").alias("norm"))
    return part(lines, "line").unionByName(part(removed, "removed")).unionByName(head.select(c("id").alias("edit_id"), F.lit("head").alias("part"), F.lit(0).alias("ord"), c("session_id").alias("norm")))


@query("s20_blame_porcelain", "select path, cast(final_line as int) as final_line, sha256(sha)[1:40] as sha, cast(origin_line as int) as origin_line, 'A ' || sha as author from blame_v")
def s20(t: Tables) -> DataFrame:
    """Blame output with a commit's details on its first line only."""
    from pyspark.sql import Window

    b = t.blame_v.withColumns({"id": F.substring(F.sha2("sha", 256), 1, 40), "first": F.row_number().over(Window.partitionBy("path", "sha").orderBy("final_line")) == 1})
    b = b.repartitionByRange("path", "sha", "final_line").sortWithinPartitions("path", "sha", "final_line").withColumn("n", F.monotonically_increasing_id())
    head = F.concat_ws(" ", "id", "origin_line", "final_line")
    rows = F.when(c("first"), F.array(head, F.concat(F.lit("author A "), "sha"), F.lit("author-time 1700000000"), F.lit("\tx"))).otherwise(F.array(head, F.lit("\tx")))
    lines = b.select("path", "n", F.posexplode(rows).alias("k", "line")).select("path", (c("n") * 10 + c("k")).alias("pos"), "line")
    return edits.blame_lines(lines, ["path"]).select("path", "final_line", "sha", "origin_line", "author")


@query("s21_rewrite_pairs", "select sha256(sha) as old, sha256(repo_path) as new from commits_v where n % 30 <> 0")
def s21(t: Tables) -> DataFrame:
    lines = t.commits_v.select(F.expr("case when n % 30 = 0 then concat('abc ', sha2(sha, 256)) else concat(sha2(sha, 256), '  ', sha2(repo_path, 256)) end").alias("line"))
    return edits.rewrite_pairs(lines)


NOTE = """select sha, concat('{"totals":{', case when n % 20 = 0 then concat('"added":', cast(added_lines as varchar(19)), ',"ai_lines":', cast(ai_lines as varchar(19))) else concat('"added_lines":0,"ai_lines":', cast(ai_lines as varchar(19)), ',"human_lines":', cast(human_lines as varchar(19))) end,
  ',"deleted":', cast(deleted_lines as varchar(19)), ',"later":1},"by_tool":{"claude":{"ai_lines":', cast(n % 7 as varchar(9)), '}}}') as note from (select t.*, c.n from totals_v t join commits_v c on c.sha = t.sha) x"""


@query("s22_note_source", "select t.sha, t.ai_lines, case when n % 20 = 0 then 0 else t.human_lines end as human_lines, case when n % 20 = 0 and t.added_lines = 0 then t.ai_lines when n % 20 = 0 then t.added_lines else t.ai_lines + t.human_lines end as added_lines, t.deleted_lines, n % 7 as claude from totals_v t join commits_v c on c.sha = t.sha")
def s22(t: Tables) -> DataFrame:
    parsed = notes.notes(t.sql(NOTE))
    return notes.note_totals(parsed).join(notes.note_tools(parsed).select("sha", c("lines").alias("claude")), "sha")


@query("s23_note_sink", "select sha, path, author_type, cast(count(*) as bigint) as n from attr_v where side = 'add' group by all")
def s23(t: Tables) -> DataFrame:
    """Documents written from ranges, read back and laid out by line."""
    from lineweave.operators import aggregate, diff

    ranges = windows.collapse_ranges(t.attr_v.where("side = 'add'"), ["sha", "path"], ["author_type", "tool", "model", "gen_type"])
    docs = aggregate.note_documents(t.attr_v, ranges)
    entry = "files array<struct<path: string, lines: array<struct<start_line: int, end_line: int, author_type: string>>>>"
    rows = docs.select("sha", F.explode(F.from_json("note", entry)["files"]).alias("f")).select("sha", "f.path", F.explode("f.lines").alias("l")).select("sha", "path", "l.*")
    return diff.range_lines(rows).groupBy("sha", "path", "author_type").agg(F.count("*").alias("n"))


@query("s24_working_log", "select sha, path as file, cast(line_no as int) as line_no, author_type, nullif(tool, '') as tool from attr_v where side = 'add'")
def s24(t: Tables) -> DataFrame:
    ranges = windows.collapse_ranges(t.attr_v.where("side = 'add'").withColumnRenamed("path", "file"), ["sha", "file"], ["author_type", "tool"])
    docs = notes.working_log_documents(ranges.withColumns({"base_sha": c("sha"), "model": F.lit(""), "gen_type": F.lit(""), "session": F.lit("")}), ["sha"])
    broken = docs.select("sha", F.lit("{no json").alias("log"))
    return notes.working_logs(docs.unionByName(broken), ["sha"]).select("sha", "file", "line_no", "author_type", "tool")


@query("s25_deletion_log", "select repo_path, file_path as file, content, arg_max(tool, e.id) as tool from edits_v e join edit_lines_v l on l.edit_id = e.id where l.line_no = 1 group by all")
def s25(t: Tables) -> DataFrame:
    rows = t.edits_v.join(t.edit_lines_v.where("line_no = 1").select(c("edit_id").alias("id"), "content"), "id")
    line = F.to_json(F.struct(c("file_path").alias("file"), "content", F.struct(F.lit("AI").alias("author"), "tool").alias("author")))
    return notes.deletions(rows.select("repo_path", "id", line.alias("line")), ["repo_path"], "id").select("repo_path", "file", "content", "tool")


@query("s26_changed_file_listing", "select id, case when id % 3 = 1 then 'src/new.go' else file_path end as path, id % 3 = 2 as deleted from edits_v where id % 5 <> 0")
def s26(t: Tables) -> DataFrame:
    name = F.expr("case when id % 5 = 0 then 'notes.bin' when id % 3 = 1 then concat(file_path, ' -> \"src/new.go\"') else file_path end")
    lines = t.edits_v.select("id", F.concat(F.expr("case id % 3 when 0 then ' M ' when 1 then 'R  ' else 'D  ' end"), name).alias("line"))
    return _by_id(lines)


def _by_id(lines: DataFrame) -> DataFrame:
    """The listing keeps no id, so each line goes through with its own number behind the name's directory."""
    marked = lines.select(F.regexp_replace("line", r"^(.. )(.* -> )?\"?", F.concat(F.lit("$1$2"), c("id").cast("string"), F.lit("@"))).alias("line"))
    got = edits.status_files(marked)
    return got.select(F.substring_index("path", "@", 1).cast("long").alias("id"), F.substring_index("path", "@", -1).alias("path"), "deleted")


@query("s27_exclude_rules", "select * from (values ('component', 'vendor'), ('glob', '*.lock'), ('anchored', 'build'), ('anywhere', 'gen/out'), ('component', 'repo0'), ('component', 'repo1'), ('component', 'repo2'), ('component', 'repo3')) v(kind, pattern)")
def s27(t: Tables) -> DataFrame:
    given = t.spark.createDataFrame([(x,) for x in ("# all", "", "!keep", "vendor/", "*.lock", "/build/", "gen/out", "  vendor  ")], "line string")
    return edits.exclude_rules(given.unionByName(t.edits_v.select(F.concat("repo_path", F.lit("/")).alias("line"))))
