"""Queries for windows, aggregates, orders and sets (W, A, O and U rows of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.operators import aggregate, joins, tables, windows
from lineweave.plans.registry import Tables, query

c = F.col
WHO = ["author_type", "tool", "model", "gen_type"]


@query("w01_match_priority", "select id, cast(row_number() over (partition by repo_path, file_path order by case confidence when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end desc, ts_ns desc, id) as int) as rank from edits_v")
def w01(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    from lineweave.operators.match import priority

    return t.edits_v.select("id", F.row_number().over(Window.partitionBy("repo_path", "file_path").orderBy(*priority())).alias("rank"))


@query("w02_latest_per_key", "select repo_path, file_path, arg_max(id, ts_ns) as id from edits_v group by all")
def w02(t: Tables) -> DataFrame:
    return tables.keep_latest(t.edits_v, ["repo_path", "file_path"], "ts_ns").select("repo_path", "file_path", "id")


RUNS = "select sha, path, {who} cast(min(line_no) as int) as start_line, cast(max(line_no) as int) as end_line from (select *, line_no - row_number() over (partition by sha, path, side, {who} 1 order by line_no) as g from attr_v) where side = 'add' group by sha, path, {who} g"


@query("w03_collapse_to_ranges", RUNS.format(who="author_type, tool, model, gen_type,"))
def w03(t: Tables) -> DataFrame:
    return windows.collapse_ranges(t.attr_v.where("side = 'add'"), ["sha", "path"], WHO)


@query("w04_coalesce_authors", "with x as (select *, case when line_no % 4 = 0 then tool else '' end as over, case when line_no > 3 then 's1' else 's0' end as session from attr_v where side = 'add'), y as (select *, line_no - row_number() over (partition by sha, path, author_type, tool, session, over order by line_no) as g from x) select sha, path, author_type, tool, session, over, cast(min(line_no) as int) as start_line, cast(max(line_no) as int) as end_line from y group by sha, path, author_type, tool, session, over, g")
def w04(t: Tables) -> DataFrame:
    rows = t.attr_v.where("side = 'add'").withColumns({"over": F.expr("case when line_no % 4 = 0 then tool else '' end"), "session": F.expr("case when line_no > 3 then 's1' else 's0' end")})
    return windows.collapse_ranges(rows, ["sha", "path"], ["author_type", "tool", "session", "over"])


BLANK = "select sha, path, line_no, case when line_no % 3 = 2 then '' else content end as content, case when line_no % 3 = 2 then 'Human' else author_type end as author_type, case when line_no % 3 = 2 then '' else tool end as tool, model, gen_type from attr_v where side = 'add'"


@query("w05_blank_line_inheritance", f"""
with b as ({BLANK}), i as (select *, line_no - row_number() over (partition by sha, path order by line_no) as g from b), n as (select *, coalesce(last_value(case when content <> '' then author_type end ignore nulls) over (partition by sha, path, g order by line_no rows between unbounded preceding and 1 preceding),
  first_value(case when content <> '' then author_type end ignore nulls) over (partition by sha, path, g order by line_no rows between 1 following and unbounded following)) as near_type from i)
select sha, path, line_no, case when content = '' and author_type <> 'AI' and near_type = 'AI' then 'AI' else author_type end as author_type from n""")
def w05(t: Tables) -> DataFrame:
    return windows.inherit_blank(t.sql(BLANK), ["sha", "path"]).select("sha", "path", "line_no", "author_type")


@query("w06_last_n_turns", "select session_id, turn, case when len(text) > 300 then substr(text, 1, 300) || '…' else text end as text from turns_v qualify row_number() over (partition by session_id order by turn desc) <= 3")
def w06(t: Tables) -> DataFrame:
    return windows.last_turns(t.turns_v.select("session_id", "turn", "text"), "session_id", "turn", 3)


@query("w07_rank_leaders", "select sha, tool, cast(row_number() over (partition by sha order by lines desc, tool) as int) as rank from tools_v")
def w07(t: Tables) -> DataFrame:
    return windows.ranked(t.tools_v, ["sha"], "lines", "tool").select("sha", "tool", "rank")


@query("w08_carry_model_forward", "select session_id, turn, last_value(nullif(model, '') ignore nulls) over (partition by session_id order by turn) as model from turns_v")
def w08(t: Tables) -> DataFrame:
    return windows.carry_forward(t.turns_v.withColumnRenamed("model", "m"), ["session_id"], "turn", "m", "model").select("session_id", "turn", "model")


@query("w09_pull_usage_back", "select session_id, turn, first_value(nullif(input_tokens, 0) ignore nulls) over (partition by session_id order by turn rows between current row and unbounded following) as next_input from turns_v")
def w09(t: Tables) -> DataFrame:
    return windows.pull_back(t.turns_v, ["session_id"], "turn", "input_tokens", "next_input").select("session_id", "turn", "next_input")


@query("w10_first_edit_gets_tokens", "select id, case when row_number() over (partition by session_id, ts_ns // 3600000000000 order by ts_ns, id) = 1 then input_tokens end as input_tokens from edits_v")
def w10(t: Tables) -> DataFrame:
    return windows.first_gets(t.edits_v.withColumn("turn", F.expr("ts_ns div 3600000000000")), ["session_id", "turn"], ["ts_ns", "id"], "input_tokens").select("id", "input_tokens")


@query("w11_seen_key_dedup", "select min(id) as id, tool, file_path, session_id from edits_v group by tool, file_path, session_id")
def w11(t: Tables) -> DataFrame:
    return windows.first_seen(t.edits_v.select("id", "tool", "file_path", "session_id"), ["tool", "file_path", "session_id"], "id")


@query("w12_previous_value", "select sha, ts_ns - prev_ns as gap_ns from windows_v")
def w12(t: Tables) -> DataFrame:
    return windows.previous_value(t.commits_v, ["repo_path"], "ts_ns", "before").select("sha", (c("ts_ns") - c("before")).alias("gap_ns"))


@query("w13_append_index", "select session_id, turn, cast(coalesce(sum(input_tokens) over (partition by session_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) as first_index from turns_v")
def w13(t: Tables) -> DataFrame:
    return windows.append_index(t.turns_v, ["session_id"], "turn", "input_tokens").select("session_id", "turn", "first_index")


@query("w14_share_of_total", "select sha, tool, round(lines * 1000.0 / greatest(sum(lines) over (partition by sha), 1)) / 10 as pct, round(lines * 1000.0 / greatest(max(lines) over (partition by sha), 1)) / 10 as width from tools_v")
def w14(t: Tables) -> DataFrame:
    return windows.shares(t.tools_v, ["sha"], "lines").select("sha", "tool", "pct", "width")


GEN = "case when author_type <> 'AI' then 'human' when gen_type in ('chat', 'cli', 'completion') then gen_type else 'unknown' end"
PIVOT = ", ".join(f"count(*) filter ({GEN} = '{g}') as {g}" for g in ("chat", "cli", "completion", "human", "unknown"))


@query("a01_added_line_totals", f"select sha, count(*) filter (author_type = 'AI') as ai_lines, count(*) filter (author_type <> 'AI') as human_lines, count(*) as added_lines, {PIVOT} from attr_v where side = 'add' group by sha")
def a01(t: Tables) -> DataFrame:
    return aggregate.added_totals(t.attr_v)


@query("a01_tool_totals", "select sha, tool, count(*) filter (side = 'add') as lines, count(*) filter (side = 'add') as accepted_lines, count(*) filter (side = 'del') as deleted_lines from attr_v where tool <> '' and (side = 'add' or author_type = 'AI') group by all")
def a01_tools(t: Tables) -> DataFrame:
    return aggregate.tool_totals(t.attr_v)


@query("a02_generation_type_totals", f"select sha, {PIVOT} from attr_v group by sha")
def a02(t: Tables) -> DataFrame:
    return aggregate.gen_type_totals(t.attr_v)


FILE_TOTALS = "select sha, path, cast(sum(case when side = 'add' and line_no <> 1 then 1 else 0 end) as bigint) as added, cast(sum(case when side = 'del' then 1 else 0 end) as bigint) as deleted from attr_v group by sha, path"


@query("a03_per_file_split", f"""with f as ({FILE_TOTALS}), g as (select sha, path, count(*) filter (author_type = 'AI' and side = 'add') as a, count(*) filter (author_type = 'AI' and side = 'del') as d from attr_v group by all)
select sha, path, least(a, added) as ai_added, added - least(a, added) as human_added, least(d, deleted) as ai_deleted, deleted - least(d, deleted) as human_deleted from f join g using (sha, path)""")
def a03(t: Tables) -> DataFrame:
    return aggregate.file_split(t.attr_v, t.sql(FILE_TOTALS))


@query("a04_deleted_totals", "select sha, count(*) as deleted_lines, count(*) filter (author_type = 'AI') as ai_deleted, count(*) filter (author_type <> 'AI') as human_deleted from attr_v where side = 'del' group by sha")
def a04(t: Tables) -> DataFrame:
    return aggregate.deleted_totals(t.attr_v)


WINDOWED = "select w.sha, e.* from edits_v e join windows_v w on e.repo_path = w.repo_path and e.ts_ns > w.prev_ns and e.ts_ns <= w.ts_ns + 5000000000"


@query("a05_token_totals_per_turn", f"""
with r as (select * from ({WINDOWED}) e where tool not in ('', 'human', 'copypaste') and greatest(coalesce(input_tokens, 0), coalesce(output_tokens, 0), coalesce(cache_read_tokens, 0), coalesce(cache_write_tokens, 0)) > 0 and exists (select 1 from tools_v t where t.sha = e.sha and t.tool = e.tool)
  qualify row_number() over (partition by sha, tool, ts_ns order by file_path, case confidence when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end desc, id) = 1)
select sha, tool, cast(sum(coalesce(input_tokens, 0)) as bigint) as input_tokens, cast(sum(coalesce(output_tokens, 0)) as bigint) as output_tokens, cast(sum(coalesce(cache_read_tokens, 0)) as bigint) as cache_read_tokens, cast(sum(coalesce(cache_write_tokens, 0)) as bigint) as cache_write_tokens from r group by all""")
def a05(t: Tables) -> DataFrame:
    return aggregate.token_totals(joins.in_window(t.edits_v, t.windows_v, ["repo_path"]), t.tools_v)


@query("a06_suggested_line_totals", f"select sha, tool, cast(sum(suggested_lines) as bigint) as suggested_lines from ({WINDOWED}) where suggested_lines > 0 group by all")
def a06(t: Tables) -> DataFrame:
    return aggregate.suggested_totals(joins.in_window(t.edits_v, t.windows_v, ["repo_path"]))


USAGE = "select t.sha, t.tool, concat('s', cast(x as varchar(9))) as session_id, t.ts_ns + x as ts_ns, case when x = 1 then '' else concat('u', cast(x as varchar(9))) end as model, t.lines + x as input_tokens, cast(x as bigint) as output_tokens from tools_v t cross join (select 1 as x union all select 2 union all select 3) y where x < 3 or t.tool = 'cursor'"


@query("a07_chat_session_usage_fold", f"""with u as (select sha, tool, cast(sum(input_tokens) as bigint) as i, cast(sum(output_tokens) as bigint) as o, arg_max(model, ts_ns) filter (model <> '') as m from ({USAGE}) group by all)
select sha, tool, coalesce(t.model, m) as model, t.input_tokens + coalesce(i, 0) as input_tokens, t.output_tokens + coalesce(o, 0) as output_tokens from tools_v t left join u using (sha, tool)""")
def a07(t: Tables) -> DataFrame:
    return aggregate.with_session_usage(t.tools_v, t.sql(USAGE))


PAIRS = "select concat('n', cast(n $div 30 as varchar(9))) as new, sha as old from commits_v"


@query("a08_source_note_token_merge", "select p.new as sha, t.tool, cast(sum(t.input_tokens) as bigint) as input_tokens, cast(sum(t.output_tokens) as bigint) as output_tokens from (select concat('n', cast(n // 30 as varchar)) as new, sha as old from commits_v) p join tools_v t on t.sha = p.old where t.tool = 'cursor' group by all")
def a08(t: Tables) -> DataFrame:
    pairs = t.sql(PAIRS)
    credited = pairs.select(c("new").alias("sha"), F.lit("cursor").alias("tool"))
    return aggregate.merged_source_tokens(pairs, t.tools_v.select("sha", "tool", "input_tokens", "output_tokens"), credited)


SUMS = ", ".join(f"cast(coalesce(sum({x}), 0) as bigint) as {x}" for x in ("added_lines", "deleted_lines", "ai_lines", "human_lines", "chat", "cli", "completion", "coding_ns"))


@query("a09_history_totals", f"select count(*) as commits, {SUMS}, min(ts_ns) as first_ns, max(ts_ns) as last_ns from totals_v")
def a09(t: Tables) -> DataFrame:
    return aggregate.history_totals(t.totals_v)


@query("a10_history_by_tool", "select tool, cast(sum(lines) as bigint) as lines, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens, arg_max(model, ts_ns) filter (model <> '') as model from tools_v group by tool having sum(lines) > 0")
def a10(t: Tables) -> DataFrame:
    return aggregate.history_by_tool(t.tools_v)


@query("a11_window_rollup", "select path, side, tool, grouping(path) * 4 + grouping(side) * 2 + grouping(tool) as level, count(*) as lines, count(*) filter (author_type = 'AI') as ai_lines from attr_v group by cube (path, side, tool)")
def a11(t: Tables) -> DataFrame:
    return aggregate.cube(t.attr_v, "path", "side", "tool")


@query("a12_coding_time", "select w.sha, cast(coalesce(max(w.ts_ns) - min(e.ts_ns), 0) as bigint) as coding_ns from windows_v w left join edits_v e on e.repo_path = w.repo_path and e.file_path <> '' and e.ts_ns > greatest(w.prev_ns, w.ts_ns - 28800000000000) and e.ts_ns <= w.ts_ns group by w.sha")
def a12(t: Tables) -> DataFrame:
    return aggregate.coding_time(t.windows_v, t.edits_v)


@query("a13_latest_usage_per_transcript", "select session_id, arg_max(model, turn) as model, arg_max(input_tokens, turn) as input_tokens, arg_max(output_tokens, turn) as output_tokens from turns_v where model <> '' and input_tokens + output_tokens > 0 group by session_id")
def a13(t: Tables) -> DataFrame:
    return aggregate.latest_usage(t.turns_v, ["session_id"], "turn")


@query("a14_usage_backfill", """
with a as (select distinct session_id, 'ra' as model, cast(7 as bigint) as i, cast(0 as bigint) as o from edits_v where cast(substr(session_id, 2) as int) % 3 = 0), b as (select distinct session_id, 'rb' as model, cast(8 as bigint) as i, cast(9 as bigint) as o from edits_v where cast(substr(session_id, 2) as int) % 2 = 0)
select e.id, e.session_id, coalesce(nullif(e.model, ''), a.model, b.model) as model, coalesce(e.input_tokens, case when a.session_id is not null then 7 when b.session_id is not null then 8 end) as input_tokens, coalesce(e.output_tokens, case when a.session_id is null and b.session_id is not null then 9 end) as output_tokens from edits_v e left join a using (session_id) left join b using (session_id)""")
def a14(t: Tables) -> DataFrame:
    n = F.expr("cast(substr(session_id, 2) as int)")
    reader = lambda keep, m, i, o: t.edits_v.where(keep).select("session_id").distinct().select("session_id", F.lit(m).alias("model"), F.lit(i).cast("long").alias("input_tokens"), F.lit(o).cast("long").alias("output_tokens"))
    edits = t.edits_v.select("id", "session_id", "model", "input_tokens", "output_tokens")
    return aggregate.backfilled_usage(edits, [reader(n % 3 == 0, "ra", 7, 0), reader(n % 2 == 0, "rb", 8, 9)])


@query("a15_session_usage_cumulative", "select session_id, tool, arg_max(id, ts_ns) as seen, max(ts_ns) as ts_ns from edits_v group by all")
def a15(t: Tables) -> DataFrame:
    return aggregate.cumulative_usage(t.edits_v.withColumn("seen", c("id")), ["session_id", "tool"], "ts_ns", ["seen"])


@query("a16_hash_multisets", "select edit_id, 'exact' as kind, content_sha as hash, count(*) as n from edit_lines_v group by all union all select edit_id, 'norm', content_sha_norm, count(*) from edit_lines_v group by all")
def a16(t: Tables) -> DataFrame:
    return aggregate.hash_counts(t.edit_lines_v)


@query("a17_dominant_generation_type", "select sha, tool, gen_type from (select sha, tool, gen_type, row_number() over (partition by sha, tool order by count(*) desc, gen_type) as k from attr_v where side = 'add' and tool <> '' and gen_type <> '' group by all) where k = 1".replace("select sha, tool, gen_type, row_number() over (partition by sha, tool order by count(*) desc, gen_type) as k from attr_v where side = 'add' and tool <> '' and gen_type <> '' group by all", "select sha, tool, gen_type, row_number() over (partition by sha, tool order by n desc, gen_type) as k from (select sha, tool, gen_type, count(*) as n from attr_v where side = 'add' and tool <> '' and gen_type <> '' group by all)"))
def a17(t: Tables) -> DataFrame:
    return aggregate.dominant_gen_type(t.attr_v)


@query("a18_file_tool_breakdown", "with n as (select sha, path, tool, count(*) as n from attr_v where side = 'add' and tool in ('claude', 'cursor', 'codex', 'copilot', 'gemini', 'human') group by all) select sha, path, string_agg(tool || ' ' || n, ' · ' order by list_position(['claude', 'cursor', 'codex', 'copilot', 'gemini', 'human'], tool)) as breakdown from n group by sha, path")
def a18(t: Tables) -> DataFrame:
    return aggregate.file_breakdown(t.attr_v)


@query("a19_leaderboard", """
with m as (select sha, model, count(*) as lines from attr_v where side = 'add' and author_type = 'AI' and model <> '' group by all), s as (select m.*, ai_deleted, ai_deleted * lines // sum(lines) over (partition by sha) as part, row_number() over (partition by sha order by model desc) = 1 as last from m join totals_v using (sha)),
r as (select sha, model as name, lines + case when last then ai_deleted - coalesce(sum(case when not last then part end) over (partition by sha), 0) else part end as lines, true as is_model, 0 as o from s),
tl as (select sha, tool as name, count(*) as lines, true as is_model, 0 as o from attr_v where author_type = 'AI' and tool <> '' and sha not in (select sha from m) group by all), x as (select sha, 'AI' as name, ai_deleted as lines, true as is_model, 0 as o from totals_v where ai_deleted > 0 and sha not in (select sha from r) and sha not in (select sha from tl)),
p as (select sha, 'Ann' as name, human_lines + human_deleted as lines, false as is_model, 1 as o from totals_v where human_lines + human_deleted > 0), u as (select * from r union all select * from tl union all select * from x union all select * from p)
select sha, cast(row_number() over (partition by sha order by lines desc, o, name) as int) as rank, name, cast(lines as bigint) as lines, is_model from u""")
def a19(t: Tables) -> DataFrame:
    tools = t.attr_v.where("author_type = 'AI' and tool <> ''").groupBy("sha", "tool").agg(F.count("*").alias("lines"))
    totals = t.totals_v.select("sha", F.lit("Ann").alias("author"), "human_lines", "deleted_lines", "ai_deleted")
    return aggregate.leaderboard(aggregate.model_totals(t.attr_v), tools, totals)


@query("a20_acceptance", "select sha, tool as top_tool, cast(least(floor(100 * accepted_lines / suggested_lines), 100) as bigint) as accepted_pct from tools_v where suggested_lines > 0 qualify row_number() over (partition by sha order by lines desc, tool) = 1")
def a20(t: Tables) -> DataFrame:
    return aggregate.acceptance(t.tools_v)


@query("a21_headline_shares", "select sha, ai_lines + ai_deleted as ai_touched, human_lines + human_deleted as human_touched, p as ai_pct, round((100 - p) * 10) / 10 as human_pct from (select *, round((ai_lines + ai_deleted) * 1000.0 / greatest(added_lines + deleted_lines, 1)) / 10 as p from totals_v)")
def a21(t: Tables) -> DataFrame:
    return aggregate.headline(t.totals_v)


@query("a23_model_rollup", "select model, count(*) as lines, cast(row_number() over (order by count(*) desc, model) as int) as rank from attr_v where side = 'add' and author_type = 'AI' and model <> '' group by model")
def a23(t: Tables) -> DataFrame:
    per = aggregate.model_totals(t.attr_v).groupBy("model").agg(F.sum("lines").alias("lines"))
    return windows.ranked(per, [], "lines", "model")


@query("a24_distinct_repos", "select distinct repo_path from edits_v where repo_path <> ''")
def a24(t: Tables) -> DataFrame:
    return aggregate.distinct_repositories(t.edits_v)


@query("a26_working_tree_note", "select file_path as path, count(*) as human_lines from added_v where sha = 'c0' group by 1")
def a26(t: Tables) -> DataFrame:
    """Uncommitted lines before any matching: all a person's, without a commit."""
    lines = t.added_v.where("sha = 'c0'").select(F.lit(None).cast("string").alias("sha"), c("file_path").alias("path"), F.lit("add").alias("side"), "line_no", F.lit("Human").alias("author_type"), F.lit("").alias("tool"), F.lit(None).cast("string").alias("model"), F.lit("human").alias("gen_type"))
    return lines.groupBy("path").agg(F.count(F.when(c("author_type") == "Human", 1)).alias("human_lines"))


@query("a27_commit_note_assembly", """
with s as (select sha, count(*) filter (side = 'add') as added_lines, count(*) filter (side = 'add' and author_type = 'AI') as ai_lines, string_agg(distinct path, ',' order by path) filter (side = 'add') as paths from attr_v group by sha),
l as (select sha, string_agg(tool || ':' || n, ',' order by tool) as tools from (select sha, tool, count(*) filter (side = 'add') as n from attr_v where tool <> '' and (side = 'add' or author_type = 'AI') group by all) group by sha)
select sha, added_lines, ai_lines, paths, tools from s join l using (sha)""")
def a27(t: Tables) -> DataFrame:
    """Notes as documents, read back for their fields."""
    from lineweave.sources import notes

    ranges = windows.collapse_ranges(t.attr_v.where("side = 'add'"), ["sha", "path"], WHO)
    n = notes.notes(aggregate.note_documents(t.attr_v, ranges)).where(F.size("n.by_tool") > 0)
    tools = F.array_join(F.transform(F.sort_array(F.map_entries("n.by_tool")), lambda e: F.concat_ws(":", e["key"], e["value"]["lines"].cast("string"))), ",")
    return n.select("sha", "n.totals.added_lines", "n.totals.ai_lines", F.array_join("n.files.path", ",").alias("paths"), tools.alias("tools"))


@query("o01_newest_commits", "select sha, ts_ns from commits_v where n % 20 = 0 and ts_ns >= 1704500000000000000 and repo_path in ('repo0', 'repo2')")
def o01(t: Tables) -> DataFrame:
    commits = t.commits_v.withColumn("note_written", F.expr("case when n % 20 = 0 then 1 else 0 end"))
    repos = t.commits_v.select("repo_path").where("repo_path in ('repo0', 'repo2')").distinct()
    return tables.newest(commits, repos, 1704500000000000000).select("sha", "ts_ns")


@query("o02_recent_session_usage", "select id, ts_ns from edits_v order by ts_ns desc, id limit 20")
def o02(t: Tables) -> DataFrame:
    return tables.recent(t.edits_v.select("id", "ts_ns"), "ts_ns", 0, "id")


@query("o03_top_one", "select tool, arg_max(id, ts_ns) as id from edits_v group by tool")
def o03(t: Tables) -> DataFrame:
    return t.edits_v.groupBy("tool").agg(F.max_by("id", "ts_ns").alias("id"))


@query("o04_ordered_prompts", "select session_id, turn, role from turns_v where role = 'user'")
def o04(t: Tables) -> DataFrame:
    return t.turns_v.where("role = 'user'").select("session_id", "turn", "role").orderBy("session_id", "turn")


@query("o05_incremental_read", "select id from edits_v where id > 500")
def o05(t: Tables) -> DataFrame:
    return tables.after(t.edits_v.select("id"), 500)


@query("o06_file_list_order", "select sha, string_agg(distinct path, ',' order by path) as files from attr_v group by sha")
def o06(t: Tables) -> DataFrame:
    return t.attr_v.groupBy("sha").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("files"))


@query("u01_union_of_sources", "select 'log' as source, id, tool, cast(null as varchar) as role from edits_v union all select 'chat', turn, null, role from turns_v")
def u01(t: Tables) -> DataFrame:
    return tables.union_all(t.edits_v.select(F.lit("log").alias("source"), "id", "tool"), t.turns_v.select(F.lit("chat").alias("source"), c("turn").cast("long").alias("id"), "role"))


@query("u02_distinct_targets", "select distinct repo_path, file_path from edits_v")
def u02(t: Tables) -> DataFrame:
    return t.edits_v.select("repo_path", "file_path").distinct()


@query("u03_set_equality", "with a as (select doc_id, list_sort(list(distinct content)) as l from old_v group by doc_id), b as (select doc_id, list_sort(list(distinct content)) as l from new_v where content not like '%  ' group by doc_id) select coalesce(a.doc_id, b.doc_id) as doc_id, a.l is not distinct from b.l as equal from a full join b on a.doc_id = b.doc_id")
def u03(t: Tables) -> DataFrame:
    return tables.equal_sets(t.old_v, t.new_v.where("content not like '%  '"), ["doc_id"], "content")


@query("u04_intersection", "select sha, file_path, cast(line_no as int) as line_no from added_v where line_no % 3 <> 0 intersect select sha, file_path, cast(line_no as int) from added_v where line_no % 2 = 0")
def u04(t: Tables) -> DataFrame:
    key = t.added_v.select("sha", "file_path", "line_no")
    return key.where("line_no % 3 <> 0").intersect(key.where("line_no % 2 = 0"))


@query("u05_difference", "select doc_id, content from old_v except all select doc_id, content from new_v")
def u05(t: Tables) -> DataFrame:
    return t.old_v.select("doc_id", "content").exceptAll(t.new_v.select("doc_id", "content"))


@query("u06_rename_source_exclusion", "select base_sha as sha, file from logs_v where n % 20 <> 0")
def u06(t: Tables) -> DataFrame:
    gone = t.logs_v.where("n % 20 = 0").select(c("base_sha").alias("sha"), c("file").alias("old"))
    files = t.logs_v.select(c("base_sha").alias("sha"), "file")
    return files.join(gone, (files["sha"] == gone["sha"]) & (files["file"] == gone["old"]), "left_anti")
