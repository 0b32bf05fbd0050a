"""Queries for column functions, rules and filters (P and F rows of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.functions import rules, shell, text
from lineweave.operators import diff, joins
from lineweave.plans.registry import ALIKE, Tables, query

c = F.col
RAW_PATH = "concat(case when id % 4 = 0 then ' ./' when id % 4 = 1 then '/' when id % 4 = 2 then '' else './' end, replace(file_path, '/', case when id % 3 = 0 then chr(92) else '/' end), case when id % 5 = 0 then ' ' else '' end)"


@query("p01_path_normalise", f"""select id, regexp_replace(replace(trim(raw), chr(92), '/'), '^\\./', '') as path,
  regexp_replace(regexp_replace(replace(trim(raw), chr(92), '/'), '^\\./', ''), '^/+', '') as log_path from (select id, {RAW_PATH} as raw from edits_v)""")
def p01(t: Tables) -> DataFrame:
    return t.edits_v.select("id", F.expr(RAW_PATH).alias("raw")).select("id", text.clean_path(c("raw")).alias("path"), text.clean_log_path(c("raw")).alias("log_path"))


@query("p02_whitespace_collapse", "select doc_id, pos, trim(regexp_replace(content, '\\s+', ' ', 'g')) as norm from drift_v")
def p02(t: Tables) -> DataFrame:
    return t.drift_v.select("doc_id", "pos", text.collapse_space(c("content")).alias("norm"))


@query("p03_whitespace_strip", "select doc_id, pos, regexp_replace(content, '\\s', '', 'g') as stripped from drift_v")
def p03(t: Tables) -> DataFrame:
    return t.drift_v.select("doc_id", "pos", text.strip_space(c("content")).alias("stripped"))


@query("p04_content_hash_pair", """select doc_id, pos, sha256(content) as sha, case when trim(content) = '' then '' else sha256(trim(regexp_replace(content, '\\s+', ' ', 'g'))) end as sha_norm from drift_v""")
def p04(t: Tables) -> DataFrame:
    return t.drift_v.select("doc_id", "pos", text.line_sha(F.concat("content", F.when(c("pos") % 2 == 0, "\r").otherwise(""))).alias("sha"), text.line_sha_norm(c("content")).alias("sha_norm"))


@query("p05_split_lines", """
with x as (select doc_id, case when doc_id % 3 = 0 then text || chr(10) when doc_id % 3 = 1 then replace(text, chr(10), chr(13) || chr(10)) else text end as t from documents),
y as (select doc_id, string_split(t, chr(10)) as a from x), z as (select doc_id, case when a[len(a)] = '' then a[1:len(a) - 1] else a end as a from y)
select doc_id, cast(unnest(range(len(a))) as int) as pos, regexp_replace(unnest(a), '\\r$', '') as content from z""")
def p05(t: Tables) -> DataFrame:
    raw = F.when(c("doc_id") % 3 == 0, F.concat("text", F.lit("\n"))).when(c("doc_id") % 3 == 1, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(c("text"))
    return diff.explode_lines(t.documents.select("doc_id", raw.alias("text")), "text", "doc_id")


@query("p06_author_class", "select id, case when tool in ('', 'human', 'copypaste') then 'Human' else 'AI' end as author_type from edits_v")
def p06(t: Tables) -> DataFrame:
    return t.edits_v.select("id", rules.author_type(c("tool")).alias("author_type"))


@query("p07_default_confidence", "select id, case when id % 3 = 0 then case when tool = 'copilot' then 'low' else 'high' end else confidence end as confidence from edits_v")
def p07(t: Tables) -> DataFrame:
    given = F.when(c("id") % 3 == 0, "").otherwise(c("confidence"))
    return t.edits_v.select("id", rules.default_confidence(given, c("tool")).alias("confidence"))


@query("p08_confidence_rank", "select id, case confidence when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end as rank from edits_v")
def p08(t: Tables) -> DataFrame:
    return t.edits_v.select("id", rules.confidence_rank(c("confidence")).alias("rank"))


@query("p09_generation_type_rules", """
select id, case when e in ('cli', 'sdk-ts') then 'cli' else 'chat' end as by_entrypoint, case when regexp_matches(lower(o), 'vscode|jetbrains|ide|extension') then 'chat' else 'cli' end as by_originator,
  coalesce(nullif(g, ''), case when s = '' then 'completion' else 'chat' end) as by_session, case when contains(lower(l), 'chat') then 'chat' else 'completion' end as by_line
from (select id, case id % 3 when 0 then 'cli' when 1 then 'sdk-ts' else 'web' end as e, case id % 4 when 0 then 'codex_VSCode' when 1 then 'JetBrains' when 2 then 'exec' else 'my-extension' end as o,
  case when id % 2 = 0 then '' else gen_type end as g, case when id % 5 = 0 then '' else session_id end as s, concat('panel/', case when id % 3 = 0 then 'Chat' else 'inline' end) as l from edits_v)""")
def p09(t: Tables) -> DataFrame:
    e = t.edits_v.selectExpr(
        "id", "case id % 3 when 0 then 'cli' when 1 then 'sdk-ts' else 'web' end as e", "case id % 4 when 0 then 'codex_VSCode' when 1 then 'JetBrains' when 2 then 'exec' else 'my-extension' end as o",
        "case when id % 2 = 0 then '' else gen_type end as g", "case when id % 5 = 0 then '' else session_id end as s", "concat('panel/', case when id % 3 = 0 then 'Chat' else 'inline' end) as l",
    )
    return e.select("id", rules.gen_type_of_entrypoint(c("e")).alias("by_entrypoint"), rules.gen_type_of_originator(c("o")).alias("by_originator"), rules.gen_type_or_completion(c("g"), c("s")).alias("by_session"), rules.gen_type_of_log_line(c("l")).alias("by_line"))


@query("p10_model_display_name", "select id, regexp_replace(case when id % 2 = 0 then 'vendor/' || model || '/x' else model end, '^[^/]*/', '') as model from edits_v")
def p10(t: Tables) -> DataFrame:
    return t.edits_v.select("id", text.model_name(F.when(c("id") % 2 == 0, F.concat(F.lit("vendor/"), "model", F.lit("/x"))).otherwise(c("model"))).alias("model"))


MODELS = "case id % 9 when 0 then 'Opus-4' when 1 then 'gpt-5' when 2 then 'o3-mini' when 3 then 'foo-o3' when 4 then 'Gemini-pro' when 5 then 'composer-1' when 6 then 'copilot-x' when 7 then 'codex-1' else 'llama' end"


@query("p11_model_to_tool", f"""select id, case when regexp_matches(lower(m), 'claude|opus|sonnet|haiku') then 'claude' when regexp_matches(lower(m), 'composer|cursor') then 'cursor' when contains(lower(m), 'gemini') then 'gemini'
  when contains(lower(m), 'copilot') then 'copilot' when regexp_matches(lower(m), 'gpt|codex|^o[134]') then 'codex' else '' end as tool from (select id, {MODELS} as m from edits_v)""")
def p11(t: Tables) -> DataFrame:
    return t.edits_v.select("id", rules.tool_of_model(F.expr(MODELS)).alias("tool"))


PATHS = "concat(case id % 4 when 0 then 'vendor/' when 1 then 'src/' when 2 then 'a/gen/out/' else './build/' end, 'f', cast(id % 50 as varchar(9)), case when id % 3 = 0 then '.min.js' when id % 3 = 1 then '.py' else '.lock' end)"


@query("p12_exclude_match", f"""select distinct path from (select path, regexp_replace(path, '^\\./', '') as p from (select {PATHS} as path from edits_v))
where list_contains(string_split(p, '/'), 'vendor') or regexp_matches(list_extract(string_split(p, '/'), -1), '^[^/]*\\.lock$') or p = 'build' or starts_with(p, 'build/') or contains('/' || p || '/', '/gen/out/')""")
def p12(t: Tables) -> DataFrame:
    files = t.edits_v.select(F.expr(PATHS).alias("path"))
    return joins.excluded(files, t.spark.createDataFrame([("component", "vendor"), ("glob", "*.lock"), ("anchored", "build"), ("anywhere", "gen/out")], "kind string, pattern string"))


@query("p13_file_operation_match", """
with f as (select distinct repo_path, file_path as path from edits_v), t as (select distinct repo_path, case cast(substr(repo_path, 5) as int) when 0 then 'src/f1.py' when 1 then 'other/f2.py' when 2 then 'f*.py' else 'src/f?.p' end as target from edits_v)
select f.repo_path, path, target from f join t on f.repo_path = t.repo_path where case when regexp_matches(target, '[*?]') then regexp_matches(path, '^' || replace(replace(replace(target, '.', '\\.'), '*', '[^/]*'), '?', '[^/]') || '$')
  or regexp_matches(list_extract(string_split(path, '/'), -1), '^' || replace(replace(replace(target, '.', '\\.'), '*', '[^/]*'), '?', '[^/]') || '$')
  else path = target or list_extract(string_split(path, '/'), -1) = list_extract(string_split(target, '/'), -1) end""")
def p13(t: Tables) -> DataFrame:
    files = t.edits_v.select("repo_path", c("file_path").alias("path")).distinct()
    targets = t.edits_v.selectExpr("repo_path", "case cast(substr(repo_path, 5) as int) when 0 then 'src/f1.py' when 1 then 'other/f2.py' when 2 then 'f*.py' else 'src/f?.p' end as target").distinct()
    return joins.file_operations(files, targets, ["repo_path"])


COMMAND = "concat(case id % 5 when 0 then 'cat a > ' when 1 then 'echo x >> \"' when 2 then 'rm -f ' when 3 then 'git rm ' else 'make 2> ' end, file_path, case when id % 5 = 1 then '\"' else '' end, case when id % 2 = 0 then ' && ls' else '' end)"


@query("p14_shell_redirect_targets", f"select id, case when id % 5 = 0 then file_path else '' end as targets from edits_v")  # noqa: F541
def p14(t: Tables) -> DataFrame:
    return t.edits_v.select("id", F.array_join(shell.write_targets(F.expr(COMMAND)), ",").alias("targets"))


@query("p15_shell_delete_targets", "select id, case when id % 5 in (2, 3) then file_path else '' end as targets from edits_v")
def p15(t: Tables) -> DataFrame:
    return t.edits_v.select("id", F.array_join(shell.delete_targets(F.expr(COMMAND)), ",").alias("targets"))


@query("p16_timestamp_parse", """select id, case when id % 7 = 0 then 0 else (epoch_us(ts) // 1000000) * 1000000000 + (case when id % 3 = 0 then 0 when id % 3 = 1 then 123000000 else 123456789 end) - case when id % 2 = 0 then 0 else 7200000000000 end end as ts_ns
from (select event_id as id, ts from events)""")
def p16(t: Tables) -> DataFrame:
    stamp = F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.when(c("id") % 3 == 0, "").when(c("id") % 3 == 1, ".123").otherwise(".123456789")
    zone = F.when(c("id") % 2 == 0, "Z").otherwise("+02:00")
    raw = F.when(c("id") % 7 == 0, "yesterday").otherwise(F.concat(stamp, part, zone))
    return t.events.select(c("event_id").alias("id"), "ts").select("id", text.to_nanos(raw).alias("ts_ns"))


@query("p17_meta_field_extract", "select id, json_extract_string(raw_meta, '$.session_id') as session_id, json_extract_string(raw_meta, '$.tool') as meta_tool, json_extract_string(raw_meta, '$.source') as source from edits_v")
def p17(t: Tables) -> DataFrame:
    return t.edits_v.select("id", *[rules.meta(c("raw_meta"), k).alias(n) for k, n in (("session_id", "session_id"), ("tool", "meta_tool"), ("source", "source"))])


@query("p18_whole_file_write_flag", "select id, coalesce(lower(json_extract_string(raw_meta, '$.tool')) in ('write', 'create_file', 'createfile', 'create_new_file'), false) as flag from edits_v")
def p18(t: Tables) -> DataFrame:
    return t.edits_v.select("id", rules.is_whole_file_write(c("raw_meta")).alias("flag"))


@query("p19_tab_log_flag", "select id, tool = 'cursor' and coalesce(json_extract_string(raw_meta, '$.source') = 'cursor_tab_log', false) as flag from edits_v")
def p19(t: Tables) -> DataFrame:
    return t.edits_v.select("id", rules.is_tab_log(c("tool"), c("raw_meta")).alias("flag"))


@query("p20_accepted_lines", "select id, cast(case when k % 4 = 0 then 0 else k % 4 end + (k % 3) + 1 as bigint) as accepted from edits_v")
def p20(t: Tables) -> DataFrame:
    one = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    ranges = F.array(one(F.lit(5), c("k") % 4 + 4), one(F.lit(10), c("k") % 3 + 10), one(F.lit(9), F.lit(3)))
    return t.edits_v.select("id", rules.accepted_lines(ranges).alias("accepted"))


@query("p23_uri_to_path", "select id, case when id % 2 = 0 then '/home/a b/' else 'C:/x+y/' end || file_path as path from edits_v")
def p23(t: Tables) -> DataFrame:
    uri = F.concat(F.when(c("id") % 2 == 0, "file:///home/a%20b/").otherwise("file:///C:/x+y/"), "file_path")
    return t.edits_v.select("id", text.uri_to_path(uri).alias("path"))


@query("p24_line_similarity", f"with p as (select doc_id, pos, content as a, case pos % 4 when 0 then replace(content, ' ', '  ') when 1 then substr(content, 1, 20) || 'zzz' when 2 then 'qq' || content else '' end as b from doc_lines_v) select doc_id, cast(pos as int) as pos, {ALIKE} as alike from p")
def p24(t: Tables) -> DataFrame:
    other = F.expr("case pos % 4 when 0 then replace(content, ' ', '  ') when 1 then concat(substr(content, 1, 20), 'zzz') when 2 then concat('qq', content) else '' end")
    return t.doc_lines_v.select("doc_id", "pos", text.similar(c("content"), other).alias("alike"))


@query("p25_rounded_share", "select sha, round(ai_lines * 1000.0 / case when added_lines = 0 then 1 else added_lines end) / 10 as pct from totals_v")
def p25(t: Tables) -> DataFrame:
    return t.totals_v.select("sha", text.share(c("ai_lines"), c("added_lines")).alias("pct"))


SHA40 = "concat(repeat('0', 40 - length(cast(n as varchar(19)))), cast(n as varchar(19)))"


@query("p26_replay_kind", f"select sha, case n % 40 when 0 then 'cherry_pick' when 10 then 'squash_merge' end as kind, case n % 40 when 0 then {SHA40} when 10 then {SHA40} || ',' || {SHA40} end as shas from commits_v")
def p26(t: Tables) -> DataFrame:
    message = F.expr(f"case n % 40 when 0 then concat('fix\n\n(cherry picked from commit ', {SHA40}, ')') when 10 then concat('Squashed commit of the following:\n\ncommit ', {SHA40}, '\nAuthor: a\n\ncommit ', {SHA40}, '\n') when 20 then concat('see commit ', {SHA40}) else 'work' end")
    return t.commits_v.select("sha", rules.replay_of_message(message).alias("r")).select("sha", "r.kind", F.array_join("r.shas", ",").alias("shas"))


@query("p28_count_lines", "select doc_id, cast(case when t = '' then 0 else len(t) - len(replace(t, chr(10), '')) + case when ends_with(t, chr(10)) then 0 else 1 end end as int) as n from (select doc_id, case when doc_id % 3 = 0 then text || chr(10) when doc_id % 3 = 1 then '' else text end as t from documents)")
def p28(t: Tables) -> DataFrame:
    raw = F.when(c("doc_id") % 3 == 0, F.concat("text", F.lit("\n"))).when(c("doc_id") % 3 == 1, "").otherwise(c("text"))
    return t.documents.select("doc_id", text.count_lines(raw).alias("n"))


@query("p30_object_id_shape", "select id, regexp_full_match(s, '[0-9a-f]{40}|[0-9a-f]{64}') as is_id from (select id, case id % 4 when 0 then sha256(file_path) when 1 then substr(sha256(file_path), 1, 40) when 2 then upper(sha256(file_path)) else 'main' end as s from edits_v)")
def p30(t: Tables) -> DataFrame:
    return t.edits_v.select("id", text.is_object_id(F.expr("case id % 4 when 0 then sha2(file_path, 256) when 1 then substr(sha2(file_path, 256), 1, 40) when 2 then upper(sha2(file_path, 256)) else 'main' end")).alias("is_id"))


NAMES = "case id % 8 when 0 then 'Bash' when 1 then 'apply_patch' when 2 then 'create_file' when 3 then 'replace_string_in_file' when 4 then 'insert_edit_into_file' when 5 then 'Write' when 6 then 'exec_command' else 'Read' end"


@query("p31_tool_kind_flags", "select id, case id % 8 when 0 then 'shell' when 1 then 'patch' when 2 then 'create' when 3 then 'replace' when 4 then 'insert' when 5 then 'write' when 6 then 'shell' else 'other' end as kind from edits_v")
def p31(t: Tables) -> DataFrame:
    return t.edits_v.select("id", rules.tool_kind(F.expr(NAMES)).alias("kind"))


@query("f01_half_open_window", "select e.id, w.sha from edits_v e join windows_v w on e.repo_path = w.repo_path and e.ts_ns > w.prev_ns and e.ts_ns <= w.ts_ns + 5000000000")
def f01(t: Tables) -> DataFrame:
    return joins.in_window(t.edits_v, t.windows_v, ["repo_path"]).select("id", "sha")


@query("f02_edits_since", "select e.id from edits_v e where repo_path = 'repo1' and file_path = 'src/f1.py' and ts_ns >= 1704500000000000000")
def f02(t: Tables) -> DataFrame:
    return t.edits_v.where((c("repo_path") == "repo1") & (c("file_path") == "src/f1.py") & (c("ts_ns") >= 1704500000000000000)).select("id")


@query("f03_eligible_ai_edits", "select id from edits_v where tool not in ('', 'human', 'copypaste') and (tool = 'cursor' or not coalesce(lower(json_extract_string(raw_meta, '$.tool')) in ('write', 'create_file', 'createfile', 'create_new_file'), false))")
def f03(t: Tables) -> DataFrame:
    return t.edits_v.where(rules.ai_eligible(c("tool"), c("raw_meta"))).select("id")


@query("f04_eligible_paste_and_tab", "select id, case when tool = 'copypaste' then 'paste' else 'tab' end as kind from edits_v where tool = 'copypaste' or (tool = 'cursor' and json_extract_string(raw_meta, '$.source') = 'cursor_tab_log')")
def f04(t: Tables) -> DataFrame:
    paste, tab = rules.paste_eligible(c("tool")), rules.is_tab_log(c("tool"), c("raw_meta"))
    return t.edits_v.where(paste | tab).select("id", F.when(paste, "paste").otherwise("tab").alias("kind"))


@query("f05_live_rows", "select id from edits_v where id % 3 <> 0")
def f05(t: Tables) -> DataFrame:
    return t.edits_v.withColumn("deleted_at", F.when(c("id") % 3 == 0, c("ts_ns"))).where(c("deleted_at").isNull()).select("id")


@query("f06_conversation_filter", "select session_id, turn, role from turns_v where role <> 'assistant'")
def f06(t: Tables) -> DataFrame:
    settings = t.spark.createDataFrame([(True, True, False)], "conversation boolean, user boolean, assistant boolean")
    keep = c("conversation") & F.when(c("role") == "user", c("user")).when(c("role") == "assistant", c("assistant")).otherwise(True)
    return t.turns_v.crossJoin(F.broadcast(settings)).where(keep).select("session_id", "turn", "role")


@query("f07_note_section_strip", "select sha, ai_lines, human_lines, cast(null as bigint) as coding_ns from totals_v")
def f07(t: Tables) -> DataFrame:
    settings = t.spark.createDataFrame([(False,)], "time boolean")
    return t.totals_v.crossJoin(F.broadcast(settings)).select("sha", "ai_lines", "human_lines", F.when(c("time"), c("coding_ns")).alias("coding_ns"))


@query("f08_liveness_filter", "select id from edits_v where (id % 300) * 1000000000 <= 120000000000")
def f08(t: Tables) -> DataFrame:
    arrived = t.edits_v.withColumn("arrival_ns", c("ts_ns") + (c("id") % 300) * 1_000_000_000)
    return arrived.where(c("arrival_ns") - c("ts_ns") <= 2 * joins.MINUTE).select("id")


@query("f09_write_window", """
with cmd as (select n as command_id, repo_path, ts_ns - (n % 7) * 60000000000 as start_ns, ts_ns as end_ns from commits_v), g as (
  select c.command_id, c.repo_path, e.file_path, e.ts_ns as mtime_ns, count(*) over (partition by c.command_id) as cnt from cmd c join edits_v e on c.repo_path = e.repo_path and e.ts_ns <= c.end_ns
  and e.ts_ns >= c.end_ns - least(greatest(c.end_ns - c.start_ns, 0) + 15000000000, 600000000000))
select command_id, repo_path, file_path, mtime_ns from g where cnt <= 30""")
def f09(t: Tables) -> DataFrame:
    commands = t.commits_v.selectExpr("n as command_id", "repo_path", "ts_ns - (n % 7) * 60000000000 as start_ns", "ts_ns as end_ns")
    return joins.write_window(commands, t.edits_v.select("repo_path", "file_path", c("ts_ns").alias("mtime_ns")))


@query("f10_baseline_candidates", """
with ch as (select distinct cast(id $div 20 as bigint) as command_id, file_path || cast(id % 5 as varchar) as file_path from edits_v), wr as (select distinct cast(id $div 20 as bigint) as command_id, file_path || cast(id % 5 as varchar) as file_path from edits_v where id % 3 = 0),
r as (select ch.*, count(*) over (partition by command_id) as n from ch where not exists (select 1 from wr where wr.command_id = ch.command_id and wr.file_path = ch.file_path))
select command_id, file_path from r where n <= 8 and file_path not like '%f1.py0'""")
def f10(t: Tables) -> DataFrame:
    e = t.edits_v.selectExpr("id", "id div 20 as command_id", "concat(file_path, id % 5) as file_path")
    changed, written = e.select("command_id", "file_path").distinct(), e.where("id % 3 = 0").select("command_id", "file_path")
    tracked = e.where("file_path like '%f1.py0'").select("file_path")
    return joins.baseline_candidates(changed, written, tracked, ["command_id"], 8).select("command_id", "file_path")


@query("f11_contributing_tools", "select e.id, w.sha from edits_v e join windows_v w on e.repo_path = w.repo_path and e.ts_ns > w.prev_ns and e.ts_ns <= w.ts_ns + 5000000000 where exists (select 1 from tools_v t where t.sha = w.sha and t.tool = e.tool)")
def f11(t: Tables) -> DataFrame:
    return joins.in_window(t.edits_v, t.windows_v, ["repo_path"]).join(t.tools_v.select("sha", "tool"), ["sha", "tool"], "left_semi").select("id", "sha")


@query("f12_changed_line_restriction", """
select a.sha, a.path, a.line_no, case when o.line_no is not null then 'AI' else a.author_type end as author_type from attr_v a left join (select distinct sha, path, line_no from attr_v where side = 'add' and line_no % 4 = 0) o on a.sha = o.sha and a.path = o.path and a.line_no = o.line_no
where a.side = 'add' and a.line_no % 2 = 0""")
def f12(t: Tables) -> DataFrame:
    key = ["sha", "path", "line_no"]
    lines = t.attr_v.where("side = 'add'").select(*key, "author_type")
    changed, over = lines.where("line_no % 2 = 0").select(*key), lines.where("line_no % 4 = 0").select(*key, F.lit("AI").alias("_o"))
    return lines.join(changed, key, "left_semi").join(over, key, "left").select(*key, F.coalesce("_o", "author_type").alias("author_type"))
