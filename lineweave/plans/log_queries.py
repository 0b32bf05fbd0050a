"""Queries for readers of tools' logs (S04 to S17). Logs are written from the tables in each tool's form, then read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.plans.registry import Tables, query
from lineweave.sources import logs, tail
from lineweave.streaming import streams

c = F.col
KEY = ["session_id"]


def json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def lines(df: DataFrame, line: Column, pos: str | Column = "turn", *keys: str) -> DataFrame:
    """Raw lines, with some that are no JSON among them."""
    where = c(pos) if isinstance(pos, str) else pos
    return df.select(*(keys or KEY), where.alias("pos"), line.alias("line"))


def with_noise(df: DataFrame) -> DataFrame:
    noise = df.where("pos % 3 = 0").withColumn("line", F.lit("{broken")).unionByName(df.where("pos % 3 = 1").withColumn("line", F.lit("plain text")))
    return df.unionByName(noise)


@query("s04_assistant_transcript", "select session_id, turn as pos, role, text, ts_ns, nullif(model, '') as model, case when role = 'assistant' then input_tokens end as input_tokens from turns_v")
def s04(t: Tables) -> DataFrame:
    """Both shapes: role under ``type`` with an array of blocks, or under ``role`` with a plain text."""
    return logs.transcript(with_noise(transcripts(t)), KEY).select("session_id", "pos", "role", "text", "ts_ns", "model", "input_tokens")


def transcripts(t: Tables) -> DataFrame:
    stamp = F.date_format(F.timestamp_seconds(c("ts_ns") / 1_000_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    blocks = F.array(F.struct(F.lit("tool").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("text").alias("type"), F.lit("").alias("text")), F.struct(F.lit("text").alias("type"), c("text").alias("text")))
    said = F.col("role") == "assistant"
    usage = F.when(said, F.struct("input_tokens", "output_tokens"))
    model = F.nullif("model", F.lit(""))
    a = json(type=c("role"), sessionId=c("session_id"), timestamp=stamp, message=F.struct(blocks.alias("content"), model.alias("model"), usage.alias("usage")))
    b = json(role=c("role"), sessionId=c("session_id"), timestamp=stamp, message=F.struct(c("text").alias("content"), model.alias("model"), usage.alias("usage")))
    return lines(t.turns_v, F.when(c("turn") % 2 == 0, a).otherwise(b))


@query("s04_transcript_files", "select session_id, cast(row_number() over (partition by session_id order by turn) as int) as nth, role, text, ts_ns, nullif(model, '') as model from turns_v")
def s04_files(t: Tables) -> DataFrame:
    """Transcripts in rolled files of many sessions, that are read in ranges of bytes; a line names its session, its place orders the file."""
    at = streams.folder(t.spark, "transcripts")
    raw = with_noise(transcripts(t)).repartition("session_id").sortWithinPartitions("session_id", "pos")
    raw.select("line").write.text(at)
    read = tail.read_lines(t.spark, at, 1 << 22).withColumn("session_id", F.get_json_object("line", "$.sessionId"))
    turns = logs.transcript(read, KEY)
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("pos")).cast("int")
    return turns.select("session_id", nth.alias("nth"), "role", "text", "ts_ns", "model")


SESSION = "select *, case when turn % 4 = 0 then concat('g', cast(turn as varchar(9))) else '' end as named, case when turn % 3 = 2 then turn + 1 else 0 end as used from turns_v"


@query("s05_cli_session_log", f"select session_id, turn as pos, last_value(nullif(named, '') ignore nulls) over w as model, cast(first_value(nullif(used, 0) ignore nulls) over (partition by session_id order by turn rows between current row and unbounded following) as bigint) as input_tokens from ({SESSION}) window w as (partition by session_id order by turn)")
def s05(t: Tables) -> DataFrame:
    model, used = F.nullif("named", F.lit("")), F.when(c("used") > 0, F.struct(c("used").alias("input_tokens"), F.lit(0).alias("output_tokens")))
    flat = json(type=F.lit("event"), model=model, usage=used)
    wrapped = json(type=F.lit("event_msg"), payload=F.struct(F.lit("token_count").alias("type"), model.alias("model"), F.struct(used.alias("last_token_usage")).alias("info")))
    raw = lines(t.sql(SESSION), F.when(c("turn") % 2 == 0, flat).otherwise(wrapped))
    return logs.session_log(with_noise(raw), KEY).select("session_id", "pos", "model", "input_tokens")


# Of each commit one file's whole text: its lines go with "old " before them and come as they are.
PATCH = "select c.sha, c.n, l.pos, l.content from commit_docs_v c join doc_lines_v l on l.doc_id = c.doc_id where c.f = 0"


def patches(t: Tables) -> DataFrame:
    lines = F.transform(F.sort_array(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"])
    return t.sql(PATCH).groupBy("sha", "n").agg(lines.alias("lines"))


def marked(before: str) -> Column:
    return F.array_join(F.transform("lines", lambda x: F.concat(F.lit(before), x)), "\n")


@query("s06_patch_apply_explode", f"""with p as (select sha, n, string_agg(content, '|' order by pos) as new, string_agg('old ' || content, '|' order by pos) as old from ({PATCH.replace("$div", "//")}) where n % 30 <> 0 group by sha, n)
select sha, 'src/a.py' as path, 'add' as change, new as added, '' as removed from p union all select sha, 'src/u.py', 'update', new, old from p union all select sha, 'src/d.py', 'delete', '', new from p""")
def s06(t: Tables) -> DataFrame:
    change = lambda kind, content=None, diff=None: F.struct(F.lit(kind).alias("type"), (content if content is not None else F.lit(None).cast("string")).alias("content"), (diff if diff is not None else F.lit(None).cast("string")).alias("unified_diff"))
    whole, n = F.concat(marked(""), F.lit("\n")), F.size("lines")
    diff = F.concat(F.lit("--- a\n+++ b\n@@ -1,"), n, F.lit(" +1,"), n, F.lit(" @@\n"), marked("-old "), F.lit("\n"), marked("+"))
    changes = F.create_map(F.lit("src/a.py"), change("add", whole), F.lit("./src/u.py"), change("update", None, diff), F.lit("src/d.py"), change("delete", whole), F.lit("src/none.py"), change("update", None, F.lit("@@ -1 +1 @@\n same")))
    payload = json(type=F.lit("patch_apply_end"), success=c("n") % 30 != 0, changes=changes)
    raw = patches(t).select("sha", c("n").alias("pos"), json(type=F.lit("event_msg"), payload=F.from_json(payload, "type string, success boolean, changes map<string, struct<type: string, content: string, unified_diff: string>>")).alias("line"))
    got = logs.patch_edits(logs.session_log(raw, ["sha"]), ["sha"])
    return got.select("sha", "path", "change", F.array_join("added", "|").alias("added"), F.array_join("removed", "|").alias("removed"))


@query("s07_patch_envelope_parse", f"""with p as ({PATCH.replace("$div", "//")}) select sha, 'src/x.py' as path, 'update' as op, '-' as sign, cast(pos + 1 as int) as n, sha256('old ' || content) as content_sha from p union all select sha, 'src/x.py', 'update', '+', cast(pos + 1 as int), sha256(content) from p
union all select sha, 'src/n.py', 'add', '+', cast(pos + 1 as int), sha256(content) from p union all select distinct sha, 'src/old.py', 'delete', '', 0, '' from p""")
def s07(t: Tables) -> DataFrame:
    text = F.concat(F.lit("*** Begin Patch\n*** Update File: ./src/x.py\n@@ def f\n same\n"), marked("-old "), F.lit("\n"), marked("+"), F.lit("\n+\n*** Delete File: src/old.py\n*** Add File: src/n.py\n+  \n"), marked("+"), F.lit("\n*** End Patch"))
    return logs.patch_envelope(patches(t).select("sha", text.alias("patch")), "patch", "sha").select("sha", "path", "op", "sign", "n", "content_sha")


@query("s08_chat_delta_replay", """
with u as (select session_id, text, ts_ns, row_number() over (partition by session_id order by turn) - 1 as request from turns_v where role = 'user')
select session_id, cast(request as int) as request, text as user_text, 'ab' as assistant_text, ts_ns // 1000000 as ts_ms, case when request % 2 = 0 then 'v/new' else 'v/old' end as model, request + 5 as prompt_tokens from u""")
def s08(t: Tables) -> DataFrame:
    """A snapshot with the first request of each session, appended ones, and later sets of model and usage."""
    u = t.sql("select session_id, text, ts_ns, cast(row_number() over (partition by session_id order by turn) - 1 as int) as request from turns_v where role = 'user'")
    parts = F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit("a").alias("value")), F.struct(F.lit("thinking").alias("kind"), F.lit("zz").alias("value")), F.struct(F.lit(None).cast("string").alias("kind"), F.lit("b").alias("value")))
    request = F.struct(F.concat("session_id", F.lit("-"), "request").alias("requestId"), F.expr("ts_ns div 1000000").alias("timestamp"), F.lit("v/old").alias("modelId"), F.struct(c("text").alias("text")).alias("message"), parts.alias("response"))
    none = F.lit(None).cast("array<string>")
    first = json(kind=F.lit(0), k=none, v=F.struct(F.array(request).alias("requests")))
    append = json(kind=F.lit(2), k=F.array(F.lit("requests")), v=F.array(request))
    path = lambda name: F.array(F.lit("requests"), c("request").cast("string"), F.lit(name))
    model = json(kind=F.lit(1), k=path("modelId"), v=F.lit("v/new"))
    usage = json(kind=F.lit(1), k=path("result"), v=F.struct(F.struct((c("request") + 5).alias("promptTokens")).alias("metadata")))
    rows = F.array(F.when(c("request") == 0, first).otherwise(append), F.when(c("request") % 2 == 0, model), usage)
    raw = u.select("session_id", "request", F.posexplode(rows).alias("k", "line")).where("line is not null").select("session_id", (c("request") * 10 + c("k")).alias("pos"), "line")
    return logs.chat_requests(raw, KEY).select("session_id", "request", "user_text", "assistant_text", "ts_ms", "model", "prompt_tokens")


@query("s09_text_edit_groups", "select session_id, cast(turn as int) as request, '/w s/f.py' as file, 3 as start_line, 4 as end_line, text as content from turns_v where role = 'assistant' and turn % 3 <> 0")
def s09(t: Tables) -> DataFrame:
    edit = F.struct(c("text").alias("text"), F.struct(F.lit(3).alias("startLineNumber"), F.lit(4).alias("endLineNumber")).alias("range"))
    group = lambda done, scheme: F.struct(F.lit("textEditGroup").alias("kind"), done.alias("done"), F.struct(F.lit(scheme).alias("scheme"), F.lit("/w%20s/f.py").alias("path")).alias("uri"), F.array(F.array(edit)).alias("edits"))
    line = json(kind=F.lit(2), k=F.array(F.lit("requests"), c("turn").cast("string"), F.lit("response")), v=F.array(group(c("turn") % 3 != 0, "file"), group(F.lit(True), "untitled")))
    raw = lines(t.turns_v.where("role = 'assistant'"), line)
    return logs.text_edit_groups(raw.unionByName(raw), KEY)


@query("s10_cli_usage_events", "select session_id, arg_max(model, turn) as model, arg_max(output_tokens, turn) filter (output_tokens > 0) as output_tokens, cast(max(turn) as bigint) as total from turns_v where role = 'assistant' group by session_id")
def s10(t: Tables) -> DataFrame:
    said = t.turns_v.where("role = 'assistant'")
    one = json(type=F.lit("assistant.usage"), data=F.struct("model", c("output_tokens").alias("outputTokens")))
    end = json(type=F.lit("session.shutdown"), data=F.struct(F.create_map(F.lit("m"), F.struct(c("turn").cast("long").alias("inputTokens"), F.lit(1).cast("long").alias("outputTokens"))).alias("modelMetrics")))
    raw = lines(said, one, c("turn") * 2).unionByName(lines(said, end, c("turn") * 2 + 1))
    got = logs.usage_events(with_noise(raw), KEY)
    return got.select("session_id", "model", "output_tokens").join(logs.shutdown_usage(got, KEY).select("session_id", c("input_tokens").alias("total")), "session_id")


@query("s11_usage_metadata", "select session_id, arg_max(model, turn) as model, cast(0 as bigint) as input_tokens, cast(max(turn) + 100 as bigint) as output_tokens from turns_v where role = 'assistant' group by session_id")
def s11(t: Tables) -> DataFrame:
    line = json(model=c("model"), usageMetadata=F.struct((c("turn") + 100).alias("totalTokenCount")))
    return logs.usage_metadata(lines(t.turns_v.where("role = 'assistant'"), line), KEY)


@query("s12_agent_step_transcript", """
select session_id, turn as step_index, 'src/w.py' as path, 'create' as op from turns_v where turn % 4 = 0 union all select session_id, turn, 'src/e.py', 'edit' from turns_v where turn % 4 = 1
union all select session_id, turn, '/made.py', 'create' from turns_v where turn % 4 = 2""")
def s12(t: Tables) -> DataFrame:
    """Writes with content, edits told with a diff, and files said to be created; a tool of a person doesn't count."""
    args = F.struct(F.lit("src/w.py").alias("TargetFile"), c("text").alias("CodeContent"))
    write = json(step_index=c("turn"), source=F.lit("MODEL"), type=F.lit("PLANNER_RESPONSE"), tool_calls=F.array(F.struct(F.lit("write_to_file").alias("name"), args.alias("args"))))
    edit = json(step_index=c("turn"), source=F.lit("MODEL"), type=F.lit("CODE_ACTION"), content=F.concat(F.lit("I used the tool to: src/e.py. Then\n@@ -1 +1 @@\n+"), "text"))
    made = json(step_index=c("turn"), source=F.lit("MODEL"), type=F.lit("CODE_ACTION"), content=F.lit("Created file file:///made.py with requested content"))
    other = json(step_index=c("turn"), source=F.lit("USER"), type=F.lit("CODE_ACTION"), content=F.lit("Created file file:///x.py with requested content"))
    line = F.when(c("turn") % 4 == 0, write).when(c("turn") % 4 == 1, edit).when(c("turn") % 4 == 2, made).otherwise(other)
    raw = lines(t.turns_v, line)
    again = raw.withColumn("pos", c("pos") + 1000)
    return logs.agent_steps(raw.unionByName(again), KEY).select("session_id", c("step_index"), "path", "op")


@query("s13_inline_completion_log", f"select sha, 'src/t.py' as path, cast(pos + 12 as int) as line_no, sha256(content) as content_sha from ({PATCH.replace('$div', '//')}) where trim(content) <> ''")
def s13(t: Tables) -> DataFrame:
    opening = F.array(*map(F.lit, ("2024-01-01 00:00:00 handleModelResult", "@@ src/t.py:10", "-|gone", " |same", "+|  ")))
    block = F.concat(opening, F.transform("lines", lambda x: F.concat(F.lit("+|"), x)), F.array(F.lit("2024-01-01 00:00:01 other"), F.concat(F.lit("+|"), F.element_at("lines", 1))))
    raw = patches(t).select("sha", F.posexplode(block).alias("pos", "line"))
    return logs.tab_suggestions(raw, ["sha"]).select("sha", "path", "line_no", "content_sha")


@query("s14_editor_log_markers", "select id, case when id % 2 = 0 then '/a b/' || file_path when id % 4 = 1 then '/w/' || file_path else '' end as path, case when id % 4 = 3 then 'low' else 'medium' end as confidence from edits_v where id % 5 <> 0")
def s14(t: Tables) -> DataFrame:
    verb = F.when(c("id") % 5 == 0, "shown").otherwise("accepted")
    where = F.when(c("id") % 2 == 0, F.concat(F.lit(" file:///a%20b/"), "file_path")).when(c("id") % 4 == 1, F.concat(F.lit(" /w/"), "file_path")).otherwise("")
    raw = t.edits_v.select("id", F.concat(F.lit("[info] completion "), verb, where).alias("line"))
    return logs.log_markers(raw, "completion accepted").select("id", "path", "confidence")


@query("s15_tool_hook_payloads", "select id, case id % 4 when 0 then 'replace' when 1 then 'other' when 2 then 'write' else 'shell' end as tool_kind, case when id % 4 = 3 then null else file_path end as path, case when id % 4 in (0, 1) then 'old' end as old_text, case id % 4 when 0 then '' when 1 then 'new' when 2 then tool end as new_text from edits_v union all select id, 'other', file_path, 'old2', 'new2' from edits_v where id % 4 = 1")
def s15(t: Tables) -> DataFrame:
    path = c("file_path")
    name = F.expr("case id % 4 when 0 then 'StrReplace' when 1 then 'MultiEdit' when 2 then 'Write' else 'Bash' end")
    pair = lambda a, b: F.struct(F.lit(a).alias("old_string"), F.lit(b).alias("new_string"))
    one = F.struct(F.when(c("id") % 4 != 3, path).alias("file_path"), F.when(c("id") % 4 == 0, "old").alias("old_string"), F.when(c("id") % 4 == 0, "  ").alias("new_string"), F.when(c("id") % 4 == 2, c("tool")).alias("content"), F.when(c("id") % 4 == 3, "ls").alias("command"), F.when(c("id") % 4 == 1, F.array(pair("old", "new"), pair("old2", "new2"))).alias("edits"))
    raw = t.edits_v.select("id", F.lit(0).alias("pos"), json(tool_name=name, tool_input=one).alias("line"))
    return logs.hook_payloads(raw, ["id"]).select("id", "tool_kind", "path", "old_text", "new_text")


@query("s16_editor_transcript_events", "select id, case id % 3 when 0 then 'create' when 1 then 'replace' else 'insert' end as tool_kind, file_path as path, 'mx' as model, cast(9 as bigint) as input_tokens from edits_v where id % 2 = 0")
def s16(t: Tables) -> DataFrame:
    name = F.expr("case id % 3 when 0 then 'create_file' when 1 then 'replace_string_in_file' else 'insert_edit_into_file' end")
    kind = F.when(c("id") % 2 == 0, "tool.execution_start").otherwise("tool.execution_end")
    line = json(type=kind, data=F.struct(c("session_id").alias("sessionId"), name.alias("toolName"), F.struct(c("file_path").alias("filePath"), F.lit("x").alias("content")).alias("arguments")))
    usage = t.edits_v.select("session_id").distinct().select("session_id", F.lit("mx").alias("model"), F.lit(9).cast("long").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"))
    return logs.tool_events(t.edits_v.select("id", F.lit(0).alias("pos"), line.alias("line")), usage, ["id"]).select("id", "tool_kind", "path", "model", "input_tokens")


@query("s17_sandbox_log", "select sha, '/Users/ann/new/a.txt' as host_path from commits_v union all select sha, '/Users/ann/old/' || sha || '.py' from commits_v")
def s17(t: Tables) -> DataFrame:
    row = F.array(
        F.lit("mounting subpath for user ann (x): /Users/ann/old -> /sessions/s1/mnt/work"), F.concat(F.lit("process:oneshot-a1 rm -f /mnt/work/"), "sha", F.lit(".py")), F.concat(F.lit("process:oneshot-a1 rm -f /mnt/work/"), "sha", F.lit(".py")),
        F.lit("mounting subpath for user ann (x): /Users/ann/new -> /sessions/s1/mnt/work"), F.lit("process:oneshot-b2 rm -rf /mnt/work/a.txt && ls"), F.lit("unmounted /sessions/s1/mnt/work"), F.lit("process:oneshot-c3 rm -f /mnt/work/late.py"),
    )
    return logs.sandbox_deletions(t.commits_v.select("sha", F.posexplode(row).alias("pos", "line")), ["sha"]).select("sha", "host_path")
