"""Tools' logs as tables: transcripts, session logs, chat deltas, usage events, agent steps, editor and sandbox logs.

Each function takes a table of raw lines (keys, pos, line), from files or a stream of them (``sources.tail``), and gives a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave import schemas
from lineweave.functions.text import clean_path, is_blank, line_sha, line_sha_norm, to_nanos, uri_to_path
from lineweave.operators import windows


def parsed(lines: DataFrame, schema: str, raw: str = "line") -> DataFrame:
    """Lines that are JSON objects, as ``j``; others are left out."""
    rows = lines.where(F.ltrim(raw).startswith("{")).withColumn("j", F.from_json(raw, schema, {"mode": "PERMISSIVE"}))
    return rows.where(F.try_parse_json(raw).isNotNull()).drop(raw)


def first_text(content: Column) -> Column:
    """A plain text, or the first non-empty text block of an array of typed blocks."""
    blocks = F.from_json(content, schemas.BLOCKS)
    some = F.filter(blocks, lambda b: b["type"].isin("text", "human_turn") & (F.coalesce(b["text"], F.lit("")) != ""))
    return F.when(F.ltrim(content).startswith("[") & blocks.isNotNull(), F.try_element_at(some, F.lit(1))["text"]).otherwise(content)


def transcript(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, role, text, ts_ns, entrypoint, model and usage of each turn of a transcript, in both of its shapes."""
    j = parsed(lines, schemas.TRANSCRIPT)
    role = F.coalesce(F.nullif("j.type", F.lit("")), F.nullif("j.role", F.lit("")), F.col("j.message.role"))
    return j.select(
        *keys, "pos", role.alias("role"), first_text(F.coalesce("j.message.content", "j.content")).alias("text"), to_nanos(F.coalesce("j.timestamp", F.lit(""))).alias("ts_ns"),
        F.col("j.entrypoint").alias("entrypoint"), F.col("j.message.model").alias("model"), F.col("j.message.usage.input_tokens").alias("input_tokens"), F.col("j.message.usage.output_tokens").alias("output_tokens"),
    )


def session_gen_type(turns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gen_type: by the first user turn that has an entry point; a chat without one."""
    from lineweave.functions.rules import gen_type_of_entrypoint

    some = (F.col("role") == "user") & (F.coalesce(F.col("entrypoint"), F.lit("")) != "")
    first = turns.groupBy(*keys).agg(F.min_by(F.when(some, F.col("entrypoint")), F.when(some, F.col("pos"))).alias("_e"))
    return first.select(*keys, gen_type_of_entrypoint(F.coalesce("_e", F.lit(""))).alias("gen_type"))


def session_log(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, kind, model, input_tokens, output_tokens, payload of a session log, flat or wrapped.

    The model is carried forward from the last line that names one, and usage is pulled back from the next line that
    has some; lines after the last usage have none.
    """
    j = parsed(lines, schemas.SESSION_LINE)
    wrapped = F.col("j.payload").isNotNull()
    inner = lambda path: F.get_json_object("j.payload", path)
    usage = lambda name: F.coalesce(inner(f"$.info.last_token_usage.{name}").cast("long"), F.col(f"j.usage.{name}"), F.lit(0))
    rows = j.select(
        *keys, "pos", F.when(wrapped, F.coalesce(inner("$.type"), F.col("j.type"))).otherwise(F.col("j.type")).alias("kind"), F.coalesce(inner("$.model"), F.col("j.model")).alias("_model"),
        usage("input_tokens").alias("_in"), usage("output_tokens").alias("_out"), F.col("j.payload").alias("payload"),
    )
    rows = windows.carry_forward(rows, keys, "pos", "_model", "model")
    rows = windows.pull_back(rows.withColumn("_total", F.col("_in") + F.col("_out")), keys, "pos", "_total", "_next")
    ahead = Window.partitionBy(*keys).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    both = F.last(F.when(F.col("_total") > 0, F.struct("_in", "_out")), True).over(ahead)
    return rows.withColumn("_u", both).select(*keys, "pos", "kind", "model", F.col("_u._in").alias("input_tokens"), F.col("_u._out").alias("output_tokens"), "payload")


def patch_edits(session: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, path, change, added, removed: one row for each file of a successful patch event.

    ``payload`` holds changes by path: add has content, update a unified diff, delete content or nothing. An update
    that neither adds nor removes is left out.
    """
    change = "map<string, struct<type: string, content: string, unified_diff: string>>"
    ok = F.coalesce(F.get_json_object("payload", "$.success"), F.lit("true")) == "true"
    rows = session.where(F.col("kind").isin("patch_apply_end", "patch_apply")).where(ok)
    rows = rows.select(*keys, "pos", F.explode(F.from_json(F.get_json_object("payload", "$.changes"), change)).alias("path", "c"))
    marked = lambda sign: F.transform(F.filter(F.split("c.unified_diff", "\n"), lambda x: x.startswith(sign) & ~x.startswith(sign * 3)), lambda x: F.substring(x, 2, 1 << 20))
    whole = F.split(F.regexp_replace("c.content", "\n$", ""), "\n")
    none = F.array().cast("array<string>")
    kind = F.col("c.type")
    rows = rows.select(
        *keys, "pos", clean_path(F.col("path")).alias("path"), kind.alias("change"),
        F.when(kind == "add", whole).when(kind == "update", marked("+")).otherwise(none).alias("added"),
        F.when(kind == "update", marked("-")).when((kind == "delete") & F.col("c.unified_diff").isNotNull(), marked("-")).when(kind == "delete", F.coalesce(whole, none)).otherwise(none).alias("removed"),
    )
    return rows.where((F.col("change") != "update") | (F.size("added") > 0) | (F.size("removed") > 0))


def patch_envelope(patches: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, path, op (add, update, delete), sign, n, content_sha, content_sha_norm of a patch in its envelope; blank lines are left out.

    n counts a file's lines of one sign. A deleted file gives one row without sign.
    """
    rows = patches.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "raw"))
    head = r"^\*\*\* (Add|Update|Delete) File: (.+)$"
    raw = F.col("raw")
    order = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_head = raw.rlike(head)
    get = lambda k: F.last(F.when(is_head, F.regexp_extract(raw, head, k)), True).over(order)
    rows = rows.withColumns({"op": F.lower(get(1)), "path": clean_path(get(2)), "is_head": is_head, "sign": F.when(raw.startswith("***"), F.lit("*")).otherwise(F.substring(raw, 1, 1))})
    body = rows.where(F.col("op").isin("add", "update") & F.col("sign").isin("+", "-")).withColumn("content", F.substring("raw", 2, 1 << 20)).where(~is_blank(F.col("content")))
    n = F.row_number().over(Window.partitionBy(*keys, "path", "sign").orderBy("pos"))
    lines = body.select(*keys, "path", "op", "sign", n.alias("n"), line_sha(F.col("content")).alias("content_sha"), line_sha_norm(F.col("content")).alias("content_sha_norm"))
    gone = rows.where(F.col("is_head") & (F.col("op") == "delete")).select(*keys, "path", "op", F.lit("").alias("sign"), F.lit(0).alias("n"), F.lit("").alias("content_sha"), F.lit("").alias("content_sha_norm"))
    return lines.unionByName(gone)


def chat_requests(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, request, user_text, assistant_text, ts_ms, model, prompt_tokens, output_tokens of a chat's delta log.

    Kind 0 is a snapshot of all requests, kind 1 sets a value at a path, kind 2 appends requests, or response parts to
    one. Parts with a kind of their own are no text; the last value of each field stands.
    """
    j = parsed(lines, schemas.CHAT_DELTA).select(*keys, "pos", "j.*")
    request = "struct<requestId: string, timestamp: bigint, modelId: string, message: struct<text: string>, response: array<struct<kind: string, value: string>>, result: struct<metadata: struct<promptTokens: bigint, outputTokens: bigint>, usage: struct<promptTokens: bigint, completionTokens: bigint>>>"
    path = F.concat_ws("/", "k")
    appends = (F.col("kind") == 2) & (path == "requests")
    some = F.when(F.col("kind") == 0, F.from_json(F.get_json_object("v", "$.requests"), f"array<{request}>")).when(appends, F.from_json("v", f"array<{request}>"))
    j = j.withColumn("_new", some).withColumn("_size", F.coalesce(F.size("_new"), F.lit(0)))
    j = windows.append_index(j.withColumn("_n", F.when(F.col("_new").isNull(), 0).otherwise(F.size("_new"))), keys, "pos", "_n", "_first")
    whole = j.where(F.col("_new").isNotNull()).select(*keys, "pos", "_first", F.posexplode("_new").alias("_i", "r")).withColumn("request", (F.col("_first") + F.col("_i")).cast("int"))
    from_whole = whole.select(
        *keys, "request", "pos", F.col("r.message.text").alias("user_text"), F.col("r.response").alias("parts"), F.col("r.timestamp").alias("ts_ms"), F.col("r.modelId").alias("model"),
        F.coalesce("r.result.metadata.promptTokens", "r.result.usage.promptTokens").alias("prompt_tokens"), F.coalesce("r.result.metadata.outputTokens", "r.result.usage.completionTokens").alias("output_tokens"),
    )
    at = F.regexp_extract(path, r"^requests/(\d+)/(\w+)", 1)
    field = F.regexp_extract(path, r"^requests/(\d+)/(\w+)", 2)
    sets = j.where(at != "").withColumns({"request": at.cast("int"), "_f": field})
    only = lambda name, value: F.when(F.col("_f") == name, value)
    number = lambda *paths: F.coalesce(*[F.get_json_object("v", p).cast("long") for p in paths])
    from_sets = sets.select(
        *keys, "request", "pos", only("message", F.get_json_object("v", "$.text")).alias("user_text"), only("response", F.from_json("v", "array<struct<kind: string, value: string>>")).alias("parts"),
        only("timestamp", F.col("v").cast("long")).alias("ts_ms"), only("modelId", F.regexp_replace("v", '"', "")).alias("model"),
        only("result", number("$.metadata.promptTokens", "$.usage.promptTokens")).alias("prompt_tokens"), only("result", number("$.metadata.outputTokens", "$.usage.completionTokens")).alias("output_tokens"),
    )
    rows = from_whole.unionByName(from_sets)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c)
    text = F.array_join(F.transform(F.filter(F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("parts").isNotNull(), F.struct("pos", "parts")))), lambda p: p["parts"])), lambda p: F.coalesce(p["kind"], F.lit("")) == ""), lambda p: p["value"]), "")
    return rows.groupBy(*keys, "request").agg(last("user_text"), text.alias("assistant_text"), last("ts_ms"), last("model"), last("prompt_tokens"), last("output_tokens"))


def text_edit_groups(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, request, file, start_line, end_line, content: finished edit groups of a chat log, once each; other URIs than files are left out."""
    group = "array<struct<kind: string, done: boolean, uri: struct<scheme: string, path: string>, edits: array<array<struct<text: string, range: struct<startLineNumber: int, endLineNumber: int>>>>>>"
    j = parsed(lines, schemas.CHAT_DELTA).select(*keys, "pos", "j.*")
    path = F.concat_ws("/", "k")
    at = F.regexp_extract(path, r"^requests/(\d+)/response", 1)
    rows = j.where(at != "").select(*keys, "pos", at.cast("int").alias("request"), F.explode(F.from_json("v", group)).alias("g"))
    rows = rows.where((F.col("g.kind") == "textEditGroup") & F.col("g.done") & (F.col("g.uri.scheme") == "file"))
    edits = rows.select(*keys, "pos", "request", uri_to_path(F.col("g.uri.path")).alias("file"), F.flatten("g.edits").alias("e"))
    edits = edits.withColumn("starts", F.transform("e", lambda x: x["range"]["startLineNumber"]))
    edits = windows.first_seen(edits, [*keys, "file", "request", "starts"], "pos")
    one = edits.select(*keys, "request", "file", F.explode("e").alias("e"))
    return one.select(*keys, "request", "file", F.col("e.range.startLineNumber").alias("start_line"), F.col("e.range.endLineNumber").alias("end_line"), F.col("e.text").alias("content"))


def usage_events(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, model, output_tokens (the latest of a session) and metrics (by model, of the last shutdown)."""
    j = parsed(lines, schemas.USAGE_EVENT).select(*keys, "pos", F.col("j.type").alias("type"), "j.data.*")
    last = lambda c, when: F.max_by(c, F.when(when, F.col("pos")))
    return j.groupBy(*keys).agg(
        last("model", F.coalesce(F.col("model"), F.lit("")) != "").alias("model"), last("outputTokens", F.col("outputTokens") > 0).alias("output_tokens"),
        last("modelMetrics", F.col("type") == "session.shutdown").alias("metrics"),
    )


def shutdown_usage(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, model, input_tokens, output_tokens of each model in the last shutdown."""
    rows = sessions.select(*keys, F.explode("metrics").alias("model", "m"))
    return rows.select(*keys, "model", F.col("m.inputTokens").alias("input_tokens"), F.col("m.outputTokens").alias("output_tokens"))


def usage_metadata(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, model, input_tokens, output_tokens of the last usage block; a total without parts counts as output."""
    j = parsed(lines, "model string, usageMetadata struct<promptTokenCount: bigint, candidatesTokenCount: bigint, totalTokenCount: bigint>")
    u = lambda name: F.coalesce(F.col(f"j.usageMetadata.{name}"), F.lit(0))
    none = (u("promptTokenCount") == 0) & (u("candidatesTokenCount") == 0)
    rows = j.where(F.col("j.usageMetadata").isNotNull()).select(*keys, "pos", F.col("j.model").alias("model"), u("promptTokenCount").alias("input_tokens"), F.when(none, u("totalTokenCount")).otherwise(u("candidatesTokenCount")).alias("output_tokens"))
    return rows.groupBy(*keys).agg(F.max_by(F.struct("model", "input_tokens", "output_tokens"), "pos").alias("u")).select(*keys, "u.*")


def agent_steps(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, step_index, path, op (edit or create), diff, content, cwd: what an agent's steps did to files.

    Only the model's action and planner steps count, each once. A write's own content is preferred to the later step
    that says the file was created; content that was cut short is no content.
    """
    j = parsed(lines, schemas.AGENT_STEP).select(*keys, "pos", "j.*")
    steps = windows.first_seen(j.where((F.col("source") == "MODEL") & F.col("type").isin("CODE_ACTION", "PLANNER_RESPONSE")), [*keys, "step_index"], "pos")
    calls = steps.select(*keys, "step_index", F.explode("tool_calls").alias("t")).where(F.lower("t.name").rlike("write|create"))
    calls = calls.where(F.coalesce(F.col("t.args.TargetFile"), F.lit("")) != "").where(~F.coalesce("t.args.CodeContent", F.lit("")).rlike(r"(<truncated|\.\.\. ?truncated)"))
    writes = calls.select(*keys, "step_index", clean_path(F.col("t.args.TargetFile")).alias("path"), F.lit("create").alias("op"), F.lit("").alias("diff"), F.col("t.args.CodeContent").alias("content"))
    told = steps.where(F.col("type") == "CODE_ACTION")
    edit = F.regexp_extract("content", r"tool to: (.+?)\.\s", 1)
    made = F.regexp_extract("content", r"Created file (file://\S+) with requested content", 1)
    diff = F.regexp_extract("content", r"(?s)(@@ -\d.*)", 1)
    told = told.select(*keys, "step_index", F.when(edit != "", clean_path(edit)).otherwise(uri_to_path(made)).alias("path"), F.when(edit != "", "edit").otherwise("create").alias("op"), diff.alias("diff"), F.lit(None).cast("string").alias("content")).where("path <> ''")
    known = writes.select(*keys, "path").distinct()
    creates = told.where("op = 'create'").join(known, [*keys, "path"], "left_anti")
    return writes.unionByName(told.where("op = 'edit'")).unionByName(creates.select(*writes.columns))


def tab_suggestions(lines: DataFrame, keys: list[str], marker: str = "handleModelResult") -> DataFrame:
    """keys, block, path, line_no, content_sha, content_sha_norm: added lines of the suggestions in an editor's log.

    A block begins at the marker and ends at the next line with a time. A hunk names path and first line; added and
    context lines advance the number, removed ones don't, blank added ones carry no hash and give no row.
    """
    raw = F.col("line")
    order = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    timed = raw.rlike(r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d")
    rows = lines.withColumns({"_start": raw.contains(marker), "_timed": timed})
    rows = rows.withColumn("block", F.sum((F.col("_start") | F.col("_timed")).cast("int")).over(order))
    in_block = Window.partitionBy(*keys, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_on", F.max("_start").over(in_block)).where("_on")
    head = r"^@@ (.+):(\d+)"
    is_head = raw.rlike(head)
    rows = rows.withColumns({"_h": F.sum(is_head.cast("int")).over(in_block), "path": F.last(F.when(is_head, F.regexp_extract(raw, head, 1)), True).over(in_block), "_first": F.last(F.when(is_head, F.regexp_extract(raw, head, 2).cast("int")), True).over(in_block)})
    body = rows.where((F.col("_h") > 0) & raw.rlike(r"^[+\- ]\|"))
    hunk = Window.partitionBy(*keys, "block", "_h").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("_first") + F.sum((F.substring("line", 1, 1) != "-").cast("int")).over(hunk) - 1
    body = body.withColumns({"line_no": at.cast("int"), "content": F.substring("line", 3, 1 << 20)}).where(raw.startswith("+|") & ~is_blank(F.col("content")))
    return body.select(*keys, "block", clean_path(F.col("path")).alias("path"), "line_no", line_sha(F.col("content")).alias("content_sha"), line_sha_norm(F.col("content")).alias("content_sha_norm"))


def log_markers(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines of editor logs that say a suggestion was taken, with ``path`` (from a file URI or an absolute path, or blank)
    and ``confidence``: medium with a path, low without."""
    uri = F.regexp_extract("line", r"file://[^\s\"')]+", 0)
    plain = F.regexp_extract("line", r"(?:^|[\s\"'(=:])(/[\w./-]+\.\w+)", 1)
    path = F.when(uri != "", uri_to_path(uri)).otherwise(plain)
    return lines.where(F.col("line").rlike(pattern)).withColumn("path", path).withColumn("confidence", F.when(F.col("path") == "", "low").otherwise("medium"))


def hook_payloads(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, tool_kind, path, old_text, new_text, patch, command, cwd, session_id of tool-call payloads.

    One row for each replacement of a call that has many. A whitespace-only new text is a deletion (new_text empty).
    """
    from lineweave.functions.rules import tool_kind

    schema = "tool_name string, cwd string, session_id string, tool_input struct<file_path: string, path: string, notebook_path: string, old_string: string, old_str: string, new_string: string, new_str: string, content: string, file_text: string, command: string, patch: string, input: string, edits: array<struct<old_string: string, new_string: string>>>"
    j = parsed(lines, schema).select(*keys, "pos", "j.*")
    i = lambda *names: F.coalesce(*[F.col(f"tool_input.{n}") for n in names])
    one = F.array(F.struct(i("old_string", "old_str").alias("old_string"), F.coalesce(i("new_string", "new_str"), i("content", "file_text")).alias("new_string")))
    rows = j.select(*keys, "pos", tool_kind(F.col("tool_name")).alias("tool_kind"), clean_path(i("file_path", "path", "notebook_path")).alias("path"), F.explode(F.coalesce("tool_input.edits", one)).alias("e"), i("patch", "input").alias("patch"), i("command").alias("command"), "cwd", "session_id")
    return rows.select(*keys, "pos", "tool_kind", "path", F.col("e.old_string").alias("old_text"), F.when(is_blank(F.col("e.new_string")), "").otherwise(F.col("e.new_string")).alias("new_text"), "patch", "command", "cwd", "session_id")


def tool_events(lines: DataFrame, usage: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, tool_kind, path, text, model, input_tokens, output_tokens of an editor's tool executions, with the
    model and usage of their chat session. usage: session_id, model, input_tokens, output_tokens."""
    from lineweave.functions.rules import tool_kind

    j = parsed(lines, "type string, data struct<sessionId: string, toolName: string, arguments: struct<filePath: string, content: string, newString: string, code: string, input: string>>")
    d = lambda n: F.col(f"j.data.{n}")
    rows = j.where(F.col("j.type") == "tool.execution_start").select(*keys, "pos", tool_kind(d("toolName")).alias("tool_kind"), clean_path(d("arguments.filePath")).alias("path"), F.coalesce(d("arguments.content"), d("arguments.newString"), d("arguments.code"), d("arguments.input")).alias("text"), d("sessionId").alias("session_id"))
    return rows.where(F.col("tool_kind").isin("patch", "create", "replace", "insert")).join(usage, "session_id", "left")


def sandbox_deletions(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, host_path: what ``rm`` deleted under mounted folders of a sandbox, as paths on the host.

    A folder's host path is the one of its latest mount before the command; an unmount clears it. Processes that were
    started twice count once.
    """
    mount = r"mounting subpath for user \S+ \([^)]*\):\s*(\S+)\s*->\s*(\S+)"
    raw = F.col("line")
    base = lambda c: F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)
    get = lambda k: F.regexp_extract(raw, mount, k)
    mounts = lines.where(raw.rlike(mount)).select(*keys, "pos", base(get(2)).alias("folder"), get(1).alias("host"))
    gone = lines.where(raw.rlike(r"unmount(?:ing|ed)\s+/sessions/\S+")).select(*keys, "pos", base(F.regexp_extract(raw, r"unmount(?:ing|ed)\s+(/sessions/\S+)", 1)).alias("folder"), F.lit("").alias("host"))
    spawn = F.coalesce(F.nullif(F.regexp_extract(raw, r"process:(oneshot-[a-f0-9-]+)", 1), F.lit("")), F.concat(F.lit("#"), F.col("pos").cast("string")))
    commands = windows.first_seen(lines.where(raw.rlike(r"(^|\s)(?:git\s+)?rm\s")).withColumn("_spawn", spawn), [*keys, "_spawn"], "pos")
    target = F.explode(F.regexp_extract_all(F.regexp_extract("line", r"(?:^|\s)rm\s+([^&|;]+)", 1), F.lit(r"/mnt/[^\s'\"]+"), 0))
    commands = commands.select(*keys, "pos", target.alias("t")).select(*keys, "pos", F.regexp_extract("t", "^/mnt/([^/]+)/", 1).alias("folder"), F.regexp_extract("t", "^/mnt/[^/]+/(.+)$", 1).alias("rest"))
    # as-of join by carrying the mount forward over both tables in one order
    both = mounts.unionByName(gone).withColumn("rest", F.lit(None).cast("string")).unionByName(commands.withColumn("host", F.lit(None).cast("string")))
    order = Window.partitionBy(*keys, "folder").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_host", F.last("host", True).over(order))
    return both.where(F.col("rest").isNotNull() & (F.coalesce(F.col("_host"), F.lit("")) != "")).select(*keys, "pos", F.concat_ws("/", "_host", "rest").alias("host_path"))
