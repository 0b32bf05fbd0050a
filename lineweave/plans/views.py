"""Views over the given tables that stand in for edits, commits, diffs and logs, the same in Spark and in DuckDB.

Text of a view uses ``@table`` for a base table, names of other views as they are, and ``$`` tokens where the two
dialects differ. Spark reads the tables of a folder; DuckDB has them as views of their names.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

TABLES = ("events", "documents", "conversations", "lineitem", "orders", "customer", "supplier", "part", "nation", "region")
# Spark and DuckDB for each token
TOKENS = {
    "$us": ("unix_micros(cast(ts as timestamp))", "epoch_us(ts)"),
    "$sec": ("unix_seconds(cast(ts as timestamp))", "(epoch_us(ts) // 1000000)"),
    "$k": ("cast(get_json_object(props, '$.k') as int)", "cast(json_extract_string(props, '$.k') as int)"),
    "$div": ("div", "//"),
    "$lf": ("'\\n'", "chr(10)"),
}

VIEWS: dict[str, tuple[str, str]] = {}


def define(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    VIEWS[name] = (spark_sql, duck_sql or spark_sql)


def dialect(text: str, duck: bool) -> str:
    for token, pair in TOKENS.items():
        text = text.replace(token, pair[duck])
    return re.sub(r"#sha\[([^\]]*)\]", r"sha256(\1)" if duck else r"sha2(\1, 256)", text)


def with_views(text: str, duck: bool) -> str:
    """The text behind a WITH clause that holds the views it names, in their order of definition."""
    wanted: set[str] = set()
    todo = [text]
    while todo:
        part = todo.pop()
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b{name}\b", part):
                wanted.add(name)
                todo.append(VIEWS[name][duck])
    if not wanted:
        return dialect(text, duck)
    ctes = ",\n".join(f"{n} as (\n{VIEWS[n][duck].strip()}\n)" for n in VIEWS if n in wanted)
    body = text.strip()
    opening = next((x for x in ("with recursive ", "with ") if body.lower().startswith(x)), None)
    joined = f"{opening}{ctes},\n{body[len(opening) :]}" if opening else f"with {ctes}\n{body}"
    return dialect(joined, duck)


def duck(text: str) -> str:
    return with_views(text, True).replace("@", "")


def spark(session: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs the text over the tables of a folder."""
    sql, mark = with_views(text, False), zlib.crc32(sf_dir.encode())
    for t in TABLES:
        if re.search(rf"@{t}\b", sql):
            session.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"{t}_{mark}")
            sql = re.sub(rf"@{t}\b", f"{t}_{mark}", sql)
    return session.sql(sql)


def view(session: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark(session, sf_dir, f"select * from {name}")


define("doc_lines_v", "select doc_id, posexplode(split(text, '\\n')) as (pos, content) from @documents",
       "select doc_id, cast(unnest(range(len(a))) as int) as pos, unnest(a) as content from (select doc_id, string_split(text, chr(10)) a from documents)")
define("edits_v", """
select event_id as id, $us * 1000 as ts_ns, concat('repo', cast(user_id % 4 as varchar(9))) as repo_path, concat('src/f', cast(k % 3 as varchar(9)), '.py') as file_path,
  case event_type when 'click' then 'claude' when 'view' then 'cursor' when 'purchase' then 'codex' when 'signup' then 'copilot'
    else case when k % 2 = 0 then '' else 'copypaste' end end as tool,
  case k % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as confidence,
  case when event_type = 'error' then 'human' when k % 4 = 0 then 'chat' when k % 4 = 1 then 'cli' when k % 4 = 2 then 'completion' else 'unknown' end as gen_type,
  case when event_type = 'error' or k % 5 = 0 then null else concat('m', cast(k % 3 as varchar(9))) end as model,
  case when k % 2 = 0 then cast(floor(value) as bigint) end as input_tokens, cast(case when k % 2 = 0 then k % 17 end as bigint) as output_tokens,
  cast(case when k % 2 = 0 then k % 5 end as bigint) as cache_read_tokens, cast(null as bigint) as cache_write_tokens,
  cast(k % 11 as bigint) as suggested_lines, concat('b', cast(user_id % 2 as varchar(9))) as branch, concat('s', cast(user_id as varchar(19))) as session_id,
  case when k % 7 = 0 then concat('{"tool":"Write","session_id":"s', cast(user_id as varchar(19)), '"}')
    when k % 7 = 1 and event_type = 'view' then '{"source":"cursor_tab_log"}' end as raw_meta, k
from (select *, $k as k from @events) e""")
define("commits_v", """
select concat('c', cast(event_id as varchar(19))) as sha, concat('repo', cast(user_id % 4 as varchar(9))) as repo_path, $sec * 1000000000 as ts_ns,
  concat('b', cast(user_id % 2 as varchar(9))) as branch, cast(event_id as bigint) as n from @events where event_id % 10 = 0""")
# Documents are dealt by the table's own count: the ten edits before a commit share a document with one of its files.
define("edit_docs_v", "select *, (id $div 10) % (select count(*) from @documents) as doc_id from edits_v")
define("commit_docs_v", """
select c.*, f.f, concat('src/f', cast(f.f as varchar(9)), '.py') as file_path, (c.n $div 10 - f.f + (select count(*) from @documents)) % (select count(*) from @documents) as doc_id
from commits_v c cross join (select 0 as f union all select 1 union all select 2) f""")
# In Spark a text's lines are hashed once and not for each edit and commit that holds it, and where only hashes are asked for the texts stay behind.
define("hashed_lines_v", "select doc_id, pos + 1 as line_no, content, #sha[content] as content_sha, #sha[replace(trim(content), '  ', ' ')] as content_sha_norm, trim(regexp_replace(content, '(?U)\\\\s+', ' ')) = '' as blank from doc_lines_v")
define("edit_lines_v", "select e.id as edit_id, l.line_no, l.content, l.content_sha, l.content_sha_norm from edit_docs_v e join hashed_lines_v l on l.doc_id = e.doc_id", """
select e.id as edit_id, l.pos + 1 as line_no, l.content, #sha[l.content] as content_sha, #sha[replace(trim(l.content), '  ', ' ')] as content_sha_norm
from edit_docs_v e join doc_lines_v l on l.doc_id = e.doc_id""")
define("added_v", "select c.sha, c.repo_path, c.file_path, c.ts_ns, l.line_no, l.content, l.content_sha, l.content_sha_norm from commit_docs_v c join hashed_lines_v l on l.doc_id = c.doc_id", """
select c.sha, c.repo_path, c.file_path, c.ts_ns, l.pos + 1 as line_no, l.content, #sha[l.content] as content_sha, #sha[replace(trim(l.content), '  ', ' ')] as content_sha_norm
from commit_docs_v c join doc_lines_v l on l.doc_id = c.doc_id""")
define("added_hashes_v", "select c.sha, c.repo_path, c.file_path, c.ts_ns, l.line_no, l.content_sha, l.content_sha_norm, l.blank from commit_docs_v c join hashed_lines_v l on l.doc_id = c.doc_id")
define("drift_v", """
select doc_id, pos, case pos % 4 when 0 then content when 1 then concat('  ', content) when 2 then replace(content, ' ', '  ') else '' end as content from doc_lines_v""")
define("old_v", "select doc_id, pos, content from doc_lines_v")
define("new_v", """
select doc_id, cast(row_number() over (partition by doc_id order by late, pos, again) - 1 as int) as pos, content from (
  select doc_id, pos, 0 as again, case when pos < 2 then 1 else 0 end as late, content from doc_lines_v where pos % 5 <> 2
  union all select doc_id, pos, 1 as again, case when pos < 2 then 1 else 0 end as late, concat(content, '  ') as content from doc_lines_v where pos % 7 = 3) x""")
define("windows_v", """
select sha, repo_path, branch, n, ts_ns, cast(coalesce(max(ts_ns) over (partition by repo_path order by ts_ns range between unbounded preceding and 1 preceding), 0) as bigint) as prev_ns
from commits_v""")
define("attr_v", """
select sha, c.file_path as path, case when l.pos % 3 = 2 then 'del' else 'add' end as side, l.pos + 1 as line_no, l.content,
  case when (c.n $div 10 + l.pos $div 2) % 3 = 0 then 'Human' else 'AI' end as author_type,
  case when (c.n $div 10 + l.pos $div 2) % 3 = 0 then case when c.n % 20 = 0 then 'copypaste' else '' end when c.n % 20 = 0 then 'claude' else 'cursor' end as tool,
  case when (c.n $div 10 + l.pos $div 2) % 3 = 0 or c.n % 30 = 0 then null else concat('m', cast(l.pos % 2 as varchar(9))) end as model,
  case when (c.n $div 10 + l.pos $div 2) % 3 = 0 then 'human' when c.n % 40 = 0 then null when l.pos < 3 then 'chat' when l.pos < 5 then 'cli' else 'completion' end as gen_type, c.ts_ns, c.repo_path
from commit_docs_v c join doc_lines_v l on l.doc_id = c.doc_id where c.f < 2""")
define("turns_v", """
select concat('s', cast(conv_id as varchar(19))) as session_id, cast(turn as int) as turn, role, text, 1704067200000000000 + conv_id * 3600000000000 + turn * 60000000000 as ts_ns,
  case when role = 'assistant' then concat('m', cast(conv_id % 3 as varchar(9))) else '' end as model, case when role = 'assistant' then turn * 10 else 0 end as input_tokens, case when role = 'assistant' then turn else 0 end as output_tokens
from @conversations""")
define("totals_v", """
select sha, cast(min(ts_ns) as bigint) as ts_ns, min(repo_path) as repo_path, cast(sum(case when side = 'add' then 1 else 0 end) as bigint) as added_lines, cast(sum(case when side = 'del' then 1 else 0 end) as bigint) as deleted_lines,
  cast(sum(case when side = 'add' and author_type = 'AI' then 1 else 0 end) as bigint) as ai_lines, cast(sum(case when side = 'add' and author_type <> 'AI' then 1 else 0 end) as bigint) as human_lines,
  cast(sum(case when side = 'del' and author_type = 'AI' then 1 else 0 end) as bigint) as ai_deleted, cast(sum(case when side = 'del' and author_type <> 'AI' then 1 else 0 end) as bigint) as human_deleted,
  cast(sum(case when author_type = 'AI' and gen_type = 'chat' then 1 else 0 end) as bigint) as chat, cast(sum(case when author_type = 'AI' and gen_type = 'cli' then 1 else 0 end) as bigint) as cli,
  cast(sum(case when author_type = 'AI' and gen_type = 'completion' then 1 else 0 end) as bigint) as completion, cast(60000000000 * count(*) as bigint) as coding_ns from attr_v group by sha""")
define("tools_v", """
select sha, tool, max(model) as model, cast(min(ts_ns) as bigint) as ts_ns, cast(sum(case when side = 'add' then 1 else 0 end) as bigint) as lines, cast(sum(case when side = 'add' then 1 else 0 end) as bigint) as accepted_lines,
  cast(count(*) + 3 as bigint) as suggested_lines, cast(count(*) * 100 as bigint) as input_tokens, cast(count(*) as bigint) as output_tokens
from attr_v where tool in ('claude', 'cursor') and author_type = 'AI' group by sha, tool""")
define("logs_v", """
select repo_path, concat('b', cast(n % 2 as varchar(9))) as branch, sha as base_sha, concat('src/f', cast(n % 3 as varchar(9)), '.py') as file, n from commits_v""")
define("fs_v", """
select event_id as id, case event_id % 13 when 0 then 'delete' when 1 then 'create' when 2 then 'rename' when 3 then 'copy' when 4 then 'chmod' else 'Move' end as kind,
  case when event_id % 17 = 0 then '' else concat('repo', cast(user_id % 4 as varchar(9))) end as repo_path, concat('src/f', cast(event_id % 3 as varchar(9)), '.py') as path,
  concat('src/f', cast(event_id % 3 as varchar(9)), '.py') as old_path, case when event_id % 19 = 0 then '' else concat('src/g', cast(event_id % 2 as varchar(9)), '.py') end as new_path,
  concat('src/f', cast(event_id % 3 as varchar(9)), '.py') as src_path, concat('src/h', cast(event_id % 2 as varchar(9)), '.py') as dst_path, $us * 1000 as at_ns from @events""")
define("blame_v", "select file_path as path, line_no + 2 as final_line, sha, line_no as origin_line from added_v")
define("ranges_v", """
select sha, concat('src/f', cast(n % 3 as varchar(9)), '.py') as path, 2 as start_line, 5 as end_line, case when n % 20 = 0 then 'Human' else 'AI' end as author_type, case when n % 30 = 0 then '' else 'claude' end as tool from commits_v""")
define("markers_v", "select tool, case when id % 6 = 0 then '' else repo_path end as repo_path, ts_ns as marker_ts, case when id % 4 = 0 then '' else model end as marker_model from edits_v where gen_type = 'chat'")
