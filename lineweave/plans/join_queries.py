"""Queries for joins and consume-once matching (J rows of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.functions import rules, shell
from lineweave.operators import joins, match
from lineweave.plans.registry import Tables, query

c = F.col
FILE = ["sha", "repo_path", "file_path"]
ELIGIBLE = "e.tool not in ('', 'human', 'copypaste') and (e.tool = 'cursor' or not coalesce(lower(json_extract_string(e.raw_meta, '$.tool')) in ('write', 'create_file', 'createfile', 'create_new_file'), false))"
RANK = "case confidence when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end desc, ts_ns desc, id"
IN_WINDOW = "select w.sha, e.* from edits_v e join windows_v w on e.repo_path = w.repo_path and e.ts_ns > w.prev_ns and e.ts_ns <= w.ts_ns + 5000000000"


def candidates(t: Tables, eligible=None, lines: DataFrame | None = None) -> DataFrame:
    """Units of the edits in each commit's window, by commit and file."""
    edits = joins.in_window(t.edit_docs_v, t.windows_v, ["repo_path"])
    return match.units_of(edits, hashes(t), FILE, eligible, lines=lines)


def hashes(t: Tables) -> DataFrame:
    """The lines of edits, by the text that edit_docs_v names for each: no line is moved once for each edit that holds it."""
    return t.hashed_lines_v.select("doc_id", "content_sha", "content_sha_norm")


def drifted(t: Tables) -> DataFrame:
    """Added lines of which every second has changed in white space only."""
    return added(t).withColumn("content_sha", F.when(c("line_no") % 2 == 0, F.sha2(F.concat("content_sha", F.lit("x")), 256)).otherwise(c("content_sha")))


def added(t: Tables) -> DataFrame:
    return t.added_v.select(*FILE, "line_no", "content_sha", "content_sha_norm")


@query("j01_hydrate_edits", "select e.id, count(l.line_no) as n_lines, coalesce(string_agg(cast(l.line_no as varchar), ',' order by l.line_no), '') as line_nos, cast(count(l.line_no) filter (l.line_no % 2 = 0) as bigint) as n_removed from edits_v e left join edit_lines_v l on l.edit_id = e.id group by e.id")
def j01(t: Tables) -> DataFrame:
    got = joins.hydrate(t.edits_v.select("id"), t.edit_lines_v, t.edit_lines_v.where("line_no % 2 = 0"))
    return got.select("id", F.size("lines").cast("long").alias("n_lines"), F.array_join("lines.line_no", ",").alias("line_nos"), F.size("removed").cast("long").alias("n_removed"))


@query("j02_previous_commit", "select c.sha, coalesce((select max(p.ts_ns) from commits_v p where p.repo_path = c.repo_path and p.ts_ns < c.ts_ns), 0) as prev_ns from commits_v c")
def j02(t: Tables) -> DataFrame:
    return joins.previous_commit(t.commits_v).select("sha", "prev_ns")


@query("j03_edits_in_commit_window", f"select w.sha, w.id from ({IN_WINDOW}) w")
def j03(t: Tables) -> DataFrame:
    return joins.in_window(t.edits_v, t.windows_v, ["repo_path"]).select("sha", "id")


TOUCH = "select sha, repo_path, branch, prev_ns, ts_ns, concat('src/f', cast(n // 10 % 3 as varchar), '.py') as file_path from windows_v"


@query("j04_per_file_last_touch", f"with f as ({TOUCH}) select sha, file_path, least(prev_ns, coalesce((select max(p.ts_ns) from f p where p.repo_path = f.repo_path and p.branch = f.branch and p.file_path = f.file_path and p.ts_ns < f.ts_ns), 0)) as prev_ns from f")
def j04(t: Tables) -> DataFrame:
    files = t.windows_v.withColumn("file_path", F.expr("concat('src/f', cast(n div 10 % 3 as string), '.py')"))
    return joins.widened(joins.last_touch(files)).select("sha", "file_path", "prev_ns")


@query("j05_nearest_model", """
select id, (select m.marker_model from markers_v m where m.tool = e.tool and (m.repo_path = e.repo_path or m.repo_path = '') and coalesce(m.marker_model, '') <> '' and abs(m.marker_ts - e.ts_ns) <= 1800000000000 order by m.marker_ts desc, m.marker_model limit 1) as near_model from edits_v e""")
def j05(t: Tables) -> DataFrame:
    return joins.nearest_model(t.edits_v, t.markers_v).select("id", "near_model")


@query("j06_nearest_generation_type", """
select id, case when tool not in ('copilot', 'cursor') then gen_type when gen_type = 'completion' and confidence = 'high' then gen_type when max((gen_type = 'chat')::int) over b = 1 then 'chat'
  else coalesce(max_by(gen_type, case when gen_type not in ('unknown', '') then (ts_ns - 1700000000000000000) * 4 + case gen_type when 'completion' then 2 when 'cli' then 1 else 3 end end) over b, gen_type) end as near_gen
from edits_v window b as (partition by tool order by ts_ns range between 3600000000000 preceding and 3600000000000 following)""")
def j06(t: Tables) -> DataFrame:
    return joins.nearest_gen_type(t.edits_v, 60 * joins.MINUTE).select("id", "near_gen")


@query("j07_retroactive_chat_upgrade", """
with e as (select *, case when id % 3 = 0 and gen_type = 'chat' then '' else file_path end as fp, tool = 'cursor' and coalesce(json_extract_string(raw_meta, '$.source') = 'cursor_tab_log', false) as is_tab from edits_v)
select id, case when gen_type = 'completion' and confidence <> 'high' and fp <> '' and not is_tab and exists (select 1 from e m where m.tool = e.tool and m.tool in ('copilot', 'cursor') and m.gen_type = 'chat' and m.fp = '' and abs(m.ts_ns - e.ts_ns) <= 3600000000000) then 'chat' else gen_type end as gen_type from e""")
def j07(t: Tables) -> DataFrame:
    e = t.edits_v.withColumns({"file_path": F.expr("case when id % 3 = 0 and gen_type = 'chat' then '' else file_path end"), "is_tab": rules.is_tab_log(c("tool"), c("raw_meta"))})
    return joins.upgraded_completions(e, 60 * joins.MINUTE).select("id", "gen_type")


SCOPE = "select distinct repo_path, file_path, concat('s', cast(id % 20 as varchar(9))) as session_id, concat('b', cast(id % 2 as varchar(9))) as branch from edits_v"


@query("j08_session_scope", f"with sc as (select distinct repo_path, file_path, session_id from ({SCOPE})), e as (select *, case when id % 4 = 0 then null else session_id end as sid from edits_v) select e.id, sc.session_id as scope_session_id from e join sc on e.repo_path = sc.repo_path and e.file_path = sc.file_path and (e.sid = sc.session_id or e.sid is null)")
def j08(t: Tables) -> DataFrame:
    e = t.edits_v.withColumn("session_id", F.expr("case when id % 4 = 0 then null else session_id end"))
    return joins.scoped(e, t.sql(SCOPE).select("repo_path", "file_path", "session_id").distinct(), ["repo_path", "file_path"], "session_id").select("id", "scope_session_id")


@query("j09_branch_scope", f"with sc as (select distinct repo_path, file_path, branch from ({SCOPE})), e as (select *, case when id % 4 = 0 then '' else branch end as br from edits_v) select e.id, sc.branch as scope_branch from e join sc on e.repo_path = sc.repo_path and e.file_path = sc.file_path and (e.br = sc.branch or coalesce(e.br, '') = '')")
def j09(t: Tables) -> DataFrame:
    e = t.edits_v.withColumn("branch", F.expr("case when id % 4 = 0 then '' else branch end"))
    return joins.scoped(e, t.sql(SCOPE).select("repo_path", "file_path", "branch").distinct(), ["repo_path", "file_path"], "branch").select("id", "scope_branch")


@query("j10_unbounded_scope", "select c.sha, e.id from commits_v c join edits_v e on e.repo_path = c.repo_path and e.file_path = 'src/f1.py' where c.n % 200 = 0")
def j10(t: Tables) -> DataFrame:
    files = t.commits_v.select("sha", "repo_path", F.lit("src/f1.py").alias("file_path"), F.expr("case when n % 200 = 0 then 'squash_merge' end").alias("replay_kind"))
    return joins.every_edit(t.edits_v, files).select("sha", "id")


EXACT = f"""
with w as ({IN_WINDOW}), r as (select *, row_number() over (partition by sha, repo_path, file_path order by {RANK}) as rnk from w e where {ELIGIBLE}),
u as (select r.sha, r.repo_path, r.file_path, r.id as edit_id, l.content_sha, row_number() over (partition by r.sha, r.repo_path, r.file_path, l.content_sha order by rnk, r.id) as k from r join edit_lines_v l on l.edit_id = r.id),
a as (select *, row_number() over (partition by sha, repo_path, file_path, content_sha order by line_no) as k from added_v)
"""


@query("j11_consume_once_exact", f"{EXACT} select a.sha, a.file_path, cast(a.line_no as int) as line_no, u.edit_id from a join u on a.sha = u.sha and a.repo_path = u.repo_path and a.file_path = u.file_path and a.content_sha = u.content_sha and a.k = u.k")
def j11(t: Tables) -> DataFrame:
    units = candidates(t, rules.ai_eligible(c("tool"), c("raw_meta")))
    return match.exact(added(t), units, [*FILE, "content_sha"]).select("sha", "file_path", "line_no", "edit_id")


# Of one file and hash: lines in order, even ones without an exact unit; edits in order with what they have of the hash.
# The walk takes line after line: an exact one the first edit with some left and one of its normalised units, another
# one the first edit with a normalised unit left.
WALK = f"""{EXACT.replace("with w", "with recursive w", 1)},
un as (select sha, repo_path, file_path, content_sha, list(edit_id order by rnk) as edits, list(n order by rnk) as n from (select r.sha, r.repo_path, r.file_path, l.content_sha, r.id as edit_id, any_value(rnk) as rnk, count(*) as n from r join edit_lines_v l on l.edit_id = r.id group by all) group by all),
gr as (select un.*, lines from un join (select sha, repo_path, file_path, content_sha, list(line_no order by line_no) as lines from added_v group by all) using (sha, repo_path, file_path, content_sha)),
st as (select sha, file_path, content_sha, edits, lines, 0 as k, n as whole, n as norm, cast(null as bigint) as hit from gr
  union all select sha, file_path, content_sha, edits, lines, k + 1, case when lines[k + 1] % 2 = 1 and e1 is not null then list_transform(whole, lambda v, i: v - (i = e1)::int) else whole end,
    list_transform(norm, lambda v, i: greatest(v - (i = e)::int, 0)), edits[e]
    from (select *, case when lines[k + 1] % 2 = 1 and e1 is not null then e1 else e2 end as e from (select *, list_position(list_transform(whole, lambda v: v > 0), true) as e1, list_position(list_transform(norm, lambda v: v > 0), true) as e2 from st where k < len(lines))))"""


@query("j12_consume_once_normalised", f"{WALK} select sha, file_path, cast(lines[k] as int) as line_no, hit as edit_id from st where hit is not null")
def j12(t: Tables) -> DataFrame:
    units = candidates(t, rules.ai_eligible(c("tool"), c("raw_meta")), added(t))
    return match.consume_once(drifted(t), units, FILE).select("sha", "file_path", "line_no", "edit_id")


@query("j13_matcher_precedence", f"""
with w as ({IN_WINDOW}), p as (select *, case when tool = 'cursor' and coalesce(json_extract_string(raw_meta, '$.source') = 'cursor_tab_log', false) then 0 when tool = 'copypaste' then 1 else 2 end as pass from w e where tool = 'copypaste' or ({ELIGIBLE})),
u as (select p.sha, p.repo_path, p.file_path, p.pass, l.content_sha, count(*) as n from p join edit_lines_v l on l.edit_id = p.id group by all),
tab as (select p.sha, p.repo_path, p.file_path, 2 as pass, l.content_sha, count(*) as n from p join edit_lines_v l on l.edit_id = p.id where pass = 0 group by all),
v as (select sha, repo_path, file_path, content_sha, sum(n) filter (pass = 0) as n0, sum(n) filter (pass = 1) as n1, sum(n) filter (pass = 2) as n2 from (select * from u union all select * from tab) group by all),
a as (select *, row_number() over (partition by sha, repo_path, file_path, content_sha order by line_no) as k from added_v)
select a.sha, a.file_path, cast(a.line_no as int) as line_no, case when k <= coalesce(n0, 0) then 'tab' when k <= coalesce(n0, 0) + coalesce(n1, 0) then 'paste' else 'ai' end as rule
from a join v on a.sha = v.sha and a.repo_path = v.repo_path and a.file_path = v.file_path and a.content_sha = v.content_sha where k <= coalesce(n0, 0) + coalesce(n1, 0) + coalesce(n2, 0)""")
def j13(t: Tables) -> DataFrame:
    edits = joins.in_window(t.edit_docs_v, t.windows_v, ["repo_path"])
    return match.by_precedence(added(t), match.pass_units(edits, hashes(t), FILE, rules.passes(), lines=added(t)), FILE).select("sha", "file_path", "line_no", "rule")


@query("j14_removed_line_match", f"""{EXACT}, um as materialized (select sha, repo_path, file_path, content_sha, k, edit_id from u),
d as materialized (select sha, repo_path, file_path, line_no, content_sha, case when line_no % 2 = 0 then 'x' || content_sha else content_sha end as drifted,
  row_number() over (partition by sha, repo_path, file_path, content_sha, line_no % 2 order by line_no) as k_all from added_v),
sure as materialized (select d.sha, d.repo_path, d.file_path, d.line_no, um.edit_id from d join um on d.sha = um.sha and d.repo_path = um.repo_path and d.file_path = um.file_path and d.drifted = um.content_sha and d.k_all = um.k),
rest as materialized (select d.*, row_number() over (partition by d.sha, d.repo_path, d.file_path, d.content_sha order by d.line_no) as k
  from d left join sure s on d.sha = s.sha and d.repo_path = s.repo_path and d.file_path = s.file_path and d.line_no = s.line_no where s.sha is null)
select sha, file_path, cast(line_no as int) as line_no, edit_id from sure union all
select r.sha, r.file_path, cast(r.line_no as int), um.edit_id from rest r join um on r.sha = um.sha and r.repo_path = um.repo_path and r.file_path = um.file_path and r.content_sha = um.content_sha and r.k = um.k""")
def j14(t: Tables) -> DataFrame:
    """Lines that went, half of them drifted: the exact budget first, then the normalised one, which it doesn't touch."""
    units = candidates(t, rules.ai_eligible(c("tool"), c("raw_meta")), added(t))
    return match.consume_once(drifted(t), units, FILE, "separate").select("sha", "file_path", "line_no", "edit_id")


@query("j15_source_note_match", """
with src as (select *, row_number() over (partition by sha, file_path, content_sha order by line_no) as k from added_v where line_no % 3 <> 0), a as (select *, row_number() over (partition by sha, file_path, content_sha order by line_no) as k from added_v)
select a.sha, a.file_path, cast(a.line_no as int) as line_no, cast(s.line_no as bigint) as edit_id from a join src s on a.sha = s.sha and a.file_path = s.file_path and a.content_sha = s.content_sha and a.k = s.k""")
def j15(t: Tables) -> DataFrame:
    """One flag for both hashes: of one content the k-th line takes the k-th unit, drifted or not."""
    key = ["sha", "file_path"]
    source = t.added_v.where("line_no % 3 <> 0").select(*key, c("line_no").alias("rank"), c("line_no").cast("long").alias("edit_id"), "content_sha", "content_sha_norm")
    return match.consume_once(drifted(t).drop("repo_path"), source, key, "flag").select(*key, "line_no", "edit_id")


OLD_NOTE = "select sha, path, line_no, 'AI' as author_type, 'claude' as tool, 'm9' as model, 'chat' as gen_type from attr_v where side = 'add' and (ts_ns // 1000000000) % 2 = 0 and not (line_no = 1 and path = 'src/f1.py')"


@query("j16_inherited_note_restore", f"""
with mine as (select sha, path, line_no, author_type, tool from attr_v where side = 'add'), old as ({OLD_NOTE}), same as (select m.sha, m.path from (select sha, path, list_sort(list(distinct line_no)) l from mine group by all) m join (select sha, path, list_sort(list(distinct line_no)) l from old group by all) o on m.sha = o.sha and m.path = o.path and m.l = o.l)
select m.sha, m.path, m.line_no, case when m.author_type <> 'AI' and o.sha is not null then 'AI' else m.author_type end as author_type, case when m.author_type <> 'AI' and o.sha is not null then 'claude' else m.tool end as tool
from mine m left join (select old.* from old join same using (sha, path)) o on m.sha = o.sha and m.path = o.path and m.line_no = o.line_no""")
def j16(t: Tables) -> DataFrame:
    cols = ["sha", "path", "line_no", "author_type", "tool", "model", "gen_type"]
    mine = t.attr_v.where("side = 'add'").select(*cols)
    old = t.sql(OLD_NOTE.replace("//", "div"))
    return joins.inherited(mine, old, ["sha", "path"]).select("sha", "path", "line_no", "author_type", "tool")


LOG = "select sha, concat('src/f', cast(n % 20 $div 10 as varchar(9)), '.py') as path, p as line_no, 'AI' as author_type, 'codex' as tool, 'm1' as model, 'cli' as gen_type from commits_v cross join (select 2 as p union all select 5) x"


@query("j17_added_lines_from_working_log", f"""with lg as ({LOG.replace("$div", "//")}) select a.sha, a.path, a.line_no, case when tr.sha is null then a.author_type when l.sha is null then 'Human' else 'AI' end as author_type, case when tr.sha is null then a.tool when l.sha is null then '' else 'codex' end as tool
from attr_v a left join (select distinct sha, path from lg) tr on a.sha = tr.sha and a.path = tr.path left join lg l on a.sha = l.sha and a.path = l.path and a.line_no = l.line_no where a.side = 'add'""")
def j17(t: Tables) -> DataFrame:
    lines = t.attr_v.where("side = 'add'").select("sha", "path", "line_no", "author_type", "tool", "model", "gen_type")
    return joins.from_working_log(lines, t.sql(LOG), ["sha", "path"]).select("sha", "path", "line_no", "author_type", "tool")


@query("j18_deleted_lines_from_log", """
with d as (select sha, path, case when path = 'src/f1.py' then 'src/f0.py' else path end as path_old, line_no, content from attr_v where side = 'del'),
lg as (select sha, path as file, content, min(author_type) as author_type, min(tool) as tool from attr_v where side = 'del' and line_no % 2 = 0 group by all), tr as (select distinct sha, path from attr_v where (ts_ns // 1000000000) % 2 = 0)
select d.sha, d.path, d.line_no, coalesce(a.author_type, b.author_type, case when tr.sha is not null then 'Human' end) as author_type from d left join lg a on a.sha = d.sha and a.file = d.path_old and a.content = d.content
left join lg b on b.sha = d.sha and b.file = d.path and b.content = d.content left join tr on tr.sha = d.sha and tr.path = d.path""")
def j18(t: Tables) -> DataFrame:
    d = t.attr_v.where("side = 'del'").select("sha", "path", F.expr("case when path = 'src/f1.py' then 'src/f0.py' else path end").alias("path_old"), "line_no", "content")
    log = t.attr_v.where("side = 'del' and line_no % 2 = 0").groupBy("sha", c("path").alias("file"), "content").agg(F.min("author_type").alias("author_type"), F.min("tool").alias("tool"))
    tracked = t.attr_v.where("(ts_ns div 1000000000) % 2 = 0").select("sha", c("path").alias("file"))
    return joins.deletions_from_log(d, log, tracked).select("sha", "path", "line_no", "author_type")


@query("j19_merge_restriction", "select sha, file_path, cast(line_no as int) as line_no from added_v where line_no % 3 <> 0")
def j19(t: Tables) -> DataFrame:
    key = ["sha", "file_path", "line_no"]
    return joins.both_parents(t.added_v.select(*key), t.added_v.where("line_no % 3 <> 0").select(*key), key)


@query("j20_blame_to_note", """select b.path, cast(b.final_line as int) as final_line, b.sha, case when r.sha is null then 'Human' else 'AI' end as author_type, coalesce(r.tool, '') as tool from blame_v b
left join ranges_v r on r.sha = b.sha and r.path = b.path and b.origin_line between r.start_line and r.end_line and r.author_type = 'AI' and coalesce(r.tool, '') <> ''""")
def j20(t: Tables) -> DataFrame:
    return joins.blame_authors(t.blame_v, t.ranges_v).select("path", "final_line", "sha", "author_type", "tool")


@query("j21_live_overrides", f"""
with b as (select repo_path, min(ts_ns) as base_ns, arg_min(sha, ts_ns) as sha from commits_v group by repo_path), w as (select b.sha, e.* from edits_v e join b on e.repo_path = b.repo_path and e.ts_ns > b.base_ns),
p as (select *, case when tool = 'copypaste' then 1 else 2 end as pass from w e where tool = 'copypaste' or ({ELIGIBLE})), v as (select p.sha, p.file_path, l.content_sha, count(*) filter (pass = 1) as n1, count(*) filter (pass = 2) as n2 from p join edit_lines_v l on l.edit_id = p.id group by all),
a as (select *, row_number() over (partition by sha, file_path, content_sha order by line_no) as k from added_v where line_no % 2 = 1)
select a.sha, a.file_path, cast(a.line_no as int) as line_no, case when k <= n1 then 'paste' else 'ai' end as rule from a join v on a.sha = v.sha and a.file_path = v.file_path and a.content_sha = v.content_sha where k <= n1 + n2""")
def j21(t: Tables) -> DataFrame:
    """Each repository has one live base; its changed lines may match any edit since."""
    base = t.commits_v.groupBy("repo_path").agg(F.min("ts_ns").alias("base_ns"), F.min_by("sha", "ts_ns").alias("sha"))
    edits = t.edit_docs_v.join(base, "repo_path").where(c("ts_ns") > c("base_ns"))
    changed = added(t).where("line_no % 2 = 1").join(base.select("sha"), "sha", "left_semi")
    passes = {name: rule for name, rule in rules.passes().items() if name != "tab"}
    return match.by_precedence(changed, match.pass_units(edits, hashes(t), FILE, passes), FILE).select("sha", "file_path", "line_no", "rule")


@query("j22_confirmed_chat_sessions", """
with r as (select case when id % 3 = 0 then '' else repo_path end as repo_path, session_id as session_path from edits_v where gen_type = 'chat')
select k.repo_path, k.session_path, count(*) as n_rows from (select distinct repo_path, session_path from r where repo_path <> '') k join r on r.session_path = k.session_path and (r.repo_path = k.repo_path or r.repo_path = '') group by all""")
def j22(t: Tables) -> DataFrame:
    rows = t.edits_v.where("gen_type = 'chat'").select(F.expr("case when id % 3 = 0 then '' else repo_path end").alias("repo_path"), c("session_id").alias("session_path"))
    return joins.confirmed_sessions(rows)


@query("j23_file_operation_backfill", """
with k as (select *, case when (ts_ns // 1000000000) % 3 = 0 then 'DELETED' when (ts_ns // 1000000000) % 3 = 1 then 'ADDED' else 'RENAMED' end as kind from attr_v)
select sha, path, side, line_no, case when kind = 'RENAMED' or path = 'src/f1.py' or author_type = 'AI' then author_type else 'AI' end as author_type, case when kind = 'RENAMED' or path = 'src/f1.py' or author_type = 'AI' then tool when kind = 'DELETED' then 'codex' else 'claude' end as tool from k""")
def j23(t: Tables) -> DataFrame:
    kind = F.expr("case when (ts_ns div 1000000000) % 3 = 0 then 'DELETED' when (ts_ns div 1000000000) % 3 = 1 then 'ADDED' else 'RENAMED' end")
    ops = t.commits_v.select("sha", F.lit("src/f0.py").alias("path"), F.explode(F.expr("array(named_struct('op', 'write', 'tool', 'cursor', 'o', 2), named_struct('op', 'write', 'tool', 'claude', 'o', 1), named_struct('op', 'delete', 'tool', 'codex', 'o', 3))")).alias("x"))
    got = joins.backfilled(t.attr_v.withColumn("kind", kind), ops.select("sha", "path", "x.op", "x.tool", c("x.o").alias("order")))
    return got.select("sha", "path", "side", "line_no", "author_type", "tool")


@query("j24_first_line_per_edit", "select e.id, cast(min(l.line_no) as int) as first_line from edits_v e left join edit_lines_v l on l.edit_id = e.id group by e.id")
def j24(t: Tables) -> DataFrame:
    return joins.first_line(t.edits_v.select("id"), t.edit_lines_v.withColumn("ord", c("line_no"))).select("id", "first_line")


RENAMES = "select sha, file as path, case when n % 20 = 0 then 'src/old.py' else file end as path_old from (select n, base_sha as sha, file from logs_v) x"
GONE = "select base_sha as sha, case when n % 20 = 0 then 'src/old.py' else file end as file, n % 7 as n_deleted from logs_v where n % 30 <> 0"


@query("j25_rename_lookup", f"with f as ({RENAMES}), d as ({GONE}) select f.sha, f.path, f.path_old, cast(coalesce(a.n_deleted, b.n_deleted, 0) as bigint) as n_deleted from f left join d a on a.sha = f.sha and a.file = f.path left join d b on b.sha = f.sha and b.file = f.path_old")
def j25(t: Tables) -> DataFrame:
    return joins.by_old_path(t.sql(RENAMES), t.sql(GONE))


@query("j26_work_session_get_or_create", "select distinct repo_path, branch, base_sha, sha256(concat_ws(chr(31), repo_path, branch, base_sha)) as session_key from (select repo_path, branch, concat('c', cast(id % 30 as varchar)) as base_sha, id from edits_v) where not (branch = 'b0' and base_sha = 'c2')")
def j26(t: Tables) -> DataFrame:
    e = t.edits_v.select("repo_path", "branch", F.expr("concat('c', cast(id % 30 as string))").alias("base_sha"))
    known = e.where("branch = 'b0' and base_sha = 'c2'").select(joins.work_session_id(c("repo_path"), c("branch"), c("base_sha")).alias("session_key")).distinct()
    return joins.new_sessions(e, known).select("repo_path", "branch", "base_sha", "session_key")


@query("j27_session_transcripts", "select session_id, arg_min(tool, id) as tool, min(id) as id from edits_v where tool <> '' group by session_id")
def j27(t: Tables) -> DataFrame:
    from lineweave.operators.windows import first_seen

    return first_seen(t.edits_v.where("tool <> ''").select("session_id", "tool", "id"), ["session_id"], "id")


@query("j28_live_and_note_agreement", "select sha, path, side, line_no, case when line_no % 5 = 0 and side = 'add' then author_type end as note_author, case when line_no % 5 = 0 then null else 'Robot' end as live_author from attr_v where line_no % 5 in (0, 1) and side = 'add'")
def j28(t: Tables) -> DataFrame:
    key = ["sha", "path", "side", "line_no"]
    note = t.attr_v.where("side = 'add' and line_no % 5 <> 1").select(*key, "author_type", "tool")
    live = t.attr_v.where("side = 'add' and line_no % 5 <> 0").select(*key, F.when(c("line_no") % 5 == 1, "Robot").otherwise(c("author_type")).alias("author_type"), "tool")
    return joins.disagreements(note, live, key)


DOC_OF = "n div 10 % (select count(*) from @documents)"


@query("j29_shell_deletions_to_removed_lines", """select l.n as command_id, l.repo_path, l.file as file_path, d.pos, sha256(d.content) as content_sha from logs_v l join doc_lines_v d on d.doc_id = l.n // 10 % (select count(*) from documents) where l.n % 20 = 0 and trim(d.content) <> ''""")
def j29(t: Tables) -> DataFrame:
    logs = t.sql(f"select *, {DOC_OF} as doc_id from logs_v")
    head = logs.join(t.documents.select("doc_id", "text"), "doc_id").select("repo_path", F.expr("concat('x', n, '/', file)").alias("file_path"), c("text").alias("content"))
    commands = logs.select(c("n").alias("command_id"), "repo_path", F.expr("concat('x', n)").alias("cwd"), shell.delete_targets(F.expr("concat(case when n % 20 = 0 then 'rm -rf ' else 'ls ' end, file)")).alias("targets"))
    got = joins.deletions_to_hashes(commands, head)
    return got.select("command_id", "repo_path", F.regexp_replace("file_path", "^x[0-9]+/", "").alias("file_path"), "pos", "content_sha")


@query("j30_shell_writes_to_edits", """select l.n as command_id, l.file as file_path, d.pos + 1 as line_no, case when trim(d.content) = '' then '' else sha256(d.content) end as content_sha, 'medium' as confidence from logs_v l join doc_lines_v d on d.doc_id = l.n // 10 % (select count(*) from documents) where l.n % 20 = 0""")
def j30(t: Tables) -> DataFrame:
    from lineweave.operators.diff import line_rows

    logs = t.sql(f"select *, {DOC_OF} as doc_id from logs_v")
    commands = logs.selectExpr("n as command_id", "concat(repo_path, '/', n) as repo_path", "n * 1000000000 as start_ns", "(n + 5) * 1000000000 as end_ns")
    files = logs.selectExpr("concat(repo_path, '/', n) as repo_path", "file as file_path", "(n + case when n % 20 = 0 then 1 else 100 end) * 1000000000 as mtime_ns", "doc_id")
    hit = joins.write_window(commands, files).join(files, ["repo_path", "file_path"]).join(t.documents.select("doc_id", c("text").alias("content")), "doc_id")
    return line_rows(hit, "content", "command_id", "file_path", most=None).select("command_id", "file_path", "line_no", "content_sha", F.lit("medium").alias("confidence"))
