"""Queries for line differences and alignment (E rows, and S18 and S19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.functions import text
from lineweave.operators import align, diff, joins, windows
from lineweave.plans.registry import ALIKE, Tables, query

c = F.col
KEY = ["doc_id"]
# Texts of the two versions, built from the views so that both engines see the same lines.
OLD_TEXT = "select doc_id, array_join(transform(array_sort(collect_list(struct(pos, content))), x -> x.content), '\\n') as old_text from old_v group by doc_id"
NEW_TEXT = "select doc_id, array_join(transform(array_sort(collect_list(struct(pos, content))), x -> x.content), '\\n') as new_text from new_v group by doc_id"
STRIPPED = "regexp_replace(content, '\\s', '', 'g')"


def lcs(old: str, new: str) -> str:
    """CTEs for DuckDB: ``al``, the longest common subsequence as (doc_id, new_pos, old_pos), and ``mv``, the moves.

    old and new select doc_id, pos, s. ``rw`` holds the table's rows from the last old line up, ``tr`` walks it: a match
    is taken, else the old line is passed over if that loses nothing.
    """
    return f"""ol as ({old}), nl as ({new}), pr as (select * from (select doc_id, list(s order by pos) as a from ol group by doc_id) join (select doc_id, list(s order by pos) as b from nl group by doc_id) using (doc_id)),
rw as (select doc_id, len(a) as i, list_transform(range(len(b) + 1), lambda x: cast(0 as bigint)) as r from pr
  union all select doc_id, i - 1, list_append(list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(j, len(b) + 1), lambda k: case when b[k] = a[i] then r[k + 1] + 1 else r[k] end))), cast(0 as bigint)) from rw join pr using (doc_id) where i > 0),
tr as (select doc_id, cast(0 as bigint) as i, cast(0 as bigint) as j, cast(null as bigint) as old_pos, cast(null as bigint) as new_pos from pr
  union all select doc_id, case when same or skip then i + 1 else i end, case when same or not skip then j + 1 else j end, case when same then i end, case when same then j end
    from (select t.doc_id, t.i, t.j, a[t.i + 1] = b[t.j + 1] as same, lower_row.r[t.j + 1] >= upper_row.r[t.j + 2] as skip from tr t join pr p on p.doc_id = t.doc_id join rw upper_row on upper_row.doc_id = t.doc_id and upper_row.i = t.i
      join rw lower_row on lower_row.doc_id = t.doc_id and lower_row.i = t.i + 1 where t.i < len(a) and t.j < len(b))),
al as (select doc_id, new_pos, old_pos from tr where new_pos is not null),
mv as (select n.doc_id, n.pos as new_pos, o.pos as old_pos from (select *, row_number() over (partition by doc_id, s order by pos) as k from nl anti join (select doc_id, new_pos as pos from al) using (doc_id, pos)) n
  join (select *, row_number() over (partition by doc_id, s order by pos) as k from ol anti join (select doc_id, old_pos as pos from al) using (doc_id, pos)) o using (doc_id, s, k)),
kept as (select *, false as moved from al union all select *, true from mv)"""


VERSIONS = lcs(f"select doc_id, pos, {STRIPPED} as s from old_v", f"select doc_id, pos, {STRIPPED} as s from new_v")
RAW_VERSIONS = lcs("select doc_id, pos, content as s from old_v", "select doc_id, pos, content as s from new_v")
# Of each gap between matches the k-th free new line replaces the k-th free old one.
REPLACED = """nf as (select n.doc_id, n.pos, (select count(*) from al where al.doc_id = n.doc_id and al.new_pos < n.pos) as gap from nl n anti join (select doc_id, new_pos as pos from kept) using (doc_id, pos)),
of as (select o.doc_id, o.pos, (select count(*) from al where al.doc_id = o.doc_id and al.old_pos < o.pos) as gap from ol o anti join (select doc_id, old_pos as pos from kept) using (doc_id, pos)),
rp as (select n.doc_id, n.pos as new_pos, o.pos as old_pos from (select *, row_number() over (partition by doc_id, gap order by pos) as k from nf) n join (select *, row_number() over (partition by doc_id, gap order by pos) as k from of) o using (doc_id, gap, k))"""


def pairs(t: Tables) -> DataFrame:
    return t.sql(OLD_TEXT).join(t.sql(NEW_TEXT), "doc_id")


def deleted(t: Tables) -> DataFrame:
    """Old lines that an alignment with moves leaves out."""
    kept = align.aligned(pairs(t), KEY).where(c("old_pos").isNotNull()).select("doc_id", c("old_pos").alias("pos"))
    both = t.new_v.select("doc_id").distinct()
    return t.old_v.join(both, "doc_id", "left_semi").join(kept, ["doc_id", "pos"], "left_anti")


@query("e01_lcs_line_alignment", f"with recursive {VERSIONS} select nl.doc_id, cast(nl.pos as int) as new_pos, cast(old_pos as int) as old_pos, coalesce(moved, false) as moved from nl join pr using (doc_id) left join kept on kept.doc_id = nl.doc_id and kept.new_pos = nl.pos")
def e01(t: Tables) -> DataFrame:
    return align.aligned(pairs(t), KEY)


@query("e02_move_detection", """
with a as (select doc_id, pos, content, row_number() over (partition by doc_id, content order by pos) as k from old_v where pos % 2 = 0), b as (select doc_id, pos, content, row_number() over (partition by doc_id, content order by pos) as k from doc_lines_v where pos % 3 <> 1)
select b.doc_id, b.pos as new_pos, a.pos as old_pos from a join b on a.doc_id = b.doc_id and a.content = b.content and a.k = b.k""")
def e02(t: Tables) -> DataFrame:
    return diff.pair_moves(t.old_v.where("pos % 2 = 0"), t.doc_lines_v.where("pos % 3 <> 1"), KEY)


CHANGED = "select doc_id, pos, case when pos % 4 = 1 then concat('changed ', cast(doc_id as varchar(19))) else content end as content from old_v"
CHANGED_TEXT = f"select doc_id, array_join(transform(array_sort(collect_list(struct(pos, content))), x -> x.content), '\\n') as new_text from ({CHANGED}) group by doc_id"
CHANGES = lcs(f"select doc_id, pos, {STRIPPED} as s from old_v", f"select doc_id, pos, {STRIPPED} as s from ({CHANGED})")


@query("e03_override_detection", f"with recursive {CHANGES}, {REPLACED} select doc_id, cast(new_pos + 1 as int) as line_no, 'Human' as author_type, 'AI' as overrode from rp")
def e03(t: Tables) -> DataFrame:
    """A person rewrites every fourth of an AI's lines."""
    edits = fold_input(t.sql(OLD_TEXT).join(t.sql(CHANGED_TEXT), "doc_id"))
    return align.fold(edits, KEY).where(c("overrode").isNotNull()).select("doc_id", "line_no", "author_type", "overrode")


def fold_input(p: DataFrame) -> DataFrame:
    """Two edits of each file: an AI writes the old version, a person makes it the new one."""
    one = lambda text_, ts, kind, tool: p.select("doc_id", F.lit(ts).alias("ts"), F.lit(ts).alias("id"), c(text_).alias("content"), F.lit("").alias("baseline"), F.lit(kind).alias("author_type"), F.lit(tool).alias("tool"), F.lit("").alias("model"), F.lit("").alias("gen_type"), F.lit("").alias("session"))
    return one("old_text", 1, "AI", "claude").unionByName(one("new_text", 2, "Human", ""))


SQL_OF_FOLD = f"""with recursive {VERSIONS}, {REPLACED} select nl.doc_id, cast(nl.pos + 1 as int) as line_no, case when k.new_pos is null then 'Human' else 'AI' end as author_type, case when k.new_pos is null then '' else 'claude' end as tool, case when rp.new_pos is not null then 'AI' end as overrode
from nl join pr using (doc_id) left join kept k on k.doc_id = nl.doc_id and k.new_pos = nl.pos left join rp on rp.doc_id = nl.doc_id and rp.new_pos = nl.pos"""


@query("e04_attribute_fold", SQL_OF_FOLD)
def e04(t: Tables) -> DataFrame:
    return align.fold(fold_input(pairs(t)), KEY).select("doc_id", "line_no", "author_type", "tool", "overrode")


@query("e05_deleted_baseline_lines", f"with recursive {VERSIONS} select ol.doc_id, cast(ol.pos as int) as pos from ol join pr using (doc_id) anti join (select doc_id, old_pos as pos from kept) k on k.doc_id = ol.doc_id and k.pos = ol.pos")
def e05(t: Tables) -> DataFrame:
    return deleted(t).select("doc_id", "pos")


BEYOND = "select {a}.doc_id, {a}.pos, {a}.content from (select *, row_number() over (partition by doc_id, content order by pos) as k from {a}) {a} left join (select doc_id, content, count(*) as n from {b} group by all) o using (doc_id, content) where k > coalesce(n, 0)"


@query("e06_multiset_diff", f"""with x as ({BEYOND.format(a="new_v", b="old_v")}), y as (select *, pos - row_number() over (partition by doc_id order by pos) as g from x)
select doc_id, cast(min(pos) + 1 as int) as start_line, cast(max(pos) + 1 as int) as end_line from y group by doc_id, g""")
def e06(t: Tables) -> DataFrame:
    new = diff.added_lines(t.old_v, t.new_v, KEY).select("doc_id", (c("pos") + 1).alias("line_no"))
    return windows.collapse_ranges(new, KEY, [])


@query("e07_added_or_moved_diff", f"with recursive {RAW_VERSIONS} select nl.doc_id, cast(nl.pos + 1 as int) as line_no, nl.s as content, true as exact from nl join pr using (doc_id) anti join al on al.doc_id = nl.doc_id and al.new_pos = nl.pos")
def e07(t: Tables) -> DataFrame:
    return align.added_or_moved(pairs(t), KEY)


@query("e08_removed_line_hashes", f"with x as ({BEYOND.format(a='old_v', b='new_v')}) select doc_id, cast(pos as int) as pos, sha256(content) as content_sha from x where trim(content) <> ''")
def e08(t: Tables) -> DataFrame:
    return diff.removed_hashes(t.old_v, t.new_v, KEY).select("doc_id", "pos", "content_sha")


# A diff of two files for each document: the first has a hunk for each eight lines, of which the first of four stays, the
# second changes in white space, the third goes and the fourth comes; the second file is all new.
DIFF = """
select doc_id, concat('diff --git a/src/d', doc_id, '.py b/src/d', doc_id, '.py\\nindex 1..2 100644\\n--- a/src/d', doc_id, '.py\\n+++ b/src/d', doc_id, '.py\\t\\n', array_join(transform(array_sort(collect_list(struct(hunk, body))), x -> x.body), '\\n'),
  '\\ndiff --git a/new.txt b/new.txt\\nnew file mode 100644\\n--- /dev/null\\n+++ b/new.txt\\n@@ -0,0 +1', case when sum(n) = 1 then '' else concat(',', sum(n)) end, ' @@\\n', array_join(transform(array_sort(collect_list(struct(hunk, plus))), x -> x.plus), '\\n'), '\\n\\\\ No newline at end of file') as diff
from (select doc_id, pos div 8 as hunk, count(*) as n, array_join(transform(array_sort(collect_list(struct(pos, concat('+', content) as line))), x -> x.line), '\\n') as plus,
    concat('@@ -', 1 + 6 * (pos div 8), ',', count_if(pos % 4 <> 3), ' +', 1 + 6 * (pos div 8), ',', count_if(pos % 4 <> 2), ' @@ def f\\n', array_join(transform(array_sort(collect_list(struct(pos,
      case pos % 4 when 0 then concat(' ', content) when 1 then concat('-', content, '\\n+', content, '  ') when 2 then concat('-', content) else concat('+', content) end as line))), x -> x.line), '\\n')) as body
  from doc_lines_v group by doc_id, pos div 8) group by doc_id"""
# The same lines for DuckDB: of the first file those that go (d) and those that come (a), with hunk and number.
GONE = "d as (select doc_id, pos // 8 as hunk, pos, pos // 4 * 3 + pos % 4 + 1 as n, content from doc_lines_v where pos % 4 in (1, 2))"
CAME = "a as (select doc_id, pos // 8 as hunk, pos, pos // 4 * 3 + case when pos % 4 = 1 then 2 else 3 end as n, case when pos % 4 = 1 then content || '  ' else content end as content from doc_lines_v where pos % 4 in (1, 3))"
OWN = "'src/d' || doc_id || '.py'"


def diffs(t: Tables) -> DataFrame:
    return t.sql(DIFF)


@query("s18_unified_diff_lines", f"""with {GONE}, {CAME} select doc_id, {OWN} as path, '-' as sign, cast(n as int) as line_no, content from d union all select doc_id, {OWN}, '+', cast(n as int), content from a
union all select doc_id, {OWN}, ' ', cast(pos // 4 * 3 + 1 as int), content from doc_lines_v where pos % 4 = 0 union all select doc_id, 'new.txt', '+', cast(pos + 1 as int), content from doc_lines_v""")
def s18(t: Tables) -> DataFrame:
    return diff.hunk_lines(diffs(t), "diff", "doc_id").select("doc_id", c("path_new").alias("path"), "sign", "line_no", "content")


@query("s18_unified_diff_files", f"select doc_id, {OWN} as path, 'MODIFIED' as kind from documents where text is not null union all select doc_id, 'new.txt', 'ADDED' from documents where text is not null")
def s18_files(t: Tables) -> DataFrame:
    return diff.file_changes(diffs(t), "diff", "doc_id").select("doc_id", "path", "kind")


@query("s19_changed_lines_from_hunks", "with n as (select doc_id, count(*) filter (pos % 4 <> 2) as own, count(*) as new from doc_lines_v group by doc_id) select doc_id, cast(unnest(range(1, own + 1)) as int) as line_no from n union all select doc_id, cast(unnest(range(1, new + 1)) as int) from n")
def s19(t: Tables) -> DataFrame:
    heads = diffs(t).select("doc_id", F.explode(F.split("diff", "\n")).alias("line"))
    return diff.hunk_new_lines(heads, "line", "doc_id")


@query("e09_diff_added_lines", f"with {CAME} select doc_id, {OWN} as path, cast(n as int) as line_no from a union all select doc_id, 'new.txt', cast(pos + 1 as int) from doc_lines_v")
def e09(t: Tables) -> DataFrame:
    return diff.hunk_lines(diffs(t), "diff", "doc_id").where("sign = '+'").select("doc_id", c("path_new").alias("path"), "line_no")


@query("e10_diff_removed_lines", f"""with {CAME}, o as (select *, row_number() over (partition by doc_id, pos // 8, content order by pos) as k from doc_lines_v where pos % 4 <> 3),
w as (select doc_id, hunk, content, count(*) as n from (select doc_id, hunk, content from a union all select doc_id, pos // 8, content from doc_lines_v where pos % 4 = 0) group by all)
select o.doc_id, sha256(o.content) as content_sha from o left join w on w.doc_id = o.doc_id and w.hunk = o.pos // 8 and w.content = o.content where k > coalesce(n, 0) and trim(o.content) <> ''""")
def e10(t: Tables) -> DataFrame:
    return diff.hunk_removed(diff.hunk_lines(diffs(t), "diff", "doc_id"), "doc_id").select("doc_id", "content_sha")


@query("e11_narrow_to_changed", f"""with recursive {RAW_VERSIONS}, fresh as (select nl.* from nl join pr using (doc_id) anti join al on al.doc_id = nl.doc_id and al.new_pos = nl.pos)
select doc_id, cast(pos + 10 as int) as line_no, s as content from fresh union all select doc_id, cast(pos + 10 as int), s from nl join pr using (doc_id) where doc_id not in (select doc_id from fresh)""")
def e11(t: Tables) -> DataFrame:
    """Every line of both versions ends, so an empty last one is a line too, as in the SQL."""
    ended = {x: F.concat(x, F.lit("\n")) for x in ("old_text", "new_text")}
    return align.narrowed(pairs(t).withColumns(ended).withColumn("start_line", F.lit(10)), KEY)


@query("e12_narrow_whole_file_write", f"""with recursive {RAW_VERSIONS} select nl.doc_id, cast(nl.pos + 1 as int) as line_no, sha256(regexp_replace(nl.s, '\\r+$', '')) as content_sha from nl
left join al on al.doc_id = nl.doc_id and al.new_pos = nl.pos where trim(nl.s) <> '' and (nl.doc_id % 3 = 0 or al.new_pos is null)""")
def e12(t: Tables) -> DataFrame:
    """Changed lines against the file's snapshot, blank ones left out; without a snapshot all lines."""
    snapshots = t.sql(OLD_TEXT).where("doc_id % 3 <> 0")
    p = t.sql(NEW_TEXT).join(snapshots, "doc_id", "left").withColumn("old_text", F.coalesce("old_text", F.lit("")))
    return align.added_or_moved(p, KEY).where(~text.is_blank(c("content"))).select("doc_id", "line_no", text.line_sha(c("content")).alias("content_sha"))


@query("e13_net_unchanged_lines", """
with a as (select edit_id, line_no as ord, content_sha, row_number() over (partition by edit_id, content_sha order by line_no) as k from edit_lines_v where line_no % 3 <> 0), b as (select edit_id, line_no as ord, content_sha, row_number() over (partition by edit_id, content_sha order by line_no) as k from edit_lines_v where line_no % 2 = 0)
select 'added' as side, edit_id, cast(ord as int) as ord from a where not exists (select 1 from b where b.edit_id = a.edit_id and b.content_sha = a.content_sha and b.k = a.k)
union all select 'removed', edit_id, cast(ord as int) from b where not exists (select 1 from a where b.edit_id = a.edit_id and b.content_sha = a.content_sha and b.k = a.k)""")
def e13(t: Tables) -> DataFrame:
    lines = t.edit_lines_v.select("edit_id", c("line_no").alias("ord"), "content_sha")
    a, b = diff.net_unchanged(lines.where("ord % 3 <> 0"), lines.where("ord % 2 = 0"))
    return a.select(F.lit("added").alias("side"), "edit_id", "ord").unionByName(b.select(F.lit("removed").alias("side"), "edit_id", "ord"))


@query("e14_hunk_pairing", f"""with {GONE}, {CAME}, p as (select coalesce(x.doc_id, y.doc_id) as doc_id, x.n as old_n, y.n as new_n, x.content as a, y.content as b from (select *, row_number() over (partition by doc_id, hunk order by pos) as k from d) x
  full join (select *, row_number() over (partition by doc_id, hunk order by pos) as k from a) y on x.doc_id = y.doc_id and x.hunk = y.hunk and x.k = y.k), q as (select *, {ALIKE} as alike from p)
select doc_id, 'add' as side, {OWN} as path, cast(new_n as int) as line_no, b as content from q where b is not null and (a is null or a <> b) union all select doc_id, 'del', {OWN}, cast(old_n as int), a from q where a is not null and (b is null or (a <> b and not alike))
union all select doc_id, 'add', 'new.txt', cast(pos + 1 as int), content from doc_lines_v""")
def e14(t: Tables) -> DataFrame:
    return diff.changed_lines(diff.hunk_lines(diffs(t), "diff", "doc_id"), "doc_id")


@query("e15_range_expand", "select sha, path, cast(unnest(range(start_line, end_line + 1)) as int) as line_no from ranges_v")
def e15(t: Tables) -> DataFrame:
    return diff.range_lines(t.ranges_v, "start_line", "end_line").select("sha", "path", "line_no")


@query("e16_snapshot_section_narrowing", """
with s as (select doc_id, pos, content, row_number() over (partition by doc_id, content order by pos) as k from doc_lines_v where pos >= 2 and pos < 5), n as (select doc_id, content, count(*) as n from new_v group by all)
select doc_id, cast(pos as int) as pos, sha256(content) as content_sha from s left join n using (doc_id, content) where k > coalesce(n, 0) and trim(content) <> '' and doc_id in (select doc_id from new_v)""")
def e16(t: Tables) -> DataFrame:
    section = t.doc_lines_v.where("pos >= 2 and pos < 5").join(t.new_v.select("doc_id").distinct(), "doc_id", "left_semi")
    return diff.removed_hashes(section, t.new_v, KEY).select("doc_id", "pos", "content_sha")


@query("e17_per_line_content_ranges", "select doc_id, cast(pos + 1 as int) as line_no, case when trim(content) = '' then '' else sha256(content) end as content_sha from doc_lines_v where pos < 4000")
def e17(t: Tables) -> DataFrame:
    return diff.line_rows(t.documents, "text", "doc_id").select("doc_id", "line_no", "content_sha")


@query("e18_base_seeding", f"with recursive {VERSIONS} select nl.doc_id, cast(nl.pos + 1 as int) as line_no, case when k.new_pos is null then '' else 'gemini' end as tool from nl join pr using (doc_id) left join kept k on k.doc_id = nl.doc_id and k.new_pos = nl.pos")
def e18(t: Tables) -> DataFrame:
    """Committed authors are the state that a file's fold begins with."""
    seed = t.old_v.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("pos")), lambda _: F.struct(F.lit("AI").alias("author_type"), F.lit("gemini").alias("tool"), F.lit("").alias("model"), F.lit("").alias("gen_type"), F.lit("").alias("session"))).alias("authors"))
    edit = pairs(t).select("doc_id", F.lit(1).alias("ts"), F.lit(1).alias("id"), c("new_text").alias("content"), c("old_text").alias("baseline"), F.lit("Human").alias("author_type"), *[F.lit("").alias(x) for x in ("tool", "model", "gen_type", "session")])
    return align.fold(edit, KEY, seed).select("doc_id", "line_no", "tool")


@query("e19_baseline_choice", "select base_sha as sha, file, case when n % 20 = 0 then 'stored' when n % 30 = 0 then 'head' else '' end as baseline from logs_v")
def e19(t: Tables) -> DataFrame:
    stored = t.logs_v.where("n % 20 = 0").select("base_sha", "file", F.lit("stored").alias("a"))
    head = t.logs_v.where("n % 30 = 0").select("base_sha", "file", F.lit("head").alias("b"))
    rows = t.logs_v.join(stored, ["base_sha", "file"], "left").join(head, ["base_sha", "file"], "left")
    return rows.select(c("base_sha").alias("sha"), "file", F.coalesce("a", "b", F.lit("")).alias("baseline"))


@query("e20_exact_content_write_credit", """
with e as (select edit_id, list_sort(list(content_sha)) as l from edit_lines_v group by edit_id), d as (select sha, file_path, list_sort(list(content_sha)) as l from added_v group by all)
select d.sha, d.file_path, min(e.edit_id) as edit_id from d join e on d.l = e.l group by all""")
def e20(t: Tables) -> DataFrame:
    """Writes whose lines are the committed file's, as multisets. Off in the pipeline, where nothing is left for it."""
    of = lambda df, *keys: df.groupBy(*keys).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("content_sha")), ","), 256).alias("l"))
    got = of(t.added_v, "sha", "file_path").join(of(t.edit_lines_v, "edit_id"), "l")
    return got.groupBy("sha", "file_path").agg(F.min("edit_id").alias("edit_id"))


@query("e21_duplicate_block_rule", """
with l as (select sha, path, line_no, author_type from attr_v where side = 'add'), f as (select sha, path, count(*) >= 3 and count(*) filter (author_type <> 'AI') > 0 as turns from l group by all)
select sha, path, cast(line_no as int) as line_no, case when turns then 'AI' else author_type end as author_type from l join f using (sha, path) union all select sha, path, cast(line_no + 100000 as int), case when turns then 'Human' else 'AI' end from l join f using (sha, path)""")
def e21(t: Tables) -> DataFrame:
    """Each file's added lines, none equal to another, and then all of them once more from an AI."""
    once = t.attr_v.where("side = 'add'").select("sha", "path", "line_no", F.concat_ws(" ", "line_no", "content").alias("content"), "author_type")
    again = once.withColumns({"line_no": c("line_no") + 100000, "author_type": F.lit("AI")})
    return windows.blocks_of_copies(once.unionByName(again), ["sha", "path"]).select("sha", "path", "line_no", "author_type")


@query("e22_same_commit_move_credit", """
with a as (select *, row_number() over (partition by sha, content order by path, line_no) as k from attr_v where side = 'add' and author_type = 'AI'), d as (select *, row_number() over (partition by sha, content order by path, line_no) as k from attr_v where line_no % 2 = 0)
select d.sha, d.path, d.line_no, a.tool from d join a on d.sha = a.sha and d.content = a.content and d.k = a.k""")
def e22(t: Tables) -> DataFrame:
    """Deleted content that an AI adds again in the commit, each addition once."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("sha", "content").orderBy("path", "line_no"))
    a = t.attr_v.where("side = 'add' and author_type = 'AI'").withColumn("k", nth).select("sha", "content", "k", "tool")
    d = t.attr_v.where("line_no % 2 = 0").withColumn("k", nth).select("sha", "content", "k", "path", "line_no")
    return d.join(a, ["sha", "content", "k"]).select("sha", "path", "line_no", "tool")
