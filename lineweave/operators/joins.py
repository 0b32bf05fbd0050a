"""Joins of edits, commits, files, sessions and notes.

Edits have id, ts_ns, repo_path, file_path, tool, gen_type, model, session_id, branch; commits have sha, repo_path,
ts_ns. Times are nanoseconds. Which side is broadcast is left to Spark, which knows the sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000_000
SLACK = 5 * SECOND
MINUTE = 60 * SECOND
DAY = 86_400 * SECOND


def bucket_of(ns: Column, width: int) -> Column:
    """Which stretch of ``width`` nanoseconds a time lies in. Whole numbers throughout: times are beyond exact doubles."""
    return ((ns - F.pmod(ns, F.lit(width))) / width).cast("long")


def hydrate(edits: DataFrame, lines: DataFrame, removed: DataFrame) -> DataFrame:
    """Edits with their lines in order and their removed hashes; empty arrays where there are none."""
    a = lines.groupBy(F.col("edit_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("line_no", "content_sha", "content_sha_norm"))).alias("lines"))
    b = removed.groupBy(F.col("edit_id").alias("id")).agg(F.sort_array(F.collect_list("content_sha")).alias("removed"))
    return edits.join(a, "id", "left").join(b, "id", "left").withColumns({"lines": F.coalesce("lines", F.array()), "removed": F.coalesce("removed", F.array())})


def previous_commit(commits: DataFrame) -> DataFrame:
    """prev_ns: the latest earlier commit time of the repository, 0 if none."""
    before = Window.partitionBy("repo_path").orderBy("ts_ns").rangeBetween(Window.unboundedPreceding, -1)
    return commits.withColumn("prev_ns", F.coalesce(F.max("ts_ns").over(before), F.lit(0)).cast("long"))


def in_window(edits: DataFrame, windows: DataFrame, on: list[str], lower: str = "prev_ns", upper: str = "ts_ns", slack: int = SLACK, bucket: int | None = None) -> DataFrame:
    """Edits inside (lower, upper + slack] of each window with equal ``on``. Windows overlap by the slack, so an edit may
    fall into two.

    windows: on, sha and the two bounds. A window spans time buckets and is laid out over them, so the join has a key
    that spreads even when one repository holds most rows. Buckets are twice as long as the windows are on average, within the
    edits' time, unless ``bucket`` tells their nanoseconds: so there are at most two and a half pieces a window in all, however
    long single ones are, and an edit meets the few pieces of its bucket.
    """
    w = windows.select(*on, "sha", F.col(lower).alias("_lo"), (F.col(upper) + slack).alias("_hi"))
    inside = (F.col("ts_ns") > F.col("_lo")) & (F.col("ts_ns") <= F.col("_hi"))
    # windows without a commit before them are open to the past: they begin with the first edit
    span = edits.agg(F.min("ts_ns").alias("_least"), F.max("ts_ns").alias("_most"))
    w = w.crossJoin(F.broadcast(span)).withColumns({"_from": F.greatest("_lo", F.col("_least") - 1), "_to": F.least("_hi", "_most")}).where("_from < _to").drop("_least", "_most")
    width = span.select(F.lit(bucket).cast("long").alias("_width")) if bucket else w.agg(F.greatest(F.ceil(2 * F.avg(F.col("_to") - F.col("_from"))), F.lit(1)).cast("long").alias("_width"))
    piece = lambda ns: F.call_function("div", ns, F.col("_width"))
    w = w.crossJoin(F.broadcast(width)).withColumn("_bucket", F.explode(F.sequence(piece(F.col("_from")), piece(F.col("_to"))))).drop("_from", "_to", "_width")
    e = edits.crossJoin(F.broadcast(width)).withColumn("_bucket", piece(F.col("ts_ns"))).drop("_width")
    return e.join(w, [*on, "_bucket"]).where(inside).drop("_bucket", "_lo", "_hi")


def last_touch(commit_files: DataFrame) -> DataFrame:
    """prev_touch_ns: when an earlier commit of the branch last touched the file, 0 if none. commit_files: sha, repo_path, branch, file_path, ts_ns."""
    before = Window.partitionBy("repo_path", "branch", "file_path").orderBy("ts_ns").rangeBetween(Window.unboundedPreceding, -1)
    return commit_files.withColumn("prev_touch_ns", F.coalesce(F.max("ts_ns").over(before), F.lit(0)).cast("long"))


def widened(windows: DataFrame) -> DataFrame:
    """prev_ns moved back to the file's last touch, where that is earlier."""
    return windows.withColumn("prev_ns", F.least("prev_ns", "prev_touch_ns"))


def nearest_model(edits: DataFrame, markers: DataFrame, width: int = 30 * MINUTE) -> DataFrame:
    """near_model: of the markers of the tool within the band, in the same repository or in none, the latest one's model.

    markers: tool, repo_path (may be blank), marker_ts, marker_model (blank ones don't count). Ties go to the smaller name.
    An edit looks at the last marker up to the end of its band, once for its repository and once for none; no pairs arise.
    """
    size = 8 * width
    some = markers.where(F.coalesce(F.col("marker_model"), F.lit("")) != "").select("tool", F.coalesce("repo_path", F.lit("")).alias("_repo"), F.col("marker_ts").alias("_at"), "marker_model")
    own = bucket_of(F.col("_at"), size)
    seen = some.withColumn("_bucket", F.explode(F.array_distinct(F.array(own, bucket_of(F.col("_at") + 2 * width, size)))))
    repos = F.explode(F.array_distinct(F.array(F.coalesce("repo_path", F.lit("")), F.lit(""))))
    asks = edits.select("id", "tool", repos.alias("_repo"), (F.col("ts_ns") + width).alias("_at")).withColumn("_bucket", own)
    rows = seen.unionByName(asks, allowMissingColumns=True)
    before = Window.partitionBy("tool", "_repo", "_bucket").orderBy("_at", F.col("id").isNotNull(), F.desc("marker_model")).rowsBetween(Window.unboundedPreceding, 0)
    marker = F.when(F.col("id").isNull(), F.struct((-F.col("_at")).alias("back"), "marker_model"))
    got = rows.withColumn("_m", F.last(marker, True).over(before)).where(F.col("id").isNotNull() & (F.col("_at") + F.col("_m.back") <= 2 * width))
    return edits.join(got.groupBy("id").agg(F.min("_m")["marker_model"].alias("near_model")), "id", "left")


def latest_within(rows: DataFrame, seen: DataFrame, width: int) -> DataFrame:
    """Rows with the greatest value that each column of ``seen`` has in their tool up to the end of their band.

    rows: tool, ts_ns. seen: tool, ts_ns and columns that grow with it. One running maximum by tool and time bucket, so the work doesn't grow
    with the number of rows in a band. What comes back may lie before the band; callers check that.
    """
    size = 8 * width
    names = [c for c in seen.columns if c not in ("tool", "ts_ns")]
    at, own = F.col("_at"), bucket_of(F.col("_at"), size)
    told = seen.select("tool", F.col("ts_ns").alias("_at"), *names).withColumn("_bucket", F.explode(F.array_distinct(F.array(own, bucket_of(at + 2 * width, size)))))
    asks = rows.withColumns({"_at": F.col("ts_ns") + width, "_ask": F.lit(True)}).withColumn("_bucket", own)
    so_far = Window.partitionBy("tool", "_bucket").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    both = asks.unionByName(told, allowMissingColumns=True)
    return both.withColumns({c: F.max(c).over(so_far) for c in names}).where("_ask").drop("_at", "_ask", "_bucket")


def nearest_gen_type(edits: DataFrame, width: int = MINUTE) -> DataFrame:
    """near_gen: ``chat`` if any edit of the tool within the band is one, else the latest known type in it; only for
    two tools, and a completion of high confidence stays what it is."""
    ours = F.coalesce(F.col("tool").isin("copilot", "cursor"), F.lit(False))
    known = edits.where(ours & ~F.col("gen_type").isin("unknown", "")).select("tool", "ts_ns", F.when(F.col("gen_type") == "chat", F.col("ts_ns")).alias("_chat"), F.struct("ts_ns", "gen_type").alias("_known"))
    low = F.col("ts_ns") - width
    any_chat = F.coalesce(F.col("_chat") >= low, F.lit(False))
    latest = F.when(F.col("_known.ts_ns") >= low, F.col("_known.gen_type"))
    sure = (F.col("gen_type") == "completion") & (F.col("confidence") == "high")
    found = F.when(sure, F.col("gen_type")).when(any_chat, "chat").otherwise(F.coalesce(latest, F.col("gen_type")))
    got = latest_within(edits.where(ours), known, width).withColumn("near_gen", found).drop("_chat", "_known")
    return got.unionByName(edits.where(~ours).withColumn("near_gen", F.col("gen_type")))


def upgraded_completions(edits: DataFrame, width: int = MINUTE) -> DataFrame:
    """Completions within a minute of a chat marker of their tool become chats, unless of high confidence, without file
    or from the tab log. A marker is a chat without a file. edits: also is_tab (boolean)."""
    marker = (F.col("gen_type") == "chat") & (F.col("file_path") == "") & F.col("tool").isin("copilot", "cursor")
    open_ = (F.col("gen_type") == "completion") & (F.col("confidence") != "high") & (F.col("file_path") != "") & ~F.col("is_tab")
    asks = F.coalesce(open_ & F.col("tool").isin("copilot", "cursor"), F.lit(False))
    got = latest_within(edits.where(asks), edits.where(marker).select("tool", "ts_ns", F.col("ts_ns").alias("_mark")), width)
    got = got.withColumn("gen_type", F.when(F.col("_mark") >= F.col("ts_ns") - width, "chat").otherwise(F.col("gen_type"))).drop("_mark")
    return got.unionByName(edits.where(~asks))


def scoped(edits: DataFrame, scope: DataFrame, on: list[str], key: str) -> DataFrame:
    """Edits with equal ``on`` whose ``key`` is the scope's, or blank: an equi join and one without the key, united."""
    s = scope.select(*on, F.col(key).alias(f"scope_{key}"))
    blank = F.coalesce(F.col(key), F.lit("")) == ""
    same = edits.where(~blank).join(s.withColumn(key, F.col(f"scope_{key}")), [*on, key])
    return same.unionByName(edits.where(blank).join(s, on).select(*same.columns))


def every_edit(edits: DataFrame, files: DataFrame) -> DataFrame:
    """Edits of the files of replayed commits, whenever they were. files: sha, repo_path, file_path, replay_kind.

    Both sides may have many rows of one file, and its result is their product: the edits of each file are dealt to parts by id, every
    part meets all replays, and what a part holds of these can spill.
    """
    parts = 4 * edits.sparkSession.sparkContext.defaultParallelism
    known, on = F.col("repo_path").isNotNull() & F.col("file_path").isNotNull(), F.struct("repo_path", "file_path", "_part")  # one key: constants in it don't undo the partitioning
    replays = files.where(known & F.col("replay_kind").isNotNull()).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("sha", on.alias("_on"))
    dealt = edits.where(known).withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("_on", on)
    both = dealt.repartition(parts, "_on").join(replays.repartition(parts, "_on").hint("merge"), "_on")
    return both.select("repo_path", "file_path", *[c for c in edits.columns if c not in ("repo_path", "file_path")], "sha")


def inherited(mine: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Human lines take the author an earlier note gave the line, if both notes have the same added lines in the file.

    mine, old: keys, line_no, author_type, tool, model, gen_type. keys name the commit pair and the file.
    """
    who = F.when(F.col("author_type") == "AI", F.struct("author_type", "tool", "model", "gen_type"))
    rows = mine.withColumn("_mine", F.lit(True)).unionByName(old.select(*keys, "line_no", F.lit(False).alias("_mine"), who.alias("_o")), allowMissingColumns=True)
    line = Window.partitionBy(*keys).orderBy("line_no").rangeBetween(0, 0)
    both = F.max("_mine").over(line) & ~F.min("_mine").over(line)
    rows = rows.withColumns({"_o": F.max("_o").over(line), "_both": both})
    got = rows.withColumn("_all", F.min("_both").over(Window.partitionBy(*keys))).where("_mine").withColumn("_o", F.when(F.col("_all"), F.col("_o"))).drop("_mine", "_both", "_all")
    take = (F.col("author_type") != "AI") & F.col("_o").isNotNull()
    return got.withColumns({c: F.when(take, F.col(f"_o.{c}")).otherwise(F.col(c)) for c in ("author_type", "tool", "model", "gen_type")}).drop("_o")


def from_working_log(lines: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of files that a log tracks take its author by position, Human where it has none; other files stay as they are."""
    tracked = log.select(*keys).distinct().withColumn("_tracked", F.lit(True))
    by_line = log.select(*keys, "line_no", F.struct("author_type", "tool", "model", "gen_type").alias("_l"))
    got = lines.join(tracked, keys, "left").join(by_line, [*keys, "line_no"], "left")
    human = {"author_type": "Human", "tool": "", "model": None, "gen_type": "human"}
    return got.withColumns({c: F.when(F.col("_tracked"), F.when(F.col("_l").isNull(), F.lit(v)).otherwise(F.col(f"_l.{c}"))).otherwise(F.col(c)) for c, v in human.items()}).drop("_tracked", "_l")


def content_digest(content: Column) -> Column:
    """SHA-256 of a text as bytes, every character counted."""
    return F.unhex(F.sha2(content, 256))


def deletions_from_log(deleted: DataFrame, log: DataFrame, tracked: DataFrame) -> DataFrame:
    """Deleted lines take the author that the deletion log has for the content under the old path, else under the new
    one; without either, files that are tracked are a person's and others stay open (null).

    deleted: sha, path_old, path, line_no, content. log: sha, file, content, author_type, tool. tracked: sha, file. Contents meet by their
    digests, so no text is moved; either side may have them as ``digest`` already (see content_digest()).
    """
    deleted, log = (df if "digest" in df.columns else df.withColumn("digest", content_digest(F.col("content"))) for df in (deleted, log))
    side = lambda path, name: log.select("sha", F.col("file").alias(path), "digest", F.struct("author_type", "tool").alias(name))
    still = F.col("path_old").eqNullSafe(F.col("path"))
    none = F.lit(None).cast("struct<author_type: string, tool: string>")
    # files that kept their path are looked up once
    got = deleted.where(still).join(side("path", "_a"), ["sha", "path", "digest"], "left").withColumn("_b", none)
    moved = deleted.where(~still).join(side("path_old", "_a"), ["sha", "path_old", "digest"], "left").join(side("path", "_b"), ["sha", "path", "digest"], "left")
    files = tracked.select("sha", F.col("file").alias("path")).distinct().withColumn("_t", F.lit(True))
    hit = F.coalesce("_a", "_b")
    got = got.unionByName(moved).join(files, ["sha", "path"], "left")
    more = [c for c in deleted.columns if c not in ("sha", "path", "path_old", "line_no", "content", "digest")]
    return got.select(
        "sha", "path", "line_no", "content", *more,
        F.when(hit.isNotNull(), hit["author_type"]).when(F.col("_t"), "Human").alias("author_type"),
        F.when(hit.isNotNull(), hit["tool"]).when(F.col("_t"), "").alias("tool"),
    )


def both_parents(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Of a merge only the lines that are added against both parents."""
    return first.join(second.select(*keys).distinct(), keys, "left_semi")


def blame_authors(blame: DataFrame, ranges: DataFrame) -> DataFrame:
    """The author of each blamed line from the note of the commit that last touched it; Human without one.

    blame: path, final_line, sha, origin_line. ranges: sha, path, start_line, end_line, author_type, tool. Ranges are
    laid out by line, so this is an equi join.
    """
    by_line = ranges.where((F.col("author_type") == "AI") & (F.coalesce(F.col("tool"), F.lit("")) != "") & (F.col("end_line") >= F.col("start_line")))
    by_line = by_line.select("sha", "path", F.explode(F.sequence("start_line", "end_line")).alias("origin_line"), "author_type", "tool").dropDuplicates(["sha", "path", "origin_line"])
    got = blame.join(by_line, ["sha", "path", "origin_line"], "left")
    return got.withColumns({"author_type": F.coalesce("author_type", F.lit("Human")), "tool": F.coalesce("tool", F.lit(""))})


def confirmed_sessions(rows: DataFrame) -> DataFrame:
    """Chat sessions of a repository: rows without repository count where the same session also has a row with one.

    rows: repo_path, session_path. Gives repo_path, session_path, rows.
    """
    known = rows.where(F.col("repo_path") != "").select("repo_path", "session_path").distinct()
    blank = rows.where(F.col("repo_path") == "").drop("repo_path").join(known, "session_path")
    return rows.where(F.col("repo_path") != "").unionByName(blank.select(*rows.columns)).groupBy("repo_path", "session_path").agg(F.count("*").alias("n_rows"))


def backfilled(lines: DataFrame, operations: DataFrame) -> DataFrame:
    """Human lines of files that a tool's log says it wrote or deleted become the tool's, as chat; the first tool claims.

    lines: sha, path, kind (file change), side, author_type, tool, gen_type, line_no. operations: sha, path, op
    (write or delete), tool, order.
    """
    first = Window.partitionBy("sha", "path", "op").orderBy("order", "tool")
    ops = operations.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("sha", "path", "op", F.col("tool").alias("_tool"))
    wanted = F.when(F.col("kind") == "DELETED", "delete").when(F.col("kind").isin("ADDED", "MODIFIED"), "write")
    got = lines.withColumn("op", wanted).join(ops, ["sha", "path", "op"], "left")
    take = F.col("_tool").isNotNull() & (F.col("author_type") != "AI")
    return got.select(
        "sha", "path", "kind", "side", "line_no", F.when(take, "AI").otherwise(F.col("author_type")).alias("author_type"),
        F.when(take, F.col("_tool")).otherwise(F.col("tool")).alias("tool"), F.when(take, "chat").otherwise(F.col("gen_type")).alias("gen_type"),
    )


def first_line(edits: DataFrame, lines: DataFrame) -> DataFrame:
    """Edits with their first recorded line, null without one. lines: edit_id, ord, line_no."""
    first = lines.groupBy(F.col("edit_id").alias("id")).agg(F.min_by("line_no", "ord").alias("first_line"))
    return edits.join(first, "id", "left")


def by_old_path(files: DataFrame, deleted: DataFrame) -> DataFrame:
    """Deletions of a file by its new path, else by the path before its rename. files: sha, path, path_old. deleted: sha, file, n_deleted."""
    side = lambda path, name: deleted.select("sha", F.col("file").alias(path), F.col("n_deleted").alias(name))
    got = files.join(side("path", "_a"), ["sha", "path"], "left").join(side("path_old", "_b"), ["sha", "path_old"], "left")
    return got.select("sha", "path", "path_old", F.coalesce("_a", "_b", F.lit(0)).alias("n_deleted"))


def work_session_id(repo: Column, branch: Column, base: Column) -> Column:
    """A stable id of (repository, branch, base commit)."""
    return F.sha2(F.concat_ws("\x1f", repo, F.coalesce(branch, F.lit("")), F.coalesce(base, F.lit(""))), 256)


def new_sessions(edits: DataFrame, known: DataFrame) -> DataFrame:
    """Work sessions that edits open and that aren't known yet. edits: repo_path, branch, base_sha. known: session_key."""
    rows = edits.select("repo_path", "branch", "base_sha").distinct().withColumn("session_key", work_session_id(F.col("repo_path"), F.col("branch"), F.col("base_sha")))
    return rows.join(known.select("session_key"), "session_key", "left_anti")


def base_of(edits: DataFrame, commits: DataFrame) -> DataFrame:
    """Edits with base_sha: the latest commit of the repository and branch at or before them, blank before the first.

    An as-of join without a join: both tables in one, the commit carried forward.
    """
    c = commits.select("repo_path", "branch", "ts_ns", F.col("sha").alias("_sha"), F.lit(0).alias("_side"))
    e = edits.withColumns({"_sha": F.lit(None).cast("string"), "_side": F.lit(1)})
    order = Window.partitionBy("repo_path", "branch").orderBy("ts_ns", "_side", "_sha").rowsBetween(Window.unboundedPreceding, 0)
    both = e.unionByName(c, allowMissingColumns=True).withColumn("base_sha", F.coalesce(F.last("_sha", True).over(order), F.lit("")))
    return both.where("_side = 1").drop("_sha", "_side")


def disagreements(note: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Lines to which a note and the live view give different authors (one may lack the line)."""
    a = note.select(*keys, F.struct("author_type", "tool").alias("note"))
    b = live.select(*keys, F.struct("author_type", "tool").alias("live"))
    return a.join(b, keys, "full").where(~F.col("note").eqNullSafe(F.col("live"))).select(*keys, F.col("note.author_type").alias("note_author"), F.col("live.author_type").alias("live_author"))


def deletions_to_hashes(commands: DataFrame, head: DataFrame, targets: str = "targets") -> DataFrame:
    """Removed hashes of files that commands delete, with the content they had; files without content give none.

    commands: command_id, repo_path, cwd, targets. head: repo_path, file_path, content.
    """
    from lineweave.functions.text import clean_log_path, is_blank, line_sha, line_sha_norm
    from lineweave.operators.diff import explode_lines

    rows = commands.select("command_id", "repo_path", F.explode(targets).alias("t"), "cwd")
    path = clean_log_path(F.when(F.coalesce(F.col("cwd"), F.lit("")) == "", F.col("t")).otherwise(F.concat_ws("/", "cwd", "t")))
    hit = rows.select("command_id", "repo_path", path.alias("file_path")).distinct().join(head, ["repo_path", "file_path"])
    lines = explode_lines(hit, "content", "command_id", "repo_path", "file_path").where(~is_blank(F.col("content")))
    return lines.select("command_id", "repo_path", "file_path", "pos", line_sha(F.col("content")).alias("content_sha"), line_sha_norm(F.col("content")).alias("content_sha_norm"))


def glob_to_regex(glob: Column) -> Column:
    """A shell glob as a regular expression: ``*`` and ``?`` don't cross slashes."""
    quoted = F.regexp_replace(glob, r"([.+^$(){}|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", "[^/]*"), r"\?", "[^/]"), F.lit("$"))


def file_operations(files: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """Files that operation targets name: exactly, by base name, or by a glob over either. files: on, path. targets: on, target."""
    base = lambda c: F.element_at(F.split(F.translate(c, "\\", "/"), "/"), -1)
    f = files.withColumn("_base", base(F.col("path")))
    t = targets.withColumn("_glob", F.col("target").rlike(r"[*?\[]"))
    plain = f.join(t.where(~F.col("_glob")).withColumn("_base", base(F.col("target"))), [*on, "_base"])
    names = f.select(*on, "path", F.explode(F.array_distinct(F.array("path", "_base"))).alias("_name"))
    glob = _globbed(names, t.where("_glob").select(*on, "target"), on, "target")
    return plain.select(*on, "path", "target").unionByName(glob.select(*on, "path", "target")).distinct()


def _globbed(names: DataFrame, globs: DataFrame, on: list[str], glob: str) -> DataFrame:
    """Rows with a _name and each glob that it meets. Globs that end in a plain extension meet names of that extension by
    an equi join; of the others each is tried on every name with equal ``on``."""
    ending = lambda c: F.regexp_extract(c, r"(\.[^.*?\[\]/\\]+)$", 1)
    g = globs.withColumn("_end", ending(F.col(glob)))
    meets = F.rlike(F.col("_name"), glob_to_regex(F.col(glob)))
    named = names.withColumn("_end", ending(F.col("_name"))).join(g.where("_end <> ''"), [*on, "_end"]).where(meets).drop("_end")
    rest = g.where("_end = ''").drop("_end")
    free = names.join(rest, on) if on else names.crossJoin(F.broadcast(_few(rest)))
    return named.unionByName(free.where(meets).select(*named.columns))


#: Rules that have no key to join by are tried on every file; more of them than this are refused.
MOST_FREE_RULES = 10_000


def _few(rules: DataFrame) -> DataFrame:
    if len(rules.limit(MOST_FREE_RULES + 1).collect()) > MOST_FREE_RULES:
        raise ValueError(f"over {MOST_FREE_RULES} globs without an extension")
    return rules


def excluded(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files that an exclude rule hits, once each. files: path. rules: kind (component, glob, anchored, anywhere), pattern.

    Rules meet the path's parts, prefixes or extension by equi joins; only globs without an extension are tried on each file.
    """
    p = F.regexp_replace(F.translate("path", "\\", "/"), r"^\./", "")
    rows = files.select("path").distinct().withColumn("_p", p).withColumn("_parts", F.split("_p", "/"))
    of = lambda kind: rules.where(F.col("kind") == kind).select("pattern").distinct()
    parts = rows.select("path", F.explode("_parts").alias("pattern")).join(of("component"), "pattern", "left_semi").select("path")
    heads = F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda n: F.array_join(F.slice("_parts", 1, n), "/"))
    anchored = rows.select("path", F.explode(heads).alias("pattern")).join(of("anchored"), "pattern", "left_semi").select("path")
    glob = _globbed(rows.select("path", F.element_at("_parts", -1).alias("_name")), of("glob"), [], "pattern").select("path")
    first = of("anywhere").withColumn("_part", F.element_at(F.split("pattern", "/"), 1))
    tried = rows.select("path", "_p", F.explode(F.array_distinct("_parts")).alias("_part")).join(first, "_part")
    anywhere = tried.where(F.concat(F.lit("/"), "_p", F.lit("/")).contains(F.concat(F.lit("/"), "pattern", F.lit("/")))).select("path")
    return parts.union(anchored).union(glob).union(anywhere).distinct()


def write_window(commands: DataFrame, files: DataFrame, floor: int = 15 * SECOND, most: int = 10 * MINUTE, limit: int = 30) -> DataFrame:
    """Files that changed while a command ran: mtime at most its run time, 15 s at least and 10 min at most, before its
    end. Commands with none or more than ``limit`` such files get none.

    commands: command_id, repo_path, start_ns, end_ns. files: repo_path, file_path, mtime_ns.
    """
    width = F.least(F.greatest(F.col("end_ns") - F.col("start_ns"), F.lit(0)) + floor, F.lit(most))
    spans = commands.select("command_id", "repo_path", (F.col("end_ns") - width).alias("lo"), F.col("end_ns").alias("hi"))
    n = counted_within(spans, files.select("repo_path", F.col("mtime_ns").alias("at")), ["repo_path"], "command_id", most)
    few = commands.join(n.where(F.col("n").between(1, limit)).select("command_id"), "command_id", "left_semi")
    c = few.withColumn("_bucket", F.explode(F.sequence(bucket_of(F.col("end_ns") - width, most), bucket_of(F.col("end_ns"), most))))
    got = c.join(files.withColumn("_bucket", bucket_of(F.col("mtime_ns"), most)), ["repo_path", "_bucket"]).where((F.col("mtime_ns") <= F.col("end_ns")) & (F.col("mtime_ns") >= F.col("end_ns") - width))
    return got.select("command_id", "repo_path", "file_path", "mtime_ns")


def counted_within(spans: DataFrame, points: DataFrame, keys: list[str], by: str, width: int) -> DataFrame:
    """by, n: how many points of equal ``keys`` the spans of each ``by`` hold, both ends included; no pair becomes a row.

    spans: keys, by, lo, hi, at most ``width`` apart. points: keys, at. A span's count is that of the points up to its end less
    that of those before its begin, from a running count of its stretch of ``width`` and the next one.
    """
    slot = bucket_of(F.col("at"), width)
    ends = F.array(F.struct(F.col("lo").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("hi").alias("at"), F.lit(2).alias("kind")))
    rows = spans.select(*keys, by, bucket_of(F.col("lo"), width).alias("_slot"), F.explode(ends).alias("_e")).select(*keys, by, "_slot", "_e.*")
    rows = rows.unionByName(points.select(*keys, "at", F.explode(F.array(slot, slot - 1)).alias("_slot"), F.lit(1).alias("kind")), allowMissingColumns=True)
    so_far = Window.partitionBy(*keys, "_slot").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.sum((F.col("kind") == 1).cast("long")).over(so_far)).where("kind <> 1")
    parts = rows.groupBy(*keys, "_slot", by).agg(F.sum(F.when(F.col("kind") == 2, F.col("_n")).otherwise(-F.col("_n"))).alias("n"))
    return parts.groupBy(by).agg(F.sum("n").alias("n"))


def baseline_candidates(changed: DataFrame, written: DataFrame, tracked: DataFrame, keys: list[str], limit: int = 60) -> DataFrame:
    """Changed files that the command didn't write and no log tracks; none for a command with more than ``limit`` of them."""
    rest = changed.join(written.select(*keys, "file_path").distinct(), [*keys, "file_path"], "left_anti")
    n = F.count("*").over(Window.partitionBy(*keys))
    return rest.withColumn("_n", n).where(F.col("_n") <= limit).drop("_n").join(tracked.select("file_path").distinct(), "file_path", "left_anti")
