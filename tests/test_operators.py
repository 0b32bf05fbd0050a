"""Operators on small tables: blanks, nulls, empty inputs, named cases."""

from pyspark.sql import functions as F

from lineweave.functions import text
from lineweave.operators import diff, joins, tables, windows
from lineweave.plans import commit


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_unicode_space_and_carriage_returns(spark):
    df = spark.createDataFrame([("  a  b ",), ("  \t",), ("x\r\r",), (None,)], "x string")
    got = df.select(text.collapse_space(F.col("x")), text.strip_space(F.col("x")), text.line_sha_norm(F.col("x")) == "").collect()
    assert [tuple(r) for r in got] == [("a b", "ab", False), ("", "", True), ("x", "x", False), (None, None, None)]
    assert df.where("x like 'x%'").select(text.line_sha(F.col("x")) == F.sha2(F.lit("x"), 256)).first()[0]


def test_lines_of_odd_texts(spark):
    df = spark.createDataFrame([(1, ""), (2, "\n"), (3, "a\r\nb"), (4, "a\n\n"), (5, None)], "k int, t string")
    got = {r["k"]: r["x"] for r in df.select("k", text.split_lines(F.col("t")).alias("x")).collect()}
    assert got == {1: [], 2: [""], 3: ["a", "b"], 4: ["a", ""], 5: None}
    n = {r["k"]: r["n"] for r in df.select("k", text.count_lines(F.col("t")).alias("n")).collect()}
    assert n == {1: 0, 2: 1, 3: 2, 4: 2, 5: None}


def test_diff_with_renames_and_no_newline(spark):
    d = "diff --git a/old name.py b/new name.py\nsimilarity index 90%\nrename from old name.py\nrename to new name.py\n--- a/old name.py\t\n+++ b/new name.py\t\n@@ -2 +2,2 @@\n-a\n+b\n+c\n\\ No newline at end of file\ndiff --git a/x.bin b/x.bin\ndeleted file mode 100644"
    df = spark.createDataFrame([("s", d)], "sha string, diff string")
    assert rows(diff.file_changes(df, "diff", "sha")) == [("s", "old name.py", "new name.py", "RENAMED"), ("s", "x.bin", "x.bin", "DELETED")]
    got = diff.hunk_lines(df, "diff", "sha").select("path_new", "sign", "content", "line_no")
    assert rows(got) == [("new name.py", "+", "b", 2), ("new name.py", "+", "c", 3), ("new name.py", "-", "a", 2)]
    assert rows(diff.changed_lines(diff.hunk_lines(df, "diff", "sha"), "sha").select("side", "line_no", "content")) == [("add", 2, "b"), ("add", 3, "c"), ("del", 2, "a")]


def test_empty_tables(spark):
    lines = spark.createDataFrame([], "k int, pos int, content string")
    assert rows(diff.added_lines(lines, lines, ["k"])) == []
    assert rows(diff.edit_totals(lines, lines, ["k"])) == []
    assert rows(windows.collapse_ranges(lines.withColumnRenamed("pos", "line_no"), ["k"], ["content"])) == []


def test_ranges_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "m"), (1, 5, "m"), (1, 6, "m")], "k int, line_no int, model string")
    assert rows(windows.collapse_ranges(df, ["k"], ["model"]).select("model", "start_line", "end_line")) == [("m", 3, 3), ("m", 5, 6), (None, 1, 2)]


def test_blank_lines_follow_an_ai_in_their_run(spark):
    df = spark.createDataFrame([(1, 1, "a", "AI"), (1, 2, "", "Human"), (1, 4, " ", "Human"), (1, 5, "b", "AI"), (1, 7, "", "Human"), (1, 8, "c", "Human")], "k int, line_no int, content string, author_type string")
    df = df.withColumns({"tool": F.lit("t"), "model": F.lit(""), "gen_type": F.lit("")})
    got = [r[0] for r in windows.inherit_blank(df, ["k"]).orderBy("line_no").select("author_type").collect()]
    assert got == ["AI", "AI", "AI", "AI", "Human", "Human"]


def test_windows_overlap_by_the_slack(spark):
    s = joins.SECOND
    edits = spark.createDataFrame([(1, 0), (2, 100 * s), (3, 103 * s), (4, 106 * s)], "id int, ts_ns long").withColumn("repo_path", F.lit("r"))
    commits = spark.createDataFrame([("a", 100 * s), ("b", 200 * s)], "sha string, ts_ns long").withColumn("repo_path", F.lit("r"))
    got = joins.in_window(edits, joins.previous_commit(commits), ["repo_path"]).select("sha", "id")
    assert rows(got) == [("a", 2), ("a", 3), ("b", 3), ("b", 4)]


def test_paste_stays_human_and_copies_are_not_credited_twice(spark):
    s = joins.SECOND
    key = lambda x: F.sha2(x, 256)
    added = spark.createDataFrame([("c", "r", "f", k + 1, x) for k, x in enumerate(["p", "a", "a", ""])], "sha string, repo_path string, file_path string, line_no int, content string")
    added = added.withColumns({"content_sha": key("content"), "content_sha_norm": F.when(F.col("content") == "", "").otherwise(key("content"))})
    edits = spark.createDataFrame([(1, "r", "f", "claude", 5 * s), (2, "r", "f", "copypaste", 6 * s)], "id int, repo_path string, file_path string, tool string, ts_ns long")
    edits = edits.withColumns({"confidence": F.lit("high"), "raw_meta": F.lit(None).cast("string"), "model": F.lit("m"), "gen_type": F.lit("chat")})
    lines = spark.createDataFrame([(1, "a"), (2, "p")], "edit_id int, content string").withColumns({"content_sha": key("content"), "content_sha_norm": key("content")})
    commits = spark.createDataFrame([("c", "r", "b", 10 * s)], "sha string, repo_path string, branch string, ts_ns long")
    got = [(r["author_type"], r["tool"]) for r in commit.attribute(added, commits, edits, lines).orderBy("line_no").collect()]
    assert got == [("Human", "copypaste"), ("AI", "claude"), ("Human", ""), ("Human", "")]


def test_upsert_and_copy_again(spark):
    known = spark.createDataFrame([("k", 1, "old")], "k string, ts long, v string")
    new = spark.createDataFrame([("k", 1, "new"), ("j", 0, "x")], "k string, ts long, v string")
    assert rows(tables.upsert(known, new, ["k"], "ts")) == [("j", 0, "x"), ("k", 1, "new")]


def test_sticky_model_by_time_bucket(spark, tmp_path):
    import random

    from lineweave.operators.joins import MINUTE
    from lineweave.streaming import streams

    draw = random.Random(5)
    rows = [(i, draw.choice(["a", "a", "b", None]), draw.randrange(-200, 600) * MINUTE + i, draw.choice(["m1", "m2", "", "", "", "", None, None])) for i in range(400)]
    kind = "id long, tool string, ts_ns long, model string"

    def plain(edits, older=()):
        out, last = {}, {}
        for i, tool, ts, model in sorted([*edits, *older], key=lambda r: (r[2], r[0])):
            if model:
                last[tool] = (model, ts)
            seen = last.get(tool)
            out[i] = seen[0] if seen and ts - seen[1] <= 30 * MINUTE else None
        return {r[0]: out[r[0]] for r in edits}

    df = spark.createDataFrame(rows, kind)
    carried = streams.models_carried(df)
    assert {r["id"]: r["model"] for r in carried.collect()} == plain(rows)
    plan = carried._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan and "Arrow" not in plan

    # a second batch has the last model of the first, but no edit has one of a later time
    first, then = [r for r in rows if r[2] < 300 * MINUTE], [r for r in rows if r[2] >= 300 * MINUTE] + [(1000, "a", 1, ""), (1001, "b", 2, None)]
    late = (1002, "a", max(r[2] for r in first if r[1] == "a" and r[3]) - 1, "")
    at = f"{tmp_path}/edits"
    spark.createDataFrame(first, kind).coalesce(1).write.parquet(at)
    spark.createDataFrame([*then, late], kind).coalesce(1).write.mode("append").parquet(at)
    got = {r["id"]: r["model"] for r in streams.sticky_model(spark, streams.source(spark, at, 1), f"{tmp_path}/sticky").collect()}
    kept = [max((r for r in first if r[1] == tool and r[3]), key=lambda r: (r[2], r[0])) for tool in ("a", "b", None)]
    assert got == {**plain(first), **plain([*then, late], kept)}


def test_streams_take_up_where_they_ended(spark, tmp_path):
    from lineweave.streaming import streams

    src, at, kind = f"{tmp_path}/in", f"{tmp_path}/kept", "k string, ts int, v string"
    land = lambda *r: spark.createDataFrame(list(r), kind).coalesce(1).write.mode("append").parquet(src)
    run = lambda: rows(streams.kept(spark, streams.source(spark, src, 1), at, streams.keep_latest(["k"], "ts")))
    land(("a", 1, "x"), ("b", 1, "y"))
    assert run() == [("a", 1, "x"), ("b", 1, "y")]
    assert run() == [("a", 1, "x"), ("b", 1, "y")]
    land(("a", 2, "z"), ("c", 1, "w"))
    assert run() == [("a", 2, "z"), ("b", 1, "y"), ("c", 1, "w")]
    # a version that was not written to the end, of a batch that runs again, is not read
    spark.createDataFrame([("q", 9, "torn")], kind).write.parquet(f"{at}/v2")
    (tmp_path / "kept" / "v2" / "_SUCCESS").unlink()
    land(("b", 3, "n"))
    assert streams.versions(spark, at) == [0, 1]
    assert run() == [("a", 2, "z"), ("b", 3, "n"), ("c", 1, "w")]
    assert streams.versions(spark, at) == [1, 2]


def test_late_events_are_stored_and_leave_the_state(spark, tmp_path):
    from lineweave.streaming import streams

    src, at = f"{tmp_path}/in", f"{tmp_path}/late"

    def land(*r):
        df = spark.createDataFrame(list(r), "user_id string, id int, t int, a int")
        df.selectExpr("user_id", "id", "timestamp_seconds(t) as ts", "timestamp_seconds(a) as arrived").coalesce(1).write.mode("append").parquet(src)

    def run():
        stored, state = streams.with_late(spark, streams.source(spark, src, 1), at, ["user_id"])
        return rows(stored.select("id", "live")), rows(state.select("user_id", "id"))

    land(("u", 1, 1000, 1010), ("v", 2, 1000, 1120), ("w", 3, 1000, 1121), (None, 4, 1, None))
    assert run() == ([(1, True), (2, True), (3, False), (4, True)], [("u", 1), ("v", 2), (None, 4)])
    land(("u", 5, 5000, 9000), ("v", 6, 999, 1000))
    assert run() == ([(1, True), (2, True), (3, False), (4, True), (5, False), (6, True)], [("u", 1), ("v", 2), (None, 4)])


def test_snapshots_are_taken_once_over_restarts(spark, tmp_path):
    from lineweave.streaming import streams

    src, at, kind = f"{tmp_path}/in", f"{tmp_path}/snap", "repo_path string, file_path string, id int, ts_ns int, kind string, content string"
    land = lambda *r: spark.createDataFrame([("r", *x) for x in r], kind).coalesce(1).write.mode("append").parquet(src)
    run = lambda: rows(streams.with_snapshots(spark, streams.source(spark, src, 1), at).select("id", "origin", "baseline"))
    land(("f", 1, 1, "edit", "e1"), ("f", 2, 2, "put", "p2"), ("f", 3, 3, "put", "p3"), ("f", 4, 4, "edit", "e4"), ("f", 5, 5, "edit", "e5"), ("g", 6, 6, "put", "p6"), ("h", 7, 7, "put", None), ("h", 8, 7, "edit", "e8"))
    first = [(1, "head", None), (4, "put", "p3"), (5, "edit", "e4"), (8, "put", None)]
    assert run() == first
    land(("f", 9, 9, "edit", "e9"), ("g", 10, 10, "edit", "e10"), ("g", 11, 11, "edit", "e11"))
    assert run() == sorted([*first, (9, "edit", "e5"), (10, "put", "p6"), (11, "edit", "e10")], key=str)


def test_file_events_in_order_over_restarts(spark, tmp_path):
    """Random histories in two batches against a table that every event changes in turn."""
    import random

    from lineweave.operators import lifecycle

    draw = random.Random(11)
    paths, kinds = ["a", "b", "c", "d"], ["delete", "create", "Restore", "rename", "move", "copy", "copy", "chmod"]
    event = "id long, kind string, repo_path string, path string, old_path string, new_path string, src_path string, dst_path string, at_ns long"
    edit = "id long, repo_path string, file_path string, ts_ns long, deleted_at long, note string"
    some = lambda: draw.choice([*paths, *paths, "", None])
    batches = []
    for b in range(2):
        edits = [(b * 1000 + i, draw.choice(["r", "s", None]), draw.choice([*paths, None]), draw.randrange(b * 100, b * 100 + 100), draw.choice([None, None, 7]), f"n{i}") for i in range(40)]
        events = [(b * 1000 + i, draw.choice(kinds), draw.choice(["r", "s", "", None]), some(), some(), some(), some(), some(), draw.randrange(b * 100, b * 100 + 100)) for i in range(60)]
        batches.append((edits, [*events, events[0]]))

    table = []
    for edits, events in batches:
        todo = [(r[3], 0, r) for r in edits] + [(r[8], 1, r) for r in set(events)]
        for at, is_event, r in sorted(todo, key=lambda x: (x[0], x[1], x[2][0])):
            if not is_event:
                table.append(list(r))
                continue
            kind, repo, path, old, new, src, dst = (r[1].lower(), *r[2:8])
            of = lambda p: [x for x in table if repo and p and x[1] == repo and x[2] == p]
            if kind == "delete":
                for x in of(path):
                    x[4] = at if x[4] is None else x[4]
            elif kind in ("create", "restore"):
                for x in of(path):
                    x[4] = None
            elif kind in ("rename", "move") and old and new and old != new:
                for x in of(old):
                    x[2], x[4] = new, None
            elif kind == "copy" and src and dst and src != dst:
                clones = [[-1, x[1], dst, *x[3:]] for x in of(src) if x[4] is None]
                if clones:
                    table[:] = [x for x in table if not (x[1] == repo and x[2] == dst)] + clones

    got = None
    for n, (edits, events) in enumerate(batches):
        lifecycle.applied(got, spark.createDataFrame(edits, edit), spark.createDataFrame(events, event)).write.parquet(f"{tmp_path}/v{n}")
        got = spark.read.parquet(f"{tmp_path}/v{n}")
    assert any(r["id"] < 0 for r in got.collect())
    assert rows(got.withColumn("id", F.greatest("id", F.lit(-1)))) == sorted(map(tuple, table), key=str)
    none = lifecycle.applied(None, spark.createDataFrame([], edit), spark.createDataFrame([], event))
    assert rows(none) == []


def test_file_events_of_a_repository_come_in_batches(spark):
    """A repository's events are never together in one frame: each frame of either walk is as long as Spark's batches."""
    from lineweave.operators import lifecycle

    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, frames, longest = spark.conf.get(size), spark.sparkContext.accumulator(0), 50

    def told(walk):
        def run(batches):
            def seen():
                for b in batches:
                    frames.add(int(len(b) > longest))
                    yield b

            yield from walk(seen())

        return run

    events = spark.range(3000).selectExpr("id", "case id % 3 when 0 then 'delete' when 1 then 'create' else 'copy' end kind", "if(id % 7 = 0, 's', 'r') repo_path", "concat('f', id % 5) path", "'' old_path", "'' new_path", "concat('f', id % 5) src_path", "concat('g', id) dst_path", "id * 10 at_ns")
    edits = spark.range(300).selectExpr("id", "if(id % 2 = 0, 's', 'r') repo_path", "concat('f', id % 5) file_path", "id * 95 ts_ns", "cast(null as long) deleted_at")
    want = rows(lifecycle.applied(None, edits, events))
    own = lifecycle.copying, lifecycle.routes
    try:
        spark.conf.set(size, str(longest))
        lifecycle.copying, lifecycle.routes = map(told, own)
        assert rows(lifecycle.applied(None, edits, events)) == want and len(want) > 300
    finally:
        spark.conf.set(size, before)
        lifecycle.copying, lifecycle.routes = own
    assert frames.value == 0


def test_fold_of_sides_that_lie_by_key_already(spark):
    """Adaptive execution merges the partitions of each side of the union in its own way; a file's rows stay together."""
    from lineweave.operators import align

    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k, None) for k in settings}
    who = F.array(F.struct(F.lit("AI").alias("author_type"), *[F.lit("t").alias(x) for x in ("tool", "model", "gen_type", "session")]))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        ids = spark.range(400).select((F.col("id") * 7 % 400).alias("id"))
        files = ids.withColumn("text", F.expr("array_join(transform(sequence(1, 20), i -> sha2(concat(id, '-', i), 512)), '')")).groupBy("id").agg(F.max("text").alias("content"))
        edits = files.select(F.col("id").alias("k"), F.lit(1).alias("ts"), F.lit(1).alias("id"), "content", F.col("content").alias("baseline"), F.lit("Human").alias("author_type"), *[F.lit("").alias(x) for x in ("tool", "model", "gen_type", "session")])
        seed = ids.groupBy(F.col("id").alias("k")).agg(F.max(who).alias("authors"))
        assert {r[0]: r[1] for r in align.fold(edits, ["k"], seed).groupBy("author_type").count().collect()} == {"AI": 400}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hashes_as_bytes_keep_apart(spark):
    given = ["", "a", "=" * 33, "0" * 64, "A" * 64, "a" * 64, "x" * 32, "z" * 64, None]
    df = spark.createDataFrame([(x,) for x in given], "x string").withColumn("d", text.digest(F.col("x")))
    got = df.select("x", "d", text.undigest(F.col("d")).alias("y")).collect()
    assert all(r["x"] == r["y"] for r in got) and len({r["d"] if r["d"] is None else bytes(r["d"]) for r in got}) == len(given)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_matching_shuffles_once(spark):
    from lineweave.operators import match

    lines = spark.createDataFrame([("c", 1, "a", "n"), ("c", 2, "b", "n"), ("c", 3, "", "n"), ("c", 4, "a", "")], "sha string, line_no int, content_sha string, content_sha_norm string")
    units = spark.createDataFrame([("c", 7, 1, "b", "n"), ("c", 8, 2, "", "n")], "sha string, edit_id int, rank int, content_sha string, content_sha_norm string")
    separate = match.consume_once(lines, units, ["sha"], "separate")
    assert rows(separate.select("line_no", "edit_id")) == [(1, 7), (2, 7), (3, 8)]
    assert exchanges(separate) == 1
    assert exchanges(match.exact(lines, units, ["sha", "content_sha"])) == 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_type_keeps_a_running_maximum(spark):
    m = joins.MINUTE
    made = [(1, "cursor", 0, "cli", "low"), (2, "cursor", m, "unknown", "low"), (3, "cursor", 2 * m, "completion", "high"), (4, "cursor", 9 * m, "chat", "low"), (5, "cursor", 10 * m, "cli", "low"), (6, "cursor", 11 * m + 1, "unknown", "low"), (7, "codex", 9 * m, "cli", "low"), (8, "cursor", 30 * m, "unknown", "low")]
    got = joins.nearest_gen_type(spark.createDataFrame(made, "id int, tool string, ts_ns long, gen_type string, confidence string"))
    assert rows(got.select("id", "near_gen")) == [(1, "cli"), (2, "completion"), (3, "completion"), (4, "chat"), (5, "chat"), (6, "unknown"), (7, "cli"), (8, "unknown")]
    assert "RangeFrame, -" not in plan(got) and "RangeFrame, unboundedpreceding" in plan(got)


def test_files_and_texts_come_one_by_one(spark):
    from lineweave.operators import align

    made = [("a", n, x, w) for n, (x, w) in enumerate([("p", "Human"), ("q", "AI"), ("r", "AI"), ("p", "AI"), ("q", "AI"), ("r", "AI")])] + [("b", 1, "p", "Human")]
    judged = windows.blocks_of_copies(spark.createDataFrame(made, "k string, line_no int, content string, author_type string"), ["k"])
    assert rows(judged.select("k", "line_no", "author_type")) == [("a", n, "AI") for n in range(3)] + [("a", n, "Human") for n in range(3, 6)] + [("b", 1, "Human")]
    pairs = spark.createDataFrame([(1, "a\nb", "b\nc"), (2, None, "x"), (3, "x", "")], "k int, old_text string, new_text string")
    told = align.aligned(pairs, ["k"])
    assert rows(told) == [(1, 0, 1, False), (1, 1, None, False), (2, 0, None, False)]
    assert "Pandas" not in plan(judged) and "Pandas" not in plan(told)


def test_hashes_of_an_edit_move_once_and_short(spark):
    from lineweave.operators import aggregate

    lines = spark.createDataFrame([(1, 1, "a" * 64, "n"), (1, 2, "a" * 64, ""), (1, 3, None, "n")], "edit_id int, ord int, content_sha string, content_sha_norm string")
    counts = aggregate.hash_counts(lines)
    assert rows(counts) == [(1, "exact", "a" * 64, 2), (1, "norm", "n", 2)]
    assert plan(counts).index("Generate") < plan(counts).index("Exchange")
    left, _ = diff.net_unchanged(lines, lines.where("ord = 1"))
    assert rows(left.select("ord", "content_sha")) == [(2, "a" * 64), (3, None)]
    assert "unhex" in plan(left)


def test_write_windows_are_counted_before_they_are_joined(spark):
    """Spans over slot borders and ties at both ends; a command with too many files makes no rows at all."""
    second = 1_000_000_000
    points = [("r" if k % 3 else "s", 7 * k * second) for k in range(400)]
    spans = [(k, "r" if k % 2 else "s", (11 * k - k % 13 * 7) * second, 11 * k * second) for k in range(250)] + [(1, "s", 0, 91 * second)]
    got = joins.counted_within(spark.createDataFrame(spans, "c long, repo string, lo long, hi long"), spark.createDataFrame(points, "repo string, at long"), ["repo"], "c", 100 * second)
    want = {}
    for c, repo, lo, hi in spans:
        want[c] = want.get(c, 0) + sum(r == repo and lo <= at <= hi for r, at in points)
    assert {r["c"]: r["n"] for r in got.collect()} == want and max(want.values()) > 3
    commands = spark.createDataFrame([(1, "r", 0, 0), (2, "r", 0, 1000 * second)], "command_id long, repo_path string, start_ns long, end_ns long")
    files = spark.createDataFrame([("r", f"f{k}", -k % 15 * second) for k in range(31)] + [("r", "g", 1000 * second)], "repo_path string, file_path string, mtime_ns long")
    late = files.where("mtime_ns <= 0").unionByName(files.selectExpr("repo_path", "file_path", "-mtime_ns as mtime_ns"))
    assert [(r["command_id"], r["file_path"]) for r in joins.write_window(commands, late.where("mtime_ns <= 0 or file_path = 'g'")).collect()] == []
    assert [(r["command_id"], r["file_path"]) for r in joins.write_window(commands, files.where("mtime_ns > 500000000000")).collect()] == [(2, "g")]


def test_every_edit_of_one_file_is_spread(spark):
    """A file with nearly all edits and replays: no partition makes more than a third of the result, which is the plain join's."""
    edits = spark.range(0, 2000, 1, 1).select("id", F.lit("r").alias("repo_path"), F.when(F.col("id") % 50 != 0, "f").alias("file_path"))
    files = spark.range(0, 90, 1, 1).select(F.concat(F.lit("c"), "id").alias("sha"), F.lit("r").alias("repo_path"), F.lit("f").alias("file_path"), F.when(F.col("id") % 3 == 0, "squash_merge").alias("replay_kind"))
    got = joins.every_edit(edits, files)
    assert got.columns == ["repo_path", "file_path", "id", "sha"]
    rows = sorted((r["sha"], r["id"]) for r in got.collect())
    assert rows == sorted((f"c{c}", i) for c in range(0, 90, 3) for i in range(2000) if i % 50)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= sum(sizes) / 3
