"""Line logs in ranges and as a tail; table and aggregate functions in SQL; markers that come late."""

import random

import pytest

from lineweave.functions import aggregates
from lineweave.sources import edits, tail
from lineweave.streaming import readers, streams


@pytest.mark.parametrize("seed", range(6))
def test_ranges_of_a_file_give_each_line_once(tmp_path, monkeypatch, seed):
    """Lines of every length against ranges of every size, blocks shorter than lines, a last line without an end."""
    rnd = random.Random(seed)
    lines = [bytes(rnd.choices(b"abc\xc3\xa9", k=rnd.choice((0, 1, 5, 40, 400)))) for _ in range(60)]
    data = b"\n".join(lines) + (b"\n" if seed % 2 else b"")
    file = tmp_path / "log"
    file.write_bytes(data)
    fs, _ = tail.opened(str(file))
    want, pos = [], 0
    for x in lines:
        want.append((pos, x))
        pos += len(x) + 1
    if want and not want[-1][1] and not seed % 2:
        want.pop()
    for block in (7, 64, 1 << 20):
        monkeypatch.setattr(tail, "BATCH_BYTES", block)
        for split in (1, 3, 50, 1000, 1 << 20):
            got = [x for r in tail.ranges(str(file), 0, len(data), split) for x in tail.lines_in(fs, *r.value, len(data))]
            assert got == want, (block, split)
    monkeypatch.setattr(tail, "BLOCK", 5)
    for size in range(0, len(data), 17):
        assert tail.whole_lines(fs, str(file), size) == data[:size].rfind(b"\n") + 1


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "logs" / "deep").mkdir(parents=True)
    (tmp_path / "logs" / "_SUCCESS").write_text("no\n")
    (tmp_path / "logs" / "deep" / "a.log").write_text("".join(f"line {k}\n" for k in range(2000)) + "\nlast")
    got = tail.read_lines(spark, str(tmp_path / "logs"), 1000)
    assert got.rdd.getNumPartitions() > 10
    assert [r["line"] for r in got.orderBy("file", "pos").collect()] == [f"line {k}" for k in range(2000)] + ["last"]
    assert [r["line"] for r in tail.lines_by_spark(spark, str(tmp_path / "logs" / "deep")).orderBy("file", "pos").collect()] == [f"line {k}" for k in range(2000)] + ["last"]
    (tmp_path / "none").mkdir()
    assert tail.read_lines(spark, str(tmp_path / "none")).count() == 0


def test_tail_waits_for_line_ends_and_starts_anew_after_truncation(spark, tmp_path):
    """An unfinished line comes whole and once, a run resumes where the one before ended, a file that became shorter is read again."""
    at, log, other = str(tmp_path), tmp_path / "in" / "a.log", tmp_path / "in" / "b.log"
    log.parent.mkdir()

    def run():
        stream = tail.tailed(spark, f"{at}/in", 16)
        streams.land(stream, f"{at}/rows", f"{at}/checkpoint")
        return sorted(r["line"] for r in spark.read.schema(stream.schema).parquet(f"{at}/rows").collect())

    log.write_text("one\ntwo\nthr")
    assert run() == ["one", "two"]
    log.write_text("one\ntwo\nthree\n")
    other.write_text("x" * 100 + "\n")
    assert run() == ["one", "three", "two", "x" * 100]
    assert run() == ["one", "three", "two", "x" * 100]
    log.write_text("new\n")
    assert run() == ["new", "one", "three", "two", "x" * 100]


def test_added_lines_of_several_files(spark):
    diff = "\n".join([
        "diff --git a/old name.py b/new name.py", "rename from old name.py", "rename to new name.py", "--- a/old name.py", "+++ b/new name.py\t", "@@ -1,3 +1,4 @@ def f", " same", "-gone", "--- a/not a header", "++++ b/not a header", "+added", "+more",
        "diff --git a/b.py b/b.py", "--- a/b.py", "+++ b/b.py", "@@ -5 +7 @@", "-x", "+y", "\\ No newline at end of file", "@@ -20,0 +22,2 @@", "+p", "+q",
        "diff --git a/c.py b/c.py", "rename from c.py", "rename to d.py", "diff --git a/gone b/gone", "--- a/gone", "+++ /dev/null", "@@ -1 +0,0 @@", "-z",
    ])
    readers.register(spark)
    spark.createDataFrame([(1, diff), (2, None), (3, ""), (4, "no diff")], "key long, diff string").createOrReplaceTempView("some_diffs")
    got = sorted(map(tuple, spark.sql("select * from added_lines(table(some_diffs))").collect()))
    assert got == sorted([(1, "new name.py", 2, "+++ b/not a header"), (1, "new name.py", 3, "added"), (1, "new name.py", 4, "more"), (1, "b.py", 7, "y"), (1, "b.py", 22, "p"), (1, "b.py", 23, "q")])


def runs(lines):
    out = []
    for x in sorted(set(lines)):
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return [tuple(x) for x in out]


def test_aggregates_in_sql_and_in_parts(spark):
    aggregates.register(spark)
    rnd = random.Random(3)
    rows = [(g, rnd.randrange(60) if rnd.random() < 0.95 else None) for g in range(6) for _ in range(rnd.choice((0, 1, 20, 90)))] + [(9, None)]
    spark.createDataFrame(rows, "g int, line_no int").createOrReplaceTempView("some_lines")
    whole = {r["g"]: [tuple(x) for x in r["r"]] for r in spark.sql("select g, collapse_ranges(line_no) as r from some_lines group by g").collect()}
    assert whole == {g: runs([x for k, x in rows if k == g and x is not None]) for g in {g for g, _ in rows}}
    parts = spark.sql("select g, merge_ranges(r) as r from (select g, line_no div 7 as p, collapse_ranges(line_no) as r from some_lines group by g, line_no div 7) group by g")
    assert {r["g"]: [tuple(x) for x in r["r"]] for r in parts.collect()} == whole
    spark.createDataFrame([("f", 2, 2, "b\na", "Human", ""), ("f", 1, 1, "a\nb", "AI", "t"), ("e", 1, 1, None, "AI", "t")], "f string, ts long, id long, content string, author_type string, tool string").createOrReplaceTempView("some_edits")
    got = {r["f"]: [tuple(x) for x in r["l"]] for r in spark.sql("select f, replay(ts, id, content, author_type, tool) as l from some_edits group by f").collect()}
    assert got == {"e": [], "f": [(1, "AI", "t", None), (2, "AI", "t", None)]}


def test_a_stored_completion_becomes_a_chat_by_a_late_marker(spark, tmp_path):
    """Two runs: after the first the edit's window is closed for none, the second brings its marker and closes the other's."""
    at, schema = str(tmp_path), "id long, tool string, s long"

    def run(rows):
        spark.createDataFrame(rows, schema).selectExpr("id", "tool", "timestamp_seconds(s) as ts").coalesce(1).write.mode("append").parquet(f"{at}/in")
        edits = streams.source(spark, f"{at}/in")
        markers = streams.source(spark, f"{at}/in").where("id < 0 or id >= 100").selectExpr("id as marker_id", "tool as marker_tool", "ts as marker_ts")
        return {r["id"]: (r["n_markers"], r["gen_type"]) for r in streams.upgraded(spark, streams.marked(edits.where("id < 100"), markers, late="10 minutes"), at).collect()}

    assert run([(1, "a", 1000), (2, "a", 5000), (100, "a", 1030), (-1, "", 1100)]) == {1: (1, "chat")}
    assert run([(101, "a", 1031), (102, "b", 5001), (-1, "", 900_000)]) == {1: (2, "chat"), 2: (0, "completion")}


def test_a_merged_table_writes_the_buckets_of_its_batch(spark, tmp_path):
    """Bytes written follow the batch; a batch that runs again gives the same table; an emptied bucket goes."""
    at = str(tmp_path)
    schema = "k long, ts long, v string"
    latest = streams.keep_latest(["k"], "ts")
    merge = lambda old, new: latest(old, new).where("v is not null")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        got = streams.kept_by_key(spark, streams.source(spark, f"{at}/in", 1), f"{at}/t", ["k"], merge, buckets=16)
        return sorted((r["k"], r["v"]) for r in got.collect())

    first = [(k, 1, "a" * 50) for k in range(400)]
    assert run(first) == [(k, "a" * 50) for k in range(400)]
    assert run([(7, 2, "b"), (7, 0, "late")]) == sorted([(k, "a" * 50) for k in range(400) if k != 7] + [(7, "b")])
    files = lambda v: [x for x in (tmp_path / "t" / "data" / f"v{v}").iterdir() if x.name.startswith("bucket=")]
    assert len(files(0)) == 16 and len(files(1)) == 1
    manifest = streams.newest(spark, f"{at}/t")
    assert sorted(manifest.values()) == [0] * 15 + [1] and streams.newest(spark, f"{at}/t", 1) == dict.fromkeys(range(16), 0)
    # a batch that wrote its data and failed before its manifest runs again from the one before
    import shutil

    shutil.rmtree(tmp_path / "t" / "manifest" / "v1")
    (tmp_path / "t" / "checkpoint" / "commits" / "1").unlink()
    (tmp_path / "t" / "checkpoint" / "commits" / ".1.crc").unlink(missing_ok=True)
    assert run([(8, 2, "c")]) == sorted([(k, "a" * 50) for k in range(400) if k not in (7, 8)] + [(7, "b"), (8, "c")])
    assert run([(k, 3, None) for k in range(400)]) == []
    assert run([(1, 4, "again")]) == [(1, "again")]


def test_markers_are_counted_without_pairs(spark, tmp_path):
    """Ties at both ends, slot borders, rows that are both; a second run's markers upgrade stored completions."""
    at, schema = str(tmp_path), "id long, tool string, s long"
    rows = [(k, "ab"[k % 2] if k % 7 else None, 60 * (k * k % 97)) for k in range(200)]

    def run(part):
        spark.createDataFrame(part, schema).selectExpr("id", "tool", "timestamp_seconds(s) as ts").coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = streams.source(spark, f"{at}/in")
        return {r["id"]: (r["n_markers"], r["gen_type"]) for r in streams.correlated(spark, stream, stream.where("id % 3 = 0"), at, 10 * streams.MINUTE).collect()}

    def plain(seen):
        n = {i: sum(m[0] != i and m[0] % 3 == 0 and m[1] == tool and tool is not None and abs(m[2] - s) <= 600 for m in seen) for i, tool, s in seen}
        return {i: (k, "chat" if k else "completion") for i, k in n.items()}

    assert run(rows[:120]) == plain(rows[:120])
    assert run(rows[120:]) == plain(rows) != plain(rows[:120])


def test_ranges_of_many_groups_at_once(spark):
    """As the aggregates say, over groups of any size with repeats, nulls and negative lines, none and no rows."""
    rnd = random.Random(5)
    rows = [(g, rnd.choice([None, rnd.randrange(-20, 60)])) for g in range(60) for _ in range(rnd.randrange(25))] + [(99, None), (98, 2**31 - 1), (97, -(2**31)), (97, 5)]
    aggregates.register(spark)
    spark.createDataFrame(rows, "g int, line_no int").createOrReplaceTempView("grouped_lines")
    want = {r["g"]: [tuple(x) for x in r["r"]] for r in spark.sql("select g, collapse_ranges(line_no) as r from grouped_lines group by g").collect()}
    parts = "select g, line_ranges(collect_list(line_no)) as r from grouped_lines group by g, line_no div 7"
    for sql in ("select g, line_ranges(collect_list(line_no)) as r from grouped_lines group by g", f"select g, union_ranges(flatten(collect_list(r))) as r from ({parts}) group by g"):
        assert {r["g"]: [tuple(x) for x in r["r"]] for r in spark.sql(sql).collect()} == want
    assert spark.sql("select line_ranges(array()) as r").first()["r"] == [] and spark.sql("select line_ranges(cast(null as array<int>)) as r").first()["r"] == []


def test_small_files_are_read_together(spark, tmp_path):
    """Hundreds of small logs are a few tasks, and a large one still many."""
    at = tmp_path / "logs"
    at.mkdir()
    for k in range(300):
        (at / f"f{k}.log").write_text(f"first of {k}\nlast of {k}")
    (at / "large.log").write_text("x" * 99 + "\n" + "y\n" * 40_000)
    got = tail.read_lines(spark, str(at), 1 << 14)
    assert got.rdd.getNumPartitions() > 4
    few = tail.read_lines(spark, str(at), 1 << 24)
    assert few.rdd.getNumPartitions() < 5
    for df in (got, few):
        lines = {(r["file"].rsplit("/", 1)[1], r["pos"], r["line"]) for r in df.collect()}
        assert len(lines) == 600 + 40_001 and ("f7.log", 0, "first of 7") in lines and ("f7.log", 11, "last of 7") in lines


def test_blame_is_carried_over_stretches(spark, monkeypatch):
    """Stretches shorter than an entry, some without a head, give what one stretch gives."""
    rows = []
    for path in ("a", "b", None):
        for k in range(40):
            sha = f"{k % 7 + 1:040d}"
            rows += [(path, f"{sha} {k + 1} {k + 3}")] + ([(path, f"author A{k % 7}"), (path, "author-time 17"), (path, "summary x"), (path, "filename y")] if k < 7 else []) + [(path, f"\tline {k}")]
    df = spark.createDataFrame([(p, n, x) for n, (p, x) in enumerate(rows)], "path string, pos long, line string").repartition(4)
    want = {(p, k + 3, f"{k % 7 + 1:040d}", k + 1, f"A{k % 7}", 17, f"line {k}") for p in ("a", "b", None) for k in range(40)}
    for slot in (1, 4, 1 << 16):
        monkeypatch.setattr(edits, "SLOT", slot)
        assert {tuple(r) for r in edits.blame_lines(df, ["path"]).collect()} == want
