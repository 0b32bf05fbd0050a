"""The findings of round 4: odd texts against the SQL, sizes that no switch may change."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lineweave.functions.text import is_blank
from lineweave.operators import align, joins, match
from lineweave.plans import catalogue
from lineweave.plans.registry import Tables
from tests.conftest import SF

TEXTS = ["", "\n", "\n\n", "a\n", "a\n\n", "\na", "a\r\nb\r\n", "\r", " \n", "a person's line\n", "x\n\na person's line", None, "same\nsame\n", "a\n \nb"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder whose documents are odd texts, each under three ids; the other tables are the smallest ones."""
    at = tmp_path_factory.mktemp("odd")
    for name in os.listdir(SF):
        if name != "documents.parquet":
            os.symlink(f"{SF}/{name}", at / name)
    kinds = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(k, text, "en", "web", len(text or "")) for k, text in enumerate(x for x in TEXTS for _ in range(3))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").to(kinds).coalesce(1).write.parquet(f"{at}/documents.parquet")
    return str(at)


def same_as_sql(spark, folder, name, only=lambda row: True):
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"create view {t.split('.')[0]} as select * from '{folder}/{t}{'/*.parquet' if os.path.isdir(f'{folder}/{t}') else ''}'")
    found = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted(str(r) for r in found.fetchall() if only(r))
    assert want and sorted(str(tuple(r)) for r in catalogue.queries()[name](spark, folder).select(*names).collect() if only(r)) == want


@pytest.mark.parametrize("name", ["t05_working_log_state", "t13_live_view", "x03_seed_hook"])
def test_odd_texts(spark, odd, name):
    """Empty texts have no line, and an ended last line begins no other."""
    same_as_sql(spark, odd, name)


def test_an_empty_last_line_is_narrowed_like_others(spark, odd):
    """Carriage returns at line ends are left out of this, as the operator drops them from what it gives and the SQL doesn't."""
    same_as_sql(spark, odd, "e11_narrow_to_changed", lambda row: "\r" not in (TEXTS[row[0] // 3] or ""))


def test_raw_lines_of_a_large_file_keep_their_order(spark):
    """3,200 lines on both sides are over 9,000,000 cells; one that moved is told as in a small file."""
    old = [f"line {k}" for k in range(3200)]
    new = old[1:] + old[:1]
    pairs = spark.createDataFrame([(1, "\n".join(old), "\n".join(new), 10)], "k int, old_text string, new_text string, start_line int")
    assert [tuple(r) for r in align.added_or_moved(pairs, ["k"]).collect()] == [(1, 3200, "line 0", True)]
    assert [tuple(r) for r in align.narrowed(pairs, ["k"]).collect()] == [(1, 3209, "line 0")]


def test_windows_of_one_file_meet_the_edits_of_their_time_only(spark):
    """Widened windows of one file spread over buckets of time: no task meets all edits with all windows, and long ones lose nothing."""
    s = joins.SECOND
    edits = spark.range(4000).select("id", (F.col("id") * 10 * s).alias("ts_ns"), F.lit("r").alias("repo_path"), F.lit("f").alias("file_path"))
    windows = spark.range(1, 401).select(F.concat(F.lit("c"), "id").alias("sha"), ((F.col("id") - 1) * 100 * s).alias("prev_ns"), (F.col("id") * 100 * s).alias("ts_ns"), F.lit("r").alias("repo_path"), F.lit("f").alias("file_path"))
    windows = windows.unionByName(windows.where("sha = 'c400'").withColumns({"sha": F.lit("long"), "prev_ns": F.lit(0).cast("long")}))
    got = joins.in_window(edits, windows, ["repo_path", "file_path"], bucket=None)
    assert got.where("sha = 'long'").count() == 3999 and got.where("sha <> 'long'").groupBy("sha").count().where("count = 10").count() == 399
    pairs = re.findall(r"Join Inner, .*", got._jdf.queryExecution().optimizedPlan().toString())
    assert any("_bucket" in p for p in pairs)  # time is part of the join's key


def test_units_that_no_line_can_take_are_left_out(spark, monkeypatch):
    """Of an edit's lines only those that the file may hold are moved on, whether edits know their lines by id or by text; a large file gets all."""
    edits = spark.createDataFrame([(1, "f", 5, "d1"), (2, "f", 6, "d1"), (3, "g", 7, "d1")], "id long, file string, ts_ns long, doc string").withColumn("confidence", F.lit("high"))
    hashed = lambda df: df.withColumns({"content_sha": F.sha2("content", 256), "content_sha_norm": F.sha2("content", 256)})
    texts = hashed(spark.createDataFrame([("d1", f"x{k}") for k in range(50)], "doc string, content string"))
    lines = hashed(spark.createDataFrame([("f", 1, "x7"), ("f", 2, "x9"), ("f", 3, "y")], "file string, line_no int, content string"))
    by_id = edits.select(F.col("id").alias("edit_id"), "doc").join(texts, "doc").drop("doc")
    want = [("f", 1, 2), ("f", 2, 2)]
    for edit_lines in (texts, by_id):
        units = match.units_of(edits, edit_lines, ["file"], lines=lines)
        assert sorted(units.columns) == sorted(match.units_of(edits, by_id, ["file"]).columns)
        assert 4 <= units.count() < 20 and units.where("file = 'g'").count() == 0
        assert sorted(tuple(r) for r in match.consume_once(lines, units, ["file"]).collect()) == want
    monkeypatch.setattr(match, "MOST_MARKS", 2)
    units = match.units_of(edits, texts, ["file"], lines=lines)
    assert units.count() == 100 and sorted(tuple(r) for r in match.consume_once(lines, units, ["file"]).collect()) == want


def test_no_text_is_shuffled_for_hashes(spark):
    """Deletions meet their log by digests, added lines of merges are parted by hashes: no exchange has a column of text lines."""
    for name in ("commit_attribution_of_deleted_lines", "commit_attribution", "j13_matcher_precedence"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        taken = [x for x in plan.split("\n") if "hashpartitioning" in x and re.search(r"\bcontent#", x)]
        assert not taken, taken


def test_blank_lines_are_told_as_by_their_text(spark, odd):
    t = Tables(spark, odd)
    ours = t.added_hashes_v.groupBy("blank").count().collect()
    theirs = t.added_v.groupBy(is_blank(F.col("content")).alias("blank")).count().collect()
    assert {tuple(r) for r in ours} == {tuple(r) for r in theirs} and len(ours) == 2
