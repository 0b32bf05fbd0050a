"""Upkeep of tables as functions of DataFrames: merge, soft deletion, moves, copies, retention, orders and sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The row of each key that comes last in the order."""
    back = [F.desc(c) if isinstance(c, str) else c.desc() for c in order]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*back))).where("_n = 1").drop("_n")


def note_commits(known: DataFrame, noted: DataFrame) -> DataFrame:
    """Commits with note_written set for the noted ones; new ones are added, times of known ones stay."""
    both = known.withColumn("_new", F.lit(0)).unionByName(noted.withColumns({"note_written": F.lit(1), "_new": F.lit(1)}))
    first = F.struct("_new", "ts_ns")
    return both.groupBy("sha").agg(F.min_by("repo_path", first).alias("repo_path"), F.min_by("ts_ns", first).alias("ts_ns"), F.max("note_written").alias("note_written"))


def upsert(known: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last write of each key; of equal times a new row wins over a known one."""
    both = known.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    return keep_latest(both, keys, order, "_side").drop("_side")


def soft_deleted(edits: DataFrame, deletions: DataFrame) -> DataFrame:
    """deleted_at set on live edits of deleted files. deletions: repo_path, file_path, at_ns."""
    first = deletions.groupBy("repo_path", "file_path").agg(F.min("at_ns").alias("_at"))
    return edits.join(first, ["repo_path", "file_path"], "left").withColumn("deleted_at", F.coalesce("deleted_at", "_at")).drop("_at")


def restored(edits: DataFrame, files: DataFrame) -> DataFrame:
    """deleted_at cleared on the edits of files that are back."""
    back = files.select("repo_path", "file_path").distinct().withColumn("_back", F.lit(True))
    return edits.join(back, ["repo_path", "file_path"], "left").withColumn("deleted_at", F.when(F.col("_back").isNull(), F.col("deleted_at"))).drop("_back")


def moved(edits: DataFrame, moves: DataFrame) -> DataFrame:
    """Edits under their files' new paths, live again. moves: repo_path, old_path, new_path; a move onto itself is none."""
    some = moves.where("old_path <> new_path").select("repo_path", F.col("old_path").alias("file_path"), F.col("new_path").alias("_to"))
    got = edits.join(some, ["repo_path", "file_path"], "left")
    hit = F.col("_to").isNotNull()
    return got.withColumns({"file_path": F.coalesce("_to", "file_path"), "deleted_at": F.when(~hit, F.col("deleted_at"))}).drop("_to")


def copied(edits: DataFrame, copies: DataFrame) -> DataFrame:
    """Live edits of a file also under the copy's path, whose own edits go; doing it again changes nothing.

    copies: repo_path, src_path, dst_path. A clone's id is the negative of a hash of its source and place, so it is the
    same in each run and apart from recorded ids.
    """
    some = copies.where("src_path <> dst_path").distinct()
    kept = edits.join(some.select("repo_path", F.col("dst_path").alias("file_path")).distinct(), ["repo_path", "file_path"], "left_anti")
    live = edits.where(F.col("deleted_at").isNull())
    clones = live.join(some.withColumnRenamed("src_path", "file_path"), ["repo_path", "file_path"])
    clones = clones.withColumns({"id": -F.abs(F.xxhash64("id", "dst_path")), "file_path": F.col("dst_path")})
    return kept.unionByName(clones.select(*kept.columns))


def dispatched(events: DataFrame) -> DataFrame:
    """File events with ``action`` (delete, restore, move, copy) or, where a field is missing, ``reject_reason``."""
    has = lambda *names: F.greatest(*[F.coalesce(F.col(n), F.lit("")) == "" for n in (*names, names[0])]) == F.lit(False)
    kind = F.lower("kind")
    action = (
        F.when(kind.isin("delete", "deleted") & has("path"), "delete")
        .when(kind.isin("create", "restore") & has("path"), "restore")
        .when(kind.isin("rename", "move") & has("old_path", "new_path"), "move")
        .when((kind == "copy") & has("src_path", "dst_path"), "copy")
    )
    known = kind.isin("delete", "deleted", "create", "restore", "rename", "move", "copy")
    reason = F.when(F.coalesce(F.col("repo_path"), F.lit("")) == "", "repo_path required").when(~known, "unknown kind").when(action.isNull(), "path required")
    return events.withColumn("reject_reason", reason).withColumn("action", F.when(F.col("reject_reason").isNull(), action))


def slashed(rows: DataFrame, path: str = "file_path") -> DataFrame:
    """Backslashes in paths become slashes."""
    return rows.withColumn(path, F.translate(path, "\\", "/"))


def carried_forward(logs: DataFrame, steps: DataFrame, committed: DataFrame) -> DataFrame:
    """Working logs of files that a commit didn't take move to the new base, unless it has one; committed ones stay.

    logs: repo_path, branch, base_sha, file, and what else. steps: repo_path, branch, old_base, new_base. committed:
    repo_path, branch, old_base, file.
    """
    key = ["repo_path", "branch", "base_sha", "file"]
    here = logs.join(steps.withColumnRenamed("old_base", "base_sha"), ["repo_path", "branch", "base_sha"], "left")
    here = here.join(committed.withColumnRenamed("old_base", "base_sha").withColumn("_c", F.lit(True)), key, "left")
    goes = F.col("new_base").isNotNull() & F.col("_c").isNull()
    moved_ = here.where(goes).withColumn("base_sha", F.col("new_base")).join(logs.select(*key), key, "left_anti")
    dropped = here.where(~goes)
    return dropped.select(*logs.columns).unionByName(moved_.select(*logs.columns))


def retained(logs: DataFrame, ancestry: DataFrame, depth: int = 200) -> DataFrame:
    """Logs whose base is no commit id, or is one that exists and isn't an ancestor more than ``depth`` behind.

    ancestry: repo_path, base_sha, behind (null if no ancestor of HEAD).
    """
    from lineweave.functions.text import is_object_id

    got = logs.join(ancestry.withColumn("_known", F.lit(True)), ["repo_path", "base_sha"], "left")
    keep = ~is_object_id(F.col("base_sha")) | (F.col("_known").isNotNull() & (F.coalesce(F.col("behind"), F.lit(0)) <= depth))
    return got.where(keep).drop("_known", "behind")


def rewrites(pairs: DataFrame, notes: DataFrame) -> DataFrame:
    """What becomes of notes when commits are rewritten: new, n_old, action (keep for one source with a note, else rebuild)."""
    groups = pairs.groupBy("new").agg(F.sort_array(F.collect_list("old")).alias("olds"))
    one = groups.select("new", "olds", F.element_at("olds", 1).alias("sha"), F.size("olds").alias("n_old")).join(notes.select("sha").distinct().withColumn("_noted", F.lit(True)), "sha", "left")
    return one.select("new", "n_old", F.when((F.col("n_old") == 1) & F.col("_noted"), "keep").otherwise("rebuild").alias("action"))


def newest(commits: DataFrame, repos: DataFrame, since_ns: int) -> DataFrame:
    """Noted commits of these repositories since a time, newest first."""
    rows = commits.where((F.col("note_written") == 1) & (F.col("ts_ns") >= since_ns)).join(repos.select("repo_path"), "repo_path", "left_semi")
    return rows.orderBy(F.desc("ts_ns"), "sha")


def recent(rows: DataFrame, order: str, limit: int, *ties: str, default: int = 20) -> DataFrame:
    """The newest rows; a limit of 0 or less means the default."""
    return rows.orderBy(F.desc(order), *ties).limit(limit if limit > 0 else default)


def after(rows: DataFrame, last_id: int, id_: str = "id") -> DataFrame:
    """Rows with a larger id, in order of it: an incremental read."""
    return rows.where(F.col(id_) > last_id).orderBy(id_)


def union_all(*parts: DataFrame) -> DataFrame:
    """All readers' rows in one table; columns that a reader lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def equal_sets(a: DataFrame, b: DataFrame, keys: list[str], value: str, multiset: bool = False) -> DataFrame:
    """keys, equal: whether both sides hold the same values for a key (as often, for multisets)."""
    fold = (lambda c: F.sort_array(F.collect_list(c))) if multiset else (lambda c: F.sort_array(F.collect_set(c)))
    got = a.groupBy(*keys).agg(fold(value).alias("_a")).join(b.groupBy(*keys).agg(fold(value).alias("_b")), keys, "full")
    return got.select(*keys, F.col("_a").eqNullSafe(F.col("_b")).alias("equal"))
