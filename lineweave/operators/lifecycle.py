"""File events in their order over recorded edits: soft deletion, restoring, moves and copies of whole files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.operators import tables
from lineweave.session import dealt

END = "array<struct<to: string, deleted: long, keeps: boolean, copies: string>>"
ROUTE = ["repo_path", "file_path", "_at", "_event", "_live", "_gone"]
ROUTES = f"repo_path string, file_path string, _at long, _event long, _live {END}, _gone {END}"
WALK = "repo_path string, _at long, _event long, action string, src string, dst string, copies boolean"
#: Outcomes of rows that go on together.
ENDS_AT_ONCE = 1 << 14


def file_events(events: DataFrame) -> DataFrame:
    """repo_path, _at, _event, action, src, dst of valid file events (see ``tables.dispatched``; id and at_ns give the
    order). Of rows with the same repository, time and id one counts; a move or copy onto itself is none."""
    got = tables.dispatched(events).where("action is not null")
    src = F.when(F.col("action") == "move", F.col("old_path")).when(F.col("action") == "copy", F.col("src_path")).otherwise(F.col("path"))
    dst = F.when(F.col("action") == "move", F.col("new_path")).when(F.col("action") == "copy", F.col("dst_path"))
    got = got.select("repo_path", F.col("at_ns").alias("_at"), F.col("id").alias("_event"), "action", src.alias("src"), dst.alias("dst"))
    return got.where("not src <=> dst").dropDuplicates(["repo_path", "_at", "_event"])


def copying(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Events with ``copies``: whether the source had live rows then. batches: repositories one after the other, each one's events in
    order, and before an event a step ``live`` or ``gone`` for a path that gets such rows. What is held are paths, not events."""
    repo, live, gone = None, set(), set()
    for steps in batches:
        flags = []
        for s in zip(steps.repo_path, steps.action, steps.src, steps.dst, strict=True):
            if s[0] != repo:
                repo, live, gone = s[0], set(), set()
            action, src, dst = s[1:]
            is_live, is_gone = src in live, src in gone
            flags.append(is_live)
            if action in ("live", "gone"):
                (live if action == "live" else gone).add(src)
            elif action == "delete" and is_live or action == "restore" and is_gone:
                a, b = (live, gone) if action == "delete" else (gone, live)
                a.discard(src)
                b.add(src)
            elif action == "move" and (is_live or is_gone):
                live.discard(src)
                gone.discard(src)
                live.add(dst)
            elif action == "copy" and is_live:
                live.add(dst)
                gone.discard(dst)
        yield steps.assign(copies=flags)[~steps.action.isin(["live", "gone"])][["repo_path", "_at", "_event", "action", "src", "dst", "copies"]]


def routes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What becomes of the rows of a path from an event on. batches: repositories one after the other, each one's events backwards.

    What is held is, for a live and for a deleted row of each path, where all later events leave it: no row, one, or one for each copy.
    """
    repo, live, gone = None, {}, {}
    of_live = lambda path: live.get(path, [(path, None, False, "")])
    of_gone = lambda path: gone.get(path, [(path, None, True, "")])
    named = lambda ends: [dict(zip(("to", "deleted", "keeps", "copies"), x, strict=True)) for x in ends]
    for walk in batches:
        out, ends = [], 0
        for s in zip(walk.repo_path, walk.action, walk.src, walk.dst, walk["_at"].tolist(), walk["_event"].tolist(), walk.copies, strict=True):
            if s[0] != repo:
                repo = s[0]
                live.clear()
                gone.clear()
            action, src, dst, at, event, copies = s[1:]
            if action == "delete":
                live[src] = [(to, at if keeps else deleted, False, by) for to, deleted, keeps, by in of_gone(src)]
            elif action == "restore":
                gone[src] = of_live(src)
            elif action == "move":
                live[src] = gone[src] = of_live(dst)
            elif copies:
                live[src] = of_live(src) + [(to, deleted, keeps, f"{event} {by}") for to, deleted, keeps, by in of_live(dst)]
                live[dst], gone[dst] = [], []
            for path in (src, dst) if action == "copy" else (src,):
                out.append((repo, path, at, event, named(of_live(path)), named(of_gone(path))))
                ends += len(out[-1][4]) + len(out[-1][5])
            if ends >= ENDS_AT_ONCE:
                yield pd.DataFrame(out, columns=ROUTE)
                out, ends = [], 0
        if out:
            yield pd.DataFrame(out, columns=ROUTE)


def applied(old: DataFrame | None, new: DataFrame, events: DataFrame) -> DataFrame:
    """Edits after file events. Those of ``old`` come before all events, those of ``new`` at their ts_ns, before events
    of that time. Both have id, repo_path, file_path, ts_ns, deleted_at and what else; events as in ``file_events``.

    A deletion marks live rows, restoring clears the mark, a move takes all rows along, live again; a copy replaces the
    rows of its target by clones of the live ones of its source, if there are any. Rows and events with a null or empty
    repository or path stay as they are. A clone's id is the negative of a hash of its source's id and the copies.

    Only events and one step for each stretch between two events of a path go through one task, that of the repository: its history
    is sequential. They come from sorts that can spill, forwards and then backwards; rows meet the outcome by a join.
    """
    steps = file_events(events)
    touches = F.when(F.col("action") == "copy", F.array("src", "dst")).otherwise(F.array("src"))
    touched = steps.select("repo_path", F.explode(touches).alias("file_path"), "_at", "_event")
    first = touched.groupBy("repo_path", "file_path").agg(F.min(F.struct("_at", "_event")).alias("_next"))
    # backwards in time: a frame that ends at the last row would be computed anew for each row
    later = Window.partitionBy("repo_path", "file_path").orderBy(F.desc("_when"), F.desc("_is_event"), F.desc("_event")).rowsBetween(Window.unboundedPreceding, -1)
    own = new.withColumns({"_when": F.col("ts_ns"), "_is_event": F.lit(False)})
    both = own.unionByName(touched.withColumns({"_when": F.col("_at"), "_is_event": F.lit(True)}), allowMissingColumns=True)
    following = F.last(F.when(F.col("_is_event"), F.struct("_at", "_event")), ignorenulls=True).over(later)
    placed = both.withColumn("_next", following).where("not _is_event").select(*new.columns, "_next")
    if old is not None:
        placed = placed.unionByName(old.join(first, ["repo_path", "file_path"], "left").select(*new.columns, "_next"))
    placed = placed.withColumns({"_at": F.col("_next._at"), "_event": F.col("_next._event")}).drop("_next")
    is_live = F.col("deleted_at").isNull()
    marks = placed.where("_at is not null").select("repo_path", "_at", "_event", F.when(is_live, "live").otherwise("gone").alias("action"), F.col("file_path").alias("src")).distinct()
    marked = steps.unionByName(marks, allowMissingColumns=True).withColumn("_after", ~F.col("action").isin("live", "gone"))
    walk = dealt(marked, "repo_path").sortWithinPartitions("repo_path", "_at", "_event", "_after").mapInPandas(copying, WALK)
    ways = walk.sortWithinPartitions("repo_path", F.desc("_at"), F.desc("_event")).mapInPandas(routes, ROUTES)
    moved = placed.where("_at is not null").join(ways, ["repo_path", "file_path", "_at", "_event"])
    ends = moved.withColumn("_end", F.explode(F.when(is_live, F.col("_live")).otherwise(F.col("_gone"))))
    clone = F.when(F.col("_end.copies") == "", F.col("id")).otherwise(-F.abs(F.xxhash64("id", "_end.copies")))
    ends = ends.withColumns({"id": clone, "file_path": F.col("_end.to"), "deleted_at": F.when(F.col("_end.keeps"), F.col("deleted_at")).otherwise(F.col("_end.deleted"))})
    return placed.where("_at is null").select(*new.columns).unionByName(ends.select(*new.columns))
