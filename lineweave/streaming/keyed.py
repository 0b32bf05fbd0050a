"""Streams with keyed state that commits close: work sessions of a branch, working logs of a file.

State lies in Spark's RocksDB store, keyed by (repository, branch) for sessions and by a group of files and the file for logs, and
goes after ``idle`` without use. Within a batch events are taken by time, across batches as they arrive, as the surveyed tool does:
the base of an edit is what is HEAD when it comes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta
from itertools import groupby

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lineweave.functions import text
from lineweave.operators import align, diff, match
from lineweave.operators.align import attribute
from lineweave.streaming import streams

BRANCH = ["repo_path", "branch"]
FILE = [*BRANCH, "file_path"]
IDLE = timedelta(days=60)
#: Files go to the processor together, in so many groups: a call and its frames cost more than a file's few events.
GROUPS = 1 << 13
#: A group's events of a batch are sorted in memory up to so many rows and characters; beyond that they wait in the state store.
HELD_ROWS, HELD_CHARS = 1 << 13, 1 << 24
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession):
    """State with a time to live needs the RocksDB store; a query keeps the store that it began with. Such a state asks for
    batches without data for ever, so a run over what is there would not end with them."""
    names = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def _keyed(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    """The processor goes to its workers by value: the one that reads its schemas beside the driver doesn't search the
    driver's module path."""
    modules = [sys.modules[__name__], align]
    for m in modules:
        cloudpickle.register_pickle_by_value(m)
    try:
        return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Update", "ProcessingTime")
    finally:
        for m in modules:
            cloudpickle.unregister_pickle_by_value(m)


def _millis(idle: timedelta) -> int:
    return int(idle.total_seconds() * 1000)


# Work sessions: a branch has one until a commit, which closes it and whose id is the next one's base.
STEP = "repo_path string, branch string, kind string, id long, ts_ns long, file_path string, base_sha string, new_base string, committed boolean, edits long"


class _Sessions(StatefulProcessor):
    def __init__(self, idle: timedelta):
        self.idle = _millis(idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", "base string, since long, edits long", self.idle)
        self.files = handle.getMapState("files", "file string", "edits long", self.idle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for pdf in rows for x in pdf[["ts_ns", "kind", "id", "file_path", "sha", "files"]].itertuples(index=False, name=None)]
        # Of equal times a commit comes first: what is written at that moment is on top of it.
        held.sort(key=lambda x: (x[0], x[1] != "commit", x[2]))
        base, since, edits = self.session.get() if self.session.exists() else ("", None, 0)
        # The open files are read from the store once and what changed of them is written once, however many commits there are.
        stored = {file: n for (file,), (n,) in self.files.iterator()}
        now, touched = dict(stored), set()
        out: list[tuple] = []
        names, kinds = [x.split()[0] for x in STEP.split(", ")], {"id": "Int64", "ts_ns": "Int64", "edits": "Int64", "committed": "boolean"}
        for ts, kind, id_, file, sha, files in held:
            if kind == "commit":
                taken = set(files if files is not None else ())
                out += [(*key, "step", id_, ts, x, base, sha, x in taken, None) for x in now]
                for x in taken:
                    now.pop(x, None)
                out.append((*key, "session", id_, since, None, base, sha, None, edits))
                base, since, edits = sha, ts, 0
            else:
                now[file] = now.get(file, 0) + 1
                touched.add(file)
                edits += 1
                since = ts if since is None else since
                out.append((*key, "edit", id_, ts, file, base, None, None, None))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=names).astype(kinds)
                out = []
        for file in stored.keys() - now.keys():
            self.files.removeKey((file,))
        for file in touched & now.keys():
            self.files.updateValue((file,), (now[file],))
        self.session.update((base, since, edits))
        yield pd.DataFrame(out, columns=names).astype(kinds)

    def close(self) -> None:
        pass


def work_sessions(events: DataFrame, idle: timedelta = IDLE) -> DataFrame:
    """What edits and commits do to the sessions of branches; see STEP.

    events (a stream): repo_path, branch, ts_ns, kind (edit or commit), id, file_path (of edits), sha and files (of commits).
    Kinds of rows: ``edit`` with the base its session has; for each commit ``session``, the closed one with its number of
    edits and since when it was open, and ``step`` for each file that was open, with the base it leaves, the new one and
    whether the commit took it. A file that it didn't take stays open. Edits without a branch are out of any session.
    Events of a branch in one batch are held together, without contents.
    """
    rows = events.where("repo_path <> '' and branch <> ''").select(*BRANCH, "ts_ns", "kind", "id", "file_path", "sha", "files")
    return _keyed(rows, BRANCH, _Sessions(idle), STEP)


# Working logs: a file's authors by line on each base that it has a log for.
LOG = "base_sha string, version int, gone boolean, line_no int, author_type string, tool string, overrode string"
EVENT = ["ts", "id", "kind", "base_sha", "new_base", "committed", "content", "baseline", "author_type", "tool"]
_PENDING = "base_sha string, new_base string, committed boolean, kind string, content string, baseline string, author_type string, tool string"


class _Logs(StatefulProcessor):
    def __init__(self, idle: timedelta):
        self.idle = _millis(idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.logs = handle.getMapState("logs", "file string, base string", "version int, content string, who array<string>, tool array<string>", self.idle)
        self.pending = handle.getMapState("pending", "place long, ts long, id long, n long", _PENDING, self.idle)

    def _events(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple[str, tuple]]:
        """The batch's events of a group, file by file in order. A hot group's go to the state store and come back one by one."""
        names, held, chars, order, n = [x.split()[0] for x in _PENDING.split(", ")], [], 0, [], 0
        places: dict[str, int] = {}

        def put_away() -> None:
            for at, value in held:
                self.pending.updateValue(at, value)
                order.append(at)
            held.clear()

        text = lambda x: x if isinstance(x, str) else None
        for pdf in rows:
            for file, ts, id_, *values in pdf[["file", "ts", "id", *names]].itertuples(index=False, name=None):
                value = tuple(x is not None and x == x and bool(x) if c == "committed" else text(x) for c, x in zip(names, values, strict=True))
                held.append(((places.setdefault(file, len(places)), int(ts), int(id_), n), value))
                n += 1
                chars += len(value[names.index("content")] or "")
            if order or len(held) > HELD_ROWS or chars > HELD_CHARS:
                put_away()
        files = list(places)
        if not order:
            yield from ((files[at[0]], value) for at, value in sorted(held, key=lambda x: x[0]))
            return
        put_away()
        for at in sorted(order):
            yield files[at[0]], self.pending.getValue(at)
            self.pending.removeKey(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        names = ["_file", *[x.split()[0] for x in LOG.split(", ")]]
        for file, events in groupby(self._events(rows), key=lambda x: x[0]):
            out += self._file(file, (value for _, value in events))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=names).astype({"line_no": "Int32"})
                out = []
        yield pd.DataFrame(out, columns=names).astype({"line_no": "Int32"})

    def _file(self, file: str, events: Iterator[tuple]) -> list[tuple]:
        logs: dict[str, tuple] = {}  # base: version, content, authors; what this batch touched
        over: dict[str, list] = {}
        gone: dict[str, int] = {}
        stored: dict[str, bool] = {}  # whether the store has a base's log, of those asked for

        def get(base: str) -> tuple | None:
            if base not in stored:
                stored[base] = self.logs.containsKey((file, base))
                if stored[base]:
                    version, content, who, tool = self.logs.getValue((file, base))
                    logs[base] = (version, content, [(a, b, "", "", "") for a, b in zip(who, tool, strict=True)])
            return logs.get(base)

        for base, new_base, committed, kind, content, baseline, who, tool in events:
            base = base or ""
            if kind == "commit":
                old = get(base)
                if old is None or committed or not new_base or new_base == base:
                    continue  # the log of a file that was committed stays at the parent
                if get(new_base) is None:  # else the newer log wins
                    logs[new_base], over[new_base] = (old[0], *old[1:]), over.get(base, [])
                    gone.pop(new_base, None)
                gone[base] = old[0]
                del logs[base]
            else:
                version, before, prior = get(base) or (0, baseline or "", [])
                authors, replaced, _ = attribute(prior, before, content, (who, tool or "", "", "", ""))
                logs[base], over[base] = (version, content or "", authors), replaced
                gone.pop(base, None)
        out = [(file, base, version + 1, True, None, None, None, None) for base, version in gone.items()]
        for base in gone:
            if stored.get(base):
                self.logs.removeKey((file, base))
        for base, (version, content, authors) in logs.items():
            if base in over:  # changed, or come to this base
                version += 1
                self.logs.updateValue((file, base), (version, content, [a[0] for a in authors], [a[1] for a in authors]))
                lost = over[base] or [None] * len(authors)
                out += [(file, base, version, False, k + 1, a[0], a[1], o[0] if o else None) for k, (a, o) in enumerate(zip(authors, lost, strict=True))]
                if not authors:
                    out.append((file, base, version, False, None, None, None, None))
        return out

    def close(self) -> None:
        pass


def working_logs(events: DataFrame, keys: list[str], idle: timedelta = IDLE) -> DataFrame:
    """keys, base_sha, version, gone, line_no, author_type, tool, overrode: a file's log on a base after each batch that changed it.

    events (a stream): keys, ts, id, kind. An ``edit`` has content, author_type, tool, base_sha, and baseline for the first edit on
    a base; a ``commit`` has base_sha, new_base and whether it ``committed`` the file. The log of a file that a commit didn't take
    moves to the new base, unless that has one, and the old one is told ``gone``; a committed one stays, for a later look
    at the commit. An empty file has one row without a line. Logs unused for ``idle`` leave the state. Keys are texts and whole
    numbers; a file is known by them as JSON.
    """
    types = dict(events.dtypes)
    group = F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).cast("int").alias("group")
    rows = events.select(group, F.to_json(F.struct(*keys)).alias("file"), *EVENT)
    logs = _keyed(rows, ["group"], _Logs(idle), f"_file string, {LOG}")
    file = F.from_json("_file", ", ".join(f"`{k}` {types[k]}" for k in keys))
    return logs.select(file.alias("_file"), *[x.split()[0] for x in LOG.split(", ")]).select("_file.*", "*").drop("_file")


def current(logs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, base_sha, line_no, author_type, tool, overrode of the logs as they stand: of each base the last version, if it isn't gone."""
    last = F.max("version").over(Window.partitionBy(*keys, "base_sha"))
    return logs.withColumn("_last", last).where("version = _last and not gone and line_no is not null").drop("_last", "version", "gone", "batch")


def live_view(log: DataFrame, texts: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_no, author_type, tool, overrode of the lines that aren't committed yet.

    log: current() on the live base. texts: keys, old_text (at HEAD; null for an untracked file, whose lines all count) and
    new_text. units: recorded lines since the base as match.consume_once() takes them, with tool: a line of a person that
    matches one is an AI's, by that tool, and overrode nobody.
    """
    changed = align.aligned(texts, keys).where("old_pos is null or moved").select(*keys, (F.col("new_pos") + 1).alias("line_no"))
    lines = log.join(changed, [*keys, "line_no"], "left_semi")
    content = diff.explode_lines(texts, "new_text", *keys).select(*keys, (F.col("pos") + 1).alias("line_no"), text.line_sha(F.col("content")).alias("content_sha"), text.line_sha_norm(F.col("content")).alias("content_sha_norm"))
    human = lines.where("author_type = 'Human'").select(*keys, "line_no").join(content, [*keys, "line_no"])
    over = match.consume_once(human, units, keys).select(*keys, "line_no", F.col("tool").alias("_tool"))
    told = lines.join(over, [*keys, "line_no"], "left")
    mine = F.col("_tool").isNotNull()
    return told.withColumns({"author_type": F.when(mine, "AI").otherwise(F.col("author_type")), "tool": F.coalesce("_tool", "tool"), "overrode": F.when(~mine, F.col("overrode"))}).drop("_tool")


def landed(spark: SparkSession, stream: DataFrame, at: str) -> DataFrame:
    """What a keyed stream emits, landed batch by batch and read back; called again it goes on from its state."""
    with rocks(spark):
        return streams.updated(spark, stream, at)
