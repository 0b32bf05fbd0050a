"""What shell commands write and delete. Tokenising is a small helper per row, in Arrow batches."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of redirects, deletions and here-documents in shell text, and what a backslash keeps.
REDIRECT = re.compile("(?:[^0-9&]|^)>>?\\s*([^\\s&|;<>'\"`]+)")
UNIX_DELETE = re.compile(r"(?:^|\s)(?:git\s+)?rm\s+([^&|;\n]+)")
WINDOWS_DELETE = re.compile(r"(?i)(?:^|[\s&|;(])(?:del|erase|remove-item)\s+([^&|;\n]+)")
HEREDOC = re.compile(r"<<-?\s*['\"]?([A-Za-z_][A-Za-z0-9_]*)['\"]?")
ABSOLUTE = re.compile(r"/|[A-Za-z]:[\\/]")
ESCAPABLE = " \t\n\r'\"\\&|;$()`*?"

_QUOTED = r"""'(?P<single>[^']*)'?|"(?P<double>(?:\\["\\]|[^"])*)"?|(?P<space>[ \t\n\r]+)"""
PIECES = re.compile(rf"{_QUOTED}|\\(?P<kept>[{re.escape(ESCAPABLE)}])|(?P<plain>[^'\"\\ \t\n\r]+|\\)", re.S)
PIECES_WITH_BACKSLASHES = re.compile(rf"{_QUOTED}|(?P<plain>[^'\" \t\n\r]+)", re.S)


def visible(command: str) -> Iterator[str]:
    """The lines of a command without its here-documents: their openers go, and so do the lines up to the closing word.

    An opener on the last line ends the command.
    """
    lines = deque(command.split("\n"))
    while lines:
        line = lines.popleft()
        names = HEREDOC.findall(line)
        if names and not lines:
            line = HEREDOC.split(line, 1)[0]
        for name in names:
            while lines and lines.popleft().rstrip() != name:
                pass
        yield HEREDOC.sub("", line)


def words(text: str, escapes: bool = True) -> list[str]:
    """Shell words with quotes taken off; with ``escapes`` a backslash keeps the next special character."""
    out, fresh = [], True
    for m in (PIECES if escapes else PIECES_WITH_BACKSLASHES).finditer(text):
        if m.lastgroup == "space":
            fresh = True
            continue
        value = re.sub(r'\\(["\\])', r"\1", m["double"]) if m.lastgroup == "double" else m[m.lastgroup]
        if fresh:
            out.append(value)
        else:
            out[-1] += value
        fresh = False
    return out


def bare(target: str) -> str:
    return target.strip().strip("'\"")


def written(command: str) -> list[str]:
    """Relative targets of > and >>."""
    targets = map(bare, REDIRECT.findall("\n".join(visible(command))))
    return [t for t in targets if t and not ABSOLUTE.match(t)]


def deleted(command: str) -> list[str]:
    """Arguments of rm, git rm, del, erase and Remove-Item, without flags."""
    out = []
    for verb, escapes, flags in ((UNIX_DELETE, True, "-"), (WINDOWS_DELETE, False, "-/")):
        targets = (bare(t) for arguments in verb.findall(command) for t in words(arguments, escapes))
        out += [t for t in targets if t and t[0] not in flags]
    return out


def _column(rule, command: Column) -> Column:
    @F.arrow_udf("array<string>")
    def of(batch: pa.Array) -> pa.Array:
        return pa.array([None if x is None else rule(x) for x in batch.to_pylist()], pa.list_(pa.string()))

    return of(command)


def write_targets(command: Column) -> Column:
    return _column(written, command)


def delete_targets(command: Column) -> Column:
    return _column(deleted, command)
