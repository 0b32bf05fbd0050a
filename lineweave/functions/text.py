"""Column functions on paths and lines of text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_path(path: Column) -> Column:
    """Trimmed, with forward slashes, without one leading ``./``."""
    return F.regexp_replace(F.translate(F.trim(path), "\\", "/"), r"^\./", "")


def clean_log_path(path: Column) -> Column:
    """clean_path() without any leading slashes: the form that working logs use."""
    return F.regexp_replace(clean_path(path), "^/+", "")


def collapse_space(line: Column) -> Column:
    """Runs of Unicode white space become one space, ends are trimmed. The hash's normaliser."""
    return F.trim(F.regexp_replace(line, r"(?U)\s+", " "))


def strip_space(line: Column) -> Column:
    """Without any Unicode white space. The aligner's normaliser, not to be mixed with collapse_space()."""
    return F.regexp_replace(line, r"(?U)\s", "")


def is_blank(line: Column) -> Column:
    return collapse_space(line) == ""


def line_sha(line: Column) -> Column:
    """SHA-256 of a line without trailing carriage returns."""
    return F.sha2(F.regexp_replace(line, r"\r+$", ""), 256)


def line_sha_norm(line: Column) -> Column:
    """SHA-256 of the normalised line, empty for blank ones."""
    norm = collapse_space(line)
    return F.when(norm == "", "").otherwise(F.sha2(norm, 256))


def split_lines(text: Column) -> Column:
    """Lines without their ends (LF, or CR LF); what follows a final LF is no line, and an empty text has none."""
    lines = F.split(text, "\n")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    return F.transform(lines, lambda x: F.regexp_replace(x, r"\r$", ""))


def count_lines(text: Column) -> Column:
    """Line ends, and one more for a last line without one."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return ends + F.when((text == "") | text.endswith("\n"), 0).otherwise(1)


def similar_bytes(a: str, b: str) -> bool:
    """Whether two lines are versions of one: equal but for spacing, or half of both is common at the ends, in bytes."""
    x, y = " ".join(a.split()), " ".join(b.split())
    if x == y:
        return True
    if not x or not y:
        return False
    p, q = a.encode("utf-8", "surrogatepass"), b.encode("utf-8", "surrogatepass")
    most, head = min(len(p), len(q)), 0
    while head < most and p[head] == q[head]:
        head += 1
    tail = 0
    while tail < most - head and p[-1 - tail] == q[-1 - tail]:
        tail += 1
    return 4 * (head + tail) >= len(p) + len(q)


def digest(sha: Column) -> Column:
    """A hash as bytes: 64 lower-case hex digits as the 32 they stand for, other texts behind a mark that is longer than those."""
    other = F.concat(F.lit(b"=" * 33), sha.cast("binary"))
    return F.when(sha == "", F.lit(b"")).when(sha.rlike("^[0-9a-f]{64}$"), F.unhex(sha)).otherwise(other)


def undigest(sha: Column) -> Column:
    """The text that digest() had."""
    return F.when(F.octet_length(sha) == 32, F.lower(F.hex(sha))).otherwise(F.substring(sha, 34, 1 << 30).cast("string"))


def similar(a: Column, b: Column) -> Column:
    """similar_bytes() of two columns; null if either is null."""

    @F.arrow_udf("boolean")
    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if i is None or j is None else similar_bytes(i, j) for i, j in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.bool_())

    return of(a, b)


def uri_to_path(uri: Column) -> Column:
    """Path of a file URI, percent-decoded, without the slash before a drive letter."""
    rest = F.regexp_replace(uri, "^file://(localhost)?", "")
    decoded = F.url_decode(F.replace(rest, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, r"^/([A-Za-z]:)", "$1")


def to_nanos(stamp: Column) -> Column:
    """Unix nanoseconds of an RFC 3339 time, 0 if it is none. Spark's times hold micros, so the last digits are added."""
    whole = F.regexp_extract(stamp, r"^(\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d)(?:\.\d+)?([Zz]|[+-]\d\d:\d\d)$", 1)
    zone = F.upper(F.regexp_extract(stamp, r"([Zz]|[+-]\d\d:\d\d)$", 1))
    part = F.rpad(F.substring(F.regexp_extract(stamp, r"\.(\d+)", 1), 1, 9), 9, "0")
    seconds = F.unix_seconds(F.try_to_timestamp(F.concat(F.upper(whole), zone), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    return F.when(whole == "", F.lit(0)).otherwise(F.coalesce(seconds * 1_000_000_000 + part.cast("long"), F.lit(0))).cast("long")


def model_name(identifier: Column) -> Column:
    """Without the vendor before the first slash."""
    return F.regexp_replace(identifier, "^[^/]*/", "")


def is_object_id(text: Column) -> Column:
    """40 or 64 lower-case hex digits."""
    return text.rlike("^([0-9a-f]{40}|[0-9a-f]{64})$")


def share(part: Column, whole: Column) -> Column:
    """Percent with one digit, halves away from zero; a whole of 0 counts as 1."""
    return F.round(part * 1000.0 / F.when(whole == 0, 1).otherwise(whole)) / 10
