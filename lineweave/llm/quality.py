"""Quality by regularised quadratic discriminant analysis of document statistics.

Each text becomes a vector of transformed statistics. Every labelled row that may be learned from adds to the counts,
sums and cross products of its class, summed by Spark. Each class covariance is shrunk towards the pooled one and its
diagonal; its Cholesky factor is kept. The score is the logistic of the difference of the classes' log densities, by
Mahalanobis distance, and of their log frequencies.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import crc_of_id, cut, pick, utf8

NAMES = ("words", "word_size", "capitals", "digits", "signs", "odd_signs", "spaces", "foreign", "lines", "line_repeats", "word_repeats", "stops", "bare", "once")
SHRINK = 0.15
THRESHOLD = 0.7
#: keep_good() broadcasts up to this many labels (12 bytes each), beyond that it joins by a shuffle.
BROADCAST_LABELS = 2_000_000
_all = bytes(range(256))
_kept = {
    "capitals": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digits": b"0123456789",
    "plain": b".,;:'\"()-?",
    "odd": b"#$%&*+/<=>@[\\]^_`{|}~!",
    "foreign": bytes(range(128, 256)),
    "stops": b".!?",
}
_others = {k: bytes(set(_all) - set(v)) for k, v in _kept.items()}
_space = re.compile(rb"\s")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of NAMES; null counts as empty."""
    data = utf8(text)
    n = max(1, len(data))
    words = data.split()
    many = max(1, len(words))
    distinct = set(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    has = {k: len(data.translate(None, v)) for k, v in _others.items()}
    letters = max(1, has["capitals"] + has["lower"] + has["foreign"])
    bare = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words)
    single = sum(len(w) == 1 and not w.isalnum() for w in words)
    root = np.sqrt
    return [
        float(np.log1p(len(words))),
        float(np.log(max(1.0, (len(data) - len(words)) / many))),
        float(root(has["capitals"] / letters)),
        float(root(has["digits"] / n)),
        float(root(has["plain"] / n)),
        float(root(has["odd"] / n)),
        float(root(max(0, len(data) - sum(map(len, words))) / n)),
        float(root(has["foreign"] / n)),
        float(np.log(many / max(1, len(lines)))),
        float(root((len(lines) - len(set(lines))) / (len(lines) + 5))),  # a repeat in a few lines says little
        float(np.log(many / max(1, len(distinct))) / max(1.0, np.log1p(many))),
        float(root(has["stops"] / many)),
        float(root(bare / many)),
        float(root(single / many)),
    ]


def statistics_of(text: Column | str) -> Column:
    """The statistics of a text column."""

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(x.as_py()) for x in texts], pa.list_(pa.float64()))

    return of(text)


@dataclass
class Model:
    """For each class: log frequency, mean, Cholesky factor of the covariance. One class only, or none: a fixed score."""

    classes: list[tuple[float, np.ndarray, np.ndarray]]
    fixed: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.full(len(x), self.fixed)
        logs = []
        for prior, mean, factor in self.classes:
            z = np.linalg.solve(factor, (x - mean).T)
            logs.append(prior - np.log(np.diag(factor)).sum() - 0.5 * (z * z).sum(axis=0))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -60, 60)))


def fit(moments: list[tuple[int, np.ndarray, np.ndarray]], shrink: float = SHRINK) -> Model:
    """moments: for class 0 and class 1, the number of rows, the sum of vectors and the sum of their outer products."""
    if any(n == 0 for n, _, _ in moments):
        return Model([], 0.5 if not any(n for n, _, _ in moments) else 0.98 if moments[1][0] else 0.02)
    total = sum(n for n, _, _ in moments)
    raw = [(n, s / n, q / n - np.outer(s / n, s / n)) for n, s, q in moments]
    pooled = sum(n * c for n, _, c in raw) / total
    floor = np.diag(np.maximum(np.diag(pooled), 1e-4))
    classes = []
    for n, mean, cov in raw:
        part = min(0.9, shrink + len(mean) / (n + len(mean)))
        mixed = (1 - part) * cov + part * (0.5 * pooled + 0.5 * floor)
        classes.append((float(np.log(n / total)), mean, np.linalg.cholesky(mixed + 0.02 * floor)))
    return Model(classes)


def moments(rows: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Of rows with x (array of statistics) and y (0 or 1): one aggregate over all of them, two rows to the driver."""
    d = len(NAMES)
    x: list[Column] = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(c) for c in x] + [F.sum(x[i] * x[j]) for i in range(d) for j in range(i, d)]
    got = {r["y"]: (r["n"], np.array(r["s"])) for r in rows.groupBy("y").agg(F.count("*").alias("n"), F.array(*sums).alias("s")).collect()}
    out = []
    for y in (0, 1):
        n, s = got.get(y, (0, np.zeros(d + d * (d + 1) // 2)))
        outer = np.zeros((d, d))
        outer[np.triu_indices(d)] = s[d:]
        out.append((n, s[:d], outer + np.triu(outer, 1).T))
    return out


def marks_of(labels: DataFrame) -> DataFrame:
    """doc_id, y: the labels that may be learned from, those whose crc32(doc_id) mod 4 is not 2; of several the largest."""
    marks = pick(labels, "doc_id", "quality").where(F.col("quality").isNotNull() & (crc_of_id(F.col("doc_id")) % 4 != 2))
    return marks.groupBy("doc_id").agg(F.max(F.when(F.col("quality") != 0, 1).otherwise(0)).alias("y"))


def train(stats: DataFrame, labels: DataFrame) -> Model:
    """stats: doc_id, x. All labelled rows that may be learned from count."""
    return fit(moments(stats.join(marks_of(labels), "doc_id").select("x", "y")))


def score_of(model: Model):
    """A function of a column of statistics: the score."""

    @F.arrow_udf("double")
    def of(x: pa.Array) -> pa.Array:
        return pa.array(model.score(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))))

    return of


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document, also for repeated rows and null ids.

    Null texts count as empty; empty texts are scored like others. Without labels of both classes all get a fixed
    score. An empty table gives no rows. Long texts are read whole.
    """
    stats = cut(pick(docs, "doc_id", "text").select("doc_id", statistics_of("text").alias("x")))
    score = score_of(train(stats, labels))
    rows = stats.select("doc_id", (crc_of_id(F.col("doc_id")) % 4 == 2).alias("held_out"), score("x").alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that score ``least`` or more; all columns stay, whatever their names.

    Each row is told by its own text, whatever its doc_id. Null and empty texts are scored as empty ones. Without labels of
    both classes all documents have one score. An empty table gives no rows. Statistics are computed for the labelled
    documents to fit, and once more for each document as it is scored.
    """
    marks = cut(marks_of(labels))
    some = pick(docs, "doc_id", "text").join(F.broadcast(marks) if marks.count() <= BROADCAST_LABELS else marks, "doc_id")
    model = fit(moments(some.select(statistics_of("text").alias("x"), "y")))
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kept = flat.where(score_of(model)(statistics_of(F.col(f"c{docs.columns.index('text')}"))) >= least)
    return kept.toDF(*docs.columns)
