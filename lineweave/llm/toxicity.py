"""Toxicity by a factorization machine over hashed terms.

A text is the set of its words and of their stems (first bytes), hashed. The score is a bias, a weight for each term and, for each pair
of terms, the inner product of their factors: a word that is harmless alone can count beside another. All terms of the
learning sample that two of its texts hold have a weight and factors. How strongly a term stands in a text, its value, follows its
likelihood ratio against the label: what chance explains gets LOW, so that thousands of such words don't drown the few
that tell, and yet the pairs that they form are learned. The classes are weighted so that a score of THRESHOLD is where a
text is as likely in either, which makes the scale of scores independent of how many toxic texts there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import crc_of_id, pick, word_bytes

BUCKETS = 1 << 18
FACTORS, STEPS, RATE = 4, 60, 0.06
#: L2 on weights and on factors.
DECAY_W, DECAY_V = 5e-4, 3e-3
#: A term's value: LOW up to a log-likelihood ratio of CHANCE, 1 from SURE more, straight between them.
LOW, CHANCE, SURE = 0.02, 3.0, 6.0
#: The sample for fitting: so many labelled documents of each class at most, each of no more bytes than the second number,
#: and of each class no more bytes in all than the third.
SAMPLE_DOCS, LONGEST, SAMPLE_BYTES = 3000, 1 << 17, 1 << 24
STEMS = (4, 5, 6)
KNOWN_WORDS = 300_000
THRESHOLD = 0.7


def terms_of(word: bytes) -> list[int]:
    """Buckets of a word: its own and those of its stems, for a word that is longer."""
    return [zlib.crc32(word) & (BUCKETS - 1), *[zlib.crc32(word[:n] + b"*%d" % n) & (BUCKETS - 1) for n in STEMS if len(word) > n]]


def buckets(text: str | None) -> set[int]:
    return {k for w in set(word_bytes(text)) for k in terms_of(w)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Model:
    """Which hashed terms count, and their weights: bias, w (terms), v (terms x factors)."""

    terms: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        """Scores of n texts; rows and cols say which text has which term."""
        linear = np.bincount(rows, self.w[cols], n)
        pairs = np.zeros(n)
        for f in range(self.v.shape[1]):
            x = self.v[cols, f]
            pairs += np.bincount(rows, x, n) ** 2 - np.bincount(rows, x * x, n)
        return sigmoid(self.bias + linear + 0.5 * pairs)


def _entropy(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    p = np.clip(k / np.maximum(n, 1), 1e-12, 1 - 1e-12)
    return -n * (p * np.log(p) + (1 - p) * np.log(1 - p))


def fit(texts: list[list[int]], labels: np.ndarray) -> Model:
    """Weights and factors of all terms that two texts hold: weighted logistic loss with L2, by Adam over sparse rows."""
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.int64), float(np.where(len(y) and y.max() > 0, 4.0, -4.0)), np.zeros(0), np.zeros((0, FACTORS)))
    n, toxic = len(y), float(y.sum())
    rows = np.repeat(np.arange(n), [len(t) for t in texts])
    cols = np.concatenate([np.asarray(t, np.int64) for t in texts])
    seen, hits = np.bincount(cols, minlength=BUCKETS), np.bincount(cols, y[rows], BUCKETS)
    gain = _entropy(np.float64(toxic), np.float64(n)) - _entropy(hits, seen) - _entropy(toxic - hits, n - seen)
    terms = np.flatnonzero(seen > 1)
    value = np.clip((gain[terms] - CHANCE) / SURE, LOW, 1).astype(np.float32)[:, None]
    place = np.full(BUCKETS, -1)
    place[terms] = np.arange(len(terms))
    known = place[cols] >= 0
    rows, cols = rows[known], place[cols[known]]
    if not len(terms):
        return Model(terms, 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    # Sums over a text's terms and over a term's texts are sums over runs, of the rows as they are and of the rows by column.
    some, first = np.unique(rows, return_index=True)
    by_col = np.argsort(cols, kind="stable")
    rows_by_col, first_by_col = rows[by_col], np.searchsorted(cols[by_col], np.arange(len(terms)))
    weight = np.where(y > 0, THRESHOLD / y.mean(), (1 - THRESHOLD) / (1 - y.mean())).astype(np.float32) / n
    params = [np.zeros(1, np.float32), np.zeros((len(terms), 1 + FACTORS), np.float32)]  # the bias; a weight and factors for each term
    params[1][:, 1:] = np.random.default_rng(11).normal(0, 0.05, (len(terms), FACTORS))
    decay = [np.float32(0), np.array([DECAY_W] + [DECAY_V] * FACTORS, np.float32)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        bias, w = params
        held = (w * value)[cols]
        sums, squares = np.zeros((n, 1 + FACTORS), np.float32), np.zeros(n, np.float32)
        sums[some] = np.add.reduceat(held, first, axis=0)
        squares[some] = np.add.reduceat((held[:, 1:] ** 2).sum(axis=1), first)
        error = (weight * (sigmoid(bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares)) - y)).astype(np.float32)
        back = np.concatenate([error[:, None], error[:, None] * sums[:, 1:]], axis=1)
        grad = np.add.reduceat(back[rows_by_col], first_by_col, axis=0) * value
        grad[:, 1:] -= w[:, 1:] * (grad[:, :1] * value)
        for p, g, d, a, c in zip(params, (error.sum(keepdims=True), grad), decay, m, v, strict=True):
            g = g + d * p
            a += 0.1 * (g - a)
            c += 0.001 * (g * g - c)
            p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.999**step)) + 1e-8)
    return Model(terms, float(params[0][0]), (params[1][:, 0] * value[:, 0]).astype(float), (params[1][:, 1:] * value).astype(float))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic: labelled documents that may be learned from, by the hash of doc_id, within the bounds of the sample."""
    marks = pick(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull() & (crc_of_id(F.col("doc_id")) % 3 != 1))
    marks = marks.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("toxic"))
    marks = marks.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    want = F.lit(False)
    for mark, n in sizes.items():
        want = want | ((F.col("toxic") == mark) & (F.col("at") < int((1 << 40) * min(1.0, SAMPLE_DOCS / n))))
    chosen = marks.where(want).orderBy("at", "doc_id").limit(4 * SAMPLE_DOCS)
    met = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 4 * SAMPLE_DOCS ids at most
    lengths = met.groupBy("doc_id", "toxic", "at").agg(F.sum(F.octet_length("text")).alias("bytes")).where(F.coalesce("bytes", F.lit(0)) <= LONGEST).orderBy("at", "doc_id").limit(4 * SAMPLE_DOCS)
    left, ids = {0: SAMPLE_BYTES, 1: SAMPLE_BYTES}, []
    for r in lengths.collect():  # ids and numbers, 4 * SAMPLE_DOCS at most
        left[r["toxic"]] -= r["bytes"] or 0
        if left[r["toxic"]] >= 0:
            ids.append((r["doc_id"], r["toxic"]))
    return docs.sparkSession.createDataFrame(ids, marks.select("doc_id", "toxic").schema)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from sample()."""

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(buckets(x.as_py())) for x in texts], pa.list_(pa.int32()))

    rows = pick(docs, "doc_id", "text").join(F.broadcast(sample(docs, labels)), "doc_id")  # 4 * SAMPLE_DOCS ids at most
    got = rows.select("doc_id", of("text").alias("ids"), "toxic").orderBy("doc_id").limit(4 * SAMPLE_DOCS).toArrow()
    offsets, ids = (x.combine_chunks() for x in (got["ids"], got["toxic"])) if len(got) else (pa.array([], pa.list_(pa.int32())), pa.array([], pa.int32()))
    return fit([x.values.to_numpy() for x in offsets], ids.to_numpy())


def toxicity_of(model: Model):
    """A function of a text column: the score, 0 to 1. Null and empty texts get the bias alone."""
    terms = model.terms

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[bytes, tuple[int, ...]] = {}
        place = {int(t): k for k, t in enumerate(terms)}

        def places(word: bytes) -> tuple[int, ...]:
            if len(known) > KNOWN_WORDS:
                known.clear()
            known[word] = got = tuple(place[k] for k in terms_of(word) if k in place)
            return got

        for batch in batches:
            rows, cols = [], []
            for k, text in enumerate(batch):
                found = {x for w in set(word_bytes(text.as_py())) for x in (known[w] if w in known else places(w))}
                cols += found
                rows += [k] * len(found)
            yield pa.array(model.scores(np.array(rows, np.int64), np.array(cols, np.int64), len(batch)))

    return of


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document, also for repeated rows and null ids (held_out by the empty text's crc32).

    Null and empty texts get the score of no terms. Without labels, or with one class only, all texts get the same
    score. An empty table gives no rows. Long texts are read whole.
    """
    score = toxicity_of(train(docs, labels))
    rows = pick(docs, "doc_id", "text").select("doc_id", (crc_of_id(F.col("doc_id")) % 3 == 1).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
