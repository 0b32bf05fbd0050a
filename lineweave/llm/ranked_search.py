"""Ranked lexical search: best-first document intervals bounded by range-maximum tables over posting lists.

A first pass counts each document's terms and keeps, for the terms that items ask for, their occurrences; N, L and the
documents of each term follow from it. Then tasks take their documents in blocks. A block has a posting list for each term,
in the order of doc_id, with the impact of the term in each document, and over all lists a sparse table that tells the
place of the largest impact in any part of a list. For an item the block starts as one interval of documents. Its bound is the sum
over terms of the largest impact in it; the interval of the largest bound is split at the document with the largest
impact, which is scored, and both rests are bounded in turn. Once no bound passes the k-th score the rest can't matter,
so the result is exact. A task carries its k best from block to block, and the tasks' best meet in one window.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm.common import pick, stored, utf8

K = 10
#: A block of documents ends with so many postings or documents: some 50 MB of tables.
BLOCK_POSTINGS, BLOCK_DOCS = 1 << 19, 1 << 14
#: Intervals that are split at once, so that their lists are looked up together.
AT_ONCE = 64
#: Items are searched in groups of at most so many distinct terms (unless one item alone has more) and so many items, which go to all tasks.
GROUP_TERMS, GROUP_ITEMS = 200_000, 20_000
LAST_ID = np.iinfo(np.int64).max

#: ASCII letters in lower case, digits and bytes of other letters as they are, every other byte a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits as UTF-8, A-Z lower-cased; null has none."""
    return utf8(text).translate(TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def groups_of(benchmark: DataFrame, group_terms: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items' distinct terms, in groups; rows come to the driver one partition at a time, as terms and not as texts."""

    @F.arrow_udf("array<binary>")
    def distinct(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(set(terms_of(x.as_py()))) for x in texts], pa.list_(pa.binary()))

    group, terms = [], set()
    for r in pick(benchmark, "item_id", "text").select("item_id", distinct("text").alias("terms")).toLocalIterator():
        own = [bytes(t) for t in r["terms"]]
        if group and (len(group) == GROUP_ITEMS or len(terms) + len(set(own) - terms) > group_terms):
            yield group
            group, terms = [], set()
        group.append((r["item_id"], own))
        terms.update(own)
    if group:
        yield group


def postings(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, tfs: each document with a term at all, its number of terms, and how often it has which of ``terms``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = terms_of(text.as_py())
                if words:
                    known = [(terms[w], k) for w, k in Counter(words).items() if w in terms]
                    rows.append((doc_id, len(words), [t for t, _ in known], [k for _, k in known]))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n", "terms", "tfs"])

    rows = pick(docs, "doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, tfs array<long>")


@dataclass
class Block:
    """Posting lists one after the other: keys (term * size + document), impacts, and where each term's list begins.

    tops[k][p] is the place of the largest impact among the 2**k postings from p; of equal ones the first.
    """

    ids: np.ndarray
    size: int
    keys: np.ndarray
    impacts: np.ndarray
    begins: np.ndarray
    tops: list[np.ndarray]

    @staticmethod
    def of(ids: np.ndarray, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int) -> Block:
        """ids: of the documents, ascending; docs, terms, impacts: a row for each posting, in any order."""
        size = max(1, len(ids))
        keys = terms.astype(np.int64) * size + docs
        order = np.argsort(keys, kind="stable")
        keys, impacts = keys[order], impacts[order]
        begins = np.searchsorted(keys, np.arange(n_terms + 1, dtype=np.int64) * size)
        longest, tops, width = int(np.diff(begins).max(initial=1)), [np.arange(len(keys), dtype=np.int32)], 1
        while 2 * width <= longest:  # entries that pass a list's end are never looked up
            low = tops[-1]
            a, b = low[: len(low) - width], low[width:]
            tops.append(np.where(impacts[a] >= impacts[b], a, b))
            width *= 2
        return Block(ids, size, keys, impacts, begins, tops)

    def largest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of the largest impact in each part [a, b) of a list; -1 for empty parts."""
        out = np.full(a.shape, -1, np.int64)
        length = b - a
        level = np.frexp(np.maximum(length, 1))[1] - 1
        for k in np.unique(level[length > 0]):
            at = (level == k) & (length > 0)
            x, y = self.tops[k][a[at]], self.tops[k][b[at] - (1 << int(k))]
            out[at] = np.where(self.impacts[x] >= self.impacts[y], x, y)
        return out

    def bounds(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For intervals by their parts of each list (intervals x terms): the sum of largest impacts, and the document of the largest."""
        place = self.largest(a, b)
        value = np.where(place >= 0, self.impacts[place], 0)
        best = value.argmax(axis=1)
        return value.sum(axis=1), self.keys[place[np.arange(len(place)), best]] % self.size


class Best:
    """The k best (score, doc_id) so far: higher scores first, then smaller ids."""

    def __init__(self, k: int) -> None:
        self.k, self.heap = k, []

    def offer(self, score: int, doc_id: int) -> None:
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, (score, -doc_id))
        elif (score, -doc_id) > self.heap[0]:
            heapq.heapreplace(self.heap, (score, -doc_id))

    def open(self, bound: np.ndarray, first_id: np.ndarray) -> np.ndarray:
        """Which intervals, by bound and smallest id, may hold a document that belongs here."""
        if len(self.heap) < self.k:
            return bound > 0
        score, last = self.heap[0]
        return (bound > max(score, 0)) | (bound == score) & (bound > 0) & (first_id < -last)


def search(block: Block, terms: np.ndarray, best: Best, at_once: int = AT_ONCE) -> None:
    """Offers ``best`` every document of the block that may be among the k best for these terms."""
    terms = terms[block.begins[terms + 1] > block.begins[terms]]
    if not len(terms) or not len(block.ids):
        return
    lo, hi = np.array([0]), np.array([len(block.ids)])
    a, b = block.begins[terms][None, :], block.begins[terms + 1][None, :]
    bound, split = block.bounds(a, b)
    base = terms.astype(np.int64) * block.size
    while True:
        keep = best.open(bound, block.ids[lo])
        if not keep.all():
            lo, hi, a, b, bound, split = (x[keep] for x in (lo, hi, a, b, bound, split))
        if not len(lo):
            return
        now = np.arange(len(lo)) if len(lo) <= at_once else np.argpartition(-bound, at_once - 1)[:at_once]
        rest = np.ones(len(lo), bool)
        rest[now] = False
        doc, a0, b0 = split[now], a[now], b[now]
        key = base[None, :] + doc[:, None]
        at = np.searchsorted(block.keys, key)
        met = (at < len(block.keys)) & (block.keys[np.minimum(at, len(block.keys) - 1)] == key)
        scores = np.where(met, block.impacts[np.minimum(at, len(block.keys) - 1)], 0).sum(axis=1)
        for score, d in zip(scores.tolist(), doc.tolist(), strict=True):
            best.offer(score, int(block.ids[d]))
        lo2, hi2 = np.concatenate([lo[now], doc + 1]), np.concatenate([doc, hi[now]])
        a2, b2 = np.concatenate([a0, at + met]), np.concatenate([at, b0])
        some = lo2 < hi2
        lo2, hi2, a2, b2 = lo2[some], hi2[some], a2[some], b2[some]
        bound2, split2 = block.bounds(a2, b2) if len(lo2) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        lo, hi, bound, split = (np.concatenate([x[rest], y]) for x, y in ((lo, lo2), (hi, hi2), (bound, bound2), (split, split2)))
        a, b = np.concatenate([a[rest], a2]), np.concatenate([b[rest], b2])


def _blocks(batches: Iterator[pa.RecordBatch], weights: np.ndarray, n_docs: int, n_terms: int, block_postings: int, block_docs: int) -> Iterator[Block]:
    """The documents of a task as blocks; n_docs and n_terms are N and L."""
    held: list[pa.RecordBatch] = []
    size = rows = 0

    def block() -> Block:
        table = pa.Table.from_batches(held).combine_chunks()
        # A null id comes after all others.
        ids = np.array([LAST_ID if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
        m = np.array([10 + 90 * n * n_docs // n_terms for n in table.column("n").to_pylist()], np.int64)  # exact whole numbers
        terms, tfs = (table.column(c).combine_chunks() for c in ("terms", "tfs"))
        counts = np.diff(terms.offsets.to_numpy())
        doc, t, tf = np.repeat(np.arange(len(ids)), counts), terms.flatten().to_numpy(), tfs.flatten().to_numpy()
        impact = weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        some = impact > 0
        return Block.of(ids[order], place[doc[some]], t[some], impact[some], len(weights))

    for batch in batches:
        at = 0
        while at < len(batch):
            ends = np.cumsum(pc.list_value_length(batch.column("terms")[at:]).to_numpy())
            take = max(1, min(len(batch) - at, block_docs - rows, int(np.searchsorted(ends, block_postings - size)) + 1))
            held.append(batch.slice(at, take))
            size, rows, at = size + int(ends[take - 1]), rows + take, at + take
            if size >= block_postings or rows >= block_docs:
                yield block()
                held, size, rows = [], 0, 0
    if held:
        yield block()


def _search_group(docs: DataFrame, items: list[tuple[int, list[bytes]]], k: int, block_postings: int, block_docs: int) -> DataFrame:
    terms = {t: n for n, t in enumerate(dict.fromkeys(t for _, own in items for t in own))}
    spark = docs.sparkSession
    found = stored(postings(docs, terms), "ranked_search")
    of_terms = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = found.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"] or 1
    weights = np.zeros(len(terms), np.int64)
    for r in of_terms.toLocalIterator():  # no more rows than the group has terms
        weights[r["term"]] = weight(n_docs, r["df"])
    asked = spark.sparkContext.broadcast((weights, [np.array([terms[t] for t in own], np.int64) for _, own in items]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries = asked.value
        best = [Best(k) for _ in queries]
        for block in _blocks(batches, weights, n_docs, n_terms, block_postings, block_docs):
            for query, own in zip(queries, best, strict=True):
                search(block, query, own)
        rows = [(q, None if -i == LAST_ID else -i, s) for q, own in enumerate(best) for s, i in own.heap if s > 0]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "doc_id", "score"])

    near = found.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(items)], "item int, item_id long")
    return ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")  # as many rows as the group has items


def top_documents(docs: DataFrame, benchmark: DataFrame, k: int = K, group_terms: int = GROUP_TERMS, block_postings: int = BLOCK_POSTINGS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: for each item its k highest-scoring documents with a score above 0.

    Each row of either table counts for itself, also if its id is repeated or null; a null doc_id comes last among equal scores.
    Null and empty texts have no terms and rank nowhere; items without terms have no rows. Empty tables give no rows. Long texts are read whole.
    """
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for items in groups_of(benchmark, group_terms):
        out = out.unionByName(_search_group(docs, items, k, block_postings, block_docs))
    return out
