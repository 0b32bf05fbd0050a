"""Exact top-k inner-product search by vector-approximation files, in blocks.

Components are turned to integers. Every block of rows holds its vectors twice: as cells (each component without its
low bits, in a byte where they fit) and exactly. For each query the cells are scanned for bounds of the inner product;
exact vectors are read from the best bound down until the k-th exact score cannot be beaten by a bound. Every block of
queries first meets one block of rows; the k-th score found there is a bound that holds everywhere and goes along with
the queries. Then it meets the other blocks in a grid joined on its coordinates, where only what reaches that bound is
read exactly and given back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm.common import cut, pick

K, SCALE, EVERY = 20, 64, 20
CELL_BITS = 3
BLOCK_ROWS, QUERY_ROWS, TILE = 16_384, 4096, 64
FIRST = 4  # times k: exact vectors read at once
NONE = -(2**63)  # the bound of a query that has found fewer than k rows


def integers(vectors: pa.Array, scale: int) -> list[np.ndarray | None]:
    """floor(scale * x) of each vector, as longs; None for null vectors and for null or non-finite components.

    Components beyond the range of longs take the nearest long.
    """
    out: list[np.ndarray | None] = []
    for v in vectors:
        x = None if not v.is_valid or v.values.null_count else np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
        if x is None or not np.isfinite(x).all():
            out.append(None)
        else:
            out.append(np.clip(np.floor(x * scale), -(2.0**62), 2.0**62).astype(np.int64))
    return out


def usable(vector: Column) -> Column:
    """Vectors that take part: neither null nor with a null or non-finite component."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def narrow(values: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    for kind in (np.int8, np.int16):
        if not values.size or np.iinfo(kind).min <= values.min() and values.max() <= np.iinfo(kind).max:
            return values.astype(kind)
    return values.astype(np.int64)


def search(q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, ids: np.ndarray, cells: np.ndarray, x: np.ndarray, k: int, bits: int = CELL_BITS) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """For each query its best k among these rows, of those that score its floor or more: (query id, [(score, vec_id)]).

    cells: x without its low bits. Integers of any size.
    """
    most = (max(abs(int(cells.min(initial=0))), abs(int(cells.max(initial=0)))) + 1) << bits
    size = float(max(1, q.shape[1]) * (int(np.abs(q).max(initial=0)) + 1) * most)
    if size >= 2**53:  # beyond exact doubles: Python's integers, saturated to longs
        wide = x.astype(object)
        for own, v, floor in zip(q_ids.tolist(), q, floors.tolist(), strict=True):
            scores = np.array([min(2**63 - 1, max(-(2**63), int(s))) for s in wide @ v.astype(object)], np.int64)
            keep = (ids != own) & (scores >= floor)
            order = sorted(zip(scores[keep].tolist(), ids[keep].tolist(), strict=True), key=lambda t: (-t[0], t[1]))
            yield own, order[:k]
        return
    kind = np.float32 if size < 2**24 else np.float64
    cells_t = np.ascontiguousarray(cells.T).astype(kind)  # a component lies in [cell << bits, (cell << bits) + 2^bits - 1]
    for at in range(0, len(q), TILE):
        part = q[at : at + TILE]
        low = (part << bits).astype(kind) @ cells_t
        gap = ((1 << bits) - 1) * np.maximum(part, 0).sum(axis=1)  # a score is at most low + gap
        for own, v, floor, bound, up in zip(q_ids[at : at + TILE].tolist(), part, floors[at : at + TILE].tolist(), low, gap, strict=True):
            yield own, _refine(own, v, floor, bound, float(up), ids, x, k)


def _refine(own: int, v: np.ndarray, floor: int, bound: np.ndarray, up: float, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int]]:
    near = np.flatnonzero(bound + up >= floor)  # the others can't reach the floor
    if not len(near):
        return []
    bound, n, best = bound[near], len(near), []
    take, done = min(n, FIRST * (k + 1)), np.zeros(n, bool)
    while True:
        if take < n:
            chosen = np.argpartition(-bound, take - 1)[:take]
            worst = bound[chosen].min()
            chosen = np.flatnonzero(bound >= worst)  # with ties at the border
        else:
            chosen, worst = np.arange(n), -np.inf
        new = chosen[~done[chosen]]
        done[new] = True
        new = near[new]
        new = new[ids[new] != own]
        scores = x[new].astype(np.int64) @ v
        new, scores = new[scores >= floor], scores[scores >= floor]
        order = np.lexsort((ids[new], -scores))[:k]
        best = sorted(best + list(zip(scores[order].tolist(), ids[new][order].tolist(), strict=True)), key=lambda t: (-t[0], t[1]))[:k]
        # a row not read yet has a bound under worst, so a score under worst + up
        if done.all() or len(best) == k and worst + up <= best[-1][0]:
            return best
        take = min(n, take * 4 if len(best) < k else max(take * 2, int((bound + up >= best[-1][0]).sum())))


def blocks(rows: DataFrame, most: int, scale: int, bits: int = CELL_BITS) -> DataFrame:
    """dim, n, ids, cells, cell_bytes, vectors, vector_bytes: rows packed by task and dimension, at most ``most`` in a block;
    unusable vectors are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            some = held.pop(dim)
            ids = np.array([i for i, _ in some], np.int64)
            vectors = np.array([v for _, v in some], np.int64).reshape(len(some), dim)
            cells, exact = narrow(vectors >> bits), narrow(vectors)
            row = {"dim": dim, "n": len(some), "ids": ids.tobytes(), "cells": cells.tobytes(), "cell_bytes": cells.itemsize, "vectors": exact.tobytes(), "vector_bytes": exact.itemsize}
            return pa.RecordBatch.from_pylist([row], BLOCK)

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), integers(batch.column(1), scale), strict=True):
                if v is not None and i is not None:
                    held.setdefault(len(v), []).append((i, v))
                    if len(held[len(v)]) == most:
                        yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(pack, "dim int, n int, ids binary, cells binary, cell_bytes int, vectors binary, vector_bytes int")


BLOCK = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("cells", pa.binary()), ("cell_bytes", pa.int32()), ("vectors", pa.binary()), ("vector_bytes", pa.int32())])


def met(batch: pa.RecordBatch, k: int) -> Iterator[tuple[dict, list[tuple[int, list[tuple[int, int]]]]]]:
    """For each row of a batch, a block of queries beside a block of rows, what search() finds."""

    def read(data: bytes, size: int, n: int, dim: int) -> np.ndarray:
        return np.frombuffer(data, np.dtype(f"i{size}")).reshape(n, dim)

    for r in batch.to_pylist():
        q_ids, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
        floors = np.frombuffer(r["floors"], np.int64) if r.get("floors") else np.full(len(q_ids), NONE, np.int64)
        q = read(r["q_vectors"], r["q_bytes"], len(q_ids), r["dim"]).astype(np.int64)
        cells, x = read(r["cells"], r["cell_bytes"], len(ids), r["dim"]), read(r["vectors"], r["vector_bytes"], len(ids), r["dim"])
        yield r, list(search(q_ids, q, floors, ids, cells, x, k))


def nearest(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows by integer inner product for each row whose vec_id is divisible by ``every``.

    Null vectors, null ids and vectors with null or non-finite components take no part, whatever else their id has.
    Vectors meet those of the same number of components only. All other rows but those with the query's own vec_id are
    candidates; rows that repeat a vec_id are so many candidates, and the id is a query once, with the smallest of its
    usable vectors (in order of components). Ties go to the smaller vec_id; with fewer rows than k all are returned.
    Scores beyond a long take the nearest long. An empty table gives no rows.
    """
    rows = pick(vectors, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    packed = cut(blocks(rows, BLOCK_ROWS, scale).withColumn("column", F.pmod(F.xxhash64("ids"), F.lit(1 << 20))))
    queries = blocks(asked, QUERY_ROWS, scale).select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("vector_bytes").alias("q_bytes"))
    queries = cut(queries.withColumn("row", F.pmod(F.xxhash64("q_ids"), F.lit(1 << 20))))
    # a first bound from the fullest block of each dimension
    fullest = packed.withColumn("_n", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("n"), "column"))).where("_n = 1").drop("_n", "column", "n")

    def first_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, found in met(batch, k):
                floors = np.array([best[-1][0] if len(best) == k else NONE for _, best in found], np.int64)
                out = {"dim": r["dim"], "row": r["row"], "q_bytes": r["q_bytes"], "q_ids": r["q_ids"], "q_vectors": r["q_vectors"], "floors": floors.tobytes()}
                yield pa.RecordBatch.from_pylist([out], pa.schema([("dim", pa.int32()), ("row", pa.int64()), ("q_bytes", pa.int32()), ("q_ids", pa.binary()), ("q_vectors", pa.binary()), ("floors", pa.binary())]))

    queries = cut(queries.join(fullest, "dim").mapInArrow(first_bounds, "dim int, row long, q_bytes int, q_ids binary, q_vectors binary, floors binary"))
    # the grid: each block of queries goes to each column, each block of rows to each row
    columns = packed.select("dim", "column").distinct()
    lines = queries.select("dim", "row").distinct()
    grid = queries.join(columns, "dim").join(packed.join(lines, "dim"), ["dim", "column", "row"]).drop("column", "row", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found in met(batch, k):
                cols: list[list[int]] = [[], [], []]
                for own, best in found:
                    cols[0] += [own] * len(best)
                    cols[1] += [i for _, i in best]
                    cols[2] += [s for s, _ in best]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    found = grid.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
