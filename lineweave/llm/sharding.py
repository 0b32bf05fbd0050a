"""Shards by vector bin packing: bytes, tokens and rows are balanced jointly, under the law ``bytes``.

Documents of equal text form a group, and a group is the item to place. Only a group that is larger than a whole shard,
in bytes or in rows, is cut, into as few pieces as leave room beside each. Each item is a vector (bytes, tokens, rows)
and goes where the dot product with the residual capacity is highest, among the shards that still have room for its
bytes; both vectors are measured by what is still to be placed, so that late small items even out what the large ones
left. Items are dealt to bins of bounded size by hash, each bin has an equal share of what is free in every shard and is
packed in a task of its own, largest items first. Items that are large for such a share are few; they are placed before,
in fewer bins or a single one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm.common import cut, pick

SHARDS = 24
#: A group that holds more than a shard is cut into pieces of at most this part of it.
PIECE = 0.9
#: Items packed by one task, and rows numbered by one task.
ITEMS = 20_000
#: An item over this part of a bin's share of a shard is placed before the bins.
HEAVY = 1 / 4


def place(sizes: np.ndarray, shards: int, free: np.ndarray | None = None, start: int = 0) -> np.ndarray:
    """The shard of each item; sizes has a row (bytes, tokens, rows) for each item, largest first.

    free: a row for each shard, what of it is free; None if that is equal. Among equal shards ``start`` comes first.
    """
    capacity = np.maximum(sizes.sum(axis=0) / shards, 1e-9)
    share = sizes / capacity
    weights = 1 / np.maximum(np.cumsum(share[::-1], axis=0)[::-1], 1e-9) ** 2  # of what is still to be placed
    left = np.ones((shards, sizes.shape[1])) if free is None else np.roll(free / np.maximum(free.mean(axis=0), 1e-9), -start, axis=0)
    at = np.empty(len(sizes), np.int32)
    for k, item in enumerate(share):
        value = left @ (item * weights[k])
        room = left[:, 0] >= item[0]
        best = np.where(room, value, -np.inf).argmax() if room.any() else left[:, 0].argmax()
        left[best] -= item
        at[k] = best
    return (at + start) % shards


def shards(docs: DataFrame, n_shards: int = SHARDS, items: int = ITEMS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: every row in exactly one shard.

    size is the UTF-8 length of the text plus 8. Null texts count as empty ones (group, size and crc32). Equal texts
    share a shard unless they are more than a shard holds, by bytes or by rows. Repeated rows are placed as often as they occur. Slots count from 0
    without gaps in each shard. An empty table gives an empty result; with fewer items than shards some stay empty.
    """
    text = F.coalesce("text", F.lit(""))
    rows = cut(
        pick(docs, "doc_id", "text").select(
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
            F.unhex(F.md5(text.cast("binary"))).alias("group"),
            F.monotonically_increasing_id().alias("row"),  # fixed by the checkpoint; tells rows of equal or null ids apart
        )
    )
    total = rows.agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not total["n"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    most_bytes, most_rows = max(1.0, total["b"] / n_shards * PIECE), max(1.0, total["n"] / n_shards * PIECE)
    groups = rows.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    parts = F.least(F.col("n"), F.ceil(F.greatest(F.col("b") / most_bytes, F.col("n") / most_rows))).cast("int")
    beyond = (F.col("b") > most_bytes / PIECE) | (F.col("n") > most_rows / PIECE)
    large = groups.where((F.col("n") > 1) & beyond).select("group", parts.alias("parts"))  # 2 * shards at most
    pieces = rows.join(F.broadcast(large), "group", "left").withColumn("piece", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int")).drop("parts")
    units = cut(pieces.groupBy("group", "piece").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")))
    placed = placed_units(units, np.array([total["b"], total["t"], total["n"]], float), n_shards, items)
    rows = cut(pieces.join(placed, ["group", "piece"]).select("doc_id", "size", "text_crc32", "shard", "row"))
    return numbered(rows, total["n"], n_shards, items)


def placed_units(units: DataFrame, total: np.ndarray, n_shards: int, items: int) -> DataFrame:
    """group, piece, shard. units: group, piece, b, t, n; total: their sums."""

    def heavy(bins: int):
        return (F.col("b") > float(total[0] / n_shards / bins * HEAVY)) | (F.col("n") > float(total[2] / n_shards / bins * HEAVY))

    levels = [int(-(-total[2] // items))]  # bins of each level; what is heavy in one goes to the next
    while levels[-1] > 1 and (many := units.where(heavy(levels[-1])).count()):  # 2 * n_shards * bins / HEAVY at most
        levels.append(max(1, min(-(-many // items), levels[-1] // 2)))
    level = F.lit(0)
    for bins in levels[:-1]:
        level = level + heavy(bins).cast("int")

    def pack(free: np.ndarray | None):
        def run(batch: pd.DataFrame) -> pd.DataFrame:
            batch["share"] = (batch[["b", "t", "n"]] / np.maximum(total, 1)).sum(axis=1)
            batch = batch.sort_values(["share", "group", "piece"], ascending=[False, True, True], kind="stable")
            batch["shard"] = place(batch[["b", "t", "n"]].to_numpy(float), n_shards, free, int(batch["bin"].iloc[0]) % n_shards)
            return batch[["group", "piece", "shard", "b", "t", "n"]]

        return run

    out, free = None, None
    for k in reversed(range(len(levels))):
        dealt = units.where(level == k).withColumn("bin", F.pmod(F.xxhash64("group", "piece"), F.lit(levels[k])).cast("int"))
        placed = dealt.groupBy("bin").applyInPandas(pack(free), "group binary, piece int, shard int, b long, t long, n long")
        if k:
            placed = cut(placed)
            free = np.tile(total / n_shards, (n_shards, 1)) if free is None else free.copy()
            for r in placed.groupBy("shard").agg(F.sum("b"), F.sum("t"), F.sum("n")).collect():  # n_shards rows at most
                free[r[0]] -= [float(x) for x in r[1:]]
        out = placed if out is None else out.unionByName(placed)
    return out.select("group", "piece", "shard")


def numbered(rows: DataFrame, n: int, n_shards: int, most: int) -> DataFrame:
    """Slots from 0 in each shard: rows are numbered within strips of a shard, then strips are laid end to end."""
    strips = max(1, -(-n // (n_shards * most)))
    rows = rows.withColumn("strip", F.pmod(F.xxhash64("row"), F.lit(strips)).cast("int"))
    before = Window.partitionBy("shard").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "strip").agg(F.count("*").alias("n")).select("shard", "strip", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "strip").orderBy("doc_id", "text_crc32", "row"))
    return (
        rows.withColumn("within", within)
        .join(starts, ["shard", "strip"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
