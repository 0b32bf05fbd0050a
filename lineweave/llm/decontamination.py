"""Benchmark decontamination by a broadcast hash set of normalised n-grams, in DataFrame functions only.

Benchmark items become windows of ten words (shorter items one window). Their hashes form a set that goes to every
executor as part of the plan, its size checked first. Each document's word array is scanned position by position;
positions whose window hash is in the set are candidates, and a join on the windows' words verifies them. A set too
large for the plan is probed by a join on the hashes alone; only windows that it knows come back with their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import ascii_lower, cut, keyed, pick

WINDOW = 10
#: Up to so many distinct windows the hash set is part of the plan (8 bytes each). Beyond, the documents' window hashes are
#: joined to it, by a broadcast up to the second number and by a shuffle of hashes from there on.
SET_WINDOWS, BROADCAST_WINDOWS = 200_000, 4_000_000
#: without_leaks() broadcasts the keys to drop up to this many (16 bytes each), beyond that it joins by a shuffle.
BROADCAST_IDS = 1_000_000
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the whole text, A-Z lower-cased; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """gram, size, hash, items: distinct windows of all items, with the ids of the items that hold them."""
    words, size = F.col("words"), F.least(F.size("words"), F.lit(window))
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1))
    rows = pick(benchmark, "item_id", "text").select("item_id", words_of(F.col("text")).alias("words"))
    rows = rows.where(F.size("words") > 0).withColumn("size", size).withColumn("at", starts)
    rows = rows.withColumn("part", F.slice(words, F.col("at"), F.col("size")))
    rows = rows.select("item_id", F.array_join("part", " ").alias("gram"), "size", F.xxhash64("part").alias("hash"))
    return rows.groupBy("gram", "size", "hash").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))


def _wide(size: int, keep: str = "true") -> str:
    """SQL for the windows of this size in the array ``words`` whose start i passes: array<struct<start, size, gram>>."""
    starts = f"if(size(words) < {size}, cast(array() as array<int>), sequence(1, size(words) - {size - 1}))"
    return f"transform(filter({starts}, i -> {keep}), i -> named_struct('start', i, 'size', {size}, 'gram', array_join(slice(words, i, {size}), ' ')))"


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, set_windows: int = SET_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, spans (start and size of each verified window, by start), item_ids (sorted as strings).

    Null and empty texts have no words; windows of items without an id are hits that name no item. Rows that repeat a
    doc_id stay rows of their own. Empty tables give no rows, or documents without hits. Long texts are read whole.
    """
    grams = cut(benchmark_windows(benchmark, window))
    many = grams.select("hash").distinct().count()
    if many > set_windows:
        return _hits_by_join(docs, grams, many)
    found = [F.expr("cast(array() as array<struct<start: int, size: int, gram: string>>)")]
    for r in grams.groupBy("size").agg(F.sort_array(F.collect_set("hash")).alias("hashes")).collect():  # window sizes at most
        found.append(F.expr(_wide(r["size"], f"xxhash64(slice(words, i, {r['size']})) in ({', '.join(f'{h}L' for h in r['hashes'])})")))
    rows = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    rows = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.concat(*found).alias("found"))
    opened = rows.select("row", "doc_id", "n_words", F.explode_outer("found").alias("w")).select("row", "doc_id", "n_words", F.struct("w.start", "w.size").alias("span"), "w.gram")
    known = grams.select(F.col("gram").alias("known"), "items")
    met = opened.join(F.broadcast(known), F.col("gram") == F.col("known"), "left")
    return met.groupBy("row", "doc_id", "n_words").agg(*_gathered()).drop("row")


def _gathered() -> tuple[Column, Column]:
    """Verified spans in order, and the items that they name; a window that a text repeats names its items once."""
    spans = F.sort_array(F.collect_list(F.when(F.col("known").isNotNull(), F.col("span")))).alias("spans")
    return spans, F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids")


def _hits_by_join(docs: DataFrame, grams: DataFrame, many: int) -> DataFrame:
    """hits() by a join on hashes: only 28 bytes of each window of a document may be shuffled, and none of its words."""
    rows = keyed(docs).select("key", "doc_id", words_of(F.col("text")).alias("words"))
    sizes = [r["size"] for r in grams.select("size").distinct().collect()]  # window sizes at most
    empty = "cast(array() as array<struct<start: int, size: int, hash: bigint>>)"
    probe = [F.expr(f"if(size(words) < {n}, {empty}, transform(sequence(1, size(words) - {n - 1}), i -> named_struct('start', i, 'size', {n}, 'hash', xxhash64(slice(words, i, {n})))))") for n in sizes]
    probes = rows.dropDuplicates(["key"]).select("key", F.explode(F.concat(*probe)).alias("w")).select("key", "w.*")
    known = grams.select("hash").distinct()
    spans = probes.join(F.broadcast(known) if many <= BROADCAST_WINDOWS else known, "hash", "left_semi").groupBy("key").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    met = rows.dropDuplicates(["key"]).join(spans, "key").select("key", F.expr("transform(spans, s -> named_struct('span', s, 'gram', array_join(slice(words, s.start, s.size), ' ')))").alias("found"))
    told = met.select("key", F.explode("found").alias("f")).select("key", "f.*").join(grams.select("gram", F.col("gram").alias("known"), "items"), "gram").groupBy("key").agg(*_gathered())
    all_ = rows.select("key", "doc_id", F.size("words").cast("long").alias("n_words")).join(told, "key", "left")
    none = F.expr("cast(array() as array<struct<start: int, size: int>>)")
    return all_.select("doc_id", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids"))


def covered(spans: str) -> Column:
    """The number of words under a sorted array of spans."""
    return F.expr(
        f"aggregate({spans}, named_struct('n', 0L, 'last', 0), (a, s) -> named_struct("
        "'n', a.n + greatest(0, s.start + s.size - 1 - greatest(a.last, s.start - 1)), 'last', greatest(a.last, s.start + s.size - 1)), a -> a.n)"
    )


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: see hits() for odd inputs."""
    return hits(docs, benchmark, window).select(
        "doc_id", "n_words", covered("spans").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def _keys_with_hits(rows: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """key, spans of the keyed() rows that hold a benchmark window; rows of one key are alike in doc_id and text."""
    found = hits(rows.select(F.col("key").alias("doc_id"), "text"), benchmark, window).where(F.size("spans") > 0)
    return cut(found.groupBy(F.col("doc_id").alias("key")).agg(F.first("spans").alias("spans")))


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a benchmark window; all columns stay, whatever their names.

    Each row is told by its own text, whatever its doc_id: rows with a null or a repeated id stay or go one by one. Null
    and empty texts stay. An empty benchmark drops nothing; an empty table gives no rows.
    """
    rows = keyed(docs)
    gone = _keys_with_hits(rows, benchmark, window).select("key")
    kept = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "key", "left_anti")
    return kept.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)])


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, words: the normalised words of each document that lie under no benchmark window, joined by spaces.

    One row for each row of docs, told by its own text: rows that repeat or lack a doc_id lose their own spans only. Null
    and empty texts give empty words. An empty table gives no rows.
    """
    rows = keyed(docs)
    found = _keys_with_hits(rows, benchmark, window)
    met = rows.select("key", "doc_id", "text").join(found, "key", "left").withColumn("words", words_of(F.col("text")))
    keep = F.expr("filter(transform(words, (w, i) -> if(exists(coalesce(spans, array()), s -> i + 1 between s.start and s.start + s.size - 1), null, w)), w -> w is not null)")
    return met.select("doc_id", F.array_join(keep, " ").alias("words"))
