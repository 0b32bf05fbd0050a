"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two fingerprints that differ in at most ``max_bits`` bits differ in at most as
many bytes, so they share at least ``8 - max_bits`` bytes at the same positions: the guaranteed number of matches.
The inverted index posts every distinct fingerprint under (positions, byte values). A posting list of a single
byte holds a 256th of all rows, so lists are kept for sets of up to three positions, chosen so that any two
fingerprints with the guaranteed number of matches meet in at least one list. Within a list the shared positional
bytes of each pair are tallied, pairs under the guaranteed number are dropped, the rest is verified on the bits.
Pairs never become rows: a list gives the edges of a spanning forest of its links, which is all that components
need. Lists longer than ``block_rows`` are cut into blocks, and each pair of blocks is a group of its own.

Four bits of 64 tell near equality. For a similarity of 0.8, which a 64-bit fingerprint can't hold apart from 0.7, the
corpus stage uses the same index over a wide fingerprint: 64 bytes from the distinct shingles, lists for triples of its
64 byte positions, the count filter, a check of all 512 bits. Two texts whose shingles are alike to 0.8 differ in
77 bits, give or take 8; no number of equal bytes is then certain, but fewer than WIDE_BYTES of 64 has a chance under
1 in 1000, and pairs meet in one of the lists with a chance that the README gives as measured. What passes is verified
on the shingles themselves before components are formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm.common import cut, keyed, pick, utf8

SHINGLE_WORDS = 4
MAX_BITS = 4
BLOCK_ROWS = 4096
#: Hot posting lists are broadcast up to this many (16 bytes each); more of them are joined by a shuffle.
BROADCAST_LISTS = 100_000
#: The wide fingerprint: 64-bit words, differing bits at most, equal bytes at least; a triple is a start and two steps.
WIDE_WORDS, WIDE_BITS, WIDE_BYTES = 8, 100, 6
WIDE_STEPS = ((1, 3), (4, 9), (6, 13))  # no two positions are together in two triples
#: So many lists are read first; of the others only those that hold rows which these leave apart.
WIDE_FIRST = 32
POSTS_A_TASK = 1 << 23
#: Texts are near copies if their distinct shingles have this Jaccard similarity.
ALIKE = 0.8
#: Shingles of texts that go on together.
HASHES_AT_ONCE = 1 << 18
#: Shingles of a block of a group whose members are compared, some 32 MB; two blocks are held at once.
HASHES_IN_BLOCK = 1 << 22
#: A key with more than this part of all rows, and 1024 rows at least, is spread over several groups of a join.
HOT_PART = 1 / 4096
#: keep_one() broadcasts the keys to drop up to this many (16 bytes each), beyond that it joins by a shuffle.
BROADCAST_IDS = 1_000_000


def simhash(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a whole text; 0 if it has no words.

    A-Z are lower-cased, words are runs without ASCII white space, shingles count as often as they occur; a text
    of fewer words is one shingle. A bit is set if it is set in over half of the shingles' XXH64 (seed 42).
    """
    words = utf8(text).lower().split()
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(shingle_words)), strict=False) if len(words) > shingle_words else [words]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), map(b" ".join, grams)), np.uint64)
    bits = np.packbits((2 * ones_by_bit(hashes[:, None]) > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def ones_by_bit(hashes: np.ndarray) -> np.ndarray:
    """How many rows have each bit set; a row is one or more 64-bit words, their low bits first."""
    ones = np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[at : at + (1 << 14)], "<u8").view(np.uint8)
        eight = np.unpackbits(part, axis=1, bitorder="little").view(np.uint64)  # eight counters of a byte each, good for 255 rows
        ones += np.add.reduceat(eight, np.arange(0, len(eight), 255), axis=0).view(np.uint8).sum(axis=0, dtype=np.int64)
    return ones


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long)."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        values = np.fromiter((simhash(x.as_py(), shingle_words) for x in texts), np.uint64, len(texts))
        return pa.array(values.view(np.int64))

    return pick(docs, "doc_id", "text").select("doc_id", of("text").alias("fp"))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def positions(matches: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any ``matches`` of the eight positions hold at least one of the sets.

    For four and more matches: triples by Turan's construction. The positions go to three rings of 3, 3 and 2; the
    triples are those inside a ring and those with two positions in a ring and one in the next.
    """
    if matches < 4:
        return list(combinations(range(8), matches))
    ring = [0, 0, 0, 1, 1, 1, 2, 2]

    def chosen(t: tuple[int, ...]) -> bool:
        in_ring = [sum(ring[i] == r for i in t) for r in range(3)]
        return 3 in in_ring or any(in_ring[r] == 2 and in_ring[(r + 1) % 3] == 1 for r in range(3))

    return [t for t in combinations(range(8), 3) if chosen(t)]


def posting_keys(fp: Column, matches: int) -> Column:
    """The keys of all lists in which a fingerprint stands."""
    byte = [F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    keys = []
    for k, places in enumerate(positions(matches)):
        key: Column = F.lit(k).cast("long")
        for i in places:
            key = F.shiftleft(key, 8).bitwiseOR(byte[i])
        keys.append(key)
    return F.array(*keys)


def _close(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Count filter, then verification."""
    differ = a ^ b
    shared = np.zeros(differ.shape, np.int8)
    for i in range(8):
        shared += (differ >> np.uint64(8 * i)) & np.uint64(255) == 0
    kept = shared >= 8 - max_bits
    kept[kept] = np.bitwise_count(differ[kept]) <= max_bits
    return kept


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among these fingerprints, breadth first."""
    left, edges = np.unique(fps), []
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            near = _close(frontier[0], left, max_bits)
            edges += [(int(frontier[0]), int(x)) for x in left[near]]
            frontier, left = np.concatenate([frontier[1:], left[near]]), left[~near]
    return edges


def links_in_lists(keys: np.ndarray, fps: np.ndarray, max_bits: int, short: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of the same key; keys are sorted. Short lists are compared by shifting, long ones by forest()."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = [], []
    size_of_row = np.repeat(sizes, sizes)
    small = size_of_row <= short
    k, f = keys[small], fps[small]
    for d in range(1, min(short, int(sizes.max(initial=0)))):
        at = np.flatnonzero(k[:-d] == k[d:])
        at = at[_close(f[at], f[at + d], max_bits)]
        a.append(f[at])
        b.append(f[at + d])
    for s, n in zip(starts[sizes > short], sizes[sizes > short], strict=True):
        if edges := forest(fps[s : s + n], max_bits):
            pairs = np.array(edges, np.uint64)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def spread_join(rows: DataFrame, side: DataFrame, on: str, n: str, salt: str, hot_rows: int) -> DataFrame:
    """rows.join(side, on), where side has each key once and in ``n`` how many rows have it. Keys with more than
    ``hot_rows`` are dealt to several groups by the hash of ``salt``; with HOT_PART they are 1 / HOT_PART at most."""
    parts = F.ceil(F.col(n) / hot_rows).cast("int")
    hot = side.where(F.col(n) > hot_rows).select(on, parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(salt), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    return dealt.join(side.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))), [on, "_part"]).drop("_part")


def hot_rows(n: int) -> int:
    return max(1024, int(n * HOT_PART))


def in_blocks(posts: DataFrame, hot: DataFrame, lists: int, block_rows: int) -> DataFrame:
    """posts (key, fp and what else) with i, j: lists in ``hot`` (key, blocks) are cut into blocks, each pair of them a group; others are one group."""
    if not lists:
        return posts.select("*", F.lit(0).alias("i"), F.lit(0).alias("j"))
    side = F.broadcast(hot) if lists <= BROADCAST_LISTS else hot
    own, other = F.col("own"), F.col("other")
    return (
        posts.join(side, "key", "left")
        .withColumn("own", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)).cast("int") - 1)))
        .select(*posts.columns, F.least(own, other).alias("i"), F.greatest(own, other).alias("j"))
    )


def links(fps: DataFrame, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Distinct fp -> a, b: links between different fingerprints whose closure is that of all links."""
    posts = fps.select(F.explode(posting_keys(F.col("fp"), 8 - max_bits)).alias("key"), "fp")
    hot = cut(posts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block_rows).select("key", F.ceil(F.col("n") / block_rows).alias("blocks")))
    dealt = in_blocks(posts, hot, hot.count(), block_rows)

    def find(keys: np.ndarray, _: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = links_in_lists(keys, fps.view(np.uint64), max_bits)
        return a.view(np.int64), b.view(np.int64)

    return _found(dealt, find, "long", lambda column: column.to_numpy())


def _found(dealt: DataFrame, find, kind: str, read) -> DataFrame:
    """a, b (of type ``kind``): find(groups, keys, fingerprints) over the groups (key, i, j), which may span batches."""

    types = {"long": pa.int64(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def out(k: np.ndarray, own: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, types[kind]) for x in find(k, own, f)], ["a", "b"])

        for batch in batches:
            keys, i, j = (batch.column(x).to_numpy() for x in (0, 2, 3))
            mixed, f = (keys * 1_000_003 + i) * 1_000_003 + j, read(batch.column(1))  # rows are in order of key, i, j; equal runs stay runs
            held = (mixed, keys, f) if rest is None else tuple(np.concatenate(x) for x in zip(rest, (mixed, keys, f), strict=True))
            k = held[0]
            if not len(k):
                continue
            last = np.flatnonzero(k != k[-1])
            end = last[-1] + 1 if len(last) else 0
            if end:
                yield out(*(x[:end] for x in held))
            rest = tuple(x[end:] for x in held)
        if rest is not None and len(rest[0]):
            yield out(*rest)

    grouped = dealt.select("key", "fp", "i", "j").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    pairs = grouped.mapInArrow(run, f"a {kind}, b {kind}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def wide_fingerprint(text: str | None, shingle_words: int) -> bytes:
    """The wide fingerprint of a whole text, over its distinct shingles; zeros if it has no words."""
    base = shingle_hashes(text, shingle_words)
    if not len(base):
        return bytes(8 * WIDE_WORDS)
    h = (base[:, None] + np.arange(WIDE_WORDS, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)  # mixed so that words are independent
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.packbits((2 * ones_by_bit(h ^ (h >> np.uint64(31))) > len(base)).astype(np.uint8), bitorder="little").tobytes()


@cache
def wide_triples() -> np.ndarray:
    n = 8 * WIDE_WORDS
    return np.array([[(i + step) % n for step in (0, *steps)] for steps in WIDE_STEPS for i in range(n)])


def _bytes_of(column: pa.Array) -> np.ndarray:
    """Fingerprints as rows of bytes."""
    n = 8 * WIDE_WORDS
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, n)


def _close_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count filter, then verification, of wide fingerprints in rows."""
    differ = a ^ b
    kept = (differ == 0).sum(axis=-1) >= WIDE_BYTES
    kept[kept] = np.bitwise_count(differ[kept].view(np.uint64)).sum(axis=-1) <= WIDE_BITS
    return kept


def first_here(a: np.ndarray, b: np.ndarray, key: int) -> np.ndarray:
    """Whether the list of ``key`` is the first of those that both rows of a pair of wide fingerprints stand in.

    Of a link that several lists show one tells. Closure holds: a forest that leaves a link to an earlier list leaves it to one
    where both ends stand, whose own forest joins them.
    """
    same, earlier = a == b, wide_triples()[: key >> 24]
    return ~(same[:, earlier[:, 0]] & same[:, earlier[:, 1]] & same[:, earlier[:, 2]]).any(axis=1)


def wide_forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among these wide fingerprints, breadth first, as row numbers."""
    left, edges = np.arange(len(fps)), []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = _close_bytes(fps[at][None, :], fps[left])
            edges += [(at, x) for x in left[near]]
            frontier += left[near].tolist()
            left = left[~near]
    return edges


def _wide_keys(column: Column, lists: range) -> Column:
    """The keys of those of these lists in which a wide fingerprint stands."""
    triples = wide_triples()[lists.start : lists.stop]

    @F.arrow_udf("array<long>")
    def keys_of(column: pa.Array) -> pa.Array:
        data, keys = _bytes_of(column), np.array(lists)[None, :]
        for place in range(3):
            keys = keys << 8 | data[:, triples[:, place]]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * len(triples)), pa.array(keys.ravel()))

    return keys_of(column)


def _each_list(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal keys."""
    ends = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) + 1
    return zip(np.append(0, ends[:-1]), ends, strict=True)


def wide_links(fps: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Distinct fp (wide fingerprints) -> a, b: links between different ones, closed under what the lists show; and node, root: the
    components of these links.

    Almost all lists hold one fingerprint and end with their count, which is summed before the shuffle. Lists of two give
    their pair at once; only fingerprints in longer lists are posted again, and these lists are read as in links().

    The first lists show most links of a large group. What they join has one label, and a later list whose rows all have one
    label joins nothing more: it ends with its count too. So closure holds, and a group isn't posted again for each of its lists.
    """
    triples = len(wide_triples())
    tasks = max(fps.sparkSession.sparkContext.defaultParallelism, -(-fps.count() * triples // POSTS_A_TASK))
    named = cut(fps.select("fp").repartition(tasks, "fp").select("fp", F.monotonically_increasing_id().alias("id")))
    early = _listed_links(named.withColumn("label", F.col("id")), range(WIDE_FIRST), block_rows)
    first = hung(early)
    low = first.groupBy("u").agg(F.min("v").alias("v"))
    low = low.join(low.select(F.col("u").alias("v"), F.col("v").alias("w")), "v", "left").select("u", F.coalesce("w", "v").alias("fp"))
    labels = low.join(named, "fp").select(F.col("u").alias("fp"), F.col("id").alias("label"))
    labelled = cut(named.join(labels, "fp", "left").select("fp", "id", F.coalesce("label", "id").alias("label")))
    later = _listed_links(labelled, range(WIDE_FIRST, triples), block_rows)
    return early.unionByName(later).distinct(), components(first.select(F.col("v").alias("a"), F.col("u").alias("b")).unionByName(later))


def _listed_links(named: DataFrame, lists: range, block_rows: int) -> DataFrame:
    """fp, id, label -> a, b: links in these lists, without lists whose rows all have one label."""
    posts = named.select("fp", "id", "label", F.explode(_wide_keys(F.col("fp"), lists)).alias("key"))
    bounds = [F.min("id").alias("a"), F.max("id").alias("b"), F.min("label").alias("low"), F.max("label").alias("high")]
    held = cut(posts.groupBy("key").agg(F.count("*").alias("n"), *bounds).where("low < high").select("key", "n", "a", "b"))
    side = lambda name: named.select(F.col("id").alias(name), F.col("fp").alias(f"fp_{name}"))
    pairs = held.where("n = 2").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")

    @F.arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(_close_bytes(_bytes_of(a), _bytes_of(b)))

    two = pairs.where(alike("fp_a", "fp_b")).select(F.least("fp_a", "fp_b").alias("a"), F.greatest("fp_a", "fp_b").alias("b"))
    more = held.where("n > 2").select("key", F.ceil(F.col("n") / block_rows).alias("blocks"))
    count, large = more.agg(F.count("*"), F.count_if(F.col("blocks") > 1)).first()
    listed = posts.select("key", "fp").join(F.broadcast(more.select("key")) if count <= BROADCAST_LISTS else more.select("key"), "key", "left_semi")
    dealt = in_blocks(listed, more.where("blocks > 1"), large, block_rows)

    def find(groups: np.ndarray, keys: np.ndarray, fps: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        edges = set()
        for s, e in _each_list(groups):
            if found := wide_forest(fps[s:e]):
                i, j = s + np.array(found).T
                told = first_here(fps[i], fps[j], int(keys[s]))
                edges.update((fps[x].tobytes(), fps[y].tobytes()) for x, y in zip(i[told], j[told], strict=True))
        return [a for a, _ in edges], [b for _, b in edges]

    return cut(two.unionByName(_found(dealt, find, "binary", _bytes_of)).distinct())


def shingle_hashes(text: str | None, shingle_words: int) -> np.ndarray:
    """Sorted distinct hashes of a whole text's shingles; a text of fewer words is one shingle, one without words has none."""
    words = utf8(text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = zip(*(words[i:] for i in range(shingle_words)), strict=False) if len(words) > shingle_words else [words]
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), map(b" ".join, grams)), np.uint64))


def listed_and_close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two wide fingerprints in rows stand in a list together and pass its check: a triple of positions is equal in both."""
    same = np.packbits(a == b, axis=-1, bitorder="little").view("<u8")[..., 0]
    turned = lambda step: same >> np.uint64(step) | same << np.uint64(64 - step)
    met = np.zeros(len(same), bool)
    for one, two in WIDE_STEPS:
        met |= same & turned(one) & turned(two) != 0
    met[met] = _close_bytes(np.broadcast_to(a, b.shape)[met], b[met])
    return met


def alike_forest(fps: np.ndarray, hashes: np.ndarray, ends: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Components of the pairs that a list holds, whose wide fingerprints are close and whose shingles are alike to ``least``: as row
    numbers, the first row of each and every other one. The shingles of row k, sorted, end in ``hashes`` before ends[k].

    A pair whose rows are joined by now isn't compared, one that fails takes no part in joining others.
    """
    starts, left, edges = np.append(0, ends[:-1]), np.arange(len(fps)), []
    sizes = ends - starts
    while len(left):
        first, left = left[0], left[1:]
        frontier = [first]
        while frontier and len(left):
            at = frontier.pop()
            near = np.flatnonzero(listed_and_close(fps[at][None, :], fps[left]))
            own = hashes[starts[at] : ends[at]]
            if not len(near) or not len(own):
                continue
            rows = left[near]
            theirs = np.concatenate([hashes[starts[x] : ends[x]] for x in rows])
            hits = np.append(0, np.cumsum(own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs))
            stops = np.cumsum(sizes[rows])
            common = hits[stops] - hits[stops - sizes[rows]]
            good = common >= least * (sizes[at] + sizes[rows] - common)
            edges += [(first, x) for x in rows[good]]
            frontier += rows[good].tolist()
            left = np.delete(left, near[good])
    return edges


def verified_components(fps: DataFrame, texts: DataFrame, shingle_words: int, least: float, block_rows: int) -> DataFrame:
    """node, root: components of links whose shingles were compared and are alike to ``least``.

    fps: distinct fp; texts: fp and the text of one row for each. What the lists show to be close is joined first; then the shingles of
    each such group come together, once for each block of it, and are compared there. Neither links that hold nor pairs that fail
    become rows beyond a spanning forest, so rows follow the members of a group and not its pairs.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets_of(rows: list[tuple[bytes, bytes, np.ndarray]]) -> pa.RecordBatch:
            keys, fps, own = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(fps, pa.binary()), pa.array(own, pa.list_(pa.int64()))], ["key", "fp", "shingles"])

        for batch in batches:
            rows, size = [], 0
            for key, fp, text in zip(*(batch.column(x) for x in ("root", "fp", "text")), strict=True):
                rows.append((key.as_py(), fp.as_py(), shingle_hashes(text.as_py(), shingle_words).view(np.int64)))
                size += len(rows[-1][2])
                if size >= HASHES_AT_ONCE:
                    yield sets_of(rows)
                    rows, size = [], 0
            if rows:
                yield sets_of(rows)

    def links_of(held: list[pa.RecordBatch]) -> list[tuple[bytes, bytes]]:
        group = pa.Table.from_batches(held).combine_chunks()
        sets = group.column("shingles").combine_chunks()
        rows = _bytes_of(group.column("fp"))
        ends = np.cumsum(np.diff(sets.offsets.to_numpy()), dtype=np.int64)
        found = alike_forest(rows, sets.flatten().to_numpy().view(np.uint64), ends, least)
        return [(rows[x].tobytes(), rows[y].tobytes()) for x, y in found]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The groups (key, i, j), which may span batches."""

        def out(edges: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[x] for e in edges], pa.binary()) for x in (0, 1)], ["a", "b"])

        held, at, edges = [], None, []
        for batch in batches:
            group = list(zip(*(batch.column(x).to_pylist() for x in ("key", "i", "j")), strict=True))
            start = 0
            for end in range(1, len(group) + 1):
                if end < len(group) and group[end] == group[start]:
                    continue
                if held and group[start] != at:
                    edges += links_of(held)
                    held = []
                at = group[start]
                held.append(batch.slice(start, end - start))
                start = end
            if edges:
                yield out(edges)
                edges = []
        if held:
            yield out(links_of(held))

    member = wide_links(fps, block_rows)[1].withColumnRenamed("node", "fp")
    sets = cut(texts.join(member, "fp").select("root", "fp", "text").mapInArrow(hashes, "key binary, fp binary, shingles array<long>"))
    most = F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum(F.size("shingles")) / HASHES_IN_BLOCK))
    hot = cut(sets.groupBy("key").agg(most.alias("blocks")).where("blocks > 1"))
    large = hot.count()
    dealt = in_blocks(sets, hot, large, block_rows)
    pairs = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp").mapInArrow(compared, "a binary, b binary")
    pairs = cut(pairs)
    if large:
        return components(pairs)
    # each group was compared whole, so its components are known
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(pairs.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def hung(edges: DataFrame) -> DataFrame:
    """a, b -> u, v (the smaller): edges between the same components, most of them to a smallest node.

    A node found in many lists has many smaller neighbours, mostly the same few for all of its group: these, not the node, are hung
    on the smallest.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    for _ in range(3):
        e = e.withColumn("low", F.min("v").over(Window.partitionBy("u")))  # one edge of a node leads to the smallest and stays, the others hang their ends on it
        e = e.select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v")).distinct()
    return cut(e)


def components(edges: DataFrame) -> DataFrame:
    """a, b -> node, root (the smallest node of its component), by alternating large and small stars until nothing changes."""

    def once(df: DataFrame, col: str, by: str) -> DataFrame:
        return df.groupBy(col).agg(F.min(by).alias("low"), F.count("*").alias("n"))

    def met(df: DataFrame, low: DataFrame, salt: str) -> DataFrame:
        """df beside what is known of its nodes; the center of a large component has many rows."""
        return spread_join(df, low, "u", "n", salt, hot_rows(before[0])).drop("n")

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = hung(edges)
    before = sign(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = once(both, "u", "v").select("u", F.least("u", "low").alias("low"), "n")
        large = met(both, low, "v").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = once(large, "u", "v")
        moved = met(large, low, "v").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        e = cut(moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct())
        after = sign(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id, copies.

    component_id is the smallest doc_id among the documents that links of at most ``max_bits`` differing bits reach;
    copies is the number of documents with the same fingerprint. Null and empty texts have fingerprint zero and are
    linked like any other. Rows with equal doc_id stay as many rows; a null doc_id never becomes a component_id
    unless its whole component has none. An empty table gives an empty result.
    """
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits must be 0 to 7: beyond that no positional byte need match")
    rows = cut(fingerprints(docs, shingle_words).withColumn("row", F.monotonically_increasing_id()))  # fixed by the checkpoint
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")))
    joined = components(links(fps.select("fp"), max_bits, block_rows))
    member = fps.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = member.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("members"))
    most = hot_rows(rows.count())
    classes = spread_join(member, roots, "root", "members", "fp", most).select("fp", "component_id", "copies")
    return spread_join(rows, classes, "fp", "copies", "row", most).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id", "copies")


def keep_one(docs: DataFrame, shingle_words: int = 5, block_rows: int = BLOCK_ROWS, least: float = ALIKE) -> DataFrame:
    """The documents without near copies: of each component of texts whose shingles are alike to ``least`` the row with the smallest doc_id stays.

    Wide fingerprints find the pairs; their shingles are then compared, so no two texts are linked that are less alike. Equal
    fingerprints count as equal texts.

    All columns stay as they are, whatever their names. Rows without an id come after those with one; of rows that share
    doc_id and text one stays, and of rows that share an id with different texts each is told by its own text. Null texts
    count as empty; texts without words are copies of each other, and a text of fewer words than a shingle is one
    shingle. Long texts are read whole. An empty table gives no rows.
    """
    flat = keyed(docs)

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([wide_fingerprint(x.as_py(), shingle_words) for x in texts], pa.binary())

    rows = cut(flat.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key").alias("who"), of("text").alias("fp"), F.monotonically_increasing_id().alias("row")))
    most = hot_rows(rows.count())
    fps = cut(rows.groupBy("fp").agg(F.min("who").alias("low"), F.count("*").alias("copies")))
    of_low = fps.select("fp", F.col("low.key").alias("key"))  # one row speaks for all of its fingerprint
    texts = flat.select("key", "text").join(of_low, "key").dropDuplicates(["fp"]).select("fp", "text")
    joined = verified_components(fps.select("fp"), texts, shingle_words, least, block_rows)
    member = fps.join(joined.withColumnRenamed("node", "fp"), "fp", "left").where("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "fp"))
    best = member.groupBy("root").agg(F.min("low")["key"].alias("best"), F.count("*").alias("members"))
    told = spread_join(member, best, "root", "members", "fp", most).select("fp", "best", "copies")
    near = spread_join(rows, told, "fp", "copies", "row", most).select("who.key", (F.col("who.key") == F.col("best")).alias("stays"))
    near = cut(near.groupBy("key", "stays").agg(F.count("*").alias("n")).where("not stays or n > 1"))
    sizes = {r["stays"]: r["c"] for r in near.groupBy("stays").agg(F.count("*").alias("c")).collect()}

    def those(stays: bool) -> DataFrame:
        keys = near.where(F.col("stays") == stays).select("key")
        return F.broadcast(keys) if sizes.get(stays, 0) <= BROADCAST_IDS else keys

    columns = [f"c{i}" for i in range(len(docs.columns))]
    kept = flat.join(those(False), "key", "left_anti")
    if sizes.get(True):
        again = kept.join(those(True), "key").groupBy("key").agg(F.first(F.struct(*columns)).alias("row")).select("row.*")
        kept = kept.join(those(True), "key", "left_anti").select(*columns).unionByName(again)
    return kept.select(*[F.col(c).alias(n) for c, n in zip(columns, docs.columns, strict=True)])
