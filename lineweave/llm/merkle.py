"""A Merkle manifest of a table: leaves per language, runs of eight, subroots, one root; proofs by a recursive query.

Leaves get their places from a range partitioning by language and id, so no language meets in one task. Levels
are built from below, eight nodes to one, and stored as rows that name their parent. A recursive query of Spark then
climbs: a step joins what has come up to a node's parent, appends the siblings and folds them with the digest carried. The
leaves of a run share everything above it, so the eight digests of a run climb in one row, with one text of siblings.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm.common import ascii_lower, crc_of_id, cut, pick

RUN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Ids that this divides are tampered with.
TAMPERED = 3
#: The offsets of partitions are broadcast up to so many rows (a partition and a language each), and joined beyond.
BROADCAST_ROWS = 200_000
#: The tree above the languages' subroots.
TOP = -1


def digest(*parts: Column) -> Column:
    """H: lower-case hex SHA-256 of the parts' concatenation."""
    return F.sha2(F.concat(*parts), 256)


def leaf(**changed: Column) -> Column:
    """H of the fields, each ``-`` or its length in bytes, a colon and its text."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts += [F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))]
    return digest(*parts)


def placed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``pos``, the place of each row in its group from 0, by ``order`` with nulls first; the result is cut from its lineage.

    Rows are partitioned by range, sorted where they lie, and numbered from the rows of their group in the partitions before.
    """
    dealt = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))  # equal rows can be parted too
    keys = [*group, *order, "_salt"]
    dealt = cut(dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = dealt.groupBy(*group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = "coalesce(sum(_n) over (partition by {} order by _part rows between unbounded preceding and 1 preceding), 0)".format(", ".join(group) or "1")
    offsets = cut(counts.withColumn("_shift", F.expr(earlier) - F.col("_first")).drop("_first", "_n"))
    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST_ROWS else offsets
    met = offsets.toDF(*[f"_o{k}" for k in range(len(group))], "_part", "_shift")
    same = [F.col(g).eqNullSafe(F.col(f"_o{k}")) for k, g in enumerate(group)]
    return dealt.join(met, reduce(lambda a, b: a & b, same, part == F.col("_part"))).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"))


def parents(nodes: DataFrame) -> DataFrame:
    """tree, pos, children (digests in order), hash: the nodes above these (tree, pos, hash), eight to one."""
    up = F.expr(f"pos div {RUN}")
    runs = nodes.groupBy("tree", up.alias("pos")).agg(F.sort_array(F.collect_list(F.struct(F.col("pos").alias("at"), "hash"))).alias("run"))  # at most eight
    return runs.select("tree", "pos", F.col("run.hash").alias("children")).withColumn("hash", F.sha2(F.array_join("children", ""), 256))


def levels(nodes: DataFrame, sizes: DataFrame) -> Iterator[DataFrame]:
    """tree, level, pos, children, hash: the levels above ``nodes``, from below, until each tree has one node.

    sizes: tree and n, its number of nodes; a tree of one node gets no level.
    """
    many = sizes.where("n > 1")
    nodes, most, level = nodes.join(many.select("tree"), "tree", "left_semi"), sizes.agg(F.max("n")).first()[0] or 0, 0
    while most > 1:
        level, most = level + 1, -(-most // RUN)
        built = cut(parents(nodes).select("tree", F.lit(level).alias("level"), "pos", "children", "hash"))
        yield built
        # A tree goes on while the level has more than one of its nodes.
        sizes = sizes.withColumn("n", F.expr(f"(n + {RUN - 1}) div {RUN}"))
        nodes = built.join(sizes.where("n > 1").select("tree"), "tree", "left_semi")


def _height(n: str = "n") -> Column:
    """The levels above n nodes, one for each eighth part of them: whole numbers, as logarithms may round."""
    steps = ", ".join(str(RUN**k) + "L" for k in range(21))
    return F.expr(f"size(filter(array({steps}), x -> x < {n}))")


@contextmanager
def _unbounded_recursion(spark: SparkSession):
    """A recursive query may give as many rows as there are runs and levels; Spark's default stops at a million."""
    names = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": "100"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


CLIMB = """
with recursive climb(tree, run, folded, proof, up_tree, up_level, up_pos, at) as (
    select tree, run, folded, proof, up_tree, up_level, up_pos, at from {start}
    union all
    select c.tree, c.run,
        transform(c.folded, f -> sha2(array_join(transform(n.children, (h, i) -> if(i = c.at, f, h)), ''), 256)),
        concat(c.proof, array_join(filter(n.children, (h, i) -> i <> c.at), '')),
        n.up_tree, n.up_level, n.up_pos, n.at
    from climb c join {nodes} n on n.tree = c.up_tree and n.level = c.up_level and n.pos = c.up_pos
)
select tree, run, folded, proof from climb where up_tree is null
"""


def manifest(docs: DataFrame) -> tuple[DataFrame, DataFrame, str | None]:
    """Builds the tree: leaves (tree, lang, doc_id, leaf, given, pos), nodes (tree, level, pos, children, hash, and the
    parent's up_tree, up_level and up_pos), and the root; no rows have none.

    ``given`` is the leaf of the tampered row, where it was tampered with. The tree TOP is over the subroots, each other one
    over a language, numbered in order. Nulls and texts of any length are hashed as FIELDS says; rows with a null id come first and are
    never tampered with; equal ids go by their leaves. Null languages are a language.
    """
    rows = pick(docs, *FIELDS)
    # Equality of strings is bytewise in hashing and sorting, so languages that differ in a byte are two.
    tamper = F.col("doc_id").isNotNull() & (crc_of_id(F.col("doc_id")) % TAMPERED == 0)
    given = F.when(tamper, leaf(text=ascii_lower(F.col("text"))))
    leaves = placed(rows.select("lang", "doc_id", leaf().alias("leaf"), given.alias("given")), ["lang"], ["doc_id", "leaf"])
    langs = cut(placed(leaves.groupBy("lang").agg(F.count("*").alias("n")), [], ["lang"]).withColumnRenamed("pos", "tree"))
    few = F.broadcast(langs) if langs.count() <= BROADCAST_ROWS else langs
    named = few.select("tree", F.col("lang").alias("_lang"))
    leaves = leaves.join(named, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
    sizes = few.select("tree", "n")
    below = reduce(DataFrame.unionByName, levels(leaves.select("tree", "pos", F.col("leaf").alias("hash")), sizes), _no_nodes(docs.sparkSession))
    lone = leaves.join(few.where("n = 1").select("tree"), "tree", "left_semi").select("tree", F.col("leaf").alias("hash"))
    height = few.select(F.col("tree").alias("_tree"), _height().alias("_top"))
    tops = below.join(height, (F.col("tree") == F.col("_tree")) & (F.col("level") == F.col("_top"))).select("tree", "hash")
    subroots = cut(tops.unionByName(lone))
    n = subroots.count()
    high = reduce(DataFrame.unionByName, levels(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), "hash"), docs.sparkSession.createDataFrame([(TOP, n)], "tree long, n long")), _no_nodes(docs.sparkSession))
    root = (high.orderBy(F.col("level").desc()).select("hash") if n > 1 else subroots.select("hash")).first()
    # Parents: within the tree, or from a subroot's place into TOP; the root has none.
    nodes = below.unionByName(high).join(height.unionByName(docs.sparkSession.createDataFrame([(TOP, 0)], "_tree long, _top int")), F.col("tree") == F.col("_tree"))
    highest = high.agg(F.max("level")).first()[0] or 0
    last = F.when(F.col("tree") == TOP, F.col("level") == highest).otherwise(F.lit(n == 1) & (F.col("level") == F.col("_top")))
    leaves_tree = (F.col("tree") != TOP) & (F.col("level") == F.col("_top"))
    nodes = nodes.select(
        "tree", "level", "pos", "children", "hash",
        F.when(~last, F.when(leaves_tree, F.lit(TOP).cast("long")).otherwise(F.col("tree"))).alias("up_tree"),
        F.when(~last, F.when(leaves_tree, F.lit(1)).otherwise(F.col("level") + 1)).alias("up_level"),
        F.when(~last, F.when(leaves_tree, F.col("tree")).otherwise(F.col("pos")).cast("long")).alias("_place"),
    ).withColumn("up_pos", F.expr(f"_place div {RUN}")).withColumn("at", F.expr(f"cast(_place % {RUN} as int)")).drop("_place")
    return leaves, cut(nodes), root[0] if root else None


def _no_nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "tree long, level int, pos long, children array<string>, hash string")


def audited(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per document, also for repeated rows.

    See manifest() for nulls and ties; a document alone in the table has no siblings, so its proof is H of nothing. An empty
    table gives no rows. Other columns, of any name, aren't read.
    """
    spark = docs.sparkSession
    leaves, nodes, root = manifest(docs)
    run = F.expr(f"pos div {RUN}")
    here = F.struct(F.col("pos").alias("at"), "doc_id", "leaf", F.coalesce("given", "leaf").alias("given"))
    runs = cut(leaves.groupBy("tree", run.alias("run")).agg(F.sort_array(F.collect_list(here)).alias("leaves")))  # at most eight
    # What a run brings to its first node: the node's digest anew for each leaf. A leaf that is alone in its language brings itself.
    first = nodes.where((F.col("level") == 1) & (F.col("tree") != TOP)).select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), "up_tree", "up_level", "up_pos", "at")
    folded = F.expr("transform(leaves, (x, k) -> sha2(array_join(transform(leaves, (y, j) -> if(j = k, x.given, y.leaf)), ''), 256))")
    met = runs.join(first, (F.col("tree") == F.col("_tree")) & (F.col("run") == F.col("_pos")), "left")
    alone, has_top = F.col("_tree").isNull(), not nodes.where(F.col("tree") == TOP).isEmpty()
    into_top = F.lit(has_top) & alone
    start = cut(met.select(
        "tree", "run", F.when(alone, F.expr("transform(leaves, x -> x.given)")).otherwise(folded).alias("folded"), F.lit("").alias("proof"),
        F.when(into_top, F.lit(TOP).cast("long")).otherwise(F.col("up_tree")).alias("up_tree"), F.when(into_top, F.lit(1)).otherwise(F.col("up_level")).alias("up_level"),
        F.when(into_top, F.expr(f"tree div {RUN}")).otherwise(F.col("up_pos")).alias("up_pos"), F.when(into_top, F.expr(f"cast(tree % {RUN} as int)")).otherwise(F.col("at")).alias("at"),
    ))
    with _unbounded_recursion(spark):
        come = cut(spark.sql(CLIMB, start=start, nodes=nodes.drop("hash")))
    tops = nodes.where((F.col("tree") != TOP) & (F.col("up_tree").isNull() | (F.col("up_tree") == TOP))).select("tree", F.col("hash").alias("_subroot"))
    subroot_of = tops if tops.count() > BROADCAST_ROWS else F.broadcast(tops)
    told = runs.join(come, ["tree", "run"]).join(subroot_of, "tree", "left").select("*", F.posexplode("leaves").alias("_k", "_leaf"))
    others = F.expr("array_join(transform(filter(leaves, (x, j) -> j <> _k), x -> x.leaf), '')")
    back = F.expr("folded[_k]")
    return told.select(
        "_leaf.doc_id", "_leaf.leaf", F.coalesce("_subroot", "_leaf.leaf").alias("subroot"), F.lit(root).cast("string").alias("root"),
        digest(others, F.col("proof")).alias("proof_sha256"), back.alias("folded_root"), (back == F.lit(root)).alias("verified"),
    )
