"""What the corpus operators share: column picking, lower-casing, checkpoints, small loops."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, whatever other columns there are (also ones that differ in case only)."""
    at = {n: i for i, n in reversed(list(enumerate(df.columns)))}
    missing = [n for n in names if n not in at]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {df.columns}")
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"c{at[n]}").alias(n) for n in names])


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with their columns named c0, c1, ..., and doc_id, text and key: 128 bits of doc_id and text."""
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    named = [F.col(f"c{docs.columns.index(n)}").alias(n) for n in ("doc_id", "text")]
    of_id = F.coalesce(F.concat(F.lit("v"), F.col("doc_id").cast("string")), F.lit("n"))
    key = F.unhex(F.md5(F.concat(of_id, F.lit("\x1f"), F.coalesce("text", F.lit(""))).cast("binary")))
    return flat.select("*", *named).withColumn("key", key)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(text, UPPER, UPPER.lower())


def crc_of_id(column: Column) -> Column:
    """crc32 of the id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share. Only a local session may go without (tests);
    it then gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a checkpoint in shared_folder()."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet into shared_folder() and read again: smaller than a checkpoint, and readable by column."""
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


#: ASCII letters in lower case, every other ASCII byte a space, bytes of other letters as they are.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_bytes(text: str | None) -> list[bytes]:
    """Words as UTF-8: runs of letters, ASCII ones lower-cased; digits and ASCII signs part them."""
    return utf8(text).translate(WORD_BYTES).split()


def has_letter(words: list[bytes]) -> bool:
    """Whether any word of word_bytes() holds a letter: ASCII ones do, others are looked at."""
    return any(w[0] < 128 or any(c.isalpha() for c in w.decode("utf-8", "replace")) for w in words)
