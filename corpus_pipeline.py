"""A training corpus from raw documents, in stages that each call an operator of lineweave.llm.

Language identification drops documents without letters or of no clear language, the quality classifier drops bad
ones, SimHash leaves one document of each group of near copies, decontamination drops documents with benchmark
windows, and packing turns the rest into windows of token ids. Each stage is written and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lineweave.llm import decontamination, languages, packing, quality, simhash
from lineweave.llm.common import read, shared_folder
from lineweave.llm.queries import RANKS, TOKENIZER


# Each stage takes rows with the columns of documents, in any order and beside others of any name, and tells each row by
# its own text: null and repeated ids, null, empty and very long texts, repeated rows and empty tables are as the
# docstrings of the operators say.


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null and empty texts, texts without letters and those of no clear language; see languages.keep_known()."""
    return languages.keep_known(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier scores under a half; see quality.keep_good()."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the row with the smallest id of each group of near copies; see simhash.keep_one()."""
    return simhash.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows with a benchmark window; see decontamination.without_leaks()."""
    return decontamination.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of token ids, a row for each piece; see packing.pack()."""
    return packing.pack(docs, TOKENIZER, RANKS)


STAGES = [("language_id", language), ("quality", good), ("near_dedup", single), ("decontamination", clean), ("packing", packed)]

#: SQL can state none of the classifiers, so the whole is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each is written beside the checkpoints, in a folder that all executors share."""
    docs, base = read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
