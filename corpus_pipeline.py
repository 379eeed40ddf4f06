"""A corpus pipeline of five stages, each an operator of ``tidemark.llm``.

Every stage takes the documents that its predecessor kept, in the columns of the documents table, and decides on all of
them: toxic documents go, then documents of low quality, then all but one of each group of near copies; what is left is
mixed to the sources' target weights (a document taken twice is two rows, one taken in part is shortened), and packed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, packing, quality, simhash, toxicity
from tidemark.llm.common import shared_dir, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.reject(docs, table(spark, sf_dir, "labels"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic),
    ("quality", good),
    ("near_dedup", deduplicated),
    ("mixing", mixed),
    ("packing", packed),
]

#: Hashing, models and tokenization are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; what a stage keeps is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{n}_{name}")
            docs = spark.read.parquet(f"{folder}/{n}_{name}")
    return docs
