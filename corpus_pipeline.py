"""The corpus pipeline: operators of chunkloom.llm one after another, each stage written as Parquet and read again.

Every stage but the last returns the columns of its input as they were, whatever they are called, and handles a table without rows. Null ids and texts, empty texts and repeated rows are
rows like any other; the stages say what becomes of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from chunkloom.llm import decontamination, mixing, quality_classifier, sharding, simhash
from chunkloom.llm.shared import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects. Null and empty texts are scored like any other; without labels of both classes, by that class's share."""
    return quality_classifier.filter_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, null ids last. Null, empty and wordless texts are near duplicates of one another; of equal rows one stays."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item. Null and empty texts hold none."""
    return decontamination.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, up to three times. A null source is a source; texts without words are taken as often as the whole part of their source's ratio says."""
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot, two columns more; columns of these names are replaced. Equal rows get slots of their own."""
    return sharding.shard_rows(docs)


STAGES = [("quality_classifier", quality), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: Fitted models and keyed random draws have no SQL equal; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; a stage's rows are written to the shared folder before the next one reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
