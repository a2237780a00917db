"""Reports of jobs and of the whole store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fingerprints import dedup_factor, dedup_ratio


def version_stats(per_version: DataFrame) -> DataFrame:
    """Ratios and average chunk size beside (bv, chunks, data_size, unique_chunks, stored_size)."""
    return per_version.withColumn("dedup_ratio", dedup_ratio(F.col("data_size"), F.col("stored_size"))).withColumn("dedup_factor", dedup_factor(F.col("data_size"), F.col("stored_size"))).withColumn("avg_chunk", F.when(F.col("chunks") > 0, F.floor(F.col("data_size") / F.col("chunks"))).cast("bigint"))


def global_stats(per_version: DataFrame) -> DataFrame:
    out = per_version.agg(F.count("*").alias("versions"), *[F.sum(c).cast("bigint").alias(c) for c in ("chunks", "data_size", "unique_chunks", "stored_size")])
    return out.withColumn("dedup_ratio", dedup_ratio(F.col("data_size"), F.col("stored_size"))).withColumn("dedup_factor", dedup_factor(F.col("data_size"), F.col("stored_size")))


def cumulative_capacity(per_version: DataFrame) -> DataFrame:
    """(bv, data_size, stored_size, total_data, total_stored): running totals over one row a version."""
    upto = Window.orderBy("bv").rowsBetween(Window.unboundedPreceding, 0)
    return per_version.select("bv", "data_size", "stored_size", F.sum("data_size").over(upto).cast("bigint").alias("total_data"), F.sum("stored_size").over(upto).cast("bigint").alias("total_stored"))


def duplicate_groups(first: DataFrame) -> DataFrame:
    """How many fingerprints occur how often."""
    return first.groupBy("copies").agg(F.count("*").alias("fingerprints"), F.sum(F.col("size") * F.col("copies")).cast("bigint").alias("bytes"))


def size_histogram(chunks: DataFrame) -> DataFrame:
    """Chunks by the power of two that their size holds."""
    return chunks.groupBy(F.floor(F.log2("size")).cast("int").alias("log2_size")).agg(F.count("*").alias("chunks"), F.sum("size").cast("bigint").alias("bytes"), F.min("size").alias("min_size"), F.max("size").alias("max_size"))


def zero_stats(zero: DataFrame) -> DataFrame:
    return zero.groupBy("bv").agg(F.count("*").alias("chunks"), F.sum(F.col("is_zero").cast("bigint")).alias("zero_chunks"), F.sum(F.when(F.col("is_zero"), F.col("size")).otherwise(0)).cast("bigint").alias("zero_size"))


def utility_histogram(covered: DataFrame, capacity: int, buckets: int = 10_000) -> DataFrame:
    """(bv, bucket, chunks, chunks_from): duplicates by rewrite utility, new chunks at 0, with the running count from the top: where a share of the chunks lies above.

    The running threshold of the rewriting fold, seen at the end of a version.
    """
    utility = F.when(F.col("is_dup"), F.greatest(F.lit(0.0), 1 - (F.col("coverage") + F.col("size")) / F.lit(float(capacity)))).otherwise(F.lit(0.0))
    per = covered.groupBy("bv", F.least(F.floor(utility * buckets), F.lit(buckets - 1)).cast("int").alias("bucket")).agg(F.count("*").alias("chunks"))
    down = Window.partitionBy("bv").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("chunks_from", F.sum("chunks").over(down))
