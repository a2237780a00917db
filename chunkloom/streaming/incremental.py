"""Incremental forms: chunks arrive as a stream, versions as micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookup


def unique_chunks(stream: DataFrame) -> DataFrame:
    """Exact deduplication as streaming state: the first copy of each fingerprint passes. ``stream`` has fp; state grows with distinct fingerprints, as an exact index does."""
    return stream.dropDuplicates(["fp"])


def unique_within(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """The same with retention: fingerprints not seen for ``delay`` leave the state."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["fp"])


def running_totals(stream: DataFrame, time: str, window: str, delay: str) -> DataFrame:
    """Chunks and bytes of each event-time window."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "chunks", "bytes")


class IncrementalIndex:
    """Exact deduplication of versions that arrive one by one: the index is a Parquet table that each micro-batch anti-joins and appends to.

    A batch that is run again after a failure writes the same folder again, so every version counts once.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def known(self, before: int) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/index").where(F.col("batch") < before).select("fp")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return None

    def add(self, batch: DataFrame, number: int) -> None:
        """Stores a batch's new chunks (fp, bv, seq, size): the foreachBatch function."""
        first = lookup.first_occurrences(batch)
        known = self.known(number)
        new = first if known is None else first.join(known, "fp", "left_anti")
        new.drop("copies").write.mode("overwrite").parquet(f"{self.root}/index/batch={number}")

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Takes all that is there, and ends."""
        query = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

    def stored(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/index")
