"""Segmenting: runs of a version's chunk stream that are looked up and updated together."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import tee

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DedupConfig
from ..functions.fingerprints import tail
from .ordered import ordered_fold


def fixed_segments(chunks: DataFrame, n: int) -> DataFrame:
    """n chunks each."""
    return chunks.withColumn("segment_no", F.floor(F.col("seq") / F.lit(n)).cast("bigint"))


def file_segments(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("segment_no", F.col("file_no").cast("bigint"))


def content_segments_simple(chunks: DataFrame, average: int) -> DataFrame:
    """Content-defined without bounds: a chunk whose fingerprint's tail is divisible by ``average`` opens a segment."""
    opens = (F.pmod(tail(F.col("fp")), F.lit(average)) == 0) & (F.col("seq") > 0)
    order = Window.partitionBy("bv").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("segment_no", F.sum(opens.cast("bigint")).over(order))


def segment_numbers(tails: Iterable[int], average: int, low: int, high: int) -> Iterator[int]:
    """Content-defined with bounds: below ``low`` chunks nothing closes; then a divisible tail closes before its chunk, and ``high`` chunks close after."""
    number, held = 0, 0
    for t in tails:
        if held >= max(high, 1) or held and held >= low and t % average == 0:
            number, held = number + 1, 0
        held += 1
        yield number


def content_segments(chunks: DataFrame, average: int, low: int, high: int) -> DataFrame:
    """A fold over each version's stream: boundaries depend on where the last one fell. Only (seq, tail) enter it."""
    marks = chunks.select(F.col("bv").cast("int").alias("bv"), F.col("seq").cast("bigint").alias("seq"), tail(F.col("fp")).alias("t"))

    def fold(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        mine, ahead = tee(rows)
        for (bv, seq, _), number in zip(mine, segment_numbers((r[2] for r in ahead), average, low, high), strict=True):
            yield bv, seq, number

    found = ordered_fold(marks, ["bv"], ["seq"], "__bv int, __seq bigint, segment_no bigint", fold)
    return chunks.join(found, (F.col("bv") == F.col("__bv")) & (F.col("seq") == F.col("__seq"))).drop("__bv", "__seq")


def segments(chunks: DataFrame, cfg: DedupConfig) -> DataFrame:
    cfg = cfg.resolved()
    if cfg.segment_algorithm == "fixed":
        return fixed_segments(chunks, cfg.segment_average)
    if cfg.segment_algorithm == "file-defined":
        return file_segments(chunks)
    return content_segments(chunks, cfg.segment_average, cfg.segment_min, cfg.segment_max)


def segment_stats(segmented: DataFrame) -> DataFrame:
    """Segments of a version, and chunks in each on average, at least and at most."""
    per = segmented.groupBy("bv", "segment_no").agg(F.count("*").alias("n"))
    return per.groupBy("bv").agg(F.count("*").alias("segments"), F.sum("n").alias("chunks"), F.avg("n").alias("avg_chunks"), F.min("n").alias("min_chunks"), F.max("n").alias("max_chunks"))
