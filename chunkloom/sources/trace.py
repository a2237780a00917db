"""Native text traces: a stream of chunks without their bytes.

``file start <bytes of the name>``, the name, ``<40 hex digits> <size>`` lines, ``file end``, and ``stream end`` without a line break after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def trace_lines(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(bv, file_no, part, chunk_no, line): the lines of each version's trace; order by all but the line. Files without chunks are there too."""
    head = files.select("bv", "file_no", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("chunk_no"), F.concat(F.lit("file start "), F.octet_length(F.encode("filename", "UTF-8"))).alias("line"))
    name = files.select("bv", "file_no", F.lit(1).alias("part"), F.lit(0).cast("bigint").alias("chunk_no"), F.col("filename").alias("line"))
    body = chunks.select("bv", "file_no", F.lit(2).alias("part"), "chunk_no", F.concat_ws(" ", F.hex("fp"), "size").alias("line"))
    end = files.select("bv", "file_no", F.lit(3).alias("part"), F.lit(0).cast("bigint").alias("chunk_no"), F.lit("file end").alias("line"))
    last = files.select("bv").distinct().select("bv", F.lit((1 << 62)).alias("file_no"), F.lit(4).alias("part"), F.lit(0).cast("bigint").alias("chunk_no"), F.lit("stream end").alias("line"))
    return head.unionByName(name).unionByName(body).unionByName(end).unionByName(last)


def write_trace(lines: DataFrame, bv: int, path: str) -> None:
    """One version's trace as a single text file in the folder ``path``; the file's order is its meaning, so one task writes it."""
    lines.where(F.col("bv") == bv).orderBy("file_no", "part", "chunk_no").select("line").coalesce(1).write.mode("overwrite").text(path, lineSep="\n")


def read_trace(spark: SparkSession, path: str, bv: int) -> DataFrame:
    """(bv, file_no, chunk_no, filename, fp, size) of one trace; hex digits in either case.

    Lines are numbered within the splits in which the file is read; what a split takes over from those before it (the line before, files begun, the last name) comes from a row a split.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    order = Window.partitionBy("split").orderBy("at")
    starts = F.col("line").rlike("^file start [0-9]+$")
    # a name follows its start line and may look like anything else
    kinds = raw.withColumn("is_start", starts).withColumn("after", F.lag("is_start").over(order))
    edge = Window.orderBy("split")  # a row a split
    ends = kinds.groupBy("split").agg(F.max_by("is_start", "at").alias("ends"))
    before = ends.select(F.col("split").alias("__split"), F.coalesce(F.lag("ends").over(edge), F.lit(False)).alias("__after"))
    named = kinds.join(F.broadcast(before), F.col("split") == F.col("__split")).withColumn("is_name", F.coalesce("after", "__after")).select("split", "at", "line", "is_start", "is_name")
    begun = (F.col("is_start") & ~F.col("is_name")).cast("bigint")
    name = F.when(F.col("is_name"), F.col("line"))
    parts = named.groupBy("split").agg(F.sum(begun).alias("begun"), F.max_by(name, F.when(F.col("is_name"), F.col("at"))).alias("name"))
    earlier = edge.rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(F.col("split").alias("__split"), F.coalesce(F.sum("begun").over(earlier), F.lit(0)).alias("__begun"), F.last("name", ignorenulls=True).over(earlier).alias("__name"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = named.withColumn("begun", F.sum(begun).over(upto)).withColumn("name", F.last(name, ignorenulls=True).over(upto)).join(F.broadcast(carried), F.col("split") == F.col("__split"))
    body = numbered.where(~F.col("is_name") & F.col("line").rlike("^[0-9A-Fa-f]{40} [0-9]+$")).withColumn("file_no", F.col("begun") + F.col("__begun") - 1).withColumn("filename", F.coalesce("name", "__name"))
    words = F.split("line", " ")
    place = Window.partitionBy("file_no").orderBy("split", "at")
    return body.select(F.lit(bv).alias("bv"), "file_no", (F.row_number().over(place) - 1).cast("bigint").alias("chunk_no"), "filename", F.unhex(words[0]).alias("fp"), words[1].cast("int").alias("size"))
