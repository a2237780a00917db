"""Fragmentation: which duplicates to write again. The relational parts; the folds live in ``plans.backup``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def container_use(recipe: DataFrame) -> DataFrame:
    """(bv, cid, size): bytes that each version refers to in each container, repeats included."""
    return recipe.groupBy("bv", "cid").agg(F.sum("size").cast("bigint").alias("size"))


def sparse_containers(use: DataFrame, capacity: int, threshold: float, limit: float) -> DataFrame:
    """(bv, cid, size): containers under the threshold, the emptiest first, as long as their bytes stay within ``limit`` of the version's; all of them from 1 on."""
    total = F.sum("size").over(Window.partitionBy("bv"))
    marked = use.withColumn("__total", total).where(F.col("size") / F.lit(float(capacity)) < threshold)
    if limit < 1:
        order = Window.partitionBy("bv").orderBy("size", "cid").rowsBetween(Window.unboundedPreceding, 0)
        marked = marked.withColumn("__sum", F.sum("size").over(order)).where(F.col("__sum") / F.col("__total") <= limit).drop("__sum")
    return marked.drop("__total")


def sparse_counts(use: DataFrame, capacity: int, threshold: float) -> DataFrame:
    """(bv, total_containers, sparse_containers, inherited_sparse), before the limit trims: inherited ones were sparse in the version before."""
    flagged = use.withColumn("sparse", F.col("size") / F.lit(float(capacity)) < threshold)
    before = flagged.where("sparse").select((F.col("bv") + 1).alias("__bv"), F.col("cid").alias("__cid"))
    joined = flagged.join(before, (F.col("bv") == F.col("__bv")) & (F.col("cid") == F.col("__cid")), "left")
    return joined.groupBy("bv").agg(F.count("*").alias("total_containers"), F.sum(F.col("sparse").cast("int")).alias("sparse_containers"), F.sum((F.col("sparse") & F.col("__cid").isNotNull()).cast("int")).alias("inherited_sparse"))


def mark_sparse(recipe: DataFrame, sparse: DataFrame) -> DataFrame:
    """Duplicates that lie in a container which the version before listed as sparse: adds is_sparse."""
    listed = sparse.select((F.col("bv") + 1).alias("__bv"), F.col("cid").alias("__cid")).withColumn("__hit", F.lit(True))
    return recipe.join(listed, (F.col("bv") == F.col("__bv")) & (F.col("cid") == F.col("__cid")), "left").withColumn("is_sparse", F.coalesce("__hit", F.lit(False)) & F.col("is_dup")).drop("__bv", "__cid", "__hit")


def capping(recipe: DataFrame, buffer: int, level: int) -> DataFrame:
    """Adds is_ooo: in each tumbling buffer the ``level`` containers with most bytes are kept (the smaller id of equals), other duplicates are out of order."""
    rows = recipe.withColumn("__buf", F.floor(F.col("seq") / F.lit(buffer)))
    per = rows.where("is_dup").groupBy("bv", "__buf", "cid").agg(F.sum("size").alias("__size"))
    kept = per.withColumn("__r", F.row_number().over(Window.partitionBy("bv", "__buf").orderBy(F.desc("__size"), "cid"))).where(F.col("__r") <= level)
    kept = kept.select(F.col("bv").alias("__bv"), F.col("__buf").alias("__b"), F.col("cid").alias("__cid"))
    joined = rows.join(kept, (F.col("bv") == F.col("__bv")) & (F.col("__buf") == F.col("__b")) & (F.col("cid") == F.col("__cid")), "left")
    return joined.withColumn("is_ooo", F.col("is_dup") & F.col("__cid").isNull()).drop("__bv", "__b", "__cid", "__buf")


def islands(recipe: DataFrame) -> DataFrame:
    """Adds ``island``: a run of duplicates of one container; new chunks (cid null here) in front join it, a new chunk, another container, file or segment after it ends it."""
    order = Window.partitionBy("bv").orderBy("seq")
    known = F.when(F.col("is_dup"), F.col("cid"))
    last, last_file, last_segment = F.lag(known).over(order), F.lag("file_no").over(order), F.lag("segment_no").over(order)
    closes = last.isNotNull() & (known.isNull() | (known != last) | (F.col("file_no") != last_file) | (F.col("segment_no") != last_segment))
    return recipe.withColumn("__new", closes.cast("bigint")).withColumn("island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def cfl_marks(recipe: DataFrame, capacity: int, threshold: float) -> DataFrame:
    """Adds is_ooo: duplicates of islands smaller than the usage threshold of a container (islands here are not cut at the buffer's end)."""
    sized = islands(recipe).withColumn("island_size", F.sum("size").over(Window.partitionBy("bv", "island")))
    return sized.withColumn("is_ooo", F.col("is_dup") & (F.col("island_size") < F.lit(threshold * capacity)))


def cbr_coverage(recipe: DataFrame, buffer: int) -> DataFrame:
    """Adds ``coverage``: bytes of the chunk's container within the look-ahead buffer that starts at the chunk."""
    ahead = Window.partitionBy("bv", "cid").orderBy("seq").rangeBetween(0, buffer - 1)
    return recipe.withColumn("coverage", F.sum("size").over(ahead).cast("bigint"))
