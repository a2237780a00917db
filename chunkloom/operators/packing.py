"""Containers: next-fit packing of written chunks, version by version, and recipes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DedupConfig
from .ordered import ordered_fold


def next_fit(rows: Iterator[tuple], capacity: int, entries: int) -> Iterator[tuple]:
    """(container from 0, offset, row) of rows that end in their size: a new container when bytes or directory entries would not fit."""
    at, used, n = 0, 0, 0
    for r in rows:
        if n and (used + r[-1] > capacity or n + 1 > entries):
            at, used, n = at + 1, 0, 0
        yield at, used, r
        used += r[-1]
        n += 1


def pack_containers(stored: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(bv, seq, fp, size, cid, off) of stored chunks (bv, seq, fp, size): versions pack side by side, since each starts a container of its own; ids run on over versions.

    A fold over one version's (seq, size) in one task; the global ids come from one row a version.
    """
    capacity, entries = cfg.container_data, cfg.container_entries

    def fold(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        for at, off, r in next_fit(rows, capacity, entries):
            yield *r, at, off

    packed = ordered_fold(stored.select(F.col("bv").cast("int"), F.col("seq").cast("bigint"), "fp", F.col("size").cast("int")), ["bv"], ["seq"], "bv int, seq bigint, fp binary, size int, local bigint, off int", fold)
    per = packed.groupBy("bv").agg((F.max("local") + 1).alias("n"))
    base = per.select(F.col("bv").alias("__bv"), F.coalesce(F.sum("n").over(Window.orderBy("bv").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    return packed.join(F.broadcast(base), F.col("bv") == F.col("__bv")).withColumn("cid", F.col("local") + F.col("__base")).drop("__bv", "__base", "local")


def simple_pack(stored: DataFrame, capacity: int) -> DataFrame:
    """A stand-in that SQL can check, not the packing of ``pack_containers``: container = bytes before the chunk in its version / capacity; cid = bv * 100000 + container."""
    before = Window.partitionBy("bv").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / F.lit(capacity))
    return stored.withColumn("cid", (F.col("bv").cast("bigint") * 100_000 + at).cast("bigint"))


def containers(entries: DataFrame) -> DataFrame:
    """(cid, bv, chunk_num, data_size)."""
    return entries.groupBy("cid", "bv").agg(F.count("*").cast("int").alias("chunk_num"), F.sum("size").cast("bigint").alias("data_size"))


def recipes(chunks: DataFrame, located: DataFrame) -> DataFrame:
    """Every chunk with its container: (.., cid). ``located`` has (fp, cid), one row a fingerprint."""
    where = located.select(F.col("fp").alias("__fp"), "cid")
    return chunks.join(where, F.col("fp") == F.col("__fp")).drop("__fp")


def file_recipes(recipe: DataFrame) -> DataFrame:
    return recipe.groupBy("bv", "file_no").agg(F.count("*").alias("chunknum"), F.sum("size").cast("bigint").alias("filesize"))


def access_records(recipe: DataFrame) -> DataFrame:
    """The containers a restore asks for, in order, repeats in a row once: (bv, record, cid)."""
    order = Window.partitionBy("bv").orderBy("seq")
    turns = recipe.withColumn("__last", F.lag("cid").over(order)).where(F.col("__last").isNull() | (F.col("__last") != F.col("cid")))
    return turns.select("bv", "seq", "cid").withColumn("record", (F.row_number().over(order) - 1).cast("bigint"))


def next_use(records: DataFrame) -> DataFrame:
    """For each access the record at which its container is asked for again; null: never."""
    return records.withColumn("next_record", F.lead("record").over(Window.partitionBy("bv", "cid").orderBy("record")))
