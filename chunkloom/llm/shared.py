"""What the operators of this subpackage share: written tables that cut lineage, table readers, Arrow slices."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one slice of a batch holds at most (a longer text is a slice of its own).
SLICE_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. One of our own only where that is unset and all tasks run in the driver (tests); a cluster has to name one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there, and a lost executor costs only its own tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, n: int) -> Column:
    """``crc32(id as text) mod n``; a null id has none."""
    return F.crc32(F.col(column).cast("string")) % F.lit(n)


def extended(schema: StructType, more: str) -> StructType:
    """``schema`` with the fields of a DDL string behind it."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


def batch_limit(spark: SparkSession) -> None:
    """Arrow batches of whole texts are kept small, in rows and in bytes, so that a Python worker's memory doesn't follow the text length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def large_binary(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary()).cast(pa.large_binary())
    return column


def slices(column: pa.ChunkedArray | pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive runs of texts; a null text has no bytes."""
    array = large_binary(column)
    n = len(array)
    if not n:
        return
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + n + 1]
    data = array.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    valid = None
    if array.null_count:
        valid = array.is_valid().to_numpy(zero_copy_only=False)
        lengths = np.where(valid, np.diff(offsets), 0)
        if (np.diff(offsets)[~valid] != 0).any():  # bytes under nulls: take the texts apart
            parts = [b"" if x is None else x for x in array.to_pylist()]
            whole = np.frombuffer(b"".join(parts), dtype=np.uint8)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        own = offsets[first : last + 1]
        yield first, last, whole[own[0] : own[-1]], own - own[0]
        first = last
