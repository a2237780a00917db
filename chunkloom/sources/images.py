"""Files of a binary format as rows (keys, content): written by a task each, taken apart where they lie, with their keys beside what they hold.

Spark reads binary files but doesn't write them; as rows they can be made, kept in tables and read on any number of executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that leave at once, and rows that are Python objects at once while a file is made.
BATCH = 50_000
SLICE = 500


def imaged(df: DataFrame, keys: list[str], order: list[str], build: Callable[[Iterator[dict]], bytes | bytearray]) -> DataFrame:
    """(keys, content): ``build`` makes a file from a key's rows, which pass by in their order (sorted by Spark, which spills). The file has to fit a row; its rows need not fit a task."""
    schema = StructType([*[df.schema[k] for k in keys], *StructType.fromDDL("content binary").fields])
    arrow = to_arrow_schema(schema)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for i in range(0, len(b), SLICE):
                yield from b.slice(i, SLICE).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in groupby(rows_of(batches), key=lambda r: tuple(r[k] for k in keys)):
            content = pa.py_buffer(build(rows))  # as it lies there: no copy
            one = pa.Array.from_buffers(pa.binary(), 1, [None, pa.array([0, content.size], pa.int32()).buffers()[1], content])
            yield pa.RecordBatch.from_arrays([*[pa.array([k], arrow.field(i).type) for i, k in enumerate(key)], one], schema=arrow)
            del content, one

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def parsed(images: DataFrame, schema: str, rows_of: Callable[[bytes], Iterable[tuple]], keep: list[str] | None = None) -> DataFrame:
    """The rows that ``rows_of`` finds in each ``content``, behind the columns ``keep``."""
    keep = keep or []
    whole = StructType([*[images.schema[k] for k in keep], *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(whole)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], names=arrow.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *key, content in ([x.as_py() for x in r] for r in zip(*b.columns, strict=True)):  # a file at a time
                held: list[tuple] = []
                for r in rows_of(content):
                    held.append((*key, *r))
                    if len(held) >= BATCH:
                        yield packed(held)
                        held = []
                if held:
                    yield packed(held)

    return images.select(*keep, "content").mapInArrow(run, whole)
