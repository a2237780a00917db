"""Ordered folds: rows of a key in their order, one after another, with whatever state a fold keeps.

Keys are dealt to partitions and sorted there by Spark (which spills), and a Python iterator passes over them: a fold's memory is its state, not its input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that leave a fold at once.
BATCH = 20_000


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], schema: str, fold: Callable[[tuple, Iterator[tuple]], Iterable[tuple]], partitions: int | None = None) -> DataFrame:
    """``fold(key, rows)`` makes result rows (in the order of ``schema``) from a key's rows (all columns of df), which come by ``order``."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    at = [df.columns.index(k) for k in keys]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*[c.to_pylist() for c in b.columns], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, rows in groupby(rows_of(batches), key=lambda r: tuple(r[i] for i in at)):
            for r in fold(key, rows):
                out.append(r)
                if len(out) >= BATCH:
                    yield packed(out)
                    out = []
        if out:
            yield packed(out)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], names=arrow.names)

    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
