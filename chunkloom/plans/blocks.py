"""Chunks as blocks: a row holds some thousands of chunks of a version as packed arrays, so that a fold over a whole series reads few rows, and what it decides is taken apart again by all executors.

Packing finds out which fingerprints occur more than once and numbers them: an aggregate and a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import compact
from .shared import batch_bytes, written

#: Chunks of a block.
BLOCK = 1 << 15
WIDTH = 20
#: Packed columns, their numbers and whether differences are kept.
PACKED = {"ids": (np.int32, False), "sizes": (np.int32, False), "seqs": (np.int64, True), "files": (np.int64, True), "lengths": (np.uint8, False)}
BLOCKS = "bv int, block bigint, n int, ids binary, sizes binary, seqs binary, files binary, lengths binary, fps binary"


def squeezed(a: np.ndarray, kind: type, differences: bool = False) -> bytes:
    a = np.asarray(a, kind)
    return pa.compress(np.diff(a, prepend=kind(0)).tobytes() if differences else a.tobytes(), "lz4", asbytes=True)


def spread(b: bytes, n: int, kind: type, differences: bool = False) -> np.ndarray:
    a = np.frombuffer(pa.decompress(b, n * np.dtype(kind).itemsize, "lz4", asbytes=True), kind)
    return np.cumsum(a, dtype=kind) if differences else a


def padded(fps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, n x 20 bytes, shorter ones filled with zeros)."""
    ends = np.frombuffer(fps.buffers()[1], np.int32)[fps.offset : fps.offset + len(fps) + 1]
    lengths = np.diff(ends)
    data = np.frombuffer(fps.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    if not (lengths == WIDTH).all():
        if lengths.max() > WIDTH:
            raise ValueError(f"fingerprints have {WIDTH} bytes at most")
        out = np.zeros((len(fps), WIDTH), np.uint8)
        out[np.arange(WIDTH)[None, :] < lengths[:, None]] = data
        data = out
    return lengths.astype(np.uint8), data.reshape(-1, WIDTH)


def _packed(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    key, held = None, []

    def row() -> pa.RecordBatch:
        whole = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        n = len(whole["ids"])
        columns = [*key, n, *[squeezed(whole[k], *PACKED[k]) for k in PACKED], whole["fps"].tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    for b in batches:
        if not len(b):
            continue
        bv, block = b.column("bv").to_numpy(), b.column("block").to_numpy()
        lengths, fps = padded(b.column("fp"))
        cuts = [0, *(np.flatnonzero((bv[1:] != bv[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(b)]
        columns = {"ids": b.column("id").to_numpy(), "sizes": b.column("size").to_numpy(), "seqs": b.column("seq").to_numpy(), "files": b.column("file_no").to_numpy(), "lengths": lengths, "fps": fps}
        for i, j in zip(cuts, cuts[1:], strict=False):
            if key is not None and key != (bv[i], block[i]):
                yield row()
                held = []
            key = (bv[i], block[i])
            held.append({k: x[i:j].copy() for k, x in columns.items()})
    if held:
        yield row()


def packed(chunks: DataFrame) -> tuple[DataFrame, int]:
    """Blocks of (bv, seq, file_no, fp, size), written once, and the highest number of a fingerprint. Numbers: -1 occurs once, 0 is the zero fingerprint, from 1 on the others that occur again."""
    spark = chunks.sparkSession
    batch_bytes(spark)
    zero = F.lit(bytearray(WIDTH))
    again = chunks.groupBy("fp").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("fp") != zero))
    again = written(again.select(F.col("fp").alias("__fp"), F.monotonically_increasing_id().alias("at")), "repeated")
    part = F.shiftright("at", 33)
    offsets, repeated = [], 0
    for r in again.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        offsets.append((r["part"], repeated))
        repeated += r["n"]
    base = F.broadcast(spark.createDataFrame(offsets, "part bigint, base bigint"))
    numbered = again.join(base, part == F.col("part")).select("__fp", (F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).cast("int").alias("__id"))
    number = F.when(F.col("fp") == zero, F.lit(0)).otherwise(F.coalesce("__id", F.lit(-1))).alias("id")
    rows = chunks.join(numbered, F.col("fp") == F.col("__fp"), "left").select(F.col("bv").cast("int").alias("bv"), F.floor(F.col("seq") / F.lit(BLOCK)).cast("bigint").alias("block"), F.col("seq").cast("bigint").alias("seq"), F.col("file_no").cast("bigint").alias("file_no"), "fp", F.col("size").cast("int").alias("size"), number)
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bv", "block").sortWithinPartitions("bv", "block", "seq")
    arrow = to_arrow_schema(StructType.fromDDL(BLOCKS))
    return written(dealt.mapInArrow(lambda batches: _packed(batches, arrow), BLOCKS), "blocks"), repeated


def versions(rows: Iterator[dict], kept: list[tuple[int, int]]) -> Iterator[compact.Version]:
    """Versions from rows of blocks in their order; ``kept`` gets (block, chunks) of the version that came last."""
    for bv, own in groupby(rows, key=lambda r: r["bv"]):
        parts: dict[str, list[np.ndarray]] = {"ids": [], "sizes": [], "files": []}
        fps = []
        kept.clear()
        for r in own:
            kept.append((r["block"], r["n"]))
            for k, held in parts.items():
                held.append(spread(r[k], r["n"], *PACKED[k]))
            if "fps" in r:
                fps.append(np.frombuffer(r["fps"], np.uint8).reshape(-1, WIDTH))
        whole = {k: np.concatenate(held) for k, held in parts.items()}
        del parts
        yield compact.Version(bv, whole["ids"], whole["sizes"], whole["files"], np.concatenate(fps) if fps else None)


def folded(blocks: DataFrame, schema: str, fingerprints: bool, fold: Callable[[Iterator[dict]], Iterator[tuple]]) -> DataFrame:
    """``fold`` makes rows from all blocks in their order, in a task of its own."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names = ["bv", "block", "n", "ids", "sizes", "files", *(["fps"] if fingerprints else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in fold(dict(zip(names, (x.as_py() for x in r), strict=True)) for b in batches for r in zip(*b.columns, strict=True)):
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(r, arrow, strict=True)], schema=arrow)

    return blocks.select(names).repartition(1).sortWithinPartitions("bv", "block").mapInArrow(run, schema)


#: What a fold decides about the chunks of a block.
DECIDED = "config string, __bv int, __block bigint, cids binary, marks binary, numbers binary"


def decided(name: str, job: compact.Backup, kept: list[tuple[int, int]]) -> Iterator[tuple]:
    cids, marks, at = np.frombuffer(job.cids, np.int64), np.frombuffer(job.marks, np.uint8), 0
    for block, n in kept:
        own = slice(at, at + n)
        yield name, job.version.bv, block, squeezed(cids[own], np.int64, True), squeezed(marks[own], np.uint8), squeezed(job.numbers[own], np.int64, True)
        at += n


def unpacked(blocks: DataFrame, decisions: DataFrame, schema: str) -> DataFrame:
    """Chunks with what was decided about them, in the columns of ``backup.RECIPE``."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*b.columns, strict=True):
                r = dict(zip(b.schema.names, (x.as_py() for x in row), strict=True))
                n, lengths = r["n"], spread(r["lengths"], r["n"], *PACKED["lengths"])
                ends = np.zeros(n + 1, np.int32)
                np.cumsum(lengths, out=ends[1:])
                data = np.frombuffer(r["fps"], np.uint8)
                if ends[-1] < len(data):
                    data = data.reshape(-1, WIDTH)[np.arange(WIDTH)[None, :] < lengths[:, None]]
                marks = spread(r["marks"], n, np.uint8)
                flags = [pa.array((marks & m) != 0) for m in (compact.DUP, compact.SPARSE, compact.OOO, compact.IN_CACHE, compact.DENIED, compact.WRITTEN)]
                columns = [
                    pa.repeat(r["config"], n), pa.repeat(pa.scalar(r["bv"], pa.int32()), n), *[pa.array(spread(r[k], n, *PACKED[k])) for k in ("seqs", "files")], pa.array(spread(r["numbers"], n, np.int64, True)),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]), pa.array(spread(r["sizes"], n, *PACKED["sizes"])), pa.array(spread(r["cids"], n, np.int64, True)), *flags,
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    joined = blocks.join(decisions, (F.col("bv") == F.col("__bv")) & (F.col("block") == F.col("__block")))
    return joined.select("config", "bv", "n", "sizes", "seqs", "files", "lengths", "fps", "cids", "marks", "numbers").mapInArrow(run, schema)
