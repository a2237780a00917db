"""Ridge on partition-summed normal equations, and isotonic calibration, shared by the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import id_remainder, written

#: Lanes in which the partial sums of a key meet before the last addition, so that no task reads a row from every partition.
FAN_IN = 32


def summed(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]], width: int) -> dict[int, np.ndarray]:
    """The sum over all partitions of the vectors (``width`` doubles) that ``partial`` makes by key.

    ``partial`` sees a partition's batches once and returns a few vectors of fixed size. They are added in two levels of shuffles, in the order of the
    partitions' numbers: a task that runs again deals its sums out as before, and the sum doesn't depend on which task is done first. One vector for each key
    reaches the driver.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, v in partial(batches).items():
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "lane": pa.array([part % FAN_IN], pa.int64()), "part": pa.array([part], pa.int64()), "v": pa.array([v.astype(np.float64).tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by key and lane: one vector is held at a time
        now, total = None, None
        for b in batches:
            for k, lane, v in zip(b.column("k").to_pylist(), b.column("lane").to_pylist(), b.column("v"), strict=True):
                if (k, lane) != now:
                    if now is not None:
                        yield row(now, total)
                    now, total = (k, lane), np.zeros(width)
                total += np.frombuffer(v.as_buffer(), np.float64)
        if now is not None:
            yield row(now, total)

    def row(key: tuple[int, int], v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"k": pa.array([key[0]], pa.int64()), "lane": pa.array([key[1]], pa.int64()), "part": pa.array([0], pa.int64()), "v": pa.array([v.tobytes()], pa.binary())})

    schema = "k bigint, lane bigint, part bigint, v binary"
    lanes = df.mapInArrow(mapped, schema).repartition(FAN_IN, "k", "lane").sortWithinPartitions("k", "lane", "part").mapInArrow(add, schema)
    whole = lanes.repartition(FAN_IN, "k").sortWithinPartitions("k", "lane").select("k", F.lit(0).cast("bigint").alias("lane"), "part", "v").mapInArrow(add, schema)
    return {r["k"]: np.frombuffer(r["v"], np.float64) for r in whole.select("k", "v").collect()}


def agreed_labels(labels: DataFrame, label: str, modulus: int, held: int) -> DataFrame:
    """(doc_id, y 0/1) of the ids outside the held-out remainder that have a label: of labels that disagree the more frequent, and 0 if none is."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & F.coalesce(id_remainder("doc_id", modulus) != held, F.lit(False)))
    return known.groupBy("doc_id").agg((F.avg((F.col(label) > 0).cast("double")) > 0.5).cast("int").alias("y"))


def drawn_rows(documents: DataFrame, known: DataFrame, most: int | dict[int, int], seed: int) -> DataFrame:
    """(doc_id, text, digest, y, stands_for): about ``most`` rows at most (of each label, if it says so); rows equal in id and text count once.

    Ids are drawn first, by a hash, about as many as rows are asked for: so few can be sent, and texts that aren't drawn never move. Should these ids have more rows than that, their rows
    are drawn in turn, by a hash of id and text. ``stands_for`` is the number of labelled rows that a drawn one stands for.
    """
    draw = lambda *x: F.pmod(F.xxhash64(*x), F.lit(1 << 30)) / F.lit(float(1 << 30))
    per_id = documents.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).join(known, "doc_id")
    per_id = written(per_id.select("doc_id", "y", "n", draw("doc_id", F.lit(seed)).alias("draw")), "labelled-ids")
    one = isinstance(most, int)
    key = (lambda y: None) if one else (lambda y: y)
    wanted = {None: most} if one else most

    def rates(rows: DataFrame, of: str) -> dict[int, float]:
        found: dict = {}
        for r in rows.groupBy("y").agg(F.count("*").alias("ids"), F.sum("n").alias("rows")).collect():
            found[key(r["y"])] = found.get(key(r["y"]), 0) + r[of]
        return {y: min(1.0, wanted[key(y)] / found[key(y)]) if found.get(key(y)) else 0.0 for y in (0, 1)}

    def by_label(rate: dict[int, float]) -> Column:
        return F.coalesce(*[F.when(F.col("y") == y, F.lit(r)) for y, r in rate.items()], F.lit(0.0))

    ids = rates(per_id, "ids")
    drawn = written(per_id.where(F.col("draw") < by_label(ids)).select("doc_id", "y", "n"), "drawn-ids")
    rows = rates(drawn, "rows")
    picked = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn.select("doc_id", "y")), "doc_id")  # about ``most`` ids
    picked = picked.withColumn("digest", F.xxhash64("doc_id", "text", F.lit(seed))).where(draw("digest") < by_label(rows))
    return picked.dropDuplicates(["doc_id", "digest"]).withColumn("stands_for", 1 / (by_label(ids) * by_label(rows)))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (x, fitted y) of the blocks' ends, rising. Ties in x are pooled first."""
    keep = w > 0
    unique, inverse = np.unique(x[keep], return_inverse=True)
    weight = np.bincount(inverse, weights=w[keep], minlength=len(unique))
    mean = np.bincount(inverse, weights=(w * y)[keep], minlength=len(unique)) / np.maximum(weight, 1e-300)
    blocks: list[list[float]] = []  # lowest x, highest x, mean, weight
    for a, b, c in zip(unique, mean, weight, strict=True):
        blocks.append([a, a, b, c])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            _, hi, m, v = blocks.pop()
            p = blocks[-1]
            blocks[-1] = [p[0], hi, (p[2] * p[3] + m * v) / (p[3] + v), p[3] + v]
    if not blocks:
        return np.zeros(0), np.zeros(0)
    xs = np.array([z for b in blocks for z in (b[0], b[1])])
    ys = np.array([z for b in blocks for z in (b[2], b[2])])
    return xs, ys


def calibrated(raw: np.ndarray, knots: tuple[np.ndarray, np.ndarray], default: float = 0.5) -> np.ndarray:
    """The fitted curve at raw, between blocks by straight lines; a tiny share of the raw order breaks ties inside blocks."""
    xs, ys = knots
    if not len(xs):
        return np.full(len(raw), default)
    squeezed = 1 / (1 + np.exp(-np.clip(4 * (raw - 0.5), -30, 30)))
    return np.clip(0.998 * np.interp(raw, xs, ys) + 0.002 * squeezed, 0, 1)


def binned(df: DataFrame, raw: str, label: str, n: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(raw, mean label, weight) of at most n bins of equal width over the raw scores' range: what calibration needs, whatever the row count."""
    lo, hi = df.agg(F.min(raw), F.max(raw)).first()
    if lo is None:
        return np.zeros(0), np.zeros(0), np.zeros(0)
    step = max((hi - lo) / n, 1e-12)
    rows = df.groupBy(F.floor((F.col(raw) - lo) / step).alias("b")).agg(F.avg(raw).alias("x"), F.avg(F.col(label).cast("double")).alias("y"), F.count("*").alias("w")).collect()
    return tuple(np.array([r[c] for r in rows], np.float64) for c in ("x", "y", "w"))  # type: ignore[return-value]
