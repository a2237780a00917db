"""Quality classifier: random Fourier features of document statistics, ridge from partition-summed normal equations, isotonic calibration.

One pass over whole texts makes a narrow table of statistics; everything after reads only that table. The Gaussian kernel on the
standardised statistics is approximated by ``n_features`` cosines, whose normal equations are additive, so that each partition sends one
matrix for each of ``FOLDS`` folds and the driver solves systems of that fixed size. The penalty is the one with the least
out-of-fold error; scores of labelled rows by the model that has not seen their fold are calibrated by isotonic regression.

Defined results: null and empty texts have zero statistics and are scored like any text; a null id is held_out = false and never a
training row; repeated rows are scored row by row (a label of a repeated id counts once for each row; of labels that disagree about an id the more
frequent counts, and 0 if none is); without training labels, or with
one class only, every score is 0.5 or that class's share; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fitting import agreed_labels, binned, calibrated, drawn_rows, isotonic, summed
from .shared import batch_limit, extended, id_remainder, slices, written
from .textstats import RATIOS, measure, text_stats

FOLDS = 5
PENALTIES = (1e-3, 1e-2, 1e-1, 1.0, 10.0)


@dataclass
class QualityModel:
    """Everything that scoring needs: a few hundred numbers, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # frequencies, statistics x features
    phase: np.ndarray
    folds: np.ndarray  # FOLDS + 1 rows: without fold i; the last has seen all
    knots: tuple[np.ndarray, np.ndarray]
    default: float = 0.5

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2.0 / self.weights.shape[1]) * np.cos(z @ self.weights + self.phase), z / np.sqrt(z.shape[1]), np.ones((len(z), 1))], 1)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _raw(df: DataFrame, model: QualityModel, out_of_fold: bool) -> DataFrame:
    """Adds ``raw``; with out_of_fold by the model that has not seen the row's fold."""
    schema = extended(df.schema, "raw double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = model.features(_matrix(b, "stats_ratios")) @ model.folds.T
            at = b.column("fold").to_numpy(zero_copy_only=False).astype(int) if out_of_fold else np.full(b.num_rows, FOLDS)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw[np.arange(b.num_rows), at])], names=[*b.schema.names, "raw"])

    return df.mapInArrow(run, schema)


def fit_quality(train: DataFrame, label: str, fold: str, n_features: int = 160, bandwidth: float = 4.0, seed: int = 7) -> QualityModel:
    """Fits on ``train`` (stats_ratios, label 0/1, fold any integer). Every row of it counts; what is collected has a fixed size."""
    d = len(RATIOS)
    rng = np.random.default_rng(seed)
    model = QualityModel(np.zeros(d), np.ones(d), rng.normal(0, 1 / bandwidth, (d, n_features)), rng.uniform(0, 2 * np.pi, n_features), np.zeros((FOLDS + 1, n_features + d + 1)), (np.zeros(0), np.zeros(0)))
    moments = train.agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("p"), *[f(F.col("stats_ratios")[i]).alias(f"{k}{i}") for i in range(d) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not moments["n"]:
        return model
    model.mean = np.array([moments[f"m{i}"] for i in range(d)], np.float64)
    sd = np.array([moments[f"s{i}"] for i in range(d)], np.float64)
    model.scale, model.default = np.where(sd > 1e-9, sd, 1.0), float(moments["p"])
    size = n_features + d + 1
    width = size * size + size + 1
    rows = train.select(F.pmod(F.col(fold).cast("long"), F.lit(FOLDS)).alias("fold"), F.col(label).cast("double").alias("y"), "stats_ratios")

    def partial(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            x, y, k = model.features(_matrix(b, "stats_ratios")), b.column("y").to_numpy(), b.column("fold").to_numpy()
            for i in np.unique(k):
                p, q = x[k == i], y[k == i]
                out[int(i)] = out.get(int(i), 0) + np.concatenate([(p.T @ p).ravel(), p.T @ q, [q @ q]])
        return out

    sums = summed(rows, partial, width)
    whole = sum(sums.values())
    parts = [whole - sums.get(i, 0) for i in range(FOLDS)] + [whole]
    cut = lambda v: (v[: size * size].reshape(size, size), v[size * size : -1], v[-1])
    n = float(moments["n"])

    def solve(v: np.ndarray, penalty: float) -> np.ndarray:
        a, b, _ = cut(v)
        ridge = np.full(size, penalty * max(1.0, n) / 1000)
        ridge[-1] = 1e-9  # the constant
        return np.linalg.solve(a + np.diag(ridge + 1e-9), b)

    def error(penalty: float) -> float:
        total = 0.0
        for i, v in sums.items():
            a, b, yy = cut(v)
            w = solve(parts[i], penalty)
            total += w @ a @ w - 2 * (b @ w) + yy
        return total

    best = min(PENALTIES, key=error) if len(sums) > 1 else 1.0
    model.folds = np.stack([solve(v, best) for v in parts])
    scored = _raw(rows, model, out_of_fold=len(sums) > 1)
    model.knots = isotonic(*binned(scored, "raw", "y"))
    return model


def score_quality(stats: DataFrame, model: QualityModel) -> DataFrame:
    """Adds ``score`` to a table that has ``stats_ratios``."""
    schema = extended(stats.schema, "score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw = model.features(_matrix(b, "stats_ratios")) @ model.folds[-1]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(calibrated(raw, model.knots, model.default))], names=[*b.schema.names, "score"])

    return stats.mapInArrow(run, schema)


def training_rows(stats: DataFrame, labels: DataFrame, label: str, modulus: int, held: int) -> DataFrame:
    """Rows of ``stats`` that have a label and whose id does not fall in the held-out remainder."""
    known = agreed_labels(labels, label, modulus, held).withColumnRenamed("y", "__y")
    return stats.where(F.coalesce(id_remainder("doc_id", modulus) != held, F.lit(False))).join(known, "doc_id")


def classify_quality(documents: DataFrame, labels: DataFrame, n_features: int = 160, bandwidth: float = 4.0) -> tuple[DataFrame, QualityModel]:
    """(doc_id, held_out, score, predicted, stats_ratios) of every row of ``documents``, and the model."""
    stats = written(text_stats(documents, ["doc_id"]).drop("stats_counts"), "quality-stats")
    train = training_rows(stats, labels, "quality", 3, 1).withColumn("__fold", F.floor(F.crc32(F.col("doc_id").cast("string")) / F.lit(3)))
    model = fit_quality(written(train.drop("doc_id"), "quality-train"), "__y", "__fold", n_features, bandwidth)  # joined once, read by each step of the fit
    scored = score_quality(stats, model)
    out = scored.select("doc_id", F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "stats_ratios")
    return out, model


def filter_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = 200_000) -> DataFrame:
    """``documents`` without the rows that the classifier rejects. Rows are scored in place: no join brings the texts together again.

    The model is fitted on about ``max_rows`` labelled rows at most, drawn by a hash of id and text (rows equal in both count once), so that the statistics of all texts are taken once, not twice.
    Null and empty texts are scored like any other; a null id is never a training row; repeated rows are judged each by itself; an empty table stays empty; all columns, whatever their names, come back as they were.
    """
    picked = drawn_rows(documents, agreed_labels(labels, "quality", 3, 1), max_rows, seed=41).withColumnRenamed("y", "__y")
    train = written(text_stats(picked, ["doc_id", "__y"]).drop("stats_counts"), "quality-train")
    model = fit_quality(train.withColumn("__fold", F.floor(F.crc32(F.col("doc_id").cast("string")) / F.lit(3))), "__y", "__fold")
    batch_limit(documents.sparkSession)
    names = documents.columns
    rows = documents.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)], F.col("text").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # statistics, score and verdict in one Python process: two in a row would hold twice the memory
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for lo, hi, data, offsets in slices(b.column(b.num_columns - 1)):
                raw = model.features(measure(data, offsets)[1]) @ model.folds[-1]
                keep[lo:hi] = calibrated(raw, model.knots, model.default) >= threshold
            yield b.filter(pa.array(keep))

    return rows.mapInArrow(run, rows.schema).select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)])
