"""Toxicity: nearest labelled examples by TF-IDF cosine over whole texts, found in a block-max inverted index; distance-weighted votes, calibrated, with evidence.

Terms are the words of a text, A-Z lower-cased. Every term of a text counts: its weight is (1 + ln tf) * idf * (``FLOOR`` + phi^2), where idf = ln((2 + N) / (1 + df)) over all
documents, and phi^2 is how strongly the term goes with the label among the examples (0 for a term that no example has). Vectors have length 1. The last factor is a supervised
term weight beside plain TF-IDF: in plain TF-IDF the few telling words of a text drown among hundreds of others (the README has the figures of both).

The examples are a bounded sample of labelled rows, about ``max_examples`` / 2 of each label at most, drawn by a hash of id and text; rows equal in both count once. Their postings are
exact by 64-bit hashes of terms. They lie in blocks of ``BLOCK`` examples; each term knows its largest weight in each block. A query adds up these bounds, looks into the ``FIRST``
blocks of the largest bounds, and then into all blocks whose bound reaches the k-th best cosine found: the k nearest are exact, ties going to the example that comes first. What the most
common terms give (those of over a ``COMMON``-th of the examples, whose postings would be most of the work) comes from one matrix product for a slice of queries, and enters the bounds as it is. Document
frequencies of the examples' terms are exact too; terms outside the examples, which only enter the length of a text's own vector, are counted in ``BUCKETS`` buckets of their hashes.

Each neighbour votes with its cosine. A text that shares no term with any example has the examples' common rate as its vote. Votes become scores by isotonic regression on the
examples' own votes, each without itself, weighted by what a drawn row stands for. Whole texts are read three times (sample, document frequencies, scores) and never shuffled.

Defined results: null and empty texts have no terms; repeated rows are scored each by itself; a null id is held_out = false and never an example; of labels that disagree about an id the
more frequent counts, and 0 if none is; without labelled examples all scores are 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fitting import agreed_labels, calibrated, drawn_rows, isotonic, summed
from .shared import batch_limit, extended, id_remainder, slices, written
from .textkit import BASE, BYTE, LOWER, U, Words, mix, prefix, span_hash

SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
FLOOR = 0.01
BLOCK = 64
FIRST = 8
NEIGHBOURS = 24
BUCKETS = 1 << 18
#: A term that more than a COMMON-th of the examples have is common; queries that meet the common terms at once.
COMMON = 16
QUERIES = 64
#: Votes that the common rate has beside the neighbours'.
PRIOR = 0.5
#: Counts that one row of the document frequencies holds.
PIECE = 1 << 13


def counted_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term hash, text, times) of the distinct terms of each text of a slice, text after text."""
    w = Words(data, offsets, SEPARATOR)
    key = span_hash(prefix(BYTE[LOWER[data]], BASE), w.start, w.end, BASE)
    _, at, tf = np.unique(mix(key + w.doc.astype(U) * U(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    order = np.lexsort((key[at], w.doc[at]))
    return key[at][order], w.doc[at][order], tf[order]


def bucket_of(key: np.ndarray) -> np.ndarray:
    return (key >> U(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


class Vocabulary:
    """The sorted hashes of the examples' terms, with a bitmap that turns most others away."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[keys >> U(44)] = True

    def find(self, key: np.ndarray) -> np.ndarray:
        """The number of each term, -1 for others."""
        out = np.full(len(key), -1, np.int64)
        maybe = np.flatnonzero(self.bitmap[key >> U(44)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == key[maybe], at, -1)
        return out


@dataclass
class Weights:
    """What turns counts into vectors: document frequencies and label relevance."""

    vocabulary: Vocabulary
    df: np.ndarray  # of the vocabulary
    other: np.ndarray  # of the buckets of terms outside
    total: int
    phi: np.ndarray

    def vectors(self, key: np.ndarray, doc: np.ndarray, tf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term, weight) of the terms in the vocabulary, and where each text's begin; the lengths are over all terms."""
        at = self.vocabulary.find(key)
        known = at >= 0
        df = np.where(known, self.df[np.maximum(at, 0)] if len(self.df) else 0, self.other[bucket_of(key)])
        factor = FLOOR + np.where(known, self.phi[np.maximum(at, 0)] if len(self.phi) else 0, 0.0)
        w = (1 + np.log(tf)) * np.log((2 + self.total) / (1 + df)) * factor
        length = np.sqrt(np.bincount(doc, weights=w * w, minlength=n))
        return at[known], (w / np.maximum(length[doc], 1e-300))[known], np.searchsorted(doc[known], np.arange(n + 1))


def phi_squared(a: np.ndarray, n: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Squared correlation of a term with the label, from the examples that have it (a of label 1, n of both)."""
    total, b = float(n1 + n0), n - a
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (a * (n0 - b) - b * (n1 - a)) ** 2 / (n * (total - n) * float(n1) * float(n0))
    return np.nan_to_num(out, nan=0.0, posinf=0.0)


class BlockMaxIndex:
    """Postings of unit vectors in blocks of examples, with each term's largest weight in each block where it occurs."""

    def __init__(self, term: np.ndarray, weight: np.ndarray, first: np.ndarray, n_terms: int):
        self.n = len(first) - 1
        self.blocks = -(-self.n // BLOCK)
        example = np.repeat(np.arange(self.n), np.diff(first))
        # alike vectors in a row make tight bounds: by strongest term, then by its weight
        top = np.zeros(self.n, np.int64)
        high = np.zeros(self.n)
        by = np.lexsort((weight, example))
        ends = np.searchsorted(example[by], np.arange(self.n), side="right") - 1
        some = np.flatnonzero(np.diff(first) > 0)
        top[some], high[some] = term[by][ends[some]], weight[by][ends[some]]
        self.order = np.lexsort((np.arange(self.n), -high, top))
        place = np.empty(self.n, np.int64)
        place[self.order] = np.arange(self.n)
        self.place = place
        example = place[example]
        by = np.lexsort((example, term))
        self.weight, self.example = weight[by], example[by].astype(np.int32)
        self._segment(np.searchsorted(term[by], np.arange(n_terms + 1)).astype(np.int32))

    def __getstate__(self) -> tuple:
        """The postings; blocks and rows follow from them."""
        return self.n, self.blocks, self.order, self.place, self.weight, self.example, self.terms

    def __setstate__(self, state: tuple) -> None:
        self.n, self.blocks, self.order, self.place, self.weight, self.example, terms = state
        self._segment(terms)

    def _segment(self, terms: np.ndarray) -> None:
        """``terms``: where each term's postings begin."""
        self.terms, n_terms = terms, len(terms) - 1
        term = np.repeat(np.arange(n_terms), np.diff(terms))
        block = self.example // BLOCK
        opens = np.ones(len(term), bool)
        opens[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        start = np.flatnonzero(opens)
        self.start = np.append(start, len(term))
        self.block = block[start]
        self.max = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.segments = np.searchsorted(term[start], np.arange(n_terms + 1))
        # terms of more than a share of the examples have long postings: they are rows of a matrix, so that a slice of queries meets them in one product
        count = self.start[self.segments[1:]] - self.start[self.segments[:-1]]
        common = np.flatnonzero(count > max(self.n // COMMON, BLOCK))
        self.row = np.full(n_terms, -1, np.int64)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.n))
        for i, t in enumerate(common.tolist()):
            p = slice(int(self.start[self.segments[t]]), int(self.start[self.segments[t + 1]]))
            self.rows[i, self.example[p]] = self.weight[p]
        self.opens = np.arange(0, self.n, BLOCK)

    def search(self, ids: np.ndarray, weights: np.ndarray, first: np.ndarray, k: int, without: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of examples, cosines) of the k nearest with a cosine above 0, the nearest first, of each query ids[first[i] : first[i + 1]]."""
        row = self.row[ids]
        for lo in range(0, len(first) - 1, QUERIES):
            n = min(QUERIES, len(first) - 1 - lo)
            query = np.repeat(np.arange(n), np.diff(first[lo : lo + n + 1]))
            own = slice(first[lo], first[lo + n])
            dense = np.zeros((n, len(self.rows)))
            common = row[own] >= 0
            dense[query[common], row[own][common]] = weights[own][common]
            shared = dense @ self.rows
            for i in range(n):
                q = slice(first[lo + i], first[lo + i + 1])
                rare = row[q] < 0
                yield self._nearest(ids[q][rare], weights[q][rare], shared[i], k, -1 if without is None else int(self.place[without[lo + i]]))

    def _nearest(self, ids: np.ndarray, v: np.ndarray, shared: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """``shared``: what the common terms give each example."""
        start, end = self.segments[ids], self.segments[ids + 1]
        s, q = _spread(start, end), np.repeat(v, end - start)
        block = self.block[s]
        upper = np.bincount(block, weights=q * self.max[s], minlength=self.blocks) + np.maximum.reduceat(shared, self.opens)
        order = np.argsort(-upper, kind="stable")
        found, cosine = self._inside(s, q, block, order[:FIRST], shared, k, without)
        rest = order[FIRST:]
        rest = rest[(upper[rest] > 0) & ((upper[rest] >= cosine[-1] - 1e-12) if len(found) == k else True)]
        if len(rest):
            more, cosines = self._inside(s, q, block, rest, shared, k, without)
            found, cosine = _best(np.concatenate([found, more]), np.concatenate([cosine, cosines]), k)
        return found, cosine

    def _inside(self, s: np.ndarray, q: np.ndarray, block: np.ndarray, chosen: np.ndarray, shared: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        wanted = np.zeros(self.blocks, bool)
        wanted[chosen] = True
        if len(chosen) < self.blocks:
            inside = wanted[block]
            s, q = s[inside], q[inside]
        start, end = self.start[s], self.start[s + 1]
        p = _spread(start, end)
        scores = shared + np.bincount(self.example[p], weights=np.repeat(q, end - start) * self.weight[p], minlength=self.n)
        scores[~np.repeat(wanted, BLOCK)[: self.n]] = 0
        if without >= 0:
            scores[without] = 0
        own = np.flatnonzero(scores > 0)
        return _best(own, scores[own], k)


def _spread(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range behind the other."""
    n = end - start
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _best(found: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    cosine = np.round(cosine, 12)
    if len(found) > 4 * k:  # all that may belong to the k best, ties included
        keep = cosine >= np.partition(cosine, len(cosine) - k)[len(cosine) - k]
        found, cosine = found[keep], cosine[keep]
    top = np.lexsort((found, -cosine))[:k]
    return found[top], cosine[top]


@dataclass
class ToxicityModel:
    weights: Weights
    index: BlockMaxIndex
    labels: np.ndarray  # by place
    names: np.ndarray
    base: float
    knots: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        return float((cosine @ self.labels[near] + PRIOR * self.base) / (cosine.sum() + PRIOR))

    def votes(self, data: np.ndarray, offsets: np.ndarray, without: np.ndarray | None = None, evidence: int = 0, cache: dict | None = None) -> tuple[list[float], list[list[dict]]]:
        """Each text's vote and its nearest examples; ``without``: the example that a text itself is."""
        ids, weights, first = self.weights.vectors(*counted_terms(data, offsets), len(offsets) - 1)
        # equal texts are looked up once in a while
        key = [(ids[a:b].tobytes(), weights[a:b].tobytes()) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)] if cache is not None else []
        if cache is not None:
            if len(cache) > 2000:
                cache.clear()
            asked = {k: i for i, k in reversed(list(enumerate(key))) if k not in cache}
            which = sorted(asked.values())
        else:
            which = list(range(len(first) - 1))
        size = np.diff(first)[which]
        picked = _spread(first[:-1][which], first[1:][which])
        found = self.index.search(ids[picked], weights[picked], np.concatenate([[0], np.cumsum(size)]), NEIGHBOURS, None if without is None else without[which])
        out = {}
        for i, (near, cosine) in zip(which, found, strict=True):
            got = self.vote(near, cosine), [{"doc_id": int(self.names[x]), "similarity": float(s), "toxic": int(self.labels[x])} for x, s in zip(near[:evidence], cosine[:evidence], strict=True)]
            if cache is not None:
                cache[key[i]] = got
            out[i] = got
        rows = [cache[k] for k in key] if cache is not None else [out[i] for i in which]
        return [v for v, _ in rows], [e for _, e in rows]


def _example_vectors(examples: DataFrame) -> pa.Table:
    """(number, keys, tfs) of every example: bounded by the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in slices(b.column(1)):
                key, doc, tf = counted_terms(data, offsets)
                cuts = pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int64) if x is tf else x.view(np.int64))) for x in (key, tf)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *lists], names=["number", "keys", "tfs"])

    return examples.select("number", "text").mapInArrow(run, "number bigint, keys array<bigint>, tfs array<bigint>").toArrow()


def document_frequencies(documents: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, int]:
    """(of the vocabulary, of the buckets of all other terms, number of documents), over every whole text."""
    spark = documents.sparkSession
    batch_limit(spark)
    shared = spark.sparkContext.broadcast(vocabulary)  # the examples' terms
    size = len(vocabulary.keys) + BUCKETS + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        own = shared.value
        total = np.zeros(-(-size // PIECE) * PIECE)
        for b in batches:
            total[size - 1] += b.num_rows
            for _, _, data, offsets in slices(b.column(0)):
                key, _, _ = counted_terms(data, offsets)
                at = own.find(key)
                total += np.bincount(np.where(at >= 0, at, len(own.keys) + bucket_of(key)), minlength=len(total))
        pieces = total.reshape(-1, PIECE)
        return {int(i): pieces[i] for i in np.flatnonzero(pieces.any(1))}

    sums = summed(documents.select(F.col("text").cast("string").alias("text")), partial, PIECE)
    flat = np.zeros(-(-size // PIECE) * PIECE)
    for i, v in sums.items():
        flat[i * PIECE : (i + 1) * PIECE] = v
    n = len(vocabulary.keys)
    return flat[:n], flat[n : n + BUCKETS], int(flat[size - 1])


def fit_toxicity(documents: DataFrame, labels: DataFrame, max_examples: int = 4096) -> ToxicityModel | None:
    """The model; None without labelled examples."""
    spark = documents.sparkSession
    batch_limit(spark)
    known = agreed_labels(labels, "toxic", 4, 2)
    drawn = drawn_rows(documents, known, {y: max_examples // 2 for y in (0, 1)}, seed=31)
    order = F.row_number().over(_by_id())
    examples = written(drawn.select((order - 1).cast("bigint").alias("number"), "doc_id", "text", "y", "stands_for"), "toxic-examples")
    rows = examples.select("number", "doc_id", "y", "stands_for").toPandas().sort_values("number")
    if not len(rows):
        return None
    y, stands_for = rows["y"].to_numpy(np.float64), rows["stands_for"].to_numpy(np.float64)
    parts = _example_vectors(examples)
    sizes = np.diff(np.concatenate([[0], np.cumsum(parts.column("keys").combine_chunks().value_lengths().to_numpy())]))
    number = np.repeat(parts.column("number").to_numpy(), sizes)
    key = parts.column("keys").combine_chunks().flatten().to_numpy().view(U)
    tf = parts.column("tfs").combine_chunks().flatten().to_numpy()
    by = np.lexsort((key, number))
    key, number, tf = key[by], number[by], tf[by]
    vocabulary = Vocabulary(np.unique(key))
    at = np.searchsorted(vocabulary.keys, key)
    size = len(vocabulary.keys)
    phi = phi_squared(np.bincount(at, weights=y[number], minlength=size), np.bincount(at, minlength=size).astype(np.float64), int(y.sum()), int((1 - y).sum()))
    df, other, total = document_frequencies(documents, vocabulary)
    weights = Weights(vocabulary, df, other, total, phi)
    index = BlockMaxIndex(*weights.vectors(key, number, tf, len(y)), size)
    base = float((y * stands_for).sum() / stands_for.sum())
    model = ToxicityModel(weights, index, y[index.order], rows["doc_id"].to_numpy(np.int64)[index.order], base)
    model.knots = _calibrate(examples, model)
    return model


def _by_id():
    from pyspark.sql import Window

    return Window.orderBy("doc_id", "digest")  # the sample, which is bounded


def _calibrate(examples: DataFrame, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression on the examples' votes, each without itself."""
    shared = examples.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = b.column(0).to_numpy()
            for lo, hi, data, offsets in slices(b.column(b.num_columns - 1)):
                votes, _ = shared.value.votes(data, offsets, without=number[lo:hi])
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns[1:-1], pa.array(votes, pa.float64())], names=["y", "stands_for", "vote"])

    spread = examples.select("number", "y", "stands_for", "text").repartition(examples.sparkSession.sparkContext.defaultParallelism, "number")
    rows = spread.mapInArrow(run, "y int, stands_for double, vote double").toPandas()  # a row an example
    rows = rows.sort_values(["vote", "y", "stands_for"])
    bins, inverse = np.unique(np.round(rows["vote"].to_numpy(), 3), return_inverse=True)
    weight = np.bincount(inverse, weights=rows["stands_for"])
    return isotonic(bins, np.bincount(inverse, weights=rows["y"] * rows["stands_for"]) / weight, weight)


def score_toxicity(documents: DataFrame, model: ToxicityModel | None, keep: list[str], evidence: int = 3) -> DataFrame:
    """Columns ``keep`` of every row with ``score`` and ``evidence``: the nearest examples (doc_id, similarity, toxic)."""
    spark = documents.sparkSession
    batch_limit(spark)
    nearest = "array<struct<doc_id:bigint,similarity:double,toxic:int>>"
    if model is None:
        return documents.select(*keep, F.lit(0.0).alias("score"), F.array().cast(nearest).alias("evidence"))
    shared = spark.sparkContext.broadcast(model)  # bounded by max_examples rows
    picked = documents.select(*[F.col(c) for c in keep], F.col("text").cast("string").alias("__text"))
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = shared.value, {}
        for b in batches:
            for lo, hi, data, offsets in slices(b.column(b.num_columns - 1)):
                votes, seen = m.votes(data, offsets, evidence=evidence, cache=cache)
                score = calibrated(np.array(votes, np.float64), m.knots, 0.0)
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns[:-1], pa.array(score), pa.array(seen, kind)], names=[*b.schema.names[:-1], "score", "evidence"])

    return picked.mapInArrow(run, extended(picked.drop("__text").schema, f"score double, evidence {nearest}"))


def classify_toxicity(documents: DataFrame, labels: DataFrame, max_examples: int = 4096) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row of ``documents``."""
    model = fit_toxicity(documents, labels, max_examples)
    held = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
    return score_toxicity(documents, model, ["doc_id"]).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")
