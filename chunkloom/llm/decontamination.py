"""Benchmark decontamination: CGK random-walk embedding and bit-sampling LSH over item-sized windows, then exact edit verification.

Words are runs of ASCII letters, digits and non-ASCII bytes of the lower-cased text, so that case and punctuation don't hide a passage. A document holds an
item of n words if one of its windows of n consecutive words (the whole document if that is shorter) is at most floor((1 - similarity) * n) word
insertions, deletions and replacements away from it.

1. Windows. By the pigeonhole principle a window within d edits of an item shares an unbroken run of ceil((n - d) / (d + 1)) words with it; windows that share
   no run of that size (4 words at most are asked for) can't match and are not embedded. Insertions and deletions before the run shift it, in a window as long as
   the item by floor(d / 2) words at most: a shared run at item offset q proposes all windows that put it at q - floor(d / 2) to q + floor(d / 2).
2. CGK: each of ``walks`` random walks reads a window from the left, writes the word it stands on, and moves on or stays as a random function of step and word
   says; edit distance turns into Hamming distance, since walks over edited copies meet again after an edit.
3. Bit sampling: ``tables`` keys for each walk, each of ``bits`` sampled steps, are looked up among the items' keys; any equal key makes a candidate.
   The number of walks is the least that finds ``target_recall`` of copies of the items with as many edits as the threshold allows, whatever class of lengths they are of; fewer
   edits collide more often, exact copies always. The tests measure recall against brute force, and at the threshold item length by item length.
4. Candidates are verified by the exact word edit distance.

The benchmark is read in blocks of at most ``BLOCK_WORDS`` words, each sent to the executors with a bound on its size; a larger benchmark takes more blocks.
Documents are never shuffled.

Defined results: null or empty texts hold nothing; items under ``min_words`` words (or null) are no evidence and match nothing; repeated rows and repeated items are reported
each by themselves; ties among windows go to the first of least distance; empty tables give an empty result; other columns are ignored, or kept by ``remove_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import batch_limit, extended, slices
from .textkit import U, Words, mix, windows

SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Words of the items that one block of the benchmark has at most (8 bytes each, and as much again for the keys).
BLOCK_WORDS = 400_000
#: Numbers that the walks of some windows, and the edit distances of some candidates, hold at once: memory doesn't follow the longest item.
HELD = 4 << 20
MAX_GRAM = 4
_PAD = U(0x1234567)


@dataclass(frozen=True)
class LeakParameters:
    similarity: float = 0.8
    min_words: int = 5
    #: Share of windows at the threshold that some key finds; ``walks`` follows from it, block by block, unless it is given.
    target_recall: float = 0.98
    walks: int = 0
    tables: int = 2
    bits: int = 3
    seed: int = 5

    def edits(self, n: np.ndarray | int) -> np.ndarray | int:
        return np.floor((1 - self.similarity) * np.asarray(n) + 1e-9).astype(np.int64)


def lower_words(column: pa.Array) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = pc.utf8_lower(column)
    for lo, hi, data, offsets in slices(column):
        w = Words(data, offsets, SEPARATOR)
        yield lo, hi, w, w.hashes()


@dataclass
class LeakIndex:
    """The items of one block, their runs of words, and the keys of their embeddings."""

    parameters: LeakParameters
    items: list[int | None]  # ids of the items in use
    words: list[np.ndarray]
    sizes: np.ndarray = field(init=False)
    grams: dict[int, tuple] = field(default_factory=dict)
    keys: np.ndarray = field(init=False)
    key_items: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        if not self.parameters.walks:
            self.parameters = replace(self.parameters, walks=walks_needed(self.words, self.parameters))
        p = self.parameters
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        d = p.edits(self.sizes)
        run = np.minimum(-(-(self.sizes - d) // (d + 1)), MAX_GRAM)
        for g in np.unique(run).tolist():
            own = np.flatnonzero(run == g)
            flat = np.concatenate([self.words[i] for i in own])
            doc = np.repeat(own, self.sizes[own])
            start = np.concatenate([[0], np.cumsum(self.sizes[own])])[np.searchsorted(own, doc)]
            at, key = windows(flat, doc, g)
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            unique, first = np.unique(key, return_index=True)
            bitmap = np.zeros(1 << 20, bool)
            bitmap[unique >> U(44)] = True
            self.grams[g] = (unique, np.append(first, len(key)), doc[at], at - start[at], bitmap)
        flat = np.concatenate(self.words) if self.words else np.zeros(0, U)
        keys = self.embed(flat, np.cumsum(self.sizes) - self.sizes, self.sizes, self.sizes)
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys = keys.ravel()[order]
        self.key_items = np.repeat(np.arange(len(self.words)), keys.shape[1])[order]

    def embed(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Keys (rows x walks * tables) of the runs flat[start : start + length], read as windows of some size; alike sizes side by side, as many as ``HELD`` allows."""
        p = self.parameters
        out = np.empty((len(start), p.walks * p.tables), U)
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            # steps x walks numbers a row; the longest of a group is at most twice its shortest
            shortest = int(size[order[at]])
            end = int(np.searchsorted(size[order], 2 * max(shortest, 16), side="right"))
            end = at + max(1, min(end - at, HELD // (2 * int(size[order[end - 1]]) * p.walks + 1)))
            own = order[at:end]
            out[own] = self._walk(flat, start[own], length[own], size[own])
            at = end
        return out

    def _walk(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray, size: np.ndarray) -> np.ndarray:
        p = self.parameters
        c, steps = len(start), int(2 * size.max(initial=0))
        at = np.zeros((c, p.walks), np.int64)
        out = np.empty((steps, c, p.walks), U)
        keys_of_step = mix(np.arange(1, (steps + 1) * p.walks + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(p.seed)).reshape(-1, p.walks)
        top, begin, end = max(len(flat) - 1, 0), start[:, None], length[:, None]
        for j in range(steps):
            symbol = np.where(at < end, flat[np.minimum(begin + at, top)], _PAD) if len(flat) else np.full(at.shape, _PAD, U)
            out[j] = symbol
            z = (symbol ^ keys_of_step[j]) * U(0xFF51AFD7ED558CCD)
            at += ((z ^ (z >> U(29))) * U(0xC4CEB9FE1A85EC53) >> U(63)).astype(np.int64)
        result = np.empty((c, p.walks, p.tables), U)
        for n in np.unique(size):
            own = np.flatnonzero(size == n)
            rng = np.random.default_rng([p.seed, int(n)])
            picks = rng.integers(0, max(2 * n, 1), (p.walks, p.tables, p.bits))
            for w in range(p.walks):
                for t in range(p.tables):
                    h = np.full(len(own), n * 1_000_003 + w * 101 + t, dtype=np.uint64)
                    for b in range(p.bits):
                        h = mix(h ^ out[picks[w, t, b], own, w])
                    result[own, w, t] = h
        return result.reshape(c, -1)

    def search(self, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text of the slice, item, first word within the text, distance) of every item that a text holds."""
        starts, docs, item = [], [], []
        for g, (unique, bounds, gram_item, gram_at, bitmap) in self.grams.items():
            at, key = windows(h, w.doc, g)
            maybe = bitmap[key >> U(44)]
            at, key = at[maybe], key[maybe]
            pos = np.searchsorted(unique, key)
            hit = (pos < len(unique)) & (unique[np.minimum(pos, len(unique) - 1)] == key)
            at, pos = at[hit], pos[hit]
            count = bounds[pos + 1] - bounds[pos]
            k = np.repeat(bounds[pos], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            starts.append(np.repeat(at, count) - gram_at[k])
            docs.append(np.repeat(w.doc[at], count))
            item.append(gram_item[k])
        none = np.zeros(0, np.int64)
        if not starts or not sum(map(len, starts)):
            return none, none, none, none
        start, doc, item = np.concatenate(starts), np.concatenate(docs), np.concatenate(item)
        seen = self._proposed(w, doc, start, self.sizes[item])
        found = [self._verify(w, h, seen[i : i + 4096]) for i in range(0, len(seen), 4096)]
        doc, item, start, distance = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((start, distance, item, doc))
        doc, item, start, distance = doc[order], item[order], start[order], distance[order]
        best = np.ones(len(doc), bool)
        best[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        return doc[best], item[best], (start - w.first[doc])[best], distance[best]

    def _proposed(self, w: Words, doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(text, first word, size) of every window that unbalanced edits can shift a run to: each one once."""
        shift = self.parameters.edits(size) // 2
        lo = w.first[doc]
        top = np.maximum(w.first[doc + 1] - size, lo)
        # intervals of starts, side by side for each size, are merged before they are spread out
        n = len(w) + 1
        a = np.clip(start - shift, lo, top) + size * n
        b = np.clip(start + shift, lo, top) + size * n
        order = np.argsort(a, kind="stable")
        a, b = a[order], np.maximum.accumulate(b[order])
        first = np.concatenate([[True], a[1:] > b[:-1]])
        a, b = a[first], b[np.append(np.flatnonzero(first)[1:] - 1, len(b) - 1)]
        count = b - a + 1
        at = np.repeat(a - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.stack([w.doc[at % n], at % n, at // n], 1)

    def _verify(self, w: Words, h: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, ...]:
        doc, start, size = seen.T
        length = np.minimum(size, w.first[doc + 1] - start)
        keys = self.embed(h, start, length, size)
        lo, hi = np.searchsorted(self.keys, keys.ravel(), "left"), np.searchsorted(self.keys, keys.ravel(), "right")
        count = hi - lo
        row = np.repeat(np.repeat(np.arange(len(doc)), keys.shape[1]), count)
        k = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pair = np.unique(row * len(self.words) + self.key_items[k])
        row, item = pair // max(len(self.words), 1), pair % max(len(self.words), 1)
        same = self.sizes[item] == size[row]
        row, item = row[same], item[same]
        distance = np.zeros(len(row), np.int64)
        for n in np.unique(size[row]).tolist():
            own, step = np.flatnonzero(size[row] == n), max(1, HELD // (8 * (n + 1)))
            for i in range(0, len(own), step):
                part = own[i : i + step]
                r = row[part]
                padded = np.where(np.arange(n) < length[r][:, None], h[np.minimum(start[r][:, None] + np.arange(n), len(h) - 1)], _PAD)
                distance[part] = edit_distances(padded, length[r], np.stack([self.words[x] for x in item[part]]))
        ok = distance <= self.parameters.edits(size[row])
        return doc[row][ok], item[ok], start[row][ok], distance[ok]


def edit_distances(a: np.ndarray, length: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of the first length[i] words of a[i] to the whole of b[i]."""
    n = b.shape[1]
    ramp = np.arange(n + 1)
    row = np.broadcast_to(ramp, (len(a), n + 1)).astype(np.int64)
    result = np.where(length == 0, n, 0)
    for i in range(a.shape[1]):
        step = np.empty_like(row)
        step[:, 0] = i + 1
        step[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (b != a[:, i : i + 1]))
        row = np.minimum.accumulate(step - ramp, axis=1) + ramp
        result = np.where(length == i + 1, row[:, n], result)
    return result


#: Edited copies of each class of lengths that the number of walks is chosen by, and walks that are tried on each.
TRIALS, TRIED_WALKS = 192, 64


def edited_copy(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """``words`` after so many edits that leave their number as it is: as many insertions as deletions, the rest replacements."""
    moves = int(rng.integers(0, edits // 2 + 1))
    at = rng.permutation(len(words))[:edits]
    copies = np.ones(len(words), np.int64)
    copies[at[:moves]], copies[at[moves : 2 * moves]] = 2, 0
    out = words.copy()
    out[at[2 * moves :]] = rng.integers(0, 1 << 62, edits - 2 * moves)
    out = np.repeat(out, copies)
    fresh = (np.cumsum(copies) - copies)[at[:moves]]
    out[fresh] = rng.integers(0, 1 << 62, moves)
    return out


def walks_needed(words: list[np.ndarray], p: LeakParameters) -> int:
    """The least number of walks whose keys find ``target_recall`` of copies with as many edits as the threshold allows, in each class of lengths (by powers of two)."""
    octave = np.array([len(w).bit_length() for w in words])
    return max((_walks_needed([words[i] for i in np.flatnonzero(octave == o)], p) for o in np.unique(octave)), default=1)


def _walks_needed(words: list[np.ndarray], p: LeakParameters) -> int:
    rng = np.random.default_rng([p.seed, 77])
    picked = [words[i] for i in rng.integers(0, len(words), TRIALS)]
    index = LeakIndex.__new__(LeakIndex)
    index.parameters = replace(p, walks=TRIED_WALKS)
    size = np.array([len(w) for w in picked], np.int64)
    begin = np.cumsum(size) - size
    edited = [edited_copy(w, int(p.edits(len(w))), rng) for w in picked]
    keys = [index.embed(np.concatenate(x), begin, size, size) for x in (picked, edited)]
    same = (keys[0] == keys[1]).reshape(TRIALS, TRIED_WALKS, p.tables).any(2)
    # a copy's chance a walk, drawn towards the mean of all so that none counts as impossible
    chance = (same.sum(1) + same.mean() * 4) / (TRIED_WALKS + 4)
    for n in range(1, 256):
        if (1 - (1 - chance) ** n).mean() >= p.target_recall:
            return n
    return 256


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, w, h in lower_words(pa.array(texts, pa.string())):
        out += [h[w.first[i] : w.first[i + 1]] for i in range(len(w.first) - 1)]
    return out


def blocks(benchmark: DataFrame, parameters: LeakParameters) -> Iterator[LeakIndex]:
    """The benchmark's items, block by block: a block is what its hash says, and has about BLOCK_WORDS words."""
    items = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text"))
    words = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(max(1, -(-words // (4 * BLOCK_WORDS))))
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        rows = part.collect()  # a block: bounded by BLOCK_WORDS
        found = [(r["item_id"], w) for r, w in zip(rows, item_words([r["text"] for r in rows]), strict=True) if len(w) >= parameters.min_words]
        if found:
            yield LeakIndex(parameters, [x for x, _ in found], [w for _, w in found])


def _found(spark: SparkSession, documents: DataFrame, index: LeakIndex) -> DataFrame:
    shared = spark.sparkContext.broadcast(index)
    picked = documents.select("doc_id", F.col("text").cast("string").alias("__text"))
    schema = extended(picked.drop("__text").schema, "item_id bigint, start_word bigint, item_words bigint, distance bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        ids = np.array([-1 if x is None else x for x in index.items], np.int64)
        void = np.array([x is None for x in index.items])
        for b in batches:
            for lo, _, w, h in lower_words(b.column(1)):
                doc, item, start, distance = index.search(w, h)
                if len(doc):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc + lo)), pa.array(ids[item], mask=void[item]), pa.array(start), pa.array(index.sizes[item]), pa.array(distance)], names=[f.name for f in schema])

    return picked.mapInArrow(run, schema)


def leaks(documents: DataFrame, benchmark: DataFrame, parameters: LeakParameters | None = None) -> DataFrame:
    """(doc_id, item_id, start_word, item_words, distance): a row for each document and each item that it holds."""
    spark = documents.sparkSession
    batch_limit(spark)
    out: DataFrame | None = None
    for index in blocks(benchmark, parameters or LeakParameters()):
        found = _found(spark, documents, index)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], extended(documents.select("doc_id").schema, "item_id bigint, start_word bigint, item_words bigint, distance bigint"))
    return out


def remove_leaks(documents: DataFrame, benchmark: DataFrame, parameters: LeakParameters | None = None) -> DataFrame:
    """``documents`` without the rows that hold an item. Rows are judged where they are: no join.

    Null and empty texts hold nothing and stay; repeated rows are judged each by itself; an empty table, or an empty benchmark, takes nothing away; all columns, whatever their names, come back as they were.
    """
    spark = documents.sparkSession
    batch_limit(spark)
    names = documents.columns
    rows = documents.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)], F.col("text").cast("string").alias("__text"))
    for index in blocks(benchmark, parameters or LeakParameters()):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for lo, _, w, h in lower_words(b.column(b.num_columns - 1)):
                    keep[shared.value.search(w, h)[0] + lo] = False
                yield b.filter(pa.array(keep))

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)])
