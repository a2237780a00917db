"""Language ID: an interpolated Kneser-Ney character model for each language, kept in sorted hash arrays.

Text is lower-cased; every run of other characters than letters is one space, and a space stands at both ends. A model has runs of up to ``ORDER`` = 4
characters (16 bits each, so that a run is one 64-bit key; characters beyond 16 bits are folded). The highest order counts runs, lower ones count distinct left neighbours;
absolute discounts are estimated from the counts of counts, and the lowest order is interpolated with the uniform distribution.

The sorted arrays hold all languages side by side: one search of a run's key answers for every language; runs that a language has not seen back
off through its context's weight. A document's distinct runs are looked up once, and its cross-entropy under each language is their
weighted mean. The lowest one wins. The score is its share of exp(-steepness * cross-entropy) among the languages, the steepness being fitted on
labelled texts that the counts left out; ``rejected`` is a text whose cross-entropy exceeds the mean of its language by more than that of ``REJECT`` of those texts does.

All training texts are counted but for those that calibrate, ``max_calibrating`` of each language at most, so that the model grows with the corpus; counts are summed by partition before
they are shuffled. Scoring reads whole texts.

No run leaves the model. Up to ``max_runs`` of them it is held in memory; beyond, it is estimated by aggregates and joins into tables, memory holds the most frequent runs with their whole
probabilities, and what texts have besides is looked up in the tables: the distinct runs of a block of texts move, and the texts' numbers of them, not the texts. Both give the same cross-entropies but for rounding.

Defined results: null texts and texts without a letter are `und` with score 0; ties go to the first language in order of code points; training rows without id or language are left out;
without any training text all is `und`; repeated rows are scored each by itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import batch_limit, extended, id_remainder, slices, written

ORDER = 4
REJECT = 0.99
UNKNOWN = "und"
#: Bytes that are looked up at once.
SLICE = 1 << 20
#: Values (runs to look up, sums) of the slices that look up their runs together.
BLOCK = 1 << 22
_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which 16-bit code points are letters (surrogates aside)."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(1 << 16)])
    return _LETTER


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, text) of a slice of lower-cased UTF-8: letters as 16 bits, other runs as one 32; a 32 begins and ends each text that has a letter."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    b = data.astype(np.uint32)
    pad = np.concatenate([b, np.zeros(3, np.uint32)])
    c0, c1, c2, c3 = (pad[at + i] for i in range(4))
    point = np.where(c0 < 0x80, c0, np.where(c0 < 0xE0, ((c0 & 31) << 6) | (c1 & 63), np.where(c0 < 0xF0, ((c0 & 15) << 12) | ((c1 & 63) << 6) | (c2 & 63), ((c0 & 7) << 18) | ((c1 & 63) << 12) | ((c2 & 63) << 6) | (c3 & 63))))
    text = np.searchsorted(offsets, at, side="right") - 1
    high = point > 0xFFFF
    is_letter = letters()[np.minimum(point, 0xFFFF)]
    if high.any():
        own = np.unique(point[high])
        is_letter[high] = np.array([chr(int(x)).isalpha() for x in own])[np.searchsorted(own, point[high])]
        point = np.where(high, 0xD800 | (point & 0x7FF), point)
    # a space before a letter that follows something else, or opens its text; one after a text's last letter
    at = np.flatnonzero(is_letter)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    point, text = point[at].astype(np.uint64), text[at]
    gap = np.ones(len(at), bool)
    gap[1:] = (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])
    ends = np.ones(len(at), bool)
    ends[:-1] = text[1:] != text[:-1]
    size = 1 + gap.astype(np.int64) + ends
    place = np.cumsum(size) - 1 - ends  # of the letter itself
    out = np.full(int(size.sum()), 32, np.uint64)
    out[place] = point
    return out, np.repeat(text, size)


def runs(symbol: np.ndarray, text: np.ndarray, n: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of each run of n symbols of one text; the first symbols of a text have shorter contexts, filled with zeros."""
    key = np.zeros(len(symbol), np.uint64)
    for back in range(n - 1, -1, -1):
        part = np.zeros(len(symbol), np.uint64)
        if back < len(symbol):
            part[back:] = symbol[: len(symbol) - back] * (text[back:] == text[: len(text) - back])
        key = (key << np.uint64(16)) | part
    return key, text


@dataclass
class RunTables:
    """A model's runs in the shared folder, keys as signed 64 bits; values by the language's number."""

    runs: list[DataFrame]  # order 1 .. ORDER: k, v map<int, double>, the log probabilities
    contexts: list[DataFrame]  # order 2 .. ORDER: x, w map<int, double>, the log weights of the lower order


@dataclass
class LanguageModel:
    languages: list[str]
    keys: list[np.ndarray]  # order 1 .. ORDER: sorted keys
    logs: list[np.ndarray]  # the runs' log probabilities, a row a key, a column a language; nan: not seen
    contexts: list[np.ndarray]  # order 2 .. ORDER: sorted contexts
    backoff: list[np.ndarray]  # their log weights of the lower order; 0 if not seen
    floor: np.ndarray
    steepness: float = 20.0
    limit: np.ndarray | None = None
    #: Where all runs are, if memory has but the most frequent ones of the highest order, with the probabilities of all languages.
    tables: RunTables | None = None

    def log_probabilities(self, key: np.ndarray) -> np.ndarray:
        """A row a key (of ORDER symbols), a column a language."""
        out = np.full((len(key), len(self.languages)), np.nan)
        weight = np.zeros_like(out)
        for n in range(ORDER, 0, -1):
            mask = np.uint64((1 << (16 * n)) - 1)
            own, found = _find(self.keys[n - 1], key & mask)
            got = np.where(found[:, None], self.logs[n - 1][own] if len(self.keys[n - 1]) else np.nan, np.nan)
            out = np.where(np.isnan(out), weight + got, out)
            if n > 1 and len(self.contexts[n - 2]):
                at, found = _find(self.contexts[n - 2], (key & mask) >> np.uint64(16))
                weight = weight + np.where(found[:, None], self.backoff[n - 2][at], 0.0)
        return np.where(np.isnan(out), weight + self.floor, out)

    def cross_entropy(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nats a symbol under each language, symbols) of each text of a slice."""
        n = len(offsets) - 1
        symbol, text = symbols(data, offsets)
        count = np.bincount(text, minlength=n)
        if not len(symbol) or not self.languages:
            return np.zeros((n, len(self.languages))), count
        key, _ = runs(symbol, text)
        # the opening space of a text predicts nothing
        first = np.ones(len(text), bool)
        first[1:] = text[1:] != text[:-1]
        unique, inverse = np.unique(key, return_inverse=True)
        logs = self.log_probabilities(unique)
        total = np.stack([np.bincount(text, weights=np.where(first, 0.0, logs[inverse, i]), minlength=n) for i in range(logs.shape[1])], 1)
        return -total / np.maximum(count - 1, 1)[:, None], count

    def known_part(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(log probabilities summed over the runs in memory, symbols) of each text of a slice, the slice's other runs, and (text, number of the run, times) of these, by text and run."""
        n = len(offsets) - 1
        symbol, text = symbols(data, offsets)
        count = np.bincount(text, minlength=n)
        key, _ = runs(symbol, text)
        opens = np.ones(len(text), bool)
        opens[1:] = text[1:] != text[:-1]
        key, text = key[~opens], text[~opens]
        unique, inverse = np.unique(key, return_inverse=True)
        at, found = _find(self.keys[-1], unique)
        held = found[inverse]
        total = np.zeros((n, len(self.languages)))
        if held.any():
            row, of = at[inverse[held]], text[held]
            total = np.stack([np.bincount(of, weights=self.logs[-1][row, i], minlength=n) for i in range(total.shape[1])], 1)
        other, number = unique[~found], np.cumsum(~found) - 1
        width = max(len(other), 1)
        pair, times = np.unique(text[~held] * width + number[inverse[~held]], return_counts=True)
        return total, count, other, pair // width, pair % width, times


def _find(known: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    return at, known[at] == key


def _discount(counts: np.ndarray) -> float:
    return _discount_of((counts == 1).sum(), (counts == 2).sum())


def _discount_of(one: int, two: int) -> float:
    return float(min(max(one / max(one + 2 * two, 1), 0.05), 0.95))


def estimate(languages: list[str], counted: list[tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
    """Interpolated Kneser-Ney models from each language's (runs of ORDER symbols, counts)."""
    per_order: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(ORDER)]
    floors = []
    for key, count in counted:
        order = np.argsort(key)
        key, count = key[order], count[order].astype(np.float64)
        tables = {ORDER: (key, count)}
        for n in range(ORDER - 1, 0, -1):  # distinct left neighbours
            k, c = np.unique(tables[n + 1][0] & np.uint64((1 << (16 * n)) - 1), return_counts=True)
            tables[n] = (k, c.astype(np.float64))
        k, c = tables[1]
        floors.append(-np.log(len(k) + 1.0))
        d = _discount(c)
        lower = (c - d) / c.sum() + d * len(k) / c.sum() / (len(k) + 1.0)
        floors[-1] += np.log(d * len(k) / c.sum())
        per_order[0].append((k, np.log(lower), k[:0], lower[:0]))
        below = (k, lower)
        for n in range(2, ORDER + 1):
            k, c = tables[n]
            d = _discount(c)
            context, first, inverse, kinds = np.unique(k >> np.uint64(16), return_index=True, return_inverse=True, return_counts=True)
            sums = np.bincount(inverse, weights=c)
            weight = d * kinds / sums
            at, _ = _find(below[0], k & np.uint64((1 << (16 * (n - 1))) - 1))
            p = np.maximum(c - d, 0) / sums[inverse] + weight[inverse] * below[1][at]
            per_order[n - 1].append((k, np.log(p), context, np.log(weight)))
            below = (k, p)

    def side_by_side(parts: list[tuple[np.ndarray, np.ndarray]], missing: float) -> tuple[np.ndarray, np.ndarray]:
        known = np.unique(np.concatenate([k for k, _ in parts])) if parts else np.zeros(0, np.uint64)
        out = np.full((len(known), len(parts)), missing)
        for i, (k, v) in enumerate(parts):
            out[np.searchsorted(known, k), i] = v
        return known, out

    keys, logs = zip(*[side_by_side([(x[0], x[1]) for x in level], np.nan) for level in per_order], strict=True)
    contexts, backoff = zip(*[side_by_side([(x[2], x[3]) for x in level], 0.0) for level in per_order[1:]], strict=True)
    return LanguageModel(languages, list(keys), list(logs), list(contexts), list(backoff), np.array(floors))


def _suffix(column: str, n: int) -> Column:
    """The last n symbols of a key."""
    return F.col(column) if n == ORDER else F.col(column).bitwiseAND(F.lit((1 << (16 * n)) - 1))


def estimate_tables(counted: DataFrame, languages: list[str]) -> LanguageModel:
    """What ``estimate`` does, by aggregates and joins, from (l, k, c): language number, run, count. A key of a join has a symbol's variety of rows at most."""
    spark = counted.sparkSession
    level = {ORDER: counted}
    for n in range(ORDER - 1, 0, -1):  # distinct left neighbours
        level[n] = written(level[n + 1].groupBy("l", _suffix("k", n).alias("k")).agg(F.count("*").alias("c")), "language-runs")
    own = {n: sorted(t.groupBy("l").agg(F.count("*").alias("kinds"), F.sum("c").alias("total"), F.count_if(F.col("c") == 1).alias("one"), F.count_if(F.col("c") == 2).alias("two")).collect()) for n, t in level.items()}

    def by_language(name: str, parts: DataFrame, key: str, value: str) -> DataFrame:
        return written(parts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", F.log(value)))).alias(name)), "language-model")

    floors, run_tables, context_tables, below = [], [], [], None
    for n in range(1, ORDER + 1):
        rows = [(r["l"], i, _discount_of(r["one"], r["two"]), float(r["kinds"]), float(r["total"])) for i, r in enumerate(own[n])]
        t = level[n].join(F.broadcast(spark.createDataFrame(rows, "l bigint, i int, d double, kinds double, total double")), "l")  # a row a language
        if below is None:
            floors = [np.log(d * kinds / total) - np.log(kinds + 1.0) for _, _, d, kinds, total in rows]
            p = t.select("i", "k", ((F.col("c") - F.col("d")) / F.col("total") + F.col("d") * F.col("kinds") / F.col("total") / (F.col("kinds") + 1.0)).alias("p"))
        else:
            t = t.select("i", "k", "c", "d", F.shiftrightunsigned("k", 16).alias("x"), _suffix("k", n - 1).alias("s"))
            contexts = written(t.groupBy("i", "x").agg(F.sum("c").alias("sum"), (F.first("d") * F.count("*")).alias("w")).select("i", "x", "sum", (F.col("w") / F.col("sum")).alias("w")), "language-contexts")
            context_tables.append(by_language("w", contexts, "x", "w"))
            p = t.join(contexts, ["i", "x"]).join(below.withColumnsRenamed({"k": "s", "p": "lower"}), ["i", "s"])
            p = p.select("i", "k", (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("sum") + F.col("w") * F.col("lower")).alias("p"))
        below = written(p, "language-probabilities")
        run_tables.append(by_language("v", below, "k", "p"))
    names = [languages[r["l"]] for r in own[ORDER]]
    nothing = np.zeros(0, np.uint64)
    return LanguageModel(names, [nothing] * ORDER, [np.zeros((0, len(names)))] * ORDER, [nothing] * (ORDER - 1), [np.zeros((0, len(names)))] * (ORDER - 1), np.array(floors), tables=RunTables(run_tables, context_tables))


def looked_up(keys: DataFrame, model: LanguageModel) -> DataFrame:
    """(k, logs) of distinct runs k, which are written: a log probability a language, from the model's tables."""
    assert model.tables is not None
    below = None
    for n in range(1, ORDER + 1):
        own = keys if n == ORDER else keys.select(_suffix("k", n).alias("k")).distinct()
        own = own.join(model.tables.runs[n - 1], "k", "left")
        if below is None:
            logs = F.transform(F.array(*[F.lit(float(x)) for x in model.floor]), lambda p, i: F.coalesce(F.try_element_at("v", i), p))
        else:
            own = own.withColumns({"x": F.shiftrightunsigned("k", 16), "s": _suffix("k", n - 1)})
            own = own.join(model.tables.contexts[n - 2], "x", "left").join(below.withColumnsRenamed({"k": "s", "logs": "lower"}), "s")
            logs = F.transform("lower", lambda p, i: F.coalesce(F.try_element_at("v", i), F.coalesce(F.try_element_at("w", i), F.lit(0.0)) + p))
        below = own.select("k", logs.alias("logs"))
    return below


def lowered(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    return slices(pc.utf8_lower(column.cast(pa.large_string())), SLICE)


def fit_languages(train: DataFrame, max_calibrating: int = 2000, max_runs: int = 1 << 24) -> LanguageModel:
    """Fits on every row of ``train`` (doc_id, text, lang): all count, but for about ``max_calibrating`` texts a language (a tenth of them at most), which calibrate.

    The counts grow with the distinct runs of the corpus, and all of them make the model. Should they exceed ``max_runs`` for all languages together, it lies in tables, and memory
    holds ``max_runs`` probabilities at most: those of the runs with the highest counts, by the least count that keeps within the bound.
    """
    spark = train.sparkSession
    batch_limit(spark)
    named = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    draw = (F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("draw")
    # the text with the largest draw always counts, so that no language is without counts
    sizes = {r["lang"]: r for r in named.groupBy("lang").agg(F.count("*").alias("n"), F.max(draw).alias("last")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], [], [], [], [], np.zeros(0))
    rows = [(k, i, min(0.1, max_calibrating / sizes[k]["n"]), sizes[k]["last"]) for i, k in enumerate(languages)]
    known = F.broadcast(spark.createDataFrame(rows, "lang string, l bigint, share double, last double"))  # a row a language
    tagged = named.withColumn("draw", draw).join(known, "lang").withColumn("calibrates", (F.col("draw") < F.col("share")) & (F.col("draw") < F.col("last")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        fresh: dict[int, list[np.ndarray]] = {}

        def settle(k: int) -> None:
            keys, counts = np.unique(np.concatenate(fresh.pop(k)), return_counts=True)
            if k in total:
                both, inverse = np.unique(np.concatenate([total[k][0], keys]), return_inverse=True)
                counts = np.bincount(inverse, weights=np.concatenate([total[k][1], counts])).astype(np.int64)
                keys = both
            total[k] = [keys, counts]

        for b in batches:
            lang = b.column(0).to_numpy()
            for lo, hi, data, offsets in lowered(b.column(1)):
                symbol, text = symbols(data, offsets)
                key, _ = runs(symbol, text)
                opens = np.ones(len(text), bool)
                opens[1:] = text[1:] != text[:-1]
                key, of = key[~opens], lang[lo:hi][text[~opens]]
                for k in np.unique(of).tolist():
                    fresh.setdefault(k, []).append(key[of == k])
                    if sum(map(len, fresh[k])) > 1 << 22:
                        settle(k)
        for k in list(fresh):
            settle(k)
        for k, (keys, counts) in total.items():
            for i in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_pydict({"l": pa.array(np.full(len(keys[i : i + (1 << 16)]), k, np.int64)), "k": pa.array(keys[i : i + (1 << 16)].view(np.int64)), "c": pa.array(counts[i : i + (1 << 16)])})

    counted = written(tagged.where(~F.col("calibrates")).select("l", "text").mapInArrow(count, "l bigint, k bigint, c bigint").groupBy("l", "k").agg(F.sum("c").alias("c")), "language-runs")
    if counted.count() > max_runs:
        model = estimate_tables(counted, languages)
        _hold_frequent(model, counted, max_runs)
        _calibrate(model, tagged.where("calibrates").select("lang", "text"))
        return model
    found = counted.toArrow()  # max_runs rows at most
    l, k, c = (found.column(x).to_numpy() for x in ("l", "k", "c"))
    order = np.lexsort((k, l))
    l, k, c = l[order], k[order], c[order]
    present = [i for i in range(len(languages)) if (l == i).any()]
    if not present:
        return LanguageModel([], [], [], [], [], np.zeros(0))
    model = estimate([languages[i] for i in present], [(k[l == i].view(np.uint64), c[l == i]) for i in present])
    _calibrate(model, tagged.where("calibrates").select("lang", "text"))
    return model


def _hold_frequent(model: LanguageModel, counted: DataFrame, max_runs: int) -> None:
    totals = written(counted.groupBy("k").agg(F.sum("c").alias("c")), "language-totals")
    least, room = None, max_runs // len(model.languages)
    for r in totals.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toLocalIterator():
        room -= r["n"]
        if room < 0:
            break
        least = r["c"]
    if least is None:
        return
    found = looked_up(written(totals.where(F.col("c") >= least).select("k"), "language-frequent"), model).toArrow()  # max_runs probabilities at most
    key, logs = _logs(found, len(model.languages))
    model.keys[-1], model.logs[-1] = key, logs


def _logs(found: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their rows of (k, logs)."""
    key = found.column("k").to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], found.column("logs").combine_chunks().flatten().to_numpy().reshape(-1, width)[order]


def _calibrate(model: LanguageModel, texts: DataFrame) -> None:
    """Steepness by the least log loss, rejection limits by a quantile of texts that the counts left out (max_calibrating a language).

    A text's excess is its cross-entropy over the mean of its language. The limit is the excess that ``REJECT`` of all calibrating texts stay under, at rank ceil((n + 1) REJECT), the
    largest excess where there are too few for that: all languages share it.
    """
    scored = cross_entropies(texts, model, ["lang"]).where(F.col("symbols") > 0).toArrow()
    model.limit = np.full(len(model.languages), np.inf)
    if not scored.num_rows:
        return
    ce = scored.column("ce").combine_chunks().flatten().to_numpy().reshape(scored.num_rows, -1)
    number = {x: i for i, x in enumerate(model.languages)}
    true = np.array([number.get(x, -1) for x in scored.column("lang").to_pylist()])
    order = np.lexsort((*ce.T, true))  # the same sums in the same order, however the rows arrive
    ce, true = ce[order][true[order] >= 0], true[order][true[order] >= 0]
    if not len(true):
        return
    own = ce[np.arange(len(true)), true]
    n = np.bincount(true, minlength=len(model.languages))
    mean = np.where(n > 0, np.bincount(true, weights=own, minlength=len(model.languages)) / np.maximum(n, 1), own.mean())
    excess = np.sort(own - mean[true])
    model.limit = mean + excess[min(len(excess), int(np.ceil((len(excess) + 1) * REJECT))) - 1]

    def loss(s: float) -> float:
        z = -s * (ce - ce.min(1, keepdims=True))
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(true)), true]))

    model.steepness = float(min((1, 2, 4, 7, 10, 15, 20, 30, 50), key=loss))


def cross_entropies(documents: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """Columns ``keep``, ``ce`` (a value a language) and ``symbols`` (0: no letter)."""
    spark = documents.sparkSession
    batch_limit(spark)
    shared = spark.sparkContext.broadcast(replace(model, tables=None))  # max_runs runs at most
    picked = documents.select(*[F.col(x) for x in keep], F.col("text").cast("string").alias("__text"))
    schema = extended(picked.drop("__text").schema, "ce array<double>, symbols bigint")
    if model.tables is not None:
        return _from_tables(picked, model, shared, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo, hi, data, offsets in lowered(b.column(b.num_columns - 1)):
                ce, count = m.cross_entropy(data, offsets)
                width = ce.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo) * width + 1, width, dtype=np.int32) if width else np.zeros(hi - lo + 1, np.int32)), pa.array(ce.ravel()))
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns[:-1], lists, pa.array(count)], names=[*b.schema.names[:-1], "ce", "symbols"])

    return picked.mapInArrow(run, schema)


def _lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * width).astype(np.int32)), pa.array(values.ravel()))


def _from_tables(picked: DataFrame, model: LanguageModel, shared: Broadcast, schema: StructType) -> DataFrame:
    """Cross-entropies if memory has but the frequent runs: the others of a block of slices meet the tables, once each, and come back to the block's sums."""
    width = len(model.languages)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, block = shared.value, TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        values = 0

        def settle() -> Iterator[pa.RecordBatch]:
            others = np.unique(np.concatenate([x[3] for x in held]))
            for i, (columns, total, count, other, at, number, times) in enumerate(held):
                n = len(count)
                number = np.searchsorted(others, other)[number]
                step = np.diff(number, prepend=0)
                opens = at[:-1][at[1:] > at[:-1]]
                step[opens] = number[opens]
                packed = [pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((at * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in ((step & 255).astype(np.uint8), (step >> 8).astype(np.int32), times)]
                own = others if i == 0 else others[:0]
                first = pa.ListArray.from_arrays(pa.array(np.where(np.arange(n + 1) > 0, len(own), 0).astype(np.int32)), pa.array(own.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*columns, _lists(total), pa.array(count), pa.array(np.full(n, block)), first, *packed], names=names)

        for b in batches:
            names = [*b.schema.names[:-1], "ce", "symbols", "__block", "__others", "__low", "__high", "__times"]
            for lo, hi, data, offsets in lowered(b.column(b.num_columns - 1)):
                total, count, other, text, number, times = m.known_part(data, offsets)
                own = pa.array(np.arange(lo, hi))  # copies: a slice of the batch would keep its texts
                held.append(([x.take(own) for x in b.columns[:-1]], total, count, other, np.searchsorted(text, np.arange(hi - lo + 1)), number.astype(np.int32), times.astype(np.int32)))
                values += 2 * len(number) + total.size
                if values > BLOCK:
                    yield from settle()
                    held, values, block = [], 0, block + 1
        if held:
            yield from settle()

    def add(texts: pa.Table, found: pa.Table) -> pa.Table:
        _, logs = _logs(found, width)
        total = texts.column("ce").combine_chunks().flatten().to_numpy().reshape(-1, width).copy()
        for i, (low, high, times) in enumerate(zip(*(texts.column(x) for x in ("__low", "__high", "__times")), strict=True)):
            number = np.cumsum(np.frombuffer(low.as_buffer(), np.uint8) + (np.frombuffer(high.as_buffer(), np.int32).astype(np.int64) << 8))
            # row by row, so that equal languages stay equal
            total[i] += (np.frombuffer(times.as_buffer(), np.int32)[:, None] * logs[number]).sum(0)
        ce = -total / np.maximum(texts.column("symbols").to_numpy() - 1, 1)[:, None]
        return texts.drop_columns(["__block", "__low", "__high", "__times"]).set_column(texts.schema.get_field_index("ce"), "ce", _lists(ce))

    # written, so that a block keeps its number; its first row has its runs, sorted; each row has the steps between the numbers of its own
    partial = written(picked.mapInArrow(sums, extended(schema, "__block bigint, __others array<bigint>, __low binary, __high binary, __times binary")), "language-sums")
    asked = written(partial.select("__block", F.explode("__others").alias("k")), "language-asked")
    found = asked.join(looked_up(written(asked.select("k").distinct(), "language-asked-runs"), model), "k").select("__block", "k", "logs")
    return partial.drop("__others").groupBy("__block").cogroup(found.groupBy("__block")).applyInArrow(add, schema)


def identify(documents: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """Columns ``keep``, lang_pred, score, cross_entropy, rejected."""
    none = (F.col("symbols") == 0) | F.lit(not model.languages)
    best = F.array_min("ce")
    i = F.array_position("ce", best).cast("int")
    names, limits = F.array(*[F.lit(x) for x in model.languages or [UNKNOWN]]), F.array(*[F.lit(float(x)) for x in (model.limit if model.limit is not None and model.languages else [np.inf])])
    share = 1 / F.aggregate("ce", F.lit(0.0), lambda a, x: a + F.exp(-F.lit(model.steepness) * (x - best)))
    scored = cross_entropies(documents, model, keep)
    return scored.select(*keep, F.when(none, UNKNOWN).otherwise(F.get(names, i - 1)).alias("lang_pred"), F.when(none, 0.0).otherwise(F.least(share, F.lit(1.0))).alias("score"), F.when(~none, best).alias("cross_entropy"), F.when(none, True).otherwise(best > F.get(limits, i - 1)).alias("rejected"))


def predict_languages(documents: DataFrame, max_calibrating: int = 2000, max_runs: int = 1 << 24) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, rejected) of every row, learnt from rows whose id is not held out."""
    held = F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False))
    model = fit_languages(documents.where(~held), max_calibrating, max_runs)
    return identify(documents, model, ["doc_id"]).withColumn("held_out", held)
