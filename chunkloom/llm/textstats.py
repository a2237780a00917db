"""Statistics of whole texts, for the quality classifier and the quality rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch_limit, extended, slices
from .textkit import BASE, BYTE, Words, covered, per_doc, prefix, repeated, span_hash, windows

SYMBOLS = b"#*$%&|<>"
_SYMBOL, _UPPER, _LOWER, _DIGIT, _PUNCT, _STOP, _HIGH, _BANG = (np.zeros(256, np.uint8) for _ in range(8))
_SYMBOL[list(SYMBOLS)] = 1
_UPPER[65:91] = 1
_LOWER[97:123] = 1
_DIGIT[48:58] = 1
_PUNCT[[i for i in range(33, 127) if not chr(i).isalnum()]] = 1
_STOP[list(b".!?")] = 1
_BANG[list(b"!")] = 1
_HIGH[128:] = 1
_LEAD = np.ones(256, np.uint8)
_LEAD[0x80:0xC0] = 0  # continuation bytes

#: Counts, exact and as the quality rules' contract words them.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Shares and logarithms that both learners use; none of them knows a label, a language, a source or an id.
RATIOS = [
    "log_words", "mean_word", "sd_word", "long_words", "symbol_share", "upper_share", "digit_share", "punct_share",
    "stop_share", "bang_share", "high_share", "space_share", "symbol_words", "punct_words", "bare_punct_words", "upper_words",
    "unique_words", "dup_line_share", "repeat_word_share", "log_line", "lines_stopped", "short_words",
]


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, ratios) of each text of a slice; an empty text has zeros."""
    w = Words(data, offsets)
    n_doc, size = len(offsets) - 1, np.diff(offsets)
    total = lambda table: per_doc(table[data].astype(np.int64), offsets)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LEAD[data], out=lead[1:])
    chars = lead[w.end] - lead[w.start]
    n_words = np.diff(w.first)
    h = w.hashes()
    word_sum = lambda flags: per_doc(flags.astype(np.int64), w.first)

    def in_words(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=sums[1:])
        return sums[w.end] - sums[w.start]

    # lines with a word that equal an earlier line of their text
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1][size > 0], breaks + 1]))
    starts = starts[starts < len(data)] if len(data) else starts[:0]
    line_doc = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    # a line ends before its line break, if it has one
    ends = ends - ((ends > starts) & (data[np.maximum(ends, 1) - 1] == 10)) if len(starts) else ends
    has_word = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends, line_doc = starts[has_word], ends[has_word], line_doc[has_word]
    line_key = span_hash(prefix(BYTE[data], BASE), starts, ends, BASE)
    dup_lines = np.bincount(line_doc[repeated(line_key, line_doc) == 2], minlength=n_doc)
    n_lines = np.bincount(line_doc, minlength=n_doc)
    last = data[np.maximum(ends, 1) - 1] if len(data) else np.zeros(0, np.uint8)
    stopped = np.bincount(line_doc[_STOP[last] > 0], minlength=n_doc)

    at, key = windows(h, w.doc, 3)
    again = at[repeated(key, w.doc[at]) > 0]
    repeats = word_sum(covered(again, 3, len(w)))
    unique = n_words - word_sum(repeated(h, w.doc) == 2)

    word_chars, symbols = word_sum(chars), total(_SYMBOL)
    counts = np.stack([n_words, word_chars, symbols, dup_lines, repeats], 1).astype(np.int64)
    squares = per_doc((chars * chars).astype(np.int64), w.first)
    mean = _share(word_chars, n_words)
    upper, lower = in_words(_UPPER), in_words(_LOWER)
    punct, length = in_words(_PUNCT), w.end - w.start
    ratios = [
        np.log1p(n_words), mean, np.sqrt(np.maximum(_share(squares, n_words) - mean * mean, 0)), _share(word_sum(chars > 14), n_words), _share(symbols, size), _share(total(_UPPER), size), _share(total(_DIGIT), size), _share(total(_PUNCT), size),
        _share(total(_STOP), size), _share(total(_BANG), size), _share(total(_HIGH), size), 1 - _share(word_chars, lead[offsets[1:]] - lead[offsets[:-1]]), _share(word_sum(in_words(_SYMBOL) > 0), n_words), _share(word_sum(punct > 0), n_words), _share(word_sum(punct == length), n_words), _share(word_sum((upper > 1) & (lower == 0)), n_words),
        _share(unique, n_words), _share(dup_lines, n_lines), _share(repeats, n_words), np.log1p(_share(n_words, n_lines)), _share(stopped, n_lines), _share(word_sum(chars < 3), n_words),
    ]
    return counts, np.nan_to_num(np.stack(ratios, 1).astype(np.float64)) * (n_words > 0)[:, None]


def text_stats(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and ``stats_counts`` (array of long, see COUNTS), ``stats_ratios`` (array of double, see RATIOS), in one pass over whole texts.

    A null text counts as an empty one; all its statistics are 0. Only ``keep`` and the text leave the scan.
    """
    batch_limit(docs.sparkSession)
    picked = docs.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    schema = extended(picked.drop("__text").schema, "stats_counts array<bigint>, stats_ratios array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for lo, hi, data, offsets in slices(column):
                counts, ratios = measure(data, offsets)
                n = hi - lo
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * m.shape[1], m.shape[1], dtype=np.int32)), pa.array(m.ravel())) for m in (counts, ratios)]
                part = batch.slice(lo, n)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *lists], names=[*batch.schema.names[:-1], "stats_counts", "stats_ratios"])

    return picked.mapInArrow(run, schema)

