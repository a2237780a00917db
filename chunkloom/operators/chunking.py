"""Chunking: a file's bytes to consecutive chunks. Boundaries never cross files.

Fixed-size and file-level chunking are built-in expressions. Content-defined chunkers need a scan of the bytes and run as Arrow functions, one file at a time, with
numpy doing the scanning: the rolling Rabin residue of the last 48 bytes is computed for a whole file by table look-ups, cut points are searched among the places that match the mask.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DedupConfig
from ..functions.fingerprints import fingerprint

# The irreducible polynomial over GF(2), the window, the break mark, and the constant of the extremum window.
POLYNOMIAL = 0xBFE6B8A5BF378D83
WINDOW = 48
BREAK_MARK = 0x78
EULER = 2.718281828


def _times_byte(value: int) -> int:
    """value * x^8 modulo the polynomial (degree 63)."""
    for _ in range(8):
        value <<= 1
        if value >> 63:
            value ^= POLYNOMIAL
    return value


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    """Row j: what a byte contributes that lies j bytes back, b * x^(8 j) modulo the polynomial; linear, so built bit by bit."""
    out = np.zeros((WINDOW, 256), np.uint64)
    basis = [1 << k for k in range(8)]
    for j in range(WINDOW):
        for k, v in enumerate(basis):
            out[j, 1 << k : 2 << k] = out[j, : 1 << k] ^ np.uint64(v)
        basis = [_times_byte(v) for v in basis]
    return out


def rolling_residues(data: np.ndarray) -> np.ndarray:
    """At each byte the residue of the last 48 bytes (fewer at the start)."""
    t = _tables()
    out = t[0][data]
    for j in range(1, min(WINDOW, len(data))):
        out[j:] ^= t[j][data[:-j]]
    return out


@lru_cache(maxsize=1)
def _triangle() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows of 1 to 47 bytes that begin at one place: which byte stands how far back, and the tables with a zero for bytes outside."""
    end, back = np.meshgrid(np.arange(WINDOW - 1), np.arange(WINDOW - 1), indexing="ij")
    tables = np.zeros((WINDOW, 257), np.uint64)
    tables[:, :256] = _tables()
    return np.maximum(end - back, 0), end >= back, tables


class Residues:
    """Rolling residues of some files behind one another, and the places that match a mask.

    Length i of a chunk at ``at`` is judged after byte i - 1 has entered a window that was empty before byte low - 1. So only the first 47 lengths see
    a window that is shorter than 48 bytes, and none sees a byte of the file before.
    """

    def __init__(self, data: np.ndarray):
        self.data, self.whole = data, rolling_residues(data)
        self.places: dict[int, np.ndarray] = {}

    def _short(self, begin: int, n: int) -> np.ndarray:
        """Residues of data[begin : begin + t] for t = 1 .. n, n < 48."""
        which, inside, tables = _triangle()
        window = self.data[begin : begin + n]
        byte = np.where(inside[:n, :n], window[which[:n, :n]], 256)
        return np.bitwise_xor.reduce(tables[np.arange(n), byte], axis=1)

    def lengths(self, at: int, low: int, high: int, mask: int) -> np.ndarray:
        """The lengths in [low, high) at which a chunk at ``at`` meets the break mark, rising."""
        short = min(low + WINDOW - 1, high)
        out = np.zeros(0, np.int64)
        if short > low:
            out = np.flatnonzero((self._short(at + low - 1, short - low) & np.uint64(mask)) == BREAK_MARK) + low
        if mask not in self.places:
            self.places[mask] = np.flatnonzero((self.whole & np.uint64(mask)) == BREAK_MARK)
        p = self.places[mask]
        i, j = np.searchsorted(p, (at + short - 1, at + high - 1))
        return np.concatenate([out, p[i:j] - at + 1])


def rabin_lengths(data: np.ndarray, avg: int, low: int, high: int, kind: str) -> list[int]:
    """Lengths of the chunks of a file. kind: rabin, normalized rabin, tttd."""
    return rabin_file(Residues(data), 0, len(data), avg, low, high, kind)


def rabin_file(r: Residues, at: int, stop: int, avg: int, low: int, high: int, kind: str) -> list[int]:
    """Lengths of the chunks of the file at bytes [at, stop)."""
    out = []
    while at < stop:
        left = stop - at
        if left <= low:
            out.append(left)
            break
        end = min(left, high)
        if kind == "rabin":
            hits = r.lengths(at, low, end, avg - 1)
            size = int(hits[0]) if len(hits) else end
        elif kind == "normalized rabin":
            # twice the average is aimed at below the average, half of it above
            hard = r.lengths(at, low, end, 2 * avg - 1)
            easy = r.lengths(at, low, end, avg // 2 - 1)
            hits = np.concatenate([hard[hard < avg][:1], easy[easy >= avg][:1]])
            size = int(hits[0]) if len(hits) else end
        else:
            backup = r.lengths(at, low, end, avg // 2 - 1)
            main = np.intersect1d(r.lengths(at, low, end, avg - 1), backup)  # asked only where the backup mask matches
            size = int(main[0]) if len(main) else int(backup[-1]) if len(backup) else end
        out.append(size)
        at += size
    return out


def extremum_window(avg: int) -> int:
    return int(avg / (EULER - 1))


def ae_lengths(data: np.ndarray, avg: int, high: int) -> list[int]:
    """Asymmetric extremum: cut ``window`` bytes after the running minimum of the 8-byte big-endian values (equal values move it on), or at ``high``
    (unless that very place is a new minimum)."""
    out, at, n, window = [], 0, len(data), extremum_window(avg)
    if n >= 8:
        pad = np.lib.stride_tricks.sliding_window_view(data, 8)
        values = np.zeros(len(pad), np.uint64)
        for k in range(8):
            values = (values << np.uint64(8)) | pad[:, k]
    while at < n:
        left = n - at
        if left <= window + 8:
            out.append(left)
            break
        size, step, best, low = left, max(2 * window, 1024), 0, int(values[at])
        lo = 1
        while lo <= left - 8 and size == left:
            hi = min(lo + step, left - 8 + 1)
            part = values[at + lo : at + hi]
            running = np.minimum.accumulate(np.concatenate([[np.uint64(low)], part]))
            new = part <= running[:-1]  # a new minimum, ties included
            where = np.arange(lo, hi)
            last = np.maximum.accumulate(np.concatenate([[best], np.where(new, where, 0)]))[1:]
            cut = ~new & ((where == last + window) | (where == high))
            hit = np.flatnonzero(cut)
            if len(hit):
                size = int(where[hit[0]])
            best, low, lo = int(last[-1]), int(running[-1]), hi
        out.append(size)
        at += size
    return out


def chunk_lengths(content: bytes, cfg: DedupConfig) -> list[int]:
    return next(batch_lengths([content], cfg))


#: Bytes of files whose residues are computed at once (a longer file by itself).
RUN_BYTES = 1 << 19


def batch_lengths(contents: list[bytes], cfg: DedupConfig) -> Iterator[list[int]]:
    """The chunk lengths of each file; short files share one computation of rolling residues."""
    kind = cfg.chunk_algorithm
    if kind in ("fixed", "file"):
        size = cfg.chunk_avg_size if kind == "fixed" else cfg.container_data
        for c in contents:
            yield [min(size, len(c) - i) for i in range(0, len(c), size)]
    elif kind == "ae":
        for c in contents:
            yield ae_lengths(np.frombuffer(c, np.uint8), cfg.chunk_avg_size, cfg.chunk_max_size)
    else:
        first = 0
        while first < len(contents):
            last, total = first, 0
            while last < len(contents) and (last == first or total + len(contents[last]) <= RUN_BYTES):
                total += len(contents[last])
                last += 1
            r, at = Residues(np.frombuffer(b"".join(contents[first:last]), np.uint8)), 0
            for c in contents[first:last]:
                yield rabin_file(r, at, at + len(c), cfg.chunk_avg_size, cfg.chunk_min_size, cfg.chunk_max_size, kind)
                at += len(c)
            first = last


def fixed_chunks(files: DataFrame, size: int, with_data: bool = False) -> DataFrame:
    """Chunks of ``size`` bytes; the tail of a file is shorter. Built-in expressions only."""
    n = F.octet_length("content")
    cut = files.where(n > 0).select("bv", "file_no", "content", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / F.lit(size)).cast("bigint"))).alias("chunk_no"))
    data = F.substring(F.col("content"), (F.col("chunk_no") * size + 1).cast("int"), F.lit(size))
    out = cut.select("bv", "file_no", "chunk_no", fingerprint(data).alias("fp"), F.octet_length(data).alias("size"), data.alias("data"))
    return out if with_data else out.drop("data")


def content_chunks(files: DataFrame, cfg: DedupConfig, with_data: bool = False) -> DataFrame:
    """Chunks by any algorithm of the configuration, with their SHA-1."""
    cfg = cfg.resolved()
    schema = "bv int, file_no bigint, chunk_no bigint, fp binary, size int" + (", data binary" if with_data else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bv", "file_no", "chunk_no", "fp", "size", *(["data"] if with_data else [])]
        for b in batches:
            contents = [x or b"" for x in b.column(2).to_pylist()]
            keys = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), contents, batch_lengths(contents, cfg), strict=True)
            rows: list[tuple] = []
            for bv, file_no, content, sizes in keys:
                at = 0
                for i, n in enumerate(sizes):
                    part = content[at : at + n]
                    rows.append((bv, file_no, i, hashlib.sha1(part).digest(), n, part)[: len(names)])
                    at += n
            if rows:
                types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names)

    picked = files.select(F.col("bv").cast("int"), F.col("file_no").cast("bigint"), "content")
    cores = picked.sparkSession.sparkContext.defaultParallelism
    if picked.rdd.getNumPartitions() < 2 * cores:  # a small input in few row groups; a large one stays where it is
        picked = picked.repartition(cores, "bv", "file_no")
    return picked.mapInArrow(run, schema)


def chunks(files: DataFrame, cfg: DedupConfig, with_data: bool = False) -> DataFrame:
    cfg = cfg.resolved()
    if cfg.chunk_algorithm == "fixed":
        return fixed_chunks(files, cfg.chunk_avg_size, with_data)
    if cfg.chunk_algorithm == "file":
        return fixed_chunks(files, cfg.container_data, with_data)
    return content_chunks(files, cfg, with_data)


def with_seq(chunk_rows: DataFrame) -> DataFrame:
    """Adds ``seq``, the place in the version's stream. Files are counted, not chunks: the running total goes over one row a file."""
    per_file = chunk_rows.groupBy("bv", "file_no").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bv").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    base = per_file.select(F.col("bv").alias("__bv"), F.col("file_no").alias("__file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    joined = chunk_rows.join(base, (F.col("bv") == F.col("__bv")) & (F.col("file_no") == F.col("__file")))
    return joined.withColumn("seq", F.col("__base") + F.col("chunk_no")).drop("__bv", "__file", "__base")
