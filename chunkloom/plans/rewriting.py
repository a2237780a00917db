"""Rewriting marks of versions whose lookup is known: a fold a version, which holds no more than the rewriting buffer."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..config import DedupConfig
from ..operators.ordered import ordered_fold
from .backup import Chunk, rewriter_of


def streamed_marks(stream: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(bv, seq, is_ooo) from (bv, seq, file_no, segment_no, size, known: the container of a duplicate, else null)."""

    def fold(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        rewriter, held = rewriter_of(cfg, ()), deque()
        for bv, seq, file_no, segment_no, size, known in rows:
            c = Chunk(seq, file_no, b"", size, segment_no, known, known is not None)
            held.append(c)
            for _ in range(rewriter.push(c)):
                done = held.popleft()
                yield bv, done.seq, done.is_ooo
        rewriter.flush()
        for done in held:
            yield key[0], done.seq, done.is_ooo

    rows = stream.select("bv", "seq", "file_no", "segment_no", "size", "known")
    return ordered_fold(rows, ["bv"], ["seq"], "bv int, seq bigint, is_ooo boolean", fold)
