"""Bloom filters as DataFrames: words of 64 bits, built by a bitwise-or aggregate, asked by a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits and hash functions of the usual filter.
BITS, HASHES = 1 << 30, 4


def positions(key: Column, bits: int = BITS, hashes: int = HASHES) -> Column:
    """The bits of a key: one hash function under different seeds."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), key), F.lit(bits)) for i in range(hashes)])


def build(keys: DataFrame, column: str, bits: int = BITS, hashes: int = HASHES) -> DataFrame:
    """(word, bits): the set words. Only words with a bit are rows, and the aggregate is partial before the shuffle."""
    at = keys.select(F.explode(positions(F.col(column), bits, hashes)).alias("p"))
    return at.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits"))


def might_contain(rows: DataFrame, column: str, filter_words: DataFrame, bits: int = BITS, hashes: int = HASHES) -> DataFrame:
    """Distinct keys of ``rows`` that may be in the filter: all that are, and few others."""
    asked = rows.select(column).distinct().select(column, F.explode(positions(F.col(column), bits, hashes)).alias("p"))
    word = filter_words.select(F.col("word").alias("__w"), F.col("bits").alias("__b"))
    hit = asked.join(word, F.shiftright("p", 6) == F.col("__w")).where(F.expr("(__b >> CAST(p & 63 AS INT)) & 1 = 1"))
    # a key's bits may coincide, so distinct ones are counted on both sides
    need = asked.groupBy(column).agg(F.countDistinct("p").alias("__n"))
    got = hit.groupBy(F.col(column).alias("__k")).agg(F.countDistinct("p").alias("__got"))
    return need.join(got, (F.col(column) == F.col("__k")) & (F.col("__n") == F.col("__got"))).select(column)
