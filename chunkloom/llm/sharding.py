"""Sharding: a uniform shuffle with exact shard sizes, dealt by a hypergeometric communication matrix.

Rows first fall into virtual partitions by a hash of their content, so that a lost executor's recomputed task puts every row where it was.
One count of each partition is known on the driver (``partitions`` numbers); there the matrix of how many rows partition p sends to shard s
is drawn: row after row a multivariate hypergeometric sample of the room that the shards still have. Each partition permutes its rows and
hands the first m[p, 0] of them to shard 0, the next m[p, 1] to shard 1 and so on; after the exchange the rows of a shard are permuted again,
in sub-buckets whose counts give each a gapless range of slots, so that no task ever holds a whole shard.

Law ``rows``: shard sizes differ by one at most. Defined results: null texts have size 1 and CRC 0; empty ones too; null ids are rows like any other;
of rows that are equal in every column it can't be told apart which gets which slot (where they are more than a virtual partition holds, they are numbered and dealt to several);
an empty table gives an empty result; columns of the input that clash with the result's are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Rows that a virtual partition, and a sub-bucket of a shard, hold on average.
ROWS_EACH = 2048
MAX_PARTITIONS = 65536
#: Numbers of the communication matrix, which the driver holds.
MAX_CELLS = 1 << 22
#: Rooms from which numpy has no hypergeometric draw; then places are drawn, so many at once.
NUMPY_DRAWS = 1_000_000_000
DRAWN_AT_ONCE = 1 << 20


def communication_matrix(counts: np.ndarray, capacity: np.ndarray, seed: int) -> np.ndarray:
    """Rows that each partition sends to each shard: uniform among all matrices' fillings with these margins."""
    rng = np.random.default_rng(seed)
    left = capacity.astype(np.int64).copy()
    out = np.zeros((len(counts), len(capacity)), np.int64)
    for p, n in enumerate(counts):
        need = int(n)
        while need and int(left.sum()) >= NUMPY_DRAWS:
            part = _drawn(rng, left, min(need, DRAWN_AT_ONCE))
            out[p] += part
            left -= part
            need -= int(part.sum())
        room, own = int(left.sum()), out[p].copy()
        for s in range(len(left)):
            room -= int(left[s])
            if not need:
                break
            # of the rows still to be placed, those that fall on shard s rather than on the later ones
            part = need if not room else (0 if not left[s] else int(rng.hypergeometric(int(left[s]), room, need)))
            out[p, s] += part
            need -= part
        left -= out[p] - own
    return out


def _drawn(rng: np.random.Generator, left: np.ndarray, draws: int) -> np.ndarray:
    """How many of so many rooms, drawn without return, lie in each shard: distinct places among all that are left, so that no number is too large."""
    total = int(left.sum())
    at = np.unique(rng.integers(0, total, draws))
    while len(at) < draws:
        at = np.union1d(at, rng.integers(0, total, draws - len(at)))
    return np.bincount(np.searchsorted(np.cumsum(left), at, side="right"), minlength=len(left))


def row_hash(df: DataFrame, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[x for c in df.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`").cast("string"))])


def numbered_apart(keyed: DataFrame, total: int) -> DataFrame:
    """``keyed`` with new hashes for rows that are equal in every column and more than a virtual partition holds: no partition gets them all.

    Such hashes are few (total / limit at most, MAX_PARTITIONS). Their rows are written with a number each before it counts, so that a task that runs again deals them out as before.
    """
    limit = max(ROWS_EACH, -(-total // MAX_PARTITIONS))
    hot = written(keyed.groupBy("__h").agg(F.count("*").alias("__n")).where(F.col("__n") > limit).select("__h"), "shard-hot")
    if hot.isEmpty():
        return keyed
    rows = written(keyed.join(F.broadcast(hot), "__h", "left_semi").withColumn("__number", F.monotonically_increasing_id()), "shard-rows")
    apart = rows.withColumn("__h", F.xxhash64("__h", "__number")).drop("__number")
    return keyed.join(F.broadcast(hot), "__h", "left_anti").select(*keyed.columns).unionByName(apart)


def shard_rows(df: DataFrame, n_shards: int = 16, seed: int = 11, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Adds ``shard`` (0 .. n_shards - 1, sizes at most one apart) and ``slot`` (0 .. size - 1, each once): a uniform random placement."""
    df = df.drop(shard, slot)
    spark = df.sparkSession
    names = df.columns
    total = df.count()
    # columns go by numbers inside, whatever their names are
    keyed = numbered_apart(df.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)], row_hash(df, seed).alias("__h")), total)
    parts = int(min(MAX_PARTITIONS, max(1, MAX_CELLS // n_shards), max(1, -(-total // ROWS_EACH))))
    subs = int(max(1, -(-total // (n_shards * ROWS_EACH))))
    keyed = keyed.withColumn("__p", F.pmod(F.col("__h"), F.lit(parts)).cast("int"))
    found = {r["__p"]: r["n"] for r in keyed.groupBy("__p").agg(F.count("*").alias("n")).collect()}  # one number a partition
    counts = np.array([found.get(p, 0) for p in range(parts)], np.int64)
    rows = int(counts.sum())
    capacity = np.array([rows // n_shards + (s < rows % n_shards) for s in range(n_shards)], np.int64)
    matrix = communication_matrix(counts, capacity, seed)
    upto = np.cumsum(matrix, axis=1)
    dealt = spark.createDataFrame([(p, [int(x) for x in upto[p]]) for p in range(parts)], "__p int, __upto array<bigint>")
    # local permutation: a keyed hash orders the partition's rows
    local = Window.partitionBy("__p").orderBy(F.xxhash64(F.col("__h"), F.lit(seed + 1)), "__h")
    placed = keyed.withColumn("__at", F.row_number().over(local)).join(F.broadcast(dealt), "__p")  # parts rows: at most MAX_PARTITIONS
    placed = placed.withColumn("__shard", F.size(F.filter("__upto", lambda x: x < F.col("__at"))).cast("int")).drop("__upto", "__at", "__p")
    # second permutation: an independent hash gives the place inside the shard, the sub-bucket being its leading part
    placed = placed.withColumn("__k", F.xxhash64(F.col("__h"), F.lit(seed + 2)))
    placed = placed.withColumn("__sub", F.pmod(F.shiftright("__k", 20), F.lit(subs)).cast("int"))
    out = _slots(placed, n_shards * subs)
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)], F.col("__shard").alias(shard), F.col("__slot").alias(slot))


def _slots(placed: DataFrame, groups: int) -> DataFrame:
    """Slots: rank within the sub-bucket plus the rows of the shard's earlier sub-buckets, all in one exchange of the rows."""
    inside = Window.partitionBy("__shard", "__sub").orderBy("__k", "__h")
    sizes = placed.groupBy(F.col("__shard").alias("__s"), F.col("__sub").alias("__b")).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).drop("__n")
    ranked = placed.withColumn("__rank", F.row_number().over(inside))
    if groups <= MAX_PARTITIONS:
        before = F.broadcast(before)
    out = ranked.join(before, (F.col("__shard") == F.col("__s")) & (F.col("__sub") == F.col("__b")))
    return out.withColumn("__slot", (F.col("__rank") - 1 + F.coalesce(F.col("__before"), F.lit(0))).cast("long"))


def document_sizes(documents: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32): the narrow rows that are placed when the texts themselves need not move."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"))
