"""Duplicate lookup. Exact deduplication is declarative: the first occurrence of a fingerprint in (version, place) order is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_occurrences(chunks: DataFrame) -> DataFrame:
    """(fp, bv, seq, size, copies): one row a distinct fingerprint. A minimum of structs, so that hot fingerprints are pre-aggregated before the shuffle."""
    first = chunks.groupBy("fp").agg(F.min(F.struct("bv", "seq", "size")).alias("f"), F.count("*").alias("copies"))
    return first.select("fp", "f.bv", "f.seq", "f.size", "copies")


def mark_duplicates(chunks: DataFrame) -> DataFrame:
    """Adds is_dup. The join back on (fp) may be split where a fingerprint is hot; a window over it could not."""
    first = first_occurrences(chunks).select(F.col("fp").alias("__fp"), F.col("bv").alias("__bv"), F.col("seq").alias("__seq"))
    return chunks.join(first, F.col("fp") == F.col("__fp")).withColumn("is_dup", ~((F.col("bv") == F.col("__bv")) & (F.col("seq") == F.col("__seq")))).drop("__fp", "__bv", "__seq")


def dedup_by_version(chunks: DataFrame) -> DataFrame:
    """What each version holds and stores: two aggregates of the same rows, none of which meets a hot fingerprint unaggregated."""
    held = chunks.groupBy("bv").agg(F.count("*").alias("chunks"), F.sum("size").cast("bigint").alias("data_size"))
    stored = first_occurrences(chunks).groupBy("bv").agg(F.count("*").alias("unique_chunks"), F.sum("size").cast("bigint").alias("stored_size"))
    return held.join(stored.withColumnRenamed("bv", "__bv"), F.col("bv") == F.col("__bv"), "left").drop("__bv").fillna(0, ["unique_chunks", "stored_size"])


def similar_segments(features: DataFrame, k: int = 1, units: tuple[str, str] = ("bv", "segment_no"), newest: int | None = None) -> DataFrame:
    """(units, cand_bv, cand_segment, shared, rank): for each segment the k earlier segments chosen greedily by the features they share.

    The candidate with most shared features wins, the newer one of equals; its features are taken from the others before the next is chosen. k = 1 is a
    ranking; more are k rounds of anti-joins, each over (segment, candidate, feature) rows. With ``newest`` a feature names its newest so many earlier segments only, as an index with
    values of that length does: rows grow with the features and not with the pairs that share one.
    """
    bv, seg = units
    mine = features.select(F.col(bv).alias("bv"), F.col(seg).alias("segment_no"), "feature")
    theirs = features.select(F.col(bv).alias("cand_bv"), F.col(seg).alias("cand_segment"), F.col("feature").alias("__feature"))
    earlier = (F.col("cand_bv") < F.col("bv")) | ((F.col("cand_bv") == F.col("bv")) & (F.col("cand_segment") < F.col("segment_no")))
    if newest is None:
        shared = mine.join(theirs, (F.col("feature") == F.col("__feature")) & earlier).drop("__feature")
    else:
        before = Window.partitionBy("feature").orderBy("bv", "segment_no").rowsBetween(-newest, -1)
        held = F.collect_list(F.struct(F.col("bv").alias("cand_bv"), F.col("segment_no").alias("cand_segment"))).over(before)
        shared = mine.withColumn("held", held).withColumn("c", F.explode("held")).select("bv", "segment_no", "feature", "c.cand_bv", "c.cand_segment")
    chosen: DataFrame | None = None
    for rank in range(1, k + 1):
        counts = shared.groupBy("bv", "segment_no", "cand_bv", "cand_segment").agg(F.count("*").alias("shared"))
        best = counts.groupBy("bv", "segment_no").agg(F.max(F.struct("shared", "cand_bv", "cand_segment")).alias("b"))
        picked = best.select("bv", "segment_no", "b.cand_bv", "b.cand_segment", "b.shared", F.lit(rank).alias("rank"))
        chosen = picked if chosen is None else chosen.unionByName(picked)
        if rank < k:
            gone = shared.join(picked.select("bv", "segment_no", "cand_bv", "cand_segment"), ["bv", "segment_no", "cand_bv", "cand_segment"]).select("bv", "segment_no", "feature").distinct()
            shared = shared.join(gone, ["bv", "segment_no", "feature"], "left_anti")
    return chosen


def near_exact_unbounded(segmented: DataFrame, features: DataFrame) -> DataFrame:
    """Near-exact deduplication with a cache that never evicts, as joins: a chunk is found if an earlier segment holds it that shares a feature with the chunk's segment, or earlier in its own segment.

    A segment's earlier hits come with all of that segment's chunks, as prefetching brings them. (bv, chunks, stored chunks, stored bytes.)
    """
    pairs = similar_pairs(features)
    here = segmented.select("bv", "segment_no", "seq", "fp", "size")
    content = segmented.select(F.col("bv").alias("cand_bv"), F.col("segment_no").alias("cand_segment"), F.col("fp").alias("__fp")).distinct()
    reachable = pairs.join(content, ["cand_bv", "cand_segment"]).select("bv", "segment_no", F.col("__fp").alias("fp")).distinct()
    firsts = here.groupBy("bv", "segment_no", "fp").agg(F.min(F.struct("seq", "size")).alias("f"))
    stored = firsts.join(reachable, ["bv", "segment_no", "fp"], "left_anti")
    kept = stored.groupBy("bv").agg(F.count("*").alias("stored_chunks"), F.sum("f.size").cast("bigint").alias("stored_size"))
    held = here.groupBy("bv").agg(F.count("*").alias("chunks"), F.sum("size").cast("bigint").alias("data_size"))
    return held.join(kept, "bv", "left").fillna(0, ["stored_chunks", "stored_size"])


def similar_pairs(features: DataFrame) -> DataFrame:
    """(bv, segment_no, cand_bv, cand_segment): the newest earlier segment of each feature, which is what an index with one id a feature answers."""
    order = Window.partitionBy("feature").orderBy("bv", "segment_no")
    newest = features.select("feature", "bv", "segment_no", F.lag(F.struct(F.col("bv").alias("cand_bv"), F.col("segment_no").alias("cand_segment"))).over(order).alias("c"))
    return newest.where(F.col("c").isNotNull()).select("bv", "segment_no", "c.cand_bv", "c.cand_segment").distinct()


def shared_features(features: DataFrame) -> DataFrame:
    """(bv, other_bv, shared): distinct features that two versions share."""
    a = features.select("bv", "feature").distinct()
    b = a.select(F.col("bv").alias("other_bv"), F.col("feature").alias("__f"))
    return a.join(b, (F.col("feature") == F.col("__f")) & (F.col("bv") < F.col("other_bv"))).groupBy("bv", "other_bv").agg(F.count("*").alias("shared"))


def remove_units(index: DataFrame, units: DataFrame) -> DataFrame:
    """The index without the entries (feature, unit_id) of ``units``."""
    return index.join(units, ["feature", "unit_id"], "left_anti")


def prefetched(recipes: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """(bv, asked_segment, segment_no, fp, cid) of the n segments that begin at each one of ``asked`` (bv, segment_no); of a repeated fingerprint the last pointer counts."""
    wanted = asked.select(F.col("bv").alias("__bv"), F.col("segment_no").alias("asked_segment"), F.explode(F.sequence(F.col("segment_no"), F.col("segment_no") + F.lit(n - 1))).alias("__segment"))
    last = recipes.groupBy("bv", "segment_no", "fp").agg(F.max_by("cid", "seq").alias("cid"))
    return last.join(wanted, (F.col("bv") == F.col("__bv")) & (F.col("segment_no") == F.col("__segment"))).select("bv", "asked_segment", "segment_no", "fp", "cid")
