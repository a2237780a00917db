"""Sampling: the features of a unit (a segment or a container) are some of its fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DedupConfig
from ..functions.fingerprints import feature_key, tail

ZERO, ONES = bytes(20), b"\xff" * 20
#: How far in front of an anchor the optimised minimum takes its feature.
BACK = 8


def sampled_count(n: Column, ratio: int) -> Column:
    """Features of a unit of n chunks: n / ratio, a remainder over half rounding up; 1 at least."""
    if ratio == 0:
        return F.lit(1)
    whole, left = F.floor(n / F.lit(ratio)), F.pmod(n, F.lit(ratio))
    return F.when(n <= ratio, F.lit(1)).otherwise(whole + (left * 2 > ratio).cast("int")).cast("int")


def _empty(units: list[str], df: DataFrame, found: DataFrame, feature: bytes) -> DataFrame:
    """Units of which no chunk was taken have the one given feature."""
    missing = df.select(*units).distinct().join(found.select(*units).distinct(), units, "left_anti")
    return found.unionByName(missing.withColumn("feature", F.lit(feature)))


def sample_random(df: DataFrame, units: list[str], ratio: int) -> DataFrame:
    """Fingerprints whose tail is divisible by ratio; a unit without any has the all-zero feature."""
    found = df.where(F.pmod(tail(F.col("fp")), F.lit(max(ratio, 1))) == 0).select(*units, F.col("fp").alias("feature")).distinct()
    return _empty(units, df, found, ZERO)


def sample_uniform(df: DataFrame, units: list[str], ratio: int) -> DataFrame:
    """Every ratio-th chunk of a unit, the first included."""
    place = F.row_number().over(Window.partitionBy(*units).orderBy("seq")) - 1
    return df.withColumn("__i", place).where(F.pmod(F.col("__i"), F.lit(max(ratio, 1))) == 0).select(*units, F.col("fp").alias("feature")).distinct()


def _anchors(df: DataFrame, units: list[str], ratio: int) -> DataFrame:
    sized = df.withColumn("__n", F.count("*").over(Window.partitionBy(*units)))
    ranked = sized.withColumn("__rank", F.row_number().over(Window.partitionBy(*units).orderBy("fp", "seq")))
    return ranked.where(F.col("__rank") <= sampled_count(F.col("__n"), ratio))


def sample_min(df: DataFrame, units: list[str], ratio: int) -> DataFrame:
    """The smallest fingerprints of a unit; repeated ones count towards their number, and are one feature."""
    return _anchors(df, units, ratio).select(*units, F.col("fp").alias("feature")).distinct()


def sample_optmin(df: DataFrame, units: list[str], ratio: int) -> DataFrame:
    """As sample_min, but the feature is the fingerprint 8 chunks before the anchor, or the unit's first."""
    order = Window.partitionBy(*units).orderBy("seq")
    before = df.withColumn("__back", F.coalesce(F.lag("fp", BACK).over(order), F.first("fp").over(order)))
    return _anchors(before, units, ratio).select(*units, F.col("__back").alias("feature")).distinct()


SAMPLERS = {"random": sample_random, "uniform": sample_uniform, "min": sample_min, "optmin": sample_optmin}


def features(df: DataFrame, units: list[str], cfg: DedupConfig) -> DataFrame:
    """(units, feature): keys of the feature index."""
    out = SAMPLERS[cfg.sampling_method](df, units, cfg.sampling_ratio)
    return out.select(*units, feature_key(F.col("feature"), cfg.index_key_size).alias("feature")).distinct()


def feature_index(found: DataFrame, unit: Column, order: list[str], length: int) -> DataFrame:
    """(feature, unit_id, ord): the newest ``length`` units of each feature, newest first."""
    ranked = found.withColumn("ord", F.row_number().over(Window.partitionBy("feature").orderBy(*[F.desc(c) for c in order])) - 1)
    return ranked.where(F.col("ord") < length).select("feature", unit.alias("unit_id"), "ord")


def update_requests(found: DataFrame) -> DataFrame:
    """Index updates of each version: one a feature of a unit."""
    return found.groupBy("bv").agg(F.count("*").alias("update_requests"))


def index_footprint(found: DataFrame, key_size: int, value_length: int) -> DataFrame:
    """Bytes of the index: a key, ``value_length`` ids of 8 bytes and a counter of 4 for each distinct feature."""
    return found.agg(F.countDistinct("feature").alias("features")).select("features", (F.col("features") * (key_size + 8 * value_length + 4)).alias("footprint"))
