"""Garbage collection: which containers are still referred to, and what goes with a deleted version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(recipe: DataFrame) -> DataFrame:
    """(cid, last_bv): the newest version that refers to each container."""
    return recipe.groupBy("cid").agg(F.max("bv").alias("last_bv"))


def update_manifest(old: DataFrame, recipe: DataFrame) -> DataFrame:
    """The manifest after another version: the newer of both sides."""
    return old.unionByName(manifest(recipe)).groupBy("cid").agg(F.max("last_bv").alias("last_bv"))


def reclaimable(man: DataFrame, job: int) -> DataFrame:
    """Containers that no version after ``job`` refers to: versions are deleted oldest first."""
    return man.where(F.col("last_bv") <= job)


def live_containers(man: DataFrame, job: int) -> DataFrame:
    return man.where(F.col("last_bv") > job).agg(F.count("*").alias("live_containers"))


def expired(versions: DataFrame, retention: int) -> DataFrame:
    """Versions that leave when the newest ``retention`` stay; none under a negative one. (0 keeps the newest too: a version just written is never deleted.)"""
    if retention < 0:
        return versions.limit(0)
    newest = versions.agg(F.max("bv").alias("__max"))
    return versions.join(F.broadcast(newest)).where(F.col("bv") <= F.col("__max") - max(retention, 1)).drop("__max")


def delete_versions(job: int, man: DataFrame, entries: DataFrame, index: DataFrame, recipe: DataFrame, logical: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifest, index, recipes) after versions up to ``job`` are gone; entries: (cid, fp); index: (feature, unit_id, bv).

    A physical index loses the features of reclaimed containers, a logical one those of the deleted versions' segments. Reclaimed blocks are listed, not freed.
    """
    gone = reclaimable(man, job)
    if logical:
        kept = index.where(F.col("bv") > job)
    else:
        kept = index.join(gone.select(F.col("cid").alias("unit_id")), "unit_id", "left_anti")
    return man.where(F.col("last_bv") > job), kept, recipe.where(F.col("bv") > job)
