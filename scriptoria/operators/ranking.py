"""Sorts, limits and set operations with fixed tie-breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions.scalar import fnv1a


def by_name(df: DataFrame, name: str, key: str) -> DataFrame:
    """Ordered as people read names: the UNICODE collation, then the key."""
    return df.orderBy(F.collate(name, "UNICODE"), key)


def latest_first(df: DataFrame, stamp: str, key: str) -> DataFrame:
    """Time stamps stay text and are compared as such, newest first, missing ones last."""
    return df.orderBy(F.col(stamp).desc_nulls_last(), key)


def representatives(papers: DataFrame, group: str, key: str, seed: str, k: int) -> DataFrame:
    """k papers: one a group by hash, then the rest by hash, so every group is seen before any is seen twice."""
    h = fnv1a(F.concat(F.lit(seed), F.col(key).cast("string")))
    ranked = papers.withColumn("hash", h).withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy("hash", key)))
    return ranked.orderBy(F.when(F.col("turn") == 1, 0).otherwise(1), "hash", key).limit(k).drop("turn")


def overflow_limit(df: DataFrame, order: list, most: int) -> DataFrame:
    """Ordered rows, one more than allowed, so that the caller sees an overflow."""
    return df.orderBy(*order).limit(most + 1)


def jaccard(left, right):
    """Shared members over all members of two arrays; 0 for two empty ones."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(0.0)


def merge_keep_existing(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def distinct_in_order(df: DataFrame, value: str, order: str) -> DataFrame:
    return df.groupBy(value).agg(F.min(order).alias(order)).orderBy(order)


def incomplete_waves(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, wave): items that share a wave with a chosen one but are not chosen themselves."""
    waves = items.join(chosen.select("id"), "id", "left_semi").select("wave").distinct()
    return items.join(waves, "wave", "left_semi").join(chosen.select("id"), "id", "left_anti").select("id", "wave")


def artifacts_of(outputs: DataFrame, memories: DataFrame) -> DataFrame:
    """Task outputs and code or experiment memories, once per hash, else path, else id; the first wins."""
    both = outputs.unionByName(memories.where("type in ('code', 'experiment')").drop("type"), allowMissingColumns=True)
    keyed = both.withColumn("_key", F.coalesce("sha256", "path", "id"))
    return keyed.withColumn("_k", F.row_number().over(Window.partitionBy("_key").orderBy("ordinal", "id"))).where("_k = 1").drop("_k", "_key")
