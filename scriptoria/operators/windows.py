"""Window-shaped operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lanes(relations: DataFrame, left: str, right: str) -> DataFrame:
    """relations with laneIndex (from 0, by id) and laneCount within each unordered pair."""
    pair = [F.least(left, right), F.greatest(left, right)]
    return relations.withColumn("laneIndex", F.row_number().over(Window.partitionBy(*pair).orderBy("id")) - 1).withColumn("laneCount", F.count("*").over(Window.partitionBy(*pair)))


def with_context(spans: DataFrame, *group: str) -> DataFrame:
    """spans (ordinal, text) with the text before and after."""
    w = Window.partitionBy(*group).orderBy("ordinal")
    return spans.withColumn("previous", F.lag("text").over(w)).withColumn("next", F.lead("text").over(w))


def nearest_before(df: DataFrame, value: Column, order: list, *group: str) -> Column:
    """The last non-null value at or before each row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def best_per_key(df: DataFrame, key: list, order: list) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def top_per_group(df: DataFrame, group: list, order: list, k: int | Column) -> DataFrame:
    """The first k rows of each group; Spark prunes ranks before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def revisions(artifacts: DataFrame, key: str, order: str, digest: str) -> DataFrame:
    """artifacts with a revision that grows by one whenever the digest changes from the row before."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.lag(digest).over(w).eqNullSafe(F.col(digest)), 0).otherwise(1)
    return artifacts.withColumn("_new", new).withColumn("revision", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def gaps(events: DataFrame, key: str, revision: str) -> DataFrame:
    """(key, revision, expected) of events whose revision is not their place in the ledger."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(revision))
    return events.select(key, revision, place.alias("expected")).where(F.col(revision) != F.col("expected"))


def fold_lines(lines: DataFrame, start: Column, group: list[str], order: str, text: str) -> DataFrame:
    """Continuation lines joined to the line that starts them by single spaces; lines before the first are dropped."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("_n", F.sum(F.when(start, 1).otherwise(0)).over(w)).where("_n > 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: F.trim(x[text])), " ")
    return marked.groupBy(*group, "_n").agg(F.min(order).alias(order), joined.alias(text)).drop("_n")


def first_wins(events: DataFrame, key: str, order: str) -> DataFrame:
    return best_per_key(events, [key], [order])


def slot(members: DataFrame, group: str, order: list, per_ring: int = 12) -> DataFrame:
    k = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return members.withColumn("slot", k % per_ring).withColumn("ring", F.floor(k / per_ring).cast("int"))
