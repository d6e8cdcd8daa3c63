"""Connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.shared import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first()
    )


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node of an undirected edge table; root is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014). Each step takes a minimum per node,
    which Spark pre-aggregates before the shuffle, and a join back that adaptive execution can split, so a hub with
    very many edges is dealt out over tasks. The edges of each round are written to the shared folder, and those of
    the round before are deleted, so that lineage and disk stay bounded. The driver sees three sums a round.

    Edges with a null end are ignored, loops only name their node, repeated edges count once. An empty table
    gives an empty result.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    now = materialize(
        ends.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc"
    )
    seen = _state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = materialize(large, "cc-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(star.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        discard(large)
        then = _state(after)
        discard(now)
        now, before, seen = after, seen, then
        if seen == before:
            break
    rooted = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    loops = ends.where("a = b").select(F.col("a").alias("node")).distinct()
    known = rooted.unionByName(roots)
    alone = loops.join(known.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
    return known.unionByName(alone)
