"""Context packs: claims and project memory under a character budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.functions import vocabulary as V
from scriptoria.operators.predicates import claim_trust


def budget_prefix(df: DataFrame, group: list[str], order: list, text: str, budget: Column | int, least: int) -> DataFrame:
    """The rows, in order, that start while `least` characters or more of the budget are left, with `kept`: the text,
    cut to what is left where it is longer. A running sum replaces the loop: what is used never shrinks."""
    window = Window.partitionBy(*group).orderBy(*order)
    used = F.coalesce(F.sum(F.length(text)).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = (F.lit(budget) if isinstance(budget, int) else budget) - used
    out = df.withColumn("_left", left).where(F.col("_left") >= least)
    cut = F.concat(F.regexp_replace(F.substr(F.col(text), F.lit(1), (F.col("_left") - 22).cast("int")), r"\s+$", ""), F.lit("\n\n[text truncated]"))
    return out.withColumn("kept", F.when(F.length(text) <= F.col("_left"), F.col(text)).otherwise(cut)).drop("_left")


def select_claims(results: DataFrame, claims: DataFrame, budget: int) -> DataFrame:
    """Claims of ranked results (query_id, place, paperId, claims) under 72 % of the budget, drafts left out.

    Papers without matching claims offer their first two that are no project role.
    """
    matched = results.select("query_id", "place", "paperId", F.posexplode("claims").alias("k", "claimId"))
    first = Window.partitionBy("query_id", "paperId").orderBy("claimId")
    bare = results.where(F.size("claims") == 0).select("query_id", "place", "paperId").join(claims.where("type <> 'project_role'").select("paperId", "claimId"), "paperId")
    offered = bare.withColumn("k", F.row_number().over(first) - 1).where("k < 2").select("query_id", "place", "paperId", "k", "claimId")
    rows = matched.unionByName(offered).join(claims.drop("paperId"), "claimId").where("text <> '' and verificationStatus <> 'card_draft'")
    kept = budget_prefix(rows, ["query_id"], ["place", "k"], "text", int(budget * 0.72), 120)
    return kept.withColumn("trust", claim_trust(F.col("verificationStatus"))).withColumn("contentHash", F.sha2("text", 256))


def select_memory(items: DataFrame, left: Column | int) -> DataFrame:
    """Active items by id under what the claims left of the budget."""
    return budget_prefix(items.where("state = 'active' and content <> ''"), ["projectId"], ["memoryId"], "content", left, 100)


def rank_memory(items: DataFrame, query: Column) -> DataFrame:
    """Active items for a preview: 2 per query term found, 1 for kinds that always matter; highest first, then id."""
    terms = F.filter(F.split("_query", " "), lambda t: t != "")
    hits = F.aggregate(F.transform(terms, lambda t: F.when(F.contains(F.col("_body"), t), 2).otherwise(0)), F.lit(0), lambda a, x: a + x)
    rows = items.where("state = 'active' and content <> ''").withColumns({"_query": T.search_text(query), "_body": T.search_text(F.concat_ws(" ", "title", "content"))})
    scored = rows.withColumn("score", hits + F.when(F.col("type").isin(*V.ALWAYS_RELEVANT), 1).otherwise(0))
    return scored.drop("_query", "_body").where("score > 0").orderBy(F.desc("score"), "memoryId")


def limitations(claims: DataFrame, papers: DataFrame) -> DataFrame:
    """The first two limitations of each paper in order, distinct texts once, at their first place."""
    order = Window.partitionBy("paperId").orderBy("claimId")
    two = claims.where("type = 'limitation'").join(papers.select("paperId", "place"), "paperId").withColumn("k", F.row_number().over(order)).where("k <= 2")
    line = two.select(F.concat_ws(": ", "paperId", "text").alias("line"), F.struct("place", "k").alias("at"))
    return line.groupBy("line").agg(F.min("at").alias("at")).orderBy("at").select("line")


def conflicts(items: DataFrame) -> DataFrame:
    kept = items.where("state = 'active' and (evidenceState = 'contradicted' or type = 'conflict')")
    return kept.select("projectId", F.concat_ws(": ", F.coalesce("title", "memoryId"), "content").alias("line"))


def pack_id(columns: list[str]) -> Column:
    """A content address: the first 20 digits of the SHA-256 of the columns as JSON."""
    return F.concat(F.lit("context-"), F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 20))


def render(claims: DataFrame, memory: DataFrame) -> DataFrame:
    """(query_id, markdown): a pack's claims in order, then its project's memory, as one text; rows of a pack are few
    by the budget. Both tables have projectId."""
    block = F.concat(F.lit("### "), F.col("paperId"), F.lit(" · "), F.col("claimId"), F.lit("\n\n"), F.col("kept"), F.lit("\n\n- Trust: "), F.col("trust"))
    parts = claims.select("query_id", F.struct(F.lit(0).alias("s"), "place", "k", block.alias("block")).alias("p"))
    note = F.concat(F.lit("### "), F.coalesce("title", "memoryId"), F.lit("\n\n"), F.col("kept"))
    listed = memory.select("projectId", F.struct(F.lit(1).alias("s"), F.lit(0).alias("place"), F.lit(0).alias("k"), note.alias("block")).alias("p"))
    notes = claims.select("query_id", "projectId").distinct().join(listed, "projectId").select("query_id", "p")
    return parts.unionByName(notes).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["block"]), "\n\n").alias("markdown"))
