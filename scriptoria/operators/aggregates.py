"""Aggregations. All are plain groupBy: Spark aggregates partially before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.functions import vocabulary as V
from scriptoria.functions.scalar import heat, rounded


def usage_counts(events: DataFrame) -> DataFrame:
    """(projectId, paperId, count, duplicates) of events (key, projectId, paperId): a key counts once."""
    per = events.groupBy("key", "projectId", "paperId").agg(F.count("*").alias("n"))
    return per.groupBy("projectId", "paperId").agg(F.count("*").alias("count"), (F.sum("n") - F.count("*")).alias("duplicates"))


def usage_heat(counts: DataFrame) -> DataFrame:
    return counts.groupBy("paperId").agg(F.sum("count").alias("count")).withColumn("heat", heat(F.col("count")))


def region_heat(members: DataFrame, heats: DataFrame, regions: DataFrame) -> DataFrame:
    """(regionId, heat): the mean heat of primary members, of all members where there is no primary one, 0 if none.

    members has (paperId, regionId, isPrimary).
    """
    h = members.join(heats.select("paperId", "heat"), "paperId", "left").withColumn("heat", F.coalesce("heat", F.lit(0.0)))
    per = h.groupBy("regionId").agg(F.avg(F.when(F.col("isPrimary"), F.col("heat"))).alias("own"), F.avg("heat").alias("all"))
    return regions.select("regionId").join(per, "regionId", "left").select("regionId", F.coalesce("own", "all", F.lit(0.0)).alias("heat"))


def conditional_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows meet each condition."""
    return df.agg(*(F.count_if(c).alias(n) for n, c in conditions.items()))


def histogram(df: DataFrame, column: str, values: list[str] | None = None) -> DataFrame:
    """(value, count); given values stand with 0 where they do not occur."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    if values is None:
        return counts
    listed = df.sparkSession.createDataFrame([(v,) for v in values], "value string")
    return F.broadcast(listed).join(counts, "value", "right_outer").unionByName(listed.join(counts, "value", "left_anti").withColumn("count", F.lit(0).cast("long")))


def region_sizes(assignments: DataFrame) -> DataFrame:
    """(optionId, regions, smallest, largest) of assignments (optionId, regionId, paperId)."""
    per = assignments.groupBy("optionId", "regionId").agg(F.count("*").alias("n"))
    return per.groupBy("optionId").agg(F.count("*").alias("regions"), F.min("n").alias("smallest"), F.max("n").alias("largest"))


def pair_bundles(relations: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(a, b, n, ids sorted): relations by unordered pair of ends."""
    return relations.groupBy(F.least(source, target).alias("a"), F.greatest(source, target).alias("b")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))


def top_tags(tags: DataFrame, generic: list[str]) -> DataFrame:
    """(grp, first, second): the most frequent tag of a group, and the next that neither contains it nor is contained.
    tags has (grp, tag); generic tags do not count; ties go by the alphabet."""
    counts = tags.where(~F.col("tag").isin(generic) & (F.col("tag") != "")).groupBy("grp", "tag").agg(F.count("*").alias("n"))
    order = Window.partitionBy("grp").orderBy(F.desc("n"), "tag")
    ranked = counts.withColumn("k", F.row_number().over(order)).withColumn("first", F.first("tag").over(order))
    other = ranked.where((F.col("k") > 1) & ~F.contains("tag", F.col("first")) & ~F.contains("first", F.col("tag")))
    return ranked.where("k = 1").select("grp", "first").join(other.groupBy("grp").agg(F.min_by("tag", "k").alias("second")), "grp", "left")


def cluster_names(groups: DataFrame, tags: DataFrame, generic: tuple[str, ...] = V.GENERIC_TAGS, fallback: str = "Research Cluster") -> DataFrame:
    """(grp, name) of groups (grp, place): their two most frequent tags that do not contain each other, as names, or a
    numbered fallback where there is no tag but generic ones. tags has (grp, tag)."""
    both = groups.join(top_tags(tags, list(generic)), "grp", "left")
    named = F.concat_ws(" & ", T.title_case(F.col("first")), T.title_case(F.col("second")))
    return both.select("grp", F.when(F.col("first").isNotNull(), named).otherwise(F.concat(F.lit(f"{fallback} "), (F.col("place") + 1).cast("string"))).alias("name"))


def partition_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (pairs, disagreements, share): pairs of papers that one assignment joins and the other parts.

    From the contingency table: C(a) + C(b) - 2 C(a and b), with C the pairs within groups; no pair is listed.
    """
    both = a.select("paperId", F.col("regionId").alias("ra")).join(b.select("paperId", F.col("regionId").alias("rb")), "paperId")
    cells = both.groupBy("ra", "rb").agg(F.count("*").alias("n"))
    two = lambda c: F.sum(F.expr(f"{c} * ({c} - 1) div 2"))
    rows = lambda key: cells.groupBy(key).agg(F.sum("n").alias("n")).agg(two("n").alias("c"))
    joined = cells.agg(two("n").alias("both"), F.sum("n").alias("papers"))
    out = joined.crossJoin(rows("ra").withColumnRenamed("c", "ca")).crossJoin(rows("rb").withColumnRenamed("c", "cb"))
    pairs = F.expr("papers * (papers - 1) div 2")
    return out.select(pairs.alias("pairs"), (F.col("ca") + F.col("cb") - 2 * F.col("both")).alias("disagreements")).withColumn("share", F.when(F.col("pairs") > 0, F.col("disagreements") / F.col("pairs")).otherwise(0.0))


def relation_scores(relations: DataFrame) -> DataFrame:
    """relations with strength, confidence and valid: the four rubric scores' sum, the weighted mean of the
    confidence components (percentages), and whether each score is one that the rubric has. Needs a column for each component."""
    strength = sum((F.col(c) for c in V.RUBRIC), F.lit(0))
    confidence = rounded(sum((F.col(c) * w for c, w in V.CONFIDENCE_WEIGHTS.items()), F.lit(0.0)))
    valid = F.lit(True)
    for c, allowed in V.RUBRIC.items():
        valid = valid & F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    return relations.withColumn("strength", strength).withColumn("confidence", confidence).withColumn("valid", valid)


def located_papers(evidence: DataFrame) -> DataFrame:
    """(relationId, papers, eligible) of evidence (relationId, paperId, located, source, target): a relation is
    eligible if both of its ends have evidence with a precise locator."""
    good = evidence.where("located").groupBy("relationId").agg(F.collect_set("paperId").alias("p"), F.first("source").alias("source"), F.first("target").alias("target"))
    ends = F.array_contains("p", F.col("source")) & F.array_contains("p", F.col("target"))
    return good.select("relationId", F.size("p").alias("papers"), ends.alias("eligible"))


def canonical(columns: dict[str, str]) -> Column:
    """The columns (name to type) in order of their names as one unambiguous string: length:value, or - for null;
    nested values as JSON."""
    flat = lambda c, t: F.to_json(F.struct(c)) if t.startswith(("array", "map", "struct")) else F.col(c).cast("string")
    values = [flat(c, t) for c, t in sorted(columns.items())]
    return F.concat(*(F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values))


def corpus_fingerprint(df: DataFrame) -> DataFrame:
    """One row: a SHA-256 that does not depend on the order of rows.

    Equal rows are counted first; digests then meet by their first six hexadecimal digits, these groups by the first
    three, and those in one digest, so that a group holds a 16,777,216th of the distinct rows or 4,096 strings.
    """
    rows = df.select(F.sha2(canonical(dict(df.dtypes)), 256).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    level = rows.select("k", F.concat_ws("=", "k", F.col("n").cast("string")).alias("h"))
    for digits in (6, 3, 0):
        together = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "\n"), 256)
        level = level.groupBy(F.substring("k", 1, digits).alias("p")).agg(together.alias("h")).withColumnRenamed("p", "k")
    return level.agg(F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)).alias("fingerprint"))


def page_quality(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, text) with meaningful characters (all but white space), words and quality: empty, sparse
    (below 80 characters or 10 words), usable (below 200 or 30) or good."""
    text = F.coalesce("text", F.lit(""))
    n = F.length(F.regexp_replace(text, r"\s+", ""))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    rows = pages.select("doc_id", "page", n.alias("meaningful"), words.alias("words"))
    sparse, usable = (F.col("meaningful") < 80) | (F.col("words") < 10), (F.col("meaningful") < 200) | (F.col("words") < 30)
    return rows.withColumn("quality", F.when(F.col("meaningful") == 0, "empty").when(sparse, "sparse").when(usable, "usable").otherwise("good"))


def ocr_gate(quality: DataFrame) -> DataFrame:
    """(doc_id, pages, meaningful, needs_ocr): text layers below max(80, 10 a page) characters need recognition."""
    per = quality.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("meaningful").alias("meaningful"))
    return per.withColumn("needs_ocr", F.col("meaningful") < F.greatest(F.lit(80), 10 * F.col("pages")))


def region_paper_counts(regions: DataFrame, assignments: DataFrame) -> DataFrame:
    per = assignments.groupBy("regionId").agg(F.count_distinct("paperId").alias("n"))
    return regions.join(per, "regionId", "left").select("regionId", F.coalesce("declared", "n", F.lit(0)).alias("papers"))


def centroid(points: DataFrame, key: str, position: str = "position") -> DataFrame:
    return points.groupBy(key).agg(F.array(*(F.avg(F.col(position)[k]) for k in range(3))).alias("center"))


def counts_with_zero(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """(key, count) for every parent, 0 where it has no child: notes of a region, say."""
    per = children.groupBy(key).agg(F.count("*").alias("count"))
    return parents.select(key).join(per, key, "left").fillna(0, ["count"])


def pending_badge(current: DataFrame, staged: DataFrame, changes: DataFrame) -> DataFrame:
    """One row (new_papers, badge): staged papers that are new, else the number of changes, at least one."""
    new = staged.select("id").join(current.select("id"), "id", "left_anti").agg(F.count("*").alias("new_papers"))
    both = new.crossJoin(changes.agg(F.count("*").alias("n")))
    return both.select("new_papers", F.when(F.col("new_papers") > 0, F.col("new_papers")).otherwise(F.greatest(F.lit(1), F.col("n"))).alias("badge"))


def issue_count(*lists: Column) -> Column:
    """How many distinct ids several arrays name together."""
    return F.size(F.array_distinct(F.flatten(F.array(*(F.coalesce(c, F.array().cast("array<string>")) for c in lists)))))
