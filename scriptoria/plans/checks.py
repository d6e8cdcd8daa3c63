"""Integrity rules as tables of violations: (severity, code, id). A rule that holds gives no row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import vocabulary as V
from scriptoria.operators.aggregates import located_papers, relation_scores
from scriptoria.operators.joins import at_most, exact_cover, missing_from


def violations(df: DataFrame, key: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """One pass over df: a row for each rule (code to (severity, condition of a violation)) that a row breaks."""
    found = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(code).alias("code"))) for code, (s, c) in rules.items()))
    rows = df.select(F.col(key).cast("string").alias("id"), F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f"))
    return rows.select("f.severity", "f.code", "id")


def _named(df: DataFrame, key: str, severity: str, code: str) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(key).cast("string").alias("id"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def doctor(graph: DataFrame, index: DataFrame, files: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Graph, catalog and files of papers against each other; members, if given, are the papers of the graph's clusters.

    graph has (paperId, verificationStatus, sourcePath, revision), index (paperId, verificationStatus, sourcePath,
    storageMode, sourceSha256, revision, cardSha256, fulltextSha256, claimsSha256), files (paperId, cardStatus,
    cardSourcePath, cardSha256, fulltextSha256, claimsSha256, claimsRevision, sourceSha256, sourceReadable): null
    where there is no such file. index may have pinSourceSha256, the source that its artifacts were made from, and files
    sourceSafe, whether a linked source's path can be trusted.
    """
    index = index if "pinSourceSha256" in index.columns else index.withColumn("pinSourceSha256", F.col("sourceSha256"))
    files = files if "sourceSafe" in files.columns else files.withColumn("sourceSafe", F.lit(True))
    g = graph.select("paperId", F.col("verificationStatus").alias("gStatus"), F.col("sourcePath").alias("gSource"), F.col("revision").alias("gRevision"), F.lit(True).alias("inGraph"))
    i = index.select("paperId", F.col("verificationStatus").alias("iStatus"), F.col("sourcePath").alias("iSource"), "storageMode", F.col("sourceSha256").alias("expected"), F.col("revision").alias("iRevision"), F.col("cardSha256").alias("pinCard"), F.col("fulltextSha256").alias("pinText"), F.col("claimsSha256").alias("pinClaims"), F.col("pinSourceSha256").alias("pinSource"), F.lit(True).alias("inIndex"))
    rows = g.join(i, "paperId", "full_outer").join(files, "paperId", "left")
    both = F.col("inGraph").isNotNull() & F.col("inIndex").isNotNull()
    there = both & F.col("cardSha256").isNotNull() & F.col("fulltextSha256").isNotNull()
    pinned = there & F.col("iRevision").isNotNull()
    source = F.col("sourceSha256").isNotNull()
    rules = {
        "index.paper_missing": ("error", F.col("inGraph").isNotNull() & F.col("inIndex").isNull()),
        "projection.orphan_papers": ("warning", F.col("inGraph").isNull()),
        "source.reference_drift": ("error", both & ~F.col("iSource").eqNullSafe(F.col("gSource"))),
        "artifact.file_missing": ("error", both & (F.col("cardSha256").isNull() | F.col("fulltextSha256").isNull())),
        "source.card_reference_drift": ("error", there & ~F.col("cardSourcePath").eqNullSafe(F.col("iSource"))),
        "projection.verification_status_drift": ("warning", there & ~F.col("iStatus").eqNullSafe(F.col("cardStatus"))),
        "graph.verification_status_drift": ("error", there & ~F.col("gStatus").eqNullSafe(F.col("cardStatus"))),
        "source.linked_missing": ("error", there & ~source & (F.col("storageMode") == "linked")),
        "source.managed_missing": ("error", there & ~source & (F.coalesce("storageMode", F.lit("managed")) != "linked")),
        "source.linked_unsafe": ("error", there & source & (F.col("storageMode") == "linked") & ~F.coalesce("sourceSafe", F.lit(False))),
        "artifact.source_revision_conflict": ("error", pinned & ~F.col("pinSource").eqNullSafe(F.col("expected"))),
        "source.unreadable": ("error", there & source & ~F.coalesce("sourceReadable", F.lit(True))),
        "source.hash_mismatch": ("error", there & source & (F.col("sourceSha256") != F.col("expected"))),
        "artifact.unpinned": ("warning", there & F.col("iRevision").isNull()),
        "artifact.card_hash_mismatch": ("error", pinned & ~F.col("pinCard").eqNullSafe(F.col("cardSha256"))),
        "artifact.fulltext_hash_mismatch": ("error", pinned & ~F.col("pinText").eqNullSafe(F.col("fulltextSha256"))),
        "artifact.claims_unreadable": ("error", pinned & F.col("claimsSha256").isNull()),
        "artifact.claims_hash_mismatch": ("error", pinned & F.col("claimsSha256").isNotNull() & ~F.col("pinClaims").eqNullSafe(F.col("claimsSha256"))),
        "artifact.claims_revision_conflict": ("error", pinned & F.col("claimsSha256").isNotNull() & ~F.col("claimsRevision").eqNullSafe(F.col("iRevision"))),
        "graph.artifacts_unpinned": ("warning", F.col("inGraph").isNotNull() & F.col("gRevision").isNull()),
    }
    found = violations(rows, "paperId", rules)
    if members is None:
        return found
    none = graph.limit(1).crossJoin(members.limit(1).agg(F.count("*").alias("clustered"))).where("clustered = 0")  # one row at most
    return found.unionByName(none.select(F.lit("warning").alias("severity"), F.lit("hierarchy.missing").alias("code"), F.lit("all").alias("id")))


def severity_counts(found: DataFrame) -> DataFrame:
    return found.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warning", "info")))


def staging(current_papers: DataFrame, papers: DataFrame, categories: DataFrame, relations: DataFrame, current_relations: DataFrame) -> DataFrame:
    """Rules for a staged snapshot: nothing is removed, references exist, memberships are at most two and agree.

    papers has (id, primaryCategory, secondaryCategory, categoryIds, useCount, position), categories (id, kind).
    """
    cats = categories.select(F.col("id").alias("_c")).distinct()
    ids = papers.select(F.col("id").alias("_p")).distinct()
    unknown = lambda df, col: df.where(F.col(col).isNotNull()).join(cats, F.col(col) == F.col("_c"), "left_anti")
    listed = F.coalesce("categoryIds", F.filter(F.array("primaryCategory", "secondaryCategory"), lambda c: c.isNotNull()))
    loose = papers.select("id", F.explode("categoryIds").alias("c")).join(cats, F.col("c") == F.col("_c"), "left_anti")
    ends = union([relations.select("id", F.col(e).alias("p")) for e in ("source", "target")])
    return union([
        _named(missing_from(current_papers, papers, "id"), "id", "error", "paper_removed"),
        _named(missing_from(current_relations, relations, "id"), "id", "error", "relation_removed"),
        _named(papers.groupBy("id").count().where("count > 1"), "id", "error", "paper_repeated"),
        _named(unknown(papers, "primaryCategory"), "id", "error", "primary_unknown"),
        _named(unknown(papers, "secondaryCategory"), "id", "error", "secondary_unknown"),
        _named(loose.select("id").distinct(), "id", "error", "category_unknown"),
        _named(ends.join(ids, F.col("p") == F.col("_p"), "left_anti").select("id").distinct(), "id", "error", "relation_end_unknown"),
        violations(papers.withColumn("_all", listed), "id", {
            "secondary_equals_primary": ("error", F.col("secondaryCategory") == F.col("primaryCategory")),
            "category_repeated": ("error", F.size("_all") != F.size(F.array_distinct("_all"))),
            "primary_not_listed": ("error", ~F.array_contains("_all", F.col("primaryCategory"))),
            "too_many_categories": ("error", F.size("_all") > 2),
            "use_count_changed": ("error", F.coalesce("useCount", F.lit(-1)) != 0),
            "position": ("error", ~F.coalesce((F.size("position") == 3) & F.forall("position", lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))),
        }),
        _named(categories.where("kind = 'macro'").agg(F.count("*").alias("n")).where("n > 10"), "n", "error", "too_many_regions"),
    ])


def paper_rules(papers: DataFrame) -> DataFrame:
    """Row rules of a paper's stored form: paths that follow from the id, a hash, and a status that its files allow."""
    pid = F.col("id").cast("string")
    path = lambda pattern: F.concat(F.lit(pattern.split("*")[0]), pid, F.lit(pattern.split("*")[1]))
    return violations(papers, "id", {
        "source_kind": ("error", ~F.coalesce(F.col("sourceKind").isin("pdf", "arxiv"), F.lit(False))),
        "sha256": ("error", ~F.coalesce(F.col("sha256").rlike(V.SHA256), F.lit(False))),
        "source_path": ("error", (F.col("storageMode") == "managed") & ~F.col("pdfPath").eqNullSafe(path("Library/PDFs/*.pdf"))),
        "card_path": ("error", ~F.col("cardPath").eqNullSafe(path("Knowledge/cards/*.md"))),
        "fulltext_path": ("error", ~F.col("fulltextPath").eqNullSafe(path("Knowledge/fulltext/*.md"))),
        "evidence_count": ("error", F.coalesce("evidenceCount", F.lit(-1)) < 0),
        "ocr_state": ("error", (F.col("verificationStatus") == "needs_ocr") & (F.col("extractionStatus") != "needs_ocr")),
        "verified_without_evidence": ("error", (F.col("verificationStatus") == "evidence_verified") & ((F.col("extractionStatus") != "extracted") | (F.col("evidenceCount") < 1) | (F.col("metadataStatus") == "provisional"))),
    })


def relation_rules(relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Recomputes strength, confidence, eligibility and status of scored relations and names what differs.

    relations has (id, source, target, strength, confidence, formalEligible, status and a column a component),
    evidence (relationId, paperId, located).
    """
    again = relation_scores(relations.withColumnsRenamed({"strength": "s0", "confidence": "c0"}))
    ends = relations.select(F.col("id").alias("relationId"), "source", "target")
    good = located_papers(evidence.join(ends, "relationId")).withColumnRenamed("relationId", "id")
    rows = again.join(good, "id", "left").withColumn("eligible", F.coalesce("eligible", F.lit(False)))
    formal = F.col("eligible") & (F.col("strength") >= V.FORMAL[0]) & (F.col("confidence") >= V.FORMAL[1])
    maybe = F.col("eligible") & (F.col("strength") >= V.CANDIDATE[0]) & (F.col("confidence") >= V.CANDIDATE[1])
    expected = F.when(formal, "verified").when(maybe, "candidate").otherwise("suggestion")
    third = evidence.join(ends, "relationId").where("paperId <> source and paperId <> target").select(F.col("relationId").alias("id")).distinct()
    return union([
        violations(rows, "id", {
            "score_not_in_rubric": ("error", ~F.col("valid")),
            "strength": ("error", ~F.col("s0").eqNullSafe(F.col("strength"))),
            "confidence": ("error", ~F.col("c0").eqNullSafe(F.col("confidence"))),
            "eligibility": ("error", ~F.col("formalEligible").eqNullSafe(F.col("eligible"))),
            "status": ("error", ~F.col("status").eqNullSafe(expected)),
        }),
        _named(third, "id", "error", "third_paper"),
    ])


def new_region_rules(regions: DataFrame, members: DataFrame, scores: DataFrame, old: DataFrame) -> DataFrame:
    """New regions need four primary papers, a consistency of 70 to 100 and, for every member and old region, a match
    below 60. regions has (regionId, consistency), members (regionId, paperId), scores (paperId, oldRegion, score)."""
    count = regions.join(members.groupBy("regionId").agg(F.count("*").alias("n")), "regionId", "left").fillna(0, ["n"])
    every = members.join(regions.select("regionId"), "regionId", "left_semi").crossJoin(at_most(old.select(F.col("regionId").alias("oldRegion")), 10, "old regions"))
    have = every.join(scores, ["paperId", "oldRegion"], "left")
    return union([
        violations(count, "regionId", {"too_few_members": ("error", F.col("n") < 4), "consistency": ("error", ~F.coalesce(F.col("consistency").between(V.CONSISTENCY, 100), F.lit(False)))}),
        violations(have, "paperId", {"score_missing": ("error", F.col("score").isNull()), "fits_old_region": ("error", F.col("score") >= V.LOW_FIT), "score_range": ("error", ~F.col("score").between(0, 100))}).distinct(),
    ])


def partition_rules(papers: DataFrame, assignments: DataFrame) -> DataFrame:
    """What is wrong with partitions (optionId, paperId, regionId): there are to be three options, each covering every
    paper once, and each two of them disagreeing about at least 15 % of the pairs of papers."""
    options = assignments.select("optionId").distinct()
    number = options.agg(F.count("*").alias("n")).where("n <> 3")
    wanted = papers.select("paperId").crossJoin(at_most(options, 100, "options"))
    key = lambda df: df.select(F.concat_ws("/", "optionId", F.col("paperId").cast("string")).alias("k"))
    problem = exact_cover(key(wanted), key(assignments), "k")
    cover = problem.select(F.lit("error").alias("severity"), F.concat(F.lit("assignment_"), "problem").alias("code"), F.col("k").alias("id"))
    alike = option_differences(assignments).where(~F.col("distinct_enough"))
    alike = alike.select(F.lit("error").alias("severity"), F.lit("options_too_alike").alias("code"), F.concat_ws("/", "a", "b").alias("id"))
    return union([_named(number, "n", "error", "not_three_options"), cover, alike])


def option_differences(assignments: DataFrame) -> DataFrame:
    """(a, b, pairs, disagreements, distinct_enough) for each two options, from their contingency tables."""
    x = assignments.select(F.col("optionId").alias("a"), "paperId", F.col("regionId").alias("ra"))
    y = assignments.select(F.col("optionId").alias("b"), "paperId", F.col("regionId").alias("rb"))
    cells = x.join(y, "paperId").where("a < b").groupBy("a", "b", "ra", "rb").agg(F.count("*").alias("n"))
    two = F.expr("n * (n - 1) div 2")
    both = cells.groupBy("a", "b").agg(F.sum(two).alias("together"), F.sum("n").alias("papers"))
    left = cells.groupBy("a", "b", "ra").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(F.sum(two).alias("ca"))
    right = cells.groupBy("a", "b", "rb").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(F.sum(two).alias("cb"))
    out = both.join(left, ["a", "b"]).join(right, ["a", "b"])
    out = out.select("a", "b", F.expr("papers * (papers - 1) div 2").alias("pairs"), (F.col("ca") + F.col("cb") - 2 * F.col("together")).alias("disagreements"))
    return out.withColumn("distinct_enough", F.col("disagreements") >= F.greatest(F.lit(1), F.ceil(F.col("pairs") * 0.15)))


def manifest_rules(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """A manifest (path, sha256, bytes, role) against files (path, sha256, bytes): the same paths, hashes and sizes,
    no path or role twice."""
    rows = manifest.withColumnsRenamed({"sha256": "m", "bytes": "mb"}).join(files.withColumnsRenamed({"sha256": "f", "bytes": "fb"}), "path", "full_outer")
    return union([
        violations(rows, "path", {"file_missing": ("error", F.col("f").isNull()), "not_listed": ("error", F.col("m").isNull()), "hash": ("error", F.col("m") != F.col("f")), "size": ("error", F.col("mb") != F.col("fb"))}),
        _named(manifest.groupBy("path").count().where("count > 1"), "path", "error", "path_repeated"),
        _named(manifest.where("role is not null").groupBy("role").count().where("count > 1"), "role", "error", "role_repeated"),
    ])


def attestation_rules(accepted: DataFrame, pages: DataFrame) -> DataFrame:
    """Each accepted candidate stands on exactly one attested page: pages has (page, candidateIds)."""
    seen = pages.select(F.explode("candidateIds").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    rows = accepted.select("id").join(seen, "id", "full_outer").join(accepted.select("id").withColumn("_in", F.lit(True)), "id", "left")
    return violations(rows, "id", {"not_attested": ("error", F.col("n").isNull()), "attested_twice": ("error", F.col("n") > 1), "not_accepted": ("error", F.col("_in").isNull())})


def pin_rules(pins: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Pinned hashes (paperId, sha256, revision) against the artifacts' own."""
    rows = pins.withColumnsRenamed({"sha256": "p", "revision": "pr"}).join(artifacts.withColumnsRenamed({"sha256": "a", "revision": "ar"}), "paperId", "left")
    return violations(rows, "paperId", {"artifact_missing": ("error", F.col("a").isNull()), "hash": ("error", F.col("p") != F.col("a")), "revision": ("error", F.col("pr") != F.col("ar"))})


def projection_rules(projections: DataFrame, ledgers: DataFrame) -> DataFrame:
    rows = projections.withColumnsRenamed({"revision": "pr", "ledgerHash": "ph"}).join(ledgers.withColumnsRenamed({"revision": "lr", "ledgerHash": "lh"}), "projectId", "left")
    return violations(rows, "projectId", {"ledger_missing": ("error", F.col("lr").isNull()), "revision": ("error", F.col("pr") != F.col("lr")), "ledger_hash": ("error", F.col("ph") != F.col("lh"))})


def identity_preserved(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows that a localization lost, added, or changed in columns that it must keep."""
    b = before.select(key, F.struct(*columns).alias("b"))
    a = after.select(key, F.struct(*columns).alias("a"))
    return violations(b.join(a, key, "full_outer"), key, {"lost": ("error", F.col("a").isNull()), "added": ("error", F.col("b").isNull()), "changed": ("error", F.to_json("a") != F.to_json("b"))})


def decision_closure(pointer: DataFrame, ledger: DataFrame) -> DataFrame:
    """A decision pointer (decisionId, sha256) has exactly one ledger line, with that hash."""
    seen = ledger.groupBy("decisionId").agg(F.count("*").alias("n"), F.min("sha256").alias("h"))
    return violations(pointer.join(seen, "decisionId", "left"), "decisionId", {"line_missing": ("error", F.col("n").isNull()), "several_lines": ("error", F.col("n") > 1), "hash": ("error", F.col("h") != F.col("sha256"))})


def status_steps(changes: DataFrame) -> DataFrame:
    """Illegal steps of the queue's states: pending, processing, ready, organized. changes has (id, revision, status)."""
    before = F.lag("status").over(Window.partitionBy("id").orderBy("revision"))
    step = F.concat_ws(">", F.coalesce("_b", F.lit("")), "status")
    legal = ("pending", "pending>processing", "processing>ready", "processing>pending", "ready>organized", "ready>pending", "ready>processing")
    marked = changes.withColumn("_b", before).withColumn("_s", F.when(F.col("_b").isNull(), F.col("status")).otherwise(step))
    return marked.where(~F.col("_s").isin(*legal) & ~F.col("_b").eqNullSafe(F.col("status"))).select("id", "revision", F.col("_s").alias("step"))


def universe_rules(
    regions: DataFrame, assets: DataFrame, papers: DataFrame, relations: DataFrame, staging: str = "staging", card_schema: str = "card-v1", rubric: str = "relation-v1"
) -> DataFrame:
    """A whole published state: regions and their artwork, papers, relations. A row for each rule that something breaks.

    regions have (id, kind, assetId, assignmentOrder), assets (id, src, enabled), papers (id, useCount, primaryCategory,
    categoryIds, classificationStatus, cardPath, fulltextPath, pdfPath, storageMode, sourcePath, linkedRoot, relativePath,
    sha256, sourceKind, verificationStatus, metadataStatus, extractionStatus, cardSchema, evidenceCount), relations (id,
    source, target, note, status, located, legacy, rubric, strength, confidence, legacyConfidence, formalEligible), where
    located names the papers that its evidence has exact places in, null for a relation without evidence. staging is the id
    of the one system region, card_schema and rubric name the versions that cards and scores must have.
    """
    macro = F.coalesce("kind", F.lit("macro")) == "macro"
    whole = regions.agg(F.count_if(macro).alias("macros"), F.count_if(F.col("kind") == "system").alias("systems"), F.count_if((F.col("kind") == "system") & (F.col("id").cast("string") != staging)).alias("strange"))
    enabled = assets.agg(F.count_if("enabled").alias("enabled"), F.count("*").alias("assets"))
    head = whole.crossJoin(F.broadcast(enabled)).withColumn("all", F.lit("all"))  # one row each
    twice = lambda df, key, code: _named(df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1"), key, "error", code)
    known = regions.select(F.col("id").alias("_region"), F.col("kind").alias("_kind")).dropDuplicates(["_region"])
    drawn = regions.where(macro).join(assets.select(F.col("id").alias("assetId"), F.lit(True).alias("_asset")).dropDuplicates(["assetId"]), "assetId", "left")
    named = papers.select("id", F.explode("categoryIds").alias("_region")).join(known, "_region", "left_anti").select("id").distinct()
    rows = papers.join(known, F.col("primaryCategory") == F.col("_region"), "left")
    card, text, pdf = (F.concat(F.lit(a), F.col("id").cast("string"), F.lit(b)) for a, b in (("Knowledge/cards/", ".md"), ("Knowledge/fulltext/", ".md"), ("Library/PDFs/", ".pdf")))
    straight = lambda c: F.col(c).startswith("/") & ~F.col(c).rlike(r"//|/\.\.?(/|$)|./$")
    linked = straight("sourcePath") & straight("linkedRoot") & (F.length("relativePath") > 0) & ~F.col("relativePath").rlike(r"(^|/)(\.\.?)?(/|$)") & (F.concat_ws("/", "linkedRoot", "relativePath") == F.col("sourcePath"))
    managed = F.coalesce("storageMode", F.lit("managed")) == "managed"
    path = F.when(managed, F.col("sourcePath") == pdf).when(F.col("storageMode") == "linked", linked).otherwise(False) & (F.col("pdfPath") == F.col("sourcePath"))
    fails = lambda c: ~F.coalesce(c, F.lit(False))
    verified = F.col("verificationStatus") == "evidence_verified"
    of_papers = {
        "use_count": ("error", fails(F.col("useCount") >= 0)), "primary_unknown": ("error", F.col("_region").isNull()),
        "staged_not_provisional": ("error", (F.col("_kind") == "system") & fails(F.col("classificationStatus") == "provisional")),
        "region_count": ("error", fails(F.size("categoryIds").between(1, 2))), "primary_not_listed": ("error", fails(F.array_contains("categoryIds", F.col("primaryCategory")))),
        "region_repeated": ("error", F.size(F.array_distinct("categoryIds")) < F.size("categoryIds")), "card_path": ("error", fails(F.col("cardPath") == card)), "fulltext_path": ("error", fails(F.col("fulltextPath") == text)),
        "statuses": ("error", fails(F.col("verificationStatus").isin(*V.PAPER_STATES) & F.col("metadataStatus").isin(*V.METADATA_STATES))),
        "source": ("error", fails(path & F.col("sha256").rlike("^[a-f0-9]{64}$") & F.col("sourceKind").isin("pdf", "arxiv"))),
        "artifacts": ("error", fails(F.col("extractionStatus").isin(*V.EXTRACTION_STATES) & (F.col("cardSchema") == card_schema) & (F.col("evidenceCount") >= 0))),
        "verified_without_evidence": ("error", verified & fails((F.col("extractionStatus") == "extracted") & (F.col("evidenceCount") >= 1) & (F.col("metadataStatus") != "provisional"))),
    }
    ids = papers.select("id").distinct()
    ends = relations.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("_s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(True).alias("_t")), "target", "left")
    legacy, scored = F.coalesce("legacy", F.lit(False)), F.coalesce(~F.col("legacy"), F.lit(True)) & F.coalesce(F.col("rubric") == rubric, F.lit(False))
    share = lambda c: F.coalesce(F.col(c).between(0, 100) & (F.col(c) == F.floor(c)), F.lit(False))
    passes = lambda s, c: F.coalesce(F.col("formalEligible") & (F.col("strength") >= s) & (F.col("confidence") >= c), F.lit(False))
    due = F.when(passes(*V.FORMAL), "verified").when(passes(*V.CANDIDATE), "candidate").otherwise("suggestion")
    places = F.coalesce("located", F.array().cast(dict(relations.dtypes)["located"]))
    of_relations = {
        "source_unknown": ("error", F.col("_s").isNull()), "target_unknown": ("error", F.col("_t").isNull()),
        "note_status_evidence": ("error", fails((F.length("note") > 0) & (F.length("status") > 0) & F.col("located").isNotNull())),
        "legacy_scored": ("error", legacy & ~((F.col("status") == "pending_scoring") & F.col("strength").isNull() & F.col("confidence").isNull() & F.coalesce(F.col("legacyConfidence").between(0, 1), F.lit(False)))),
        "rubric": ("error", ~legacy & ~F.coalesce(F.col("rubric") == rubric, F.lit(False))), "scores": ("error", scored & ~(share("strength") & share("confidence"))), "status_due": ("error", scored & ~F.col("status").eqNullSafe(due)),
        "not_located": ("error", scored & F.coalesce(F.col("status").isin("candidate", "verified"), F.lit(False)) & ~(F.array_contains(places, F.col("source")) & F.array_contains(places, F.col("target")))),
    }
    return union([
        violations(head, "all", {"macro_count": ("error", F.col("macros") > V.MOST_MACROS), "system_regions": ("error", (F.col("systems") > 1) | (F.col("strange") > 0)), "assets_enabled": ("error", F.col("enabled") < V.MOST_MACROS), "no_assets": ("error", F.col("assets") == 0)}),
        twice(assets, "id", "asset_repeated"), twice(assets, "src", "asset_path_repeated"), violations(assets, "id", {"asset_path": ("error", fails(F.col("src").startswith("./")))}),
        twice(regions, "id", "region_id_repeated"), violations(regions, "id", {"region_kind": ("error", ~F.coalesce("kind", F.lit("macro")).isin("macro", "system"))}),
        violations(drawn, "id", {"asset_unknown": ("error", F.col("_asset").isNull()), "assignment_order": ("error", fails(F.col("assignmentOrder") > 0))}), twice(drawn, "assignmentOrder", "assignment_order_repeated"),
        twice(papers, "id", "paper_repeated"), violations(rows, "id", of_papers), _named(named, "id", "error", "region_unknown"), violations(ends, "id", of_relations),
    ])


def proposal_rules(proposals: DataFrame, options: DataFrame, regions: DataFrame, assignments: DataFrame, schema: str = "partition-proposals-v1") -> DataFrame:
    """Partition proposals, of which each offers three options that a reader may choose from.

    proposals have (proposalId, schemaVersion, status, artifactFingerprint, searchSummary, truthPath, truthSha256,
    baseRevision, selectedOptionId, decisionId, decisionRecordPath, decisionRecordSha256, selectedSnapshotPath,
    selectedSnapshotSha256), options (proposalId, optionId, name, summary, strengths, limitations, regionCount,
    paperCount), regions (proposalId, optionId, regionId, name, paperCount), assignments (proposalId, optionId, paperId,
    regionId). A proposal is waiting or selected; counts that an option states are those of its regions and papers, whose
    sums agree; every paper of an option has one region of that option; a selection names its option, its line in the
    ledger of decisions and its snapshot. ids of options are proposal/option.
    """
    fails = lambda c: ~F.coalesce(c, F.lit(False))
    sha = lambda c: F.lower(c).rlike("^[0-9a-f]{64}$")
    inside = lambda c, folder: F.col(c).startswith(folder) & F.lower(c).endswith(".json") & ~F.col(c).rlike(r"(^|/)\.\.?(/|$)|//")
    key = ["proposalId", "optionId"]
    offered = options.groupBy("proposalId").agg(F.count("*").alias("_options"), F.collect_set("optionId").alias("_ids"))  # a few each
    heads = proposals.join(offered, "proposalId", "left")
    chosen = F.array_contains("_ids", F.col("selectedOptionId")) & (F.length("decisionId") > 0) & (F.col("decisionRecordPath") == V.DECISIONS) & sha("decisionRecordSha256") & inside("selectedSnapshotPath", V.PROPOSAL_SNAPSHOTS) & sha("selectedSnapshotSha256")
    of_heads = {
        "schema": ("error", fails(F.col("schemaVersion") == schema)), "status": ("error", fails(F.col("status").isin("awaiting_user", "selected"))), "fingerprint": ("error", fails(sha("artifactFingerprint"))), "summary": ("error", fails(F.length("searchSummary") > 0)),
        "truth": ("error", fails(inside("truthPath", V.PROPOSAL_TRUTHS) & sha("truthSha256"))), "base_revision": ("error", fails(F.length(F.col("baseRevision").cast("string")) > 0)), "option_count": ("error", fails(F.col("_options") == 3)),
        "selection": ("error", (F.col("status") == "selected") & fails(chosen)),
    }
    named = lambda df: df.withColumn("id", F.concat_ws("/", F.col("proposalId").cast("string"), F.col("optionId").cast("string")))
    own = regions.groupBy(*key).agg(F.count("*").alias("_regions"), F.sum("paperCount").alias("_sum"))
    # Papers are counted once before their options are.
    per_paper = assignments.groupBy(*key, "paperId").agg(F.count("*").alias("n"))
    papers = per_paper.groupBy(*key).agg(F.sum("n").alias("_rows"), F.count("*").alias("_papers"))
    rows = named(options.join(own, key, "left").join(papers, key, "left").fillna(0, ["_regions", "_rows", "_papers"]))
    of_options = {
        "option_fields": ("error", fails((F.length(F.col("optionId").cast("string")) > 0) & (F.length("name") > 0) & F.col("summary").isNotNull() & F.col("strengths").isNotNull() & F.col("limitations").isNotNull())),
        "region_count": ("error", ~F.col("_regions").between(1, V.MOST_MACROS)), "metrics": ("error", fails((F.col("regionCount") == F.col("_regions")) & (F.col("paperCount") == F.col("_rows")))),
        "paper_sum": ("error", fails((F.col("_sum") == F.col("paperCount")) & (F.col("_papers") == F.col("paperCount")))),
    }
    twice = lambda df, columns, code: _named(named(df.groupBy(*columns).count().where("count > 1")), "id", "error", code)
    strange = assignments.join(regions.select(*key, "regionId").distinct(), [*key, "regionId"], "left_anti")
    whole = (F.col("paperCount") >= 0) & (F.col("paperCount") == F.floor("paperCount"))
    return union([
        violations(heads, "proposalId", of_heads), violations(rows, "id", of_options), twice(options, key, "option_repeated"), twice(regions, [*key, "regionId"], "region_repeated"), twice(assignments, [*key, "paperId"], "assignment_repeated"),
        violations(named(regions), "id", {"region_fields": ("error", fails((F.length(F.col("regionId").cast("string")) > 0) & (F.length("name") > 0) & whole))}),
        _named(named(strange), "id", "error", "assignment_region"), _named(named(assignments.where("paperId is null")), "id", "error", "assignment_paper"),
    ])
