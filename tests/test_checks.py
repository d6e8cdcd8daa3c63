from pyspark.sql import functions as F

from scriptoria.operators import joins
from scriptoria.plans import checks, review
from scriptoria.sources import writers


def codes(df):
    return sorted((r["code"], r["id"]) for r in df.collect())


def test_doctor_names_every_drift(spark):
    graph = spark.createDataFrame([("ok", "card_draft", "s", 1), ("lost", "card_draft", "s", None), ("drift", "evidence_verified", "other", 1)], "paperId string, verificationStatus string, sourcePath string, revision int")
    pin = lambda i, **k: (i, k.get("status", "card_draft"), "s", k.get("mode", "managed"), "src", k.get("rev", 1), "card", "text", "claims")
    index = spark.createDataFrame([pin("ok"), pin("drift", rev=2), pin("orphan")], "paperId string, verificationStatus string, sourcePath string, storageMode string, sourceSha256 string, revision int, cardSha256 string, fulltextSha256 string, claimsSha256 string")
    files = spark.createDataFrame([("ok", "card_draft", "s", "card", "text", "claims", 1, "src", True), ("drift", "card_draft", "s", "card2", "text", "claims", 1, "src2", True)], "paperId string, cardStatus string, cardSourcePath string, cardSha256 string, fulltextSha256 string, claimsSha256 string, claimsRevision int, sourceSha256 string, sourceReadable boolean")
    found = checks.doctor(graph, index, files)
    assert codes(found) == [
        ("artifact.card_hash_mismatch", "drift"), ("artifact.claims_revision_conflict", "drift"), ("graph.artifacts_unpinned", "lost"), ("graph.verification_status_drift", "drift"), ("index.paper_missing", "lost"),
        ("projection.orphan_papers", "orphan"), ("source.hash_mismatch", "drift"), ("source.reference_drift", "drift"),
    ]
    assert tuple(checks.severity_counts(found).first()) == (6, 2, 0)


def test_staging_rules(spark):
    schema = "id string, primaryCategory string, secondaryCategory string, categoryIds array<string>, useCount int, position array<double>"
    old = spark.createDataFrame([("a",), ("z",)], "id string")
    papers = spark.createDataFrame([("a", "c1", None, ["c1"], 0, [0.0, 0.0, 0.0]), ("b", "c1", "c1", ["c1", "c9"], 2, [0.0])], schema)
    cats = spark.createDataFrame([("c1", "macro")], "id string, kind string")
    rel = spark.createDataFrame([("r", "a", "nobody")], "id string, source string, target string")
    assert codes(checks.staging(old, papers, cats, rel, rel)) == [("category_unknown", "b"), ("paper_removed", "z"), ("position", "b"), ("relation_end_unknown", "r"), ("secondary_equals_primary", "b"), ("use_count_changed", "b")]


def test_file_and_pointer_rules(spark):
    manifest = spark.createDataFrame([("a", "1", 3, "card"), ("b", "2", 3, "card"), ("c", "3", 3, None)], "path string, sha256 string, bytes int, role string")
    files = spark.createDataFrame([("a", "1", 3), ("b", "9", 4), ("d", "4", 1)], "path string, sha256 string, bytes int")
    assert codes(checks.manifest_rules(manifest, files)) == [("file_missing", "c"), ("hash", "b"), ("not_listed", "d"), ("role_repeated", "card"), ("size", "b")]
    accepted = spark.createDataFrame([("x",), ("y",)], "id string")
    pages = spark.createDataFrame([(1, ["x", "z"]), (2, ["x"])], "page int, candidateIds array<string>")
    assert codes(checks.attestation_rules(accepted, pages)) == [("attested_twice", "x"), ("not_accepted", "z"), ("not_attested", "y")]
    pins = spark.createDataFrame([("p", "1", 1), ("q", "1", 1)], "paperId string, sha256 string, revision int")
    assert codes(checks.pin_rules(pins, pins.where("paperId = 'p'").withColumn("revision", F.lit(2)))) == [("artifact_missing", "q"), ("revision", "p")]
    led = spark.createDataFrame([("p", 3, "h")], "projectId string, revision int, ledgerHash string")
    assert codes(checks.projection_rules(led.withColumn("revision", F.lit(2)), led)) == [("revision", "p")]
    ptr = spark.createDataFrame([("d1", "h"), ("d2", "h")], "decisionId string, sha256 string")
    assert codes(checks.decision_closure(ptr, spark.createDataFrame([("d1", "x"), ("d1", "x")], ptr.schema))) == [("hash", "d1"), ("line_missing", "d2"), ("several_lines", "d1")]
    steps = spark.createDataFrame([("i", 1, "pending"), ("i", 2, "processing"), ("i", 3, "organized"), ("j", 1, "ready")], "id string, revision int, status string")
    assert sorted((r["id"], r["step"]) for r in checks.status_steps(steps).collect()) == [("i", "processing>organized"), ("j", "ready")]
    texts = spark.createDataFrame([("a", "x", "en"), ("b", "y", "en")], "id string, name string, text string")
    assert codes(checks.identity_preserved(texts, texts.where("id = 'a'").withColumn("name", F.lit("z")), "id", ["name"])) == [("changed", "a"), ("lost", "b")]


def test_region_and_paper_rules(spark):
    regions = spark.createDataFrame([("n", 60.0)], "regionId string, consistency double")
    members = spark.createDataFrame([("n", p) for p in "abc"], "regionId string, paperId string")
    scores = spark.createDataFrame([("a", "o", 10.0), ("b", "o", 70.0)], "paperId string, oldRegion string, score double")
    old = spark.createDataFrame([("o",)], "regionId string")
    assert codes(checks.new_region_rules(regions, members, scores, old)) == [("consistency", "n"), ("fits_old_region", "b"), ("score_missing", "c"), ("too_few_members", "n")]
    papers = spark.createDataFrame(
        [("p", "pdf", "a" * 64, "managed", "Library/PDFs/p.pdf", "Knowledge/cards/p.md", "Knowledge/fulltext/p.md", 1, "evidence_verified", "extracted", "checked"), ("q", "web", "zz", "managed", "x", None, "y", -1, "evidence_verified", "pending", "provisional")],
        "id string, sourceKind string, sha256 string, storageMode string, pdfPath string, cardPath string, fulltextPath string, evidenceCount int, verificationStatus string, extractionStatus string, metadataStatus string")
    assert [c for c, i in codes(checks.paper_rules(papers)) if i == "q"] == ["card_path", "evidence_count", "fulltext_path", "sha256", "source_kind", "source_path", "verified_without_evidence"]
    assert not [c for c, i in codes(checks.paper_rules(papers)) if i == "p"]


def test_catalog_and_review_helpers(spark):
    base = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, t string, n int")
    up = spark.createDataFrame([("a", "z")], "id string, t string")
    assert sorted(map(tuple, joins.overlay(base, up, "id").collect())) == [("a", "z", 1), ("b", "y", 2)]
    assert sorted((r["id"], r["decision"]) for r in joins.decide(base, spark.createDataFrame([("a", "accept")], "id string, decision string")).collect()) == [("a", "accept"), ("b", "reject")]
    kept = review.adopt(base.withColumnRenamed("t", "title"), spark.createDataFrame([("b", " new  title ")], "id string, title string"))
    assert sorted((r["id"], r["title"]) for r in kept.collect()) == [("a", "x"), ("b", "new title")]
    moved = review.migrate(spark.createDataFrame([("p", "T", True, "h", None)], "id string, title string, verified boolean, sha256 string, useCount int")).first()
    assert moved["verificationStatus"] == "evidence_verified" and moved["source"]["pdfPath"] == "Library/PDFs/p.pdf" and moved["useCount"] == 0
    plan = spark.createDataFrame([("o", "p", "r1"), ("o", "q", "r2")], "optionId string, paperId string, regionId string")
    claims = spark.createDataFrame([("c2", "p", "needs_attention"), ("c1", "p", "evidence_verified")], "claimId string, paperId string, verificationStatus string")
    got = {r["paperId"]: (r["claimId"], r["oldRegionScore"]) for r in review.plan_options(plan, claims, spark.createDataFrame([("p", "r1")], "paperId string, regionId string")).collect()}
    assert got == {"p": ("c1", 82), "q": (None, 18)}
    notes = spark.createDataFrame([("n1", "p", "text", "pending", 1, "2024")], "id string, paperId string, text string, status string, revision int, createdAt string")
    assert writers.annotation_mirror(notes).first()["markdown"].startswith("## n1")
