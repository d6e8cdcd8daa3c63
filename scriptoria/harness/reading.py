"""Queries about what is read and reviewed: previews, handoffs, routing texts, evidence, options, final statuses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.harness.adapters import first_line, statuses, table
from scriptoria.harness.rules import query as registered
from scriptoria.harness.state import memory_log
from scriptoria.operators import aggregates, predicates, ranking, windows
from scriptoria.plans import checks, context, fulltext, memory, review

QUERIES, SQL = {}, {}


def query(sql: str):
    return registered(sql, QUERIES, SQL)


NORMAL = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
#: State of the items of memory_log as a batch replays it, in which a retired item that is superseded stays so.
ITEMS = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations),
c AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
item AS (
  SELECT t.conv_id, k, 'mem-' || k || '-' || conv_id AS id, role, text, CASE WHEN k = 1 AND n >= 3 THEN 'superseded' WHEN k = 3 AND n >= 6 AND conv_id % 5 <> 0 THEN 'retired' ELSE 'active' END AS state, k = 2 AND n >= 4 AS against
  FROM t JOIN c USING (conv_id) WHERE k IN (1, 2, 3) OR k > 7)
"""


@query(ITEMS + f"""
SELECT id AS "memoryId", score::INTEGER AS score FROM (
  SELECT id, {" + ".join(f"CASE WHEN contains(body, '{t}') THEN 2 ELSE 0 END" for t in ("the", "tion", "user"))} AS score
  FROM (SELECT id, {NORMAL.format("role || ' ' || text")} AS body FROM item WHERE state = 'active' AND text <> ''))
WHERE score > 0
""")
def memory_preview(spark, sf_dir):
    return context.rank_memory(memory.items(memory_log(spark, sf_dir)), F.lit("The tion, user!")).select("memoryId", "score")


@query(ITEMS + """
SELECT 'p-' || conv_id AS "projectId", part, id AS "memoryId", role AS title FROM (
  SELECT *, unnest(CASE WHEN against THEN ['active', 'conflict'] ELSE ['active'] END) AS part FROM item WHERE state = 'active')
""")
def handoffs(spark, sf_dir):
    return memory.handoff(memory.items(memory_log(spark, sf_dir)))


@query(r"""
WITH c AS (
  SELECT conv_id, CASE role WHEN 'user' THEN 'research_question' WHEN 'assistant' THEN 'result' ELSE 'method' END AS kind, length(text) % 100 AS score, turn, text FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, kind ORDER BY score DESC, turn, text) AS k FROM c),
m AS (SELECT conv_id, string_agg(text, ' ' ORDER BY kind, k) AS more FROM k WHERE k <= 2 GROUP BY conv_id)
SELECT doc_id AS query_id, md5(split_part(text, chr(10), 1) || coalesce(' ' || more, '')) AS text_md5, CASE WHEN more IS NULL THEN 12 ELSE 24 END AS keep FROM documents LEFT JOIN m ON conv_id = doc_id
""")
def routing_texts(spark, sf_dir):
    kind = F.when(F.col("role") == "user", "research_question").when(F.col("role") == "assistant", "result").otherwise("method")
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), kind.alias("kind"), (F.length("text") % 100).alias("score"), F.col("turn").alias("page"), F.col("text").alias("start"), "text")
    titles = table(spark, sf_dir, "documents").select("doc_id", first_line("text").alias("title"))
    return fulltext.routing_queries(titles, c).select("query_id", F.md5("text").alias("text_md5"), "keep")


@query("""
SELECT l_orderkey || '-' || l_linenumber AS "candidateId", l_orderkey AS "paperId", 'E' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_partkey, l_orderkey || '-' || l_linenumber) AS "evidenceId" FROM lineitem
""")
def evidence_numbers(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    accepted = li.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("candidateId"), F.col("l_orderkey").alias("paperId"), F.col("l_suppkey").alias("page"), F.col("l_partkey").alias("start"))
    return review.numbered_evidence(accepted).select("candidateId", "paperId", "evidenceId")


@query("""
WITH o AS (SELECT n AS option_id, doc_id, CASE WHEN (doc_id + n) % 3 = 0 THEN lang ELSE source END AS region FROM documents, range(3) r(n)),
s AS (SELECT doc_id, max(CASE WHEN quality = 1 AND toxic = 0 THEN 0 WHEN quality = 1 THEN 1 END) AS r FROM labels GROUP BY doc_id),
c AS (SELECT conv_id, min(conv_id || '-' || turn) AS claim FROM conversations JOIN s ON doc_id = conv_id WHERE r IS NOT NULL GROUP BY conv_id)
SELECT option_id AS "optionId", o.doc_id AS "paperId", region AS "regionId", claim AS "claimId", CASE WHEN d.lang = region THEN 82 WHEN o.doc_id % 4 <> 0 THEN 66 ELSE 18 END AS "oldRegionScore"
FROM o LEFT JOIN c ON conv_id = o.doc_id LEFT JOIN (SELECT doc_id, lang FROM documents WHERE doc_id % 4 <> 0) d ON d.doc_id = o.doc_id
""")
def option_plans(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    plan = d.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("optionId"), F.col("doc_id").alias("paperId"), "lang", "source")
    plan = plan.select("optionId", "paperId", F.when((F.col("paperId") + F.col("optionId")) % 3 == 0, F.col("lang")).otherwise(F.col("source")).alias("regionId"))
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("claimId"), F.col("conv_id").alias("paperId"))
    claims = c.join(statuses(spark, sf_dir), "paperId")
    old = d.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("paperId"), F.col("lang").alias("regionId"))
    return review.plan_options(plan, claims, old)


@query("""
WITH s AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'evidence_verified' WHEN quality = 1 THEN 'needs_attention' ELSE 'card_draft' END AS status, quality + toxic AS n FROM labels)
SELECT d.doc_id AS id, coalesce(status, 'imported') AS "verificationStatus", coalesce(n, 0)::INTEGER AS "evidenceCount", CASE WHEN d.doc_id % 2 = 0 THEN split_part(text, ' ', 1) ELSE 'none' END AS summary
FROM documents d LEFT JOIN s USING (doc_id)
""")
def finalized_papers(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    papers = d.select(F.col("doc_id").alias("id"), F.lit("imported").alias("verificationStatus"), F.lit("none").alias("summary"))
    n = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paperId"), (F.col("quality") + F.col("toxic")).alias("n"))
    cards = statuses(spark, sf_dir).join(n, "paperId").select(F.col("paperId").alias("id"), F.col("verificationStatus").alias("status"), F.col("n").alias("evidenceCount"))
    summaries = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("card_id"), F.substring_index("text", " ", 1).alias("summary"))
    return review.finalize(papers, cards, summaries).select("id", "verificationStatus", "evidenceCount", "summary")


@query("SELECT c_custkey, c_nationkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def best_of_groups(spark, sf_dir):
    return windows.top_per_group(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_custkey", "c_nationkey")


@query("""
SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size > 25, p_size DESC, p_partkey)::INTEGER AS place FROM part WHERE lower(concat_ws(' ', p_name, p_type)) LIKE '%gear promo%' ORDER BY place LIMIT 40
""")
def library_page(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    items = p.select(F.col("p_partkey").alias("id"), F.lit("organized").alias("status"), (F.col("p_size") <= 25).alias("catalog"), F.col("p_size").alias("number"), "p_name", "p_type")
    first = predicates.library_list(items, "organized", " Gear PROMO", "p_name", "p_type").limit(40)
    order = Window.orderBy(F.when(F.col("catalog"), 0).otherwise(1), F.desc("number"), "id")  # at most 40 rows
    return first.select("id", F.row_number().over(order).alias("place"))


@query("""
WITH r AS (SELECT o_orderkey AS id, o_orderdate::DATE::VARCHAR AS stamp FROM orders WHERE o_orderstatus <> 'P')
SELECT id, stamp FROM r ORDER BY stamp DESC, id LIMIT 25
""")
def latest_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("stamp"))
    return ranking.latest_first(rows, "stamp", "id").limit(25)


@query("""
SELECT selector, n FROM (
  SELECT selector, count(c.l_orderkey) AS n FROM (SELECT unnest(['0-0-0-0', 'E7', 'E9', 'E-none']) AS selector) s
  LEFT JOIN lineitem c ON selector = l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey OR selector = 'E' || l_partkey OR selector = 'E' || l_suppkey GROUP BY selector) WHERE n = 0
UNION ALL SELECT 'found', count(*) FROM lineitem WHERE l_partkey IN (7, 9) OR l_suppkey IN (7, 9)
""")
def claim_selectors(spark, sf_dir):
    """How many claims the selectors name, and the selectors that name none."""
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    marks = F.array_distinct(F.array(*(F.concat(F.lit("E"), F.col(c).cast("string")) for c in ("l_partkey", "l_suppkey"))))
    found, unknown = predicates.selected_claims(li.select(key.alias("claimId"), marks.alias("evidenceIds")), ["0-0-0-0", "E7", "E9", "E-none"])
    return unknown.select("selector", F.lit(0).cast("long").alias("n")).unionByName(found.agg(F.lit("found").alias("selector"), F.count("*").alias("n")))


@query(r"""
WITH region AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey = 24 THEN 'other' WHEN n_nationkey >= 22 THEN 'system' END AS kind, n_nationkey % 12 AS asset, n_nationkey % 20 AS ord FROM nation),
asset AS (SELECT n AS id, CASE WHEN n = 3 THEN 'x' ELSE './' || n % 9 END AS src, n < 8 AS enabled FROM range(11) r(n)),
paper AS (
  SELECT p_partkey AS id, p_size AS k, p_size % 26 AS region, CASE WHEN p_size = 1 THEN -1 ELSE p_size END AS uses, CASE WHEN p_size = 2 THEN 1 WHEN p_size = 3 THEN 3 ELSE 2 END AS n FROM part),
pcode AS (
  SELECT id, unnest([
    CASE WHEN k = 1 THEN 'use_count' END, CASE WHEN region = 25 THEN 'primary_unknown' END, CASE WHEN region IN (22, 23) AND k % 2 = 0 THEN 'staged_not_provisional' END, CASE WHEN k = 3 THEN 'region_count' END,
    CASE WHEN k = 4 THEN 'primary_not_listed' END, CASE WHEN k = 3 AND (region = 0 OR (region + 1) % 26 = 0) THEN 'region_repeated' END, CASE WHEN k = 5 THEN 'card_path' END, CASE WHEN k = 6 THEN 'fulltext_path' END,
    CASE WHEN k = 7 THEN 'statuses' END, CASE WHEN k IN (8, 9, 10) THEN 'source' END, CASE WHEN k = 11 THEN 'artifacts' END, CASE WHEN k IN (11, 12) THEN 'verified_without_evidence' END,
    CASE WHEN region = 25 OR (k NOT IN (2, 4) AND (region + 1) % 26 = 25) THEN 'region_unknown' END]) AS code FROM paper),
rel AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, l_partkey AS source, l_suppkey AS target, l_linenumber AS k, l_quantity * 2 AS s, round(100 - l_discount * 400, 3) AS c, l_tax < 0.06 AS formal FROM lineitem),
rcode AS (
  SELECT id, unnest([
    CASE WHEN source NOT IN (SELECT id FROM paper) THEN 'source_unknown' END, CASE WHEN target NOT IN (SELECT id FROM paper) THEN 'target_unknown' END, CASE WHEN k = 1 THEN 'note_status_evidence' END,
    CASE WHEN k = 2 AND s > 50 THEN 'legacy_scored' END, CASE WHEN k = 3 THEN 'rubric' END, CASE WHEN k NOT IN (2, 3) AND (s <> floor(s) OR c <> floor(c) OR s > 100 OR c > 100 OR c < 0) THEN 'scores' END,
    CASE WHEN k NOT IN (2, 3) AND 'candidate' <> CASE WHEN formal AND s >= 60 AND c >= 75 THEN 'verified' WHEN formal AND s >= 40 AND c >= 50 THEN 'candidate' ELSE 'suggestion' END THEN 'status_due' END,
    CASE WHEN k = 1 OR k = 4 AND source <> target THEN 'not_located' END]) AS code FROM rel)
SELECT code, count(*) AS n FROM (
  SELECT code FROM pcode WHERE code IS NOT NULL UNION ALL SELECT code FROM rcode WHERE code IS NOT NULL
  UNION ALL SELECT unnest(['macro_count', 'system_regions', 'assets_enabled']) UNION ALL SELECT 'asset_path' FROM asset WHERE src = 'x'
  UNION ALL SELECT 'asset_path_repeated' FROM asset GROUP BY src HAVING count(*) > 1
  UNION ALL SELECT 'region_kind' FROM region WHERE kind = 'other'
  UNION ALL SELECT 'asset_unknown' FROM region WHERE kind IS NULL AND asset = 11
  UNION ALL SELECT 'assignment_order' FROM region WHERE kind IS NULL AND ord = 0
  UNION ALL SELECT 'assignment_order_repeated' FROM region WHERE kind IS NULL GROUP BY ord HAVING count(*) > 1)
GROUP BY code
""")
def universe_problems(spark, sf_dir):
    """A published state made of nation, part and lineitem with faults by size and line number: how often each rule is broken."""
    n, p, li = (table(spark, sf_dir, t) for t in ("nation", "part", "lineitem"))
    key = F.col("n_nationkey")
    regions = n.select(key.cast("long").alias("id"), F.when(key == 24, "other").when(key >= 22, "system").alias("kind"), (key % 12).cast("long").alias("assetId"), (key % 20).alias("assignmentOrder"))
    assets = spark.range(11).select("id", F.when(F.col("id") == 3, "x").otherwise(F.concat(F.lit("./"), (F.col("id") % 9).cast("string"))).alias("src"), (F.col("id") < 8).alias("enabled"))
    k, pid = F.col("p_size"), F.col("p_partkey").cast("string")
    region, beside = (k % 26).cast("long"), ((k % 26 + 1) % 26).cast("long")
    path = lambda a, b, wrong: F.when(k == wrong, "elsewhere").otherwise(F.concat(F.lit(a), pid, F.lit(b)))
    linked = k.isin(9, 13)
    pdf = F.when(linked, F.concat(F.lit("/root/"), pid)).otherwise(path("Library/PDFs/", ".pdf", 8))
    papers = p.select(
        F.col("p_partkey").alias("id"), F.when(k == 1, -1).otherwise(k).alias("useCount"), region.alias("primaryCategory"),
        F.when(k == 2, F.array(region)).when(k == 3, F.array(region, beside, F.lit(0).cast("long"))).when(k == 4, F.array(F.lit(0).cast("long"))).otherwise(F.array(region, beside)).alias("categoryIds"),
        F.when(k % 2 == 0, "confirmed").otherwise("provisional").alias("classificationStatus"), path("Knowledge/cards/", ".md", 5).alias("cardPath"), path("Knowledge/fulltext/", ".md", 6).alias("fulltextPath"), pdf.alias("pdfPath"),
        F.when(linked, "linked").alias("storageMode"), pdf.alias("sourcePath"), F.lit("/root").alias("linkedRoot"), F.when(k == 9, F.concat(F.lit("../root/"), pid)).otherwise(pid).alias("relativePath"), F.when(k == 10, "x").otherwise(F.sha2("p_name", 256)).alias("sha256"),
        F.lit("pdf").alias("sourceKind"), F.when(k == 7, "ready").otherwise("evidence_verified").alias("verificationStatus"), F.lit("official_verified").alias("metadataStatus"), F.when(k == 11, "lost").otherwise("extracted").alias("extractionStatus"),
        F.lit("card-v1").alias("cardSchema"), F.when(k == 12, 0).otherwise(1).alias("evidenceCount"),
    )
    line = F.col("l_linenumber")
    s, c = F.col("l_quantity") * 2, F.round(100 - F.col("l_discount") * 400, 3)
    blank = (line == 2) & (s <= 50)
    relations = li.select(
        F.concat_ws("-", *(F.col(x).cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey"))).alias("id"), F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.lit("note").alias("note"),
        F.when(line == 2, "pending_scoring").otherwise("candidate").alias("status"), F.when(line == 1, None).when(line == 4, F.array("l_partkey")).otherwise(F.array("l_partkey", "l_suppkey")).alias("located"), (line == 2).alias("legacy"),
        F.when(line == 3, "other").otherwise("relation-v1").alias("rubric"), F.when(~blank, s).alias("strength"), F.when(~blank, c).alias("confidence"), F.lit(0.5).alias("legacyConfidence"), (F.col("l_tax") < 0.06).alias("formalEligible"),
    )
    return checks.universe_rules(regions, assets, papers, relations).groupBy("code").agg(F.count("*").alias("n"))


#: The size that stands for each of the doctor's findings, in the query below and in its SQL.
FINDINGS = (
    "projection.orphan_papers", "index.paper_missing", "source.reference_drift", "artifact.file_missing", "source.card_reference_drift", "projection.verification_status_drift", "graph.verification_status_drift",
    "source.linked_missing", "source.managed_missing", "source.unreadable", "source.hash_mismatch", "artifact.unpinned", "artifact.card_hash_mismatch", "artifact.fulltext_hash_mismatch", "artifact.claims_unreadable",
    "artifact.claims_hash_mismatch", "artifact.claims_revision_conflict", "graph.artifacts_unpinned", "source.linked_unsafe", "artifact.source_revision_conflict",
)


@query(f"""
WITH f(size, code) AS (VALUES {", ".join(f"({k}, '{c}')" for k, c in enumerate(FINDINGS, 1))})
SELECT code, count(*) AS n FROM part JOIN f ON p_size = size GROUP BY code UNION ALL SELECT 'hierarchy.missing', 1
""")
def doctor_findings(spark, sf_dir):
    """The integrity doctor over part, where each of the sizes 1 to 20 has another fault: all of its codes are reached."""
    p = table(spark, sf_dir, "part")
    k, h, own = F.col("p_size"), F.sha2("p_name", 256), F.concat(F.lit("Library/"), F.col("p_partkey").cast("string"))
    fault = lambda n, wrong, right: F.when(k == n, wrong).otherwise(right)
    none, other = F.lit(None).cast("string"), F.lit("other")
    code = {c: n for n, c in enumerate(FINDINGS, 1)}
    pid = F.col("p_partkey").alias("paperId")
    status = F.lit("card_draft")
    linked = F.when(k.isin(code["source.linked_missing"], code["source.linked_unsafe"]), "linked").otherwise("managed")
    graph = p.where(k != code["projection.orphan_papers"]).select(
        pid, fault(code["graph.verification_status_drift"], other, status).alias("verificationStatus"), fault(code["source.reference_drift"], other, own).alias("sourcePath"), fault(code["graph.artifacts_unpinned"], F.lit(None).cast("int"), F.lit(1)).alias("revision"))
    index = p.where(k != code["index.paper_missing"]).select(
        pid, fault(code["projection.verification_status_drift"], other, status).alias("verificationStatus"), own.alias("sourcePath"), linked.alias("storageMode"), h.alias("sourceSha256"), fault(code["artifact.unpinned"], F.lit(None).cast("int"), F.lit(1)).alias("revision"),
        fault(code["artifact.card_hash_mismatch"], other, h).alias("cardSha256"), fault(code["artifact.fulltext_hash_mismatch"], other, h).alias("fulltextSha256"), fault(code["artifact.claims_hash_mismatch"], other, h).alias("claimsSha256"),
        fault(code["artifact.source_revision_conflict"], other, h).alias("pinSourceSha256"))
    gone = k.isin(code["source.linked_missing"], code["source.managed_missing"])
    files = p.select(
        pid, status.alias("cardStatus"), fault(code["source.card_reference_drift"], other, own).alias("cardSourcePath"), fault(code["artifact.file_missing"], none, h).alias("cardSha256"), h.alias("fulltextSha256"), fault(code["artifact.claims_unreadable"], none, h).alias("claimsSha256"),
        fault(code["artifact.claims_revision_conflict"], F.lit(2), F.lit(1)).alias("claimsRevision"), F.when(gone, none).otherwise(fault(code["source.hash_mismatch"], other, h)).alias("sourceSha256"), (k != code["source.unreadable"]).alias("sourceReadable"), (k != code["source.linked_unsafe"]).alias("sourceSafe"))
    return checks.doctor(graph, index, files, members=p.limit(0)).groupBy("code").agg(F.count("*").alias("n"))


@query(ITEMS + r"""
, r AS (SELECT conv_id, id, text, 1500 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM item WHERE state = 'active' AND text <> '')
SELECT 'p-' || conv_id AS "projectId", id AS "memoryId", CASE WHEN length(text) <= room THEN text ELSE regexp_replace(substr(text, 1, (room - 22)::BIGINT), '\s+$', '') || chr(10) || chr(10) || '[text truncated]' END AS kept
FROM r WHERE room >= 100
""")
def pack_memory(spark, sf_dir):
    """The memory that a pack takes in: what its claims have left of the budget, items in order."""
    return context.select_memory(memory.items(memory_log(spark, sf_dir)), 1_500).select("projectId", "memoryId", "kept")


@query("""
WITH item AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'organized' ELSE 'processing' END AS status, (o_custkey % 50)::BIGINT AS number FROM orders)
SELECT status, count(*) AS n, min(number) AS first FROM item GROUP BY status UNION ALL SELECT 'ready', 0, NULL
""")
def queue_parts(spark, sf_dir):
    """The parts that the queue is shown in, with their sizes and first numbers."""
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "organized").otherwise("processing")
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), (F.col("o_custkey") % 50).alias("number"))
    parts = [df.agg(F.lit(s).alias("status"), F.count("*").alias("n"), F.min("number").alias("first")) for s, df in predicates.queue_split(items).items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(r"""
WITH c AS (SELECT conv_id, turn, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY conv_id || '-' || turn) AS k FROM conversations WHERE role = 'assistant')
SELECT md5(line) AS line_md5 FROM (SELECT DISTINCT conv_id || ': ' || text AS line FROM c WHERE k <= 2)
""")
def limitation_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    claims = c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("claimId"), F.col("conv_id").cast("string").alias("paperId"), F.lit("limitation").alias("type"), "text")
    papers = c.groupBy(F.col("conv_id").cast("string").alias("paperId")).agg(F.min("conv_id").alias("place"))
    return context.limitations(claims, papers).select(F.md5("line").alias("line_md5"))


@query("""SELECT 'p-' || conv_id AS "projectId", md5(role || ': ' || text) AS line_md5 FROM conversations WHERE turn = 0""")
def conflict_lines(spark, sf_dir):
    """Contradicted items as a pack lists them: first turns stand for them here."""
    c = table(spark, sf_dir, "conversations")
    evidence = F.when(F.col("turn") == 0, "contradicted").otherwise("provisional")
    items = c.select(F.concat(F.lit("p-"), F.col("conv_id").cast("string")).alias("projectId"), F.col("turn").cast("string").alias("memoryId"), F.col("role").alias("title"), F.col("text").alias("content"), F.lit("active").alias("state"), evidence.alias("evidenceState"), F.lit("finding").alias("type"))
    return context.conflicts(items).select("projectId", F.md5("line").alias("line_md5"))


@query("""
WITH c AS (SELECT c_nationkey AS n, c_custkey % 4 AS r, c_custkey % 5 AS f FROM customer),
t AS (SELECT n_nationkey AS n, count(r) AS papers, count(*) FILTER (r = 0) AS fours, count(*) FILTER (f = 0) AS fives FROM nation LEFT JOIN c ON n = n_nationkey GROUP BY n_nationkey),
f AS (
  SELECT n, unnest(CASE n WHEN 1 THEN ['schema'] WHEN 2 THEN ['status'] WHEN 3 THEN ['fingerprint'] WHEN 4 THEN ['summary'] WHEN 5 THEN ['truth'] WHEN 6 THEN ['base_revision'] WHEN 7 THEN ['option_count'] WHEN 9 THEN ['option_repeated', 'option_count'] WHEN 15 THEN ['selection'] ELSE [] END) AS code, 1 AS k FROM t
  UNION ALL
  SELECT n, unnest(CASE n WHEN 8 THEN ['option_fields'] WHEN 10 THEN ['metrics'] WHEN 11 THEN ['metrics', 'paper_sum'] WHEN 12 THEN ['region_fields'] WHEN 13 THEN ['paper_sum'] WHEN 18 THEN ['region_repeated', 'metrics', 'paper_sum'] ELSE [] END), 3 FROM t
  UNION ALL SELECT n, 'assignment_region', 3 * fours FROM t WHERE n = 14
  UNION ALL SELECT n, unnest(CASE WHEN fives > 0 THEN ['assignment_repeated', 'metrics'] ELSE [] END), unnest([3 * fives, 3]) FROM t WHERE n = 17)
SELECT code, sum(k)::BIGINT AS n FROM f WHERE code IS NOT NULL AND k > 0 GROUP BY code
""")
def proposal_problems(spark, sf_dir):
    """A proposal for each nation, whose options deal its customers to four regions; nations 1 to 18 have a fault each."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    k = F.col("n_nationkey")
    fault = lambda m, wrong, right: F.when(k == m, wrong).otherwise(right)
    sha, none = F.sha2("n_name", 256), F.lit(None).cast("string")
    chosen = lambda right: F.when(k == 16, right).otherwise(none)
    proposals = n.select(
        k.alias("proposalId"), fault(1, F.lit("v0"), F.lit("partition-proposals-v1")).alias("schemaVersion"), F.when(k == 2, "open").when(k.isin(15, 16), "selected").otherwise("awaiting_user").alias("status"), fault(3, F.lit("x"), sha).alias("artifactFingerprint"),
        fault(4, F.lit(""), F.lit("found")).alias("searchSummary"), fault(5, F.lit("Planning/partition-proposals/../x.json"), F.lit("Planning/partition-proposals/x.json")).alias("truthPath"), sha.alias("truthSha256"), fault(6, none, F.lit("7")).alias("baseRevision"),
        chosen(F.lit("1")).alias("selectedOptionId"), chosen(F.lit("d")).alias("decisionId"), chosen(F.lit("Planning/partition-decisions.jsonl")).alias("decisionRecordPath"), chosen(sha).alias("decisionRecordSha256"),
        chosen(F.lit("Planning/partition-snapshots/s.json")).alias("selectedSnapshotPath"), chosen(sha).alias("selectedSnapshotSha256"),
    )
    dealt = n.select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("o"))
    here = c.select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    sizes = here.groupBy("n_nationkey").agg(F.count("*").alias("papers"))
    options = dealt.join(sizes, "n_nationkey", "left").fillna(0, ["papers"]).where("not (n_nationkey = 7 and o = 2)")
    options = options.unionByName(options.where("n_nationkey = 9 and o = 0"))
    tag, oid = F.array(F.lit("x")), F.col("o").cast("string").alias("optionId")
    options = options.select(k.alias("proposalId"), oid, fault(8, F.lit(""), F.lit("name")).alias("name"), F.lit("why").alias("summary"), tag.alias("strengths"), tag.alias("limitations"), fault(10, F.lit(5), F.lit(4)).alias("regionCount"), fault(11, F.col("papers") + 1, F.col("papers")).alias("paperCount"))
    four = dealt.select("n_nationkey", "o", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("r")).where("not (n_nationkey = 7 and o = 2)")
    placed = dealt.join(here, "n_nationkey").select("n_nationkey", "o", "c_custkey", ((F.col("c_custkey") + F.col("o")) % 4).cast("int").alias("r")).where("not (n_nationkey = 7 and o = 2)")
    counts = placed.groupBy("n_nationkey", "o", "r").agg(F.count("*").alias("n"))
    regions = four.join(counts, ["n_nationkey", "o", "r"], "left").fillna(0, ["n"])
    regions = regions.unionByName(regions.where("n_nationkey = 18 and r = 0").withColumn("n", F.lit(1).cast("long")))
    r = F.col("r")
    regions = regions.select(k.alias("proposalId"), oid, r.cast("string").alias("regionId"), F.when((k == 12) & (r == 0), "").otherwise("name").alias("name"), F.when((k == 13) & (r == 1), F.col("n") + 1).otherwise(F.col("n")).alias("paperCount"))
    assigned = placed.unionByName(placed.where("n_nationkey = 17 and c_custkey % 5 = 0"))
    assigned = assigned.select(k.alias("proposalId"), oid, F.col("c_custkey").alias("paperId"), F.when((k == 14) & (F.col("c_custkey") % 4 == 0), "9").otherwise(r.cast("string")).alias("regionId"))
    return checks.proposal_rules(proposals, options, regions, assigned).groupBy("code").agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT p_brand AS grp, p_size, CASE WHEN p_size % 5 = 0 THEN 'sidm' WHEN p_size % 5 = 1 THEN 'Review' ELSE p_name END AS raw FROM part WHERE p_brand <> 'Brand#1'),
g AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS place FROM (SELECT DISTINCT p_brand AS grp FROM part)),
c AS (SELECT grp, lower(trim(raw)) AS tag, count(*) AS n FROM t WHERE lower(trim(raw)) <> 'review' GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, tag) AS k, first_value(tag) OVER (PARTITION BY grp ORDER BY n DESC, tag) AS first FROM c),
two AS (SELECT grp, first, arg_min(tag, k) FILTER (k > 1 AND NOT contains(tag, first) AND NOT contains(first, tag)) AS second FROM k GROUP BY grp, first),
named AS (SELECT grp, list_transform([first, second], lambda x: CASE WHEN x = 'sidm' THEN 'SIDM' ELSE list_aggregate(list_transform(string_split(x, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') END) AS names FROM two)
SELECT g.grp, CASE WHEN names IS NULL THEN 'Research Cluster ' || (place + 1) ELSE array_to_string(list_filter(names, lambda x: x IS NOT NULL), ' & ') END AS name FROM g LEFT JOIN named USING (grp)
""")
def cluster_names(spark, sf_dir):
    """Brands as clusters, named by their parts' tags; the first brand has none."""
    p = table(spark, sf_dir, "part")
    raw = F.when(F.col("p_size") % 5 == 0, "sidm").when(F.col("p_size") % 5 == 1, "Review").otherwise(F.col("p_name"))
    tags = p.where("p_brand <> 'Brand#1'").select(F.col("p_brand").alias("grp"), T.tag(raw).alias("tag"))
    brands = p.select(F.col("p_brand").alias("grp")).distinct()
    groups = brands.select("grp", (F.row_number().over(Window.orderBy("grp")) - 1).alias("place"))  # tens of brands
    return aggregates.cluster_names(groups, tags)
