"""Filters, set operations and value rules over the harness tables, each beside its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.functions import scalar as S
from scriptoria.functions import text as T
from scriptoria.harness.adapters import first_line, relations, table, usage
from scriptoria.harness.tables import EDGES, USAGE
from scriptoria.operators import aggregates, joins, predicates, ranking, windows
from scriptoria.plans import checks, duplicates
from scriptoria.sources import readers

QUERIES, SQL = {}, {}


def query(sql: str, queries: dict = QUERIES, oracles: dict = SQL):
    """Register a function under its name with this SQL."""

    def keep(f):
        queries[f.__name__], oracles[f.__name__] = f, sql
        return f

    return keep


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def members_within(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return predicates.within(table(spark, sf_dir, "documents"), good, "doc_id").select("doc_id", "lang")


@query(EDGES + """, p AS (
  SELECT *, greatest(0, least(100, CASE WHEN strength <= 1 THEN strength * 100 ELSE strength END)) AS s, greatest(0, least(100, CASE WHEN confidence <= 1 THEN confidence * 100 ELSE confidence END)) AS c FROM r),
t AS (SELECT *, CASE WHEN NOT eligible OR status = 'suggestion' THEN 'suggestion' WHEN status = 'verified' THEN CASE WHEN s >= 60 AND c >= 75 THEN 'verified' ELSE 'suggestion' END
    ELSE CASE WHEN s >= 40 AND c >= 50 THEN 'candidate' ELSE 'suggestion' END END AS state FROM p),
x AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0)
SELECT id, state FROM t WHERE state IN ('verified', 'candidate') AND strength >= 70 AND source IN (SELECT id FROM x) AND target IN (SELECT id FROM x)
""")
def visible_relations(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return predicates.visible_relations(relations(spark, sf_dir), known, 70.0, ["verified", "candidate"]).select("id", "state")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND length(text) > 0")
def memory_facets(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    state = F.when(F.length("text") > 0, "active").otherwise("retired")
    items = c.select("conv_id", "turn", state.alias("state"), F.col("role").alias("type"), F.lit("provisional").alias("evidenceState"), F.lit("aiInference").alias("provenance"))
    return predicates.memory_facets(items, kind="user", evidence="provisional").select("conv_id", "turn")


@query("""
SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
ORDER BY o_orderkey LIMIT 5
""")
def batch_candidates(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "pending").otherwise("organized")
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("number"), status.alias("status"), (F.col("o_totalprice") > 1000).alias("prepared"))
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return predicates.batch_candidates(items, done).select("id")


@query("SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) WHERE trim(t) <> '' AND NOT regexp_matches(t, '(?i)\\bTODO\\b') GROUP BY doc_id")
def claims_without_todo(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return predicates.without_todo(lines).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query(USAGE + """, c AS (SELECT "paperId" AS id, count(DISTINCT key) AS n FROM u GROUP BY ALL)
SELECT doc_id AS id, coalesce(n, 0)::INTEGER AS "useCount" FROM documents LEFT JOIN c ON doc_id = id
""")
def papers_with_usage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(7).alias("useCount"))
    counts = aggregates.usage_counts(usage(spark, sf_dir)).groupBy("paperId").agg(F.sum("count").alias("n"))
    return predicates.with_usage(docs, counts)


@query("""
SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'verified_original_source' WHEN quality = 1 THEN 'verified_with_attention_flag' ELSE 'provisional_not_for_formal_use' END AS trust, count(*) AS n
FROM labels GROUP BY ALL
""")
def claim_trust(spark, sf_dir):
    from scriptoria.harness.adapters import statuses

    return statuses(spark, sf_dir).groupBy(predicates.claim_trust(F.col("verificationStatus")).alias("trust")).agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT *, p_size < 40 AS src, p_size < 30 AS card, p_size < 35 AS full_, p_size AS ev, CASE WHEN p_brand < 'Brand#3' THEN 'arxiv' ELSE 'pdf' END AS kind,
  CASE WHEN p_retailprice > 1400 THEN 'evidence_verified' WHEN p_retailprice > 1200 THEN 'odd' ELSE 'imported' END AS st FROM part),
k AS (SELECT *, CASE WHEN st <> 'odd' THEN st WHEN NOT src THEN 'source_missing' WHEN NOT full_ THEN 'imported' WHEN NOT card THEN 'extracted' ELSE 'card_draft' END AS known FROM s),
q AS (SELECT *, CASE WHEN known = 'evidence_verified' AND NOT (card AND full_ AND ev >= 1) THEN CASE WHEN src THEN 'needs_attention' ELSE 'source_missing' END ELSE known END AS kept FROM k)
SELECT p_partkey AS id, CASE WHEN NOT src AND kind <> 'arxiv' THEN 'source_missing' ELSE kept END AS status FROM q
""")
def repaired_statuses(spark, sf_dir):
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    status = F.when(F.col("p_retailprice") > 1400, "evidence_verified").when(F.col("p_retailprice") > 1200, "odd").otherwise("imported")
    kind = F.when(F.col("p_brand") < "Brand#3", "arxiv").otherwise("pdf")
    return p.select(F.col("p_partkey").alias("id"), predicates.repaired_status(status, size < 40, size < 30, size < 35, size, kind).alias("status"))


@query("""
SELECT p_partkey AS id, CASE WHEN p_size > 45 THEN 'source_missing' WHEN p_size > 40 THEN 'source_hash_mismatch' WHEN p_size > 35 THEN 'source_hash_missing' WHEN p_size > 30 THEN 'card_missing'
  WHEN p_size > 25 THEN 'fulltext_missing' END AS issue FROM part
""")
def integrity_issues(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), predicates.integrity_issue(size > 45, size > 40, size > 35, size > 30, size > 25).alias("issue"))


@query("SELECT conv_id, turn FROM conversations WHERE role IN ('assistant', 'system')")
def section_rows(spark, sf_dir):
    cards = table(spark, sf_dir, "conversations").withColumnRenamed("role", "heading")
    return predicates.section_rows(cards, ["Assistant", "system"]).select("conv_id", "turn")


@query("""
WITH w AS (SELECT p_partkey AS id, p_size > 25 AS named, p_brand, unnest(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: length(x) >= 4))) AS w FROM part),
v AS (SELECT DISTINCT p_brand AS r, w FROM w),
n AS (SELECT id, r, count(*) AS n FROM w JOIN v USING (w) WHERE NOT named GROUP BY ALL),
b AS (SELECT id, r, row_number() OVER (PARTITION BY id ORDER BY n DESC, r) AS k FROM n)
SELECT p_partkey AS id, p_brand AS "regionId" FROM part WHERE p_size > 25 UNION ALL SELECT id, r FROM b WHERE k = 1
""")
def best_regions(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("words", T.region_words(F.col("p_name")))
    items = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("regionId"), "words")
    vocabulary = p.select(F.col("p_brand").alias("regionId"), F.explode("words").alias("w")).groupBy("regionId").agg(F.collect_set("w").alias("words"))
    return joins.best_region(items, vocabulary)


@query("SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'accept' WHEN quality = 0 THEN 'hold' ELSE 'reject' END AS decision FROM documents LEFT JOIN labels USING (doc_id)")
def decided(spark, sf_dir):
    made = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "accept").otherwise("hold").alias("decision"))
    return joins.decide(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), made)


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS \"inGraph\" FROM documents")
def marked_present(spark, sf_dir):
    return joins.mark_present(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, quality::VARCHAR AS note FROM labels UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def absorbed(spark, sf_dir):
    catalog = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("note"))
    return joins.absorb(catalog, table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("note")), "doc_id")


@query("SELECT doc_id, toxic::VARCHAR AS a, NULL::VARCHAR AS b FROM labels UNION ALL SELECT doc_id, NULL, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def merged_keep_existing(spark, sf_dir):
    old = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("a"))
    return ranking.merge_keep_existing(old, table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("b")), "doc_id")


@query("""
SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' END, lang) AS lang, source FROM documents LEFT JOIN labels USING (doc_id)
""")
def overlaid(spark, sf_dir):
    update = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("lang"), F.lit(1).alias("other"))
    return joins.overlay(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), update, "doc_id")


@query("""
SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'repeated' FROM labels GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT doc_id, 'unknown' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
""")
def covered(spark, sf_dir):
    return joins.exact_cover(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS \"createdAt\" FROM events ORDER BY 2 DESC, 1 DESC LIMIT 20")
def latest_notes(spark, sf_dir):
    notes = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("createdAt"))
    return readers.latest_notes(notes, 20)


@query("SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 31")
def overflow_limit(spark, sf_dir):
    return ranking.overflow_limit(table(spark, sf_dir, "part"), [F.desc("p_retailprice"), "p_partkey"], 30).select("p_partkey")


@query("SELECT source AS value, min(doc_id) AS first FROM documents WHERE source IS NOT NULL GROUP BY source")
def distinct_in_order(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("value"), F.col("doc_id").alias("first"))
    return ranking.distinct_in_order(d, "value", "first")


@query("""
WITH c AS (SELECT o_orderkey AS id, o_custkey AS wave FROM orders WHERE o_orderstatus = 'P')
SELECT o_orderkey AS id, o_custkey AS wave FROM orders WHERE o_custkey IN (SELECT wave FROM c) AND o_orderkey NOT IN (SELECT id FROM c)
""")
def incomplete_waves(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("wave"), "o_orderstatus")
    return ranking.incomplete_waves(items.drop("o_orderstatus"), items.where("o_orderstatus = 'P'"))


@query("""
WITH o AS (SELECT 'o' || event_id AS id, event_id AS ordinal, CASE WHEN value > 50 THEN event_type END AS sha256, CASE WHEN value > 20 THEN 'p' || user_id END AS path, NULL AS type FROM events
  UNION ALL SELECT 'm' || event_id, event_id + 1, NULL, 'p' || user_id, CASE WHEN value > 70 THEN 'code' ELSE 'note' END FROM events),
k AS (SELECT *, coalesce(sha256, path, id) AS key FROM o WHERE type IS NULL OR type = 'code')
SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY key ORDER BY ordinal, id) AS k FROM k) WHERE k = 1
""")
def artifacts_of_task(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name, path = F.col("event_id").cast("string"), F.concat(F.lit("p"), F.col("user_id").cast("string"))
    outputs = e.select(F.concat(F.lit("o"), name).alias("id"), F.col("event_id").alias("ordinal"), F.when(F.col("value") > 50, F.col("event_type")).alias("sha256"), F.when(F.col("value") > 20, path).alias("path"))
    kind = F.when(F.col("value") > 70, "code").otherwise("note")
    memories = e.select(F.concat(F.lit("m"), name).alias("id"), (F.col("event_id") + 1).alias("ordinal"), path.alias("path"), kind.alias("type"))
    return ranking.artifacts_of(outputs, memories).select("id")


@query("""
WITH k AS (SELECT s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1 AS k FROM supplier) SELECT id, (k % 12)::INTEGER AS slot, (k // 12)::INTEGER AS ring FROM k
""")
def ring_slots(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return windows.slot(s, "s_nationkey", [F.desc("s_acctbal"), "s_suppkey"]).select(F.col("s_suppkey").alias("id"), F.col("slot").cast("int"), "ring")


@query("SELECT n_nationkey, count(c_custkey) AS count FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal < -900) ON n_nationkey = c_nationkey GROUP BY 1")
def counts_with_zero(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal < -900").select(F.col("c_nationkey").alias("n_nationkey"))
    return aggregates.counts_with_zero(table(spark, sf_dir, "nation"), c, "n_nationkey")


@query("SELECT label, round(avg(embedding[1]::DOUBLE), 6) AS x, round(avg(embedding[2]::DOUBLE), 6) AS y, round(avg(embedding[3]::DOUBLE), 6) AS z FROM embeddings GROUP BY label")
def centroids(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("position"))
    return aggregates.centroid(e, "label").select("label", *(F.round(F.col("center")[k], 6).alias(n) for k, n in enumerate("xyz")))


@query("""
SELECT n_nationkey AS "regionId", CASE WHEN n_regionkey = 1 THEN 5 ELSE coalesce(n, 0) END AS papers FROM nation LEFT JOIN (SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey
""")
def region_paper_counts(spark, sf_dir):
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("regionId"), F.when(F.col("n_regionkey") == 1, F.lit(5).cast("long")).alias("declared"))
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("regionId"), F.col("c_mktsegment").alias("paperId"))
    return aggregates.region_paper_counts(regions, members)


@query("""
SELECT 'staged' AS state, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS new_papers, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS badge
UNION ALL SELECT 'changed', 0, (SELECT count(*) FROM labels WHERE toxic = 1)
UNION ALL SELECT 'quiet', 0, 1
""")
def pending_badge(spark, sf_dir):
    """The badge with new papers, with changes only, and with nothing but the refresh itself."""
    now, staged = (table(spark, sf_dir, t).select(F.col("doc_id").alias("id")) for t in ("labels", "documents"))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    cases = (("staged", staged, now), ("changed", now, toxic), ("quiet", now, toxic.limit(0)))
    return reduce(DataFrame.unionByName, (aggregates.pending_badge(now, s, c).select(F.lit(name).alias("state"), "new_papers", "badge") for name, s, c in cases))


@query("""
SELECT p_partkey AS id, len(list_distinct(string_split(p_name, ' ') || string_split(p_type, ' '))) AS issues FROM part
""")
def issue_counts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    none = F.lit(None).cast("array<string>")
    return p.select(F.col("p_partkey").alias("id"), aggregates.issue_count(F.split("p_name", " "), F.split("p_type", " "), none).cast("long").alias("issues"))


@query(r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) <= 60 THEN s ELSE rtrim(substr(s, 1, 59)) || '…' END AS clip FROM t
""")
def clipped_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clipped(F.col("text"), 60).alias("clip"))


@query(r"""
SELECT conv_id, turn, 'E' || conv_id || CASE WHEN turn = conv_id THEN '' ELSE ',E' || turn END AS ids, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare FROM conversations
""")
def evidence_marks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    said = F.regexp_replace("text", r"^\s+|\s+$", "")
    marks = F.concat(F.lit(" [E"), F.col("conv_id").cast("string"), F.lit("] [E"), F.col("turn").cast("string"), F.lit("] [E"), F.col("conv_id").cast("string"), F.lit("]"))
    statement = F.concat(said, marks)
    return c.select("conv_id", "turn", F.array_join(T.evidence_ids(statement), ",").alias("ids"), T.bare_statement(statement).alias("bare"))


@query(r"""
SELECT p_partkey AS id, '10.1234/ab.' || p_partkey AS doi, CASE WHEN p_size > 25 THEN '2401.' || lpad(p_size::VARCHAR, 5, '0') || 'v2' ELSE 'hep-th/' || lpad(p_size::VARCHAR, 7, '0') END AS arxiv,
  CASE WHEN p_size > 25 THEN '2401.' || lpad(p_size::VARCHAR, 5, '0') ELSE 'hep-th/' || lpad(p_size::VARCHAR, 7, '0') END AS base, NULL::VARCHAR AS none FROM part
""")
def identifiers(spark, sf_dir):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    address = F.when(F.col("p_size") > 25, F.concat(F.lit("https://arxiv.org/pdf/2401."), F.lpad(size, 5, "0"), F.lit("v2.pdf"))).otherwise(F.concat(F.lit(" hep-th/"), F.lpad(size, 7, "0"), F.lit("/ ")))
    found = T.arxiv_id(address)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), T.doi(F.concat(F.lit(" https://dx.DOI.org/10.1234/AB."), key)).alias("doi"), found.alias("arxiv"), T.arxiv_base(found).alias("base"), T.doi(F.concat(F.lit("11.1/"), key)).alias("none")
    )


@query("""
SELECT p_partkey AS id, greatest(0.0, least(100.0, CASE WHEN p_retailprice / 1500 <= 1 THEN p_retailprice / 1500 * 100 ELSE p_retailprice / 1500 END)) AS pct, greatest(0, least(100, floor(p_size / 45.0::DOUBLE * 100 + 0.5)))::BIGINT AS score,
  pow(p_size / 30.0::DOUBLE, 2) + pow((p_size - 10) / 20.0::DOUBLE, 2) <= 1 AS inside, p_name AS first, len(list_filter(list_transform(string_split(p_type, ' '), lambda x: trim(x)), lambda x: x <> ''))::INTEGER AS authors FROM part
""")
def value_rules(spark, sf_dir):
    size = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), S.percent(F.col("p_retailprice") / 1500).alias("pct"), S.score100(size / 45).alias("score"),
        S.inside_ellipse(size, size - 10, F.lit(30.0), F.lit(20.0)).alias("inside"), S.first_text(F.lit(" "), F.lit(None).cast("string"), F.col("p_name")).alias("first"),
        F.size(S.author_list(F.concat(F.replace(F.col("p_type"), F.lit(" "), F.lit(" ; ")), F.lit(";;")))).alias("authors"),
    )


@query("""
SELECT doc_id, ((('0x' || substr(sha256(text), 1, 4))::INTEGER) / 65535.0::DOUBLE * 2 - 1) AS x, ((('0x' || substr(sha256(text), 5, 4))::INTEGER) / 65535.0::DOUBLE * 2 - 1) AS y FROM documents
""")
def digest_positions(spark, sf_dir):
    at = S.digest_position(F.sha2("text", 256))
    return table(spark, sf_dir, "documents").select("doc_id", at[0].alias("x"), at[1].alias("y"))


@query("SELECT doc_id, regexp_matches(text, '\\p{Han}') AS han, length(split_part(text, chr(10), 1)) AS n FROM documents")
def han_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.has_han(F.col("text")).alias("han"), F.length(first_line("text")).cast("long").alias("n"))


@query("""
WITH x AS (SELECT l_orderkey || '-' || l_linenumber AS id, o_custkey AS s, l_suppkey AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT x.id, a.c_mktsegment AS "sourceGroup", b.c_mktsegment AS "targetGroup" FROM x JOIN customer a ON s = a.c_custkey JOIN customer b ON t = b.c_custkey WHERE a.c_mktsegment <> b.c_mktsegment
""")
def endpoint_groups(spark, sf_dir):
    grp = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("grp"))
    return joins.endpoint_groups(relations(spark, sf_dir).select("id", "source", "target"), grp).select("id", "sourceGroup", "targetGroup")


@query(r"""
WITH q AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'pending_codex' WHEN 'P' THEN 'needs_attention' WHEN 'F' THEN 'ready_to_refresh' END AS status, o_orderkey AS k FROM orders WHERE o_orderpriority <> '5-LOW'),
r AS (SELECT CASE status WHEN 'ready_to_refresh' THEN 'ready' ELSE 'pending' END AS leg, k, status FROM q WHERE status IS NOT NULL)
SELECT leg, row_number() OVER (PARTITION BY leg ORDER BY k, k::VARCHAR)::INTEGER AS place, 'LIT-' || lpad(k::VARCHAR, greatest(4, length(k::VARCHAR))::INTEGER, '0') AS code, k::VARCHAR AS id, status FROM r
UNION ALL SELECT 'research', row_number() OVER (ORDER BY r_regionkey::VARCHAR)::INTEGER, NULL, r_regionkey::VARCHAR, 'pending_update' FROM region WHERE r_regionkey > 1
""")
def open_queue(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'")
    status = F.when(F.col("o_orderstatus") == "O", "pending_codex").when(F.col("o_orderstatus") == "P", "needs_attention").when(F.col("o_orderstatus") == "F", "ready_to_refresh")
    drafts = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.when(F.col("r_regionkey") > 1, "pending_update").otherwise("idle").alias("status"))
    return predicates.open_queue(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("number"), status.alias("status")), drafts)


REVIEWS = """
WITH rel AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_partkey AS source, l_suppkey AS target, l_quantity AS strength FROM lineitem),
rev AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_partkey AS source, CASE WHEN l_partkey % 7 = 1 THEN l_suppkey + 1 ELSE l_suppkey END AS target,
  CASE WHEN l_partkey % 7 = 2 THEN 'draft' WHEN l_returnflag = 'R' THEN 'verified' ELSE 'candidate' END AS status, 2 * l_quantity AS strength FROM lineitem WHERE l_linenumber < 4
  UNION ALL SELECT 'new-' || n_nationkey, n_nationkey, n_regionkey, 'verified', 1 FROM nation
  UNION ALL SELECT l_orderkey || '-' || l_linenumber, l_partkey, l_suppkey, 'verified', 3 FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 7 = 3),
m AS (SELECT v.*, r.id IS NOT NULL AS known, v.source IS NOT DISTINCT FROM r.source AND v.target IS NOT DISTINCT FROM r.target AS same, count(*) OVER (PARTITION BY v.id) AS n,
  coalesce(v.status IN ('suggestion', 'candidate', 'verified'), false) AS allowed FROM rev v LEFT JOIN rel r ON v.id = r.id)
"""


def review_input(spark, sf_dir):
    """lineitem as relations and as reviews, some with another target or status, some twice; nations as unknown ones."""
    li, name = table(spark, sf_dir, "lineitem"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id")
    rel = li.select(name, F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_quantity").cast("double").alias("strength"))
    target = F.when(F.col("l_partkey") % 7 == 1, F.col("l_suppkey") + 1).otherwise(F.col("l_suppkey"))
    status = F.when(F.col("l_partkey") % 7 == 2, "draft").when(F.col("l_returnflag") == "R", "verified").otherwise("candidate")
    rev = li.where("l_linenumber < 4").select(name, F.col("l_partkey").alias("source"), target.alias("target"), status.alias("status"), (F.col("l_quantity") * 2).cast("double").alias("strength"))
    fresh = table(spark, sf_dir, "nation").select(F.concat(F.lit("new-"), F.col("n_nationkey").cast("string")), "n_nationkey", "n_regionkey", F.lit("verified"), F.lit(1.0))
    twice = li.where("l_linenumber = 1 and l_partkey % 7 = 3").select(name, "l_partkey", "l_suppkey", F.lit("verified"), F.lit(3.0))
    return rel, rev.union(fresh).union(twice)


@query(REVIEWS + """, ok AS (SELECT * FROM m WHERE known AND same AND n = 1 AND allowed)
SELECT rel.id, rel.source, rel.target, coalesce(ok.strength, rel.strength)::DOUBLE AS strength, ok.status, CASE WHEN ok.id IS NOT NULL THEN 'scored_v1' END AS "scoringStatus" FROM rel LEFT JOIN ok ON rel.id = ok.id
""")
def merged_reviews(spark, sf_dir):
    return joins.merge_reviews(*review_input(spark, sf_dir))[0]


@query(REVIEWS + """SELECT problem, count(DISTINCT id) AS n FROM (
  SELECT id, 'unknown' AS problem FROM m WHERE NOT known UNION ALL SELECT id, 'repeated' FROM m WHERE n > 1 UNION ALL SELECT id, 'endpoints_changed' FROM m WHERE known AND NOT same
  UNION ALL SELECT id, 'invalid_status' FROM m WHERE NOT allowed UNION ALL SELECT id, 'missing' FROM rel WHERE id NOT IN (SELECT id FROM rev)) GROUP BY problem
""")
def review_problems(spark, sf_dir):
    return joins.merge_reviews(*review_input(spark, sf_dir), require_all=True)[1].groupBy("problem").agg(F.count("*").alias("n"))


@query("""
WITH known AS (SELECT doc_id, md5(text) AS sha, split_part(text, chr(10), 1) AS title FROM documents WHERE source IS NOT NULL),
hit AS (SELECT d.doc_id AS id, k.doc_id AS p, md5(d.text) = k.sha AS s, split_part(d.text, chr(10), 1) = k.title AS t FROM documents d JOIN known k ON md5(d.text) = k.sha
  UNION SELECT d.doc_id, k.doc_id, md5(d.text) = k.sha, true FROM documents d JOIN known k ON split_part(d.text, chr(10), 1) = k.title),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS k FROM hit)
SELECT id, p AS "paperId", CASE WHEN s AND t THEN 'sha256,title' WHEN s THEN 'sha256' ELSE 'title' END AS matched FROM f WHERE k = 1
""")
def first_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("sha"), first_line("text").alias("title"))
    known = d.where("source is not null").select(F.col("doc_id").alias("paperId"), F.col("doc_id").alias("place"), "sha", "title")
    found = joins.first_duplicate(d.withColumnRenamed("doc_id", "id"), known, {"sha256": "sha", "title": "title"}, "place")
    return found.select("id", "paperId", F.array_join("matchedBy", ",").alias("matched"))


@query("""
WITH a AS (SELECT o, c_custkey AS p, c_custkey % (2 + o) AS r FROM customer, (SELECT unnest([0, 1]) AS o) UNION ALL SELECT 9, c_custkey, c_custkey % 2 FROM customer WHERE c_custkey % 10 <> 0
  UNION ALL SELECT 9, c_custkey, 1 FROM customer WHERE c_custkey % 100 = 1),
o AS (SELECT DISTINCT o FROM a), n AS (SELECT o, p, count(*) AS n FROM a GROUP BY o, p),
cells AS (SELECT x.o AS a, y.o AS b, x.r AS ra, y.r AS rb, count(*) AS n FROM a x JOIN a y USING (p) WHERE x.o < y.o GROUP BY ALL),
d AS (SELECT a, b, sum(n) AS n, sum(n * (n - 1) // 2) AS t FROM cells GROUP BY a, b),
ca AS (SELECT a, b, sum(n * (n - 1) // 2) AS c FROM (SELECT a, b, ra, sum(n) AS n FROM cells GROUP BY ALL) GROUP BY a, b),
cb AS (SELECT a, b, sum(n * (n - 1) // 2) AS c FROM (SELECT a, b, rb, sum(n) AS n FROM cells GROUP BY ALL) GROUP BY a, b)
SELECT 'error' AS severity, 'assignment_missing' AS code, o || '/' || c_custkey AS id FROM o, customer WHERE (o, c_custkey) NOT IN (SELECT (o, p) FROM n)
UNION ALL SELECT 'error', 'assignment_repeated', o || '/' || p FROM n WHERE n > 1
UNION ALL SELECT 'error', 'options_too_alike', a || '/' || b FROM d JOIN ca USING (a, b) JOIN cb USING (a, b) WHERE ca.c + cb.c - 2 * t < greatest(1, ceil((n * (n - 1) // 2) * 0.15))
UNION ALL SELECT 'error', 'not_three_options', count(*)::VARCHAR FROM o HAVING count(*) <> 3
""")
def partition_problems(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paperId"))
    rows = [c.select(F.lit(o).alias("optionId"), "paperId", (F.col("paperId") % (2 + o)).alias("regionId")) for o in (0, 1)]
    rows.append(c.where("paperId % 10 <> 0").select(F.lit(9).alias("optionId"), "paperId", (F.col("paperId") % 2).alias("regionId")))
    rows.append(c.where("paperId % 100 = 1").select(F.lit(9).alias("optionId"), "paperId", F.lit(1).cast("bigint").alias("regionId")))
    out = checks.partition_rules(c, rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]))
    return out.select("severity", "code", "id")


@query("""
WITH k AS (SELECT p_partkey AS id, p_partkey % 4 AS m, p_partkey + 1 IN (SELECT p_partkey FROM part) AS next FROM part)
SELECT id, CASE WHEN m = 0 THEN 'duplicate' WHEN m = 2 AND next THEN 'conflicting_keys' WHEN m = 3 THEN 'new' ELSE 'conflicting_identifiers' END AS decision,
  CASE WHEN m = 3 THEN '' WHEN m = 2 AND next THEN id || ',' || (id + 1) ELSE id::VARCHAR END AS papers,
  CASE WHEN m = 0 THEN 'arxiv_id,doi,sha256' WHEN m = 3 THEN '' WHEN m = 2 AND next THEN 'doi,sha256' ELSE 'sha256' END AS matched FROM k
""")
def dup_branches(spark, sf_dir):
    """Parts as documents that agree with a paper, contradict it, name two papers, or none."""
    key = F.col("p_partkey")
    digest, number = F.sha2(key.cast("string"), 256), F.lpad(key.cast("string"), 8, "0")
    address = lambda k: F.concat(F.lit("https://doi.org/10.1234/X."), k.cast("string"))
    none, parts = F.lit(None).cast("string"), table(spark, sf_dir, "part")
    rest = [none.alias("title"), F.array().cast("array<string>").alias("authors")]
    arxiv = lambda v: F.concat(F.lit("hep-th/"), F.substring(number, 2, 7), F.lit(v))
    known = parts.select(key.alias("paperId"), digest.alias("sha256"), arxiv("v1").alias("arxivId"), address(key).alias("doi"), *rest)
    m = key % 4
    doi = F.when(m == 0, address(key)).when(m == 1, "10.1234/other").when(m == 2, address(key + 1))
    new = parts.select(key.alias("id"), F.when(m < 3, F.upper(digest)).otherwise("none").alias("sha256"), F.when(m == 0, arxiv("v2")).alias("arxivId"), doi.alias("doi"), *rest)
    out = duplicates.decide(new, known)
    return out.select("id", "decision", F.array_join(F.col("paperIds").cast("array<string>"), ",").alias("papers"), F.array_join("matchedBy", ",").alias("matched"))
