"""Search, text, screening and duplicates over the harness tables."""

from __future__ import annotations

from hashlib import sha256
from uuid import uuid4

from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.functions import vocabulary as V
from scriptoria.harness.adapters import first_line, memory_events, papers, relations, shared_folder, statuses, table
from scriptoria.operators import joins, predicates
from scriptoria.operators.windows import with_context
from scriptoria.plans import candidates, context, duplicates, fulltext, index, memory, screening

WEIGHTS = {"title": V.PAPER_WEIGHTS["title"], "tags": V.PAPER_WEIGHTS["tags"], "body": V.PAPER_WEIGHTS["body"]}
CARD_QUERY, MEMORY_QUERY, LIST_QUERY = "the tion heron", "the and", "tion the"


def queries_table(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def keeper(spark, name):
    """Writes a table to the shared folder and reads it again."""

    def keep(df):
        path = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


def bm25_topk(spark, sf_dir):
    terms = fulltext.term_rows(queries_table(spark, sf_dir), "query_id", "text")
    ranked = fulltext.bm25(papers(spark, sf_dir), "paperId", {c: (F.col(c), w) for c, w in WEIGHTS.items()}, terms)
    return fulltext.top(ranked, 10).select("query_id", "place", "doc_id", "rank")


def bm25_indexed(spark, sf_dir):
    """bm25_topk from an index that is built in the shared folder once per corpus."""
    base = shared_folder(spark)
    docs = papers(spark, sf_dir)
    path = f"{base}/fulltext-{sha256(sf_dir.encode()).hexdigest()[:16]}"
    index.build(docs, path, "paperId", {c: (F.col(c), w) for c, w in WEIGHTS.items()})
    terms = fulltext.term_rows(queries_table(spark, sf_dir), "query_id", "text")
    return fulltext.top(index.rank(index.load(spark, path), terms), 10).select("query_id", "place", "doc_id", "rank")


def _aliases_sql(n: str) -> str:
    parts = []
    for key, words in V.SEARCH_ALIASES:
        hit = " OR ".join([f"contains(' ' || {n} || ' ', ' {key} ')", *(f"contains({n}, '{w}')" for w in words.split())])
        parts.append(f"CASE WHEN {hit} THEN '{key} {words}' END")
    return f"concat_ws(' ', {n}, {', '.join(parts)})"


TOKENS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"

BM25_SQL = f"""
WITH q AS (SELECT item_id AS query_id, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS n FROM benchmark),
qt AS (SELECT query_id, unnest({TOKENS.format(_aliases_sql('n'))}) AS term, generate_subscripts({TOKENS.format(_aliases_sql('n'))}, 1) AS pos FROM q),
terms AS (
  SELECT query_id, term FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) AS k FROM qt GROUP BY query_id, term) WHERE k <= 48),
doc AS (SELECT doc_id, {TOKENS.format("split_part(text, chr(10), 1)")} AS title, {TOKENS.format('source')} AS tags, {TOKENS.format('text')} AS body FROM documents),
size AS (SELECT doc_id, len(title) + len(tags) + len(body) AS d FROM doc),
tok AS (
  SELECT doc_id, unnest(title) AS term, 8.0::DOUBLE AS w FROM doc UNION ALL SELECT doc_id, unnest(tags), 3.0::DOUBLE FROM doc UNION ALL SELECT doc_id, unnest(body), 1.0::DOUBLE FROM doc),
post AS (SELECT doc_id, term, sum(w) AS f FROM tok WHERE term IN (SELECT term FROM terms) GROUP BY doc_id, term),
total AS (SELECT count(*) AS n_docs, avg(d) AS avg_d FROM size),
seen AS (SELECT term, count(*) AS n FROM post GROUP BY term),
idf AS (SELECT term, CASE WHEN ln((n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) END AS idf FROM seen, total),
ranked AS (
  SELECT query_id, p.doc_id, round(-sum(idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d / avg_d))), 6) AS rank
  FROM terms JOIN post p USING (term) JOIN idf USING (term) JOIN size s ON s.doc_id = p.doc_id, total GROUP BY query_id, p.doc_id)
SELECT query_id, place, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id)::INTEGER AS place FROM ranked) WHERE place <= 10
"""


def merged(spark, sf_dir):
    """(query_id, place, paperId, rank, claims, expanded_by) of the benchmark's texts over documents, conversations as
    claims and formal relations."""
    p = papers(spark, sf_dir).join(statuses(spark, sf_dir), "paperId", "left").fillna("card_draft", ["verificationStatus"])
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("claimId"), F.col("conv_id").alias("paperId"), F.col("role").alias("type"), F.col("role").alias("section"), "text")
    r = relations(spark, sf_dir)
    formal = r.where(predicates.formal_relation(F.col("status"), F.col("strength"), F.col("confidence"), F.col("formalEligible")))

    def indexed(name, df, key, weights):
        """A ranker over an index in the shared folder, which is built where the corpus is a new one."""
        path = f"{shared_folder(spark)}/{name}-{sha256(sf_dir.encode()).hexdigest()[:16]}"
        index.build(df, path, key, fulltext.search_columns(df, weights))
        return lambda terms: index.rank(index.load(spark, path), terms)

    by_paper, by_claim = indexed("papers", p, "paperId", V.PAPER_WEIGHTS), indexed("claims", c, "claimId", V.CLAIM_WEIGHTS)
    return fulltext.search(p, c, formal, queries_table(spark, sf_dir), limit=10, rank_papers=by_paper, rank_claims=by_claim, keep=keeper(spark, "search"))


def search_merged(spark, sf_dir):
    return merged(spark, sf_dir).withColumns({c: F.array_join(c, ",") for c in ("claims", "expanded_by")})


def _ranked_sql(name: str, docs: str, weights: dict[str, float], keep: int) -> str:
    """Common table expressions that end in {name}_top (query_id, id, rank, place), given terms and docs with an id."""
    cols = ", ".join(f"{TOKENS.format(c)} AS {c}" for c in weights)
    tokens = " UNION ALL ".join(f"SELECT id, unnest({c}) AS term, {w}::DOUBLE AS w FROM {name}_doc" for c, w in weights.items())
    return f"""
{name}_doc AS (SELECT id, {cols} FROM ({docs})),
{name}_size AS (SELECT id, {' + '.join(f'len({c})' for c in weights)} AS d FROM {name}_doc),
{name}_post AS (SELECT id, term, sum(w) AS f FROM ({tokens}) WHERE term IN (SELECT term FROM terms) GROUP BY id, term),
{name}_total AS (SELECT count(*) AS n_docs, avg(d) AS avg_d FROM {name}_size),
{name}_idf AS (SELECT term, CASE WHEN v <= 0 THEN 1e-6::DOUBLE ELSE v END AS idf FROM (SELECT term, ln((n_docs - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS v FROM {name}_post, {name}_total GROUP BY term, n_docs)),
{name}_rank AS (
  SELECT query_id, p.id, round(-sum(idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d / avg_d))), 6) AS rank
  FROM terms JOIN {name}_post p USING (term) JOIN {name}_idf USING (term) JOIN {name}_size s ON s.id = p.id, {name}_total GROUP BY query_id, p.id),
{name}_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS place FROM {name}_rank) WHERE place <= {keep})"""


#: limit 10: 30 papers, 80 claims, at most 20 after each widening.
MERGED = f"""
WITH q AS (SELECT item_id AS query_id, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS n FROM benchmark),
qt AS (SELECT query_id, unnest({TOKENS.format(_aliases_sql('n'))}) AS term, generate_subscripts({TOKENS.format(_aliases_sql('n'))}, 1) AS pos FROM q),
terms AS (SELECT query_id, term FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) AS k FROM qt GROUP BY query_id, term) WHERE k <= 48),
{_ranked_sql("paper", "SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, lang AS authors, source AS tags, text AS body FROM documents", {c: w for c, w in V.PAPER_WEIGHTS.items() if c != "aliases"}, 30)},
{_ranked_sql("claim", "SELECT conv_id || '-' || turn AS id, role AS type, role AS section, text FROM conversations", {c: w for c, w in V.CLAIM_WEIGHTS.items() if c != "evidence"}, 80)},
hit AS (SELECT query_id, id AS claim, split_part(id, '-', 1)::BIGINT AS paper, rank, place FROM claim_top),
own AS (SELECT query_id, paper, min(place) AS first, min(rank) AS best, (list(claim ORDER BY place, claim))[:6] AS claims FROM hit GROUP BY query_id, paper),
direct AS (SELECT query_id, id AS paper, rank FROM paper_top),
have AS (SELECT query_id, count(*) AS n FROM direct GROUP BY query_id),
extra AS (
  SELECT query_id, paper FROM (
    SELECT o.query_id, o.paper, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY o.query_id ORDER BY o.first) AS k
    FROM own o LEFT JOIN have USING (query_id) WHERE coalesce(n, 0) < 10 AND o.paper IN (SELECT doc_id FROM documents) AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.query_id = o.query_id AND d.paper = o.paper))
  WHERE n + k <= 20),
known AS (SELECT * FROM direct UNION ALL SELECT query_id, paper, 0.0 FROM extra),
formal AS (
  SELECT l_orderkey || '-' || l_linenumber AS id, o_custkey AS source, l_suppkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_returnflag <> 'R' AND l_linestatus = 'F' AND l_quantity * 2 >= 60 AND round(100 - l_discount * 400, 3) >= 75 AND l_tax < 0.08),
led AS (
  SELECT query_id, target AS paper, id FROM known JOIN formal ON source = paper
  UNION SELECT k.query_id, source, id FROM known k JOIN formal ON target = k.paper WHERE NOT EXISTS (SELECT 1 FROM known x WHERE x.query_id = k.query_id AND x.paper = source)),
near AS (SELECT query_id, paper, list(id ORDER BY id) AS expanded_by FROM led GROUP BY query_id, paper),
space AS (SELECT query_id, count(*) AS n FROM known GROUP BY query_id),
fresh AS (
  SELECT query_id, paper FROM (
    SELECT query_id, paper, n, row_number() OVER (PARTITION BY query_id ORDER BY expanded_by[1], paper) AS k FROM near a JOIN space USING (query_id)
    WHERE paper IN (SELECT doc_id FROM documents) AND NOT EXISTS (SELECT 1 FROM known x WHERE x.query_id = a.query_id AND x.paper = a.paper))
  WHERE n + k <= 20),
status AS (SELECT doc_id AS paper, max(CASE WHEN quality = 1 AND toxic = 0 THEN 'evidence_verified' WHEN quality = 1 THEN 'needs_attention' ELSE 'card_draft' END) AS status FROM labels GROUP BY doc_id),
merged AS (
  SELECT m.query_id, m.paper, m.rank, own.claims, near.expanded_by, row_number() OVER (PARTITION BY m.query_id ORDER BY round(m.rank + coalesce(own.best, 0), 6), m.paper) AS place
  FROM (SELECT * FROM known UNION ALL SELECT query_id, paper, 10.0 FROM fresh) m JOIN status USING (paper)
  LEFT JOIN own ON own.query_id = m.query_id AND own.paper = m.paper LEFT JOIN near ON near.query_id = m.query_id AND near.paper = m.paper
  WHERE status IN ('evidence_verified', 'needs_attention'))"""
MERGED_SQL = MERGED + """
SELECT query_id, place::INTEGER AS place, paper AS "paperId", rank, coalesce(array_to_string(claims, ','), '') AS claims, coalesce(array_to_string(expanded_by, ','), '') AS expanded_by FROM merged WHERE place <= 10
"""


def context_pack(spark, sf_dir):
    found = merged(spark, sf_dir)
    st = statuses(spark, sf_dir)
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("claimId"), F.col("conv_id").alias("paperId"), F.col("role").alias("type"), "text")
    c = c.join(st, "paperId", "left").fillna("card_draft", ["verificationStatus"])
    return context.select_claims(found, c, 12_000).select("query_id", "place", "k", "paperId", "claimId", "trust", "contentHash", "kept")


PACK_SQL = MERGED + """,
claim AS (
  SELECT conv_id || '-' || turn AS id, conv_id AS paper, role AS type, text, coalesce(status, 'card_draft') AS status FROM conversations LEFT JOIN status ON paper = conv_id),
found AS (SELECT * FROM merged WHERE place <= 10),
offered AS (
  SELECT query_id, place, paper, unnest(range(len(claims)))::INTEGER AS k, unnest(claims) AS id FROM found WHERE claims IS NOT NULL
  UNION ALL
  SELECT query_id, place, paper, k, id FROM (
    SELECT f.query_id, f.place, f.paper, c.id, (row_number() OVER (PARTITION BY f.query_id, f.paper ORDER BY c.id) - 1)::INTEGER AS k FROM found f JOIN claim c ON c.paper = f.paper WHERE f.claims IS NULL AND c.type <> 'project_role')
  WHERE k < 2),
room AS (
  SELECT o.*, c.text, c.status, 8640 - coalesce(sum(length(c.text)) OVER (PARTITION BY query_id ORDER BY place, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over
  FROM offered o JOIN claim c USING (id) WHERE c.text <> '' AND c.status <> 'card_draft')
SELECT query_id, place::INTEGER AS place, k, paper AS "paperId", id AS "claimId", CASE status WHEN 'evidence_verified' THEN 'verified_original_source' WHEN 'needs_attention' THEN 'verified_with_attention_flag' ELSE 'provisional_not_for_formal_use' END AS trust, sha256(text) AS "contentHash",
  CASE WHEN length(text) <= left_over THEN text ELSE regexp_replace(substr(text, 1, (left_over - 22)::BIGINT), '\\s+$', '') || chr(10) || chr(10) || '[text truncated]' END AS kept
FROM room WHERE left_over >= 120
"""


def card_score_fallback(spark, sf_dir):
    cards = papers(spark, sf_dir).withColumn("paperId", F.col("paperId").cast("string"))
    return fulltext.fallback_search(cards, CARD_QUERY, 50).select("paperId", "score")


def _card_sql() -> str:
    normal = lambda c: f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
    per = []
    for t in CARD_QUERY.split():
        per.append(
            f"(CASE WHEN contains(id, '{t}') THEN 8 ELSE 0 END + CASE WHEN contains(title, '{t}') THEN 12 ELSE 0 END + CASE WHEN contains(authors, '{t}') THEN 6 ELSE 0 END"
            f" + CASE WHEN contains(tags, '{t}') THEN 5 ELSE 0 END + least(5, (length(body) - length(replace(body, '{t}', ''))) // {len(t)}))"
        )
    every = " AND ".join(f"contains(concat_ws(' ', title, tags, body), '{t}')" for t in CARD_QUERY.split())
    return f"""
WITH card AS (
  SELECT doc_id::VARCHAR AS id, {normal("split_part(text, chr(10), 1)")} AS title, {normal('lang')} AS authors, {normal('source')} AS tags, {normal('text')} AS body FROM documents),
scored AS (SELECT id AS "paperId", ({' + '.join(per)} + CASE WHEN {every} THEN 5 ELSE 0 END)::INTEGER AS score FROM card)
SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, "paperId" LIMIT 50
"""


def memory_search(spark, sf_dir):
    items = memory.items(memory_events(spark, sf_dir))
    return memory.search(items, F.lit(MEMORY_QUERY), 20).select("memoryId", "score", "updatedRevision")


def _memory_sql() -> str:
    terms = [MEMORY_QUERY, *MEMORY_QUERY.split()]
    per = " + ".join(f"CASE WHEN contains(lower(title), '{t}') THEN 6 ELSE 0 END + CASE WHEN contains('finding', '{t}') THEN 3 ELSE 0 END + least(8, (length(every) - length(replace(every, '{t}', ''))) // {len(t)})" for t in terms)
    return f"""
WITH item AS (
  SELECT 'mem-' || conv_id || '-' || turn AS "memoryId", role AS title, lower(concat_ws(chr(10), role, nullif(text, ''), 'finding', 'provisional', 'aiInference')) AS every, coalesce(lead(turn) OVER (PARTITION BY conv_id, role ORDER BY turn), turn) + 1 AS "updatedRevision" FROM conversations),
scored AS (SELECT "memoryId", ({per})::INTEGER AS score, "updatedRevision" FROM item)
SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, "updatedRevision" DESC, "memoryId" LIMIT 20
"""


def library_search(spark, sf_dir):
    return predicates.contains_any_field(papers(spark, sf_dir), LIST_QUERY, "title", "authors", "tags", "body").select("paperId")


LIBRARY_SQL = f"""
SELECT doc_id AS "paperId" FROM documents
WHERE contains(lower(concat_ws(' ', split_part(text, chr(10), 1), lang, source, text)), '{LIST_QUERY}')
"""


def normalized_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(T.search_text(F.col("text")), 256).alias("normal_sha"), T.slug(first_line("text")).alias("slug"), T.identity(first_line("text")).alias("identity"), T.has_han(F.col("text")).alias("han"))


NORMALIZED_SQL = r"""
WITH d AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS line FROM documents)
SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'))) AS normal_sha,
  CASE WHEN trim(substr(trim(regexp_replace(strip_accents(lower(line)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 72), '-') = '' THEN 'paper'
    ELSE trim(substr(trim(regexp_replace(strip_accents(lower(line)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 72), '-') END AS slug,
  trim(regexp_replace(strip_accents(lower(line)), '[^\p{L}\p{N}]+', ' ', 'g')) AS identity,
  regexp_matches(text, '\p{Han}') AS han
FROM d
"""


def sentence_context(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    rows = with_context(candidates.spans(d, ".!?"), "doc_id", "page")
    return rows.select("doc_id", "ordinal", "start", "end", F.md5("text").alias("text_md5"), F.md5("previous").alias("previous_md5"), F.md5("next").alias("next_md5"))


SENTENCE_SQL = r"""
WITH piece AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+')) AS raw, generate_subscripts(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+'), 1) - 1 AS ordinal FROM documents),
placed AS (SELECT doc_id, ordinal, sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY ordinal) AS e, length(raw) AS n, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS text FROM piece),
kept AS (SELECT * FROM placed WHERE text <> '')
SELECT doc_id, ordinal::INTEGER AS ordinal, (e - n)::BIGINT AS start, e::BIGINT AS "end", md5(text) AS text_md5,
  md5(lag(text) OVER (PARTITION BY doc_id ORDER BY ordinal)) AS previous_md5, md5(lead(text) OVER (PARTITION BY doc_id ORDER BY ordinal)) AS next_md5
FROM kept
"""


def routing_candidates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    return candidates.ranked(candidates.collect(d)).select("doc_id", "kind", "place", "score", "start", "end", "section", "signals", "id")


def screening_input(spark, sf_dir, keep):
    """Documents, regions and their papers; the documents are the papers, so their tokens are cut and counted once."""
    d = table(spark, sf_dir, "documents")
    words = keep(screening.counted(d.select(F.col("doc_id").alias("docId"), F.col("lang").alias("regionId"), "text"), ["docId", "regionId"], "text"))
    regions = words.select("regionId").distinct().select("regionId", F.col("regionId").alias("name"), F.col("regionId").alias("description"))
    return words.select("docId", "words"), regions, words.select("regionId", "words")


def tfidf_screen(spark, sf_dir):
    keep = keeper(spark, "screen")
    return screening.screen(*screening_input(spark, sf_dir, keep), keep=keep)


SCREEN_SQL = r"""
WITH word AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents),
kept AS (SELECT * FROM word WHERE length(token) >= 2 OR regexp_full_match(token, '\p{Nd}+')),
prof AS (
  SELECT region, token, sum(tf) AS tf FROM (
    SELECT lang AS region, token, count(*) AS tf FROM kept GROUP BY ALL
    UNION ALL SELECT DISTINCT lang, lower(lang), 5 FROM documents) GROUP BY region, token),
n AS (SELECT count(DISTINCT lang) AS n FROM documents),
idf AS (SELECT token, ln((1 + n)::DOUBLE / (1 + count(*))) + 1 AS idf FROM prof, n GROUP BY token, n),
p AS (SELECT region, token, (1 + ln(tf)) * idf AS v FROM prof JOIN idf USING (token)),
q AS (SELECT doc_id, token, (1 + ln(tf)) * coalesce(idf, 1.0) AS w FROM (SELECT doc_id, token, count(*) AS tf FROM kept GROUP BY ALL) LEFT JOIN idf USING (token)),
pn AS (SELECT region, sum(v * v) AS pn FROM p GROUP BY region),
qn AS (SELECT doc_id, sum(w * w) AS qn, sum(w) AS mass FROM q GROUP BY doc_id),
hit AS (SELECT doc_id, region, sum(w * v) AS dot, sum(w) AS matched FROM q JOIN p USING (token) GROUP BY doc_id, region),
scored AS (
  SELECT qn.doc_id, pn.region, round(coalesce(dot, 0) / sqrt(pn * qn), 6) AS cosine, round(coalesce(matched, 0) / mass, 6) AS coverage
  FROM qn CROSS JOIN pn LEFT JOIN hit ON hit.doc_id = qn.doc_id AND hit.region = pn.region),
final AS (SELECT *, greatest(0, least(100, floor(round(cosine * 0.72::DOUBLE + coverage * 0.28::DOUBLE, 6) * 100 + 0.5)))::BIGINT AS score FROM scored)
SELECT doc_id AS "docId", place, region AS "regionId", score, cosine, coverage
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, region)::INTEGER AS place FROM final) WHERE place <= 3
"""


def incoming(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    null = F.lit(None).cast("string")
    return d.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"), null.alias("arxivId"), null.alias("doi"), first_line("text").alias("title"), F.array("source").alias("authors"))


def existing(spark, sf_dir):
    """The catalog: the first document of each text."""
    return incoming(spark, sf_dir).groupBy("sha256").agg(F.min_by(F.struct("id", "arxivId", "doi", "title", "authors"), "id").alias("p")).select(F.col("p.id").alias("paperId"), "sha256", "p.arxivId", "p.doi", "p.title", "p.authors")


def dup_decision(spark, sf_dir):
    out = duplicates.decide(incoming(spark, sf_dir), existing(spark, sf_dir), counted=True)
    return out.select("id", "decision", F.array_join("paperIds", ",").alias("papers"), F.array_join("matchedBy", ",").alias("matched_by"), "n_possible")


DUP_SQL = r"""
WITH d AS (SELECT doc_id AS id, sha256(text) AS h, trim(regexp_replace(strip_accents(lower(split_part(text, chr(10), 1))), '[^\p{L}\p{N}]+', ' ', 'g')) AS t, source AS s FROM documents),
e AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY h ORDER BY id) = 1),
strict AS (SELECT d.id, e.id AS paper FROM d JOIN e USING (h)),
weak AS (SELECT d.id, e.id AS paper FROM d JOIN e ON d.t = e.t AND d.s = e.s AND d.t <> '' WHERE d.h <> e.h)
SELECT d.id, 'duplicate' AS decision, (SELECT max(paper) FROM strict x WHERE x.id = d.id)::VARCHAR AS papers, 'sha256' AS matched_by, coalesce(w.n, 0)::INTEGER AS n_possible
FROM d LEFT JOIN (SELECT id, count(DISTINCT paper) AS n FROM weak GROUP BY id) w ON w.id = d.id
"""


def identity_collisions(spark, sf_dir):
    rows = incoming(spark, sf_dir).withColumnRenamed("id", "paperId")
    return joins.shared_identities(rows, ["sha256", "doi", "title"]).select("key", "value", F.size("papers").alias("n_papers"), F.col("papers")[0].alias("first_paper"))


COLLISION_SQL = """
SELECT 'sha256' AS key, sha256(text) AS value, count(DISTINCT doc_id)::INTEGER AS n_papers, min(doc_id) AS first_paper FROM documents GROUP BY text HAVING count(DISTINCT doc_id) > 1
UNION ALL SELECT 'title', split_part(text, chr(10), 1), count(DISTINCT doc_id)::INTEGER, min(doc_id) FROM documents WHERE split_part(text, chr(10), 1) <> '' GROUP BY split_part(text, chr(10), 1) HAVING count(DISTINCT doc_id) > 1
"""


def budget_prefix(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return context.budget_prefix(c, ["conv_id"], ["turn"], "text", 600, 100).select("conv_id", "turn", "kept")


BUDGET_SQL = r"""
WITH r AS (SELECT conv_id, turn, text, 600 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM conversations)
SELECT conv_id, turn, CASE WHEN length(text) <= room THEN text ELSE regexp_replace(substr(text, 1, (room - 22)::BIGINT), '\s+$', '') || chr(10) || chr(10) || '[text truncated]' END AS kept
FROM r WHERE room >= 100
"""


def repartition_advice(spark, sf_dir):
    keep = keeper(spark, "advice")
    return screening.repartition_advice(*screening_input(spark, sf_dir, keep), keep=keep)


ADVICE_SQL = SCREEN_SQL[: SCREEN_SQL.index("SELECT doc_id AS \"docId\"")] + """,
low AS (SELECT doc_id FROM final GROUP BY doc_id HAVING max(score) < 60),
n_low AS (SELECT count(*) AS n FROM low),
token_sum AS (SELECT token, sum(w / sqrt(qn)) AS s FROM q JOIN qn USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM low) GROUP BY token),
square AS (SELECT sum(s * s) AS s2 FROM token_sum),
mean AS (SELECT n AS low_fit, CASE WHEN n >= 4 THEN greatest(0, least(100, floor(round((s2 - n) / (n * (n - 1)), 6) * 100 + 0.5)))::BIGINT END AS consistency FROM n_low, square)
SELECT low_fit AS "lowFit", consistency, coalesce(low_fit >= 4 AND consistency >= 70, false) AS propose FROM mean
"""

QUERIES = {f.__name__: f for f in (
    bm25_topk, bm25_indexed, search_merged, context_pack, card_score_fallback, memory_search, library_search, normalized_text, sentence_context,
    routing_candidates, tfidf_screen, dup_decision, identity_collisions, budget_prefix, repartition_advice,
)}
SQL = {
    "bm25_topk": BM25_SQL, "bm25_indexed": BM25_SQL, "search_merged": MERGED_SQL, "repartition_advice": ADVICE_SQL, "context_pack": PACK_SQL, "card_score_fallback": _card_sql(), "memory_search": _memory_sql(), "library_search": LIBRARY_SQL, "normalized_text": NORMALIZED_SQL,
    "sentence_context": SENTENCE_SQL, "tfidf_screen": SCREEN_SQL, "dup_decision": DUP_SQL, "identity_collisions": COLLISION_SQL, "budget_prefix": BUDGET_SQL,
}
