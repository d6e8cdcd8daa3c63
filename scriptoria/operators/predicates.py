"""Filters and case expressions. Functions take DataFrames or Columns and keep them lazy, so filters reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.functions import vocabulary as V
from scriptoria.functions.scalar import display_state

#: Rows of the queue that are numbered in one part, about, and the most parts.
QUEUE_ROWS, QUEUE_PARTS = 500_000, 256


def contains_any_field(df: DataFrame, query: str, *fields: str) -> DataFrame:
    """Rows whose fields, joined by spaces, contain the query without regard to case; arrays count by their members.
    A blank query keeps all rows."""
    needle = query.strip().lower()
    if not needle:
        return df
    parts = [F.array_join(f, " ") if dict(df.dtypes)[f].startswith("array") else F.col(f) for f in fields]
    return df.where(F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(needle)))


def within(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the members (a one-column table)."""
    return df.join(members.select(F.col(members.columns[0]).alias(key)).distinct(), key, "left_semi")


def visible_relations(relations: DataFrame, papers: DataFrame, least: float, layers: list[str], paper_id: str = "id") -> DataFrame:
    """Relations whose layer is on, that are no suggestion, strong enough or unscored, and whose ends both exist."""
    state = display_state(F.col("status"), F.col("strength"), F.col("confidence"), F.col("formalEligible"))
    kept = relations.withColumn("state", state).where((F.col("state") != "suggestion") & F.col("state").isin(layers))
    kept = kept.where((F.col("state") == "unscored") | (F.col("strength") >= least))
    ids = papers.select(F.col(paper_id).alias("_id")).distinct()
    for end in ("source", "target"):
        kept = kept.join(ids, F.col(end) == F.col("_id"), "left_semi")
    return kept


def formal_relation(status: Column, strength: Column, confidence: Column, eligible: Column) -> Column:
    """Verified, not ruled out, strength 60 and confidence 75 or more. A missing score never passes."""
    s, c = V.FORMAL
    return F.coalesce((status == "verified") & F.coalesce(eligible, F.lit(True)) & (strength >= s) & (confidence >= c), F.lit(False))


def formal_status(status: Column) -> Column:
    return F.coalesce(status.isin(*V.FORMAL_STATUSES), F.lit(False))


def memory_facets(items: DataFrame, state: str | None = "active", kind: str | None = None, evidence: str | None = None, provenance: str | None = None) -> DataFrame:
    for column, value in (("state", state), ("type", kind), ("evidenceState", evidence), ("provenance", provenance)):
        if value is not None:
            items = items.where(F.col(column) == value)
    return items


def queue_view(items: DataFrame) -> DataFrame:
    """items with their code, such as LIT-0001."""
    return items.withColumn("code", F.format_string("LIT-%04d", F.col("number")))


def open_queue(items: DataFrame, research: DataFrame | None = None) -> DataFrame:
    """(leg, place, code, id, status): what waits in a workspace. The leg is pending for items to work on, ready for
    finished ones that wait to be taken over, and research for a draft (id, status) that is to be set up or updated;
    the place in a leg is by number and id. Items of any other status, or of none, do not wait. A leg can be long: it is
    numbered in parts that cut the numbers at their quantiles, each from the end of those before."""
    leg = F.when(F.col("status").isin(*V.QUEUE_PENDING), "pending").when(F.col("status").isin(*V.QUEUE_READY), "ready")
    rows = queue_view(items).select(leg.alias("leg"), "number", "code", F.col("id").cast("string").alias("id"), "status").where("leg is not null")
    if research is not None:
        drafts = research.where(F.col("status").isin(*V.RESEARCH_OPEN))
        rows = rows.unionByName(drafts.select(F.lit("research").alias("leg"), F.col("id").cast("string").alias("id"), "status"), allowMissingColumns=True)
    few, rest = rows.where("leg = 'research'"), rows.where("leg <> 'research'")
    n = rest.count()
    count = min(QUEUE_PARTS, -(-n // QUEUE_ROWS))
    cuts = sorted(set(rest.agg(F.percentile_approx("number", [k / count for k in range(1, count)], 10_000)).first()[0] or [])) if count > 1 else []

    def part(low: int, high: int) -> Column:
        """The number of cuts below a row's number, found by halves; missing numbers are first, as in the order."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("number") > cuts[middle], part(middle + 1, high)).otherwise(part(low, middle))

    parts = few.withColumn("_part", F.lit(0)).unionByName(rest.withColumn("_part", part(0, len(cuts))))
    sizes = parts.groupBy("leg", "_part").agg(F.count("*").alias("_n"))
    before = sizes.select("leg", "_part", F.coalesce(F.sum("_n").over(Window.partitionBy("leg").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = parts.withColumn("place", F.row_number().over(Window.partitionBy("leg", "_part").orderBy("number", "id")))
    return numbered.join(F.broadcast(before), ["leg", "_part"]).select("leg", (F.col("place") + F.col("_before")).cast("int").alias("place"), "code", "id", "status")


def queue_split(items: DataFrame) -> dict[str, DataFrame]:
    return {s: items.where(F.col("status") == s).orderBy("number", "id") for s in ("pending", "ready", "processing", "organized")}


def batch_candidates(items: DataFrame, completed: DataFrame, requested: list[str] | None = None, size: int = 5) -> DataFrame:
    """The next `size` prepared pending items by number and id that no earlier batch completed."""
    open_ = items.where((F.col("status") == "pending") & (F.col("prepared")))
    if requested:
        open_ = open_.where(F.col("id").isin(requested))
    return open_.join(completed.select("id").distinct(), "id", "left_anti").orderBy("number", "id").limit(size)


def selected_claims(claims: DataFrame, selectors: list[str]) -> tuple[DataFrame, DataFrame]:
    """(claims named by their id or by an evidence id, selectors that name none)."""
    wanted = claims.sparkSession.createDataFrame([(s,) for s in selectors], "selector string")
    keys = claims.select("claimId", F.explode(F.array_union(F.array("claimId"), F.coalesce("evidenceIds", F.array().cast("array<string>")))).alias("selector"))
    hits = keys.join(F.broadcast(wanted), "selector")
    return claims.join(hits.select("claimId").distinct(), "claimId", "left_semi"), wanted.join(hits, "selector", "left_anti")


def pages_of(text: DataFrame, selectors: list[str]) -> DataFrame:
    """(doc_id, page, text) of pages 3 or 3-7; a range spans 101 pages at most. Pages begin at <!-- page: N -->."""
    ranges = []
    for s in selectors:
        a, _, b = s.partition("-")
        first, last = int(a), int(b or a)
        if first < 1 or last < first or last - first > 100:
            raise ValueError(f"invalid page range: {s}")
        ranges.append((first, last))
    parts = text.select("doc_id", F.explode(F.split("text", r"(?=<!-- page:\s*\d+\s*-->)")).alias("text"))
    parts = parts.withColumn("page", F.expr(r"try_cast(regexp_extract(text, '^<!-- page:\\s*(\\d+)\\s*-->', 1) as int)"))
    cond = F.lit(False)
    for first, last in ranges:
        cond = cond | F.col("page").between(first, last)
    return parts.where(cond).select("doc_id", "page", "text")


def without_todo(claims: DataFrame) -> DataFrame:
    return claims.where((F.trim("text") != "") & ~F.col("text").rlike(r"(?i)\bTODO\b"))


def with_usage(papers: DataFrame, counts: DataFrame, paper_id: str = "id") -> DataFrame:
    """papers with useCount: the count truncated and never below 0, 0 where there is none."""
    used = counts.select(F.col(counts.columns[0]).alias(paper_id), F.greatest(F.lit(0), F.floor(F.col(counts.columns[1]))).cast("int").alias("_n"))
    return papers.drop("useCount").join(used, paper_id, "left").withColumn("useCount", F.coalesce("_n", F.lit(0))).drop("_n")


def repaired_status(status: Column, has_source: Column, has_card: Column, has_fulltext: Column, evidence: Column, kind: Column) -> Column:
    """What a stored status becomes for the files that are there: an unknown one is derived from them, a verified one
    without card, full text or evidence needs attention, and one without its source, unless that is remote, is missing."""
    derived = F.when(~has_source, "source_missing").when(~has_fulltext, "imported").when(~has_card, "extracted").otherwise("card_draft")
    known = F.when(F.coalesce(status.isin(*V.PAPER_STATES), F.lit(False)), status).otherwise(derived)
    closed = has_card & has_fulltext & (F.coalesce(evidence, F.lit(0)) >= 1)
    kept = F.when((known == "evidence_verified") & ~closed, F.when(has_source, "needs_attention").otherwise("source_missing")).otherwise(known)
    return F.when(~has_source & (F.coalesce(kind, F.lit("pdf")) != "arxiv"), "source_missing").otherwise(kept)


def verification_badge(status: Column, issue: Column, closed: Column) -> Column:
    """struct<status, tone, label> of a paper: an integrity issue first, then verified evidence, then the status."""
    rows = [(issue == code, "needs_attention", "attention", label) for code, label in (
        ("source_missing", "Source missing"), ("source_hash_missing", "Source hash missing"), ("source_hash_mismatch", "Source hash mismatch"),
        ("card_missing", "Knowledge card missing"), ("fulltext_missing", "Full text missing"),
    )]
    rows.append(((status == "evidence_verified") & closed, "evidence_verified", "verified", "Evidence verified"))
    rows += [(status == s, s, tone, label) for s, tone, label in (
        ("source_missing", "attention", "Source missing"), ("needs_ocr", "attention", "OCR required"), ("needs_attention", "attention", "Review required"),
        ("extracted", "progress", "Full text extracted"), ("imported", "progress", "Source imported"), ("legacy_summary", "draft", "Legacy summary"),
    )]
    out = F.struct(F.coalesce(status, F.lit("card_draft")).alias("status"), F.lit("draft").alias("tone"), F.lit("Knowledge-card draft").alias("label"))
    for condition, s, tone, label in reversed(rows):
        out = F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(s).alias("status"), F.lit(tone).alias("tone"), F.lit(label).alias("label"))).otherwise(out)
    return out


def claim_trust(status: Column) -> Column:
    return (
        F.when(status == "evidence_verified", "verified_original_source")
        .when(status == "needs_attention", "verified_with_attention_flag")
        .otherwise("provisional_not_for_formal_use")
    )


def integrity_issue(source_missing: Column, hash_mismatch: Column, hash_missing: Column, card_missing: Column, fulltext_missing: Column) -> Column:
    """The first of a paper's issues in order of weight; null if it has none."""
    return F.coalesce(
        F.when(source_missing, "source_missing"), F.when(hash_mismatch, "source_hash_mismatch"), F.when(hash_missing, "source_hash_missing"),
        F.when(card_missing, "card_missing"), F.when(fulltext_missing, "fulltext_missing"),
    )


def located(locator: Column) -> Column:
    """Whether any field of a locator is filled in."""
    return F.coalesce(*(F.when(F.trim(locator[f].cast("string")) != "", F.lit(True)) for f in ("page", "section", "equation", "figure", "table")), F.lit(False))


def valid_locator(text: Column) -> Column:
    """A locator has one of the known forms and is no placeholder."""
    named = F.lit(False)
    for form in V.LOCATOR_FORMS:
        named = named | text.rlike(form)
    return F.coalesce(named & ~text.rlike(V.LOCATOR_PLACEHOLDER), F.lit(False))


def library_list(items: DataFrame, status: str | None, query: str, *fields: str) -> DataFrame:
    """Items of a status that match a query; catalog items first, then the highest numbers."""
    kept = items if status is None else items.where(F.col("status") == status)
    return contains_any_field(kept, query, *fields).orderBy(F.when(F.col("catalog"), 0).otherwise(1), F.desc("number"), "id")


def allowed_backup_path(path: Column, pdfs: bool = False) -> Column:
    """Relative paths of known files and folders; no caches, indexes or databases, and PDFs only if asked for."""
    safe = ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.?(/|$)") & ~path.rlike(r"(^|/)(Cache|Index)(/|$)") & ~path.rlike(r"(?i)\.sqlite3?$")
    inside = path.isin(*V.BACKUP_FILES)
    for folder in (*V.BACKUP_FOLDERS, *(("Library/PDFs/",) if pdfs else ())):
        inside = inside | path.startswith(folder)
    return F.coalesce(safe & inside, F.lit(False))


def catalog_items(papers: DataFrame) -> DataFrame:
    """Catalog papers as library items, numbered by id."""
    k = F.row_number().over(Window.orderBy("id"))  # the catalog of one library
    return papers.withColumn("number", k).withColumn("status", F.lit("organized")).withColumn("catalog", F.lit(True))


def paper_ids(new: DataFrame, known: DataFrame) -> DataFrame:
    """(id, paperId): the wished id, else one from the arXiv id, else from the title; taken ones get eight digits of
    the source's hash. new has (id, wished, arxivId, title, sha256)."""
    base = F.coalesce("wished", F.when(F.col("arxivId").isNotNull(), T.slug(F.concat(F.lit("arxiv-"), T.arxiv_base(F.col("arxivId"))))), T.slug(F.col("title")))
    both = new.withColumn("base", base).join(known.select(F.col("paperId").alias("base")).distinct().withColumn("_taken", F.lit(True)), "base", "left")
    return both.select("id", F.when(F.col("_taken"), F.concat_ws("-", "base", F.substring("sha256", 1, 8))).otherwise(F.col("base")).alias("paperId"))


def project_ids(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, projectId): project- and a slug of 96 characters at most; the n-th of a slug gets the suffix -n."""
    slug = F.substring(F.concat(F.lit("project-"), T.slug(F.col("name"), most=96, default="project")), 1, 96)
    stem = lambda c: F.regexp_replace(c, r"-\d+$", "")
    had = known.select(stem(F.col("projectId")).alias("base")).unionByName(known.select(F.col("projectId").alias("base"))).distinct()
    counts = known.select(F.col("projectId").alias("base"), F.lit(1).alias("n")).unionByName(known.where(F.col("projectId").rlike(r"-\d+$")).select(stem(F.col("projectId")).alias("base"), F.expr("cast(regexp_extract(projectId, '-(\\\\d+)$', 1) as int)").alias("n")))
    top = counts.groupBy("base").agg(F.max("n").alias("used")).join(had, "base", "left_semi")
    rows = names.withColumn("base", slug).withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy("name"))).join(top, "base", "left")
    n = F.coalesce("used", F.lit(0)) + F.col("k")
    return rows.select("name", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n.cast("string"))).alias("projectId"))


def accepted(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that meet all rules, violations (code, row as JSON) of the others). A null rule counts as not met."""
    codes = F.filter(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items())), lambda c: c.isNotNull())
    marked = df.withColumn("_codes", codes)
    bad = marked.where(F.size("_codes") > 0).select(F.explode("_codes").alias("code"), F.to_json(F.struct(*df.columns)).alias("row"))
    return marked.where(F.size("_codes") == 0).drop("_codes"), bad


def section_rows(cards: DataFrame, wanted: list[str]) -> DataFrame:
    """Card sections (paper_id, heading, body) whose slug is asked for."""
    return cards.where(T.slug(F.col("heading"), default="section").isin([w.lower().replace(" ", "-") for w in wanted]))
