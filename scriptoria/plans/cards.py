"""Markdown cards: front matter, sections, claims and their evidence, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.functions import vocabulary as V
from scriptoria.operators.windows import fold_lines, nearest_before

FRONT = r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)"
HEADING = r"^#{1,6}\s+"
LEGACY = r"(?i)legacy|provisional"


def front_matter(cards: DataFrame) -> DataFrame:
    """(card_id, key, value) of the scalar fields between the two --- lines; quotes are taken off."""
    lines = cards.select("card_id", F.explode(F.split(F.regexp_extract("text", FRONT, 1), "\n")).alias("line"))
    field = lines.where(F.col("line").rlike(r"^[A-Za-z0-9_-]+:"))
    value = F.trim(F.regexp_extract("line", r"^[A-Za-z0-9_-]+:\s*(.*)$", 1))
    bare = F.regexp_replace(value, "^['\"]|['\"]$", "")
    return field.select("card_id", F.regexp_extract("line", r"^([A-Za-z0-9_-]+):", 1).alias("key"), F.when(value.isin("null", "~"), None).otherwise(bare).alias("value"))


def body_lines(cards: DataFrame) -> DataFrame:
    """(card_id, n, line) of the body, numbered."""
    body = F.regexp_replace("text", FRONT, "")
    return cards.select("card_id", F.posexplode(F.split(body, "\n")).alias("n", "line"))


def without_legacy(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept lines, (card_id, removed)): lines from a heading that says legacy or provisional to the next that does
    not are dropped."""
    heading = F.col("line").rlike(HEADING) | F.trim("line").rlike(HEADING)
    drop = F.when(heading, F.trim("line").rlike(LEGACY))
    marked = lines.withColumn("_drop", F.coalesce(nearest_before(lines, drop, ["n"], "card_id"), F.lit(False)))
    removed = marked.groupBy("card_id").agg(F.count_if("_drop").alias("removed"))
    return marked.where(~F.col("_drop")).drop("_drop"), removed


def section_lines(lines: DataFrame) -> DataFrame:
    """lines with the ## heading that they stand under; heading lines themselves are left out."""
    at = F.when(F.col("line").rlike(r"^##\s+\S"), F.regexp_extract("line", r"^##\s+(.+?)\s*$", 1))
    return lines.withColumn("heading", nearest_before(lines, at, ["n"], "card_id")).where(F.col("heading").isNotNull() & at.isNull())


def evidence_index(sections: DataFrame) -> DataFrame:
    """(card_id, evidenceId, locator, paraphrase) of lines `- E1 — locator — paraphrase` under Evidence index."""
    pattern = r"^\s*-\s*(E\d+)\s+[—–-]\s+(.+?)\s+[—–-]\s+(.+)\s*$"
    rows = sections.where((F.lower("heading") == "evidence index") & F.col("line").rlike(pattern))
    part = lambda k: F.trim(F.regexp_extract("line", pattern, k))
    return rows.select("card_id", part(1).alias("evidenceId"), part(2).alias("locator"), part(3).alias("paraphrase"))


def claims(sections: DataFrame) -> DataFrame:
    """(card_id, claimId, type, section, text, evidenceIds): a claim for each bullet of the six known sections.

    Lines that go on with a bullet are folded into it. Empty bullets and those that say TODO give none.
    """
    types = F.create_map(*(F.lit(x) for pair in V.SECTION_TYPES.items() for x in pair))
    known = sections.withColumn("type", types[F.lower("heading")]).where("type is not null and trim(line) <> '' and not trim(line) like '<!--%'")
    bullets = fold_lines(known, F.col("line").rlike(r"^\s*-\s+\S"), ["card_id", "type", "heading"], "n", "line")
    statement = bullets.withColumn("line", F.regexp_replace("line", r"^\s*-\s+", ""))
    made = statement.select("card_id", "type", F.col("heading").alias("section"), "n", T.bare_statement(F.col("line")).alias("text"), T.evidence_ids(F.col("line")).alias("evidenceIds"))
    made = made.where((F.col("text") != "") & ~F.col("text").rlike(r"(?i)\bTODO\b"))
    digest = F.substring(F.sha2(F.concat_ws("\x1f", "card_id", "type", "text", "evidenceIds"), 256), 1, 16)
    return made.withColumn("claimId", F.concat_ws("-", "card_id", F.regexp_replace("type", "_", "-"), digest)).drop("n")


def card_problems(cards: DataFrame) -> DataFrame:
    """(card_id, code): missing headings, evidence not numbered 1..n, bullets that cite none or unknown evidence, TODO."""
    lines, _ = without_legacy(body_lines(cards))
    sections = section_lines(lines)
    have = sections.select("card_id", F.lower("heading").alias("heading")).distinct()
    wanted = cards.select("card_id", F.explode(F.array(*(F.lit(h) for h in (*V.SECTION_TYPES, "evidence index")))).alias("heading"))
    missing = wanted.join(have, ["card_id", "heading"], "left_anti").select("card_id", F.concat(F.lit("heading_missing:"), "heading").alias("code"))
    evidence = evidence_index(sections).withColumn("k", F.row_number().over(Window.partitionBy("card_id").orderBy(F.expr("cast(substring(evidenceId, 2) as int)"))))
    order = evidence.where(F.col("evidenceId") != F.concat(F.lit("E"), "k")).select("card_id", F.lit("evidence_numbering").alias("code")).distinct()
    made = claims(sections)
    silent = made.where(F.size("evidenceIds") == 0).select("card_id", F.lit("bullet_without_evidence").alias("code"))
    cited = made.select("card_id", F.explode("evidenceIds").alias("evidenceId"))
    unknown = cited.join(evidence, ["card_id", "evidenceId"], "left_anti").select("card_id", F.concat(F.lit("evidence_unknown:"), "evidenceId").alias("code"))
    todo = lines.where(F.col("line").rlike(r"(?i)\bTODO\b")).select("card_id", F.lit("todo").alias("code"))
    return missing.unionByName(order).unionByName(silent).unionByName(unknown).unionByName(todo).distinct()


def render_card(card: DataFrame, statements: DataFrame) -> DataFrame:
    """(card_id, markdown) of accepted statements (card_id, type, text, locator): evidence is numbered in order."""
    order = Window.partitionBy("card_id").orderBy("type", "text")
    numbered = statements.withColumn("e", F.concat(F.lit("E"), F.row_number().over(order)))
    titles = F.create_map(*(F.lit(x) for name, kind in V.SECTION_TYPES.items() for x in (kind, name.capitalize())))
    bullets = numbered.groupBy("card_id", "type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("text", "e"))), lambda b: F.concat(F.lit("- "), b["text"], F.lit(" ["), b["e"], F.lit("]"))), "\n").alias("b"))
    block = F.concat(F.lit("## "), titles[F.col("type")], F.lit("\n\n"), F.col("b"))
    sections = bullets.groupBy("card_id").agg(F.array_join(F.array_sort(F.collect_list(block)), "\n\n").alias("s"))
    index = numbered.groupBy("card_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.length("e").alias("l"), "e", "locator", "text"))), lambda x: F.concat(F.lit("- "), x["e"], F.lit(" — "), x["locator"], F.lit(" — "), x["text"])), "\n").alias("i"))
    both = card.join(sections, "card_id").join(index, "card_id")
    return both.select("card_id", F.concat(F.lit("# "), "title", F.lit("\n\n"), "s", F.lit("\n\n## Evidence index\n\n"), "i", F.lit("\n")).alias("markdown"))


def summaries(sections: DataFrame, heading: str = "main results", most: int = 2) -> DataFrame:
    """(card_id, summary): the first bullets of a section as one text, without marks."""
    rows = claims(sections).where(F.lower("section") == heading)
    return rows.groupBy("card_id").agg(F.array_join(F.slice(F.array_sort(F.collect_list("text")), 1, most), " ").alias("summary"))
