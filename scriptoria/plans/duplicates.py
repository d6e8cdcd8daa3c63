"""Duplicate decisions for incoming documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.operators.joins import identity_matches, possible_matches

KEYS = {"sha256": "sha256", "arxiv_id": "arxivBase", "doi": "doi"}


def identities(docs: DataFrame, key: str) -> DataFrame:
    """docs (key, sha256, arxivId, doi, title, authors array) in comparable form."""
    return docs.select(
        key,
        F.lower("sha256").alias("sha256"),
        T.arxiv_base(F.col("arxivId")).alias("arxivBase"),
        T.doi(F.col("doi")).alias("doi"),
        T.title_author_key(F.col("title"), F.col("authors")).alias("titleAuthor"),
    )


def possible_counts(a: DataFrame, b: DataFrame, strict: DataFrame) -> DataFrame:
    """(id, n_possible): how many papers possible_matches() pairs an incoming document with, without listing a pair: the
    papers of its title and authors less those among them that a strict key names. Documents without any are left out."""
    papers = b.select("paperId", "titleAuthor").where("titleAuthor is not null").distinct()
    sizes = papers.groupBy("titleAuthor").agg(F.count("*").alias("n"))
    mine = a.select("id", "titleAuthor").where("titleAuthor is not null").distinct()
    named = strict.select("id", "paperId").distinct().join(papers, "paperId").groupBy("id", "titleAuthor").agg(F.count("*").alias("less"))
    left = mine.join(sizes, "titleAuthor").join(named, ["id", "titleAuthor"], "left").select("id", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n"))
    return left.groupBy("id").agg(F.sum("n").cast("int").alias("n_possible")).where("n_possible > 0")


def decide(incoming: DataFrame, existing: DataFrame, counted: bool = False) -> DataFrame:
    """(id, decision, paperIds, matchedBy, possible): what each incoming document is.

    `conflicting_keys` if strict keys name several papers, `conflicting_identifiers` if the one paper that they name
    has another arXiv id or DOI, `duplicate` if nothing contradicts, else `new`. possible lists papers of the same
    title and authors that no strict key names; with counted, n_possible takes its place, their number: of many papers
    with one title each document would list all others.
    """
    a, b = identities(incoming, "id"), identities(existing, "paperId")
    strict = identity_matches(a, b, KEYS)
    other = b.select("paperId", F.col("arxivBase").alias("arxiv2"), F.col("doi").alias("doi2"))
    checked = strict.join(a.select("id", "arxivBase", "doi"), "id").join(other, "paperId")
    clash = (F.col("arxivBase") != F.col("arxiv2")) | (F.col("doi") != F.col("doi2"))
    per = checked.groupBy("id").agg(F.array_sort(F.collect_set("paperId")).alias("paperIds"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("matchedBy")))).alias("matchedBy"), F.max(F.coalesce(clash, F.lit(False))).alias("clash"))
    if counted:
        maybe = possible_counts(a, b, strict)
    else:
        maybe = possible_matches(a, b, strict, "titleAuthor").groupBy("id").agg(F.array_sort(F.collect_set("paperId")).alias("possible"))
    none = F.array().cast("array<string>")
    out = a.select("id").join(per, "id", "left").join(maybe, "id", "left")
    decision = F.when(F.size("paperIds") > 1, "conflicting_keys").when(F.col("clash"), "conflicting_identifiers").when(F.size("paperIds") == 1, "duplicate").otherwise("new")
    kind = F.array().cast(dict(per.dtypes)["paperIds"])
    last = F.coalesce("n_possible", F.lit(0)).alias("n_possible") if counted else F.coalesce("possible", kind).alias("possible")
    return out.select("id", decision.alias("decision"), F.coalesce("paperIds", kind).alias("paperIds"), F.coalesce("matchedBy", none).alias("matchedBy"), last)
