"""Review packets against the pages that they cite: every candidate is pinned to a page's text by the text's hash and by
a half-open range of UTF-16 units, as its makers count, and must be what stands there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import vocabulary as V

#: Code points of a candidate's text; a longer one is cut, with an ellipsis as the last.
MOST_TEXT = 2_400


def utf16(text: Column) -> Column:
    return F.encode(text, "UTF-16BE")


def splits_pair(units: Column, at: Column) -> Column:
    """Whether a place in UTF-16 units lies within a surrogate pair."""
    return F.hex(F.substr(units, 2 * at + 1, F.lit(2))).between("DC00", "DFFF")


def slice_utf16(units: Column, start: Column, end: Column) -> Column:
    """The text from start to end, which must not lie within surrogate pairs."""
    return F.decode(F.substr(units, 2 * start + 1, 2 * (end - start)), "UTF-16BE")


def to_code_points(units: Column, at: Column) -> Column:
    """A place in UTF-16 units in code points."""
    return F.length(F.decode(F.substr(units, F.lit(1), 2 * at), "UTF-16BE")).cast("long")


def pinned(candidates: DataFrame, packets: DataFrame, quality: DataFrame, pages: DataFrame) -> DataFrame:
    """candidates with problem, start_point and end_point: the first thing wrong with each, and its range in code points.

    candidates have (candidateId, docId, kind, page, sourceSha256, pageTextSha256, start, end, text, status, purpose,
    verificationState), packets (docId, sourceSha256), quality (docId, page, pageTextSha256) as a packet states them, pages
    (docId, page, text) as they are. Problems, in this order: id, repeated, kind, source, not_provisional, page_unknown,
    page_repeated, not_pinned (the packet states another hash of the page, or none), page_changed (the page's text has
    another), range, splits_pair, text. Places are known where the range fits.
    """
    said = quality.groupBy("docId", "page").agg(F.count("*").alias("_said_n"), F.min("pageTextSha256").alias("_said"))
    there = pages.select("docId", "page", utf16(F.col("text")).alias("_units"), F.sha2("text", 256).alias("_page_hash"))
    source = packets.select("docId", F.col("sourceSha256").alias("_source"))
    rows = candidates.withColumn("_times", F.count("*").over(Window.partitionBy("docId", "candidateId")))
    rows = rows.join(source, "docId", "left").join(said, ["docId", "page"], "left").join(there, ["docId", "page"], "left")
    size = (F.octet_length("_units") / 2).cast("long")
    start, end = F.col("start").cast("int"), F.col("end").cast("int")
    fits = F.coalesce((start >= 0) & (end > start) & (end <= size), F.lit(False))
    split = splits_pair(F.col("_units"), start) | splits_pair(F.col("_units"), end)
    readable = fits & ~F.coalesce(split, F.lit(True))
    rows = rows.withColumn("_body", F.when(readable, slice_utf16(F.col("_units"), start, end)))
    cut = F.when(F.length("_body") > MOST_TEXT, F.concat(F.substring("_body", 1, MOST_TEXT - 1), F.lit("…"))).otherwise(F.col("_body"))
    routing = (F.col("status") == "provisional") & (F.col("purpose") == "routing_only") & (F.col("verificationState") == "unverified")
    problem = F.coalesce(
        F.when(~F.coalesce(F.col("candidateId").rlike(V.CANDIDATE_ID), F.lit(False)), "id"),
        F.when(F.col("_times") > 1, "repeated"),
        F.when(~F.coalesce(F.col("kind").isin(*V.CANDIDATE_KINDS), F.lit(False)), "kind"),
        F.when(~F.coalesce(F.col("sourceSha256") == F.col("_source"), F.lit(False)), "source"),
        F.when(~F.coalesce(routing, F.lit(False)), "not_provisional"),
        F.when(F.col("_units").isNull(), "page_unknown"),
        F.when(F.col("_said_n") > 1, "page_repeated"),
        F.when(~F.coalesce(F.col("_said") == F.col("pageTextSha256"), F.lit(False)), "not_pinned"),
        F.when(F.col("_page_hash") != F.col("pageTextSha256"), "page_changed"),
        F.when(~fits, "range"),
        F.when(~readable, "splits_pair"),
        F.when(~F.coalesce((F.length("text") > 0) & (F.col("text") == cut), F.lit(False)), "text"),
    )
    return rows.select(
        *(F.col(c) for c in candidates.columns), problem.alias("problem"),
        F.when(readable, to_code_points(F.col("_units"), start)).alias("start_point"), F.when(readable, to_code_points(F.col("_units"), end)).alias("end_point"),
    )


def in_review_order(candidates: DataFrame) -> DataFrame:
    """(docId, candidateId, place): candidates without a problem by kind, score, page, start and id."""
    kind = F.array_position(F.array(*map(F.lit, V.CANDIDATE_KINDS)), F.col("kind"))
    by = Window.partitionBy("docId").orderBy(kind, F.desc("routingScore"), "page", "start", "candidateId")
    return candidates.where("problem is null").select("docId", "candidateId", F.row_number().over(by).alias("place"))
