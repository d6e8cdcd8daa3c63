"""Candidate sentences, headings, equations and anchors of documents' pages, ranked and capped per kind."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.functions import vocabulary as V
from scriptoria.functions.normal import once
from scriptoria.operators.windows import nearest_before, with_context


def spans(pages: DataFrame, ends: str) -> DataFrame:
    """(doc_id, page, ordinal, start, end, text): pieces of pages (doc_id, page, text) up to and with each end.

    ends is the body of a character class. Offsets are characters; white space is squeezed in text; blank pieces are
    left out but count in ordinal.
    """
    parts = pages.select("doc_id", "page", F.posexplode(F.split("text", f"(?<=[{ends}])")).alias("ordinal", "raw"))
    w = Window.partitionBy("doc_id", "page").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("raw")).over(w)
    out = parts.withColumn("end", end).withColumn("start", F.col("end") - F.length("raw"))
    return out.withColumn("text", T.squeeze(F.col("raw"))).where("text <> ''").drop("raw")


def words(text: Column) -> Column:
    return F.size(F.split(text, r"\s+"))


def heading_signals(text: Column) -> Column:
    """Why a line looks like a heading: a common name, a number, capitals only; empty if it does not."""
    canonical = F.lower(F.trim(text, F.lit(":")))
    letters = F.regexp_replace(text, r"[^\p{L}]+", "")
    found = F.array(
        F.when(canonical.isin(*V.COMMON_HEADINGS), F.lit("common_section_heading")),
        F.when(text.rlike(V.NUMBERED_HEADING), F.lit("numbered_heading")),
        F.when((F.length(letters) >= 3) & (F.length(F.regexp_replace(letters, r"[^\p{Lu}]+", "")) == F.length(letters)), F.lit("uppercase_heading")),
    )
    fits = F.length(text).between(3, 120) & (words(text) <= 14) & ~text.rlike(r"[.?!;]$")
    return F.when(fits, F.filter(found, lambda s: s.isNotNull())).otherwise(F.array().cast("array<string>"))


def equation_signals(text: Column) -> Column:
    found = F.filter(F.array(*(F.when(F.contains(text, F.lit(o)), F.lit(f"operator:{o}")) for o in V.EQUATION_OPERATORS)), lambda s: s.isNotNull())
    fits = F.length(text).between(3, 180) & ~F.contains(F.lower(text), F.lit("http")) & text.rlike(r"[\p{L}\p{N}]")
    return F.when(fits, found).otherwise(F.array().cast("array<string>"))


def vocabulary_signals(text: Column, kind: str) -> Column:
    return once(F.lower(text), lambda low: F.filter(F.array(*(F.lit(w) for w in sorted(V.SIGNALS[kind]))), lambda w: F.contains(low, w)))


def sentence_signals(text: Column) -> Column:
    """array<struct<kind, signals>>: the kinds of candidate that a sentence is, with why."""
    anchors = {"figure": text.rlike(V.FIGURE_ANCHOR), "table": text.rlike(V.TABLE_ANCHOR), "citation": text.rlike(V.CITATION_ANCHORS[0]) | text.rlike(V.CITATION_ANCHORS[1])}
    names = {"figure": "figure_marker", "table": "table_marker", "citation": "citation_marker"}
    none = F.array().cast("array<string>")
    fits = F.length(text).between(40, 360) & once(words(text), lambda n: n.between(6, 60))
    marked = F.array(*(F.struct(F.lit(k).alias("kind"), F.when(c, F.array(F.lit(names[k]))).otherwise(none).alias("signals")) for k, c in anchors.items()))
    spoken = F.array(*(F.struct(F.lit(k).alias("kind"), vocabulary_signals(text, k).alias("signals")) for k in V.SIGNALS))
    return F.filter(F.concat(marked, F.when(fits, spoken).otherwise(F.array().cast("array<struct<kind:string,signals:array<string>>>"))), lambda f: F.size(f["signals"]) > 0)


def may_hold(text: Column) -> Column:
    """Whether a page may have a candidate: true for each page that has one, and for some others.

    Lines are looked at one by one. A squeezed sentence is a piece of the squeezed page between blanks, ends of sentences
    and the page's ends, so what a sentence holds the page holds.
    """
    lines = F.transform(F.split(text, r"(?<=[\n\r])"), T.squeeze)
    known = F.exists(lines, lambda x: (F.size(heading_signals(x)) > 0) | (F.size(equation_signals(x)) > 0))
    phrases = sorted({w for signals in V.SIGNALS.values() for w in signals})
    any_of = lambda low, ours: reduce(or_, (F.contains(low, F.lit(w)) for w in phrases if w.startswith("we ") == ours))
    # A pattern is tried only where the letters that it asks for stand, and what begins with "we" only where that does.
    anchors = (("fig", V.FIGURE_ANCHOR), ("table", V.TABLE_ANCHOR), ("[", V.CITATION_ANCHORS[0]), ("(", V.CITATION_ANCHORS[1]))
    said = lambda page, low: any_of(low, False) | (F.contains(low, F.lit("we ")) & any_of(low, True)) | reduce(or_, (F.contains(low, F.lit(w)) & page.rlike(a) for w, a in anchors))
    return once(T.squeeze(text), lambda page: once(F.lower(page), lambda low: said(page, low))) | known


def routing_score(kind: Column, text: Column, signals: Column, section: Column) -> Column:
    """100 a signal, one a word up to 60, 50 for a fitting section, 25 for a question mark in a question, 10 for "we"."""
    low, under = F.lower(text), F.lower(F.coalesce(section, F.lit("")))
    support = F.lit(False)
    for name, names in V.SECTION_SUPPORT.items():
        hit = F.lit(False)
        for n in names:
            hit = hit | F.contains(under, F.lit(n))
        support = support | ((kind == name) & hit)
    return (
        F.size(signals) * 100
        + F.least(words(text), F.lit(60))
        + F.when(support, 50).otherwise(0)
        + F.when((kind == "research_question") & F.contains(text, F.lit("?")), 25).otherwise(0)
        + F.when(low.startswith("we ") | F.contains(low, F.lit(" we ")), 10).otherwise(0)
    )


def collect(pages: DataFrame) -> DataFrame:
    """All candidates of pages (doc_id, page, text): (doc_id, kind, page, section, ordinal, start, end, text, previous,
    next, signals, score).

    Pages that cannot have one are left out before they are cut into spans; the others are shuffled once, whole, and both
    kinds of span read them there. Signals are found below the windows, once a span.
    """
    # An outer explode and not a filter: Spark would move that to the files, below the spreading of a table that few hold.
    kept = F.explode_outer(F.filter(F.array("text"), may_hold)).alias("text")
    pages = pages.select("doc_id", "page", kept).where("text is not null").repartition("doc_id")
    text = F.col("text")
    lines = spans(pages, r"\n\r").withColumn("heads", heading_signals(text)).withColumn("equation", equation_signals(text))
    lines = with_context(lines, "doc_id", "page")
    lines = lines.withColumn("section", nearest_before(lines, F.when(F.size("heads") > 0, text), ["ordinal"], "doc_id", "page"))
    # Sentences run over line ends; the section is that of the last heading that starts at or before them.
    sentences = with_context(spans(pages, ".!?").withColumn("found", sentence_signals(text)), "doc_id", "page").where(F.size("found") > 0)
    marks = lines.where(F.size("heads") > 0).select("doc_id", "page", "start", F.col("text").alias("head"), F.lit(0).alias("is_sentence"))
    both = marks.unionByName(sentences.select("doc_id", "page", "start", F.lit(None).cast("string").alias("head"), F.lit(1).alias("is_sentence"), "ordinal", "end", "text", "previous", "next", "found"), allowMissingColumns=True)
    both = both.withColumn("section", nearest_before(both, F.col("head"), ["start", "is_sentence"], "doc_id", "page")).where("is_sentence = 1")
    kinds = (("section", text, "heads"), ("equation", F.col("section"), "equation"))
    own = F.array(*(F.struct(F.lit(kind).alias("kind"), section.alias("section"), F.array_sort(signals).alias("signals")) for kind, section, signals in kinds))
    own = lines.withColumn("f", F.explode(F.filter(own, lambda f: F.size(f["signals"]) > 0)))
    rest = ["ordinal", "start", "end", "text", "previous", "next", "f.signals"]
    out = own.select("doc_id", "f.kind", "page", "f.section", *rest).unionByName(both.withColumn("f", F.explode("found")).select("doc_id", "f.kind", "page", "section", *rest))
    return out.withColumn("score", routing_score(F.col("kind"), F.col("text"), F.col("signals"), F.col("section")))


def ranked(candidates: DataFrame) -> DataFrame:
    """The best candidate of each (kind, folded text) of a document, capped per kind, with its place.

    The order is score, page, start, then id, as for the caps.
    """
    pin = F.sha2(F.concat_ws("\x1f", F.col("doc_id").cast("string"), "kind", F.col("page").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"), F.col("ordinal").cast("string"), T.identity(F.col("text"))), 256)
    rows = candidates.withColumn("id", pin)
    order = [F.desc("score"), "page", "start", "id"]
    once = rows.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "kind", T.identity(F.col("text"))).orderBy(*order))).where("_k = 1")
    caps = F.create_map(*(F.lit(x) for pair in V.CANDIDATE_CAPS.items() for x in pair))
    place = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy(*order))
    return once.withColumn("place", place).where(F.col("place") <= caps[F.col("kind")]).drop("_k")


def review_order(candidates: DataFrame) -> DataFrame:
    kinds = F.create_map(*(x for k, name in enumerate(V.CANDIDATE_CAPS) for x in (F.lit(name), F.lit(k))))
    return candidates.orderBy("doc_id", kinds[F.col("kind")], F.desc("score"), "page", "start", "id")
