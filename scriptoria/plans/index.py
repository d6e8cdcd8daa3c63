"""A full-text index as Parquet tables: built once over a corpus, read by term.

Postings are range-partitioned and sorted by (term, document), so a query's terms prune files and row groups by their
statistics, and a term that every document has is spread over as many files as it needs. Lengths are kept with the
postings, document counts in a lexicon, totals in one row; a query touches nothing else. A new index is published
under the fingerprint of its corpus and replaces the old one by a pointer.
"""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.operators.aggregates import corpus_fingerprint
from scriptoria.plans.fulltext import IDF_FLOOR, by_document, counted, maybe_broadcast, scored
from scriptoria.sources.pointers import delete, files_mark
from scriptoria.sources.readers import INDEX_TABLES, published
from scriptoria.sources.writers import announce, prune, stage

#: Distinct query terms that are pushed into the scan as a list; more meet the postings in a join.
PUSHED_TERMS = 500
#: Times that an index is built while its corpus moves.
ATTEMPTS = 3


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """postings (term, doc_id, f, d) and totals (n_docs, avg_d) of documents with their terms, as counted() gives them."""
    totals = rows.agg(F.count("*").alias("n_docs"), F.avg("d").alias("avg_d"))
    postings = rows.select("doc_id", "d", F.inline("terms")).select("term", "doc_id", "f", "d")
    return {"postings": postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"), "totals": totals}


def mark_of(docs: DataFrame, doc_id: str, columns: dict[str, tuple[Column, float]]) -> str:
    """What an index stands for: the files that docs reads, by name, size and time, and the columns with their weights.
    Only a table that reads no files is hashed by its rows. docs must follow from its files and these names alone."""
    files = docs.inputFiles()
    body = files_mark(docs.sparkSession, files) if files else corpus_fingerprint(docs).first()["fingerprint"]
    return sha256(json.dumps([body, doc_id, sorted((n, w) for n, (_, w) in columns.items()), sorted(docs.columns)]).encode()).hexdigest()


def build(docs: DataFrame, path: str, doc_id: str, columns: dict[str, tuple[Column, float]]) -> str:
    """Build and publish an index below path unless the published one stands for the corpus as it is; returns its mark.

    An index whose corpus has moved while it was built is built again, ATTEMPTS times at most. Of older versions the one
    before stays, for readers that have begun with it.
    """
    spark = docs.sparkSession
    for _ in range(ATTEMPTS):
        mark, now = mark_of(docs, doc_id, columns), published(spark, path)
        if now and now[1] == mark:
            return mark
        # Texts are cut once: the range partitioning reads its input twice, and the totals read it too.
        version = stage({"counted": counted(docs, doc_id, columns)}, path)
        stage(tables(spark.read.parquet(f"{path}/{version}/counted")), path, version)
        delete(spark, f"{path}/{version}/counted")
        made = {t: spark.read.parquet(f"{path}/{version}/{t}") for t in ("postings", "totals")}
        seen = made["postings"].groupBy("term").agg(F.count("*").alias("n"))
        idf = F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
        lexicon = seen.crossJoin(F.broadcast(made["totals"])).select("term", "n", F.when(idf <= 0, IDF_FLOOR).otherwise(idf).alias("idf"))  # totals is one row
        lexicon.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/{version}/lexicon")
        if mark_of(docs, doc_id, columns) == mark:
            announce(spark, path, mark, version)
            prune(spark, path, 2)
            return mark
        delete(spark, f"{path}/{version}")
    raise RuntimeError(f"the corpus changed while its index was built, {ATTEMPTS} times")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{path}/{published(spark, path)[2]}/{t}") for t in INDEX_TABLES}


def rank(index: dict[str, DataFrame], terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank) as plans.fulltext.bm25() gives, from an index."""
    distinct = [r[0] for r in terms.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    postings, lexicon = index["postings"], index["lexicon"]
    if len(distinct) <= PUSHED_TERMS:
        postings, lexicon = (t.where(F.col("term").isin(distinct)) for t in (postings, lexicon))
    wanted = terms.join(lexicon, "term").crossJoin(F.broadcast(index["totals"])).select("query_id", "term", "idf", "avg_d")
    # A posting is shuffled once, not once for each query that has its term.
    found = postings.join(maybe_broadcast(terms.select("term").distinct()), "term", "left_semi")
    return scored(by_document(found, index["totals"].first()["n_docs"], terms.select("query_id").distinct().count()), maybe_broadcast(wanted))
