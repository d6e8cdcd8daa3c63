"""A corpus pipeline of five operators: each stage's result is written as Parquet and is the next one's input.

run() gives the tokens of a training mix: toxic documents and near-duplicates are gone, repeated passages are cut,
sources are mixed to their weights, and what is left is encoded and decoded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm import bpe, mixing, simhash, spans, toxicity
from scriptoria.llm.shared import materialize, table


def beside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, list]:
    """docs with columns of these names out of an operator's way, and the columns that give them their names back."""
    away = {c: f"__own_{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(away), [F.col(away.get(c, c)).alias(c) for c in docs.columns]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict as toxic; it is fitted on the labels of docs.

    Null, empty and wordless texts have no offending sentence and stay; texts are scored whole, of any length. Rows with
    equal texts have equal scores and share a verdict. An empty table, and one without labels of both kinds, gives all
    of its rows. All columns come out as they were, those of the operator's names too.
    """
    model = toxicity.train(toxicity.labelled_documents(docs, table(spark, sf_dir, "labels")))
    apart, own = beside(docs, ["score", "predicted", "n_sentences", "offending", "worst"])
    return toxicity.score_documents(apart, model).where("predicted = 0").select(*own)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates: five words, a similarity of 0.8.

    Texts without words (null ones too) are near no other. Rows that share an id but not a group all stay; equal rows
    stay once, whatever their other columns are; rows of a null id all stay. Texts are compared whole, of any length. An
    empty table gives an empty result. All columns come out as they were.
    """
    return simhash.one_of_each(docs, simhash.similar_documents(docs, shingle=5, similarity=0.8))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the sentences of repeated spans.

    The first occurrence, by id and place, stays; rows that share an id, and equal rows of a null id, count as one
    document. Null and empty texts stay as they are; texts are read whole, of any length. An empty table gives an empty
    result. Columns come out as they were, but for text and n_chars, which follows it.
    """
    apart, own = beside(docs, ["n_sentences", "n_removed", "removed_chars"])
    return spans.dedup_substrings(apart).select(*own)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every time that the mix takes a document; the one at a source's cut has fewer words.

    Documents without words (null and empty texts) are never taken. A null source is a source, null ids are told apart
    by their texts, rows that share id, text and source are taken together. Texts are counted whole, of any length. An
    empty table gives an empty result. Columns come out as they were, but for the text at the cut and n_chars.
    """
    return mixing.mixed_documents(docs, materialize(mixing.mix(docs), "mix"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, exact): the tokens, and whether they decode to the text's bytes.

    Null and empty texts have no tokens; texts are encoded whole, of any length. Every row gives a row, repeated ones
    too; nulls in the three columns stay. An empty table gives an empty result. Other columns are not read.
    """
    kept = ["doc_id", "lang", "source"]
    encoded = bpe.encode_documents(docs, *bpe.vocabulary(), keep=kept, verify=True)
    return encoded.select(*kept, "n_tokens", "ids", "exact")


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("byte_level_bpe", tokens_stage),
]

#: SQL expresses neither the fitted model nor the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
