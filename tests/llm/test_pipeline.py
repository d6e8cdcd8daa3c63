import re
from collections import Counter

import corpus_pipeline as cp
from pyspark.sql import functions as F

from scriptoria.llm import bpe, mixing
from scriptoria.llm.shared import materialize


def shingles(text, k=5):
    w = text.lower().split()
    return {" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    state = {"": docs}
    at = docs
    for name, stage in cp.STAGES[:-1]:
        at = materialize(stage(spark, at, sf_dir), "test")
        assert at.columns == docs.columns, name
        state[name] = at
    clean, single, cut, mixed = (state[n] for n, _ in cp.STAGES[:-1])
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    gone = docs.join(clean, "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.where("toxic = 0").count() <= 0.02 * labels.count() and gone.where("toxic = 1").count() >= 0.6 * labels.where("toxic = 1").count()
    # Near-dedup: no two kept documents are copies, and every one that went has a kept one like it.
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    kept = {r["doc_id"] for r in single.collect()}
    assert max(Counter(t.lower() for t in (texts[i] for i in kept) if t.split()).values()) == 1
    sets = {i: shingles(t) for i, t in texts.items()}
    groups = {}
    for i in texts:
        if i not in kept:
            groups[i] = max(len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) for j in texts if j != i and j < i)
    assert groups and min(groups.values()) >= 0.7
    assert cut.count() == single.count()
    words = lambda d: d.select(F.sum(F.size(F.expr("filter(split(text, '[ \\\\t-\\\\r]+'), x -> x <> '')")))).first()[0]
    assert words(cut) <= words(single)
    taken = mixing.mix(cut)
    assert words(mixed) == taken.select(F.sum("taken")).first()[0]
    last = cp.STAGES[-1][1](spark, mixed, sf_dir)
    assert last.count() == mixed.count() and last.where("not exact").count() == 0
    own = bpe.Encoder.load(*bpe.vocabulary())
    by_id = {(r["doc_id"], len(r["ids"])): r["ids"] for r in last.collect()}
    for r in mixed.limit(200).collect():
        ids = own.encode(r["text"])
        assert by_id[r["doc_id"], len(ids)] == ids


def test_stages_take_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, predicted int, ids string, _n int"
    rows = [(1, "same words here again and so on", "en", "a", 1, 0, "x", 1), (2, "same words here again and so on", "en", "a", 1, 0, "x", 1), (3, None, None, None, None, None, None, None), (None, "no id", "en", "a", 5, 0, "x", 1), (5, "", "en", "b", 0, 0, "x", 1)]
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for data in (rows, []):
        at = spark.createDataFrame(data, schema)
        for name, stage in cp.STAGES:
            at = materialize(stage(spark, at, str(tmp_path)), "odd")
            if name != "byte_level_bpe":
                # Columns of the operators' names keep their own values.
                assert {(r["predicted"], r["ids"], r["_n"]) for r in at.where("doc_id is not null and text <> ''").collect()} <= {(0, "x", 1)}
        assert (at.count() > 0) == bool(data)


def test_names():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "mixing", "byte_level_bpe"] and re.match("N", str(cp.ORACLE_SQL))


def test_stages_keep_columns_with_the_operators_names(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(1, "one text of some words", "en", "a", 22, 7, 77), (2, "and another one", "en", "b", 15, 8, 88)], "doc_id long, text string, lang string, source string, n_chars long, predicted int, n_removed int")
    for stage in (cp.toxicity_stage, cp.near_dedup_stage, cp.substring_stage):
        docs = materialize(stage(spark, docs, str(tmp_path)), "odd")
        assert sorted((r["predicted"], r["n_removed"]) for r in docs.collect()) == [(7, 77), (8, 88)]
