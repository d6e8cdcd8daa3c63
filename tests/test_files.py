import json

import pytest
from pyspark.sql import functions as F

from scriptoria.plans import index
from scriptoria.sources import readers, writers
from scriptoria.streaming import ledgers


def test_usage_ledger_tolerates_a_torn_tail_only(spark, tmp_path):
    line = lambda k: json.dumps({"schemaVersion": 2, "taskHash": "t", "projectId": None if k else "p", "paperId": f"x{k}"})
    (tmp_path / "a.jsonl").write_text(line(0) + "\n" + line(1) + "\n" + '{"paperId": "x')
    events, bad = readers.usage_ledger(spark, str(tmp_path / "a.jsonl"))
    assert events.count() == 2 and bad.count() == 0
    assert [r[0] for r in events.orderBy("n").select(readers.usage_key()).collect()] == ["t:p:x0", "t:x1"]
    (tmp_path / "b.jsonl").write_text('{"broken\n' + line(1) + "\n")
    assert readers.usage_ledger(spark, str(tmp_path / "b.jsonl"))[1].count() == 1


def test_memory_ledger_fails_on_blank_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"revision": 1}\n\n{"revision": 2}\n')
    with pytest.raises(Exception):
        readers.memory_ledger(spark, str(tmp_path / "m.jsonl"), "revision int").collect()


def test_publish_commit_and_append(spark, tmp_path):
    df = spark.range(3).select(F.col("id"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    path = str(tmp_path / "index")
    writers.commit(path, {"t": df}, None, "f1")
    assert readers.published(spark, path)[:2] == (1, "f1")
    with pytest.raises(RuntimeError):
        writers.commit(path, {"t": df}, None, "f2")
    assert not writers.point(spark, path, 1, "f3", "v") and readers.published(spark, path)[1] == "f1"
    (tmp_path / "index" / "current" / "0000000002.json").write_text("")  # a writer that died
    assert readers.published(spark, path)[:2] == (1, "f1")
    writers.commit(path, {"t": df}, "f1", "f4")  # takes the number after it
    assert readers.published(spark, path)[:2] == (3, "f4")
    log = str(tmp_path / "log")
    assert writers.append_once(df.union(df), log, "key").count() == 3
    writers.append_once(df, log, "key")
    assert spark.read.parquet(log).count() == 3


def test_a_built_index_is_read(spark, tmp_path):
    docs = spark.createDataFrame([(1, "soliton halo"), (2, "halo lensing")], "id long, body string")
    path = str(tmp_path / "index")
    mark = index.build(docs, path, "id", {"body": (F.col("body"), 1.0)})
    assert readers.index_tables(spark, path, "other") is None
    assert readers.index_tables(spark, path, mark)["lexicon"].count() == 3
    assert index.build(docs, path, "id", {"body": (F.col("body"), 1.0)}) == mark and readers.published(spark, path)[0] == 1
    found = index.rank(index.load(spark, path), spark.createDataFrame([(1, "lensing")], "query_id int, term string"))
    assert [r["doc_id"] for r in found.collect()] == [2]


def test_discovery_pages_and_cards(spark, tmp_path):
    (tmp_path / "in" / ".hidden").mkdir(parents=True)
    for name in ("b.pdf", "a.PDF", ".c.pdf", ".hidden/d.pdf", "x.txt"):
        (tmp_path / "in" / name).write_bytes(b"%PDF")
    assert [r["relativePath"] for r in readers.discovered(spark, str(tmp_path / "in")).collect()] == ["a.PDF", "b.pdf"]
    text = spark.createDataFrame([("d", "<!-- page: 1 -->one<!-- page: 2 -->two")], "doc_id string, text string")
    assert [tuple(r) for r in readers.pages(text).orderBy("page").collect()] == [("d", 1, "one"), ("d", 2, "two")]
    (tmp_path / "p1.md").write_text("# T\n")
    assert readers.cards(spark, str(tmp_path / "*.md")).first()["card_id"] == "p1"
    feed = spark.createDataFrame([("<feed><entry><id>http://x/abs/2401.1v1</id><title>A\n B</title><author><name>N</name></author><author><name>M</name></author></entry><entry><id>http://x/abs/2</id><title>C</title><author><name>O</name></author></entry></feed>",)], "xml string")
    first = readers.atom(feed).first()
    assert first["id"] == "2401.1v1" and first["title"] == "A B" and first["authors"] == ["N", "M"]


def test_artifact_revisions_append_only_changes(spark):
    known = spark.createDataFrame([], "paperId string, revision int, artifactSha256 string")
    found = spark.createDataFrame([("p", "a", "b", "c")], "paperId string, cardSha256 string, fulltextSha256 string, sourceSha256 string")
    first = writers.artifact_revisions(known, found)
    row = first.first()
    assert row["revision"] == 1
    again = writers.artifact_revisions(first.select("paperId", "revision", "artifactSha256"), found)
    assert again.count() == 0


def test_usage_stream_counts_keys_once(spark, tmp_path):
    src = tmp_path / "src"
    schema = "taskHash string, projectId string, paperId string"
    spark.createDataFrame([("t", "p", "x"), ("t", "p", "x"), ("u", "p", "x")], schema).write.json(str(src))
    out = ledgers.run_available(ledgers.counts(ledgers.usage_stream(spark, str(src), schema)), "counts_test", str(tmp_path / "ck"))
    assert [tuple(r) for r in out.collect()] == [("p", "x", 2)]
