"""What a step's work grows with, read from its plan or counted, and results where a group is large."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.operators import joins, predicates
from scriptoria.plans import candidates, duplicates, fulltext, hierarchy, index, screening


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def docs(spark):
    rows = [(1, "b a b", "a c a b"), (2, None, "c"), (3, "", ""), (4, "x", "x x x"), (5, "a", None)]
    return spark.createDataFrame(rows, "id int, title string, body string")


@pytest.fixture
def columns(spark):
    return {"title": (F.col("title"), 8.0), "body": (F.col("body"), 1.0)}


def test_terms_are_counted_inside_the_row(docs, columns):
    """the index's counts were shuffled by term and document before they were shuffled into its order."""
    out = fulltext.counted(docs, "id", columns)
    for r in docs.join(out.withColumnRenamed("doc_id", "id"), "id").collect():
        want = Counter()
        for text, w in ((r["title"], 8.0), (r["body"], 1.0)):
            for t in (text or "").split():
                want[t] += w
        assert {t["term"]: t["f"] for t in r["terms"]} == want and len(r["terms"]) == len(want)
        assert r["d"] == len((r["title"] or "").split()) + len((r["body"] or "").split())
    assert "Exchange" not in plan(out)


def test_postings_are_shuffled_once_by_document(spark, docs, columns, tmp_path):
    """a row for each query and posting was shuffled, and an index of a few MB was broadcast."""
    terms = spark.createDataFrame([(1, "a"), (1, "c"), (2, "a"), (2, "x"), (3, "none")], "query_id int, term string")
    index.build(docs, str(tmp_path), "id", columns)
    both = fulltext.bm25(docs, "id", columns, terms), index.rank(index.load(spark, str(tmp_path)), terms)
    rows = [sorted((r["query_id"], r["doc_id"], round(r["rank"], 9)) for r in df.collect()) for df in both]
    assert rows[0] == rows[1] and {(q, d) for q, d, _ in rows[0]} == {(1, 1), (1, 2), (1, 5), (2, 1), (2, 4), (2, 5)}
    for df in both:
        assert "hashpartitioning(query_id" not in plan(df) and "hashpartitioning(doc_id" in plan(df)


def test_parts_of_postings_follow_the_documents(spark):
    postings = spark.createDataFrame([("a", 1, 1.0, 1)], "term string, doc_id int, f double, d int")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert fulltext.by_document(postings, 10).rdd.getNumPartitions() == least
    assert fulltext.by_document(postings, 1_000 * fulltext.PART_DOCUMENTS).rdd.getNumPartitions() == max(least, 1_000)


def test_parts_of_postings_follow_the_pairs(spark, docs, columns, tmp_path, monkeypatch):
    """a part held as many pairs as its documents had with all queries, however many those were."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(fulltext, "PART_PAIRS", 2)
    terms = spark.createDataFrame([(q, "a") for q in range(6)], "query_id int, term string")
    index.build(docs, str(tmp_path), "id", columns)
    for df in (fulltext.bm25(docs, "id", columns, terms), index.rank(index.load(spark, str(tmp_path)), terms)):
        assert "hashpartitioning(doc_id" in plan(df) and ", 15), REPARTITION_BY_NUM" in plan(df) and least < 15
        assert sorted({(r["query_id"], r["doc_id"]) for r in df.collect()}) == [(q, d) for q in range(6) for d in (1, 5)]


def test_items_meet_regions_by_their_list_of_words(spark):
    """F8: a row was counted for each item and region, and one task held them all."""
    items = spark.createDataFrame([(k, "r1" if k == 9 else "gone" if k == 8 else None, ["halo", "core"] if k % 2 else ["core", "lens"]) for k in range(10)], "id int, regionId string, words array<string>")
    regions = spark.createDataFrame([("r2", ["halo"]), ("r1", ["halo"]), ("r3", ["lens", "core"]), ("r4", ["core"])], "regionId string, words array<string>")
    got = joins.best_region(items, regions)
    assert dict(map(tuple, got.collect())) == {k: "r1" if k % 2 else "r3" for k in range(10)}
    assert "hashpartitioning(id" not in plan(got)


def test_a_long_leg_is_numbered_in_parts(spark, monkeypatch):
    """one task sorted a whole leg."""
    monkeypatch.setattr(predicates, "QUEUE_ROWS", 10)
    status = ["pending_codex", "ready_to_refresh", None]
    rows = [(f"i{k}", None if k % 17 == 0 else (k * 7) % 23, status[k % 3]) for k in range(150)]
    research = spark.createDataFrame([("b", "pending_update"), ("a", "pending_update")], "id string, status string")
    got = predicates.open_queue(spark.createDataFrame(rows, "id string, number int, status string"), research)
    for leg, s in (("pending", "pending_codex"), ("ready", "ready_to_refresh")):
        want = sorted(((n is not None, n or 0, i) for i, n, x in rows if x == s))
        assert [(r["place"], r["id"]) for r in sorted(got.where(F.col("leg") == leg).collect(), key=lambda r: r["place"])] == [(k + 1, w[2]) for k, w in enumerate(want)]
    assert [(r["place"], r["id"]) for r in got.where("leg = 'research'").orderBy("place").collect()] == [(1, "a"), (2, "b")]
    assert "_part" in plan(got)


def test_possible_papers_are_counted_without_pairs(spark):
    """documents of one title listed all papers of that title."""
    kind = "string, sha256 string, arxivId string, doi string, title string, authors array<string>"
    new = [(f"d{k}", f"s{k % 6}", None, None, "T" if k < 9 else "" if k == 9 else "U", ["a"]) for k in range(14)]
    known = [(f"p{k}", f"s{k}", None, None, "t" if k < 5 else "U", ["A"]) for k in range(8)]
    a, b = spark.createDataFrame(new, "id " + kind), spark.createDataFrame(known, "paperId " + kind)
    listed = {r["id"]: (r["decision"], r["paperIds"], len(r["possible"])) for r in duplicates.decide(a, b).collect()}
    counted = {r["id"]: (r["decision"], r["paperIds"], r["n_possible"]) for r in duplicates.decide(a, b, counted=True).collect()}
    assert listed == counted and {n for *_, n in counted.values()} >= {0, 2, 3, 4, 5}


def test_papers_with_the_same_tags_are_compared_once(monkeypatch):
    """each paper was compared with every paper that was placed before it."""
    calls, likeness = [], hierarchy.Region.likeness
    monkeypatch.setattr(hierarchy.Region, "likeness", lambda self, *a: calls.append(1) or likeness(self, *a))
    tags = {f"p{k:04}": {"ab"[k % 2], "xyz"[k % 3]} for k in range(600)}
    groups = hierarchy.Region("r", tags, {("p0001", "p0599"): 1.0}, "s").fresh()
    assert sorted(p for members in groups.values() for p in members) == sorted(tags)
    # Founding compares every paper with at most 12 seeds, companions as many.
    assert len(calls) < 30 * len(tags)


def test_tokens_of_a_document_are_counted_inside_the_row(spark):
    """a row for each document and token was shuffled to be counted."""
    docs = spark.createDataFrame([(1, "bb aa bb 7 x"), (2, None), (3, "aa")], "docId int, text string")
    got = screening.frequencies(docs, "docId", "text")
    assert sorted(map(tuple, got.collect())) == [(1, "7", 1), (1, "aa", 1), (1, "bb", 2), (3, "aa", 1)]
    assert "Exchange" not in plan(got)


def test_pages_without_candidates_are_left_out_before_they_are_cut(spark, monkeypatch):
    """every page was cut into spans, which were shuffled and sorted, and each sentence was lowered for each phrase."""
    plain = "The rate of a run is low. It goes up\nand down again, and so on!  "
    held = [
        "Results", "x\r2.1 On Waves\ry", "ALL CAPITALS", "a line\n\nE = mc", "See Fig.", "see Fig 3", "FIGURES 12b. So", "as tables. 4", "as Table\n4a", "so [2, 3].", "(Smith et al. 2019) said", "so (smith 2019)",
        "here\n we \t use the rate of it, as it is so.", "HOWEVER, the rate of a run is not what it was.", "however it is", "In this the rate of it is\tfor\nsimplicity low", "the rate of a run, we ask.we use it, so it is.",
    ]
    rows = [(k, p, t) for k, t in enumerate([plain, "", None, *held, *(plain + t for t in held), *(t + "." + plain for t in held)]) for p in (1, 2)]
    pages = spark.createDataFrame(rows, "doc_id int, page int, text string")
    got = sorted(map(str, candidates.ranked(candidates.collect(pages)).collect()))
    may = {(r["doc_id"], r["page"]) for r in pages.where(candidates.may_hold(F.col("text"))).collect()}
    monkeypatch.setattr(candidates, "may_hold", lambda text: text.isNotNull())
    whole = candidates.ranked(candidates.collect(pages)).collect()
    assert got == sorted(map(str, whole)) and {r["kind"] for r in whole} >= {"section", "equation", "figure", "table", "citation", "method", "limitation", "assumption"}
    assert {(r["doc_id"], r["page"]) for r in candidates.collect(pages).collect()} <= may and not may & {(k, p) for k in range(3) for p in (1, 2)}


def test_tokens_are_cut_and_counted_as_by_the_expression(spark):
    """tokens were cut by an expression for each of them, which now only cuts texts outside the plain blocks."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    held = ["".join(map(chr, points[at : at + 64])) for at in range(0, len(points), 64)] + [f"{chr(c)} {chr(c)}a {chr(c)}1 7{chr(c)}" for c in [*range(0x530), *range(0x1E00, 0x2C00)]]
    texts = [None, "", "x", "The the 7 a b2 THE", "halo 日本 halo 7", "かな", "İstanbul ΣΑΣ ß \U0001f600ok ½ ² Ⅷ ①", "a" * 5_000 + " b" * 3, *held]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "docId int, text string").repartition(4)
    got = {r["docId"]: {w["token"]: w["tf"] for w in r["words"]} for r in screening.counted(df, ["docId"], "text").collect()}
    want = {r["docId"]: Counter(r["t"]) for r in df.select("docId", T.screening_tokens(F.col("text")).alias("t")).collect()}
    assert got == want and len(want) == len(texts)
    assert df.where(F.lower("text").rlike(f"[^{screening.PLAIN}]")).count() < df.count() - 5_000


def test_advice_cuts_tokens_once_and_shuffles_rare_ones_alone(spark, monkeypatch, tmp_path):
    """four passes cut all texts, and all occurrences were shuffled where the vocabulary was no longer broadcast."""
    calls, cut = [], screening.counted
    monkeypatch.setattr(screening, "counted", lambda *a: calls.append(a[1]) or cut(*a))
    texts = [f"halo {'core ' * (k % 3)}w{k} lens{k % 5}" for k in range(40)] + ["", None, "alone", "Ω 日本 halo"]
    docs = spark.createDataFrame([(k, f"r{k % 4}", t) for k, t in enumerate(texts)], "docId int, regionId string, text string")
    screening.counted(docs, ["docId", "regionId"], "text").write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")
    regions = spark.createDataFrame([(f"r{k}", f"r{k}", "core halo") for k in range(4)] + [("r9", "other", None)], "regionId string, name string, description string")
    members = words.where("docId % 7 > 0").replace("r3", "gone")  # so that some tokens are in no region, and a region is not listed
    given = words.select("docId", "words"), regions, members.select("regionId", "words")

    def keep(df):
        df.write.parquet(path := f"{tmp_path}/{len(list(tmp_path.iterdir()))}")
        return spark.read.schema(df.schema).parquet(path)

    def both():
        return sorted(map(tuple, screening.screen(*given, keep=keep).collect())), screening.repartition_advice(*given, keep=keep).collect()

    whole = both()
    assert calls == [["docId", "regionId"]] + 2 * [["regionId", "times"]]
    plain = docs.select("docId", "text"), regions, docs.where("docId % 7 > 0").replace("r3", "gone").select("regionId", "text")
    assert sorted(map(tuple, screening.screen(*plain).collect())) == whole[0]
    monkeypatch.setattr(screening, "is_small", lambda *a: False)
    for rows, slots in ((1, 2), (30, 9)):
        monkeypatch.setattr(screening, "COMMON_ROWS", rows)
        monkeypatch.setattr(screening, "SLOTS", slots)
        assert screening.common_level(screening.weights(screening.profiles(*given[1:]), regions, screening.numbered(*given[1:]))) is not None
        assert both() == whole
    assert len(whole[0]) == 3 * 42 and whole[1][0]["lowFit"] > 4 and "gone" in {r[2] for r in whole[0]}
