"""Inputs on which queries differed from their SQL, and joins that pairs of a shared value must not pass through."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from scriptoria import registry
from scriptoria.llm import shared, simhash
from scriptoria.operators import joins
from scriptoria.streaming import memory


def test_queue_after_has_a_row_for_each_line_of_the_last_command(spark, tmp_path):
    con = duckdb.connect()
    con.sql("create table orders as select * from '/root/testdata/sf0.001/orders.parquet' where o_orderstatus = 'O' limit 5")
    con.sql("create table lineitem as select l.* from '/root/testdata/sf0.001/lineitem.parquet' l join orders on l_orderkey = o_orderkey where l_linenumber <= 1")
    con.sql("insert into lineitem select * replace (l_shipdate + interval 1 day as l_shipdate) from lineitem where l_orderkey = (select min(l_orderkey) from lineitem)")
    for t in ("orders", "lineitem"):
        con.sql(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    want = con.sql(registry.oracle_sql()["queue_after"]).fetchall()
    got = [tuple(r) for r in registry.queries()["queue_after"](spark, str(tmp_path)).collect()]
    assert len(want) == 6 and sorted(map(str, got)) == sorted(map(str, want))


def test_first_duplicate_of_a_value_that_all_share(spark):
    rows = [(k, k % 7, f"h{k % 50}", "one title") for k in range(20_000)]
    papers = spark.createDataFrame(rows + [(3, 9, "other", None)], "paperId long, place long, sha string, title string")
    new = spark.createDataFrame([*((k, f"h{k}", "one title") for k in range(20_000)), (-1, "h8", None), (-2, "none", "none"), (-3, None, None)], "id long, sha string, title string")
    # All pairs would be 4 * 10^8 rows.
    got = {r["id"]: (r["paperId"], r["matchedBy"]) for r in joins.first_duplicate(new, papers, {"sha256": "sha", "title": "title"}, "place").collect()}
    assert got[0] == (0, ["sha256", "title"]) and got[5] == (0, ["title"]) and got[-1] == (308, ["sha256"]) and len(got) == 20_001


def test_creators_of_a_list_are_joined_once(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = (
        df([(1, "w1"), (2, "w2"), (11, "a1"), (12, "a2")], "itemID long, key string"), df([(11, 1, "application/pdf"), (12, 2, "application/pdf")], "itemID long, parentItemID long, contentType string"),
        df([], "itemID long, fieldID int, valueID string"), df([], "valueID string, value string"), df([(1, "title")], "fieldID int, fieldName string"),
        df([(7, 2, 1, 0), (7, 1, 1, 1)], "itemID long, creatorID long, creatorTypeID int, orderIndex int"), df([(1, "A", "B"), (2, None, "C")], "creatorID long, firstName string, lastName string"),
        df([(1, "author")], "creatorTypeID int, creatorType string"), df([], "itemID long"),
    )
    out = joins.catalog_discovery(*tables, credits=df([(1, 7)], "itemID long, listID long"), joined=lambda n: F.array_join(n, ";"))
    assert [(r["attachmentKey"], r["authors"]) for r in out.collect()] == [("a1", "C;A B"), ("a2", None)]


def test_near_copies_come_through_their_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in rng.integers(0, 5000, 300)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(f"v{k}" for k in range(200))), (4, None)], "doc_id long, text string")
    # Without the join that completes them.
    monkeypatch.setattr(simhash, "_candidates", lambda tokens, similarity: spark.createDataFrame([], "cell long, key long, n int"))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_bitmaps_rule_out_no_similar_pair():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**32, size, dtype=np.uint32)) for size in (40, 45, 300, 320, 1100) for _ in range(3)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * 0.9)], rng.integers(0, 2**32, len(s) // 20, dtype=np.uint32)])) for s in sets]
    n, label = np.array([len(s) for s in sets]), np.arange(len(sets))
    label[15:18] = label[:3]
    may, pairs = simhash.apart(n, label, [simhash.bitmap(s, simhash.bitmap_words(len(s))) for s in sets], 0.8)
    like = [(i, j) for i in range(len(sets)) for j in range(i) if label[i] != label[j] and simhash.jaccard(sets[i], sets[j]) >= 0.8]
    assert len(like) >= 12 and all(may[i] and may[j] for i, j in like) and not may.all()
    assert {tuple(sorted(p)) for p in pairs} >= {(j, i) for i, j in like if i - j == 15}


def test_a_small_set_does_not_coarsen_the_bitmaps_of_large_ones():
    rng = np.random.default_rng(8)
    x, y = (rng.integers(0, 2**32, 2000, dtype=np.uint32) for _ in range(2))
    sets = [np.unique(s) for s in (x[:30], x, np.concatenate([x[:1400], y[:600]]))]
    may, pairs = simhash.apart(np.array([len(s) for s in sets]), np.arange(3), [simhash.bitmap(s, simhash.bitmap_words(len(s))) for s in sets], 0.8)
    assert not may.any() and not pairs


def test_near_dedup_leaves_no_tokens_behind_and_shuffles_no_equal_rows(spark, tmp_path, monkeypatch):
    texts = [(k, " ".join(f"w{(k % 5) * 1000 + j}" for j in range(60))) for k in range(40)]
    docs = spark.createDataFrame([*texts, *texts], "doc_id long, text string").repartition(4)
    monkeypatch.setattr(shared, "shared_folder", lambda spark: f"file://{tmp_path}")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.similar_documents(docs).collect()}
    assert got == {(k, k % 5) for k in range(40)}
    left = {p.name.split("-")[0] for p in tmp_path.iterdir()}
    assert "classes" in left and not left & {"prefixes", "heads", "sets", "candidates", "compared"}


class Kept:
    """Stands for value and map states; counts the calls."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return Kept()

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def getValue(self, key):
        self.calls += 1
        return self.map.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value


def test_a_small_ledger_is_one_value_and_a_long_one_moves_to_maps():
    def event(k: int) -> dict:
        item = {"memoryId": f"m{k}", "type": "finding", "title": "t", "content": "c", "state": None, "evidenceState": "e", "provenance": "p", "supersedes": [f"m{k - 1}"] if k > 2 else [], "contradicts": None, "taskHash": None}
        return {"revision": k, "eventId": f"e{k}", "type": "project_initialized" if k == 1 else "memory_recorded", "name": "n", "description": None, "memory": item}

    def run(cuts: list[int]) -> tuple:
        ledger, rows, calls = memory.Ledger(), [], []
        ledger.init(head := Kept())
        for low, high in zip([1, *cuts], [*cuts, 101], strict=True):
            before = head.calls + sum(x.calls for x, _ in ledger.states)
            rows += ledger.handleInputRows(("p",), [event(k) for k in range(low, high)], None)
            calls.append(head.calls + sum(x.calls for x, _ in ledger.states) - before)
        return rows, calls, ledger

    (rows, calls, ledger), (once, _, _) = run([9, 20, 60]), run([])
    assert rows == once and len(rows) == 1 + 99 + 98 and not any(r["code"] for r in rows)
    assert calls[:2] == [2, 2] and len(ledger.states[0][0].map) == 100 and len(ledger.states[1][0].map) == 99
    again = list(ledger.handleInputRows(("p",), [event(5), event(101)], None))
    assert [(r["id"], r["state"]) for r in again] == [("m101", "active"), ("m100", "superseded")]
