"""State that is written: pointers, staged snapshots, journals, streams and what they project, changes by revision."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from scriptoria.harness import state
from scriptoria.operators import revisions
from scriptoria.plans import memory as batch
from scriptoria.plans import hierarchy, packets
from scriptoria.sources import journal, pointers, projection, readers, snapshots, writers
from scriptoria.streaming import changes, memory


class Stopped(Exception):
    pass


def stop_at(step):
    def after(name):
        if name == step:
            raise Stopped(name)

    return after


# pointers


def test_dead_and_racing_writers_block_nobody(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(3)
    writers.commit(path, {"t": df}, None, "a")
    (tmp_path / "t" / "current" / "0000000002.json").write_text("")
    (tmp_path / "t" / "current" / "0000000003.json").write_text('{"fingerprint": "half')
    assert readers.published(spark, path)[:2] == (1, "a")
    writers.commit(path, {"t": df}, "a", "b")
    assert readers.published(spark, path)[:2] == (4, "b")
    writers.publish({"t": df}, path, "c")
    assert readers.published(spark, path)[:2] == (5, "c")
    # Two writers on one base, again and again: one wins each time, the other is told.
    for k in range(6):
        base, won, lost = readers.published(spark, path)[1], [], []

        def go(mark, base=base, won=won, lost=lost):
            try:
                writers.swap(spark, path, base, mark, "v")
                won.append(mark)
            except RuntimeError:
                lost.append(mark)

        racers = [threading.Thread(target=go, args=(f"{k}-{n}",)) for n in range(4)]
        [r.start() for r in racers], [r.join() for r in racers]
        assert len(won) == 1 and len(lost) == 3 and readers.published(spark, path)[1] == won[0]
    assert not [n for n in (tmp_path / "t" / "current").iterdir() if n.name.startswith(".") and not n.name.endswith(".crc")]


def test_create_once_is_whole_or_not_there(spark, tmp_path):
    at = f"{tmp_path}/x/0000000001.json"
    assert pointers.create_once(spark, at, "one") and not pointers.create_once(spark, at, "two")
    assert pointers.read_text(spark, at) == "one" and pointers.read_text(spark, at + "x") is None
    assert pointers.names(spark, f"{tmp_path}/nowhere") == []


def test_old_versions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    versions = [writers.publish({"t": spark.range(k)}, path, str(k)) for k in range(1, 5)]
    waiting = writers.stage({"t": spark.range(9)}, path)
    assert sorted(writers.prune(spark, path, 2)) == sorted(versions[:2])
    assert set(pointers.names(spark, path)) == {"current", waiting, *versions[2:]} and spark.read.parquet(f"{path}/{versions[3]}/t").count() == 4


# staged snapshots


def papers(spark, rows):
    return spark.createDataFrame(rows, "id long, title string")


def test_snapshots_are_staged_checked_and_promoted(spark, tmp_path):
    path = str(tmp_path / "s")
    first = snapshots.stage(spark, path, {"papers": papers(spark, [(1, "a"), (2, "b")])}, {"papers": "id"})
    assert readers.published(spark, path) is None and snapshots.pending(spark, path)["id"] == first
    with pytest.raises(RuntimeError, match="waits"):
        snapshots.stage(spark, path, {"papers": papers(spark, [(1, "a")])})
    assert snapshots.promote(spark, path) == first and snapshots.pending(spark, path) is None
    second = snapshots.stage(spark, path, {"papers": papers(spark, [(1, "a"), (2, "c"), (3, "d")])}, {"papers": "id"})
    assert {tuple(r) for r in snapshots.changes(spark, path, second, "papers").collect()} == {(2, "changed"), (3, "added")}
    assert snapshots.load(spark, path, "papers").count() == 2
    third = snapshots.stage(spark, path, {"papers": papers(spark, [(1, "z")])}, replace=True)
    assert snapshots.leftovers(spark, path) == [] and snapshots.promote(spark, path) == third
    snapshots.stage(spark, path, {"papers": papers(spark, [(7, "y")])})
    snapshots.withdraw(spark, path)
    assert snapshots.pending(spark, path) is None and snapshots.load(spark, path, "papers").first()["title"] == "z"


@pytest.mark.parametrize("harm", ["bytes", "rows", "gone", "extra", "manifest"])
def test_damaged_snapshots_are_not_promoted(spark, tmp_path, harm):
    path = str(tmp_path / "s")
    snapshots.stage(spark, path, {"papers": papers(spark, [(1, "old")])})
    snapshots.promote(spark, path)
    name = snapshots.stage(spark, path, {"papers": papers(spark, [(k, f"title {k}") for k in range(50)]).repartition(2)})
    folder = tmp_path / "s" / "staged" / name / "papers"
    part = sorted(folder.glob("part-*"))[0]
    if harm == "bytes":
        data = bytearray(part.read_bytes())
        data[len(data) // 2] ^= 255
        data[8] ^= 255
        part.write_bytes(data)
        (folder / f".{part.name}.crc").unlink()
    elif harm == "rows":
        other = tmp_path / "other"
        spark.read.parquet(str(part)).withColumn("title", F.upper("title")).coalesce(1).write.parquet(str(other))
        part.write_bytes(next(other.glob("part-*")).read_bytes())
        (folder / f".{part.name}.crc").unlink()
    elif harm == "gone":
        part.unlink()
    elif harm == "extra":
        papers(spark, [(99, "x")]).write.mode("append").parquet(str(folder))
    else:
        lines = next((tmp_path / "s" / "staged" / name / "manifest").glob("part-*"))
        lines.write_text(lines.read_text().splitlines()[0] + "\n")
        (lines.parent / f".{lines.name}.crc").unlink()
    with pytest.raises(snapshots.Damaged) as e:
        snapshots.promote(spark, path)
    assert {p[2] for p in e.value.problems} & {"missing", "changed", "unknown"}
    assert snapshots.load(spark, path, "papers").first()["title"] == "old" and snapshots.pending(spark, path)["id"] == name


def test_a_snapshot_of_an_older_version_is_stale(spark, tmp_path):
    path = str(tmp_path / "s")
    snapshots.stage(spark, path, {"papers": papers(spark, [(1, "a")])})
    writers.publish({"papers": papers(spark, [(5, "e")])}, path, "elsewhere")
    with pytest.raises(RuntimeError, match="current state"):
        snapshots.promote(spark, path)
    assert snapshots.load(spark, path, "papers").first()["id"] == 5


def test_a_promotion_that_died_is_settled(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    name = snapshots.stage(spark, path, {"papers": papers(spark, [(1, "a")])})
    monkeypatch.setattr(snapshots, "_settle", lambda *a: (_ for _ in ()).throw(Stopped()))
    with pytest.raises(Stopped):
        snapshots.promote(spark, path)
    monkeypatch.undo()
    assert snapshots.promote(spark, path) == name and snapshots.pending(spark, path) is None


# journal


def values(spark, root):
    return {n: None if df is None else sorted(r[0] for r in df.collect()) for n, df in journal.read(spark, root, ["cards", "index"]).items()}


STEPS = ["staged cards", "staged index", "planned", "installed cards", "installed index", "committed"]


@pytest.mark.parametrize("fresh", [True, False])
@pytest.mark.parametrize("damaged", [False, True])
@pytest.mark.parametrize("step", STEPS)
def test_adoption_stopped_anywhere_ends_in_one_of_two_states(spark, tmp_path, step, damaged, fresh):
    root = str(tmp_path / "r")
    old = {"cards": None, "index": None} if fresh else {"cards": [1], "index": [10]}
    if not fresh:
        journal.adopt(spark, root, {"cards": spark.createDataFrame([(1,)], "v int"), "index": spark.createDataFrame([(10,)], "v int")}, "first")
    new = {"cards": spark.createDataFrame([(1,), (2,)], "v int"), "index": spark.createDataFrame([(10,), (20,)], "v int")}
    with pytest.raises(Stopped):
        journal.adopt(spark, root, new, "second", stop_at(step))
    done = step == "committed"
    assert values(spark, root) == ({"cards": [1, 2], "index": [10, 20]} if done else old)
    if damaged and not done:
        for part in (tmp_path / "r" / "index").glob("v-*/rows/part-*"):
            if fresh or json.dumps(20) in json.dumps([r[0] for r in spark.read.parquet(str(part)).collect()]):
                part.unlink()
    settled = journal.recover(spark, root)
    forward = done or (not damaged and step in STEPS[2:])
    assert values(spark, root) == ({"cards": [1, 2], "index": [10, 20]} if forward else old)
    assert set(settled.values()) == (set() if done or step in STEPS[:2] else {"committed" if forward else "undone"})
    assert journal.recover(spark, root) == {}
    if forward:  # the same inputs are not adopted twice
        assert journal.adopt(spark, root, new, "second") == journal.begin(spark, root, new, "second")
    else:
        journal.adopt(spark, root, new, "third")
        assert values(spark, root) == {"cards": [1, 2], "index": [10, 20]}


def test_adoption_gives_way_to_another_writer(spark, tmp_path):
    root, one = str(tmp_path / "r"), spark.createDataFrame([(1,)], "v int")

    def other(step):
        if step == "installed cards":
            writers.publish({"rows": spark.createDataFrame([(7,)], "v int")}, f"{root}/index", "elsewhere")

    with pytest.raises(RuntimeError):
        journal.adopt(spark, root, {"cards": one, "index": one}, "a", other)
    assert values(spark, root) == {"cards": None, "index": [7]}


# streams


def test_stream_and_batch_replay_agree(spark, sf_dir):
    log = state.memory_log(spark, sf_dir)
    sound = log.where("not (cast(substring(projectId, 3) as long) % 5 = 0)")
    want = {tuple(r) for r in batch.items(sound).select("projectId", "memoryId", "state", "createdRevision", "updatedRevision", "supersededBy", F.array_join("contradictedBy", ",")).collect()}
    got = state.memory_stream(spark, sf_dir).where("kind = 'memory' and not (cast(substring(projectId, 3) as long) % 5 = 0)")
    assert {tuple(r) for r in got.select("projectId", "id", "state", "createdRevision", "updatedRevision", "supersededBy", "contradictedBy").collect()} == want and want


def event(project, revision, kind, **more):
    return {"projectId": project, "revision": revision, "eventId": more.pop("eventId", f"{project}-{revision}"), "type": kind, **more}


def item(name, supersedes=(), contradicts=(), task=None):
    return {"memoryId": name, "type": "finding", "title": name, "content": "", "state": "active", "evidenceState": "provisional", "provenance": "user", "supersedes": list(supersedes), "contradicts": list(contradicts), "taskHash": task}


def streamed(spark, tmp_path, batches, initial=None):
    rows = []
    for k, part in enumerate(batches):
        spark.createDataFrame(part, memory.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with memory.rocksdb(spark):
            stream = memory.changes(spark.readStream.schema(memory.EVENTS).parquet(f"{tmp_path}/in"), initial)
            projection.run_to(stream, f"{tmp_path}/ck", lambda df, b: rows.extend(df.collect()))
    return rows


def test_illegal_events_are_told_and_change_nothing(spark, tmp_path):
    begin = lambda p: event(p, 1, "project_initialized", name="n")
    record = lambda p, r, *a, **k: event(p, r, "memory_recorded", memory=item(*a, **k))
    cases = {
        "not_initialized": [record("a", 1, "m")], "initialized_twice": [begin("b"), event("b", 2, "project_initialized")], "revision_gap": [begin("c"), record("c", 3, "m")],
        "repeated_event_id": [begin("d"), record("d", 2, "m") | {"eventId": "d-1"}], "repeated_memory": [begin("e"), record("e", 2, "m"), record("e", 3, "m")], "unknown_target": [begin("f"), record("f", 2, "m", supersedes=["x"])],
        "self_relation": [begin("g"), record("g", 2, "m", contradicts=["m"])], "target_not_active": [begin("h"), record("h", 2, "m"), event("h", 3, "memory_retired", memoryId="m"), record("h", 4, "n", supersedes=["m"])],
        "unknown_task": [begin("i"), event("i", 2, "task_completed", taskHash="t")], "repeated_task": [begin("j"), event("j", 2, "task_started", taskHash="t"), event("j", 3, "task_started", taskHash="t")],
        "task_not_active": [begin("k"), event("k", 2, "task_started", taskHash="t"), event("k", 3, "task_completed", taskHash="t"), event("k", 4, "task_completed", taskHash="t")],
        "unknown_type": [begin("l"), event("l", 2, "memory_forgotten")], "no_memory": [begin("m"), event("m", 2, "memory_recorded")],
    }
    late = [event(e[-1]["projectId"], e[-1]["revision"] + 1, "project_metadata_updated", name="late") for e in cases.values()]
    everything = [e for events in cases.values() for e in events]
    rows = streamed(spark, tmp_path, [everything, late + everything[:3]])
    told = {(r["projectId"], r["code"]) for r in rows if r["kind"] == "error"}
    assert told == {(events[0]["projectId"], code) for code, events in cases.items()} | {(e["projectId"], "after_error") for e in late}
    assert not [r for r in rows if r["title"] == "late"]


def test_a_stream_starts_from_a_replayed_state(spark, tmp_path):
    first = [event("p", 1, "project_initialized", name="n"), event("p", 2, "task_started", taskHash="t", summary="s"), event("p", 3, "memory_recorded", memory=item("a"))]
    then = [event("p", 4, "memory_recorded", memory=item("b", ["a"], task="t")), event("p", 5, "task_completed", taskHash="t", memoryIds=["a"], resultSummary="done")]
    at_once = streamed(spark, tmp_path / "one", [first + then])
    replayed = spark.createDataFrame(streamed(spark, tmp_path / "two", [first]), memory.CHANGES)
    head = replayed.withColumn("revision", F.when(F.col("kind") == "project", F.lit(3).cast("long")).otherwise(F.col("revision")))
    rest = streamed(spark, tmp_path / "three", [then], memory.latest(head).select(*[f.split()[0] for f in memory.CHANGES.split(", ")]))
    assert [tuple(r) for r in rest] == [tuple(r) for r in at_once if r["revision"] > 3] and {r["kind"] for r in rest} == {"memory", "task"}


def test_projection_of_a_batch_twice_changes_nothing(spark, tmp_path):
    path, kind = str(tmp_path / "state"), "project string, id string, revision long, state string"
    put = lambda rows, batch: projection.project_batch(spark.createDataFrame(rows, kind), batch, path, "project", ["project", "id"])
    files = lambda p: {f.name for f in (tmp_path / "state" / f"project={p}").glob("*.parquet")}
    assert sorted(put([("a", "x", 1, "active"), ("b", "y", 1, "active"), ("a", "x", 2, "retired")], 0)) == ["a", "b"]
    before = files("a"), files("b")
    assert put([("a", "x", 1, "active"), ("b", "y", 1, "active"), ("a", "x", 2, "retired")], 0) == [] and (files("a"), files("b")) == before
    assert put([("a", "z", 3, "active")], 1) == ["a"] and files("b") == before[1] and files("a") != before[0]
    # A batch that failed between two parts does what is left.
    assert put([("a", "z", 4, "gone"), ("b", "y", 2, "gone")], 1) == ["b"]
    rows = {(r["project"], r["id"]): (r["revision"], r["state"]) for r in projection.projected(spark, path).collect()}
    assert rows == {("a", "x"): (2, "retired"), ("a", "z"): (3, "active"), ("b", "y"): (2, "gone")}
    log = str(tmp_path / "log")
    for batch in (0, 1, 0):
        projection.append_batch(spark.range(3), batch, log)
    assert spark.read.parquet(log).count() == 6


def test_a_burst_gives_one_row_a_key_and_a_restart_none(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, "key string, at long, value string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")

    def run(until, seconds=60):
        with memory.rocksdb(spark):
            stream = changes.coalesced(spark.readStream.schema("key string, at long, value string").json(f"{tmp_path}/in"), 300)
            query = stream.writeStream.outputMode("append").foreachBatch(lambda df, b: projection.append_batch(df, b, f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="200 milliseconds").start()
        began = time.time()
        while not until() and time.time() - began < seconds:
            time.sleep(0.3)
        query.stop()

    def told():
        try:
            return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("key", "at", "value", "changes").collect())
        except Exception:
            return []

    put([("a", k, f"v{k}") for k in range(20)] + [("b", 1, "x"), ("b", 1, "y")])
    once = [("a", 19, "v19", 20), ("b", 1, "y", 2)]
    run(lambda: len(told()) >= 2)
    assert told() == once
    began = time.time()
    run(lambda: time.time() - began > 5)
    assert told() == once
    put([("a", 30, "later")])
    run(lambda: len(told()) >= 3)
    assert told() == sorted([*once, ("a", 30, "later", 1)])


# changes by revision


def test_two_stale_writers_give_one_winner_and_a_named_conflict(spark):
    items = spark.createDataFrame([("i", "pending_codex", 3, None, "kept")], "id string, status string, revision long, paperId string, title string")
    kind = "commandId string, itemId string, at long, action string, revision long, disposition string, paperId string, refreshId string, reason string"
    commands = spark.createDataFrame([
        ("one", "i", 5, "begin", 3, None, None, None, None), ("two", "i", 6, "begin", 3, None, None, None, None), ("three", "i", 7, "mark", 4, "added", "p", "r", None), ("again", "i", 1, "begin", 5, None, None, None, None),
        ("old", "i", 1, "attention", 2, None, None, None, "why"), ("far", "i", 1, "attention", 9, None, None, None, "why"), ("who", "j", 1, "begin", 1, None, None, None, None), ("bad", "i", 1, "mark", 3, "added", None, "r", None), ("none", "i", 1, None, None, None, None, None, None),
    ], kind)
    after, verdicts = revisions.apply_commands(items, commands)
    assert tuple(after.first()) == ("i", "ready_to_refresh", 5, "p", "kept")
    assert {r["commandId"]: (r["verdict"], r["winner"]) for r in verdicts.collect()} == {
        "one": ("accepted", None), "two": ("conflict", "one"), "three": ("accepted", None), "again": ("illegal_status", None), "old": ("conflict", None), "far": ("conflict", None), "who": ("unknown_item", None), "bad": ("no_paper", None), "none": ("unknown_action", None),
    }


def test_every_verdict_is_reached(spark, sf_dir):
    found = {r["verdict"] for r in state.duplicate_verdicts(spark, sf_dir).select("verdict").distinct().collect()}
    assert found == {"valid", "stale", "conflict"}
    assert {r[0] for r in state.packets_pinned(spark, sf_dir).select("problem").distinct().collect()} >= {None, "kind", "source", "not_provisional", "not_pinned", "range", "splits_pair", "text"}
    assert {r[0] for r in state.queue_verdicts(spark, sf_dir).select("verdict").distinct().collect()} >= {"accepted", "conflict", "illegal_status", "no_reason", "no_refresh"}


def test_utf16_places(spark):
    texts = ["a😀b", "😀😀", "é日本", "x" * 9]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("u", packets.utf16(F.col("t")))
    for r in df.collect():
        units = r["t"].encode("utf-16-be")
        for start in range(len(units) // 2 + 1):
            row = df.where(F.col("t") == r["t"]).select(packets.splits_pair(F.col("u"), F.lit(start)).alias("s")).first()["s"]
            low = units[2 * start : 2 * start + 2]
            assert bool(row) == (len(low) == 2 and 0xDC <= low[0] <= 0xDF)
    row = df.where("t = 'a😀b'").select(packets.to_code_points(F.col("u"), F.lit(3)).alias("p"), packets.slice_utf16(F.col("u"), F.lit(1), F.lit(3)).alias("s")).first()
    assert row["p"] == 2 and row["s"] == "😀"


def test_packets_with_other_problems(spark):
    sha = lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()
    text, good = "the page", "rp2-anchor-" + "0" * 64
    base = {"candidateId": good, "docId": 1, "kind": "method", "page": 1, "sourceSha256": "s", "pageTextSha256": sha(text), "start": 0, "end": 3, "text": "the", "status": "provisional", "purpose": "routing_only", "verificationState": "unverified"}
    cases = {"id": {"candidateId": "x"}, "page_unknown": {"page": 9}, "page_changed": {"page": 2, "pageTextSha256": sha("before")}, "page_repeated": {"page": 3}, "text": {"text": ""}, "range": {"end": 99}, None: {"routingScore": 1}}
    rows = [{"routingScore": 0, **base, "candidateId": good[:-1] + str(k), **c} for k, c in enumerate(cases.values())]
    kind = "candidateId string, docId int, kind string, page int, sourceSha256 string, pageTextSha256 string, start int, end int, text string, status string, purpose string, verificationState string, routingScore int"
    pages = spark.createDataFrame([(1, 1, text), (1, 2, "after"), (1, 3, text)], "docId int, page int, text string")
    quality = spark.createDataFrame([(1, 1, sha(text)), (1, 2, sha("before")), (1, 3, sha(text)), (1, 3, sha(text))], "docId int, page int, pageTextSha256 string")
    found = packets.pinned(spark.createDataFrame(rows, kind), spark.createDataFrame([(1, "s")], "docId int, sourceSha256 string"), quality, pages)
    assert {r["candidateId"]: r["problem"] for r in found.collect()} == {r["candidateId"]: p for r, p in zip(rows, cases, strict=True)}
    assert [tuple(r) for r in packets.in_review_order(found).collect()] == [(1, good[:-1] + "6", 1)]


# places of clusters


def test_adding_a_cluster_moves_no_other(spark):
    regions = spark.createDataFrame([("r", [0.0, 0.0, 0.0]), ("s", [9.0, 1.0, 2.0])], "regionId string, center array<double>")
    seeds = lambda n: spark.createDataFrame([(r, f"c{k:02}") for r in "rs" for k in range(n)], "regionId string, clusterSeed string")
    at = lambda df: {(r["regionId"], r["clusterSeed"]): (r["ring"], r["slot"], tuple(r["position"] or ())) for r in df.collect()}
    whole = hierarchy.places(seeds(12), regions)
    placed = at(whole)
    assert {p[0] for p in placed.values()} == {0, 1} and len({p[2] for p in placed.values()}) == 24
    # Opposite slots first: the widest clearance on the inner ring.
    assert [placed["r", f"c{k:02}"][:2] for k in range(4)] == [(0, 0), (0, 2), (0, 1), (0, 3)]
    rest = whole.where("clusterSeed not in ('c01', 'c07')")
    again = at(hierarchy.places(seeds(12), regions, earlier=rest))
    assert all(again[k] == placed[k] for k in placed if k[1] not in ("c01", "c07")) and again["r", "c01"][:2] == (0, 2)
    members = spark.createDataFrame([(r, f"c{k:02}", f"p{r}{k}{j}") for r in "rs" for k in range(12) for j in range(7)], "regionId string, clusterSeed string, paperId string")
    papers = members.select("regionId", "paperId")
    assert {r["code"] for r in hierarchy.inspect(members, papers, whole, regions).collect()} <= {"too_many_clusters"}
    one = hierarchy.assignment_hash(members, whole).first()[0]
    assert one == hierarchy.assignment_hash(members.repartition(5), whole.repartition(3)).first()[0]
    moved = members.withColumn("clusterSeed", F.when(F.col("paperId") == "pr00", "c01").otherwise(F.col("clusterSeed")))
    assert hierarchy.assignment_hash(moved, whole).first()[0] != one and hierarchy.assignment_hash(members, hierarchy.places(seeds(12), regions, "other")).first()[0] != one


def test_a_full_region_has_no_place_left(spark):
    regions = spark.createDataFrame([("r", [0.0, 0.0, 0.0])], "regionId string, center array<double>")
    seeds = spark.createDataFrame([("r", f"c{k:02}") for k in range(13)], "regionId string, clusterSeed string")
    rows = hierarchy.places(seeds, regions).collect()
    assert len(rows) == 13 and [r["clusterSeed"] for r in rows if r["position"] is None] == ["c12"]
    # An earlier place off the rings stays, and others keep clear of it.
    odd = spark.createDataFrame([("r", "c05", [1.72, 0.1, 0.0])], "regionId string, clusterSeed string, position array<double>")
    kept = {r["clusterSeed"]: r["position"] for r in hierarchy.places(seeds.limit(6), regions, earlier=odd).collect()}
    assert kept["c05"] == [1.72, 0.1, 0.0] and all(sum((a - b) ** 2 for a, b in zip(kept["c05"], p, strict=True)) > 0.9 for k, p in kept.items() if k != "c05" and p)
