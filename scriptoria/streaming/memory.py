"""The memory ledger as a stream: state per project, with every event checked against it.

A small ledger is one value. Items and tasks of a longer one are map states, so an event reads and writes the few
entries that it names, however long the ledger is. An event that the state does not allow is an output row with a code; it and all later events of its project change
nothing, as a ledger with such an event cannot be read past it. An event that comes again is passed over.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ITEM = "type string, title string, content string, state string, evidenceState string, provenance string, createdRevision long, updatedRevision long, supersededBy string, contradictedBy array<string>"
TASK = "title string, state string, createdRevision long, updatedRevision long, content string"
#: What a batch puts out: the new row of a project, memory, task or handoff, or an error with its code.
CHANGES = f"projectId string, revision long, kind string, id string, {ITEM}, code string"
#: What a stream reads. memory is as memory_recorded has it; name and description belong to the project's events,
#: summary, resultSummary and memoryIds to tasks, handoffId to handoffs.
EVENTS = (
    "projectId string, revision long, eventId string, type string, name string, description string, memoryId string, reason string, taskHash string, summary string, resultSummary string, "
    "memoryIds array<string>, handoffId string, memory struct<memoryId: string, type: string, title: string, content: string, state: string, evidenceState: string, provenance: string, "
    "supersedes: array<string>, contradicts: array<string>, taskHash: string>"
)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Entries of a ledger, and characters of them as JSON, up to which they are kept in one value.
SMALL, SMALL_CHARS = 64, 1 << 16

_ITEM = [f.split()[0] for f in ITEM.split(", ")]
_TASK = [f.split()[0] for f in TASK.split(", ")]


class Illegal(Exception):
    """An event that the state does not allow, by its code."""


class Entries:
    """A map state's entries as a batch reads and changes them: each is fetched once, and kept once, at the end. If they are
    given as whole, these are all that there are, and none is fetched."""

    def __init__(self, state, fields: list[str], whole: dict | None = None):
        self.state, self.fields, self.known, self.changed, self.whole = state, fields, dict(whole or {}), {}, whole is not None

    def get(self, name: str) -> dict | None:
        if name not in self.known and self.whole:
            return None
        if name not in self.known:
            values = self.state.getValue((name,))
            self.known[name] = None if values is None else dict(zip(self.fields, values, strict=True))
        return self.known[name]

    def put(self, name: str, entry: dict) -> None:
        self.known[name] = self.changed[name] = entry

    def keep(self) -> None:
        """The changed entries, or all of them if they were given as whole, go to the map."""
        for name, entry in (self.known if self.whole else self.changed).items():
            self.state.updateValue((name,), tuple(entry[c] for c in self.fields))


class Ledger(StatefulProcessor):
    """One project's ledger. Up to SMALL entries and SMALL_CHARS characters they are part of the head, as JSON, so that a batch reads
    and writes one value a project, whatever its events are; beyond that they move to map states, for good."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "revision long, started long, title string, content string, failed string, entries string")
        self.states = (
            (handle.getMapState("events", "eventId string", "revision long"), ["revision"]),
            (handle.getMapState("memories", "memoryId string", ITEM), _ITEM),
            (handle.getMapState("tasks", "taskHash string", TASK), _TASK),
        )

    def _open(self) -> list:
        """Sets events, memories and tasks; gives the rest of the head."""
        *head, entries = self.head.get() or (0, None, None, None, None, "[[], [], []]")
        whole = [None] * 3 if entries is None else [{name: dict(zip(x[1], values, strict=True)) for name, values in part} for x, part in zip(self.states, json.loads(entries), strict=True)]
        self.events, self.memories, self.tasks = (Entries(*x, part) for x, part in zip(self.states, whole, strict=True))
        return head

    def _close(self, *head) -> None:
        every, entries = (self.events, self.memories, self.tasks), None
        if self.events.whole and sum(len(x.known) for x in every) <= SMALL:
            entries = json.dumps([[[name, [entry[c] for c in x.fields]] for name, entry in x.known.items()] for x in every])
        if entries is None or len(entries) > SMALL_CHARS:
            entries = None
            for x in every:
                x.keep()
        self.head.update((*head, entries))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        revision, started, title, content, failed = self._open()
        for e in sorted(rows, key=lambda r: (r["revision"], r["eventId"])):
            known = (self.events.get(e["eventId"]) or {}).get("revision")
            if known == e["revision"]:
                continue
            try:
                if failed:
                    raise Illegal("after_error")
                if known is not None:
                    raise Illegal("repeated_event_id")
                if e["revision"] != revision + 1:
                    raise Illegal("revision_gap")
                if (started is None) != (e["type"] == "project_initialized"):
                    raise Illegal("not_initialized" if started is None else "initialized_twice")
                if e["type"] in ("project_initialized", "project_metadata_updated"):
                    started = started or e["revision"]
                    title, content = e["name"] if e["name"] is not None else title, e["description"] if e["description"] is not None else content or ""
                    out = [self._row(key, e, "project", key[0], title=title, content=content, state="active", createdRevision=started, updatedRevision=e["revision"])]
                elif hasattr(self, f"_{e['type']}"):
                    out = list(getattr(self, f"_{e['type']}")(key, e))
                else:
                    raise Illegal("unknown_type")
                revision = e["revision"]
                self.events.put(e["eventId"], {"revision": revision})
                yield from out
            except Illegal as problem:
                failed = failed or str(problem)
                if known is None:
                    self.events.put(e["eventId"], {"revision": e["revision"]})
                yield self._row(key, e, "error", e["eventId"], code=str(problem))
        self._close(revision, started, title, content, failed)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Rows of a state that a batch has replayed: CHANGES of every memory and task, one of the project (whose revision
        is the ledger's), and one for each handoff and error."""
        r, head = initialState, self._open()
        if r["kind"] == "memory":
            self.memories.put(r["id"], {c: r[c] for c in _ITEM})
        elif r["kind"] == "task":
            self.tasks.put(r["id"], {c: r[c] for c in _TASK})
        elif r["kind"] == "project":
            head = [r["revision"], r["createdRevision"], r["title"], r["content"], head[4]]
        elif r["kind"] == "error":
            head[4] = r["code"]
        self._close(*head)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, e, kind: str, name: str, **values) -> Row:
        values.setdefault("contradictedBy", [])
        return Row(projectId=key[0], revision=e["revision"], kind=kind, id=name, **{c: values.get(c) for c in _ITEM}, code=values.get("code"))

    def _item(self, name: str) -> dict | None:
        item = self.memories.get(name)
        return None if item is None else dict(item)

    def _keep(self, key, e, name: str, item: dict) -> Row:
        self.memories.put(name, dict(item))
        return self._row(key, e, "memory", name, **item)

    def _memory_recorded(self, key, e) -> Iterator[Row]:
        m = e["memory"]
        if m is None or not m["memoryId"]:
            raise Illegal("no_memory")
        name, over, against = m["memoryId"], list(m["supersedes"] or []), list(m["contradicts"] or [])
        if self._item(name) is not None:
            raise Illegal("repeated_memory")
        if name in over + against:
            raise Illegal("self_relation")
        targets = {t: self._item(t) for t in over + against}
        if None in targets.values():
            raise Illegal("unknown_target")
        if any(targets[t]["state"] != "active" for t in over) or len(set(over)) < len(over):
            raise Illegal("target_not_active")
        if m["taskHash"] is not None and self.tasks.get(m["taskHash"]) is None:
            raise Illegal("unknown_task")
        at = e["revision"]
        item = {c: m[c] for c in ("type", "title", "content", "evidenceState", "provenance")}
        yield self._keep(key, e, name, item | {"state": m["state"] or "active", "createdRevision": at, "updatedRevision": at, "supersededBy": None, "contradictedBy": []})
        for t in over:
            targets[t] |= {"state": "superseded", "supersededBy": name, "updatedRevision": at}
        for t in against:
            targets[t] |= {"contradictedBy": [*dict.fromkeys([*targets[t]["contradictedBy"], name])], "updatedRevision": at}
        for t, item in targets.items():
            yield self._keep(key, e, t, item)

    def _memory_retired(self, key, e) -> Iterator[Row]:
        item = self._item(e["memoryId"])
        if item is None:
            raise Illegal("unknown_target")
        if item["state"] != "active":
            raise Illegal("target_not_active")
        yield self._keep(key, e, e["memoryId"], item | {"state": "retired", "updatedRevision": e["revision"]})

    def _task_started(self, key, e) -> Iterator[Row]:
        if self.tasks.get(e["taskHash"]) is not None:
            raise Illegal("repeated_task")
        yield self._task(key, e, title=e["summary"], state="active", createdRevision=e["revision"], updatedRevision=e["revision"], content=None)

    def _task_completed(self, key, e) -> Iterator[Row]:
        task = self.tasks.get(e["taskHash"])
        if task is None:
            raise Illegal("unknown_task")
        if task["state"] != "active":
            raise Illegal("task_not_active")
        if any(self._item(m) is None for m in e["memoryIds"] or []):
            raise Illegal("unknown_target")
        yield self._task(key, e, **task | {"state": "completed", "updatedRevision": e["revision"], "content": e["resultSummary"]})

    def _task(self, key, e, **task) -> Row:
        self.tasks.put(e["taskHash"], {c: task[c] for c in _TASK})
        return self._row(key, e, "task", e["taskHash"], **task)

    def _handoff_built(self, key, e) -> Iterator[Row]:
        if self.tasks.get(e["taskHash"]) is None:
            raise Illegal("unknown_task")
        yield self._row(key, e, "handoff", e["handoffId"], title=e["taskHash"], state="built", createdRevision=e["revision"], updatedRevision=e["revision"])


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started within keep their state in RocksDB, which map states and timers need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def changes(events: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """CHANGES of a stream of EVENTS, in revision order within a project and batch. initial has CHANGES rows of a replayed
    state, which the first batch starts from. Start it within rocksdb()."""
    start = initial.groupBy("projectId") if initial is not None else None
    return events.groupBy("projectId").transformWithState(Ledger(), CHANGES, "Append", "None", initialState=start)


def latest(rows: DataFrame) -> DataFrame:
    """Of CHANGES rows the last one of each project, memory, task, handoff and error. Of one revision's rows for an id,
    a relation's effect comes after the item's own row."""
    pick = [c for c in rows.columns if c not in ("projectId", "kind", "id")]
    last = rows.groupBy("projectId", "kind", "id").agg(F.max_by(F.struct(*pick), F.col("revision")).alias("r"))
    return last.select("projectId", "kind", "id", "r.*")
