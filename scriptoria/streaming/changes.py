"""Bursts of changes as one: a key is told once it has been quiet for a while."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class Quiet(StatefulProcessor):
    """Keeps a key's last change and how many there were, until no other has come for `wait` milliseconds."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "at long, value string, changes long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at, value, count, due = self.held.get() if self.held.exists() else (None, None, 0, None)
        for r in rows:
            count += 1
            if at is None or (r["at"], r["value"]) >= (at, value):
                at, value = r["at"], r["value"]
        if due is not None:
            self.handle.deleteTimer(due)
        due = timerValues.getCurrentProcessingTimeInMs() + self.wait
        self.handle.registerTimer(due)
        self.held.update((at, value, count, due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.held.exists():
            at, value, count, _ = self.held.get()
            self.held.clear()
            yield Row(key=key[0], at=at, value=value, changes=count)

    def close(self) -> None:
        pass


def coalesced(stream: DataFrame, wait_ms: int = 350) -> DataFrame:
    """(key, at, value, changes) once a burst of (key string, at long, value string) is over: its last change by at, ties
    by the greater value, and how many it had. Timers fire as batches pass, so the trigger must go on; start it within
    memory.rocksdb()."""
    return stream.groupBy("key").transformWithState(Quiet(wait_ms), "key string, at long, value string, changes long", "Append", "ProcessingTime")
