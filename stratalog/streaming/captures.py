"""The capture of files as a stateful stream: thirteen states, with debounce, deferral, retries and forgetting by timers.

Events say what was seen or done with a path: `observed`, the outcome of a stable read, of an announcement, an upload
and its completion. One window of state a (host, path); a timer stands at what is due next: the end of a quiet time,
of a deferral, of a backoff, or of the time after which a finished capture is forgotten. Before an event is taken, what
was due by its time is done first, so the outcome doesn't depend on how events fall into micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: States, outcomes of a read that end a capture, and seconds.
STATES = (
    "OBSERVED", "DEBOUNCING", "OPENING", "COPYING_AND_HASHING", "HASHED", "ANNOUNCED", "DEDUP_HIT", "UPLOAD_REQUIRED", "UPLOADING", "FINALIZING", "OCCURRENCE_QUEUED", "COMPLETE", "GAP")
READ_GAPS = {"deleted": "DELETED_BEFORE_READ", "denied": "PERMISSION_DENIED", "too_large": "TOO_LARGE", "changed": "CHANGED_DURING_READ"}
QUIET, DEFER, FORGET, FIRST_BACKOFF, MOST_BACKOFF, MOST_ATTEMPTS = 2, 30, 86_400, 5, 300, 8
OUT = "host_name string, path string, at long, state string, outcome string, attempts int"


class Capture(NamedTuple):
    """state, attempts so far, what is due and when (epoch seconds; 0: nothing)."""

    state: str
    attempts: int
    due: int
    why: str


def backoff(attempts: int) -> int:
    return min(MOST_BACKOFF, FIRST_BACKOFF * 2 ** min(attempts, 20))


def _retry(c: Capture, at: int, most: int) -> tuple[Capture, list[tuple[str, str | None]]]:
    if c.attempts >= most:
        return Capture("GAP", c.attempts, at + FORGET, "forget"), [("GAP", "UPLOAD_FAILED")]
    return c._replace(attempts=c.attempts + 1, due=at + backoff(c.attempts), why="retry"), []


def _finish(c: Capture, at: int, *states: str) -> tuple[Capture, list[tuple[str, str | None]]]:
    return Capture("COMPLETE", c.attempts, at + FORGET, "forget"), [(s, None) for s in (*states, "OCCURRENCE_QUEUED", "COMPLETE")]


def on_event(c: Capture | None, event: str, at: int, most: int = MOST_ATTEMPTS) -> tuple[Capture | None, list[tuple[str, str | None]]]:
    """The capture after an event, and the (state, outcome) it went through. An event that doesn't fit its state changes nothing."""
    if event == "observed":
        if c is None or c.state in ("COMPLETE", "GAP"):
            return Capture("DEBOUNCING", 0, at + QUIET, "quiet"), [("OBSERVED", None), ("DEBOUNCING", None)]
        return (c._replace(due=at + QUIET), []) if c.state == "DEBOUNCING" else (c, [])
    if c is None:
        return None, []
    if c.state == "COPYING_AND_HASHING":
        if event == "hashed":
            return Capture("HASHED", c.attempts, 0, ""), [("HASHED", None)]
        if event in READ_GAPS:
            return Capture("GAP", c.attempts, at + FORGET, "forget"), [("GAP", READ_GAPS[event])]
        if event == "spool_full":
            return c._replace(due=at + DEFER, why="retry"), []
        if event == "io_error":
            return _retry(c, at, most)
    elif c.state == "HASHED":
        if event == "already_present":
            return _finish(c, at, "ANNOUNCED", "DEDUP_HIT")
        if event == "upload_required":
            return Capture("UPLOADING", c.attempts, 0, ""), [(s, None) for s in ("ANNOUNCED", "UPLOAD_REQUIRED", "UPLOADING")]
        if event.startswith("refused:"):
            return Capture("GAP", c.attempts, at + FORGET, "forget"), [("ANNOUNCED", None), ("GAP", event.partition(":")[2])]
        if event == "announce_failed":
            return _retry(c, at, most)
    elif c.state == "UPLOADING":
        if event == "uploaded":
            return Capture("FINALIZING", c.attempts, 0, ""), [("FINALIZING", None)]
        if event == "upload_failed":
            return _retry(c, at, most)
    elif c.state == "FINALIZING":
        if event == "finalized":
            return _finish(c, at)
        if event == "finalize_failed":
            return _retry(c, at, most)
    return c, []


def on_due(c: Capture) -> tuple[Capture | None, list[tuple[str, str | None]]]:
    """What happens when a capture's time has come: a quiet file is opened, a retry starts over where it can, an old one is forgotten."""
    if c.why == "quiet":
        return Capture("COPYING_AND_HASHING", c.attempts, 0, ""), [("OPENING", None), ("COPYING_AND_HASHING", None)]
    if c.why == "retry":
        # a hashed file is announced anew; one that wasn't read is read again
        again = "COPYING_AND_HASHING" if c.state == "COPYING_AND_HASHING" else "HASHED"
        return Capture(again, c.attempts, 0, ""), [(again, None)]
    return None, []


class CaptureMachine(StatefulProcessor):
    def __init__(self, most_attempts: int = MOST_ATTEMPTS):
        self.most = most_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.capture = handle.getValueState("capture", "state string, attempts int, due long, why string")

    def _stored(self) -> Capture | None:
        return Capture(*self.capture.get()) if self.capture.exists() else None

    def _store(self, before: Capture | None, after: Capture | None) -> None:
        old, new = (c.due if c else 0 for c in (before, after))
        if old and old != new:
            self.handle.deleteTimer(old * 1000)
        if new and old != new:
            self.handle.registerTimer(new * 1000)
        if after is None:
            self.capture.clear()
        elif after != before:
            self.capture.update(tuple(after))

    @staticmethod
    def _rows(key, at: int, c: Capture | None, steps) -> Iterator[Row]:
        for state, outcome in steps:
            yield Row(host_name=key[0], path=key[1], at=at, state=state, outcome=outcome, attempts=c.attempts if c else 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = c = self._stored()
        for r in sorted(rows, key=lambda r: (r.at, r.sequence)):
            while c and c.due and c.due <= r.at:
                at = c.due
                c, steps = on_due(c)
                yield from self._rows(key, at, c, steps)
            c, steps = on_event(c, r.event, r.at, self.most)
            yield from self._rows(key, r.at, c, steps)
        self._store(before, c)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = c = self._stored()
        now = timerValues.getCurrentWatermarkInMs()
        while c and c.due and c.due * 1000 <= now:
            at = c.due
            c, steps = on_due(c)
            yield from self._rows(key, at, c, steps)
        # the timer that expired is gone by itself
        self._store(before._replace(due=0) if before else None, c)


def captures(stream: DataFrame, *, late: str = "1 minute", most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """Transitions (host_name, path, at, state, outcome, attempts) of a stream (host_name, path, sequence, at: epoch seconds, event).

    Needs the RocksDB state store. Events may come late by `late`; later ones are dropped.
    """
    timed = stream.withColumn("event_time", F.timestamp_seconds("at")).withWatermark("event_time", late)
    return timed.groupBy("host_name", "path").transformWithState(CaptureMachine(most_attempts), OUT, "Append", "EventTime")
