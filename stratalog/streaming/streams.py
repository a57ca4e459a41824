"""Structured Streaming forms: replay-safe ledger, forward scans, segment replay, outbox, debounce, late minima."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratalog.operators import events

LEDGER_KEY = ["tenant_id", "agent_id", "boot_id", "agent_sequence"]


def ledger_once(stream: DataFrame, *, within: str | None = None, event_time: str = "received_at") -> DataFrame:
    """Each (tenant, agent, boot, sequence) once.

    Without `within` the state keeps every key for ever, as back-dated events are
    legal; with it, a watermark on the time of receipt bounds the state.
    """
    if within is None:
        return stream.dropDuplicates(LEDGER_KEY)
    return stream.withWatermark(event_time, within).dropDuplicatesWithinWatermark(LEDGER_KEY)


def sightings(stream: DataFrame) -> DataFrame:
    """First and last time of each artifact, however late an event comes: for update or complete mode."""
    return stream.groupBy("tenant_id", "artifact_id").agg(F.min("observed_at").alias("first_observed"), F.max("observed_at").alias("last_observed"), F.count("*").alias("occurrences"))


def start_forward(stream: DataFrame, scan: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, *, key: tuple[str, ...] = ("tenant_id", "artifact_id")):
    """Scans each micro-batch's new artifacts and writes matches under its batch number, so a replay overwrites itself."""

    def batch(df: DataFrame, number: int) -> None:
        scan(df.dropDuplicates(list(key))).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def segment_events(stream: DataFrame) -> DataFrame:
    """Telemetry events, each (tenant, host, event id) once."""
    known = stream.select("tenant_id", "host_name", "segment", events.telemetry_identity(F.col("event")).alias("e")).select("tenant_id", "host_name", "segment", "e.*")
    return known.where("event_id IS NOT NULL").dropDuplicates(["tenant_id", "host_name", "event_id"])


def conflicting_segments(segments: DataFrame) -> DataFrame:
    """Segments sent again with another digest: to be refused."""
    return segments.groupBy("tenant_id", "host_name", "segment").agg(F.countDistinct("segment_sha256").alias("digests")).where("digests > 1")


def start_outbox(stream: DataFrame, send: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """At-least-once delivery: send returns its batch with `delivered`; what failed is written with its next try."""

    def batch(df: DataFrame, number: int) -> None:
        tried = send(df)
        state = tried.withColumn("attempts", F.col("attempts") + (~F.col("delivered")).cast("int"))
        state.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def debounce(stream: DataFrame, quiet: str, *, key: tuple[str, ...] = ("host_name", "path"), at: str = "observed_at") -> DataFrame:
    """One row for each burst of events of a key: a burst ends after a quiet time. Needs a watermark on `at`."""
    return stream.groupBy(*key, F.session_window(at, quiet).alias("burst")).agg(F.count("*").alias("events"), F.min("priority").alias("priority")).select(
        *key, F.col("burst.end").alias("ready_at"), "events", "priority")


#: A reduced capture machine: how a capture goes on, by what happened.
CAPTURE_STEPS = {
    ("PENDING", "stable"): "HASHED", ("PENDING", "changed"): "PENDING", ("PENDING", "deleted"): "GAP", ("PENDING", "denied"): "GAP", ("PENDING", "too_large"): "GAP",
    ("HASHED", "known"): "DONE", ("HASHED", "wanted"): "UPLOADING", ("UPLOADING", "uploaded"): "DONE", ("UPLOADING", "failed"): "PENDING",
}
MOST_ATTEMPTS = 8
_CAPTURE = "host_name string, path string, state string, attempts int"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, attempts = state.get if state.exists else ("PENDING", 0)
    for rows in batches:
        for what in rows.sort_values("sequence")["event"]:
            after = CAPTURE_STEPS.get((now, what), now)
            attempts += int(after == "PENDING")
            now = "GAP" if after == "PENDING" and attempts >= MOST_ATTEMPTS else after
    state.update((now, attempts))
    yield pd.DataFrame([{"host_name": key[0], "path": key[1], "state": now, "attempts": attempts}])


def captures(stream: DataFrame) -> DataFrame:
    """State of each (host, path) after its events (sequence, event): for update mode. State is one small row a key."""
    return stream.groupBy("host_name", "path").applyInPandasWithState(_advance, _CAPTURE, "state string, attempts int", "update", GroupStateTimeout.NoTimeout)
