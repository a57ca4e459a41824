"""Streaming forms give what a batch gives."""

import json
import struct

import pandas as pd
from pyspark.sql import functions as F

from stratalog.streaming import journal, streams

ROWS = [("t", "a", "b", n % 5, n, "2024-01-01 00:00:%02d" % n) for n in range(10)]
SCHEMA = "tenant_id string, agent_id string, boot_id string, agent_sequence long, artifact_id long, received_at string"


def _stream(spark, folder, rows, schema):
    for k in range(2):
        spark.createDataFrame(rows[k::2], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def _drain(df, mode, name, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_ledger_once(spark, tmp_path):
    stream = _stream(spark, tmp_path / "in", ROWS, SCHEMA)
    assert _drain(streams.ledger_once(stream), "append", "once", tmp_path).count() == 5


def test_late_minima(spark, tmp_path):
    rows = [("t", 1, 50), ("t", 1, 20), ("t", 1, 5), ("t", 2, 7)]
    stream = _stream(spark, tmp_path / "in", rows, "tenant_id string, artifact_id long, observed_at long")
    got = {r.artifact_id: (r.first_observed, r.last_observed) for r in _drain(streams.sightings(stream), "complete", "late", tmp_path).collect()}
    assert got == {1: (5, 50), 2: (7, 7)}


def test_forward_scan_is_replay_safe(spark, tmp_path):
    stream = _stream(spark, tmp_path / "in", ROWS, SCHEMA)
    for _ in range(2):
        streams.start_forward(stream, lambda df: df.where("artifact_id % 2 = 0"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_segment_replay(spark, tmp_path):
    rows = [("t", "h", "a.jsonl.gz", '{"event_id":"e%d","ts":%d.5}' % (n % 3, n)) for n in range(6)]
    stream = _stream(spark, tmp_path / "in", rows, "tenant_id string, host_name string, segment string, event string")
    assert _drain(streams.segment_events(stream), "append", "segments", tmp_path).count() == 3
    twice = spark.createDataFrame([("t", "h", "a", "1"), ("t", "h", "a", "2"), ("t", "h", "b", "1")], "tenant_id string, host_name string, segment string, segment_sha256 string")
    assert [r.segment for r in streams.conflicting_segments(twice).collect()] == ["a"]


def test_outbox(spark, tmp_path):
    stream = _stream(spark, tmp_path / "in", [(n, 0) for n in range(6)], "outbox_id long, attempts int")
    streams.start_outbox(stream, lambda df: df.withColumn("delivered", F.col("outbox_id") % 2 == 0), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert {(r.outbox_id % 2, r.attempts) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(0, 0), (1, 1)}


def test_capture_steps():
    class State:
        exists, kept = False, None

        def update(self, x):
            self.kept = x

    batch = pd.DataFrame({"sequence": [3, 1, 2], "event": ["uploaded", "stable", "wanted"]})
    assert next(streams._advance(("h", "p"), iter([batch]), State())).iloc[0]["state"] == "DONE"


def _records(numbers):
    out = b""
    for n in numbers:
        name = f"f{n}".encode("utf-16-le")
        out += struct.pack("<IHHQQqqIIIIHH", 60 + len(name), 2, 0, n, 1, n, 0, 0x100, 0, 0, 0, len(name), 60) + name
    return out


def test_a_restart_goes_on_at_the_next_number_of_the_journal(spark, tmp_path):
    journal.register(spark)
    folder = tmp_path / "journal"
    folder.mkdir()

    def state(name, first, last):
        (folder / "state.json").write_text(json.dumps({"journal": name, "first": first, "next": last}))

    def add(name, first, last):
        (folder / f"{name}_{first}-{last}.usn").write_bytes(_records(range(first, last)))

    def run():
        q = spark.readStream.format("change_journal").option("from", "first").load(str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.kind, r.journal, r.usn, r.file_name) for r in spark.read.parquet(str(tmp_path / "out")).collect()) if q.exception() is None else None

    add(7, 10, 15), state(7, 10, 15)
    seen = [("record", 7, n, f"f{n}") for n in range(10, 15)]
    assert run() == seen
    assert run() == seen  # nothing new
    add(7, 15, 40), add(7, 40, 42), state(7, 10, 41)  # the last record isn't finished
    seen += [("record", 7, n, f"f{n}") for n in range(15, 41)]
    assert run() == seen
    add(8, 5, 9), state(8, 5, 9)  # made anew: nothing of it is read, all files are to be looked at
    seen += [("reconcile", 8, 9, None)]
    assert run() == sorted(seen)
    add(8, 9, 12), state(8, 5, 12)
    seen += [("record", 8, n, f"f{n}") for n in range(9, 12)]
    assert run() == sorted(seen)
    (folder / "8_9-12.usn").unlink(), add(8, 30, 33), state(8, 30, 33)  # what the cursor asks for is gone
    assert run() == sorted([*seen, ("reconcile", 8, 33, None)])
