"""Keyed tables that outlive replays and stops, the capture machine with a restart, counters and opinions."""

import random

import pytest
from pyspark.sql import functions as F

from stratalog.operators import analyst
from stratalog.sources.keyed import KeyedTable
from stratalog.streaming import captures

SCHEMA = "tenant_id string, artifact_id long, band long, value string"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_batch_counts_once(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["tenant_id", "artifact_id"], SCHEMA, buckets=4)
    assert table.read().count() == 0 and table.batches() == []
    first = spark.createDataFrame([("t", i, 0, "a") for i in range(20)], SCHEMA)
    assert table.write("b1", first) and not table.write("b1", first.withColumn("value", F.lit("z")))
    second = spark.createDataFrame([("t", 3, 0, "new"), ("t", 3, 1, "later"), ("u", 3, 0, "b")], SCHEMA)
    assert table.write("b2", second, order=[F.col("band")])
    want = [("t", i, 0, "new" if i == 3 else "a") for i in range(20)] + [("u", 3, 0, "b")]
    assert _rows(table.read()) == want
    assert table.write("b3", spark.createDataFrame([("t", 3, 9, "no"), ("t", 99, 9, "yes")], SCHEMA), mode="absent")
    assert _rows(table.read()) == sorted([*want, ("t", 99, 9, "yes")]) and table.batches() == ["b1", "b2", "b3"]
    assert table.write("b4", first.limit(0)) and len(_rows(table.read())) == 22


def test_a_batch_that_stops_half_way_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), ["tenant_id", "artifact_id"], SCHEMA, buckets=4)
    table.write("b1", spark.createDataFrame([("t", 1, 0, "a")], SCHEMA))

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(KeyedTable, "_commit", stop)
        table.write("b2", spark.createDataFrame([("t", 1, 0, "b"), ("t", 2, 0, "b")], SCHEMA))
    assert _rows(table.read()) == [("t", 1, 0, "a")]
    assert table.write("b2", spark.createDataFrame([("t", 1, 0, "b"), ("t", 2, 0, "b")], SCHEMA))
    assert _rows(table.read()) == [("t", 1, 0, "b"), ("t", 2, 0, "b")]


def test_an_index_is_replaced_by_artifact(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["tenant_id", "artifact_id", "band"], SCHEMA, buckets=4)
    by = ["tenant_id", "artifact_id"]
    table.write("b1", spark.createDataFrame([("t", a, b, "old") for a in range(5) for b in range(3)], SCHEMA), mode="replace", by=by)
    table.write("b2", spark.createDataFrame([("t", 2, 7, "new"), ("t", 9, 0, "new")], SCHEMA), mode="replace", by=by)
    assert _rows(table.read()) == sorted([("t", a, b, "old") for a in (0, 1, 3, 4) for b in range(3)] + [("t", 2, 7, "new"), ("t", 9, 0, "new")])
    with pytest.raises(ValueError):
        table.write("b3", spark.createDataFrame([("t", 1, 1, "x")], SCHEMA))


EVENTS = ("observed", "observed", "hashed", "hashed", "io_error", "spool_full", "deleted", "already_present", "upload_required", "refused:QUOTA", "announce_failed", "uploaded", "upload_failed", "finalized", "finalize_failed")


def _plain(events, until):
    """events (sequence, at, event) of one path, in order: all transitions up to a time."""
    c, out = None, []

    def due(limit):
        nonlocal c
        while c and c.due and c.due <= limit:
            at = c.due
            c, steps = captures.on_due(c)
            out.extend((at, *s, c.attempts if c else 0) for s in steps)

    for _, at, event in events:
        due(at)
        c, steps = captures.on_event(c, event, at, 2)
        out.extend((at, *s, c.attempts if c else 0) for s in steps)
    due(until)
    return out


def test_captures_with_a_restart_equal_a_plain_loop(spark, tmp_path):
    r, batches, log = random.Random(4), [], {}
    now = 1_700_000_000
    for _ in range(3):
        rows = []
        for _ in range(120):
            now += r.choice((0, 1, 1, 3, 20, 400))
            host, path = "h%d" % r.randrange(2), "p%d" % r.randrange(3)
            rows.append((host, path, len(rows), now, r.choice(EVENTS)))
            log.setdefault((host, path), []).append((len(rows), now, rows[-1][-1]))
        batches.append(rows)
    last = now + 10 * 86_400
    batches.append([("end", "end", 0, last, "observed")])
    schema = "host_name string, path string, sequence long, at long, event string"
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for i, rows in enumerate(batches):  # started anew for each
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
            q = captures.captures(stream, late="1 second", most_attempts=2).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = {}
    for x in spark.read.parquet(f"{tmp_path}/out").where("host_name <> 'end'").collect():
        got.setdefault((x.host_name, x.path), []).append((x.at, x.state, x.outcome, x.attempts))
    want = {k: _plain(v, last - 1) for k, v in log.items()}
    key = lambda x: tuple(map(str, x))
    assert {k: sorted(v, key=key) for k, v in got.items()} == {k: sorted(v, key=key) for k, v in want.items()}
    assert {s for v in want.values() for _, s, _, _ in v} == set(captures.STATES)


def test_jobs_count_under_their_hunts_tenant(spark):
    one = lambda s, rows: spark.createDataFrame(rows, s)
    t = one("tenant_id string", [("a",), (None,)])
    got = analyst.platform_metrics(
        artifact=one("tenant_id string, storage_state string", [("a", "committed"), ("a", "uploading")]), occurrence=t, hunt=one("hunt_id long, tenant_id string, state string", [(1, "a", "QUEUED"), (2, "b", "DRAFT")]),
        job=one("hunt_id long, finished_at long", [(1, None), (2, 5), (3, None)]), detection=t, bundle=one("tenant_id string, active boolean", [("a", True), ("b", False)]), agent=t, continuous=t)
    rows = {(r.everything, r.tenant_id): tuple(r[2:]) for r in got.collect()}
    assert rows == {(True, None): (1, 2, 2, 1, 1, 2, 1, 2, 2), (False, "a"): (1, 1, 1, 1, 1, 1, 1, 1, 1), (False, "b"): (0, 0, 1, 0, 0, 0, 0, 0, 0), (False, None): (0, 1, 0, 0, 0, 1, 0, 1, 1)}
