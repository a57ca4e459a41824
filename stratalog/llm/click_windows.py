"""Expiring click deduplication: a stateful stream that keeps one window of 24 hours an id.

Copies of the clicks are cut into batches and fed in order to a query with `transformWithState`. State lies in hashed
buckets of ids: one map from ids to their open windows, and a timing wheel beside it, a second map from a deadline's
hour to the ids whose windows end then. One timer a bucket stands at the wheel's first deadline; when the watermark
passes it, every slot that is due is drained. The watermark of a batch shows from the next one on: there, windows that
its rows would meet and that are over are closed first, and the timer closes the others. The last batch carries a mark
after all hours and gets a turn without rows. A call of the state takes about a millisecond in Python, so an entry of
the first map is a page: the windows of a hashed part of a bucket's ids, as records.

A bucket's own rows bound the next watermark from below, so a window which they show to be over is given out at once
and never enters the state. A click's copies of one batch travel as one row. What grows with the input stays in tasks:
the driver learns the least and the largest label, the number of copies and the last hour.

Rows without an arrival time have no hour and take no part. A null id is an id like any other, with one copy; negative
ids have as many copies as their non-negative remainder says. A value that isn't finite, or too large for 64 bits,
counts as null. Extra columns play no part, an empty table gives no windows, and equal rows are repeats. Arrival is
expected after 1970, as a stream's watermark starts there. An id's copies of one batch meet in one task, as records of
45 bytes, since each may depend on the one before it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stratalog.llm.common import ragged, read, shared_dir

BATCHES, SPAN, LATE = 8, 24, 96
HOUR_MS = 3_600_000
#: Copies of a batch that a bucket should get; more copies, more buckets.
BUCKET_COPIES, LEAST_BUCKETS = 32_768, 16
#: Pages of windows in a bucket, and windows in a row of the stream's output.
PAGES, OUT_WINDOWS = 8, 65_536
FED = "bucket int, last int, copies binary"
OUT = "click_id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash string"
#: A copy, as the JVM writes it, most significant byte first.
RECORD = np.dtype([("id", ">i8"), ("null", "u1"), ("hour", ">i4"), ("hash", ">u8", 4)])
WINDOW = np.dtype([("id", "i8"), ("null", "u1"), ("start", "i4"), ("repeats", "i8"), ("conflicts", "i8"), ("crc", "i8"), ("hash", "u8", 4)])
ID = np.dtype([("id", "i8"), ("null", "u1")])
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # else each start leaves its stores, with some 5 MB of files a partition, until they are missed
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def _micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is taken as UTC."""
    c = F.col(name)
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    seconds = F.unix_date(c.cast("date")).cast("long") * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.expr(f"extract(SECOND FROM `{name}`)") * 1_000_000).cast("long")


def _copy(df: DataFrame, j: int) -> tuple[Column, Column, Column]:
    """Copy j of a row of df: its hour, its label, and its record as bytes: id, whether null, hour, hash."""
    c = F.crc32(F.concat(F.coalesce(F.col("click_id").cast("string"), F.lit("")), F.lit(f":{j}")).cast("binary"))
    hour = F.col("at") + 6 * j * (c % 10)
    text = F.concat_ws("|", *(f"t{i}" for i in range(5)), (c % 3).cast("string"))
    numbers = F.concat(
        F.lpad(F.hex(F.coalesce("click_id", F.lit(0).cast("long"))), 16, "0"), F.when(F.col("click_id").isNull(), "01").otherwise("00"), F.lpad(F.hex(hour), 8, "0"))
    return hour, hour + F.floor(c / 10) % 200, F.unhex(F.concat(numbers, F.sha2(text, 256)))


def _prepared(clicks: DataFrame) -> DataFrame:
    number = F.nanvl(100 * F.col("value").cast("double") + 0.5, F.lit(float("inf")))
    texts = (
        F.col("client_id").cast("string"), F.col("kind"), F.when(F.abs(number) < 2.0**63, F.floor(number)).cast("string"),
        _micros(clicks, "ts").cast("string"), F.col("props"))
    return clicks.where(F.col("arrived_at").isNotNull()).select(
        F.col("click_id").cast("long"), F.floor(_micros(clicks, "arrived_at") / F.lit(3_600_000_000)).alias("at"),
        F.coalesce(F.pmod("click_id", F.lit(3)), F.lit(0)).alias("more"), *(F.coalesce(c, F.lit("")).alias(f"t{i}") for i, c in enumerate(texts)))


def _ordered(records: np.ndarray) -> np.ndarray:
    h = records["hash"]
    return records[np.lexsort((h[:, 3], h[:, 2], h[:, 1], h[:, 0], records["hour"], records["id"], records["null"]))]


def _heads(x: np.ndarray) -> np.ndarray:
    """Where the ids of a sorted array begin."""
    new = np.ones(len(x), bool)
    new[1:] = (x["id"][1:] != x["id"][:-1]) | (x["null"][1:] != x["null"][:-1])
    return np.flatnonzero(new)


def _find(ids: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each of ids the place of its window, or -1; windows have different ids."""
    if not len(windows):
        return np.full(len(ids), -1)
    order = np.lexsort((windows["id"], windows["null"]))
    # nulls stand last, and their id is zero
    real = windows["id"][order][: len(windows) - int(windows["null"].sum())]
    at = np.minimum(np.searchsorted(real, ids["id"]), max(len(real) - 1, 0))
    hit = (real[at] == ids["id"]) if len(real) else np.zeros(len(ids), bool)
    found = np.where(hit & (ids["null"] == 0), order[at], -1)
    return np.where((ids["null"] == 1) & (windows["null"].sum() > 0), order[-1], found)


def fold(records: np.ndarray, standing: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A batch's records against the windows that stand open: (closed windows, open windows of the ids that came, their places in standing)."""
    records = _ordered(records)
    head = _heads(records)
    ends = np.append(head[1:], len(records))
    hour = records["hour"].astype(np.int64)
    group = np.repeat(np.arange(len(head)), ends - head)
    low, width = int(hour.min()), int(hour.max() - hour.min()) + 2
    place = group * width + (hour - low)  # sorted, as records are
    known = _find(records[head], standing)
    made: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    window_of = np.empty(len(records), np.int64)
    opener = np.zeros(len(records), bool)
    at, live, first = head.copy(), np.arange(len(head)), True
    total = 0
    while len(live):
        w = np.zeros(len(live), WINDOW)
        old = known[live] >= 0 if first else np.zeros(len(live), bool)
        fresh = records[at[live]]
        for f in ("id", "null", "hash"):
            w[f] = fresh[f]
        w["start"] = fresh["hour"]
        w[old] = standing[known[live][old]]
        stop = np.searchsorted(place, live * width + np.clip(w["start"].astype(np.int64) + SPAN + 1 - low, 0, width - 1))
        stop = np.clip(stop, at[live], ends[live])
        opener[at[live][~old]] = True
        window_of[ragged(at[live], stop - at[live])] = np.repeat(np.arange(total, total + len(live)), stop - at[live])
        made.append(w)
        owner.append(live)
        total += len(live)
        at[live] = stop
        live, first = live[stop < ends[live]], False
    windows, owners = np.concatenate(made), np.concatenate(owner)
    repeat = np.flatnonzero(~opener)
    np.add.at(windows["repeats"], window_of[repeat], 1)
    odd = repeat[(records["hash"][repeat] != windows["hash"][window_of[repeat]]).any(axis=1)]
    np.add.at(windows["conflicts"], window_of[odd], 1)
    digests = records["hash"][odd].astype(">u8").tobytes()
    np.add.at(windows["crc"], window_of[odd], np.array([zlib.crc32(digests[i : i + 32].hex().encode()) for i in range(0, len(digests), 32)], np.int64))
    last = np.zeros(len(head), np.int64)
    last[owners] = np.arange(total)  # a group's windows were made in order
    is_open = np.zeros(total, bool)
    is_open[last] = True
    return windows[~is_open], windows[last], known[known >= 0]


class ClickWindows(StatefulProcessor):
    """Windows of a bucket of ids, as records of WINDOW in pages."""

    def __init__(self, batch: int, before: int, end: int, pages: int = PAGES):
        """before: the last batch that had rows. end: the hour at which a watermark tells that there are no more batches."""
        self.batch, self.before, self.end, self.pages = batch, before, end, pages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "page int", "windows binary")
        self.wheel = handle.getMapState("wheel", "deadline int", "ids binary")

    def _page(self, x: np.ndarray) -> np.ndarray:
        return (((x["id"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(self.pages)).astype(np.int64)

    @staticmethod
    def _rows(closed: np.ndarray, batch: int) -> Iterator[Row]:
        for i in range(0, len(closed), OUT_WINDOWS):
            yield Row(closed_batch=batch, windows=closed[i : i + OUT_WINDOWS].tobytes())

    def _load(self, pages: np.ndarray) -> np.ndarray:
        held = [self.windows.getValue((p,)) for p in pages.tolist()]
        return np.concatenate([np.zeros(0, WINDOW), *(np.frombuffer(v[0], WINDOW) for v in held if v is not None)])

    def _save(self, pages: np.ndarray, windows: np.ndarray) -> None:
        """Gives these pages these windows."""
        of = self._page(windows)
        for p in pages.tolist():
            if (own := windows[of == p]).size:
                self.windows.updateValue((p,), (own.tobytes(),))
            else:
                self.windows.removeKey((p,))

    def _slots(self) -> dict[int, bytes]:
        return {k[0]: bytes(v[0]) for k, v in self.wheel.iterator()}

    def _timer(self, deadlines) -> None:
        """The bucket's one timer stands at its first deadline."""
        first = min(deadlines) * HOUR_MS if deadlines else None
        standing = list(self.handle.listTimers())
        for t in standing:
            if t != first:
                self.handle.deleteTimer(t)
        if first is not None and first not in standing:
            self.handle.registerTimer(first)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        records = np.frombuffer(b"".join(r.copies for r in rows), RECORD)
        now = timerValues.getCurrentWatermarkInMs()
        if self.batch:  # the watermark lies a second before the first hour that is in time
            records = records[records["hour"].astype(np.int64) * HOUR_MS > now]
        if not len(records):
            return
        # with all fields in the machine's own byte order
        records = records.astype(np.dtype([(n, records.dtype[n].newbyteorder("=")) for n in RECORD.names]))
        pages = np.unique(self._page(records))
        standing = self._load(pages)
        due = (standing["start"].astype(np.int64) + SPAN) * HOUR_MS <= now
        yield from self._rows(standing[due], self.before)
        shrunk, standing = bool(due.any()), standing[~due]
        closed, now_open, touched = fold(records, standing)
        # the next watermark lies no lower than this bucket's own
        over = now_open["start"].astype(np.int64) + SPAN < int(records["hour"].max()) - LATE
        rest = np.ones(len(standing), bool)
        rest[touched] = False
        yield from self._rows(np.concatenate([closed, now_open[over]]), self.batch)
        stay = now_open[~over]
        if shrunk or len(standing) or len(stay):
            self._save(pages, np.concatenate([standing[rest], stay]))
        before = _find(stay, standing)
        moved = stay[(before < 0) | (standing["start"][before] != stay["start"])] if len(standing) else stay
        if len(moved):
            slots = self._slots()
            ids = np.zeros(len(moved), ID)
            ids["id"], ids["null"] = moved["id"], moved["null"]
            deadlines = moved["start"] + SPAN
            for d in np.unique(deadlines).tolist():
                self.wheel.updateValue((d,), (slots.get(d, b"") + ids[deadlines == d].tobytes(),))
            self._timer([*slots, *deadlines.tolist()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        slots = self._slots()
        due = {d: ids for d, ids in slots.items() if d * HOUR_MS <= now}
        ids = np.frombuffer(b"".join(due.values()), ID)
        deadline = np.repeat(np.fromiter(due, np.int64, len(due)), [len(x) // ID.itemsize for x in due.values()])
        pages = np.unique(self._page(ids))
        standing = self._load(pages)
        at = _find(ids, standing)
        # an id that has moved on to a later window stays in that one's slot
        at = np.unique(at[(at >= 0) & (standing["start"][at] + SPAN == deadline)]) if len(standing) else at[:0]
        yield from self._rows(standing[at], self.batch if now >= self.end * HOUR_MS else self.before)
        if len(at):
            self._save(pages, np.delete(standing, at))
        left = {d: ids for d, ids in slots.items() if d not in due}
        if len(left) < len(due):
            self.wheel.clear()
            for d, ids in left.items():
                self.wheel.updateValue((d,), (ids,))
        else:
            for d in due:
                self.wheel.removeKey((d,))
        self._timer(left)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, blob in zip(batch["closed_batch"].to_pylist(), batch["windows"]):
            w = np.frombuffer(blob.as_buffer(), WINDOW)
            big = w["hash"].astype(">u8").tobytes()
            columns = [
                pa.array(w["id"], mask=w["null"] == 1), pa.array(w["start"].astype(np.int64)), pa.array(np.full(len(w), number, np.int64)),
                *(pa.array(np.ascontiguousarray(w[f])) for f in ("repeats", "conflicts", "crc")),
                pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(w), [None, pa.py_buffer(big)]).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "hash"])


def _moved(spark: SparkSession, source: str, target: str) -> bool:
    """Whether there was something to move."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(source)):
        return False
    if not fs.rename(path(source), path(target)):
        raise OSError(f"{source} can't be moved to {target}")
    return True


def _start(spark: SparkSession, folder: str, batch: int, before: int, end: int) -> None:
    """Feeds what has been added to the folder."""
    fed = spark.readStream.schema(FED).parquet(f"{folder}/in/*")
    # a second more, as what lies at the watermark itself is neither late nor over
    fed = fed.withColumn("at", F.timestamp_seconds(F.col("last").cast("long") * 3_600)).withWatermark("at", f"{LATE} hours 1 second")
    windows = fed.select("bucket", "copies").groupBy("bucket").transformWithState(ClickWindows(batch, before, end), "closed_batch long, windows binary", "Append", "EventTime")
    query = windows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def _cut(rows: DataFrame, low: int, high: int, batches: int, buckets: int) -> DataFrame:
    """(batch, bucket, last, copies): a click's copies of one batch are one row; last is their last hour."""
    made = [_copy(rows, j) for j in range(3)]
    for j, (hour, label, record) in enumerate(made):
        there = F.col("more") >= j
        rows = rows.withColumns({
            f"h{j}": F.when(there, hour).cast("int"), f"r{j}": F.when(there, record),
            f"b{j}": F.when(there, F.floor((label - F.lit(low)) * batches / F.lit(high - low + 1))).cast("int")})
    rows = rows.withColumn("batch", F.explode(F.array_distinct(F.array_compact(F.array("b0", "b1", "b2")))))
    here = [F.col(f"b{j}").eqNullSafe(F.col("batch")) for j in range(3)]
    return rows.select(
        "batch", F.pmod(F.xxhash64("click_id"), F.lit(buckets)).cast("int").alias("bucket"), F.greatest(*(F.when(x, F.col(f"h{j}")) for j, x in enumerate(here))).alias("last"),
        F.concat(*(F.when(x, F.col(f"r{j}")).otherwise(F.lit(b"")) for j, x in enumerate(here))).alias("copies"))


def deduplicate(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The windows of all copies: click_id, start_hour, closed_batch, n_repeats, n_conflicts, conflict_crc, hash."""
    spark = clicks.sparkSession
    folder = f"{shared_dir(spark)}/clicks-{uuid.uuid4().hex}"
    rows = _prepared(clicks)
    made = [_copy(rows, j) for j in range(3)]
    of = lambda i: [F.when(F.col("more") >= j, made[j][i]) for j in range(3)]
    low, high, last, many = rows.agg(F.min(F.least(*of(1))), F.max(F.greatest(*of(1))), F.max(F.greatest(*of(0))), F.sum(F.col("more") + 1)).first()
    if not many:
        return spark.createDataFrame([], OUT)
    buckets = max(LEAST_BUCKETS, -(-many // (batches * BUCKET_COPIES)))
    _cut(rows, low, high, batches, buckets).write.partitionBy("batch").parquet(f"{folder}/cut")
    # a row without copies, after all hours, moves the watermark past every deadline
    end = last + SPAN + 2
    spark.range(1).select(F.lit(0).alias("bucket"), F.lit(end + LATE + 1).cast("int").alias("last"), F.lit(b"").alias("copies")).write.mode("append").parquet(f"{folder}/cut/batch={batches - 1}")
    before = {k: spark.conf.get(k, None) for k in (*SETTINGS, NO_DATA)}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/in")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
        last = 0
        for b in range(batches):
            if not _moved(spark, f"{folder}/cut/batch={b}", f"{folder}/in/{b}"):
                continue
            # a turn without rows is needed at the end alone
            spark.conf.set(NO_DATA, str(b == batches - 1).lower())
            _start(spark, folder, b, last, end)
            last = b
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema("closed_batch long, windows binary").parquet(f"{folder}/out").mapInArrow(_unpacked, OUT.replace("hash string", "hash binary"))
    return out.withColumn("hash", F.lower(F.hex("hash")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read(spark, sf_dir, "clicks"))


#: The contract step by step: an id's copies in order, each knowing its window from the one before. CRC-32 by its table.
ORACLE = """
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))),
j AS (SELECT *, epoch_us(arrived_at) // 3600000000 AS base, unnest(range(click_id % 3 + 1)) AS j FROM clicks WHERE arrived_at IS NOT NULL),
named AS (SELECT *, click_id || ':' || j AS name FROM j),
summed AS (SELECT named.*, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(substr(name, i, 1)) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS c FROM named, tab),
copy AS (SELECT click_id, base + 6 * j * (c % 10) AS hour, base + 6 * j * (c % 10) + c // 10 % 200 AS label,
  sha256(coalesce(CAST(client_id AS VARCHAR), '') || '|' || coalesce(kind, '') || '|' || CASE WHEN isfinite(value) THEN CAST(CAST(floor(100 * value + 0.5) AS BIGINT) AS VARCHAR) ELSE '' END || '|' || coalesce(CAST(epoch_us(ts) AS VARCHAR), '') || '|' || coalesce(props, '') || '|' || c % 3) AS hash FROM summed),
cut AS (SELECT click_id, hour, hash, (label - min(label) OVER ()) * 8 // (max(label) OVER () - min(label) OVER () + 1) AS batch FROM copy),
last AS (SELECT b, (SELECT max(hour) FROM cut WHERE batch <= b) AS m FROM range(8) r(b)),
kept AS (SELECT cut.*, row_number() OVER (PARTITION BY click_id ORDER BY batch, hour, hash) AS n FROM cut LEFT JOIN last ON b = batch - 1 WHERE batch = 0 OR hour >= m - 96),
step AS (SELECT click_id, n, batch, hour, hash, hour AS start, hash AS opener, 1 AS w FROM kept WHERE n = 1
  UNION ALL SELECT k.click_id, k.n, k.batch, k.hour, k.hash, CASE WHEN new THEN k.hour ELSE start END, CASE WHEN new THEN k.hash ELSE opener END, CASE WHEN new THEN w + 1 ELSE w END
  FROM (SELECT kept.*, s.start, s.opener, s.w, kept.hour > s.start + 24 OR s.batch < kept.batch AND s.start + 24 < (SELECT m FROM last WHERE b = kept.batch - 1) - 96 AS new FROM step s JOIN kept ON kept.click_id = s.click_id AND kept.n = s.n + 1) k),
crc AS (SELECT hash, xor(list_reduce(list_concat([4294967295], list_transform(range(1, 65), lambda i: CAST(ascii(substr(hash, i, 1)) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS v FROM (SELECT DISTINCT hash FROM step WHERE hash <> opener), tab),
win AS (SELECT click_id, w, any_value(start) AS start, any_value(opener) AS opener, min(batch) AS head, max(batch) AS tail, count(*) - 1 AS n_repeats, count(*) FILTER (s.hash <> opener) AS n_conflicts, coalesce(sum(v) FILTER (s.hash <> opener), 0) AS crc FROM step s LEFT JOIN crc USING (hash) GROUP BY 1, 2),
closing AS (SELECT *, lead(head) OVER (PARTITION BY click_id ORDER BY w) AS later, (SELECT min(b) FROM last WHERE b >= tail AND start + 24 < m - 96) AS due FROM win)
SELECT click_id, start AS start_hour, CAST(least(coalesce(due, 7), coalesce(later, 7)) AS BIGINT) AS closed_batch, n_repeats, n_conflicts, CAST(crc AS BIGINT) AS conflict_crc, opener AS hash FROM closing
"""
