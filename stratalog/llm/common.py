"""What the training-data operators share: durable intermediate tables, words,
Arrow batches in bounded pieces, and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The same set of separators, as a character class.
GAP = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in local mode without the setting."""
    sc = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
        return folder
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.gettempdir() + "/stratalog-checkpoints"


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint, which survives lost executors."""
    jsc = df.sparkSession.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bounds the bytes of the session's Arrow batches, which are bounded by rows alone otherwise, whole texts and all.

    Applications (the registered queries and the pipeline's stages) call this, as they run later than they are built;
    operators never do. It changes no result, and a bound of the session's own that is lower stays.
    """
    now = spark.conf.get(BATCH_BYTES, None)
    if now is None or not 0 < _bytes(now) <= most:
        spark.conf.set(BATCH_BYTES, str(most))


def _bytes(size: str) -> int:
    """A size of Spark's settings, as 4194304, 4194304b, 4m or 4mb."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgt]?)b?\s*", size.lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Splits batches so that a piece holds about `most` bytes of a string column; a longer text stands alone.

    A batch is let go before the next one is read; a caller that does so with its pieces holds one batch at a time.
    """
    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)
        del batch


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of the elements of slices (start, length), one slice after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on after its task, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def packed(x: np.ndarray, deltas: bool = False) -> bytes:
    """A numpy array of 4 or 8 byte integers, byte plane by byte plane, compressed; deltas: of sorted ones, their differences."""
    x = np.diff(x, prepend=x.dtype.type(0)) if deltas else x
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(b: bytes, dtype: type, deltas: bool = False) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(b[8:], size * n, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    x = np.ascontiguousarray(planes.T).view(dtype)[:, 0]
    return np.cumsum(x, dtype=dtype) if deltas else x


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node id reachable, for every node of an edge (u, v).

    Alternates large-star and small-star rounds (Kiveris et al. 2014): every
    round is two pre-aggregated minima and two equi-joins, the number of edges
    never grows, and nothing is collected but a checksum of a round.
    """
    def canonical(df):
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def star(e: DataFrame, small: bool) -> DataFrame:
        if small:
            # e holds u > v: the smaller neighbours of u are its v
            m = e.groupBy("u").agg(F.min("v").alias("m"))
            j = e.join(m, "u")
            return j.select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                m.select("u", F.col("m").alias("v")))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # neighbours larger than u hang onto u's minimum
        j = e.select(F.col("v").alias("u"), F.col("u").alias("w")).join(m, "u")
        return j.select(F.col("w").alias("u"), F.col("m").alias("v"))

    now, before = durable(canonical(edges)), None
    for _ in range(rounds):
        now = durable(canonical(star(canonical(star(now, False)), True)))
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
