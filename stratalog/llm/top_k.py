"""Exact top-k search by inner product: norm-bucketed retrieval.

Vectors become integers, are sorted by length and dealt into buckets of similar length (a durable table of packed
matrices, longest first). Queries come in blocks of bounded size, each broadcast once and met with every bucket. The
least of a query's best scores so far, over its own length and the bucket's greatest, is its local threshold on the
cosine. Over 1, the bucket has nothing for it. Else the bucket is pruned for it in one of two ways, by that threshold:

- high: by coordinates. A unit vector within the threshold of the query's direction has, in the query's largest
  coordinates, values inside an interval; the bucket keeps each coordinate sorted, the narrowest interval is cut out of
  its order and the others filter;
- else: by length. Only the bucket's first vectors are long enough to reach the score.

What is left is verified by exact integer products. Thresholds start from the scores of the longest vectors and rise as
a task goes through its buckets.

Vectors that are null or hold a null or non-finite component take no part, nor do those with a component of
2^54 or more. A query meets vectors of its own dimension; without components all products are 0. A row is told from
its like by its place, so repeated rows are each other's candidates and each query row has its own answers. A null id
is never a query's, and as a candidate comes after all others of its score. Scores beyond 64 bits end at the limit of
long. Extra columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.llm.common import read, shared_dir

SCALE, TOP, EVERY = 256, 5, 50
#: Vectors in a bucket, queries in a block, and bytes of the numbers of either at most.
BUCKET, BLOCK, MOST_BYTES = 4_096, 16_384, 16 << 20
#: From this local threshold on a bucket is pruned by coordinates, of which so many are looked at.
COORDINATES_FROM, FOCUS = 0.9, 6
#: Float errors in lengths and directions stay well below this.
SLACK = 1e-9
EXACT = 2.0**53
LIMIT = 2**63 - 1
NO_ID = LIMIT


def _whole(vec) -> Column:
    """Whether a vector takes part."""
    return F.coalesce(vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & (F.abs(F.coalesce(x, F.lit(0.0))) < 2.0**54)), F.lit(False))


def _floats(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat.astype(np.float64)).reshape(batch.num_rows, width)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole floats; as int64, at most LIMIT from zero."""
    if not x.shape[1]:
        return np.zeros((len(q), len(x)), np.int64)
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1] < EXACT:
        return (q @ x.T).astype(np.int64)
    whole = np.array([[int(v) for v in row] for row in q], object) @ np.array([[int(v) for v in row] for row in x], object).T
    return np.clip(whole, -LIMIT - 1, LIMIT).astype(np.int64)


class Best:
    """The k best (score, id, row) of each query of a block: higher scores first, then smaller ids, then smaller rows."""

    def __init__(self, count: int, k: int):
        self.k = k
        self.score = np.full((count, k), -LIMIT - 1)
        self.id = np.full((count, k), NO_ID)
        self.row = np.full((count, k), -1)
        self.floor = np.full(count, -np.inf)  # no score below it is wanted

    def take(self, q: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        fit = score >= self.floor[q]
        if not fit.any():
            return
        old = self.row[q] >= 0
        score, ids, rows = (np.concatenate([a[old], b[fit]]) for a, b in ((self.score[q], score), (self.id[q], ids), (self.row[q], rows)))
        order = np.lexsort((rows, ids, -score.astype(np.float64), -score))[: self.k] if np.abs(score).max() < EXACT else np.array(sorted(range(len(score)), key=lambda i: (-int(score[i]), ids[i], rows[i]))[: self.k])
        n = len(order)
        self.score[q, :n], self.id[q, :n], self.row[q, :n] = score[order], ids[order], rows[order]
        if n == self.k:
            self.floor[q] = max(self.floor[q], float(self.score[q, -1]))


class Queries:
    """A block of queries of one dimension: whole numbers, lengths, ids and rows, and scores that are known to be reached."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, floor: np.ndarray | None = None):
        self.x, self.ids, self.rows = x, ids, rows
        self.length = np.sqrt((x * x).sum(axis=1))
        self.floor = np.full(len(x), -np.inf) if floor is None else floor


class Bucket:
    """Vectors of similar length, longest first; each coordinate of their directions in order, once it is asked for."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.x, self.ids, self.rows = x, ids, rows
        self.length = np.sqrt((x * x).sum(axis=1))
        self.unit: np.ndarray | None = None
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if self.unit is None:
            self.unit = self.x / np.where(self.length > 0, self.length, 1)[:, None]
        if f not in self.sorted:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.sorted[f] = order, self.unit[order, f]
        return self.sorted[f]

    def by_coordinates(self, q: np.ndarray, length: float, cosine: float) -> np.ndarray:
        """Places of vectors whose direction may lie within the cosine of q's."""
        direction = q / length
        focus = np.argpartition(-np.abs(direction), min(FOCUS, len(q)) - 1)[:FOCUS]
        at, rest = direction[focus] * cosine, np.sqrt(np.maximum(0, (1 - cosine * cosine) * (1 - direction[focus] ** 2)))
        # past the direction itself a coordinate is bounded by the sphere alone
        low = np.where(direction[focus] < -cosine, -1.0, at - rest) - SLACK
        high = np.where(direction[focus] > cosine, 1.0, at + rest) + SLACK
        best = None
        for f, lo, hi in zip(focus.tolist(), low, high):
            order, values = self.coordinate(f)
            span = np.searchsorted(values, lo), np.searchsorted(values, hi, side="right")
            if best is None or span[1] - span[0] < best[1] - best[0]:
                best = (*span, order)
        near = best[2][best[0] : best[1]]
        near = near[((self.unit[near][:, focus] >= low) & (self.unit[near][:, focus] <= high)).all(axis=1)]
        return near


def search(queries: Queries, bucket: Bucket, best: Best) -> dict[str, int]:
    """Adds a bucket's vectors to the queries' best; how many (query, bucket) were pruned how, and products made."""
    said = {"whole": 0, "coordinates": 0, "length": 0, "products": 0}
    if not len(bucket.x):
        return said
    longest = bucket.length[0]
    reach = queries.length * longest
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(reach > 0, best.floor / reach, np.where(best.floor > 0, np.inf, -np.inf)) - SLACK
    over = cosine > 1
    said["whole"] = int(over.sum())
    fine = (cosine >= COORDINATES_FROM) & ~over
    for q in np.flatnonzero(fine).tolist():
        near = bucket.by_coordinates(queries.x[q], queries.length[q], float(cosine[q]))
        near = near[bucket.rows[near] != queries.rows[q]]
        said["coordinates"] += 1
        said["products"] += len(near)
        if len(near):
            best.take(q, _products(queries.x[q : q + 1], bucket.x[near])[0], bucket.ids[near], bucket.rows[near])
    rest = np.flatnonzero(~over & ~fine)
    said["length"] = len(rest)
    for start in range(0, len(rest), 256):
        some = rest[start : start + 256]
        # |x| |q| has to reach the floor: the first vectors of the bucket
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(best.floor[some] > 0, best.floor[some] / queries.length[some] * (1 - SLACK), 0)
        end = int(np.searchsorted(-bucket.length, -least.min(), side="right"))
        product = _products(queries.x[some], bucket.x[:end])
        said["products"] += product.size
        reached = product >= best.floor[some][:, None]
        for i in np.flatnonzero(reached.any(axis=1)).tolist():
            q, score = some[i], product[i]
            wanted = np.flatnonzero(reached[i] & (bucket.rows[:end] != queries.rows[q]))
            if len(wanted) > best.k:  # ties with the k-th stay
                cut = np.partition(score[wanted], len(wanted) - best.k)[len(wanted) - best.k]
                wanted = wanted[score[wanted] >= cut]
            if len(wanted):
                best.take(q, score[wanted], bucket.ids[wanted], bucket.rows[wanted])
    return said


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, id, vec) to (row, id, width, length, vec): whole components."""
    for batch in batches:
        at = batch.column(batch.schema.get_field_index("vec"))
        sizes = at.value_lengths().to_numpy(zero_copy_only=False)
        for width in np.unique(sizes).tolist():
            own = batch.filter(pa.array(sizes == width))
            x = _floats(own, "vec", width)
            packed = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [own.column(0), own.column(1), pa.array(np.full(len(x), width, np.int32)), pa.array(np.sqrt((x * x).sum(axis=1))), packed], names=["row", "id", "width", "length", "vec"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), width)


def _parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows sorted by (width, length descending) as (width, x, ids, rows) of `most` vectors, or what MOST_BYTES hold."""
    held: list[pa.RecordBatch] = []

    def flush(width: int):
        t = pa.Table.from_batches(held)
        x = _matrix(t["vec"].combine_chunks(), width)
        ids = t["id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
        return width, x, ids, t["row"].to_numpy()

    width, count, fit = -1, 0, most
    for batch in batches:
        widths = batch["width"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            while lo < hi:
                if held and (widths[lo] != width or count == fit):
                    yield flush(width)
                    held, count = [], 0
                width = int(widths[lo])
                fit = max(1, min(most, MOST_BYTES // (8 * max(width, 1))))
                n = min(hi - lo, fit - count)
                held.append(batch.slice(lo, n))
                count, lo = count + n, lo + n
    if held:
        yield flush(width)


def _buckets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for width, x, ids, rows in _parts(batches, size):
        yield pa.RecordBatch.from_arrays(
            [pa.array([width], pa.int32()), pa.array([float(np.sqrt((x[0] * x[0]).sum()))]), pa.array([x.astype(np.float64).tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary()), pa.array([rows.tobytes()], pa.binary())],
            names=["width", "longest", "x", "ids", "rows"])


def _bucket(batch: pa.RecordBatch, i: int) -> Bucket:
    x, ids, rows = (np.frombuffer(batch[c][i].as_buffer(), t) for c, t in (("x", np.float64), ("ids", np.int64), ("rows", np.int64)))
    return Bucket(x.reshape(len(rows), batch["width"][i].as_py()), ids, rows)


def _searched(batches: Iterator[pa.RecordBatch], block: Broadcast, k: int) -> Iterator[pa.RecordBatch]:
    """Buckets to each query's best of the task, as (query, id, score, candidate's id and row)."""
    queries: Queries = block.value
    best = Best(len(queries.x), k)
    best.floor[:] = queries.floor
    for batch in batches:
        for i in range(batch.num_rows):
            if batch["width"][i].as_py() == queries.x.shape[1]:
                search(queries, _bucket(batch, i), best)
    q, at = np.nonzero(best.row >= 0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(queries.rows[q]), pa.array(queries.ids[q]), pa.array(best.score[q, at]), pa.array(best.id[q, at], mask=best.id[q, at] == NO_ID), pa.array(best.row[q, at])],
        names=["query_row", "query_id", "score", "vec_id", "row"])


FOUND = "query_row long, query_id long, score long, vec_id long, row long"


def seeded(queries: Queries, seeds: Bucket, k: int) -> Queries:
    """With each query's k-th best score among the seeds as its floor."""
    best = Best(len(queries.x), k)
    search(queries, seeds, best)
    full = best.row[:, -1] >= 0
    return Queries(queries.x, queries.ids, queries.rows, np.where(full, best.score[:, -1].astype(np.float64), -np.inf))


def top_k(vectors: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = TOP, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query row with all other rows."""
    spark = vectors.sparkSession
    folder = f"{shared_dir(spark)}/top-k-{uuid.uuid4().hex}"
    vec = F.col(vector).cast("array<double>")
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), vec.alias("vec"), is_query.alias("asks")).where(_whole(F.col("vec")))
    # rows have their places from here on
    rows.write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    measured = rows.select("row", "id", "vec").mapInArrow(_lengths, "row long, id long, width int, length double, vec binary")
    measured.repartitionByRange("width", F.desc("length"), "row").sortWithinPartitions("width", F.desc("length"), "row").mapInArrow(
        partial(_buckets, size=bucket), "width int, longest double, x binary, ids binary, rows binary").write.parquet(f"{folder}/buckets")
    buckets = spark.read.parquet(f"{folder}/buckets")
    asked = rows.where("asks").select("row", "id", "vec").mapInArrow(_lengths, "row long, id long, width int, length double, vec binary")
    asked.repartitionByRange("width", F.desc("length"), "row").sortWithinPartitions("width", F.desc("length"), "row").mapInArrow(
        partial(_buckets, size=block), "width int, longest double, x binary, ids binary, rows binary").write.parquet(f"{folder}/queries")
    blocks = spark.read.parquet(f"{folder}/queries")
    found = []
    named = blocks.select("width", "longest", F.xxhash64("rows").alias("name")).orderBy("width", F.desc("longest"), "name").collect()  # a row a block
    heads = {w: buckets.where(F.col("width") == w).orderBy(F.desc("longest")).limit(1) for w in {b.width for b in named}}
    for b in named:
        own = _bucket(blocks.where((F.col("width") == b.width) & (F.xxhash64("rows") == b.name)).toArrow().to_batches()[0], 0)
        queries = Queries(own.x, own.ids, own.rows)
        seeds = _bucket(heads[b.width].toArrow().to_batches()[0], 0)
        sent = spark.sparkContext.broadcast(seeded(queries, seeds, k))
        found.append(buckets.mapInArrow(partial(_searched, block=sent, k=k), FOUND))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    everything = found[0]
    for f in found[1:]:
        everything = everything.unionByName(f)
    first = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return everything.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


#: The contract by brute force.
ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS cr, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, cr) AS k FROM p)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM n WHERE k <= 5
"""
