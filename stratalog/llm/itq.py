"""Embedding near-dedup by iterative quantisation.

Vectors of one label link at a cosine of 0.98 or more. Equal vectors collapse
first. A rotation for balanced binary codes is learned (PCA, then alternating
signs and orthogonal Procrustes steps) on at most FIT_ROWS vectors; every
vector gets a code of up to 64 bits. Multi-index Hamming tables each key the
codes by one seeded subset of bits. How often bits of linked vectors differ is
measured, as it depends on the data: QUERY_ROWS vectors are compared with all
others of their label, and tables are added until the share RECALL of the links
found meets in one; where these are few, pairs made at the threshold must meet
as well. Of the subset sizes, up to the logarithm of the number of vectors, the
one of least work is taken; a size of zero compares all. Only ids and codes go to
the tables; there pairs are filtered by the Hamming distance of whole codes, and
vectors follow those that have a partner near enough, into the first table where
they meet it, to be reranked in double precision, so no pair below the threshold
links.

A pair counts in the first table where it meets. Hot keys are cut into
sub-blocks whose pairs are dealt out; a task emits sums of links for each vector
and a spanning forest, never the pairs. A shorter vector is padded with zeros.

Null labels, and vectors that are null, zero or hold null or non-finite
components, link with nothing. Repeated rows count as vectors of their own; of
equal vectors the least id names the class. An empty table gives an empty
result. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import components, durable, give_back

COSINE = 0.98
#: Most vectors the rotation is learned on, by a hash of their ids.
FIT_ROWS = 10_000
BITS, ROUNDS, RECALL = 64, 40, 0.999
#: Vectors whose links are brute-forced to measure recall, by a hash of their ids; links that suffice without made ones; most links kept.
QUERY_ROWS, ENOUGH, MOST_LINKS = 1_000, 2_000, 100_000
#: Tables beyond which a subset size is given up, and comparisons that cost as much as a row of a table.
MOST_TABLES, ROW_COST = 256, 200
#: Bits beyond the most that differ in a measured link, within which vectors are reranked.
MARGIN = 2
SUB_BLOCK = 1024
SMALL = 48


class Quantiser:
    def __init__(self, mean: np.ndarray, rotation: np.ndarray):
        self.mean, self.rotation = mean, rotation

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = 1) -> Quantiser:
        """x: unit vectors."""
        mean = x.mean(axis=0)
        centred = x - mean
        bits = min(BITS, x.shape[1])
        _, vectors = np.linalg.eigh(centred.T @ centred)
        axes = vectors[:, ::-1][:, :bits]
        v = centred @ axes
        r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
        for _ in range(ROUNDS):
            u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ wt).T
        return cls(mean, axes @ r)

    def codes(self, x: np.ndarray) -> np.ndarray:
        bits = (x - self.mean) @ self.rotation >= 0
        full = np.zeros((len(x), 64), bool)
        full[:, :bits.shape[1]] = bits
        return np.packbits(full, axis=1, bitorder="little").view(np.int64)[:, 0]


def _as_long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def table_masks(n: int, bits: int, differ: list[tuple[np.ndarray, np.ndarray]], seed: int = 2) -> list[int]:
    """Seeded subsets of code bits, as masks: as many as each set (differing bits, number) of linked pairs needs to meet."""
    best, least = [0], float(n + ROW_COST)  # one table that holds all
    for size in range(max(1, min(bits, 26, round(math.log2(max(n, 2))))), 0, -1):
        r = np.random.default_rng(seed)
        apart, masks, work = [(x, m) for x, m in differ], [], ROW_COST + n / 2**size
        # half the allowance, as tables are fitted to the measured pairs
        allowed = [m.sum() * (1 - RECALL) / 2 for _, m in differ]
        while any(m.sum() > most for (_, m), most in zip(apart, allowed, strict=True)) or not masks:
            if len(masks) == MOST_TABLES or (len(masks) + 1) * work >= least:
                masks = []
                break
            mask = _as_long(sum(1 << int(b) for b in r.choice(bits, size, replace=False)))
            masks.append(mask)
            apart = [(x[miss], m[miss]) for x, m in apart for miss in [x & mask != 0]]
        if masks:
            best, least = masks, len(masks) * work
    return best


def made_pairs(quantiser: Quantiser, x: np.ndarray, seed: int = 3) -> np.ndarray:
    """Differing bits of unit vectors x and of vectors at the threshold from them, in random directions."""
    noise = np.random.default_rng(seed).standard_normal(x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    noise /= np.maximum(np.sqrt((noise * noise).sum(axis=1, keepdims=True)), 1e-300)
    return quantiser.codes(x) ^ quantiser.codes(COSINE * x + math.sqrt(1 - COSINE**2) * noise)


def _differ(batches: Iterator[pa.RecordBatch], queries: Broadcast, width: int) -> Iterator[pa.RecordBatch]:
    """Differing bits of each link between a vector and a query, with their number."""
    label, ids, code, q = queries.value
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            at = {f: part.column(part.schema.get_field_index(f)) for f in ("label", "id", "code", "vec")}
            near = _matrix(at["vec"], width) @ q.T >= COSINE
            near &= (at["label"].to_numpy()[:, None] == label) & (at["id"].to_numpy()[:, None] != ids)
            i, j = np.nonzero(near)
            x, m = np.unique(at["code"].to_numpy()[i] ^ code[j], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(m.astype(np.int64))], names=["x", "m"])


def measured_pairs(coded: DataFrame, quantiser: Quantiser, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sets of (differing bits, number) of the links of QUERY_ROWS vectors, and of made ones where these are few."""
    some = coded.orderBy(F.xxhash64("id", "label"), "id").limit(QUERY_ROWS).toArrow()  # bounded
    if not some.num_rows:
        return []
    q = _matrix(some["vec"].combine_chunks(), width)
    label, ids, code = (some[c].to_numpy() for c in ("label", "id", "code"))
    sent = coded.sparkSession.sparkContext.broadcast((label, ids, code, q))
    links = coded.select("label", "id", "code", "vec").mapInArrow(partial(_differ, queries=sent, width=width), "x long, m long").groupBy("x").agg(F.sum("m").alias("m"))
    found = links.orderBy(F.xxhash64("x")).limit(MOST_LINKS).toArrow()
    sets = [(found["x"].to_numpy(), found["m"].to_numpy())] if found.num_rows else []
    if found.num_rows < ENOUGH:
        made = made_pairs(quantiser, np.repeat(q, max(1, ENOUGH // len(q)), axis=0))
        sets.append((made, np.ones(len(made), np.int64)))
    return sets


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Unit rows in double precision, padded with zeros."""
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(n) and (n == width).all():
        out = flat.reshape(len(n), width)
    else:
        out = np.zeros((len(n), width))
        row = np.repeat(np.arange(len(n)), n)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    scale = np.abs(out).max(axis=1, keepdims=True, initial=0)
    out = out / np.where(scale > 0, scale, 1)
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-300)


def _code(batches: Iterator[pa.RecordBatch], quantiser: Broadcast, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("code", pa.array(quantiser.value.codes(_matrix(batch.column(batch.schema.get_field_index("vec")), width))))


def _key_ids(table: pa.Table) -> np.ndarray:
    changed = np.zeros(table.num_rows, bool)
    for name in ("label", "t", "k", "i", "j"):
        x = table[name].to_numpy()
        changed[1:] |= x[1:] != x[:-1]
    return np.cumsum(changed)


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in pieces of whole groups, with each row's group number."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows < most:
            continue
        key = _key_ids(held)
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield held.slice(0, cut), key[:cut]
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held, _key_ids(held)
    del held
    give_back()


def _first_here(code: np.ndarray, t: np.ndarray, masks: list[int], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs that meet in no earlier table."""
    differ, ok = code[i] ^ code[j], np.ones(len(i), bool)
    for at, mask in enumerate(masks):
        ok &= (t[i] <= at) | (differ & mask != 0)
    return ok


def _near(batches: Iterator[pa.RecordBatch], masks: list[int], radius: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (label, t, k, i, j, s, id, code): those with a partner within `radius` bits that they meet here first."""
    for table, key in _groups(batches, 100_000):
        code, t = table["code"].to_numpy(), table["t"].to_numpy()
        cross, side = table["i"].to_numpy() != table["j"].to_numpy(), table["s"].to_numpy()
        size, keep = np.bincount(key, minlength=int(key[-1]) + 1), np.zeros(len(key), bool)

        def take(i: np.ndarray, j: np.ndarray) -> None:
            close = np.bitwise_count((code[i] ^ code[j]).view(np.uint64)) <= radius
            i, j = i[close], j[close]
            ok = _first_here(code, t, masks, i, j)
            keep[i[ok]] = True
            keep[j[ok]] = True

        small = np.flatnonzero(size[key] <= SMALL)
        for step in range(1, SMALL):
            i, j = small[:-step], small[step:]
            same = key[i] == key[j]
            if not same.any():
                break
            same &= ~(cross[i] & (side[i] == side[j]))
            take(i[same], j[same])
        for g in np.flatnonzero(size > SMALL):
            lo, hi = np.searchsorted(key, [g, g + 1])
            for start in range(lo, hi, 256):
                stop = min(hi, start + 256)
                near = np.bitwise_count((code[start:stop, None] ^ code[None, lo:hi]).view(np.uint64)) <= radius
                near &= np.arange(lo, hi)[None, :] > np.arange(start, stop)[:, None]
                if cross[lo]:
                    near &= side[start:stop, None] != side[None, lo:hi]
                i, j = np.nonzero(near)
                take(i + start, j + lo)
        if keep.any():
            yield table.drop_columns(["code"]).filter(pa.array(keep)).combine_chunks().to_batches()[0]


def _rerank(batches: Iterator[pa.RecordBatch], masks: list[int], width: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (label, t, k, i, j, s, id, n, code, vec) to rows (u, v, links): links of u, or a forest edge u-v."""
    for table, key in _groups(batches, 20_000):
        yield _meet(table, key, masks, width)


def _meet(table: pa.Table, key: np.ndarray, masks: list[int], width: int) -> pa.RecordBatch:
    x = _matrix(table["vec"].combine_chunks(), width)
    ids, copies, t = (table[c].to_numpy() for c in ("id", "n", "t"))
    code = table["code"].to_numpy()
    cross, side = table["i"].to_numpy() != table["j"].to_numpy(), table["s"].to_numpy()
    size = np.bincount(key, minlength=int(key[-1]) + 1)
    links = np.zeros(len(ids), np.int64)
    left, right = [], []

    small = np.flatnonzero(size[key] <= SMALL)
    for step in range(1, SMALL):
        i, j = small[:-step], small[step:]
        same = key[i] == key[j]
        if not same.any():
            break
        same &= ~(cross[i] & (side[i] == side[j]))
        i, j = i[same], j[same]
        near = (x[i] * x[j]).sum(axis=1) >= COSINE
        i, j = i[near], j[near]
        ok = _first_here(code, t, masks, i, j)
        i, j = i[ok], j[ok]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        left.append(i)
        right.append(j)
    for g in np.flatnonzero(size > SMALL):
        lo, hi = np.searchsorted(key, [g, g + 1])
        label = np.arange(hi - lo)
        for start in range(lo, hi, 256):
            stop = min(hi, start + 256)
            near = x[start:stop] @ x[lo:hi].T >= COSINE
            near &= np.arange(lo, hi)[None, :] > np.arange(start, stop)[:, None]
            if cross[lo]:
                near &= side[start:stop, None] != side[None, lo:hi]
            i, j = np.nonzero(near)
            i, j = i + start, j + lo
            ok = _first_here(code, t, masks, i, j)
            i, j = i[ok], j[ok]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            for a in np.unique(i):  # joins a to each other class it is linked to, once
                others, one = np.unique(label[j[i == a] - lo], return_index=True)
                new = others != label[a - lo]
                if new.any():
                    left.append(np.full(int(new.sum()), a))
                    right.append(j[i == a][one[new]])
                    label[np.isin(label, others[new])] = label[a - lo]
    own = np.flatnonzero(links)
    i, j = (np.concatenate(z).astype(np.int64) if z else np.zeros(0, np.int64) for z in (left, right))
    u, v = np.concatenate([ids[own], ids[i]]), np.concatenate([ids[own], ids[j]])
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.concatenate([links[own], np.zeros(len(i), np.int64)]))], names=["u", "v", "links"])


def near_duplicates(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept), a row for each row of vectors."""
    vec = F.col(vector).cast("array<double>")
    usable = F.coalesce(
        F.col(label).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(vec, lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), vec.alias("vec"), usable.alias("ok"))
    named = durable(rows.where("ok").groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.max(F.size("vec")).alias("w")))
    n, width = named.agg(F.count("*"), F.max("w")).first()
    alone = rows.where("NOT ok").select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if n:
        picked = named.orderBy(F.xxhash64("rep", "label"), "rep").limit(FIT_ROWS).select("vec").toArrow()  # bounded
        x = _matrix(picked["vec"].combine_chunks(), width)
        quantiser = Quantiser.fit(x)
        sent = vectors.sparkSession.sparkContext.broadcast(quantiser)
        plain = named.where(F.col("rep").isNotNull()).select(F.xxhash64("label").alias("label"), F.col("rep").alias("id"), "n", "vec")
        coded = plain.mapInArrow(partial(_code, quantiser=sent, width=width), "label long, id long, n long, vec array<double>, code long")
        coded = durable(coded)
        pairs = measured_pairs(coded, quantiser, width)
        masks = table_masks(n, quantiser.rotation.shape[1], pairs)
        radius = max((int(np.bitwise_count(x.view(np.uint64)).max()) for x, _ in pairs if len(x)), default=64) + MARGIN
        tables = F.array(*[F.struct(F.lit(t).cast("short").alias("t"), F.col("code").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)])
        keyed = coded.select("label", "id", "code", F.explode(tables).alias("e")).select("label", "id", "code", "e.t", "e.k")
        shared = keyed.groupBy("label", "t", "k").agg(F.count("*").alias("m")).where("m > 1")
        met = keyed.join(shared, ["label", "t", "k"]).withColumn("parts", F.ceil(F.col("m") / SUB_BLOCK).cast("int"))
        met = met.withColumn("s", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id"), "parts")).otherwise(0).cast("int"))
        met = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        group = ("label", "t", "k", "i", "j")
        dealt = met.select("label", "t", "k", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), "s", "id", "code")
        # codes alone go to the tables; vectors follow those that have a partner near enough
        near = dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(partial(_near, masks=masks, radius=radius), "label long, t short, k long, i int, j int, s int, id long")
        placed = near.join(coded.select("id", "n", "code", "vec"), "id").select(*group, "s", "id", "n", "code", "vec").repartition(*group).sortWithinPartitions(*group)
        found = durable(placed.mapInArrow(partial(_rerank, masks=masks, width=width), "u long, v long, links long"))
        links = found.where("u = v").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
        parts = components(found.where("u <> v").select("u", "v")).withColumnRenamed("node", "rep")
        reps = named.join(links, "rep", "left").join(parts, "rep", "left").select(
            "label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
        linked = rows.where("ok").join(reps, ["label", "vec"]).select(F.col("id").alias(key), "n_links", "component_id")
        alone = alone.unionByName(linked)
    return alone.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The contract by brute force: all pairs of a label, then reachability.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(x, y) AS (SELECT x, x FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
root AS (SELECT x, min(y) AS c FROM reach GROUP BY 1), many AS (SELECT x, count(*) AS n FROM link GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept FROM v LEFT JOIN root ON root.x = vec_id LEFT JOIN many ON many.x = vec_id
"""
