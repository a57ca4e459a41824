"""SimHash near-dedup with pivot distance tables.

A fingerprint has a bit set where more than half the XXH64 values (seed 42) of
a text's 4-word shingles have it set. Equal fingerprints collapse first, so
copies never meet as pairs. Two fingerprints within 4 bits agree in at least
B - 4 of B blocks of bits, so every choice of B - 4 blocks is a table whose
keys bring together all that could link; B grows with the number of distinct
fingerprints, so a key rarely holds strangers. Within a key the pivot table
decides (by itself the table is a filter, no index: see the README): the Hamming distances of each fingerprint to many fixed reference
fingerprints are computed once; by the triangle inequality a pair whose largest
coordinate difference exceeds 4 is discarded, and survivors are verified.

Keys with many fingerprints are cut into sub-blocks and the pairs of sub-blocks
dealt out, so no task holds an unbounded group; a large group emits only a
spanning forest of its links, so rows never grow with its square, and the
components stay exact.

Texts without words (null and empty too) have fingerprint zero and link like
any other; a very long text is read whole; an empty table gives an empty result;
extra columns are left out, whatever their names. Repeated rows keep their rows. A null doc_id gets its component but
never names one unless the component has no other id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import components, durable, give_back, pieces

SHINGLE = 4
SEED = 42
RADIUS = 4
PIVOTS = 32
#: Fingerprints of one sub-block of a hot key.
SUB_BLOCK = 2048
#: A key with more is searched as a matrix and emits a forest.
SMALL = 64


def fingerprint(text: bytes) -> int:
    """Of one text, plainly; `_fingerprints` does the same for batches."""
    h = np.array(_hashes(text), np.uint64)
    if not len(h):
        return 0
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _hashes(text: bytes) -> list[int]:
    words = text.lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return [digest(joined, SEED)] if words else []
    starts, at = [], 0
    for n in map(len, words):
        starts.append(at)
        at += n + 1
    starts.append(at)
    return [digest(joined[s:e - 1], SEED) for s, e in zip(starts, starts[SHINGLE:])]  # noqa: B905


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "__text", 2 << 20):
        at = batch.schema.get_field_index("__text")
        each = [_hashes(t) for t in batch.column(at).cast(pa.binary()).fill_null(b"").to_pylist()]
        n = np.array(list(map(len, each)), np.int64)
        out = np.zeros(len(each), np.uint64)
        if n.any():
            h = np.fromiter((x for one in each for x in one), np.uint64, int(n.sum()))
            full = np.flatnonzero(n)
            first = (np.cumsum(n) - n)[full]
            ones = np.empty((len(full), 64), np.int32)
            raw = h.view(np.uint8).reshape(-1, 8)
            for byte in range(8):  # a byte of the hashes at a time
                bits = np.unpackbits(np.ascontiguousarray(raw[:, byte]).reshape(-1, 1), axis=1, bitorder="little")
                ones[:, 8 * byte:8 * byte + 8] = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
            out[full] = np.packbits(2 * ones > n[full][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        yield batch.remove_column(at).append_column("fp", pa.array(out.view(np.int64)))
        del batch, each, out
    give_back()


def fingerprints(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(kept columns, fp long)."""
    given = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "__text")
    return given.mapInArrow(_fingerprints, f"{schema}, fp long")


def block_masks(blocks: int) -> list[int]:
    """For every choice of blocks - RADIUS blocks, the mask of their bits, as signed longs."""
    edge = [round(i * 64 / blocks) for i in range(blocks + 1)]
    bits = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(bits[i] for i in chosen)) for chosen in combinations(range(blocks), blocks - RADIUS)]


def blocks_for(n: int) -> int:
    """Few tables, yet few strangers under a key."""
    for blocks in range(RADIUS + 2, 11):
        if comb(blocks, RADIUS) * n / 2 ** (64 * (blocks - RADIUS) / blocks) <= 8:
            return blocks
    return 11


def pivots() -> np.ndarray:
    return np.random.default_rng(20_240_501).integers(0, 2**64, PIVOTS, dtype=np.uint64)


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Distances to every pivot: a row of PIVOTS small integers for each fingerprint."""
    return np.bitwise_count(fp[:, None] ^ pivots()[None, :]).astype(np.int8)


def _survivors(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) link: first by coordinate differences, then by the fingerprints themselves."""
    keep = np.arange(len(i))
    for at in range(0, PIVOTS, 8):
        gap = np.abs(table[i[keep], at:at + 8] - table[j[keep], at:at + 8]).max(axis=1, initial=0)
        keep = keep[gap <= RADIUS]
    return keep[np.bitwise_count(fp[i[keep]] ^ fp[j[keep]]) <= RADIUS]


def _forest(fp: np.ndarray, table: np.ndarray, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of a large group; side: only pairs across two sides count."""
    label, left, right, every = np.arange(len(fp)), [], [], np.arange(len(fp))
    for i in range(len(fp)):
        other = every[i + 1:] if side is None else every[i + 1:][side[i + 1:] != side[i]]
        other = other[label[other] != label[i]]
        if len(other):
            near = other[_survivors(fp, table, np.full(len(other), i), other)]
            labels, one = np.unique(label[near], return_index=True)
            if len(labels):
                left += [i] * len(labels)
                right += near[one].tolist()
                label[np.isin(label, labels)] = label[i]
    return np.array(left, np.int64), np.array(right, np.int64)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t, k, i, j, s, fp), sorted by key, to links (u, v)."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows < 100_000:
            continue
        key = _key_ids(held)
        cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
        if cut:
            yield _search(held.slice(0, cut), key[:cut])
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield _search(held, _key_ids(held))


def _key_ids(table: pa.Table) -> np.ndarray:
    changed = np.zeros(table.num_rows, bool)
    for name in ("t", "k", "i", "j"):
        x = table[name].to_numpy()
        changed[1:] |= x[1:] != x[:-1]
    return np.cumsum(changed)


def _search(table: pa.Table, key: np.ndarray) -> pa.RecordBatch:
    fp = table["fp"].to_numpy().view(np.uint64)
    distances = pivot_table(fp)
    size = np.bincount(key, minlength=int(key[-1]) + 1)
    left, right = [], []
    small = np.flatnonzero(size[key] <= SMALL)
    cross, side = (table["i"].to_numpy() != table["j"].to_numpy()), table["s"].to_numpy()
    for step in range(1, SMALL):
        i, j = small[:-step], small[step:]
        same = (key[i] == key[j]) & ~(cross[i] & (side[i] == side[j]))
        if not (key[i] == key[j]).any():
            break
        i, j = i[same], j[same]
        linked = _survivors(fp, distances, i, j)
        left.append(i[linked])
        right.append(j[linked])
    for g in np.flatnonzero(size > SMALL):
        lo, hi = np.searchsorted(key, [g, g + 1])
        a, b = _forest(fp[lo:hi], distances[lo:hi], side[lo:hi] if cross[lo] else None)
        left.append(lo + a)
        right.append(lo + b)
    i, j = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (left, right))
    return pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[j].view(np.int64))], names=["u", "v"])


def links(distinct: DataFrame, n: int) -> DataFrame:
    """distinct (fp): n fingerprints. (u, v) pairs within RADIUS bits whose components are those of all such pairs."""
    masks = block_masks(blocks_for(n))
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)])).alias("e")).select("fp", "e.t", "e.k")
    shared = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / SUB_BLOCK).cast("int")
    met = keyed.join(shared, ["t", "k"]).withColumn("parts", parts)
    met = met.withColumn("s", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("fp"), "parts")).otherwise(0).cast("int"))
    met = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = met.select("t", "k", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), "s", "fp")
    placed = dealt.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
    return placed.mapInArrow(_links, "u long, v long")


def classes(printed: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """printed (key, fp), durable. (fp, component_id): the smallest key reachable by links."""
    distinct = durable(printed.groupBy("fp").agg(F.min(key).alias("least")))
    found = durable(components(links(distinct.select("fp"), distinct.count())))
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(least, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id), a row for each row of docs."""
    printed = durable(fingerprints(docs, text=text, keep=(key,)))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return printed.join(classes(printed, key=key), "fp").select(key, hexed.alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
