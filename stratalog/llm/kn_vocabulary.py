"""Words within their classes: counts of the whole vocabulary, which grows with the table and is never collected or broadcast.

The second half of a class-based model: `kn_words` foretells a word's class
from the class before it, this module the word from its class, by modified
Kneser-Ney discounts with a place for unknown words in each class.

A task puts its texts into blocks of some megabytes. A block is the sorted array
of its distinct word hashes with their counts, cut by ranges of hashes, and for
each text the places of its words in that array. Arrays go to their range, are
merged into one sorted hash array with the counts of the table, and each block
gets the counts of its words back. A word costs one entry a block however often
it stands there, so a frequent one burdens no range; ranges are as many as the
text needs. Of the whole table only sums by class are gathered.

A text's own words are taken from the counts before it is scored. Whatever the
blocks, the result is the same.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import durable, give_back, packed, unpacked
from stratalog.llm.kn_words import BITS, CLASSES, IN_CLASS, discounts

#: Bytes of text in a block, and in a range of hashes.
BLOCK_BYTES, RANGE_BYTES = 4 << 20, 128 << 20
LEAST_RANGES = 8
#: Columns of a block's rows: a range's part, or (range -1) the places of each text's words.
FIELDS = "__block long, __place int, __range int, __keys binary, __counts binary, __sizes binary"
SCHEMA = pa.schema([("__block", pa.int64()), ("__place", pa.int32()), ("__range", pa.int32()), ("__keys", pa.binary()), ("__counts", pa.binary()), ("__sizes", pa.binary())])


def ranges(docs: DataFrame, text: str = "text") -> int:
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(LEAST_RANGES, -(-size // RANGE_BYTES))


def _rows(**columns: list) -> pa.RecordBatch:
    n = len(columns["__block"])
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in SCHEMA], schema=SCHEMA)


class Block:
    """Texts whose words are gathered; `name` and `texts` tell the next text's block and place."""

    def __init__(self, cuts: int):
        self.edges = np.arange(1, cuts, dtype=np.uint64) * np.uint64(2**BITS // cuts)
        self.clear()

    def clear(self) -> None:
        self.name, self.texts, self.size = int.from_bytes(os.urandom(8), "little") >> 1, 0, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, w: np.ndarray, doc: np.ndarray, texts: int, size: int) -> None:
        key, own = np.unique((doc.astype(np.uint64) << np.uint64(BITS)) | w, return_counts=True)
        n = np.bincount((key >> np.uint64(BITS)).astype(np.int64), minlength=texts)
        self.parts.append((key & np.uint64(2**BITS - 1), own, n))
        self.texts, self.size = self.texts + texts, self.size + size

    def rows(self) -> pa.RecordBatch:
        w, own, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        keys, place = np.unique(w, return_inverse=True)
        counts = np.bincount(place, own, len(keys)).astype(np.int64)
        cut = np.concatenate([[0], np.searchsorted(keys, self.edges), [len(keys)]])
        some = np.flatnonzero(np.diff(cut))
        in_class = np.bincount((keys >> IN_CLASS).astype(np.int64), minlength=CLASSES)
        # places differ from one word to the next; the first of a text counts from 0
        step = np.diff(place, prepend=0)
        starts = (np.cumsum(n) - n)[n > 0]
        step[starts] = place[starts]
        out = _rows(
            __block=[self.name] * (len(some) + 1), __range=[-1, *some.tolist()],
            __keys=[packed(step.astype(np.int32)), *(packed(keys[cut[r]:cut[r + 1]].astype(np.int64), deltas=True) for r in some)],
            __counts=[packed(own.astype(np.int32)), *(packed(np.minimum(counts[cut[r]:cut[r + 1]], 2**31 - 1).astype(np.int32)) for r in some)],
            __sizes=[packed(np.concatenate([in_class, n]).astype(np.int32)), *([None] * len(some))])
        self.clear()
        return out


MERGED = "__block long, __range int, __counts binary, class int, sums array<long>"
_MERGED = pa.schema([("__block", pa.int64()), ("__range", pa.int32()), ("__counts", pa.binary()), ("class", pa.int32()), ("sums", pa.list_(pa.int64()))])


def _class_sums(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Of each class: its words' total, how many stand 1, 2, 3, 4 times, and how many there are."""
    of = (keys >> int(IN_CLASS)).astype(np.int64)
    names, at = np.unique(of, return_inverse=True)
    sums = [np.bincount(at, counts, len(names)), *(np.bincount(at[counts == k], minlength=len(names)) for k in (1, 2, 3, 4)), np.bincount(at, minlength=len(names))]
    sums = np.stack(sums, 1).astype(np.int64).tolist()
    none = [None] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((none, none, none, names, sums), _MERGED, strict=True)], schema=_MERGED)


def _merged(r: int, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    keys, at = np.unique(np.concatenate([k for _, k, _ in parts]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([c for *_, c in parts]), len(keys)).astype(np.int64)
    upto = 0
    for block, k, _ in parts:
        mine = np.minimum(counts[at[upto:upto + len(k)]], 2**31 - 1).astype(np.int32)
        upto += len(k)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([block], [r], [packed(mine)], [None], [None]), _MERGED, strict=True)], schema=_MERGED)
    yield _class_sums(keys, counts)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range: the table's counts for each block's words, and sums by class."""
    now, parts = None, []
    for batch in batches:
        for block, r, k, c in zip(*(batch.column(x).to_pylist() for x in range(4)), strict=True):
            if r != now and parts:
                yield from _merged(now, parts)
                parts = []
            now = r
            parts.append((block, unpacked(k, np.int64, deltas=True), unpacked(c, np.int32)))
    if parts:
        yield from _merged(now, parts)
    del parts
    give_back()


class Classes:
    """Of each class its words' total, how many stand once, twice and more often, and its places (one for unknown words)."""

    def __init__(self, rows: list[tuple[int, list[int]]]):
        sums = np.zeros((CLASSES, 6), np.int64)
        for k, s in rows:
            sums[k] = s
        self.discounts = discounts(sums[:, 1:5].sum(0).tolist())
        self.total, self.by_count = sums[:, 0], np.stack([sums[:, 1], sums[:, 2], sums[:, 5] - sums[:, 1] - sums[:, 2]])
        self.places = sums[:, 5] + 1

    def log_probabilities(self, doc: np.ndarray, of: np.ndarray, count: np.ndarray, own: np.ndarray, texts: int) -> np.ndarray:
        """The sum for each text over its words, by the counts of all other texts: distinct words of texts in order of (doc, class)."""
        out = np.zeros(texts)
        if not len(doc):
            return out
        rest = np.maximum(count - own, 0)
        start = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (doc[1:] != doc[:-1])]))
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(doc))))
        total = (self.total[of[start]] - np.add.reduceat(own, start))[group]
        mass = np.zeros(len(start))
        for k in (1, 2, 3):
            was, stays = np.minimum(count, 3) == k, np.minimum(rest, 3) == k
            mass += self.discounts[k] * (self.by_count[k - 1][of[start]] + np.add.reduceat(stays.astype(np.int64) - was, start))
        low = 1 / self.places[of]
        high = np.maximum(rest - self.discounts[np.minimum(rest, 3)], 0)
        p = np.where(total > 0, (high + mass[group] * low) / np.maximum(total, 1), low)
        return np.bincount(doc, own * np.log(np.maximum(p, 1e-300)), texts)


SCORES = "__block long, __place int, __word_nats double"


def _block_scores(block: int, own_row: tuple[bytes, bytes, bytes], counts: list[bytes], classes: Classes) -> pa.RecordBatch:
    step, own, sizes = (unpacked(x, np.int32).astype(np.int64) for x in own_row)
    in_class, n = sizes[:CLASSES], sizes[CLASSES:]
    doc = np.repeat(np.arange(len(n)), n)
    before = np.cumsum(step)
    starts = (np.cumsum(n) - n)[n > 0]
    base = np.zeros(len(step), np.int64)
    base[starts] = np.diff(np.concatenate([[0], before[starts] - step[starts]]))
    place = before - np.cumsum(base)
    count = np.concatenate([*(unpacked(c, np.int32) for c in counts), np.zeros(0, np.int32)]).astype(np.int64)
    of = np.repeat(np.arange(CLASSES), in_class)
    nats = classes.log_probabilities(doc, of[place], count[place], own, len(n))
    words = np.bincount(doc, own, len(n))
    mean = np.where(words > 0, -nats / np.maximum(words, 1), np.nan)
    return pa.RecordBatch.from_arrays([pa.array([block] * len(n), pa.int64()), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(mean, from_pandas=True)], names=["__block", "__place", "__word_nats"])


def scores(blocks: DataFrame) -> DataFrame:
    """(block, place, nats a word) of every text of the blocks' rows (FIELDS), which must be durable."""
    parts = blocks.where("__range >= 0").select("__block", "__range", "__keys", "__counts")
    merged = durable(parts.repartition("__range").sortWithinPartitions("__range").mapInArrow(_merge, MERGED))
    by_class = merged.where("class IS NOT NULL").groupBy("class").agg(F.array(*(F.sum(F.col("sums")[k]) for k in range(6))).alias("sums")).collect()  # CLASSES rows at most
    classes = blocks.sparkSession.sparkContext.broadcast(Classes([tuple(r) for r in by_class]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, counts = None, None, []
        for batch in batches:
            for block, r, c, k, s in zip(*(batch.column(x).to_pylist() for x in range(5)), strict=True):
                if r < 0:
                    if own:
                        yield _block_scores(now, own, counts, classes.value)
                    now, own, counts = block, (k, c, s), []
                else:
                    counts.append(c)
        if own:
            yield _block_scores(now, own, counts, classes.value)
        give_back()

    both = blocks.where("__range = -1").select("__block", "__range", "__counts", "__keys", "__sizes").unionByName(
        merged.where("class IS NULL").select("__block", "__range", "__counts"), allowMissingColumns=True)
    return both.repartition("__block").sortWithinPartitions("__block", "__range").mapInArrow(score, SCORES)
