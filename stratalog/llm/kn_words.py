"""A class-based modified Kneser-Ney model of words: pairs of classes, then the word within its class (`kn_vocabulary`); each document scored by all others.

A word is a run of ASCII letters and digits (without case) and of other bytes
beyond ASCII; a punctuation mark is a word, and so is each character from
U+3000 on. Words fall into CLASSES classes by a hash, so pairs of classes are
bounded by CLASSES ** 2 whatever the table and however many words it has:
frequent words rule their classes, and rare ones add noise.

Tasks add up their pairs of whole texts before the shuffle; counts go by range
of the first class as compressed sorted arrays and are added up again, and the
driver gets one sorted array of pair codes and counts, which is broadcast.
Nothing is cut off.

A document's own pairs are taken from the counts of its pairs before it is
scored: words in a senseless order would foretell themselves otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import give_back, packed, pieces, unpacked

#: Classes of words; one more stands for the start of a text.
CLASSES = 2048
SPACE = (CLASSES + 1) * CLASSES
#: Ranges of first classes, and bytes of text split into words at once.
RANGES, CHUNK = 16, 1 << 20
#: Bits of a word's hash; the first of them give its class, so hashes in order have classes in order.
BITS = 40
IN_CLASS = np.uint64(BITS - (CLASSES - 1).bit_length())


def _kinds() -> np.ndarray:
    """0 space, 1 of a word, 2 a word by itself, 3 leads one, 4 continues."""
    out = np.full(256, 2, np.uint8)
    for b in range(256):
        if b in b" \t\n\x0b\x0c\r\x00":
            out[b] = 0
        elif b >= 0x80:
            out[b] = 4 if b < 0xC0 else 1 if b < 0xE3 else 3
        elif chr(b).isalnum():
            out[b] = 1
    return out


_KIND = _kinds()
_r = np.random.default_rng(7)
_BYTE = _r.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _r.integers(1, 2**63, 1024, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (BITS bits) of all words, and the number of the text each stands in."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kind = _KIND[data]
    if (kind == 4).any():
        lead = np.maximum.accumulate(np.where(kind != 4, np.arange(len(data), dtype=np.int32), np.int32(0)))
        whole = kind[lead]
    else:
        whole = kind
    begins = (kind == 2) | (kind == 3)
    begins[1:] |= (kind[1:] == 1) & (whole[:-1] != 1)
    begins[0] = kind[0] not in (0, 4)
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.arange(len(data), dtype=np.int32) - np.repeat(at, np.diff(np.append(at, len(data)))).astype(np.int32) if at[0] == 0 else np.arange(len(data), dtype=np.int32) - np.concatenate(
        [np.zeros(at[0], np.int32), np.repeat(at, np.diff(np.append(at, len(data)))).astype(np.int32)])
    value = _BYTE[data] * _PLACE[place & 1023]
    value[whole == 0] = 0
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return _mix(np.add.reduceat(value, at)) >> np.uint64(64 - BITS), np.searchsorted(ends, at, side="right")


def pairs(w: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Class before * CLASSES + class for each of the words of texts."""
    now = (w >> IN_CLASS).astype(np.int64)
    before = np.full(len(now), CLASSES, np.int64)
    same = doc[1:] == doc[:-1]
    before[1:][same] = now[:-1][same]
    return before * CLASSES + now


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Parts of a list of about CHUNK bytes, with the place of their first text."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if texts:
        yield first, texts[first:]


ROW = "range int, keys binary, counts binary"


def _row(r: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([packed(keys, deltas=True)], pa.binary()), pa.array([packed(counts)], pa.binary())], names=["range", "keys", "counts"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SPACE, np.int64)
    for batch in pieces(batches, "__text", CHUNK):
        total += np.bincount(pairs(*words(batch.column(0).cast(pa.binary()).fill_null(b"").to_pylist())), minlength=SPACE)
        del batch
    at = np.flatnonzero(total)
    give_back()
    cuts = np.searchsorted(at, np.arange(RANGES + 1) * SPACE // RANGES)
    for r in range(RANGES):
        if cuts[r] < cuts[r + 1]:
            part = at[cuts[r]:cuts[r + 1]]
            yield _row(r, part, total[part])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range: one row for each range, counts added up."""
    now, total, size = None, np.zeros(0, np.int64), -(-SPACE // RANGES) + 1
    for batch in batches:
        for r, k, c in zip(*(batch.column(x).to_pylist() for x in range(3)), strict=True):
            if r != now:
                if now is not None:
                    at = np.flatnonzero(total)
                    yield _row(now, at + now * SPACE // RANGES, total[at])
                now, total = r, np.zeros(size, np.int64)
            total[unpacked(k, np.int64, deltas=True) - r * SPACE // RANGES] += unpacked(c, np.int64)
    if now is not None:
        at = np.flatnonzero(total)
        yield _row(now, at + now * SPACE // RANGES, total[at])


def discounts(n: list[int]) -> np.ndarray:
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return np.array([0.0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k - 0.1) if n[k - 1] and n[k] else 0.5 * k for k in (1, 2, 3)])


class WordModel:
    """Sorted codes of pairs with their counts; of each first class its total and followers counted 1, 2 and more; of each class how many it follows."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.codes, self.counts = codes.astype(np.int32), np.minimum(counts, 2**31 - 1).astype(np.int32)
        by_count = lambda n: [int((n == k).sum()) for k in range(1, 5)]
        before, now = np.divmod(self.codes, np.int32(CLASSES))
        self.context = np.stack([np.bincount(before, x, CLASSES + 1) for x in (self.counts, self.counts == 1, self.counts == 2, self.counts > 2)])
        self.heads = np.bincount(now, minlength=CLASSES)
        self.pair_discounts, self.word_discounts = discounts(by_count(self.counts)), discounts(by_count(self.heads))
        self.left = float(self.word_discounts[np.minimum(self.heads, 3)].sum())
        self.vocabulary = int((self.heads > 0).sum()) + 1  # with one place for unknown words
        self._dense: np.ndarray | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_dense"}

    def __setstate__(self, state):
        self.__dict__ = state | {"_dense": None}

    def count(self, asked: np.ndarray) -> np.ndarray:
        if self._dense is None:  # the sorted array spread out once in a worker
            self._dense = np.zeros(SPACE, np.int32)
            self._dense[self.codes] = self.counts
        return self._dense[asked].astype(np.int64)

    def log_perplexity(self, texts: list[bytes]) -> np.ndarray:
        """Of each text of the table for a word, by the counts of all other texts; NaN of one without words."""
        return np.concatenate([*(self.of_words(*words(some), len(some)) for _, some in _chunks(texts)), np.zeros(0)])

    def of_words(self, w: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
        """The same of so many texts, given their words."""
        out = np.full(texts, np.nan)
        if not len(w):
            return out
        code = pairs(w, doc)
        key, own = np.unique(doc * SPACE + code, return_counts=True)
        doc, code = np.divmod(key, SPACE)
        before, now = np.divmod(code, CLASSES)
        count = self.count(code)
        rest = np.maximum(count - own, 0)
        start = np.concatenate([[True], (before[1:] != before[:-1]) | (doc[1:] != doc[:-1])])
        at, group = np.flatnonzero(start), np.cumsum(start) - 1
        total = self.context[0][before] - np.add.reduceat(own, at)[group]
        mass = np.zeros(len(code))
        for k in (1, 2, 3):  # a text's own pairs leave or change their class of counts
            was, stays = np.minimum(count, 3) == k, np.minimum(rest, 3) == k
            mass += self.pair_discounts[k] * (self.context[k][before] + np.add.reduceat(stays.astype(np.int64) - was, at)[group])
        gone = (rest == 0).astype(np.float64)
        _, of_word = np.unique(doc * CLASSES + now, return_inverse=True)
        heads = self.heads[now] - np.bincount(of_word, gone)[of_word]
        all_heads = np.maximum(len(self.codes) - np.bincount(doc, gone, texts)[doc], 0)
        kept = np.maximum(heads - self.word_discounts[np.clip(heads, 0, 3).astype(np.int64)], 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            low = np.where(all_heads > 0, (kept + self.left / self.vocabulary) / np.maximum(all_heads, 1), 1 / self.vocabulary)
            high = np.maximum(rest - self.pair_discounts[np.minimum(rest, 3)], 0)
            p = np.where(total > 0, (high + mass * low) / np.maximum(total, 1), low)
        logs, n = np.bincount(doc, own * np.log(np.maximum(p, 1e-300)), texts), np.bincount(doc, own, texts)
        out[n > 0] = -logs[n > 0] / n[n > 0]
        return out


def train(docs: DataFrame, text: str = "text") -> WordModel:
    added = docs.select(F.col(text).alias("__text")).mapInArrow(_count, ROW)
    rows = added.repartition(RANGES, "range").sortWithinPartitions("range").mapInArrow(_merge, ROW).toArrow().sort_by("range")  # bounded by the classes
    both = [[np.minimum(unpacked(b, np.int64, deltas=name == "keys"), 2**31 - 1).astype(np.int32) for b in rows[name].to_pylist()] for name in ("keys", "counts")]
    model = WordModel(*(np.concatenate([*x, np.zeros(0, np.int32)]) for x in both))
    del rows, both
    give_back()
    return model
