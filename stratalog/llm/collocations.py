"""Phrase collocation mining: phrases of two to five words that stand together more often than their parts suggest.

Level by level, as Apriori does: a phrase can only be frequent if the phrase without its last word and the one without
its first are. Every frequent phrase of a level has a number, so a phrase of the next level is a pair of numbers, an
exact key of 64 bits. A level takes three passes over the text, which is held as positions and numbers only:

1. Candidates: mappers send the different pairs of every GATHER or so, dealt by their hash, each with a count of one
   byte. Pairs whose bytes together reach the least count, or one of which is full, get a minimal perfect hash with
   their keys beside it.
2. Counts: mappers look pairs up, verify the stored key, bincount their slots; the arrays are summed as a tree.
3. The text again, as positions and numbers of this level's frequent phrases.

What is broadcast has a bound: tables hold TABLE keys, more keys make more tables, each of which costs a pass more. What
finds the candidates grows with the text: as much is sent for every GATHER, however often it repeats elsewhere, and
buckets stay of one size up to 2 ** SKETCH_BITS of them. Counts of a phrase's parts are read by their numbers, from the
levels' tables.

Null texts are empty, a null language is `und` and so one with that name. Rows may repeat, and extra columns play no
part. Words may be of any length. An empty table, or one without a frequent phrase, gives no rows. Ranks, scores and
counts are exact while 1000 * a * n stays below 10 ** 38.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.llm.common import give_back, packed, pieces, read, shared_dir, unpacked
from stratalog.llm.perfect_hash import PerfectHash, mixed

LEAST, MOST_WORDS, PER_LANG = 100, 5, 2_000
#: Words of a table of words, and keys of a table of phrases, that is broadcast.
WORD_TABLE, TABLE = 500_000, 2_000_000
CHUNK = 1 << 13
#: Words of the text for each bucket of pairs, bits of a pair's hash that tell its bucket at most, and the full byte of a count.
BUCKET, SKETCH_BITS, MANY = 1 << 21, 12, 255
#: Bytes of text in a block, and entries that a task gathers before it merges them.
BLOCK, GATHER = 1 << 20, 1 << 19
#: Parts in which a tree's arrays are summed first, and in which a language's first phrases are found first.
PARTS = 32

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KIND = np.zeros(256, np.uint8)  # 0 in a word, 1 between words, 2 between pieces
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
STEP = 0x100000001B3

ENCODED = "pos binary, ids binary"
SUMS = "chunk int, counts binary"
PAIRS = "bucket int, keys binary, counts binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to rows (lang, text, codes): texts of a language in one, a line each, so that no piece spans two."""
    for batch in pieces(batches, "text", BLOCK):
        lang = batch["lang"].fill_null("und")
        for name in lang.unique():
            own = batch["text"].filter(pc.equal(lang, name)).fill_null("")
            joined = b"\n".join(x.as_buffer().to_pybytes() for x in own)
            yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([joined], pa.binary()), pa.nulls(1, pa.binary())], names=["lang", "text", "codes"])


def _words(text: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """A block's words, and their positions: next to each other only in one piece."""
    text = LOWER[text]
    kind = KIND[text]
    inside = kind == 0
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    positions = np.arange(len(starts)) + np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(text[inside])), positions


def _hashed(lang: str, words: pa.LargeStringArray, seed: int) -> np.ndarray:
    """64 bits of each word of a language."""
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    powers = np.cumprod(np.full(int(size.max()), STEP, np.uint64), dtype=np.uint64)
    within = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], size)
    sums = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[within], offsets[:-1] - offsets[0])
    base = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")
    return mixed(mixed(sums, seed) ^ mixed(size.astype(np.uint64) + np.uint64(base)), seed + 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (lang, word, n), summed over what a task gathers."""
    names = ["lang", "word", "n"]

    def merged(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(["lang", "word"]).aggregate([("n", "sum")]).rename_columns(names)

    held, many = [], 0
    for batch in _blocks(batches):
        for name, block in zip(batch["lang"].to_pylist(), batch["text"]):
            words, _ = _words(np.frombuffer(block.as_buffer(), np.uint8))
            found = words.value_counts()
            n = len(found)
            held.append(pa.table([pa.array([name] * n, pa.string()), found.field(0), found.field(1)], names=names))
            many += n
            if many > GATHER:
                held = [merged(held)]
                many = held[0].num_rows
                if many > GATHER // 2:
                    yield from held[0].cast(pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])).to_batches(max_chunksize=65_536)
                    held, many = [], 0
    if held:
        yield from merged(held).cast(pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])).to_batches(max_chunksize=65_536)
    held = []
    give_back()


class WordTable:
    """Frequent words with numbers from `base` on: a perfect hash of their hashes, and the words to verify."""

    def __init__(self, langs: list[str], words: pa.LargeStringArray, base: int):
        self.base, self.seed = base, 0
        codes = pa.array(langs, pa.string()).dictionary_encode()
        self.names, lang = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
        while True:
            keys = np.empty(len(words), np.uint64)
            for i, name in enumerate(self.names):
                own = lang == i
                keys[own] = _hashed(name, words.filter(pa.array(own)), self.seed)
            if len(np.unique(keys)) == len(keys):
                break
            self.seed += 2
        self.hash = PerfectHash(keys)
        slots = self.hash.slots(keys)
        order = np.empty(len(keys), np.int64)
        order[slots] = np.arange(len(keys))
        self.words, self.lang = words.take(pa.array(order)), lang[order].astype(np.int32)

    def ids(self, lang: str, words: pa.LargeStringArray) -> np.ndarray:
        """The number of each word of a language, or -1."""
        if lang not in self.names or not len(words):
            return np.full(len(words), -1)
        slots = self.hash.slots(_hashed(lang, words, self.seed))
        at = np.flatnonzero(slots >= 0)
        same = pc.equal(self.words.take(pa.array(slots[at])), words.take(pa.array(at))).to_numpy(zero_copy_only=False)
        at = at[same & (self.lang[slots[at]] == self.names.index(lang))]
        out = np.full(len(words), -1)
        out[at] = self.base + slots[at]
        return out


def _encoded(positions: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    there = ids >= 0
    return pa.RecordBatch.from_arrays(
        [pa.array([packed(positions[there].astype(np.int32), deltas=True)], pa.binary()), pa.array([packed(ids[there].astype(np.int32))], pa.binary())], names=["pos", "ids"])


def _word_codes(batches: Iterator[pa.RecordBatch], table: Broadcast, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """Blocks, made of texts at first, with the numbers of a table's words; after the last table, positions and numbers alone."""
    for batch in _blocks(batches) if first else batches:
        for name, block, before in zip(batch["lang"].to_pylist(), batch["text"], batch["codes"]):
            words, positions = _words(np.frombuffer(block.as_buffer(), np.uint8))
            distinct = words.dictionary_encode()
            codes = table.value.ids(name, distinct.dictionary)[distinct.indices.to_numpy(zero_copy_only=False)]
            if before.is_valid:
                codes = np.maximum(codes, unpacked(before.as_py(), np.int64))
            if last:
                yield _encoded(positions, codes)
            else:
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block.as_py()], pa.binary()), pa.array([packed(codes)], pa.binary())], names=["lang", "text", "codes"])
    give_back()


def _numbered(batches: Iterator[pa.RecordBatch], table: Broadcast) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of a table's words with their numbers."""
    for batch in batches:
        ids, lang = np.full(batch.num_rows, -1), batch["lang"]
        for name in lang.unique().to_pylist():
            own = np.flatnonzero(pc.equal(lang, name).to_numpy(zero_copy_only=False))
            ids[own] = table.value.ids(name, batch["word"].take(pa.array(own)).cast(pa.large_string()))
        yield pa.RecordBatch.from_arrays([pa.array(ids), lang, batch["word"], batch["n"]], names=["id", "lang", "word", "n"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for pos, ids in zip(batch["pos"], batch["ids"]):
            yield unpacked(pos.as_py(), np.int32, deltas=True), unpacked(ids.as_py(), np.int32)


def _keys(pos: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a phrase is followed by one that begins a word later, and the pairs' keys."""
    at = np.flatnonzero(pos[1:] == pos[:-1] + 1)
    return pos[at], (ids[at].astype(np.uint64) << np.uint64(32)) | ids[at + 1].astype(np.uint64)


def _chunks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """An array as rows (chunk, part, counts), without chunks of zeros."""
    part = TaskContext.get().partitionId() % PARTS
    for i in range(0, len(counts), CHUNK):
        if (own := counts[i : i + CHUNK]).any():
            yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK], pa.int32()), pa.array([part], pa.int32()), pa.array([packed(own)], pa.binary())], names=["chunk", "part", "counts"])


def _pairs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The different keys of every GATHER or so, dealt by their hash, with counts of one byte, which stop at MANY."""
    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        bucket = (mixed(keys) >> np.uint64(64 - bits)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        keys, counts, bucket = keys[order], np.minimum(counts[order], MANY).astype(np.uint8), bucket[order]
        starts = np.flatnonzero(np.diff(bucket, prepend=np.uint16(bucket[0] + 1)))
        rows = [(int(bucket[a]), packed(keys[a:b], deltas=True), packed(counts[a:b])) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)])]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "keys", "counts"])

    held, many = [], 0
    for pos, ids in _rows(batches):
        _, keys = _keys(pos, ids)
        held.append(keys)
        many += len(keys)
        if many > GATHER:
            yield from flush(held)
            held, many = [], 0
    if many:
        yield from flush(held)
    held = []
    give_back()


def _candidates(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Keys, sorted by bucket, whose counts together may reach the least."""
    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        return keys[starts], np.minimum(np.add.reduceat(counts[order], starts), least)

    def out(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, counts = merged(held)
        if len(keys := keys[counts >= least]):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

    now, held, many, most = None, [], 0, 2 * GATHER
    for batch in batches:
        for bucket, keys, counts in zip(batch["bucket"].to_pylist(), batch["keys"], batch["counts"]):
            if held and bucket != now:
                yield from out(held)
                held, many, most = [], 0, 2 * GATHER
            now, counts = bucket, unpacked(counts.as_py(), np.uint8).astype(np.int64)
            held.append((unpacked(keys.as_py(), np.uint64, deltas=True), np.where(counts == MANY, least, counts)))
            many += len(counts)
            if many > most:
                held = [merged(held)]
                many = len(held[0][0])
                most = max(most, 2 * many)
    if held:
        yield from out(held)
    held = []
    give_back()


def _slot_counts(batches: Iterator[pa.RecordBatch], table: Broadcast) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(len(table.value), np.int64)
    for pos, ids in _rows(batches):
        slots = table.value.slots(_keys(pos, ids)[1])
        counts += np.bincount(slots[slots >= 0], minlength=len(counts))
    yield from _chunks(counts)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (chunk, part) to one row each."""
    key = total = None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([0], pa.int32()), pa.array([packed(total)], pa.binary())], names=["chunk", "part", "counts"])

    for batch in batches:
        for *this, counts in zip(batch["chunk"].to_pylist(), batch["part"].to_pylist(), batch["counts"]):
            counts = unpacked(counts.as_py(), np.int64)
            if this == key:
                total += counts
            else:
                if key:
                    yield out()
                key, total = this, counts.copy()
    if key:
        yield out()


def tree_sum(parts: DataFrame) -> DataFrame:
    """Rows (chunk, part, counts) summed to one for each chunk: first by part, then the parts."""
    for keys in (("chunk", "part"), ("chunk",)):
        parts = parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_added, f"chunk int, part int, {SUMS.split(', ')[1]}")
    return parts


def _reached(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [np.packbits(unpacked(c.as_py(), np.int64) >= least, bitorder="little").tobytes() for c in batch["counts"]]
        yield pa.RecordBatch.from_arrays([batch["chunk"], pa.array(bits, pa.binary())], names=["chunk", "counts"])


def _bits(sums: DataFrame, size: int, least: int) -> np.ndarray:
    """A bit for each count that reaches the least; as many bits as a table has keys or cells, which is bounded."""
    out = np.zeros(-(-size // CHUNK) * CHUNK // 8, np.uint8)
    for chunk, bits in sums.mapInArrow(partial(_reached, least=least), SUMS).collect():
        own = np.frombuffer(bits, np.uint8)
        out[chunk * CHUNK // 8 : chunk * CHUNK // 8 + len(own)] = own
    return out


def _frequent(batches: Iterator[pa.RecordBatch], table: Broadcast, base: int, least: int) -> Iterator[pa.RecordBatch]:
    """Sums of slots to the frequent phrases: number, those of the parts, count."""
    for batch in batches:
        for chunk, counts in zip(batch["chunk"].to_pylist(), batch["counts"]):
            counts = unpacked(counts.as_py(), np.int64)
            slots = chunk * CHUNK + np.flatnonzero(counts >= least)
            keys = table.value.keys[slots]
            yield pa.RecordBatch.from_arrays(
                [pa.array(base + slots), pa.array((keys >> np.uint64(32)).astype(np.int64)), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(counts[counts >= least])], names=["id", "prefix", "suffix", "n"])


def _phrase_codes(batches: Iterator[pa.RecordBatch], table: Broadcast, frequent: Broadcast, base: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows with the numbers of a table's frequent phrases; after the last table, the new positions and numbers alone."""
    for batch in batches:
        before = batch["codes"] if "codes" in batch.schema.names else [None] * batch.num_rows
        for row, old in zip(zip(batch["pos"].to_pylist(), batch["ids"].to_pylist()), before):
            pos, keys = _keys(unpacked(row[0], np.int32, deltas=True), unpacked(row[1], np.int32))
            slots = table.value.slots(keys)
            codes, at = np.full(len(slots), -1), np.flatnonzero(slots >= 0)
            at = at[(frequent.value[slots[at] >> 3] >> (slots[at] & 7).astype(np.uint8)) & 1 == 1]
            codes[at] = base + slots[at]
            if old is not None and old.is_valid:
                codes = np.maximum(codes, unpacked(old.as_py(), np.int64))
            if last:
                yield _encoded(pos, codes)
            else:
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.binary()), pa.array([row[1]], pa.binary()), pa.array([packed(codes)], pa.binary())], names=["pos", "ids", "codes"])


def _numbers_fit(n: int) -> None:
    if n >= 2**31:
        raise ValueError("numbers of phrases have 31 bits")


class Miner:
    """The levels of one table of documents, in a folder that all executors share."""

    def __init__(self, docs: DataFrame, least: int, text: str, lang: str):
        self.spark, self.least = docs.sparkSession, least
        self.folder = f"{shared_dir(self.spark)}/collocations-{uuid.uuid4().hex}"
        self.docs = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def dropped(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def words(self) -> tuple[DataFrame, DataFrame, int]:
        """Frequent words as phrases of level one, words of each language, and all words."""
        counted = self.stored(self.docs.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
        totals = self.stored(counted.groupBy("lang").agg(F.sum("n").alias("words")), "totals")
        frequent = counted.where(F.col("n") >= self.least)
        many, words = frequent.count(), totals.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
        _numbers_fit(many)
        tables, base, levels, coded = max(1, -(-many // WORD_TABLE)), 0, [], self.docs
        for t in range(tables if many else 0):
            own = frequent.where(F.pmod(F.xxhash64("lang", "word"), F.lit(tables)) == t)
            rows = own.select("lang", "word").toArrow()  # bounded
            table = WordTable(rows["lang"].to_pylist(), rows["word"].combine_chunks().cast(pa.large_string()), base)
            base += len(rows)
            sent, last = self.spark.sparkContext.broadcast(table), t == tables - 1
            levels.append(own.mapInArrow(partial(_numbered, table=sent), "id long, lang string, word string, n long"))
            coded = coded.mapInArrow(partial(_word_codes, table=sent, first=t == 0, last=last), ENCODED if last else "lang string, text binary, codes binary")
        none = F.array().cast("array<long>")
        level = levels[0] if levels else self.spark.createDataFrame([], "id long, lang string, word string, n long")
        for more in levels[1:]:
            level = level.unionByName(more)
        level = self.stored(level.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", none.alias("heads"), none.alias("tails"), F.lit(None).cast("long").alias("prefix"), F.lit(None).cast("long").alias("suffix")), "level1")
        if levels:
            self.encoded = self.stored(coded, "text1")
        self.dropped("words")
        return level, totals, words if many else 0

    def next(self, level: int, before: DataFrame, words: int) -> DataFrame | None:
        """The frequent phrases of a level, or None if there are none."""
        bits = min(SKETCH_BITS, max(8, math.ceil(math.log2(max(words, 1) / BUCKET))))
        pairs = self.encoded.mapInArrow(partial(_pairs, bits=bits), PAIRS).repartition("bucket").sortWithinPartitions("bucket")
        keys = self.stored(pairs.mapInArrow(partial(_candidates, least=self.least), "key long"), f"keys{level}")
        many = keys.count()
        _numbers_fit(many)
        if not many:
            return None
        tables, base, found, coded = -(-many // TABLE), 0, [], self.encoded
        for t in range(tables):
            own = keys.where(F.pmod(F.xxhash64("key"), F.lit(tables)) == t).toArrow()["key"].to_numpy()  # bounded
            table = PerfectHash(own.view(np.uint64))
            sent, last = self.spark.sparkContext.broadcast(table), t == tables - 1
            sums = self.stored(tree_sum(self.encoded.mapInArrow(partial(_slot_counts, table=sent), f"chunk int, part int, {SUMS.split(', ')[1]}")), f"sums{level}-{t}")
            found.append(sums.mapInArrow(partial(_frequent, table=sent, base=base, least=self.least), "id long, prefix long, suffix long, n long"))
            frequent = self.spark.sparkContext.broadcast(_bits(sums, len(table), self.least))
            coded = coded.mapInArrow(partial(_phrase_codes, table=sent, frequent=frequent, base=base, last=last), ENCODED if last else f"{ENCODED}, codes binary")
            base += len(table)
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more)
        first = before.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("begins"), F.concat("heads", F.array("n")).alias("heads"))
        rest = before.select(F.col("id").alias("suffix"), "last", F.concat("tails", F.array("n")).alias("tails"))
        phrases = rows.join(first, "prefix").join(rest, "suffix").select("id", "lang", F.concat_ws(" ", "begins", "last").alias("phrase"), "last", "n", "heads", "tails", "prefix", "suffix")
        phrases = self.stored(phrases, f"level{level}")
        if level < MOST_WORDS:
            self.encoded = self.stored(coded, f"text{level}")
        for name in (f"text{level - 1}", f"keys{level}"):
            self.dropped(name)
        return phrases


def mine(docs: DataFrame, *, least: int = LEAST, first: int = PER_LANG, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first collocations."""
    miner = Miner(docs, least, text, lang)
    level, totals, words = miner.words()
    levels = []
    while words and len(levels) < MOST_WORDS - 1 and (level := miner.next(len(levels) + 2, level, words)) is not None:
        levels.append(level)
    if not levels:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    kept = []
    for number, level in enumerate(levels, 2):
        if number - 1 < len(levels):
            # a longer phrase of the same count, however long, has one of a word more in between
            longer = levels[number - 1]
            inside = longer.select(F.col("prefix").alias("id"), F.col("n").alias("m")).unionByName(longer.select(F.col("suffix").alias("id"), F.col("n").alias("m"))).groupBy("id").agg(F.max("m").alias("m"))
            level = level.join(inside, "id", "left").where(F.col("m").isNull() | (F.col("m") < F.col("n")))
        cuts = F.array(*[F.struct(F.lit(k).alias("k"), F.element_at("heads", k).alias("l"), F.element_at("tails", number - k).alias("r")) for k in range(1, number)])
        kept.append(level.select("lang", "phrase", F.col("n").alias("a"), cuts.alias("cuts")))
    scored = kept[0]
    for more in kept[1:]:
        scored = scored.unionByName(more)
    scored = scored.join(totals.select("lang", F.col("words").alias("n")), "lang")
    score = "(CAST(1000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(18,0)) * CAST(n AS DECIMAL(18,0))) div (CAST(x.l AS DECIMAL(18,0)) * CAST(x.r AS DECIMAL(18,0)))"
    scored = scored.withColumn("cut", F.array_min(F.expr(f"transform(cuts, x -> struct({score} AS score, x.k AS k, x.l AS l, x.r AS r))")))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    scored = scored.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= first).drop("rank")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read(spark, sf_dir, "documents"))


#: The contract by counting every phrase.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d)),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (SELECT lang, k, list_slice(w, i, i + k - 1) AS g FROM starts, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, g, count(*) AS a FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY 1),
cand AS (SELECT * FROM f WHERE k > 1 AND a >= 100),
parts AS (SELECT lang, g, a, k, unnest(range(2, k)) AS m FROM cand),
inside AS (SELECT DISTINCT lang, list_slice(g, i, i + m - 1) AS g, a FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM parts)),
gone AS (SELECT DISTINCT c.lang, c.g FROM cand c JOIN inside s ON s.lang = c.lang AND s.g = c.g WHERE 100 * s.a >= 100 * c.a),
cut AS (SELECT lang, g, k, a, unnest(range(1, k)) AS c FROM cand),
scored AS (SELECT cut.lang, cut.g, cut.c, cut.a, x.a AS l, y.a AS r, n, (1000::HUGEINT * cut.a::HUGEINT * n::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT) AS score FROM cut
    JOIN f x ON x.lang = cut.lang AND x.g = list_slice(cut.g, 1, cut.c) JOIN f y ON y.lang = cut.lang AND y.g = list_slice(cut.g, cut.c + 1, cut.k) JOIN total ON total.lang = cut.lang),
least AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, c) AS o FROM scored),
best AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM least ANTI JOIN gone USING (lang, g) WHERE o = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""
