"""Byte-level BPE encoding and decoding.

Encoding: each text is cut by the pre-token pattern on the JVM. A segment is a
run of rows of one task; it sends each of its distinct pre-tokens once, by hash,
so that those of all segments meet and a word of the whole table is one byte
array. Higher-order functions fold the ranked merges over these byte arrays,
with the rank map as a literal: a table by hash and displacement from (left id,
right id) to the merged rank, found by two array reads. The ids return to the
segments, whose word numbers went the same way once and compressed; texts are
never shuffled, and no key holds more than a segment's or a bucket's words.
Decoding maps ids to their binary pieces and concatenates them.

The fold's steps grow with the square of a word's length, so pre-tokens of more
than LONG bytes are merged by rank-synchronous rounds over arrays instead.

Null texts count as empty (no ids); a very long text is encoded whole, in a
segment of its own; repeated rows give repeated results; an empty table gives an
empty result; other columns are left out but for those asked for, and one asked
for under the name of a result is refused.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from stratalog.llm.common import give_back, packed, ragged, unpacked

#: Distinct words and bytes of text of a segment, about; a longer text stands alone. They bound memory, never results.
SEGMENT_WORDS, SEGMENT_BYTES = 1_500_000, 40 << 20
#: Bytes of pre-tokens numbered at a time.
CHUNK_BYTES = 3 << 20
#: Distinct words in a row that is folded, and the longest of them in bytes.
ROW_WORDS, LONG = 64_000, 400
#: Bytes of a table for each partition that words are dealt to, and buckets of words in one.
PARTITION_BYTES, PARTITION_BUCKETS = 32 << 20, 3
_SLOTS, _BUCKETS, _ODD = 1 << 16, 1 << 14, 10087
_NONE = 1 << 20  # a rank above all others


def default_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) -> rank, for the one merge by which each listed piece comes about.

    Merges within a piece's bytes go on as if the piece stood alone until one
    crosses its ends, so no other two of its parts ever stand side by side.
    """
    found = {}
    for piece, rank in ranks.items():
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            least, at = min(((ranks.get(a + b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(_NONE, 0))
            if least >= rank:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            found[ranks[parts[0]], ranks[parts[1]]] = rank
    return found


def _displaced(pairs: dict[tuple[int, int], int], odd: int) -> tuple[list[int], list[int]] | None:
    """Slots and each bucket's displacement for one multiplier; none if two pairs of a bucket always meet."""
    buckets: dict[int, list[tuple[int, int]]] = {}
    for left, right in pairs:
        buckets.setdefault((left * _ODD + right) & _BUCKETS - 1, []).append((left, right))
    if any(len({(right * odd + left) & _SLOTS - 1 for left, right in x}) < len(x) for x in buckets.values()):
        return None
    slots, displaced = [-1] * _SLOTS, [0] * _BUCKETS
    for bucket in sorted(buckets, key=lambda x: (-len(buckets[x]), x)):
        for d in range(_SLOTS):
            at = [(right * odd + left + d) & _SLOTS - 1 for left, right in buckets[bucket]]
            if all(slots[i] < 0 for i in at):
                break
        else:
            return None
        displaced[bucket] = d
        for i, (left, right) in zip(at, buckets[bucket], strict=True):
            slots[i] = (left << 16 | right) << 16 | pairs[left, right]
    return slots, displaced


@cache
def literal_map(path: str) -> tuple[list[int], list[int], list[int], int]:
    """The rank map by hash and displacement, the id of each byte, and the hash's multiplier.

    A pair's bucket gives a displacement, that and the pair its slot, where the
    pair itself stands with its rank: a lookup is two array reads.
    """
    ranks = load_ranks(path)
    if max(ranks.values()) >= 1 << 16:
        raise ValueError("ids must fit 16 bits")
    pairs = pair_ranks(ranks)
    if len(pairs) + 256 != len(ranks):
        raise ValueError("every listed piece must come about by merges")
    for odd in range(17779, 17779 + 2000, 2):
        if found := _displaced(pairs, odd):
            return *found, [ranks[bytes([b])] for b in range(256)], odd
    raise ValueError("the rank map does not fit its table")


@cache
def piece_hex(path: str) -> list[str]:
    """Each id's piece, in hex."""
    ranks = load_ranks(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    return pieces


def _bind(value: Column, body) -> Column:
    """Evaluates a value once and gives it to body as a variable."""
    return F.get(F.transform(F.array(value), body), 0)


def _if(condition: Column, yes: Column, no: Column) -> Column:
    """Evaluated by interpretation, as lambdas are, it is cheaper than CASE WHEN."""
    return F.call_function("if", condition, yes, no)


def merged_ids(words: Column, path: str) -> Column:
    """Folds ranked merges over each byte array of an array of words; gives each word's ids.

    A byte stands as 256 * byte + next byte, the last one as 65536 + byte.

    The literal map is a text that each row of words parses once; it stands in
    every description of the plan, so it is kept small.

    A word's state holds one long for each symbol: the rank of the pair it forms
    with the next one, then its id; the least rank, at its first place, is next.
    """
    slots, displaced, single, odd = literal_map(path)
    text = json.dumps({"m": slots, "d": displaced, "s": single}, separators=(",", ":"))
    unfolded = F.substring(F.size(words).cast("string"), 1, 0)
    literal = F.from_json(F.concat(F.lit(text), unfolded), "m array<bigint>, d array<bigint>, s array<bigint>")

    def encode(t: Column) -> Column:
        none = F.lit(_NONE << 16)

        def partner(left: Column, right: Column) -> Column:
            """The rank of a pair, as it stands in a state's long."""
            key = F.shiftleft(left, 16).bitwiseOR(right)
            moved = F.get(t["d"], (left * _ODD + right).bitwiseAND(_BUCKETS - 1).cast("int"))
            slot = F.get(t["m"], (right * odd + left + moved).bitwiseAND(_SLOTS - 1).cast("int"))
            return _if(F.shiftright(slot, 16) == key, F.shiftleft(slot.bitwiseAND(65535), 16), none)

        def merge(state: Column, _: Column) -> Column:
            def at(least: Column) -> Column:
                rank = F.shiftright(least, 27)

                def join(p: Column) -> Column:  # p: 1-based place of the left symbol
                    follower = F.get(state, p + 1)
                    joined = _if(follower.isNull(), none, partner(rank, follower.bitwiseAND(65535))).bitwiseOR(rank)
                    id_before = F.get(state, p - 2).bitwiseAND(65535)
                    pair = _if(p == 1, F.array(joined), F.array(partner(id_before, rank).bitwiseOR(id_before), joined))
                    return F.flatten(F.array(F.slice(state, F.lit(1), F.greatest(p - 2, F.lit(0))), pair, F.slice(state, p + 2, F.size(state))))

                return _if(rank >= _NONE, state, _bind((least.bitwiseAND((1 << 27) - 1) + 1).cast("int"), join))

            # rank and place in one number; array_position leaves its loop by an exception, which costs far more
            return _bind(F.array_min(F.transform(state, lambda x, i: F.shiftleft(F.shiftright(x, 16), 27).bitwiseOR(i.cast("long")))), at)

        def word(w: Column) -> Column:
            def start(x: Column) -> Column:
                last = x >= 65536
                own = F.get(t["s"], _if(last, x - 65536, F.shiftright(x, 8)))
                return _if(last, none.bitwiseOR(own), partner(own, F.get(t["s"], x.bitwiseAND(255))).bitwiseOR(own))

            state = F.transform(w, start)
            ids = lambda s: F.transform(s, lambda x: x.bitwiseAND(65535).cast("int"))
            return _if(F.size(w) <= 1, ids(state), F.aggregate(F.sequence(F.lit(2), F.size(w)), state, merge, ids))

        return F.transform(words, word)

    return _bind(literal, encode)


#: What segments send: words of a bucket (kind 0), or rows with the numbers of their words (kind 1).
_SENT = "key long, kind int, segment long, data binary, numbers binary"
#: Distinct words of a bucket, with the segments and numbers they have there.
_FOLDED = "words array<array<int>>, long array<array<int>>, segments array<struct<key: long, numbers: binary, words: array<int>>>"
#: Keys of segments start here, those of buckets lie below.
_SEGMENTS = 1 << 40


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as stream:
        return stream.read_next_batch()


def _sent(key: int, kind: int, segment: int, data: bytes, numbers: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([key]), pa.array([kind], pa.int32()), pa.array([segment]), pa.array([data], pa.binary()), pa.array([numbers], pa.binary())], names=["key", "kind", "segment", "data", "numbers"])


def _segments(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of (key columns, __words) to rows of _SENT; words are numbered within their segment."""
    key = _SEGMENTS + (TaskContext.get().partitionId() << 20)
    seen, held = pa.array([], pa.string()), 0

    def words() -> Iterator[pa.RecordBatch]:
        raw = seen.cast(pa.binary())
        bucket = np.fromiter(map(zlib.crc32, raw.to_pylist()), np.uint32, len(raw)) % np.uint32(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[k]:cuts[k + 1]]
            yield _sent(int(k), 0, key, _ipc(pa.RecordBatch.from_arrays([raw.take(pa.array(at))], names=["w"])), packed(at.astype(np.int32), deltas=True))

    for batch in batches:
        words_at = batch.schema.get_field_index("__words")
        keys = batch.remove_column(words_at)
        column = batch.column(words_at)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        values = column.flatten()
        sizes = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset) if len(values) else np.zeros(1, np.int32)
        row, part, rows = 0, None, None
        while row < batch.num_rows:
            first = int(ends[row - 1]) if row else 0
            stop = max(row + 1, int(np.searchsorted(sizes[ends], sizes[first] + CHUNK_BYTES, "right")))
            stop = min(stop, batch.num_rows)
            part = values.slice(first, int(ends[stop - 1]) - first).dictionary_encode()
            if len(seen) > SEGMENT_WORDS or held > SEGMENT_BYTES:
                yield from words()
                seen, held, key = pa.array([], pa.string()), 0, key + 1
            held += int(sizes[ends[stop - 1]]) - int(sizes[first])
            known = pc.index_in(part.dictionary, value_set=seen) if len(seen) else pa.nulls(len(part.dictionary), pa.int32())
            new = pc.is_null(known)
            added = part.dictionary.filter(new)
            number = known.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32, copy=True)
            number[new.to_numpy(zero_copy_only=False)] = len(seen) + np.arange(len(added), dtype=np.int32)
            seen = pa.concat_arrays([seen, added])
            numbers = number[part.indices.to_numpy()] if len(part) else np.zeros(0, np.int32)
            counts = np.diff(np.concatenate([[first], ends[row:stop]])).astype(np.int32)
            rows = keys.slice(row, stop - row).append_column("__count", pa.array(counts))
            yield _sent(key, 1, key, _ipc(rows), packed(np.ascontiguousarray(numbers)))
            row = stop
        # else the next batch is read while this one is still held
        del batch, keys, column, values, sizes, part, rows
    yield from words()
    del seen
    give_back()


def _distinct(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Rows of _SENT, sorted by key, to rows of _FOLDED: the words of a bucket once, and who asked for them."""
    now, held = None, []
    for batch in batches:
        for key, kind, segment, data, numbers in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            if kind:
                continue
            if key != now and held:
                yield from _bucket(held, path)
                held = []
            now = key
            held.append((segment, _read(data).column(0), unpacked(numbers, np.int32, deltas=True)))
    if held:
        yield from _bucket(held, path)
    del held
    give_back()


def _bucket(held: list[tuple[int, pa.Array, np.ndarray]], path: str) -> Iterator[pa.RecordBatch]:
    every = pa.concat_arrays([w for _, w, _ in held]).dictionary_encode()
    at = every.indices.to_numpy()
    segment = np.repeat(np.array([s for s, _, _ in held], np.int64), [len(w) for _, w, _ in held])
    number = np.concatenate([n for _, _, n in held])
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(0, len(every.dictionary) + ROW_WORDS, ROW_WORDS))
    for i, lo in enumerate(range(0, len(every.dictionary), ROW_WORDS)):
        part = every.dictionary.slice(lo, ROW_WORDS)
        raw = part.to_pylist()
        long = [merged_long(w, path) if len(w) > LONG else None for w in raw] if max(map(len, raw)) > LONG else None
        short = raw if long is None else [b"" if ids is not None else w for w, ids in zip(raw, long, strict=True)]
        spans = np.concatenate([[0], np.cumsum(list(map(len, short)))]).astype(np.int32)
        data = np.frombuffer(b"".join(short), np.uint8).astype(np.int32)
        last = spans[1:][spans[1:] > spans[:-1]] - 1
        paired = 256 * data
        paired[:-1] += data[1:]
        paired[last] = 65536 + data[last]
        asked = order[cuts[i]:cuts[i + 1]]
        asked = asked[np.argsort(segment[asked], kind="stable")]
        ends = np.append(np.flatnonzero(np.diff(segment[asked])) + 1, len(asked)).astype(np.int32)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int32)
        who = pa.StructArray.from_arrays([
            pa.array(segment[asked[starts]]), pa.array([packed(number[asked[x:y]]) for x, y in zip(starts, ends, strict=True)], pa.binary()),
            pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1])), pa.array((at[asked] - lo).astype(np.int32)))], names=["key", "numbers", "words"])
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        done = pa.array([long], pa.list_(pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays([one(pa.ListArray.from_arrays(pa.array(spans), pa.array(paired))), done, one(who)], names=["words", "long", "segments"])


@cache
def _sorted_pairs(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left << 20 | right) of all listed pairs, in order, their ranks, and the id of each byte."""
    ranks = load_ranks(path)
    pairs = pair_ranks(ranks)
    keys = np.fromiter((a << 20 | b for a, b in pairs), np.int64, len(pairs))
    order = np.argsort(keys)
    return keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order], np.array([ranks[bytes([b])] for b in range(256)], np.int64)


def merged_long(word: bytes, path: str) -> list[int]:
    """Ids of one long word: a round merges all places of the least rank, from the left."""
    keys, ranks, single = _sorted_pairs(path)

    def ranked(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, ranks[at], _NONE)

    ids = single[np.frombuffer(word, np.uint8)]
    pair = ranked(ids[:-1], ids[1:])
    while len(pair) and (least := pair.min()) < _NONE:
        hit = np.flatnonzero(pair == least)
        if len(hit) > 1:  # of places in a row, which share a symbol, every other one
            run = np.concatenate([[0], np.flatnonzero(np.diff(hit) > 1) + 1])
            nth = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[nth % 2 == 0]
        ids[hit] = least
        ids = np.delete(ids, hit + 1)
        pair = np.delete(pair, hit)  # the pair at a merged place goes; its neighbours are ranked anew
        place = hit - np.arange(len(hit))
        again = np.unique(np.concatenate([place, place - 1]))
        again = again[(again >= 0) & (again < len(pair))]
        pair[again] = ranked(ids[again], ids[again + 1])
    return ids.tolist()


def _answers(words: DataFrame, path: str) -> DataFrame:
    """Folds each bucket's words; a row for each segment that asked: (key, numbers, sizes, ids)."""

    def told(ids: Column) -> Column:
        of = lambda w: F.coalesce(F.get(F.col("long"), w), F.get(ids, w))
        return F.transform("segments", lambda s: F.struct(
            s["key"].alias("key"), s["numbers"].alias("numbers"), F.transform(s["words"], lambda w: F.size(of(w))).alias("sizes"), F.flatten(F.transform(s["words"], of)).alias("ids")))

    return words.select(F.explode(_bind(merged_ids(F.col("words"), path), told)).alias("a")).select("a.*")


@cache
def _tables(path: str) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]:
    """For each id its piece, and its decimal number with a space after it: bytes, starts, lengths."""
    pieces = [bytes.fromhex(p) for p in piece_hex(path)]
    out = []
    for table in (pieces, [b"%d " % i for i in range(len(pieces))]):
        n = np.array(list(map(len, table)), np.int64)
        out.append((np.frombuffer(b"".join(table), np.uint8), np.cumsum(n) - n, n))
    return tuple(out)


def decode_bytes(ids: np.ndarray, path: str) -> bytes:
    """Concatenates the ids' binary pieces."""
    data, start, size = _tables(path)[0]
    return data[ragged(start[ids], size[ids])].tobytes()


def _digests(ids: np.ndarray, path: str) -> tuple[str, str]:
    data, start, size = _tables(path)[1]
    spelled = data[ragged(start[ids], size[ids])].tobytes()[:-1]
    return hashlib.sha256(spelled).hexdigest(), hashlib.sha256(decode_bytes(ids, path)).hexdigest()


def _rows(sent: pa.Table, answers: pa.Table, path: str, ids_kept: bool, digested: bool, schema: pa.Schema) -> pa.Table:
    """One segment's rows and its words' ids to rows of (key columns, ids, n_tokens, ids_sha256, decoded_sha256)."""
    sent = sent.filter(pc.equal(sent["kind"], 1))
    if not sent.num_rows:
        return schema.empty_table()
    numbers = np.concatenate([*(unpacked(b, np.int32) for b in answers["numbers"].to_pylist()), np.zeros(0, np.int32)])
    sizes, flat = (answers[c].combine_chunks().flatten().to_numpy() for c in ("sizes", "ids"))
    lengths, starts = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
    lengths[numbers] = sizes
    starts[numbers] = np.cumsum(sizes, dtype=np.int64) - sizes
    out = []
    for data, packed_numbers in zip(sent["data"].to_pylist(), sent["numbers"].to_pylist(), strict=True):
        rows, asked = _read(data), unpacked(packed_numbers, np.int32)
        if len(asked) and int(asked.max()) >= len(numbers):
            raise RuntimeError("the rows of a segment changed while it was encoded")
        counts = rows.column(rows.num_columns - 1).to_numpy()
        rows = rows.remove_column(rows.num_columns - 1)
        each = lengths[asked]
        ids = flat[ragged(starts[asked], each)]
        upto = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        if ids_kept:
            rows = rows.append_column("ids", pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids)))
        if digested:
            both = [_digests(ids[a:b], path) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
            rows = rows.append_column("n_tokens", pa.array(np.diff(upto)))
            rows = rows.append_column("ids_sha256", pa.array([x for x, _ in both], pa.string())).append_column("decoded_sha256", pa.array([y for _, y in both], pa.string()))
        out.append(rows)
    del flat, lengths, starts, sizes, numbers, answers, sent
    give_back()
    return pa.Table.from_batches(out).cast(schema)


def _partitions(docs: DataFrame) -> int:
    """Partitions that words and segments are dealt to: by the table's size as the plan knows it."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # a plan that knows no size says so by an enormous one
    return max(least, size // PARTITION_BYTES) if size < 1 << 55 else least


def encode(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, pattern: str | None = None, ids: bool = True, digests: bool = False) -> DataFrame:
    """(kept columns, ids array<int>): each text's ids without special tokens.

    digests: adds n_tokens, ids_sha256 (of the decimal ids joined by one space)
    and decoded_sha256 (of the bytes that the ids decode to).
    """
    path, pattern = path or default_ranks_path(), pattern or default_pattern()
    if clash := set(keep) & {"ids", "n_tokens", "ids_sha256", "decoded_sha256"}:
        raise ValueError(f"columns of the result: {sorted(clash)}")
    # (?U): white space as Unicode has it
    cut = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("(?U)" + pattern), F.lit(0))
    given = docs.select(*keep, cut.alias("__words"))
    partitions = _partitions(docs)
    # both branches below read this one shuffle
    sent = given.mapInArrow(partial(_segments, buckets=PARTITION_BUCKETS * partitions), _SENT).repartition(partitions, "key")
    words = sent.sortWithinPartitions("key").mapInArrow(partial(_distinct, path=path), _FOLDED)
    answers = _answers(words, path)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "__words"]
    fields += ["ids array<int>"] * ids + ["n_tokens long, ids_sha256 string, decoded_sha256 string"] * digests
    schema = to_arrow_schema(_parse_datatype_string(", ".join(fields)))

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        return _rows(left, right, path, ids, digests, schema)

    return sent.groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(rows, ", ".join(fields))


def decode(ids: Column, path: str | None = None) -> Column:
    """The bytes of an array of ids: their binary pieces, one after the other. An unknown id gives null."""
    return _bind(F.from_json(F.lit(json.dumps(piece_hex(path or default_ranks_path()))), "array<string>"), lambda t: F.when(F.size(ids) == 0, F.lit(b"")).otherwise(
        F.unhex(F.array_join(F.transform(ids, lambda i: F.get(t, i)), ""))))
