"""Token counts by rank-synchronous array merging.

Pre-tokens are cut on the JVM, numbered by Arrow's dictionary encoding, and
each word not seen before in its task becomes a sequence of symbol ids in one
ragged numpy array. A round finds every sequence's lowest-rank pair and merges
all its places in all sequences at once; rounds go on until no pair is listed,
and the surviving symbols of a sequence are its tokens. There is no shuffle.

Counts equal the tokenizers library's for a byte-level BPE file without begin,
end or padding tokens; a listed special string inside a text is one token and
splits it, as is that library's default. Null texts count as empty; repeated
rows give repeated results; a very long text is counted whole; an empty table
gives an empty result; other columns are left out unless asked for, and one
asked for under the name of a result is refused.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.byte_bpe import default_pattern
from stratalog.llm.common import ragged

#: Distinct words a task remembers before it forgets them all; bounds its memory, never its results.
MEMORY_WORDS = 2_000_000
#: Symbols in one ragged array.
BLOCK_SYMBOLS = 4_000_000
_NONE = np.int32(2**31 - 1)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {b: chr(b) for b in own}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return letters


class Merges:
    """Byte ids, and the merges sorted by pair: key, rank, new id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, vocab = whole["model"], whole["model"]["vocab"]
        if model["type"] != "BPE" or whole.get("normalizer") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError("a byte-level BPE file is needed")
        cut = whole.get("pre_tokenizer") or {}
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or cut.get("use_regex") is False or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("another way of cutting or merging than byte level's own")
        if any(t.get(k) for t in whole.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take in their neighbourhood are not supported")
        self.special = [t["content"] for t in whole.get("added_tokens", [])]
        self.byte_ids = np.array([vocab[c] for _, c in sorted(byte_letters().items())], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = np.arange(len(keys), dtype=np.int32)[order]
        self.new_ids = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def count(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols that survive in each of the byte sequences that stand one after the other in data."""
        out = lengths.astype(np.int64).copy()
        alive = np.flatnonzero(lengths > 1)
        starts = np.cumsum(lengths) - lengths
        symbols = self.byte_ids[data[ragged(starts[alive], lengths[alive])]]
        sizes = lengths[alive].astype(np.int64)
        if not len(alive):
            return out
        ranks = self._paired(symbols, sizes)
        while len(alive):
            first = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(ranks, first)
            done = least == _NONE
            if done.any():
                out[alive[done]] = sizes[done]
                go = ~done
                kept = np.repeat(go, sizes)
                symbols, ranks, alive, sizes, least = symbols[kept], ranks[kept], alive[go], sizes[go], least[go]
                if not len(alive):
                    break
            hit = ranks == np.repeat(least, sizes)
            hit = self._apart(hit)
            at = np.flatnonzero(hit)
            symbols[at] = self.new_ids[ranks[at]]
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            owner = np.repeat(np.arange(len(sizes)), sizes)
            sizes = sizes - np.bincount(owner[at], minlength=len(sizes))
            # only pairs next to a merged symbol change
            stale = hit.copy()
            stale[:-1] |= hit[1:]
            keep = ~gone
            stale, symbols, ranks = stale[keep], symbols[keep], ranks[keep]
            ends = np.cumsum(sizes) - 1
            ranks[ends] = _NONE
            stale[ends] = False
            # a symbol whose right neighbour was merged into one two places on
            again = np.flatnonzero(stale)
            ranks[again] = self.rank(symbols[again], symbols[again + 1])
        return out

    def _paired(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ranks = np.full(len(symbols), _NONE, np.int32)
        ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
        ranks[np.cumsum(sizes) - 1] = _NONE
        return ranks

    @staticmethod
    def _apart(hit: np.ndarray) -> np.ndarray:
        """Of neighbouring hits, which share a symbol, every other one from the left."""
        if not (hit[1:] & hit[:-1]).any():
            return hit
        place = np.arange(len(hit))
        start = hit.copy()
        start[1:] &= ~hit[:-1]
        begun = np.maximum.accumulate(np.where(start, place, 0))
        return hit & ((place - begun) % 2 == 0)


@cache
def merges(path: str) -> Merges:
    return Merges(path)


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = merges(path)
    seen, tokens = pa.array([], pa.string()), np.zeros(0, np.int64)
    for batch in batches:
        at = batch.schema.get_field_index("__words")
        column = batch.column(at)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        part = column.flatten().dictionary_encode()
        if len(seen) > MEMORY_WORDS:
            seen, tokens = seen.slice(0, 0), tokens[:0]
        known = pc.index_in(part.dictionary, value_set=seen) if len(seen) else pa.nulls(len(part.dictionary), pa.int32())
        new = pc.is_null(known)
        added = part.dictionary.filter(new)
        raw = added.cast(pa.binary())
        lengths = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
        spans, fresh, start = np.concatenate([[0], np.cumsum(lengths)]), [], 0
        while start < len(lengths):
            stop = max(start + 1, int(np.searchsorted(spans, spans[start] + BLOCK_SYMBOLS, "right")) - 1)
            fresh.append(model.count(data[spans[start]:spans[stop]], lengths[start:stop]))
            start = stop
        number = known.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        number[new.to_numpy(zero_copy_only=False)] = len(tokens) + np.arange(len(added))
        seen, tokens = pa.concat_arrays([seen, added]), np.concatenate([tokens, *fresh])
        each = tokens[number[part.indices.to_numpy()]] if len(part) else np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], ends])]
        yield batch.remove_column(at).append_column("__tokens", pa.array(np.diff(upto)))


def count_tokens(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, pattern: str | None = None, limit: int = 512) -> DataFrame:
    """(kept columns, n_bytes, n_tokens, over_limit)."""
    path, pattern = path or default_path(), F.lit("(?U)" + (pattern or default_pattern()))
    if clash := set(keep) & {"n_bytes", "n_tokens", "over_limit"}:
        raise ValueError(f"columns of the result: {sorted(clash)}")
    whole = F.coalesce(F.col(text), F.lit(""))
    words, extra = F.regexp_extract_all(whole, pattern, F.lit(0)), F.lit(0)
    specials = sorted(merges(path).special, key=len, reverse=True)
    if specials:
        quoted = "|".join("\\Q" + s + "\\E" for s in specials)
        parts = F.split(whole, quoted)
        found = F.lit(False)
        for s in specials:
            found = found | F.contains(whole, F.lit(s))
        words = F.when(found, F.flatten(F.transform(parts, lambda x: F.regexp_extract_all(x, pattern, F.lit(0))))).otherwise(words)
        extra = F.when(found, F.size(parts) - 1).otherwise(0)
    given = docs.select(*keep, F.octet_length(whole).cast("long").alias("n_bytes"), extra.cast("long").alias("__extra"), words.alias("__words"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "__words")
    n = F.col("__extra") + F.col("__tokens")
    counted = given.mapInArrow(partial(_count, path=path), f"{schema}, __tokens long")
    return counted.select(*keep, "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
