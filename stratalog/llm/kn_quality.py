"""Quality rules: n-gram perplexity bands over base rules on words, lines and symbols.

The model is a modified Kneser-Ney model of order 4 over characters folded into
a fixed alphabet (letters without case, digits, groups of punctuation, lead and
continuation bytes of other scripts). Spark counts every n-gram of every
document; each task adds up its texts before the shuffle. Lower orders count
continuations. The alphabet bounds the table by ALPHABET ** ORDER n-grams
whatever the input, so the model is collected, its discounts and interpolated
probabilities are computed, and it is stored as sorted hash arrays: an order's
n-gram hashes in order, with a log probability and a back-off weight each.

A document's perplexity is per word: symbols strewn between letters raise it,
table bars and repeats lower it. For each language the median and the
median absolute deviation of log perplexity, exact over all documents that pass
the base rules, give the lower and the upper band.

A second, class-based model counts pairs of word classes (`kn_words`) and within
them every word of the table (`kn_vocabulary`), so words, their order and
scripts that the alphabet folds together count as well. What it gathers grows
with the input and stays in sorted hash arrays dealt over the cluster. A
document is kept within the bands of the first and below the upper band of the
second: text that others repeat is foretold well, and copies are not the matter
of these rules.

Null and empty texts have no perplexity and fail the base rules; a very long
text is measured whole. A null language is a language of its own. Repeated rows
count as often as they stand. An empty table gives an empty result. Extra
columns are left out unless kept; one kept under a result's name is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from stratalog.llm import kn_vocabulary, kn_words
from stratalog.llm.common import durable, give_back, pieces

ORDER, ALPHABET = 4, 47
SPACE = ALPHABET ** ORDER
#: Words in a window whose repeats count.
REPEAT = 8
MIN_WORDS = 20
#: Deviations (scaled to standard ones) that a language's bands reach from its median, and their least width in nats.
BAND_DEVIATIONS, LEAST_WIDTH = 4.0, 1.0
#: Log perplexity is binned this finely for medians.
BIN = 0.001
#: Bytes of text scored at once; a longer text stands alone.
SLICE_BYTES = 1 << 20
_SYMBOLS = b"#*$%&|<>"


def alphabet() -> np.ndarray:
    """The class of each byte."""
    out = np.zeros(256, np.int32)
    for b in range(256):
        c = chr(b)
        if b in b" \t\n\x0b\x0c\r\x00":
            out[b] = 0
        elif c.isascii() and c.isalpha():
            out[b] = 1 + ord(c.lower()) - ord("a")
        elif c.isascii() and c.isdigit():
            out[b] = 27
        elif c in ".,;:!?":
            out[b] = 28
        elif c in "'\"-()":
            out[b] = 29
        elif b in _SYMBOLS:
            out[b] = 39 + _SYMBOLS.index(b)
        elif 0x21 <= b < 0x7F:
            out[b] = 31
        elif b < 0x21 or b == 0x7F:
            out[b] = 32
        elif b >= 0xC0:
            out[b] = 33 if b == 0xC3 else 34 if b < 0xE0 else 35 if b < 0xF0 else 36
        else:
            out[b] = 30 if b & 0x20 else 37 + (b >> 4 & 1)
    return out


_CLASS = alphabet()


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams ending at each byte of each text, with white space before a text; and each text's byte count."""
    pad = b"\x00" * (ORDER - 1)
    c = _CLASS[np.frombuffer(b"".join(pad + t for t in texts), np.uint8)]
    code = c.copy()
    for back in range(1, ORDER):
        code[back:] += c[:-back] * ALPHABET ** back
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    inside = np.ones(len(c), bool)
    starts = np.cumsum(n + ORDER - 1) - (n + ORDER - 1)
    for k in range(ORDER - 1):
        inside[starts + k] = False
    return code[inside], n


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SPACE, np.int64)
    for batch in pieces(batches, "__text", 4 * SLICE_BYTES):
        code, _ = grams(batch.column(0).cast(pa.binary()).fill_null(b"").to_pylist())
        total += np.bincount(code, minlength=SPACE)
        del batch, code
    at = np.flatnonzero(total)
    give_back()
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])


def count_orders(docs: DataFrame, text: str = "text") -> list[DataFrame]:
    """(gram, n) for orders 1 to ORDER: counts of the highest, continuation counts of the others."""
    top = durable(docs.select(F.col(text).alias("__text")).mapInArrow(_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    out = [top]
    for order in range(ORDER - 1, 0, -1):
        out.insert(0, out[0].groupBy((F.col("gram") % ALPHABET ** order).alias("gram")).agg(F.count("*").alias("n")))
    return out


def mix64(order: int, code: np.ndarray) -> np.ndarray:
    """A bijective 64-bit hash of (order, n-gram)."""
    x = code.astype(np.uint64) | np.uint64(order << 40)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


class Model:
    """Per order: sorted hashes of n-grams with log probabilities, and of contexts with log back-off weights."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        lower_keys, lower_p = np.arange(ALPHABET), np.full(ALPHABET, 1 / ALPHABET)
        self.floor = -np.log(ALPHABET)
        for order, (keys, counts) in enumerate(tables, 1):
            sort = np.argsort(keys)
            keys, counts = keys[sort], counts[sort].astype(np.float64)
            n = [float((counts == k).sum()) for k in range(1, 5)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
            discounts = np.array([0.0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k - 0.1) if n[k - 1] and n[k] else 0.5 * k for k in (1, 2, 3)])
            which = np.minimum(counts, 3).astype(np.int64)
            context, first = np.unique(keys // ALPHABET, return_index=True)
            total = np.add.reduceat(counts, first) if len(keys) else counts
            taken = np.add.reduceat(discounts[which], first) if len(keys) else counts
            weight = taken / total
            at = np.searchsorted(context, keys // ALPHABET)
            p_low = lower_p[np.searchsorted(lower_keys, keys % ALPHABET ** (order - 1))] if order > 1 else np.full(len(keys), 1 / ALPHABET)
            p = (counts - discounts[which]) / total[at] + weight[at] * p_low
            for store, k, v in ((self.grams, mix64(order, keys), np.log(p)), (self.contexts, mix64(order, context), np.log(weight))):
                by_hash = np.argsort(k)
                store.append((k[by_hash], v[by_hash]))
            lower_keys, lower_p = keys, p

    def log_probability(self, code: np.ndarray) -> np.ndarray:
        """Of the last character of each packed n-gram, given those before."""
        out, todo = np.zeros(len(code)), np.arange(len(code))
        for order in range(ORDER, 0, -1):
            now = code[todo] % ALPHABET ** order
            seen, value = self._find(self.grams[order - 1], mix64(order, now))
            out[todo[seen]] += value[seen]
            todo, now = todo[~seen], now[~seen]
            known, weight = self._find(self.contexts[order - 1], mix64(order, now // ALPHABET))
            out[todo] += np.where(known, weight, 0.0)
        out[todo] += self.floor
        return out

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        if not len(keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return keys[at] == hashes, values[at]


def train(docs: DataFrame, text: str = "text") -> Model:
    tables = []
    for table in count_orders(docs, text):
        rows = table.toArrow()  # bounded by the alphabet
        tables.append((rows["gram"].to_numpy(), rows["n"].to_numpy()))
    model = Model(tables)
    del tables, rows
    give_back()
    return model


class _Scorer:
    """Looks each n-gram up once in a worker."""

    def __init__(self, model: Model):
        self.model, self.known, self.value = model, np.zeros(SPACE, bool), np.zeros(SPACE, np.float32)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """Log perplexity of each text, for a word; NaN of one without words."""
        code, _ = grams(texts)
        n = np.fromiter((len(t.split()) for t in texts), np.int64, len(texts))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        new = np.unique(code[~self.known[code]])
        self.value[new] = self.model.log_probability(new)
        self.known[new] = True
        upto = np.concatenate([[0.0], np.cumsum(self.value[code], dtype=np.float64)])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(n > 0, -(upto[ends[1:]] - upto[ends[:-1]]) / n, np.nan)


_FIXED = np.random.default_rng(11).integers(1, 2**63, REPEAT, dtype=np.uint64) | np.uint64(1)


def base_measures(text: bytes, numbers: dict[bytes, int]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; numbers gives each word an id, and grows."""
    words = text.split()
    chars = sum(map(len, words)) if text.isascii() else len(b"".join(words).decode())
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
    repeats = 0
    if len(words) > REPEAT:
        get, size = numbers.setdefault, numbers.__len__
        ids = np.array([get(w, size()) for w in words], np.uint64) + np.uint64(1)
        n = len(ids) - REPEAT + 1
        h = np.zeros(n, np.uint64)
        for k in range(REPEAT):
            x = ids[k:k + n] * _FIXED[k]
            h += (x ^ (x >> np.uint64(29))) * _FIXED[-1 - k]
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if same.any():
            window = np.lib.stride_tricks.sliding_window_view(ids, REPEAT)
            twice = np.zeros(n, bool)
            if (window[order[1:][same]] == window[order[:-1][same]]).all():
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
            else:  # two different windows have one hash
                _, which, many = np.unique(window, axis=0, return_inverse=True, return_counts=True)
                twice = many[which.reshape(-1)] > 1
            cover = np.zeros(len(ids) + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + REPEAT, -1)
            repeats = int((np.cumsum(cover)[:-1] > 0).sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats


#: Words a worker numbers before it starts over.
_MOST_NUMBERS = 250_000


def _score(batches: Iterator[pa.RecordBatch], model: Broadcast, cuts: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row for each text, then those of its block."""
    scorer, word_model = _Scorer(model.value[0]), model.value[1]
    numbers: dict[bytes, int] = {}
    block = kn_vocabulary.Block(cuts)
    filled = lambda rows: pa.RecordBatch.from_arrays([rows.column(f.name).cast(f.type) if f.name in rows.schema.names else pa.nulls(rows.num_rows, f.type) for f in schema], schema=schema)
    for batch in pieces(batches, "__text", SLICE_BYTES):
        at = batch.schema.get_field_index("__text")
        texts = batch.column(at).cast(pa.binary()).fill_null(b"").to_pylist()
        found, texts_here = kn_words.words(texts), len(texts)
        out = batch.remove_column(at).append_column("__word_ppl", pa.array(word_model.of_words(*found, texts_here), from_pandas=True)).append_column("__log_ppl", pa.array(scorer(texts), from_pandas=True))
        rows = []
        for t in texts:
            if len(numbers) > _MOST_NUMBERS:
                numbers = {}
            rows.append(base_measures(t, numbers))
        for name, column in zip(MEASURES, np.array(rows, np.int64).reshape(-1, len(MEASURES)).T, strict=True):
            out = out.append_column(name, pa.array(np.ascontiguousarray(column)))
        places = np.arange(block.texts, block.texts + texts_here, dtype=np.int32)
        yield filled(out.append_column("__block", pa.array([block.name] * texts_here, pa.int64())).append_column("__place", pa.array(places)))
        block.add(*found, texts_here, sum(map(len, texts)))
        del batch, texts, out, found, rows
        if block.size >= kn_vocabulary.BLOCK_BYTES:
            yield filled(block.rows())
    if block.texts:
        yield filled(block.rows())
    del scorer, numbers, block
    give_back()


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def scored(docs: DataFrame, model: Broadcast, *, text: str = "text", keep: tuple[str, ...]) -> DataFrame:
    given = docs.select(*keep, F.col(text).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "__text"] + ["__word_ppl double", "__log_ppl double"] + [f"{m} long" for m in MEASURES] + [kn_vocabulary.FIELDS]
    schema = ", ".join(fields)
    cuts, arrow = kn_vocabulary.ranges(docs, text), to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    rows = durable(given.mapInArrow(partial(_score, model=model, cuts=cuts, schema=arrow), schema))
    mine = rows.where("__range IS NULL").drop("__range", "__keys", "__counts", "__sizes")
    nats = kn_vocabulary.scores(rows.select("__block", "__place", "__range", "__keys", "__counts", "__sizes"))
    return mine.join(nats, ["__block", "__place"]).withColumn("__word_ppl", F.col("__word_ppl") + F.col("__word_nats")).drop("__block", "__place", "__word_nats")


def bands(narrow: DataFrame, lang: str = "lang", column: str = "__log_ppl") -> DataFrame:
    """narrow (lang, column): (lang, low, high) from exact binned medians and median deviations."""

    def median(df: DataFrame, value: str) -> DataFrame:
        binned = df.groupBy(lang, F.round(F.col(value) / BIN).cast("long").alias("b")).agg(F.sum("n").alias("n"))
        by = W.partitionBy(lang)  # a language's bins, some thousands at most
        upto = binned.withColumn("upto", F.sum("n").over(by.orderBy("b"))).withColumn("all", F.sum("n").over(by))
        return upto.where(2 * F.col("upto") >= F.col("all")).groupBy(lang).agg((F.min("b") * BIN).alias("m"))

    hist = durable(narrow.where(F.col(column).isNotNull()).groupBy(lang, (F.round(F.col(column) / BIN) * BIN).alias("x")).agg(F.count("*").alias("n")))
    middle = median(hist, "x")
    away = hist.join(middle.withColumnRenamed(lang, "__l"), F.col(lang).eqNullSafe(F.col("__l"))).select(lang, F.abs(F.col("x") - F.col("m")).alias("d"), "n")
    spread = median(away, "d").select(F.col(lang).alias("__l"), F.col("m").alias("mad"))
    width = F.greatest(F.lit(LEAST_WIDTH), BAND_DEVIATIONS * 1.4826 * F.col("mad"))
    both = middle.join(spread, F.col(lang).eqNullSafe(F.col("__l")))
    return both.select(F.col(lang).alias("__lang"), (F.col("m") - width).alias("__low"), (F.col("m") + width).alias("__high"))


#: Languages whose bands are broadcast.
MOST_LANGUAGES = 50_000


def judge(docs: DataFrame, *, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(kept columns, MEASURES, base_failed, perplexity, low, high, word_perplexity, word_high, kept)."""
    if clash := set(keep) & {*MEASURES, "base_failed", "perplexity", "low", "high", "word_perplexity", "word_high", "kept"}:
        raise ValueError(f"columns of the result: {sorted(clash)}")
    model = docs.sparkSession.sparkContext.broadcast((train(docs, text), kn_words.train(docs, text)))
    give_back()
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    given = docs.select(*keep, F.col(lang).alias("__of"), F.col(text).alias("__body"))
    rows = narrow = durable(scored(given, model, text="__body", keep=(*keep, "__of")))
    for prefix, column in (("", "__log_ppl"), ("__word", "__word_ppl")):
        found = durable(bands(narrow.where(~failed), "__of", column)).toDF(*(f"{prefix}{x}" for x in ("__lang", "__low", "__high")))
        if found.count() <= MOST_LANGUAGES:
            found = F.broadcast(found)
        rows = rows.join(found, F.col("__of").eqNullSafe(F.col(f"{prefix}__lang")), "left")
    within = F.coalesce(F.col("__log_ppl").between(F.col("__low"), F.col("__high")) & (F.col("__word_ppl") <= F.col("__word__high")), F.lit(False))
    return rows.select(
        *keep, *MEASURES, failed.alias("base_failed"), F.exp("__log_ppl").alias("perplexity"), F.exp("__low").alias("low"), F.exp("__high").alias("high"),
        F.exp("__word_ppl").alias("word_perplexity"), F.exp("__word__high").alias("word_high"), (~failed & within).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
