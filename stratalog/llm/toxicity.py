"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of a hashed word vector and the hashed vectors of its
character 3- to 5-grams, so unseen words with known stems still speak. Two
gated recurrent layers read a window of words in both directions, attention
pools their states, and a logistic unit gives the window's score. All windows
of WINDOW words, each overlapping the next by half, cover a whole text; the
text's score is its highest window's.

Training is plain numpy on the driver, over at most TRAIN_ROWS labelled ids of
each class, drawn by a hash, and whole texts of at most TRAIN_BYTES: a text is
taught by its highest window of the epoch and a random one. The network's
weights (a few MB) are broadcast; scoring cuts whole texts into words within the
worker, a slice of SLICE_BYTES at a time, and shuffles nothing.

Null and empty texts get the score of an empty window; a very long text is
scored whole, in a slice of its own. Repeated rows get equal scores; an id that
repeats is learned from once. If the labels lack a class, or a table is empty,
every score is 0. Extra columns are left out unless kept. Labels, language,
source and ids are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import give_back, pieces, ragged

#: Most labelled ids of a class to learn from, and bytes of a text that is learned from: the sample holds 64 MB at most. Scoring has no such bound.
TRAIN_ROWS, TRAIN_BYTES = 2_000, 16 << 10
WINDOW, STRIDE = 32, 16
THRESHOLD = 0.7
WIDTH, HIDDEN = 10, 8
WORD_ROWS, GRAM_ROWS = 1 << 15, 1 << 16
#: Rounds over the sample; a small sample has more of them, up to so many steps in all.
EPOCHS, BATCH, LEAST_STEPS = 6, 128, 200
#: Distinct words a worker keeps before it starts over.
MEMORY_WORDS = 150_000
#: Bytes of text scored at a time; a longer text stands alone.
SLICE_BYTES = 2 << 20
_MIX = np.random.default_rng(5).integers(1, 2**31, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_features(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words whose bytes stand one after the other: a word row each, then gram rows and how many each word has."""
    n = len(lengths)
    sizes = lengths + 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    text = np.zeros(int(ends[-1]) if n else 0, np.uint64)
    inner = ragged(starts + 1, lengths)
    text[inner] = data
    text[starts], text[ends - 1] = 2, 3
    place = np.arange(len(text)) - np.repeat(starts, sizes)
    # a polynomial of the bytes, so equal words agree wherever they stand
    weight = _MIX[place % 16] * (place // 16 * 2 + 1).astype(np.uint64)
    value = np.add.reduceat((text * text + np.uint64(7)) * weight, starts) if n else np.zeros(0, np.uint64)
    words = (value * _MIX[3] >> np.uint64(40)).astype(np.int64) % WORD_ROWS
    owner, rows = [], []
    which = np.repeat(np.arange(n), sizes)
    for g in (3, 4, 5):
        if len(text) < g:
            continue
        h = np.full(len(text) - g + 1, g, np.uint64)
        for k in range(g):
            h = (h ^ text[k:len(text) - g + 1 + k]) * _MIX[4]
            h ^= h >> np.uint64(27)
        ok = which[:len(h)] == which[g - 1:]
        owner.append(which[:len(h)][ok])
        rows.append((h[ok] >> np.uint64(20)).astype(np.int64) % GRAM_ROWS)
    owner, rows = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, rows))
    order = np.argsort(owner, kind="stable")
    return words, rows[order], np.bincount(owner, minlength=n)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words: each window's text, its first word and its number of words; a text without words has one empty window."""
    n = np.maximum(1, -(-np.maximum(counts - WINDOW, 0) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    first = nth * STRIDE
    return owner, first, np.minimum(WINDOW, counts[owner] - first)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        f = lambda *shape, by=0.3: (r.standard_normal(shape) * by).astype(np.float32)
        self.words, self.grams = f(WORD_ROWS, WIDTH, by=0.02), f(GRAM_ROWS, WIDTH, by=0.02)
        self.p = {"W": f(2, WIDTH, 3 * HIDDEN), "U": f(2, HIDDEN, 3 * HIDDEN), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
                  "A": f(2 * HIDDEN, HIDDEN), "v": f(HIDDEN), "w": f(2 * HIDDEN), "c": np.zeros(1, np.float32)}

    def all_gates(self, words: np.ndarray, grams: np.ndarray, n: np.ndarray, step: int = 5_000) -> np.ndarray:
        """Gate inputs of many words, a block of them at a time."""
        ends = np.concatenate([[0], np.cumsum(n)])
        out = np.empty((2, len(n), 3 * HIDDEN), np.float32)
        for i in range(0, len(n), step):
            j = min(len(n), i + step)
            out[:, i:j] = self.project(self.embed(words[i:j], grams[ends[i]:ends[j]], n[i:j]))
        return out

    def embed(self, words: np.ndarray, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = self.words[words]
        if len(grams):
            full = np.flatnonzero(n)
            summed = np.add.reduceat(self.grams[grams], (np.cumsum(n) - n)[full], axis=0)
            out[full] += summed / np.sqrt(n[full])[:, None].astype(np.float32)
        return out

    def project(self, x: np.ndarray) -> np.ndarray:
        """What a word adds to the gates, in both directions: (2, words, 3 HIDDEN)."""
        return np.matmul(x[None], self.p["W"]) + self.p["b"]

    def forward(self, gates: np.ndarray, at: np.ndarray, size: np.ndarray, keep: bool = False):
        """Window logits; at (windows, WINDOW): word numbers in gates."""
        p, n, steps = self.p, len(at), at.shape[1]
        mask = np.arange(steps)[None, :] < size[:, None]
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.zeros((2, steps, n, HIDDEN), np.float32)
        cache = []
        for t in range(steps):
            back = steps - 1 - t
            x = np.stack([gates[0][at[:, t]], gates[1][at[:, back]]])
            u = np.matmul(h, p["U"])
            zr = _sigmoid(x[..., :2 * HIDDEN] + u[..., :2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            m = np.tanh(x[..., 2 * HIDDEN:] + r * u[..., 2 * HIDDEN:])
            on = np.stack([mask[:, t], mask[:, back]])[..., None]
            new = np.where(on, m + z * (h - m), h)
            if keep:
                cache.append((h, z, r, m, u[..., 2 * HIDDEN:], on))
            h = new
            states[0, t], states[1, back] = h[0], h[1]
        both = np.concatenate([states[0], states[1]], axis=2)  # steps, windows, 2 HIDDEN
        tan = np.tanh(both @ p["A"])
        e = np.where(mask.T, tan @ p["v"], -1e9)
        a = np.exp(e - e.max(axis=0)) * mask.T
        a /= np.maximum(a.sum(axis=0), 1e-9)
        pooled = (a[..., None] * both).sum(axis=0)
        logit = pooled @ p["w"] + p["c"][0]
        return (logit, (mask, cache, both, tan, a, pooled)) if keep else logit

    def backward(self, d: np.ndarray, at: np.ndarray, kept, n_words: int) -> tuple[dict, np.ndarray]:
        """d: of the loss by each logit. Gradients of the parameters but W and b, and of the gates' inputs."""
        p, (mask, cache, both, tan, a, pooled) = self.p, kept
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["w"], g["c"] = pooled.T @ d, np.array([d.sum()], np.float32)
        d_pool = d[:, None] * p["w"]
        d_a = (both * d_pool).sum(axis=2)
        d_both = a[..., None] * d_pool
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        g["v"] = np.einsum("tn,tnk->k", d_e, tan)
        d_tan = d_e[..., None] * p["v"] * (1 - tan * tan)
        g["A"] = np.einsum("tnj,tnk->jk", both, d_tan)
        d_both += d_tan @ p["A"].T
        d_gates = np.zeros((2, n_words, 3 * HIDDEN), np.float32)
        steps = at.shape[1]
        d_h = np.zeros((2, len(d), HIDDEN), np.float32)
        for t in reversed(range(steps)):
            back = steps - 1 - t
            h, z, r, m, un, on = cache[t]
            d_h = d_h + np.stack([d_both[t, :, :HIDDEN], d_both[back, :, HIDDEN:]])
            live = d_h * on
            d_m = live * (1 - z) * (1 - m * m)
            d_z = live * (h - m) * z * (1 - z)
            d_r = d_m * un * r * (1 - r)
            d_u = np.concatenate([d_z, d_r, d_m * r], axis=2)
            g["U"] += np.matmul(h.transpose(0, 2, 1), d_u)
            d_x = np.concatenate([d_z, d_r, d_m], axis=2)
            np.add.at(d_gates[0], at[:, t], d_x[0])
            np.add.at(d_gates[1], at[:, back], d_x[1])
            d_h = d_h * np.where(on, z, 1) + np.matmul(d_u, p["U"].transpose(0, 2, 1))
        return g, d_gates

    def scores(self, gates: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Each text's highest logit and the window that has it. numbers: words of the texts, one text after the other."""
        owner, first, size = windows(counts)
        start = (np.cumsum(counts) - counts)[owner] + first
        logits = np.empty(len(owner), np.float32)
        step = np.arange(WINDOW)
        most = max(0, len(numbers) - 1)
        padded = numbers if len(numbers) else np.zeros(1, np.int64)
        for lo in range(0, len(owner), 2048):
            part = slice(lo, lo + 2048)
            at = padded[np.minimum(start[part, None] + step, most)]
            logits[part] = self.forward(gates, at, size[part])
        best = np.maximum.reduceat(logits, np.searchsorted(owner, np.arange(len(counts)))) if len(counts) else logits
        return best, logits, (owner, start, size)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lower-cased words, one text after the other, and each text's count; a null text has none."""
    listed = pc.ascii_split_whitespace(pc.utf8_lower(texts.fill_null("")))
    flat = listed.flatten()
    full = pc.not_equal(flat, "")  # white space at either end leaves an empty string
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(listed).to_numpy(zero_copy_only=False), dtype=np.int64)])
    return flat.filter(full), np.diff(upto[ends])


def split(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct lower-cased words, each text's word numbers one after the other, and the texts' counts."""
    flat, counts = words_of(pa.array(texts, pa.string()))
    coded = flat.dictionary_encode()
    return coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), counts


def train(texts: list[str], labels: list[int], seed: int = 3) -> Network | None:
    """A network from labelled texts; None if a class is missing."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    net, r = Network(seed), np.random.default_rng(seed)
    vocabulary, numbers, counts = split(texts)
    give_back()
    features = []
    for i in range(0, max(1, len(vocabulary)), 5_000):
        some = vocabulary[i:i + 5_000]
        w, g, n = word_features(np.frombuffer(b"".join(some), np.uint8), np.array(list(map(len, some)), np.int64))
        features.append((w.astype(np.int32), g.astype(np.int32), n))
    words, grams, n_grams = (np.concatenate(x) for x in zip(*features, strict=True))
    del vocabulary, features
    gram_start = np.cumsum(n_grams) - n_grams
    speed = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    seen_w, seen_g, count = np.full(WORD_ROWS, 1e-4, np.float32), np.full(GRAM_ROWS, 1e-4, np.float32), 0
    every = np.arange(WINDOW)
    rounds = max(EPOCHS, -(-LEAST_STEPS // -(-int(len(y) + (y == 0).sum()) // BATCH)))
    for _ in range(rounds):
        gates = net.all_gates(words, grams, n_grams)
        _, logits, (own, start, size) = net.scores(gates, numbers, counts)
        lo = np.searchsorted(own, np.arange(len(counts)))
        hi = np.append(lo[1:], len(own))
        best = np.array([a + int(np.argmax(logits[a:b])) for a, b in zip(lo, hi, strict=True)])
        other = r.integers(lo, hi)
        calm = np.flatnonzero(y == 0)
        chosen, target = np.concatenate([best, other[calm]]), np.concatenate([y, y[calm]])
        order = r.permutation(len(chosen))
        for at in range(0, len(order), BATCH):
            pick = chosen[order[at:at + BATCH]]
            t = target[order[at:at + BATCH]]
            ids = numbers[np.minimum(start[pick, None] + every, max(0, len(numbers) - 1))] if len(numbers) else np.zeros((len(pick), WINDOW), np.int64)
            used, local = np.unique(ids, return_inverse=True)
            local = local.reshape(ids.shape)
            g_at, g_n = ragged(gram_start[used], n_grams[used]), n_grams[used]
            x = net.embed(words[used], grams[g_at], g_n)
            logit, kept = net.forward(net.project(x), local, size[pick], keep=True)
            d = ((_sigmoid(logit) - t) / len(t)).astype(np.float32)
            g, d_gates = net.backward(d, local, kept, len(used))
            g["W"], g["b"] = np.einsum("nk,dnj->dkj", x, d_gates), d_gates.sum(axis=1, keepdims=True)
            d_x = np.einsum("dnj,dkj->nk", d_gates, net.p["W"])
            count += 1
            for k, v in net.p.items():
                m, s = speed[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] * g[k] - s)
                v -= 0.01 * (m / (1 - 0.9 ** count)) / (np.sqrt(s / (1 - 0.99 ** count)) + 1e-7)
            share = d_x / np.sqrt(np.maximum(g_n, 1))[:, None].astype(np.float32)
            for table, row, grad, seen in ((net.words, words[used], d_x, seen_w), (net.grams, grams[g_at], np.repeat(share, g_n, axis=0), seen_g)):
                rows, inverse = np.unique(row, return_inverse=True)
                total = np.zeros((len(rows), WIDTH), np.float32)
                np.add.at(total, inverse, grad)
                seen[rows] += (total * total).mean(axis=1)
                table[rows] -= 0.03 * total / np.sqrt(seen[rows])[:, None]
    del gates, logits, own, start, size, words, grams, n_grams, gram_start, numbers
    give_back()
    return net


def _score(batches: Iterator[pa.RecordBatch], network: Broadcast, column: str, kept: bool) -> Iterator[pa.RecordBatch]:
    net: Network = network.value
    seen, gates = pa.array([], pa.string()), np.zeros((2, 0, 3 * HIDDEN), np.float32)
    nothing = net.project(np.zeros((1, WIDTH), np.float32))
    for batch in pieces(batches, column, SLICE_BYTES):
        at = batch.schema.get_field_index(column)
        flat, counts = words_of(batch.column(at))
        part = flat.dictionary_encode()
        if len(seen) > MEMORY_WORDS:
            seen, gates = seen.slice(0, 0), gates[:, :0]
        known = pc.index_in(part.dictionary, value_set=seen) if len(seen) else pa.nulls(len(part.dictionary), pa.int32())
        new = pc.is_null(known)
        added = part.dictionary.filter(new)
        raw = added.cast(pa.binary()).to_pylist()
        fresh = []
        for lo in range(0, len(raw), 5_000):
            some = raw[lo:lo + 5_000]
            fresh.append(net.all_gates(*word_features(np.frombuffer(b"".join(some), np.uint8), np.array(list(map(len, some)), np.int64))))
        number = known.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        number[new.to_numpy(zero_copy_only=False)] = len(seen) + np.arange(len(added))
        seen, gates = pa.concat_arrays([seen, added]), np.concatenate([gates, *fresh], axis=1)
        numbers = number[part.indices.to_numpy()] if len(part) else np.zeros(0, np.int64)
        best, _, _ = net.scores(gates if gates.shape[1] else nothing, numbers, counts)
        yield (batch if kept else batch.remove_column(at)).append_column("__score", pa.array(_sigmoid(best.astype(np.float64))))
        del batch, flat, part, known, new, added, raw, fresh, number, numbers, counts
    del seen, gates
    give_back()


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[list[str], list[int]]:
    """Texts of at most TRAIN_ROWS labelled ids of each class, by a hash of their ids, without those held out and texts beyond TRAIN_BYTES.

    An id counts once: of repeated rows one is taken. Both bounds hold before anything is collected.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("__y"))
    draw = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = known.where("__y = 0").orderBy(*draw).limit(TRAIN_ROWS).unionByName(known.where("__y = 1").orderBy(*draw).limit(TRAIN_ROWS))
    text = F.coalesce("text", F.lit(""))
    rows = docs.where(F.octet_length(text) <= TRAIN_BYTES).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "__y").agg(F.min(text).alias("t")).toArrow()
    rows = rows.sort_by([("doc_id", "ascending")])
    return rows["t"].to_pylist(), rows["__y"].to_pylist()


def score(docs: DataFrame, network: Network | None, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(kept columns, score). A column of docs named score may not be kept beside it."""
    if "score" in keep:
        raise ValueError("score is a column of the result")
    if network is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(network)
    kept = text in keep
    column = text if kept else "__text"
    given = docs.select(*keep) if kept else docs.select(*keep, F.col(text).alias(column))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if kept or f.name != column)
    return given.mapInArrow(partial(_score, network=sent, column=column, kept=kept), f"{schema}, __score double").withColumnRenamed("__score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    network = train(*sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = score(docs, network)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
