"""Mixing, near-dedup of texts and vectors, components and the pipeline, against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from stratalog.llm import itq, mixing, simhash
from stratalog.llm.common import components

SF = "/root/testdata/sf0.01"


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, a):
        self.up.setdefault(a, a)
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(70)] + [(500, 300), (500, 400), (7, 7)]
    sets = Sets()
    for a, b in edges:
        if a != b:
            sets.join(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: sets.find(n) for n in sets.up}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def _plain_print(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _plain_classes(prints):
    """prints: [(id, fingerprint)]."""
    sets, values = Sets(), [(k, v) for k, v in prints if k is not None]
    for k, _ in values:
        sets.find(k)
    for i, (k, v) in enumerate(values):
        for m, w in values[i + 1:]:
            if (v ^ w).bit_count() <= 4:
                sets.join(k, m)
    return {k: sets.find(k) for k, _ in values}


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n"), (10**6 + 3, "One"), (10**6 + 4, "one"), (10**6 + 4, "one"), (10**6 + 5, "a b c d"), (10**6 + 6, "w " * 30000)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = docs.collect()
    prints = {(r.doc_id, r.text): _plain_print(r.text) for r in rows}
    want = _plain_classes([(k, v) for (k, _), v in prints.items()])
    got = simhash.near_duplicates(docs.withColumn("fingerprint", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {(r.doc_id, r.fingerprint) for r in got} == {(k, f"{v:016x}") for (k, _), v in prints.items()}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_finds_every_close_pair_in_hot_groups(spark, monkeypatch):
    r = random.Random(9)
    base = r.getrandbits(64)
    prints = [r.getrandbits(64) for _ in range(300)]
    for _ in range(400):  # a large group of near copies, some of them linked through others alone
        x = base if r.random() < 0.5 else prints[-1]
        for _ in range(r.randint(1, 4)):
            x ^= 1 << r.randrange(64)
        prints.append(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(prints)], "doc_id long, fp long")
    by_print = {signed(x): i for i, x in reversed(list(enumerate(prints)))}
    want = _plain_classes([(i, prints[i]) for i in by_print.values()])
    for sub_block in (simhash.SUB_BLOCK, 40):
        monkeypatch.setattr(simhash, "SUB_BLOCK", sub_block)
        got = {r.fp: r.component_id for r in simhash.classes(df).collect()}
        assert got == {f: want[i] for f, i in by_print.items()}


def test_pivot_table_never_discards_a_link():
    r = np.random.default_rng(2)
    a = r.integers(0, 2**64, 2000, dtype=np.uint64)
    b = a.copy()
    for k in range(4):
        b ^= np.uint64(1) << r.integers(0, 64, len(b)).astype(np.uint64)
    fp = np.concatenate([a, b])
    i, j = np.arange(2000), np.arange(2000) + 2000
    assert len(simhash._survivors(fp, simhash.pivot_table(fp), i, j)) == 2000


def test_itq_recall_and_exact_rerank(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    r = np.random.default_rng(1)
    x = np.stack(rows.embedding.to_numpy()).astype(np.float64)
    extra = [(10**6 + i, (x[i % 50] + r.normal(0, 0.02, 64) * np.abs(x[i % 50]).mean() * 4).tolist(), int(rows.label.iloc[i % 50])) for i in range(600)]
    odd = [(2 * 10**6, None, 1), (2 * 10**6 + 1, [0.0] * 64, 1), (2 * 10**6 + 2, [float("nan")] * 64, 1), (2 * 10**6 + 3, [1.0, None] + [0.0] * 62, 1), (2 * 10**6 + 4, [1.0] * 64, None), (2 * 10**6 + 5, [], 1), (2 * 10**6 + 6, [float("inf")] + [0.0] * 63, 1)]
    both = extra + [(3 * 10**6, x[0].tolist(), int(rows.label.iloc[0])), (3 * 10**6, x[0].tolist(), int(rows.label.iloc[0])), (3 * 10**6 + 1, [1.0, 2.0], 1)]
    all_rows = [(int(v), list(map(float, e)), int(lab)) for v, e, lab in zip(rows.vec_id, rows.embedding, rows.label, strict=True)] + both
    df = spark.createDataFrame(all_rows + odd, "vec_id long, embedding array<float>, label int")
    unit = np.zeros((len(all_rows), 64))
    for i, (_, e, _) in enumerate(all_rows):
        unit[i, :len(e)] = np.array(e, np.float32)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label, ids = np.array([t[2] for t in all_rows]), np.array([t[0] for t in all_rows])
    want, sets = defaultdict(int), Sets()
    for k in np.unique(label):
        at = np.flatnonzero(label == k)
        near = unit[at] @ unit[at].T >= itq.COSINE
        np.fill_diagonal(near, False)
        for i, j in zip(*np.nonzero(near), strict=True):
            want[at[i]] += 1
            sets.join(int(ids[at[i]]), int(ids[at[j]]))
    got = itq.near_duplicates(df).collect()
    assert len(got) == len(all_rows) + len(odd)
    found = defaultdict(int)
    for g in got:
        found[g.vec_id] += g.n_links
        assert g.kept == (g.vec_id == g.component_id)
        if 2 * 10**6 <= g.vec_id < 3 * 10**6:
            assert (g.n_links, g.component_id) == (0, g.vec_id)
    total = defaultdict(int)
    for i, n in want.items():
        total[int(ids[i])] += n
    assert all(found[k] <= total[k] for k in found)
    assert sum(found.values()) >= 0.99 * sum(total.values()) > 0
    assert itq.near_duplicates(df.limit(0)).count() == 0


def test_itq_recall_of_vectors_with_a_common_mean(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(1500, 64)) / 8
    mean = r.normal(size=64)
    x = base + 3 * mean / np.linalg.norm(mean)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = r.normal(size=x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    both = np.concatenate([x, 0.981 * x + np.sqrt(1 - 0.981**2) * noise])
    near = both @ both.T >= itq.COSINE
    np.fill_diagonal(near, False)
    got = itq.near_duplicates(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(both)], "vec_id long, embedding array<double>, label int")).collect()
    found = {g.vec_id: g.n_links for g in got}
    assert all(found[i] <= near[i].sum() for i in found)
    assert sum(found.values()) >= 0.99 * near.sum() > 0


def test_targets_and_flow():
    assert mixing.targets({"a": 10, "b": 10, "c": 80}, {"a": 1, "b": 8, "c": 1}) == {"a": 30.0, "b": 30.0, "c": 40.0}
    # shared documents go where their own sources fall short, and nothing repeats while fresh words are left
    flow = mixing.min_cost_flow({("a",): 10, ("a", "b"): 30, ("b",): 5}, {"a": 15, "b": 30})
    assert sum(v.get("a", 0) for v in flow.values()) == 15 and sum(v.get("b", 0) for v in flow.values()) == 30
    assert all(sum(v.values()) <= n for v, n in zip([flow["a",], flow["a", "b"], flow["b",]], [10, 30, 5], strict=True))


def test_flow_is_cheapest():
    from itertools import product

    capacity, quota = {("a",): 2, ("a", "b"): 2}, {"a": 5, "b": 2}
    cost = lambda n, c: max(0, n - c) + max(0, n - 2 * c)
    best = min(cost(x, 2) + cost(y + z, 2) for x, y, z in product(range(7), repeat=3) if x + y == 5 and z == 2 and x <= 6 and y + z <= 6)
    flow = mixing.min_cost_flow(capacity, quota)
    assert sum(cost(sum(f.values()), capacity[p]) for p, f in flow.items()) == best


def test_mixing_meets_targets(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").join(mixing.query(spark, SF), "doc_id").toPandas()
    by = rows.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.source_size).all() and (abs(by.taken - by.target) <= 2).all() and (rows.taken <= 3 * rows["size"]).all()
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(by.index))}
    assert all(abs(by.target[s] - by["size"].sum() * weight[s] / sum(weight.values())) < 1e-6 for s in by.index if by.target[s] < 3 * by["size"][s])
    again = mixing.query(spark, SF).toPandas().sort_values("doc_id")
    assert (again.taken.to_numpy() == rows.sort_values("doc_id").taken.to_numpy()).all()


def test_mixing_odd_rows(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "d " * 5, None), (4, "d " * 5, None), (None, "e f", "y"), (5, "g", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", mixing.word_count(F.col("text")))
    got = mixing.mix(docs, F.col("size"), F.array("source")).collect()
    assert len(got) == len(rows) and sum(r.size for r in got) == 16
    assert {r.source: r["__source_size"] for r in got} == {"x": 3, None: 10, "y": 3}
    assert mixing.mix(docs.limit(0), F.col("size"), F.array("source")).count() == 0


def test_mixing_takes_clashing_names_and_odd_sources(spark):
    rows = [(1, ["a"], 5, 7, 7), (2, [], 5, 7, 7), (3, None, 5, 7, 7), (4, ["a", None], 5, 7, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, members array<string>, n long, tokens long, held long")
    got = mixing.mix(docs, F.col("n"), F.col("members")).collect()
    assert len(got) == 4 and all(r.tokens == r.held == 7 and 0 <= r["__taken"] <= 15 for r in got)
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumn("__taken", F.lit(1)), F.col("n"), F.col("members"))


def test_mixing_shared_documents(spark):
    docs = spark.createDataFrame([(i, ["a"] if i % 3 else ["a", "b"], 10) for i in range(300)], "doc_id long, members array<string>, n long")
    got = mixing.mix(docs, F.col("n"), F.col("members"), weights={"a": 1, "b": 1}).toPandas()
    assert 0 < got["__taken"].sum() and (got["__taken"] <= 30).all()


def test_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).cache()
        n = after.count()
        assert n > 0
        if name in ("toxicity", "quality_rules"):
            assert after.columns == columns and n < before.count()
            assert after.join(before, columns, "left_anti").count() == 0
        elif name == "simhash_near_dedup":
            want = _plain_classes([(r.doc_id, _plain_print(r.text)) for r in before.collect()])
            assert {r.doc_id for r in after.collect()} == set(want.values())
        elif name == "mixing":
            assert after.columns == columns and after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
        else:
            assert n == before.count() and after.where("n_tokens IS NULL OR decoded_sha256 IS NULL").count() == 0
        before = after


def test_pipeline_stages_take_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c d e " * 30, None, None, 5), (2, "a b c d e " * 30, None, None, 5)]
    rows += [(i, " ".join(random.Random(i).choices("the cat sat on a mat with one dog and two birds in some old house by that long river".split(), k=60)), "en", "s", 1) for i in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() >= 0
        assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("n", [10, 10**5, 10**7, 10**9])
def test_blocks_leave_room(n):
    blocks = simhash.blocks_for(n)
    masks = simhash.block_masks(blocks)
    r = random.Random(n)
    for _ in range(50):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), 4):
            y ^= 1 << b
        assert any((x ^ y) & (m % (1 << 64)) == 0 for m in masks)


def test_itq_equals_its_twin(spark):
    import duckdb

    c = duckdb.connect()
    c.sql("create view embeddings as select * from read_parquet('/root/testdata/sf0.01/embeddings.parquet')")
    got = itq.query(spark, "/root/testdata/sf0.01")
    want = c.sql(itq.ORACLE).select(", ".join(got.columns)).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
