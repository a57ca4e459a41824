"""Collocations, top-k search and expiring clicks, against brute force."""

import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import click_windows, collocations, top_k
from stratalog.llm.perfect_hash import PerfectHash

LOWER = {i: i + 32 for i in range(65, 91)}


# --- perfect hash and collocations ------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 100_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
    h = PerfectHash(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    others = np.setdiff1d(keys + np.uint64(1), keys)
    assert (h.slots(others) == -1).all()


def test_perfect_hash_refuses_equal_keys():
    with pytest.raises(ValueError):
        PerfectHash(np.array([3, 3], np.uint64))


def _collocations(docs, least, first):
    grams, total = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 6):
                for i in range(len(words) - n + 1):
                    grams.setdefault(lang, Counter())[tuple(words[i : i + n])] += 1
    out = []
    for lang, f in grams.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, _, left, right = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((lang, " ".join(p), a, left, right, total[lang], score))
        rows.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i, *r[1:]) for i, r in enumerate(rows[:first], 1)]
    return sorted(out)


def _texts(seed, n=60):
    r = random.Random(seed)
    words = ["a", "B", "the", "日本", "x" * 300, "né", "end", "q,r", "s\tt", "u\x0bv"]
    odd = [(None, "en"), ("", "en"), (" \t ", None), ("only.", None), ("a b a b a b a", "und"), ("the  end the\nend THE end!", None), ("a" * 5000, "de")]
    return odd + [(" ".join(r.choices(words, weights=[5, 5, 5, 2, 1, 2, 2, 1, 1, 1], k=r.randrange(60))), r.choice(["en", "de", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize(("least", "first"), [(3, 2000), (4, 4)])
def test_collocations_equal_brute_force(spark, monkeypatch, least, first):
    docs = _texts(least)
    df = spark.createDataFrame(docs, "text string, lang string").withColumn("n", F.lit(1)).repartition(3)
    want = _collocations(docs, least, first)
    assert [tuple(r) for r in sorted(collocations.mine(df, least=least, first=first).collect())] == want and want
    # several tables of words and of phrases, each a pass of its own, tiny chunks and blocks
    for name, value in (("WORD_TABLE", 8), ("TABLE", 40), ("CHUNK", 8), ("BLOCK", 2000), ("GATHER", 16), ("SKETCH_BITS", 12)):
        monkeypatch.setattr(collocations, name, value)
    assert [tuple(r) for r in sorted(collocations.mine(df, least=least, first=first).collect())] == want


def test_no_collocations(spark):
    for rows in ([], [("a b", "en")], [(None, None)]):
        assert collocations.mine(spark.createDataFrame(rows, "text string, lang string"), least=2).count() == 0


def test_candidates_of_collocations_are_pairs_that_reach_the_count(spark, monkeypatch):
    r, least = random.Random(3), 10
    docs = [(" ".join(f"w{r.randrange(200)}" for _ in range(400)), "en") for _ in range(150)] + [("w1 w2 w3", "en")] * 30
    sizes = []
    monkeypatch.setattr(collocations, "PerfectHash", lambda keys: sizes.append(len(keys)) or PerfectHash(keys))
    df = spark.createDataFrame(docs, "text string, lang string").repartition(7)
    assert [tuple(x) for x in sorted(collocations.mine(df, least=least).collect())] == _collocations(docs, least, 2000)
    pairs = Counter(p for text, _ in docs for p in zip(text.split(), text.split()[1:]))
    # words, pairs, and the one phrase of three: rare pairs don't pass because others share a place with them
    assert sizes == [200, sum(n >= least for n in pairs.values()), 1]


@pytest.mark.parametrize("gather", [50, 1 << 19])
def test_collocations_beyond_a_byte(spark, monkeypatch, gather):
    docs = [("a b c", "en")] * 290 + [("a b d", "en")] * 20 + [("b c " * 20, None)] * 30
    monkeypatch.setattr(collocations, "GATHER", gather)
    df = spark.createDataFrame(docs, "text string, lang string").repartition(2)
    for least in (255, 300):
        assert [tuple(x) for x in sorted(collocations.mine(df, least=least).collect())] == _collocations(docs, least, 2000)


# --- top-k search -----------------------------------------------------------------------


def _top(rows, k=5):
    """rows (id, vector): a list of (query id, rank, id, score)."""
    whole = [(i, v, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, v, x) in enumerate(whole):
        if q is not None and q % 50 == 0:
            found = sorted((-sum(map(lambda s, t: s * t, x, y)), i is None, i if i is not None else 0, b) for b, (i, w, y) in enumerate(whole) if a != b and len(w) == len(v))[:k]
            out += [(q, n, whole[f[3]][0], -f[0]) for n, f in enumerate(found, 1)]
    return Counter(out)


@pytest.mark.parametrize("seed", range(2))
def test_top_k_equals_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    scale = r.lognormal(0, 1 if seed % 2 else 0.01, 400)
    base = r.normal(size=(40, 8))
    rows = [(int(i), [float(x) for x in np.float32(scale[i] * (base[i % 40] + 0.03 * r.normal(size=8)) / np.linalg.norm(base[i % 40]))]) for i in range(400)]
    rows += [(0, rows[0][1]), (50, rows[7][1]), (None, rows[3][1]), (950, None), (1000, [1.0, None] + [0.0] * 6), (1050, [float("nan")] * 8), (1100, [float("inf")] * 8), (1150, [0.0] * 8), (1200, []), (1201, []), (1250, [2.0, 1.0]), (1251, [1.0, 1.0])]
    rows += [(2000 + i, [1.0] + [0.0] * 7) for i in range(20)]  # ties
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, row int, score double").repartition(3)
    got = top_k.top_k(df, F.col("vec_id") % 50 == 0, bucket=37, block=5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, got.collect())) == _top([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])


def test_pruning_saves_products():
    r = np.random.default_rng(3)
    x = np.floor(256 * r.normal(size=(4000, 16)) * r.lognormal(0, 1, 4000)[:, None])
    x[::10] = np.floor(x[1::10] * 0.97)  # near directions, so that coordinates prune
    x = x[np.argsort(-np.linalg.norm(x, axis=1))]
    ids = np.arange(len(x))
    queries = top_k.Queries(x[::50], ids[::50], ids[::50])
    best, said = top_k.Best(len(queries.x), 5), Counter()
    for i in range(0, len(x), 200):
        said.update(top_k.search(queries, top_k.Bucket(x[i : i + 200], ids[i : i + 200], ids[i : i + 200]), best))
    exact = x[::50] @ x.T
    exact[np.arange(len(queries.x)), ids[::50]] = -np.inf
    assert (np.sort(exact, axis=1)[:, ::-1][:, :5] == best.score).all()
    assert said["whole"] and said["coordinates"] and said["length"] and said["products"] < 0.5 * exact.size


def test_no_vectors(spark):
    for rows in ([], [(1, [1.0])], [(0, None)], [(0, [1.0])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert top_k.top_k(df, F.col("vec_id") % 50 == 0).count() == 0


def test_scores_beyond_a_double(spark):
    rows = [(0, [1.0, 2.0**45]), (1, [3.0, 2.0**1]), (2, [1.0, 2.0**50]), (3, [4.0, 2.0**1])]
    got = top_k.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    limit = 2**63 - 1
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(i, min(limit, int(256 * 1 * 256 * v[0] + 256 * 2**45 * 256 * v[1]))) for i, v in (rows[2], rows[3], rows[1])]


# --- expiring clicks --------------------------------------------------------------------


def _windows(rows, batches=8):
    """rows (click_id, ts, arrived_at, client_id, kind, value, props)."""
    epoch, copies = datetime.datetime(1970, 1, 1), []
    for click, ts, arrived, client, kind, value, props in rows:
        if arrived is None:
            continue
        for j in range((click or 0) % 3 + 1 if click is not None else 1):
            c = zlib.crc32(f"{'' if click is None else click}:{j}".encode())
            hour = (arrived - epoch) // datetime.timedelta(hours=1) + 6 * j * (c % 10)
            micros = "" if ts is None else str((ts - epoch) // datetime.timedelta(microseconds=1))
            number = "" if value is None or not math.isfinite(value) else str(math.floor(100 * value + 0.5))
            text = "|".join(["" if client is None else str(client), kind or "", number, micros, props or "", str(c % 3)])
            copies.append((click, hour, hour + c // 10 % 200, hashlib.sha256(text.encode()).hexdigest()))
    low, high = min(c[2] for c in copies), max(c[2] for c in copies)
    cut = [[c for c in copies if (c[2] - low) * batches // (high - low + 1) == b] for b in range(batches)]
    out, opened, last = [], {}, None
    for b, batch in enumerate(cut):
        for click, hour, _, digest in sorted(batch, key=lambda c: (c[1], c[3])):
            if b and hour < last - 96:
                continue
            w = opened.get(click)
            if w and hour <= w[0] + 24:
                w[1] += 1
                if digest != w[4]:
                    w[2] += 1
                    w[3] += zlib.crc32(digest.encode())
            else:
                if w:
                    out.append((click, w[0], b, *w[1:]))
                opened[click] = [hour, 0, 0, 0, digest]
        last = max([c[1] for c in batch] + ([last] if last is not None else []))
        for click in [k for k, w in opened.items() if w[0] + 24 < last - 96 or b == batches - 1]:
            w = opened.pop(click)
            out.append((click, w[0], b, *w[1:]))
    return Counter(out)


def _clicks(seed, n):
    r = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at = start + datetime.timedelta(minutes=r.randrange(60 * 24 * 60))
        rows.append((r.choice((i, 3 * (i // 3) + 2, 5)), at - datetime.timedelta(seconds=r.random()), at, r.choice((None, 1, 2)), r.choice((None, "view", "a|b")), r.choice((None, 1.005, -3.5, r.random())), r.choice((None, "", '{"k": 1}'))))
    return rows + rows[:20] + [(None, start, start, None, None, None, None), (7, None, None, 1, "view", 1.0, None), (-4, start, start, 1, "x", float("nan"), ""), (-4, start, start, 1, "x", float("inf"), "")]


CLICK = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def test_click_windows_equal_a_plain_loop(spark):
    rows = _clicks(1, 500)
    df = spark.createDataFrame(rows, CLICK).withColumns({"hour": F.lit(1), "batch": F.lit("x"), "hash": F.lit(None)})
    got = click_windows.deduplicate(df)
    assert got.columns == ["click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "hash"]
    assert Counter(map(tuple, got.collect())) == _windows(rows)


def test_no_clicks(spark):
    assert click_windows.deduplicate(spark.createDataFrame([], CLICK)).count() == 0
    assert click_windows.deduplicate(spark.createDataFrame([(1, None, None, None, None, None, None)], CLICK)).count() == 0


def test_fold_equals_one_record_at_a_time():
    r = np.random.default_rng(5)
    opened, plain, out = np.zeros(0, click_windows.WINDOW), {}, []
    native = np.dtype([(n, click_windows.RECORD.fields[n][0].newbyteorder("=")) for n in click_windows.RECORD.names])
    for low in (0, 40, 90, 200):
        records = np.zeros(400, native)
        records["id"], records["hour"], records["hash"] = r.integers(0, 60, 400), low + r.integers(0, 80, 400), r.integers(0, 3, (400, 4))
        records["null"] = records["id"] == 0
        closed, now, touched = click_windows.fold(records, opened)
        keep = np.ones(len(opened), bool)
        keep[touched] = False
        opened = np.concatenate([opened[keep], now])
        got = [(int(w["id"]), int(w["start"]), int(w["repeats"]), int(w["conflicts"])) for w in closed]
        want = []
        for x in sorted(records, key=lambda x: (x["hour"], tuple(x["hash"]))):
            w = plain.get(int(x["id"]))
            if w and x["hour"] <= w[0] + 24:
                w[1] += 1
                w[2] += tuple(x["hash"]) != w[3]
            else:
                if w:
                    want.append((int(x["id"]), *w[:3]))
                plain[int(x["id"])] = [int(x["hour"]), 0, 0, tuple(x["hash"])]
        assert Counter(got) == Counter(want)
        out += got
    assert {int(w["id"]): [int(w["start"]), int(w["repeats"]), int(w["conflicts"])] for w in opened} == {k: w[:3] for k, w in plain.items()} and out


def test_the_twin_of_clicks_equals_a_plain_loop():
    rows = [r for r in _clicks(2, 400) if r[0] is not None and r[0] >= 0 and r[2] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE clicks (click_id BIGINT, ts TIMESTAMP, arrived_at TIMESTAMP, client_id BIGINT, kind VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO clicks VALUES (?, ?, ?, ?, ?, ?, ?)", rows)
    assert Counter(con.execute(click_windows.ORACLE).fetchall()) == _windows(rows)


def test_the_twin_of_collocations_equals_brute_force():
    words = [("a b c", 70), ("a b", 50), ("B C. c", 40), ("x a b c d", 110), ("d; x y", 120)]
    docs = [(text, lang) for text, n in words for lang, times in (("en", n), (None, n // 2 + 40)) for _ in range(times)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    want = _collocations(docs, 100, 2000)
    assert sorted(con.execute(collocations.ORACLE).fetchall()) == want and want
