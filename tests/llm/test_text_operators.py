"""Operators on texts and pages, against libraries, brute force and held-out rows."""

import hashlib
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import byte_bpe, crf_pages, html_blocks, html_crf, kn_quality, kn_vocabulary, kn_words, license_scan, token_count, toxicity, url_filter

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "word " * 5000, "日本語 text 😀😀  \n\n x", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "same", "same", "\x1c\x85\xa0 nbsp", "it's I'll we've DON'T", "x<|endoftext|>y  <|endoftext|>"]
DOCS = "doc_id long, text string, lang string, n_words long, kept string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, i, "clash") for i, t in enumerate(ODD)] + [(None, "no id", "en", None, None)], DOCS)


def test_byte_bpe_equals_tiktoken(spark, odd):
    import tiktoken

    plain = tiktoken.Encoding("plain", pat_str=byte_bpe.default_pattern(), mergeable_ranks=byte_bpe.load_ranks(byte_bpe.default_ranks_path()), special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).unionByName(odd.select(F.col("doc_id") + 10**6, "text").toDF("doc_id", "text"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = byte_bpe.encode(docs, digests=True).withColumn("d", F.sha2(byte_bpe.decode(F.col("ids")), 256)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.ids == ids and r.d == r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert byte_bpe.encode(odd.limit(0)).count() == 0


def test_token_count_equals_tokenizers(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_count.default_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select(F.col("doc_id") + 10**6, "text").toDF("doc_id", "text"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in token_count.count_tokens(docs).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 512)
    assert token_count.count_tokens(odd.limit(0)).count() == 0


def test_merging_rounds_equal_one_merge_at_a_time():
    model = token_count.merges(token_count.default_path())
    rank = {(int(k) >> 20, int(k) & 0xFFFFF): int(r) for k, r in zip(model.keys, model.ranks, strict=True)}
    r = random.Random(1)
    words = [bytes(r.choices(b"aab th e", k=r.randint(1, 14))) for _ in range(300)]
    got = model.count(np.frombuffer(b"".join(words), np.uint8), np.array(list(map(len, words))))
    for w, n in zip(words, got, strict=True):
        ids = [int(model.byte_ids[b]) for b in w]
        while pairs := [(rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]:
            best, at = min(pairs)
            ids[at:at + 2] = [int(model.new_ids[best])]
        assert len(ids) == n


def _plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    lines, seen, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = Counter(tuple(words[i:i + 8]) for i in range(n - 7))
    covered = {k for i in range(n - 7) if grams[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_measures_equal_plain_ones(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [t or "" for t in ODD] + ["a b c d e f g h " * 3, "a\nb\n\n \na\na", "x " * 9]
    for t in texts:
        assert kn_quality.base_measures(t.encode(), {}) == _plain_measures(t)


class _PlainKneserNey:
    """The same model by dictionaries."""

    def __init__(self, texts):
        k, self.a = kn_quality.ORDER, kn_quality.ALPHABET
        classes = kn_quality.alphabet()
        self.count = [Counter() for _ in range(k + 1)]
        for t in texts:
            c = [0] * (k - 1) + [int(classes[b]) for b in t.encode()]
            self.count[k].update(tuple(c[i - k + 1:i + 1]) for i in range(k - 1, len(c)))
        for n in range(k - 1, 0, -1):
            self.count[n].update(g[1:] for g in self.count[n + 1])
        self.discount = []
        for n in range(1, k + 1):
            m = [sum(v == j for v in self.count[n].values()) for j in range(1, 5)]
            y = m[0] / (m[0] + 2 * m[1]) if m[0] and m[1] else 0.5
            self.discount.append([0] + [min(max(j - (j + 1) * y * m[j] / m[j - 1], 0.1), j - 0.1) if m[j - 1] and m[j] else 0.5 * j for j in (1, 2, 3)])

    def p(self, gram):
        if not gram:
            return 1 / self.a
        same = {g: v for g, v in self.count[len(gram)].items() if g[:-1] == gram[:-1]}
        if not same:
            return self.p(gram[1:])
        d, total = self.discount[len(gram) - 1], sum(same.values())
        return max(0, same.get(gram, 0) - d[min(3, same.get(gram, 0))]) / total + sum(d[min(3, v)] for v in same.values()) / total * self.p(gram[1:])


def test_kneser_ney_equals_a_plain_one_and_sums_to_one(spark):
    texts = ["the cat sat on the mat", "the dog sat", "a cat and a dog $$$ 12", "été", ""]
    model = kn_quality.train(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string"))
    plain = _PlainKneserNey(texts)
    r = random.Random(3)
    unpack = lambda code: tuple(code // kn_quality.ALPHABET ** k % kn_quality.ALPHABET for k in range(kn_quality.ORDER - 1, -1, -1))
    codes = [int(c) for t in ("the cat sat here", "zzz $$") for c in kn_quality.grams([t.encode()])[0]] + [r.randrange(kn_quality.SPACE) for _ in range(20)]
    got = np.exp(model.log_probability(np.array(codes)))
    assert np.allclose(got, [plain.p(unpack(c)) for c in codes], rtol=1e-9)
    for context in (0, codes[5] % kn_quality.ALPHABET ** 3):
        every = context * kn_quality.ALPHABET + np.arange(kn_quality.ALPHABET)
        assert abs(np.exp(model.log_probability(every)).sum() - 1) < 1e-9


def _plain_word_perplexity(texts, which):
    """Modified Kneser-Ney over pairs, by dictionaries, discounts of all texts, counts of the others."""
    split = [re.findall(r"[a-z]+|[.,]", t.lower()) for t in texts]
    ways = [[("", *w[:1])] * bool(w) + list(zip(w, w[1:], strict=False)) for w in split]
    whole = Counter(p for w in ways for p in w)
    rest = whole - Counter(ways[which])
    heads = lambda c: Counter(w for _, w in c)
    d = [kn_words.discounts([sum(v == k for v in c.values()) for k in range(1, 5)]) for c in (whole, heads(whole))]
    mass = sum(d[1][min(3, v)] for v in heads(whole).values())
    some, n = heads(rest), len(rest)
    logs = 0
    for c, w in ways[which]:
        low = (max(0, some[w] - d[1][min(3, some[w])]) + mass / (len(heads(whole)) + 1)) / n
        after = {k: v for k, v in rest.items() if k[0] == c}
        total = sum(after.values())
        logs += np.log((max(0, rest[c, w] - d[0][min(3, rest[c, w])]) + sum(d[0][min(3, v)] for v in after.values()) * low) / total if total else low)
    return -logs / len(ways[which])


def test_word_model_equals_a_plain_one(spark):
    r = random.Random(8)
    texts = [" ".join(r.choices(["The", "cat", "sat,", "on", "a", "mat.", "dog", "ran"], k=r.randint(1, 30))) for _ in range(40)] + ["only here once", "the cat sat", ""]
    model = kn_words.train(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").repartition(5))
    got = model.log_perplexity([t.encode() for t in texts])
    assert np.isnan(got[-1]) and np.allclose(got[:-1], [_plain_word_perplexity(texts, i) for i in range(len(texts) - 1)])


def _plain_nats(texts, which):
    """Words within their classes by dictionaries, discounts of all texts, counts of the others."""
    split = [re.findall(r"[a-z]+|[.,]", t.lower()) for t in texts]
    whole = Counter(w for s in split for w in s)
    kind = {w: int(kn_words.words([w.encode()])[0][0] >> kn_words.IN_CLASS) for w in whole}.get
    rest = whole - Counter(split[which])
    d = kn_words.discounts([sum(v == k for v in whole.values()) for k in range(1, 5)])
    logs = 0
    for w in split[which]:
        places = 1 + sum(kind(x) == kind(w) for x in whole)
        same = {x: n for x, n in rest.items() if kind(x) == kind(w)}
        total = sum(same.values())
        logs += np.log((max(0, rest[w] - d[min(3, rest[w])]) + sum(d[min(3, n)] for n in same.values()) / places) / total if total else 1 / places)
    return -logs / len(split[which])


@pytest.mark.parametrize("block", [1, 300, 1 << 20])
def test_words_in_classes_equal_plain_ones(spark, block):
    r = random.Random(9)
    lexicon = ["".join(r.choices("abcdefgh", k=r.randint(1, 6))) for _ in range(3000)]
    texts = [" ".join(r.choices(lexicon[:40] if i % 2 else lexicon, k=r.randint(1, 30))) + "." for i in range(24)] + ["", "only.", ""]
    blocks, at, now = [], [], kn_vocabulary.Block(8)
    for t in texts:
        at.append((now.name, now.texts))
        now.add(*kn_words.words([t.encode()]), 1, len(t))
        if now.size >= block:
            blocks.append(now.rows())
    if now.texts:
        blocks.append(now.rows())
    rows = [tuple(x.values()) for b in blocks for x in b.to_pylist()]
    got = {(x["__block"], x["__place"]): x["__word_nats"] for x in kn_vocabulary.scores(spark.createDataFrame(rows, kn_vocabulary.FIELDS).repartition(3)).collect()}
    assert len(got) == len(texts) and all((got[a] is None) == (not t) for a, t in zip(at, texts, strict=True))
    assert np.allclose([got[a] for a, t in zip(at, texts, strict=True) if t], [_plain_nats(texts, i) for i, t in enumerate(texts) if t])


@pytest.mark.parametrize("letters", ["abcdefghijklmnop", "абвгдежзиклмнопр"])
def test_word_salad_goes(spark, letters):
    r = random.Random(5)
    lexicon = ["".join(r.choices(letters, k=r.randint(3, 8))) for _ in range(300)]
    chain = {w: r.sample(lexicon, 3) for w in lexicon}
    texts = []
    for _ in range(300):
        now, text = r.choice(lexicon), []
        for _ in range(120):
            text.append(now)
            now = r.choice(chain[now])
        texts.append(text)
    salad = [r.sample(t, len(t)) for t in texts[:5]]
    rows = kn_quality.judge(spark.createDataFrame([(i, " ".join(t), "xx") for i, t in enumerate(texts + salad)], "doc_id long, text string, lang string")).collect()
    assert sum(x.kept for x in rows if x.doc_id < 300) > 290
    assert not any(x.kept for x in rows if x.doc_id >= 300)


def test_quality_verdicts(spark, odd):
    rows = {r.doc_id: r for r in kn_quality.judge(odd).collect()}
    assert len(rows) == len(ODD) + 1
    assert not any(rows[i].kept for i in range(len(ODD))) and rows[0].base_failed and rows[0].perplexity is None
    assert kn_quality.judge(odd.limit(0)).count() == 0
    found = kn_quality.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    good = found.where("quality = 1 AND NOT base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.97


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    found = toxicity.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    hit = {(r.toxic, r.predicted): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert hit[1, 1] / (hit[1, 1] + hit.get((1, 0), 0)) > 0.8
    assert hit.get((0, 1), 0) / (hit[0, 0] + hit.get((0, 1), 0)) < 0.03


def test_toxicity_gradients_and_odd_texts(spark, odd):
    net = toxicity.train(["you idiot fool"] * 8 + ["nice day today"] * 8, [1] * 8 + [0] * 8)
    rows = {r.doc_id: r.score for r in toxicity.score(odd, net).collect()}
    assert len(rows) == len(ODD) + 1 and all(0 <= s <= 1 for s in rows.values()) and rows[0] == rows[1]
    assert toxicity.train(["x"], [1]) is None and toxicity.score(odd, None).where("score <> 0").count() == 0
    r = np.random.default_rng(0)
    gates, at, size = r.standard_normal((2, 9, 3 * toxicity.HIDDEN)), r.integers(0, 9, (4, 6)), np.array([6, 3, 1, 5])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    logit, kept = net.forward(gates, at, size, keep=True)
    g, d_gates = net.backward(np.ones(4), at, kept, 9)
    for name in ("U", "A", "v", "w"):
        where = tuple(r.integers(0, n) for n in net.p[name].shape)
        old, step = net.p[name][where], 1e-3
        ends = []
        for s in (step, -step):
            net.p[name][where] = old + s
            ends.append(net.forward(gates, at, size).astype(np.float64).sum())
        net.p[name][where] = old
        assert abs((ends[0] - ends[1]) / (2 * step) - g[name][where]) < 5e-3


def test_windows_cover_every_word():
    counts = np.array([0, 1, 32, 33, 48, 49, 100])
    owner, first, size = toxicity.windows(counts)
    for i, n in enumerate(counts):
        mine = owner == i
        assert set().union(*[range(a, a + s) for a, s in zip(first[mine], size[mine], strict=True)]) == set(range(n))


def test_field_on_unseen_layouts():
    field, right, total = html_crf.default_field(), 0, 0
    for page, labels in crf_pages.labelled_pages(80, seed=4242):
        found = html_blocks.blocks(page)
        assert len(found) == len(labels)
        right += sum(a == b for a, b in zip(field.decode(found), labels, strict=True))
        total += len(labels)
    assert right / total > 0.97


def test_viterbi_equals_all_paths():
    from itertools import product

    field = html_crf.Field({"in p": 0.4, "in li": -0.7}, [[0.3, -0.5], [-0.2, 0.6]], [0.1, -0.1])
    page = [html_blocks.Block(html_blocks.Node(None, t, 1, [f"in {t}"]), "some words", 0) for t in ("p", "li", "p", "li", "li", "p")]

    def worth(path):
        return field.starts[path[0]] + sum(field.scores([b])[0] for b, y in zip(page, path, strict=True) if y) + sum(field.moves[a][b] for a, b in zip(path, path[1:]))

    assert field.decode(page) == list(max(product((0, 1), repeat=len(page)), key=worth))


def test_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>"), (4, "u", "no markup & a&nbsp;b"), (5, "u", '<article><h1>Head</h1><p>One &amp; <b>two</b><br>three. Four five six.</article><footer>&copy; x</footer>' * 1)]
    got = {r.page_id: r for r in html_crf.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1].text, got[2].text, got[3].text) == ("", "", "") and got[5].text == "Head One & two three. Four five six."
    assert all(r.n_chars == len(r.text) for r in got.values())
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_crf.extract(pages, keep=("page_id", "html")).collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        import html

        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inner))).split())
        assert r.text == want


@pytest.mark.parametrize("module", [url_filter, license_scan])
def test_sql_twins(spark, module):
    c = duckdb.connect()
    for t in ("pages", "documents"):
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = module.query(spark, SF)
    want = c.sql(module.ORACLE).select(", ".join(got.columns)).fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_cascade_is_exact(spark):
    universe = [f"k{i}" for i in range(4000)]
    listed = universe[::13]
    df = spark.createDataFrame([(k,) for k in universe * 2], "key string")
    cascade = url_filter.Cascade.build(listed, df, len(universe))
    assert len(cascade.levels) > 1
    assert {r.key for r in df.where(cascade.holds(F.col("key"))).collect()} == set(listed)
    assert url_filter.Cascade.build([], df, 1).levels == []


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/71?x", "http://example.com/en/6#a", "http://notexample.com/en/7", "http://xexample.net/de/8", "http://b.example.net/de/8", "http://com/en/", "a://b.org/es/://c", "http://x.org/es\n/", "http://" + "a." * 500 + "com/en/1"]
    rules = {h + p: v for h, p, v in url_filter.RULES}
    for r in url_filter.filter_urls(spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string"), url_filter.RULES).collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [k for h, p, v in url_filter.RULES for k in [h + p] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best, rules.get(best, "allow"))
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), url_filter.RULES).count() == 0


def test_licences(spark):
    text = license_scan.LICENSES["MIT"]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + text.upper()), (2, text.replace("sublicense", "sublicence").replace(" ", "  ").replace(",", ";")), (3, text + " more"), (4, None), (5, ""), (6, "!!!"), (2, text)]
    got = Counter((r.doc_id, r.license) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.known_licenses(spark)).collect())
    assert got == Counter([(1, "MIT"), (2, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, None)])


def test_longer_lists_make_more_cascades(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_KEYS", 50)
    rules = [(f"h{i}.org", "/", url_filter.BLOCK if i % 3 else url_filter.ALLOW) for i in range(0, 400, 2)]
    pages = spark.createDataFrame([(i, f"http://h{i}.org/x") for i in range(400)], "page_id long, url string")
    want = {(i, rules[i // 2][2] if i % 2 == 0 else url_filter.ALLOW) for i in range(400)}
    assert {(r.page_id, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()} == want
    with pytest.raises(ValueError):
        url_filter.filter_urls(pages.withColumn("rule", F.lit(1)), rules, keep=("page_id", "rule"))


def test_licence_forms(spark, tmp_path):
    texts = [
        "(c) you may sell it", "(c) you must never sell it", "x\rcopyright 2020 me\ry", "x\ny", "licence licence", "license license", "Copyright Jane Doe\nbody", "body",
        "copyright notice and terms", "terms", "(c) 2020 Jane\nbody", "per cent per cent", "percent percent"] + [t for _, t in license_scan.texts()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", "text", license_scan.canonical(F.col("text")).alias("c")).collect()
    c = [r.c for r in sorted(rows)]
    assert c[0] != c[1] and c[2] == c[3] == "x y" and c[4] == c[5] and c[6] == c[7] == c[10] == "body" and c[8] == "copyright notice and terms" and c[11] == c[12]
    spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string").toPandas().to_parquet(f"{tmp_path}/licences.parquet")
    d = duckdb.connect()
    d.sql(f"create view documents as select * from read_parquet('{tmp_path}/licences.parquet')")
    got = license_scan.scan(spark.read.parquet(f"{tmp_path}/licences.parquet"), license_scan.known_licenses(spark)).collect()
    assert Counter(map(tuple, got)) == Counter(d.sql(license_scan.ORACLE).fetchall())
    assert sorted(r.license for r in got if r.license) == sorted(n for n, _ in license_scan.texts())
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string"), license_scan.known_licenses(spark)).count() == 0
    long = spark.createDataFrame([(1, "many words " * 100_000, "x")], "doc_id long, text string, license string")
    assert license_scan.scan(long, license_scan.known_licenses(spark)).collect()[0].license is None


@pytest.mark.parametrize(("page", "want"), [
    ('<svg class="i"/><article><p>Body text.</p></article>', ["Body text."]),
    ('<p>Let <math><mi>x</mi></math> be.</p>', ["Let x be."]),
    ('<div title="A hidden gem"><p>Seen.</p></div><div hidden><p>No.</p></div><div style="display: none">No.</div><div class="post hidden wide"><p>Wide.</p></div>', ["Seen.", "Wide."]),
    ("<select><option>a<p>After it all.</p>", ["a", "After it all."]),
    ("<svg><text>pic</text></svg><p>One.</p><script>var x='</p>'</script><p>Two.", ["One.", "Two."]),
    ("<canvas><p>Left open.</p>", ["Left open."]),
])
def test_blocks_of_odd_markup(page, want):
    assert [b.text for b in html_blocks.blocks(page)] == want


def test_pages_without_rows_repeats_and_long_ones(spark):
    page = "<article>" + "<p>One two three four. Five six seven.</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page)], "page_id long, url string, html string")
    got = html_crf.extract(df).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].n_chars > 600_000
    assert html_crf.extract(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        html_crf.extract(df.withColumn("text", F.lit("x")), keep=("page_id", "text"))


def test_one_very_long_word(spark):
    import tiktoken

    plain = tiktoken.Encoding("plain", pat_str=byte_bpe.default_pattern(), mergeable_ranks=byte_bpe.load_ranks(byte_bpe.default_ranks_path()), special_tokens={})
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGH", k=n)) for n in (399, 400, 401, 3000)] + ["日本語" * 700, "a" * 5000]
    assert [byte_bpe.merged_long(w.encode(), byte_bpe.default_ranks_path()) for w in words] == [plain.encode_ordinary(w) for w in words]
    long = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=200_000))
    docs = spark.createDataFrame([(i, w) for i, w in enumerate([*words, long])], "doc_id long, text string")
    got = {x.doc_id: x.ids for x in byte_bpe.encode(docs).collect()}
    assert [got[i] for i in range(len(words))] == [plain.encode_ordinary(w) for w in words]
    assert got[len(words)] == plain.encode_ordinary(long)


def test_clashing_names_are_refused(spark, odd):
    for call in (
        lambda: byte_bpe.encode(odd.withColumn("ids", F.lit(1)), keep=("doc_id", "ids")), lambda: token_count.count_tokens(odd.withColumn("n_tokens", F.lit(1)), keep=("doc_id", "n_tokens")),
        lambda: kn_quality.judge(odd, keep=("doc_id", "kept")), lambda: toxicity.score(odd.withColumn("score", F.lit(1)), None, keep=("doc_id", "score"))):
        with pytest.raises(ValueError):
            call()


def _plain_logit(net, text):
    """The network word by word, without arrays of windows."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    words = [w.encode() for w in text.lower().split()]
    best = []
    for first in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
        some, h = words[first:first + toxicity.WINDOW], []
        x = []
        for w in some:
            row, grams, n = toxicity.word_features(np.frombuffer(w, np.uint8), np.array([len(w)]))
            x.append(net.words[row[0]] + net.grams[grams].sum(axis=0) / np.sqrt(n[0]))
        for way in (0, 1):
            state, states = np.zeros(toxicity.HIDDEN), []
            for v in x[::-1] if way else x:
                gate, u = v @ net.p["W"][way] + net.p["b"][way, 0], state @ net.p["U"][way]
                z, r = (sig(gate[k * toxicity.HIDDEN:(k + 1) * toxicity.HIDDEN] + u[k * toxicity.HIDDEN:(k + 1) * toxicity.HIDDEN]) for k in (0, 1))
                m = np.tanh(gate[2 * toxicity.HIDDEN:] + r * u[2 * toxicity.HIDDEN:])
                state = (1 - z) * m + z * state
                states.append(state)
            h.append(states[::-1] if way else states)
        both = np.array([np.concatenate(s) for s in zip(*h, strict=True)])
        a = np.exp(np.tanh(both @ net.p["A"]) @ net.p["v"])
        best.append((a / a.sum()) @ both @ net.p["w"] + net.p["c"][0])
    return max(best)


def test_network_equals_a_plain_pass(spark):
    net, r = toxicity.Network(seed=9), random.Random(9)
    net.words, net.grams = net.words * 30, net.grams * 30
    texts = [" ".join(r.choices("some words Stand here und da für él 日本 xyz".split(), k=k)) for k in (1, 5, 32, 33, 70, 200)]
    got = {x.doc_id: x.score for x in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], [1 / (1 + np.exp(-_plain_logit(net, t))) for t in texts], atol=1e-4)


def test_elements_whose_names_only_begin_like_raw_ones():
    page = "<article><h1>T</h1><title-card><p>Body text one.</p></title-card><style-guide>x</style-guide><svg-icon>y</svg-icon><p>Two<script>no</script-not></script></p></article>"
    assert [b.text for b in html_blocks.blocks(page)] == ["T", "Body text one.", "xy", "Two"]


@pytest.mark.parametrize("unit", ["<div>word ", "<svg>word ", "<blockquote><li>word ", "<p></section>word ", '<div class="n%s">word '])
def test_deep_pages_take_time_in_proportion(unit):
    field = html_crf.default_field()

    def seconds(n):
        page = "".join(unit.replace("%s", "".join(chr(97 + int(d)) for d in str(i))) for i in range(n))
        start = time.process_time()
        assert html_crf.main_text(page, field).count("word") <= n
        return time.process_time() - start

    seconds(1_000)
    assert seconds(40_000) < max(2.0, 40 * seconds(4_000))


def test_a_field_sees_every_ancestor_once():
    page = '<div class="box"><section class="box main"><div><p>Some words here.</p></div></section><p>More.</p></div>'
    for block, want in zip(html_blocks.blocks(page), (["in div", "in section", "in p", "name box", "name main"], ["in div", "in p", "name box"]), strict=True):
        found = html_crf.path_features(block.node)
        assert sorted(f for f in found if f.startswith(("in ", "name "))) == sorted(want) and len(found) == len(set(found))


def test_clauses_are_no_notices(spark):
    mit = license_scan.LICENSES["MIT"]
    good = ["Copyright (c) 2020 Jane Q. Public", "Copyright 2001-2003, 2007 Acme, Inc.", "(c) 2020 The Example Foundation. All rights reserved.", "© 2011 Jane Public <jane@example.com>", "Copyright (C) Jane Public", "Copyright Jane Public"]
    bad = ["Copyright use requires payment.", "Copyright claims lapse in 2020 unless you pay me.", "(c) 2020 days must pass", "Copyright 2020 you pay a fee", "Copyright (c) 2020. Fees are due yearly"]
    rows = [(f"{x}\n\n{mit}", "MIT") for x in good] + [(f"MIT License\n\n{good[0]}\n{good[-2]}\n\n{mit}", "MIT")] + [(f"{mit}\n\n{x}", None) for x in bad] + [(f"{x}\n\n{mit}", None) for x in bad] + [(f"{mit}\nCopyright Jane Public", None)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in license_scan.scan(docs, license_scan.known_licenses(spark)).collect()}
    assert [(rows[i][0][:50], got[i]) for i in range(len(rows))] == [(t[:50], want) for t, want in rows]


def test_the_query_finds_planted_licences_as_its_twin_does(spark, tmp_path):
    docs = [(i, f"Copyright (c) 20{i:02d} Someone\r\n\r\n" + body.upper().replace("\n", "\r\n")) for i, (_, body) in enumerate(license_scan.texts())] + [(900, None), (901, ""), (902, "MIT"), (903, "Copyright 2020 A. Man")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.digest, r.license) for r in license_scan.query(spark, str(tmp_path)).collect()}
    assert [got[i][1] for i in range(len(license_scan.texts()))] == [name for name, _ in license_scan.texts()] and {got[i][1] for i in (900, 901, 902, 903)} == {None}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert {i: (d, name) for i, d, name in con.execute(license_scan.ORACLE).fetchall()} == got
