"""Linking in batches and rule scans, against plain versions."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from stratalog.functions import fuzzy, scalars
from stratalog.operators import graph, hunts, linking, scanner, similarity
from stratalog.plans import catalog, similar


def _contents(seed, n):
    r = random.Random(seed)
    base = [bytes(r.choices(b"abcdefgh \n", k=r.choice((0, 40, 300, 1500)))) for _ in range(n // 3)]
    rows = []
    for i in range(n):
        body = bytearray(base[i % len(base)])
        if body and i >= len(base):
            body[r.randrange(len(body))] ^= 1
        rows.append(("t%d" % (i % 2), i, "ab"[i % 5 == 0], bytes(body), "f%d" % r.randrange(n), "g%d" % r.randrange(n) if i % 2 else None, "gcc" if i % 9 == 0 else None))
    return rows


def _features(spark, rows):
    df = spark.createDataFrame(rows, "tenant_id string, artifact_id long, artifact_class string, body binary, f string, g string, hint string")
    return linking.features(df, F.col("body"), {"f": F.col("f"), "g": F.col("g")}, F.col("hint"))


def _groups(rows):
    """By union-find over equal normal forms within a class."""
    root = {(t, i): (t, i) for t, i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = {}
    for t, i, cls, _, f, g, _ in rows:
        for name, value in (("f", f), ("g", g)):
            if value is not None:
                a, b = find((t, i)), find(seen.setdefault((t, cls, name, value), (t, i)))
                root[max(a, b)] = min(a, b)
    members = {}
    for x in root:
        members.setdefault(find(x), []).append(x)
    return {x: g[1] for g, xs in members.items() if len(xs) > 1 for x in xs}


def _compared(f, fresh, standing):
    """Pairs that a batch compares: a band in common, or for artifacts without one their whole class."""
    def bands(k):
        size, *halves = f[k].fuzzy.split(":")
        return set(enumerate(f"{size}:{x}" for h in halves for x in ([h[i : i + 3] for i in range(len(h) - 2)] if len(h) >= 3 else [h] if h else [])))

    own, out = {k: bands(k) for k in [*fresh, *standing]}, set()
    for a in fresh:
        others = [b for b in own if b != a and b[0] == a[0]]
        near = [b for b in others if own[a] & own[b]] or [b for b in others if f[b].artifact_class == f[a].artifact_class and f[b].size_bytes]
        out |= {(a[0], min(a[1], b[1]), max(a[1], b[1])) for b in near}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_two_batches_equal_one(spark, seed):
    rows = _contents(seed, 120)
    feature = graph.durable(_features(spark, rows))
    standing, written = linking.advance(feature.where("artifact_id % 3 <> 1"), linking.Standing.empty(feature))
    before = {(r.tenant_id, r.artifact_id): r.group_id for r in standing.group.collect()}
    assert before == _groups([x for x in rows if x[1] % 3 != 1]) and {tuple(r) for r in written.collect()} == {(*k, g) for k, g in before.items()}
    standing, written = linking.advance(feature, standing)  # those that stand are left as they are
    after = {(r.tenant_id, r.artifact_id): r.group_id for r in standing.group.collect()}
    assert after == _groups(rows)
    # only what changed is written
    assert {tuple(r) for r in written.collect()} == {(*k, g) for k, g in after.items() if before.get(k) != g}
    # byte edges: every pair with a band in common, or of an artifact without one, that passes gates and score
    f = {(r.tenant_id, r.artifact_id): r for r in feature.collect()}
    assert all(r.fuzzy == fuzzy.fuzzy_hash(rows[r.artifact_id][3]) for r in f.values())
    once = {(r.tenant_id, r.src, r.dst, r.score) for r in linking.link(feature, linking.Standing.empty(feature)).where("edge_type = 'byte_similar'").collect()}
    twice = {(r.tenant_id, r.src, r.dst, r.score) for r in standing.edge.where("edge_type = 'byte_similar'").collect()}
    pairs = spark.createDataFrame([(t, a, b) for t, a in f for s, b in f if s == t and a < b], "tenant_id string, src long, dst long")
    full = {(r.tenant_id, r.src, r.dst, r.score) for r in similarity.byte_edges(pairs, feature.select(*linking.FEATURE)).collect()}
    first = [k for k in f if k[1] % 3 != 1]
    met = {(x.tenant_id, *sorted((x.src, x.dst))) for x in linking.scoring_pairs(feature, feature).collect()}
    assert {e[:3] for e in full if f[e[0], e[1]].artifact_class == f[e[0], e[2]].artifact_class and f[e[0], e[1]].size_bytes and f[e[0], e[2]].size_bytes} <= met
    compared = _compared(f, list(f), [])
    assert once == {e for e in full if e[:3] in compared} and once
    compared = _compared(f, first, []) | _compared(f, [k for k in f if k not in first], first)
    assert twice == {e for e in full if e[:3] in compared}
    links = {(r.tenant_id, r.edge_type): r.links for r in standing.edge.where("edge_type = 'shared_provenance'").collect()}
    assert set(links.values()) <= set(range(1, 14))


def test_fallback_meets_the_whole_class(spark, monkeypatch):
    monkeypatch.setattr(linking, "CELL_ROWS", 4)  # so that cells are dealt out
    r = random.Random(5)
    rows = [("t", i, "xy"[i % 2], r.choice((0, 1, 4, 16, 64, 63, 65, 255, 256, r.randrange(5000))), r.choice((0.0, 2.0, 4.0, 6.0, 8.0, r.random() * 8)), None) for i in range(150)]
    feature = spark.createDataFrame(rows, "tenant_id string, artifact_id long, artifact_class string, size_bytes long, entropy double, fuzzy string")
    got = [(x.src, x.dst) for x in linking.class_fallback(feature.where("artifact_id % 7 = 0"), feature).collect()]
    m = scalars.MODEL
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] % 7 == 0 and a[1] != b[1] and a[2] == b[2] and b[3] > 0 and max(a[3], b[3]) / max(1, min(a[3], b[3])) <= float(m["size_ratio_max"]) and abs(a[4] - b[4]) <= float(m["entropy_delta_max"])}
    assert len(got) == len(set(got)) and set(got) == want


def test_hot_bands_keep_the_first_partners(spark):
    rows = [("t", i, 0, "k") for i in range(300)] + [("t", i, 1, "m%d" % (i % 40)) for i in range(300)]
    band = spark.createDataFrame(rows, "tenant_id string, artifact_id long, band_idx int, band_key string")
    got = {}
    for x in linking.band_candidates(band, band, cap=5).collect():
        got.setdefault(x.src, []).append(x.dst)
    assert {k: sorted(v) for k, v in got.items()} == {i: [j for j in range(300) if j != i][:5] for i in range(300)}


def _digests(spark, digests):
    """Features of artifacts of one class, told by their fuzzy hashes."""
    return spark.createDataFrame([("t", i, "x", 100, 4.0, d, [], None) for i, d in enumerate(digests)], "tenant_id string, artifact_id long, artifact_class string, size_bytes long, entropy double, fuzzy string, normalized array<struct<name:string,hash:string>>, hint string")


def _byte_similar(feature, standing):
    return {(x.src, x.dst, x.score) for x in linking.link(feature, standing).where("edge_type = 'byte_similar'").collect()}


def test_partners_beyond_the_first_are_compared(spark):
    r = random.Random(6)
    # a band that all share; only the last four are alike, two and two
    rows = ["12:ABC" + "".join(r.choices(fuzzy.ALPHABET, k=30)) + ":A" for _ in range(600)]
    rows += [rows[0][:-9] + "q" * 3 + ":A", "12:ABCnoneofthese12345:B", "12:ABCnoneofthese12346:B", rows[599][:-9] + "z:A"]
    feature = graph.durable(_digests(spark, rows))
    want = {(0, 600), (601, 602), (599, 603)}
    assert {x[:2] for x in _byte_similar(feature, linking.Standing.empty(feature))} == want
    first = linking.Standing.empty(feature)
    first = linking.Standing(feature.where("artifact_id < 602"), linking.bands(feature.where("artifact_id < 602")), first.edge, first.group)
    assert {x[:2] for x in _byte_similar(feature, first)} == {x for x in want if x[1] > 601}


def test_bands_and_runs_as_a_plain_version_has_them(spark):
    r = random.Random(9)
    half = lambda: "".join(r.choices("AB", (9, 1), k=r.choice((0, 1, 2, 3, 8, 12, 16))))
    rows = [f"{r.choice((3, 6, 12))}:{half()}:{half()}" for _ in range(110)] + ["3:XYZABABCDEFG:PQ", "6:QQ:XYZABABCDEFG", "192:UVWUVWUVW:K"] + [None, "x:ABCDEFGH:A"]
    feature = graph.durable(_digests(spark, rows))
    f = {("t", i): feature_row for i, feature_row in enumerate(feature.orderBy("artifact_id").collect()) if feature_row.fuzzy}
    ids = range(len(rows))
    pairs = spark.createDataFrame([("t", a, b) for a in ids for b in ids if a < b], "tenant_id string, src long, dst long")
    full = {(x.src, x.dst, x.score) for x in similarity.byte_edges(pairs, feature.select(*linking.FEATURE)).collect()}
    met = {x[1:] for x in _compared(f, list(f), [])}
    want = {x for x in full if x[:2] in met}
    assert _byte_similar(feature, linking.Standing.empty(feature)) == want and 0 < len(want) < len(full)
    uncapped = {(x.src, x.dst) for x in linking.band_candidates(linking.bands(feature), linking.bands(feature)).collect()}
    with_band = {(a, b) for a, b in uncapped if a < b}
    assert {(b, a) for a, b in uncapped} == uncapped
    near = similarity.byte_edges(pairs, feature.select(*linking.FEATURE), banded=True)
    assert {(x.src, x.dst, x.score) for x in near.collect()} == {x for x in full if x[:2] in with_band}


def test_edges_and_groups_are_found_without_each_other(spark, monkeypatch):
    feature = graph.durable(_features(spark, _contents(4, 90)))
    whole = linking.backfill(feature, 2)
    rows = lambda df: sorted(map(tuple, df.collect()))
    edges, groups = rows(whole.edge.where("edge_type = 'byte_similar'").drop("links")), rows(whole.group)
    found, none = linking.merge_groups, lambda *a, **b: pytest.fail("not asked for")
    monkeypatch.setattr(linking, "merge_groups", none)
    assert edges and rows(linking.backfill_alike(feature, 2)) == edges
    monkeypatch.setattr(linking, "merge_groups", found)
    monkeypatch.setattr(similarity, "byte_edges", none)
    assert groups and rows(linking.backfill_groups(feature, 2)) == groups
    assert catalog.queries()["linked_groups"](spark, "/root/testdata/sf0.001").columns == ["tenant_id", "artifact_id", "group_id"]


def test_hashes_of_long_slices(monkeypatch):
    r = random.Random(2)
    contents = [bytes(r.choices(b"ab \n", k=n)) for n in (0, 1, 7, 300, 5000, 9000)] + [b"\x00" * 4000, bytes(range(256)) * 30]
    want = [fuzzy.fuzzy_hash(c) for c in contents]
    for few in (0, 1, 5, 1000):
        monkeypatch.setattr(fuzzy, "FEW", few)
        assert fuzzy.fuzzy_hashes(contents) == want


RULES = {
    "a": 'rule a { strings: $x = "needle" $y = "Hay" nocase condition: $x and #y >= 2 }',
    "b": "rule b { strings: $h = { 4D 5A ?? [1-3] 50 } condition: $h }",
    "c": "rule c { strings: $r = /ab+c[0-9]/ condition: #r > 1 or filesize < 3 }",
    "d": 'rule d { strings: $w = "wide" wide $f = "full" fullword condition: any of them }',
    "e": 'rule e { strings: $o = "aa" condition: #o == 4 }',
    "f": "rule f { strings: $n = /[0-9][a-z][0-9]/ condition: not $n }",
    "bad": "rule bad { strings: $q = /(/ condition: $q }",
    "worse": 'rule worse { strings: $q = "x" condition: $p }',
}


def test_scans_by_whole_rules(spark):
    contents = [b"", b"zz", b"a needle in hay, HAY", b"needle hay", b"xMZ\x01\x02\x03P", b"MZP", b"abc1 abbbc2", b"w\x00i\x00d\x00e\x00", b"fully", b"so full.", b"aaaaa", b"1a2", b"\xff" * 40 + b"needle"]
    df = spark.createDataFrame([("t", i, c) for i, c in enumerate(contents)] + [("t", 99, None)], "tenant_id string, artifact_id long, content binary")
    rules = spark.createDataFrame(list(RULES.items()), "rule_id string, source string")
    got = {r.artifact_id: r for r in scanner.scan(df, rules).collect()}
    assert got[99].status == "error" and {r.rule_id for r in scanner.broken_rules(rules).collect()} == {"bad", "worse"}
    good = {k: hunts.parse_rule(v) for k, v in RULES.items() if k not in ("bad", "worse")}
    for i, c in enumerate(contents):
        hits = {k: {p.name: [(m.start(1), len(m[1])) for m in re.finditer(b"(?=(" + p.regex.encode("latin-1") + b"))", c, re.S | (re.I if p.ignore_case else 0))] for p in r.patterns} for k, r in good.items()}
        want = {k for k in good if hunts.holds(hunts.parse_condition(good[k]), {n: len(x) for n, x in hits[k].items()}, len(c))}
        assert {m.rule_id for m in got[i].matches} == want, c
        for m in got[i].matches:
            assert sorted((p.identifier, p.offset, p.length) for p in m.patterns) == sorted((f"${n}", o, size) for n, x in hits[m.rule_id].items() for o, size in x)
        assert got[i].status == ("matched" if want else "clean")


def test_evidence_and_work_are_bounded(spark, monkeypatch):
    one = scanner.Scanner([("n", 'rule r { strings: $a = "ab" condition: #a == 500 }')])
    status, matches = one.scan(b"ab" * 500)
    assert status == "matched" and len(matches[0]["patterns"]) == scanner.MOST_EVIDENCE and matches[0]["namespace"] == "n"
    monkeypatch.setattr(scanner, "LEAST_WORK", 0)
    monkeypatch.setattr(scanner, "WORK_FACTOR", 3)
    many = scanner.Scanner([("n", f'rule r{i} {{ strings: $a = "ab" condition: $a }}') for i in range(4)])
    assert many.scan(b"ab" * 10) == ("timeout", []) and many.scan(b"cd" * 10) == ("clean", [])
    rules = spark.createDataFrame([(f"r{i}", f'rule r{i} {{ strings: $a = "k{i}" condition: $a }}') for i in range(6)], "rule_id string, source string")
    assert [len(x) for x in scanner.bundles_of(rules, most=120)] == [2, 2, 2]


def test_atoms_are_in_every_match():
    for source, text in ((r"ab+c[0-9]", b"abbbc1"), ("(?:foo|bar)qux", b"barqux"), (r"x{2,3}yz", b"xxyz"), ("h.llo", b"hallo"), ("(?i:ABC)d", b"abcd")):
        found = scanner.atom(hunts.Pattern("p", "regex", source))
        assert found is None or found in text.lower()
    assert scanner.atom(hunts.Pattern("p", "regex", "[a-z]+")) is None


def test_pair_evidence_equals_a_plain_version(spark):
    r = random.Random(8)
    functions = {(a, 10 * i): sorted(r.sample(range(40), r.choice((0, 3, 5, 8)))) for a in (1, 2, 3) for i in range(12)}
    rows = [("t", a, o, [f"h{x:02d}" for x in tokens], o + 5, None if o % 20 else f"f{o}", len(tokens)) for (a, o), tokens in functions.items()]
    df = spark.createDataFrame(rows, "tenant_id string, artifact_id long, offset long, tokens array<string>, size int, name string, insns int")
    pairs = spark.createDataFrame([("t", 1, 2), ("t", 1, 3)], "tenant_id string, src long, dst long")
    got = {(x.src, x.dst): x for x in similarity.pair_evidence(df, pairs, most_pairs=4, most_tokens=3).collect()}
    for a, b in ((1, 2), (1, 3)):
        fa, fb = ({o: set(t) for (x, o), t in functions.items() if x == y} for y in (a, b))
        score = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
        near = sorted(((-score(x, y), o, p) for o, x in fa.items() for p, y in fb.items() if score(x, y) >= similarity.TAU))
        used_a, used_b, chosen = set(), set(), []
        for s, o, p in near:
            if o not in used_a and p not in used_b:
                used_a.add(o), used_b.add(p), chosen.append((o, p, -s))
        body = json.loads(got[a, b].evidence)
        assert [(x["a"]["offset"], x["b"]["offset"], x["score"]) for x in body["pairs"]] == chosen[:4] and body["matched_pairs"] == len(chosen) and got[a, b].listed == len(chosen[:4])
        assert body["contested_a"] == sorted({o for _, o, _ in near} - used_a) and body["unmatched_b"] == sorted(set(fb) - {p for _, _, p in near})
        assert body["coverage_a_to_b"] == len(chosen) / 12 and not got[a, b].truncated
        for x in body["pairs"]:
            for side, y in (("a", a), ("b", b)):
                tokens = [f"h{v:02d}" for v in functions[y, x[side]["offset"]]]
                assert x[side]["token_hashes_prefix"] == tokens[:3] and x[side]["token_count"] == len(tokens) == x[side]["insn_count"] and "name" in x[side]
    small = similarity.pair_evidence(df, pairs, most_bytes=700).collect()
    for x in small:
        body = json.loads(x.evidence)
        assert len(body["pairs"]) == x.listed and x.truncated == (x.listed < body["matched_pairs"]) and sum(len(json.dumps(p, separators=(",", ":"))) + 1 for p in body["pairs"]) <= 700
    assert any(x.truncated for x in small)


def test_digests_are_taken_apart_before_pairs_meet(spark):
    rows = [("t", i, "en", 100, 4.0, d) for i, d in enumerate(("3:ABCDEFGHIJ:ABCDE", "3:ABCDEFGHIK:ABCDE", "6:ABCDE:ABCDEFGHIJ", "3:AAAAAAABCDEFGHI:A", "3:AAABCDEFGHI:A", "12:ABCDEFGHIJ:A", "x:ABCDEFGHIJ:A", "3:ABCDEFGHIJ", None))]
    feature = spark.createDataFrame(rows, "tenant_id string, artifact_id long, artifact_class string, size_bytes long, entropy double, fuzzy string")
    ids = range(len(rows))
    pairs = spark.createDataFrame([("t", a, b) for a in ids for b in ids if a < b], "tenant_id string, src long, dst long")
    edges = similarity.byte_edges(pairs, feature)
    scores = spark.createDataFrame([(a, b, rows[a][5], rows[b][5]) for a in ids for b in ids if a < b], "src long, dst long, a string, b string").select("src", "dst", scalars.fuzzy_compare(F.col("a"), F.col("b")).alias("score"))
    assert {(r.src, r.dst, r.score) for r in edges.collect()} == {(r.src, r.dst, float(r.score)) for r in scores.where("score >= 40").collect()}
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and "regexp_replace" not in plan[: plan.index("Join")]


@pytest.mark.parametrize("cap", [1, 3, 7])
def test_bands_with_the_same_members_meet_once(spark, cap):
    rng = random.Random(cap)
    rows = [("t", i, b, f"k{i % 2}") for i in range(40) for b in range(6)] + [("t", i, 9, f"q{rng.randrange(8)}") for i in range(40)] + [("u", i, 0, "k0") for i in range(5)]
    bands = spark.createDataFrame(rows, "tenant_id string, artifact_id long, band_idx int, band_key string")
    want = {}
    for t, i, b, k in rows:
        want.setdefault((t, i), set()).update(j for u, j, c, m in rows if (u, c, m) == (t, b, k) and j > i)
    found = similarity.candidates(bands, cap)
    assert sorted(map(tuple, found.collect())) == sorted((t, i, j) for (t, i), js in want.items() for j in sorted(js)[:cap])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_xor" in plan and "block" in plan


def test_rules_share_what_is_found(monkeypatch):
    rules = [("n", f'rule r{i} {{ strings: $a = "abab" $b = "AB" nocase $c = /a[a-z]{{1,2}}b/ condition: {c} }}') for i, c in enumerate(("$a and #b > 3", "not $a", "filesize < 4", "#a == 70", "$c", "#a > 69 and $b"))]
    one = scanner.Scanner(rules)
    calls, find = [], scanner.Finder.find
    monkeypatch.setattr(scanner.Finder, "find", lambda self, *a: calls.append(1) or find(self, *a))
    for text in (b"", b"xyz", b"abab", b"ABABaBab", b"ab" * 71, b"abab." * 70, b"axxb aab abb"):
        calls.clear()
        want = []
        for i in range(len(rules)):
            n = {k: len(re.findall(p, text)) for k, p in (("a", rb"(?=abab)"), ("b", rb"(?i)(?=ab)"), ("c", rb"(?=a[a-z]{1,2}b)"))}
            if ((n["a"] and n["b"] > 3), not n["a"], len(text) < 4, n["a"] == 70, n["c"], n["a"] > 69 and n["b"])[i]:
                want.append((f"r{i}", [(f"${k}", m.start()) for k, p in (("a", rb"(?=abab)"), ("b", rb"(?i)(?=ab)"), ("c", rb"(?=a[a-z]{1,2}b)")) for m in list(re.finditer(p, text))[:64]]))
        assert [(m["rule_id"], [(p["identifier"], p["offset"]) for p in m["patterns"]]) for m in one.scan(text)[1]] == want
        assert len(calls) <= 3


def test_only_what_a_condition_leaves_open_is_looked_for(monkeypatch):
    one = scanner.Scanner([("n", 'rule r { strings: $a = "needle" $b = "hay " nocase $c = "straw" $d = /barn[a-z ]{1,8}door/ condition: $d or ($a and #b > 2 and not $c) }')])
    calls, find = [], scanner.Finder.find
    monkeypatch.setattr(scanner.Finder, "find", lambda self, *a: calls.append(1) or find(self, *a))
    # a rule that fails makes no evidence, and a count is taken only where the rest leaves it open
    for text, most in ((b"needle straw " * 9, 0), (b"hay " * 9, 0), (b"barn " * 9, 0), (b"needle hay HAY ", 1), (b"needle hay hay hay straw", 1)):
        calls.clear()
        assert one.scan(text) == ("clean", []) and len(calls) <= most, text
    assert [p["offset"] for p in one.scan(b"needle Hay HAY hay ")[1][0]["patterns"]] == [0, 7, 11, 15]
    assert [(p["identifier"], p["offset"], p["length"]) for p in one.scan(b"a barn or door, straw")[1][0]["patterns"]] == [("$c", 16, 5), ("$d", 2, 12)]


def test_evidence_is_that_of_scans(spark, monkeypatch):
    rng = random.Random(5)
    parts = [b"needle", b"hay", b"HAY", b"MZ\x01\x02P", b"abbbc7", b"w\x00i\x00d\x00e\x00", b"full", b" ", b".", b"aa", b"1a2", b"\xff\x00", b"a long needle of words"]
    more = {"g": 'rule g { strings: $a = "a long needle of" $b = /(?i:HAY)/ condition: all of them }', "h": 'rule h { strings: $a = "hay" $b = "full" $c = "MZ" condition: 2 of them and filesize > 9 }', "i": 'rule i { strings: $a = "aa" condition: #a != 2 or false }'}
    contents = [b"".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(300)] + [b"", b"aa" * 200]
    df = spark.createDataFrame([("t%d" % (i % 2), i, c) for i, c in enumerate([*contents, None])], "tenant_id string, artifact_id long, content binary").repartition(2)
    rules = spark.createDataFrame(list((RULES | more).items()), "rule_id string, source string")
    good = {k: hunts.parse_rule(v) for k, v in (RULES | more).items() if k not in ("bad", "worse")}
    want = []
    for i, c in enumerate(contents):
        for k, r in good.items():
            hits = {p.name: [(m.start(1), len(m[1])) for m in re.finditer(b"(?=(" + p.regex.encode("latin-1") + b"))", c, re.S | (re.I if p.ignore_case else 0))] for p in r.patterns}
            if hunts.holds(hunts.parse_condition(r), {n: len(x) for n, x in hits.items()}, len(c)):
                want += [(f"t{i % 2}", i, k, f"${n}", o, size) for n, x in hits.items() for o, size in x[: scanner.MOST_EVIDENCE]]
    assert sorted(map(tuple, scanner.evidence(df, rules).collect())) == sorted(want)
    exploded = scanner.scan(df, rules).selectExpr("tenant_id", "artifact_id", "explode(matches) AS m").selectExpr("tenant_id", "artifact_id", "m.rule_id", "explode(m.patterns) AS p").select("tenant_id", "artifact_id", "rule_id", "p.*")
    assert sorted(map(tuple, exploded.collect())) == sorted(want)
    assert scanner.evidence(df, rules.where("false")).count() == 0
    # runs that lie across the ends of slabs
    for slab in (1, 5, 64):
        monkeypatch.setattr(scanner, "SLAB", slab)
        one = scanner.Scanner([(k, v) for k, v in (RULES | more).items()])
        got = [(f"t{i % 2}", i, m["rule_id"], p["identifier"], p["offset"], p["length"]) for i, c in enumerate(contents) for m in one.scan(c)[1] for p in m["patterns"]]
        assert sorted(got) == sorted(want)


@pytest.fixture(scope="module")
def costly(spark):
    """A text that asks for more work than the bound, and rules of which one holds."""
    rules = [(f"r{i}", f'rule r{i} {{ strings: $a = "ab" condition: #a == {i} }}') for i in range(5000, 10001)]
    return spark.createDataFrame([("t", 1, b"ab" * 10000)], "tenant_id string, artifact_id long, content binary"), spark.createDataFrame(rules, "rule_id string, source string")


def _failing(monkeypatch):
    of = similar._rules
    bad = [("item_bad", RULES["bad"]), ("item_null", None)]
    monkeypatch.setattr(similar, "_rules", lambda spark, sf_dir: of(spark, sf_dir).unionByName(spark.createDataFrame(bad, "rule_id string, source string")))


def test_scans_that_show_no_status_hide_no_failure(spark, costly, monkeypatch):
    content, rules = costly
    assert scanner.scan(content, rules).first()["status"] == "timeout"
    found = scanner.scan(content, rules, strict=True).first()
    assert found["status"] == "matched" and [m.rule_id for m in found["matches"]] == ["r10000"]
    _failing(monkeypatch)
    with pytest.raises(hunts.RuleError, match="item_bad .*item_null"):
        catalog.queries()["rule_scan"](spark, "/root/testdata/sf0.001")


def test_evidence_hides_no_failure(spark, costly, monkeypatch):
    content, rules = costly
    assert scanner.evidence(content, rules).count() == 0
    places = scanner.evidence(content, rules, strict=True).collect()
    assert [(x.rule_id, x.offset) for x in places] == [("r10000", 2 * i) for i in range(scanner.MOST_EVIDENCE)]
    _failing(monkeypatch)
    with pytest.raises(hunts.RuleError, match="item_bad .*item_null"):
        catalog.queries()["rule_evidence"](spark, "/root/testdata/sf0.001")
