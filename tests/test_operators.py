"""Golden vectors and small scenarios."""

import gzip
import io
import json
import struct
import tarfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stratalog.functions import fuzzy, scalars
from stratalog.operators import analyst, events, graph, hunts, ledger, lifecycle, similarity
from stratalog.sources import parsers

HOUR = 3_600_000_000


@pytest.mark.parametrize("data, digest", [(b"", "3::"), (b"a", "3:E:E"), (b"hello world", "3:iKFSMPn:rJPn"), (b"hello world!", "3:iKFSMPE:rJPE")])
def test_fuzzy_digests(data, digest):
    assert fuzzy.fuzzy_hash(data) == digest


def test_fuzzy_compare(spark):
    a = fuzzy.fuzzy_hash(bytes(i % 251 for i in range(8192)))
    b = bytearray(i % 251 for i in range(8192))
    b[1000] ^= 0xFF
    b[5000] ^= 0xFF
    rows = spark.createDataFrame([(a, a), (a, fuzzy.fuzzy_hash(bytes(b))), ("garbage", a), ("3:abc:de", "24:abc:de")], "a string, b string")
    same, near, bad, far = [r[0] for r in rows.select(scalars.fuzzy_compare(F.col("a"), F.col("b"))).collect()]
    assert (same, bad, far) == (100, 0, 0) and 40 <= near <= 100


def test_entropy_and_hmac(spark):
    assert fuzzy.entropy(bytes(100)) == 0 and fuzzy.entropy(bytes(range(256))) == 8
    row = spark.createDataFrame([(b"Jefe", b"what do ya want for nothing?")], "k binary, m binary").select(fuzzy.hmac_sha256_udf("k", "m")).first()
    assert row[0] == "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"


def test_classify(spark):
    pe = bytearray(0x80)
    pe[:2], pe[0x3C:0x40], pe[0x40:0x44] = b"MZ", struct.pack("<I", 0x40), b"PE\0\0"
    data = [bytes(pe), b"MZ" + bytes(70), b"\x7fELF\x02", b"\xca\xfe\xba\xbe", b"\xcf\xfa\xed\xfe", b"#!/bin/sh", b"", b"#"]
    got = [r[0] for r in spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "i int, d binary").orderBy("i").select(scalars.classify_bytes(F.col("d"))).collect()]
    assert got == ["pe", "unknown", "elf", "macho_fat", "macho", "script", "unknown", "unknown"]


def test_dropper_takes_first_sightings_alone(spark):
    t0 = 1_717_236_000_000_000
    rows = [("t", 1, "h1", "/tmp/bad", t0), ("t", 2, "h1", "/tmp/helper", t0 + HOUR), ("t", 4, "h1", "/old", t0 - 48 * HOUR), ("t", 4, "h1", "/old", t0 + HOUR)]
    rows += [("t", 3, f"h{k}", "/common", t0 + HOUR) for k in range(1, 5)] + [("other", 2, "h1", "/x", t0)]
    occ = spark.createDataFrame(rows, "tenant_id string, artifact_id long, host_name string, path string, observed_at long")
    seeds = spark.createDataFrame([("t", 1)], "tenant_id string, artifact_id long")
    got = analyst.dropper_candidates(occ, seeds, window_us=24 * HOUR, max_hosts=3).collect()
    assert [(r.tenant_id, r.artifact_id, r.host_count, r.min_time_delta_secs) for r in got] == [("t", 2, 1, 3600)]
    rare = analyst.rarity_search(occ, max_hosts=1)
    assert {(r.tenant_id, r.artifact_id) for r in rare.collect()} == {("t", 1), ("t", 2), ("t", 4), ("other", 2)}


def test_rules():
    rule = hunts.parse_rule('rule Demo { strings: $a = "MARK" nocase $h = { 4D ?? 5A } $r = /ab+c/ condition: any of them and filesize < 1KB }')
    assert rule.name == "Demo" and [p.kind for p in rule.patterns] == ["text", "hex", "regex"]
    for bad in ("// rule x", "rule a {} rule b {}", "rule 1x { condition: true }"):
        with pytest.raises(hunts.RuleError):
            hunts.parse_rule(bad)


def test_scan_counts_bytes(spark):
    source = 'rule Two { strings: $a = "mark" nocase $b = { ff ?? 01 } condition: #a == 2 or ($b and not $a) }'
    data = [b"Mark xx MARK", b"mark", b"\xff\x00\x01", "é mark".encode()]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "i int, content binary")
    found, failed = hunts.scan(df, [source, "rule Bad { condition: pe.is_dll() }"])
    assert [r.rules for r in found.orderBy("i").collect()] == [["Two"], [], ["Two"], []] and len(failed) == 1


def test_hunt_counts_cached_failures(spark):
    out = spark.createDataFrame([("t", 1, "timeout", 0, True), ("t", 2, "error", 0, False), ("t", 3, "clean", 0, True)], "tenant_id string, artifact_id long, status string, n_rules int, cached boolean")
    r = hunts.counters(out).first()
    assert (r.scanned, r.cache_hits, r.timed_out, r.failed, r.state) == (0, 2, 1, 1, "COMPLETED_PARTIAL")


def test_finalize_and_announce(spark):
    staged = spark.createDataFrame([(bytearray(b"x"), 1, "2D711642B726B04401627CA9FBAC32F5C8530FB1903CC4DB02258717921A4881"), (bytearray(b"y"), 1, "00")], "content binary, size_bytes long, announced string")
    assert [r.outcome for r in ledger.finalize(staged).orderBy("announced").collect()] == ["HASH_MISMATCH", "CAPTURED"]


def test_stix_and_sandbox(spark):
    bundle = {"objects": [{"type": "indicator", "id": "i1", "pattern": f"[file:hashes.'SHA-256' = '{'A' * 64}']"}, {"type": "indicator", "id": "i2", "pattern": f"[file:hashes.MD5 = '{'b' * 32}']"},
                          {"type": "indicator", "id": "i3", "pattern": "[domain-name:value = 'x.example']"}, {"type": "marking-definition"}]}
    got = events.stix_indicators(spark.createDataFrame([(json.dumps(bundle),)], "bundle string")).collect()
    assert {(r.ioc_type, r.value) for r in got} == {("sha256", "a" * 64), ("md5", "b" * 32)}
    report = {"signatures": [{"name": "n", "description": "d", "severity": 3}, {}], "ttps": [{"ttp": "T1055"}, {"ttp": "T1027"}]}
    found = spark.createDataFrame([(json.dumps(report),)], "r string").select(events.sandbox_findings(F.col("r"))).first()[0]
    assert [f.category for f in found] == ["signature", "signature", "attack", "attack"]


def test_greedy_coverage(spark):
    f = [("t", 1, 10, ["a", "b", "c"]), ("t", 1, 20, ["a", "b", "c"]), ("t", 1, 30, ["a", "b", "c"]), ("t", 2, 5, ["a", "b", "c"])]
    functions = spark.createDataFrame(f, "tenant_id string, artifact_id long, offset long, tokens array<string>")
    r = similarity.coverage(functions, spark.createDataFrame([("t", 1, 2)], "tenant_id string, src long, dst long")).first()
    assert (round(r.a_to_b, 3), r.b_to_a, r.matched_pairs, r.contested_a, r.top) == (0.333, 1.0, 1, 2, "10-5")


def test_groups_and_export(spark):
    edges = spark.createDataFrame(
        [("t", i, i + 1, "normalized_equivalent", 1.0) for i in range(20)] + [("t", 50, 51, "byte_similar", 60.0), ("u", 1, 2, "exact_copy", 1.0)], "tenant_id string, src long, dst long, edge_type string, score double")
    g = {(r.tenant_id, r.artifact_id): r.group_id for r in graph.variant_groups(edges).collect()}
    assert len(g) == 23 and {v for (t, _), v in g.items() if t == "t"} == {0}
    near = graph.neighborhood(edges, spark.createDataFrame([("t", 10)], "tenant_id string, artifact_id long"), depth=2)
    assert sorted(r.node for r in near.collect()) == [8, 9, 10, 11, 12]
    for fmt in ("json", "dot", "graphml"):
        assert "11" in graph.export(near, edges.where("tenant_id = 't' AND src BETWEEN 8 AND 11"), fmt)


def test_byte_edges(spark):
    a = bytes(i % 251 for i in range(8192))
    b = bytearray(a)
    b[1000] ^= 0xFF
    rows = [("t", 1, "x", 8192, 7.9, fuzzy.fuzzy_hash(a)), ("t", 2, "x", 8192, 7.9, fuzzy.fuzzy_hash(bytes(b))), ("t", 3, "y", 8192, 7.9, fuzzy.fuzzy_hash(a))]
    feature = spark.createDataFrame(rows, "tenant_id string, artifact_id long, artifact_class string, size_bytes long, entropy double, fuzzy string")
    bands = feature.select("tenant_id", "artifact_id", F.posexplode(scalars.lsh_bands(F.col("fuzzy"))).alias("band_idx", "band_key"))
    got = similarity.byte_edges(similarity.candidates(bands), feature).collect()
    assert [(r.src, r.dst) for r in got] == [(1, 2)] and got[0].score >= 40


def test_archives_and_journals(spark):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for name, body in (("bin/demo", b"\x7fELFxxxx"), ("etc/note", b"hi")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    layer = gzip.compress(raw.getvalue())
    parsers.register(spark)
    spark.createDataFrame([(bytearray(layer),)], "d binary").createOrReplaceTempView("layers")
    assert [tuple(r) for r in spark.sql("SELECT path, size FROM layers, LATERAL tar_members(d)").collect()] == [("bin/demo", 8), ("etc/note", 2)]
    taken, gaps = parsers.import_images(spark, spark.createDataFrame([("img", "sha256:1", bytearray(layer))], "image string, digest string, content binary"))
    assert [r.path for r in taken.collect()] == ["bin/demo"] and gaps.count() == 0
    name = "a.txt".encode("utf-16-le")
    record = struct.pack("<IHHQQqqIIIIHH", 60 + len(name), 2, 0, 7, 8, 99, 0, 0x100, 0, 0, 0, len(name), 60) + name
    assert list(parsers.usn_records(record + b"\1")) == [(99, 7, 8, 0x100, "a.txt")]
    assert list(parsers.usn_records(record[:30])) == []
    note = struct.pack("<III", 12 + len(name) + 2, 1, len(name)) + name + b"\0\0" + struct.pack("<III", 0, 3, len(name)) + name
    assert list(parsers.notify_records(note)) == [(1, "a.txt"), (3, "a.txt")]
    assert parsers.pe_features(b"MZ" + bytes(100)) is None and parsers.elf_features(b"\x7fELF") is None
    assert parsers.prologues(bytes(16) + b"\x55\x48\x89\xe5" + bytes(44) + b"\xf3\x0f\x1e\xfa" + bytes(1)) == [16, 64]


def test_directory_import(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"f{k}").write_bytes(b"#!x" if k % 2 else b"plain%d" % k)
    got = parsers.import_directory(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.seq for r in got] == [1, 2, 3, 4, 5] and got[0].content == b"plain0" and [r.path[-2:] for r in got] == ["f0", "f1", "f2", "f3", "f4"]


def test_import_loses_no_file(spark, tmp_path):
    for k in range(1200):
        (tmp_path / f"{k:04d}").write_bytes(b"%d" % k * 300)
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = [(r.seq, r.path[-4:], r.content[:4]) for r in parsers.import_directory(spark, str(tmp_path)).select("seq", "path", "content").collect()]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sorted(got) == [(k + 1, f"{k:04d}", (b"%d" % k * 300)[:4]) for k in range(1200)]


def test_an_empty_artifact_passes_the_gates_or_not(spark):
    rows = [("t", 1, "x", 0, 0.0, "3::"), ("t", 2, "x", 4, 0.0, "3:a:a"), ("t", 3, "x", 5, 0.0, "3:a:a")]
    feature = spark.createDataFrame(rows, "tenant_id string, artifact_id long, artifact_class string, size_bytes long, entropy double, fuzzy string")
    pairs = spark.createDataFrame([("t", 1, 2), ("t", 1, 3), ("t", 2, 3)], "tenant_id string, src long, dst long")
    assert [(r.src, r.dst) for r in similarity.byte_edges(pairs, feature).collect()] == [(2, 3)]
    none = spark.createDataFrame([(1, b""), (2, None), (3, b"ab")], "k long, c binary")
    assert {r.k: r.entropy for r in similarity.entropy(none, ["k"], F.col("c")).collect()} == {1: 0.0, 2: 0.0, 3: 1.0}


def test_saved_images_name_every_tag_and_leave_large_layers_to_a_gap():
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for name, body in (("manifest.json", b'[{"RepoTags": ["a:1", "a:2"], "Layers": ["l0", "l1"]}]'), ("l0", b"x" * 100), ("l1", b"y" * 2000)):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    got = [(t, at, size, body is None) for t, at, size, body in parsers.docker_layers(raw.getvalue(), most=1000)]
    assert got == [(t, at, size, size > 1000) for t in ("a:1", "a:2") for at, size in ((0, 100), (1, 2000))]


def test_times_and_names(spark):
    now = datetime.fromisoformat("2024-06-01T10:00:00+00:00")
    assert (now - scalars.parse_since("30d", now)).days == 30 and scalars.parse_since("2024-01-01T00:00:00Z", now).month == 1
    slugs = spark.createDataFrame([("a",), ("a-b",), ("-a",), ("A",), ("a" * 64,)], "s string").select(scalars.valid_slug(F.col("s"))).collect()
    assert [r[0] for r in slugs] == [True, True, False, False, False]


def test_functions_without_tokens_are_alike(spark):
    rows = [("t", 1, 0, []), ("t", 1, 9, [5, 6]), ("t", 2, 0, []), ("t", 2, 9, [7])]
    functions = spark.createDataFrame(rows, "tenant_id string, artifact_id long, offset long, tokens array<long>")
    got = similarity.coverage(functions, spark.createDataFrame([("t", 1, 2)], "tenant_id string, src long, dst long")).collect()[0]
    assert (got.matched_pairs, got.a_to_b, got.unmatched_a) == (1, 0.5, 1)


def test_neighbourhood_lists_the_edges_of_expanded_nodes(spark):
    e = spark.createDataFrame([("t", 1, 2, "byte_similar", 1.0), ("t", 1, 3, "byte_similar", 1.0), ("t", 2, 3, "byte_similar", 1.0)], "tenant_id string, src long, dst long, edge_type string, score double")
    seed = spark.createDataFrame([("t", 1)], "tenant_id string, artifact_id long")
    for most in (10, 2):
        nodes, edges, flags = lifecycle.bounded_view(e, seed, depth=1, most_nodes=most)
        assert {(r.src, r.dst) for r in edges.collect()} == {(1, 2), (1, 3)} and flags.collect()[0].truncated == (most == 2)
    assert {(r.src, r.dst) for r in lifecycle.bounded_view(e, seed, depth=2)[1].collect()} == {(1, 2), (1, 3), (2, 3)}
    wide = spark.createDataFrame([("t", 1, i, "b" * 6000, 1.0) for i in range(2, 102)], "tenant_id string, src long, dst long, edge_type string, score double")
    assert lifecycle.bounded_view(wide, seed)[2].collect()[0].too_large


def test_one_index_finds_every_literal(spark):
    rules = spark.createDataFrame([("a", "abc"), ("b", "bc"), ("c", ""), ("d", None), ("e", "abc"), ("f", "日本")], "rule_id string, literal string")
    content = spark.createDataFrame([("t", 1, "xabcx"), ("t", 2, None), ("t", 3, ""), ("t", 4, "in 日本")], "tenant_id string, artifact_id long, text string")
    got = {(r.artifact_id, r.rule_id) for r in hunts.literal_matches(content, rules).collect()}
    assert got == {(1, "a"), (1, "b"), (1, "c"), (1, "e"), (3, "c"), (4, "c"), (4, "f")}
    assert hunts.literal_matches(content, rules.limit(0)).count() == 0


def test_groups_that_do_not_settle_raise(spark):
    chain = spark.createDataFrame([("t", i, i + 1, "exact_copy") for i in range(40)], "tenant_id string, src long, dst long, edge_type string")
    with pytest.raises(RuntimeError):
        graph.variant_groups(chain, rounds=2)
    assert graph.variant_groups(chain).select("group_id").distinct().count() == 1


def test_prologues_near_the_end():
    assert parsers.prologues(bytes(8) + b"\x48\x89\x5c" + bytes(30)) == [8]
    assert parsers.prologues(bytes(8) + b"\x40\x53") == []
    # what begins four bytes before the end isn't looked at
    assert parsers.prologues(bytes.fromhex("9090909040539090")) == [] and parsers.prologues(bytes.fromhex("554889e5")) == [] and parsers.prologues(bytes.fromhex("554889e590")) == [0]


def test_lookups_and_bounds(spark):
    df = spark.range(5).withColumnRenamed("id", "rule_id")
    assert lifecycle.lookup(df, "rule_id", 3).count() == 1 and lifecycle.populated(df) and not lifecycle.populated(df.limit(0))
    with pytest.raises(lifecycle.NotFound):
        lifecycle.lookup(df, "rule_id", 9)
    e = spark.createDataFrame([("t", 0, i, "byte_similar", 1.0 * i) for i in range(1, 10)], "tenant_id string, src long, dst long, edge_type string, score double")
    nodes, edges, flags = lifecycle.bounded_view(e, spark.createDataFrame([("t", 0)], "tenant_id string, artifact_id long"), most_nodes=4, most_edges=2)
    assert {r.node for r in nodes.collect()} == {0, 1, 2, 3} and {r.dst for r in edges.collect()} == {8, 9} and flags.collect()[0].truncated
    assert lifecycle.edge_filter(e, min_score=5, include_weak=False).count() == 0 and lifecycle.page(df, ["rule_id"], 10, 5).count() == 0
