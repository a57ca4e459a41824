"""Every registered query of the library against its DuckDB twin."""

import duckdb
import pytest

from stratalog.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_twin(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key)


def test_function_coverage_is_one_to_one(spark):
    rows = catalog.queries()["function_coverage"](spark, SF).collect()
    assert rows and all(0 <= r.a_to_b <= 1 and 0 <= r.b_to_a <= 1 and r.contested_a >= 0 and r.unmatched_b >= 0 for r in rows)


def test_whole_graph_equals_union_find(spark, tmp_path):
    orders = spark.createDataFrame([(k, k * 37 % 1500 + 1, "O", "1-URGENT") for k in range(1, 6001)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    edges, root = set(), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k in range(1, 6001):
        a, b = k * 37 % 1500 + 1, k * 7 % 1000
        kind = "normalized_equivalent" if k % 12 == 0 else "semantic_variant_strong" if k % 12 == 1 else "byte_similar" if k % 3 == 1 else "shared_provenance"
        if a != b:
            edges.add((f"t{a % 3}", min(a, b), max(a, b), kind))
    strong = ("normalized_equivalent", "semantic_variant_strong")
    for t, a, b, kind in edges:
        if kind in strong:
            x, y = sorted((find((t, a)), find((t, b))))
            root[y] = x
    group = {x: find(x)[1] for x in root}
    run = lambda name: {tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
    assert run("canonical_edges") == edges
    assert run("variant_groups") == {(t, n, g) for (t, n), g in group.items()}
    members = {}
    for (t, n), g in group.items():
        members.setdefault((t, g), set()).add(n)
    assert run("group_members") == {(t, g, len(m), min(m), max(m)) for (t, g), m in members.items()}
    assert run("intra_group_edges") == {e for e in edges if e[:2] in group and (e[0], e[2]) in group}
    ways = {(t, *w, kind) for t, a, b, kind in edges for w in ((a, b), (b, a))}
    assert run("weak_leads") == {(t, group[t, a], b) for t, a, b, kind in ways if kind not in strong and (t, a) in group and b not in members[t, group[t, a]]}
    depth = {(t, 7): 0 for t, a, _, _ in ways if a == 7}
    for d in (1, 2):
        for t, b in {(t, b) for t, a, b, _ in ways if depth.get((t, a)) == d - 1} - set(depth):
            depth[t, b] = d
    got = {(r.tenant_id, r.node, r.depth) for r in catalog.queries()["neighborhood_bfs"](spark, str(tmp_path)).collect()}
    assert got == {(t, n, d) for (t, n), d in depth.items()}
    assert len(run("import_set_hash")) == 6000


def test_every_document_reaches_the_indicators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = catalog.queries()["indicator_upsert"](spark, SF)
    assert found.select("value").distinct().count() == docs.select("text").distinct().count()
    assert catalog.queries()["stix_hash_tokens"](spark, SF).count() == 2 * docs.where("lang = 'en'").count() > 0
