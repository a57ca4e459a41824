"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that may
count a document); the few patterns and sources form a flow network: from each
pattern run three arcs of its token capacity, at costs 0, 1 and 2 for the first,
second and third use of a document (convex, so repeats come last); arcs lead to
the pattern's sources, and from each source to the sink its quota. The
cheapest flow says how many tokens each source takes from each pattern.
Documents are then chosen in a seeded order until a pattern's tokens are met.

Selection is exact without putting a source into one task: sizes are summed by
(pattern, hash bucket), buckets are prefix-summed, and the documents of one
bucket are ranked among themselves; a bucket has some thousands of documents
whatever the input.

Null and empty texts have size 0; documents of size 0 are never taken; a very
long text counts whole. A null source is a source of its own, the last, and so
are a null and an empty array of sources. Repeated rows count as often as they
stand and are told apart in no way, so any of them may be the one at the
boundary. An empty table gives an empty result. Other columns stay as they are,
whatever their names; those of the results are refused.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalog.llm.common import WORD, durable

#: Uses of a document at most.
MOST_USES = 3
#: Documents in a bucket, about.
BUCKET_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict) -> dict:
    """Shares of the total by weight; none above MOST_USES times its source's size, the excess shared anew."""
    total, capped, out = float(sum(sizes.values())), {}, {}
    while True:
        rest = [s for s in sizes if s not in capped]
        left, scale = total - sum(capped.values()), sum(weights[s] for s in rest)
        out = capped | {s: left * weights[s] / scale for s in rest}
        above = [s for s in rest if out[s] > MOST_USES * sizes[s]]
        if not above:
            return out
        capped |= {s: float(MOST_USES * sizes[s]) for s in above}


def min_cost_flow(capacity: dict[tuple, int], quota: dict[str, int]) -> dict[tuple, dict[str, int]]:
    """capacity: of a pattern (a tuple of sources) once; quota: of a source. Tokens from each pattern to each source.

    Successive shortest paths with potentials; path lengths are at most the
    number of patterns and sources, and each augmentation fills an arc.
    """
    patterns, sources = sorted(capacity, key=repr), sorted(quota, key=repr)
    n = len(patterns) + len(sources) + 2
    node = {("p", p): i + 1 for i, p in enumerate(patterns)} | {("s", s): len(patterns) + 1 + i for i, s in enumerate(sources)}
    end = n - 1
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]

    def arc(a: int, b: int, c: int, w: int) -> None:
        for x, y, k, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(v)

    for p in patterns:
        for use in range(MOST_USES):
            arc(0, node["p", p], capacity[p], use)
        for s in p:
            if s in quota:
                arc(node["p", p], node["s", s], MOST_USES * capacity[p], 0)
    for s in sources:
        arc(node["s", s], end, quota[s], 0)
    high = [0] * n
    while True:
        dist, back, heap = [float("inf")] * n, [-1] * n, [(0, 0)]
        dist[0] = 0
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for e in out[a]:
                far = d + cost[e] + high[a] - high[to[e]]
                if cap[e] > 0 and far < dist[to[e]]:
                    dist[to[e]], back[to[e]] = far, e
                    heapq.heappush(heap, (far, to[e]))
        if dist[end] == float("inf"):
            break
        high = [h + (d if d < float("inf") else 0) for h, d in zip(high, dist, strict=True)]
        path, a = [], end
        while a:
            path.append(back[a])
            a = to[back[a] ^ 1]
        most = min(cap[e] for e in path)
        for e in path:
            cap[e] -= most
            cap[e ^ 1] += most
    flow: dict[tuple, dict[str, int]] = {p: {} for p in patterns}
    for p in patterns:
        for e in out[node["p", p]]:
            if e % 2 == 0 and to[e] > len(patterns) and cap[e ^ 1]:
                flow[p][sources[to[e] - len(patterns) - 1]] = cap[e ^ 1]
    return flow


_OWN = frozenset(("__size", "__source_size", "__target", "__taken", "__members", "__key", "__draw", "__bucket", "__before", "__tokens", "__held"))


def mix(docs: DataFrame, size: Column, members: Column, *, weights: dict | None = None, seed: int = 7) -> DataFrame:
    """All columns of docs and __size, __source_size, __target, __taken.

    members: array<string>, the sources that may count a document; its first one
    is the source whose size and target it reports. weights: by source; without
    them 1, 2, 3, repeating, by code point, null last.
    """
    if clash := {c for c in docs.columns if c in _OWN}:
        raise ValueError(f"columns of the result: {sorted(clash)}")
    whole = F.when(F.size(F.coalesce(members, F.array().cast("array<string>"))) > 0, members).otherwise(F.array(F.lit(None).cast("string")))
    given = docs.withColumns({"__size": size, "__members": whole})
    by_pattern = given.groupBy("__members").agg(F.sum("__size").alias("n"), F.count("*").alias("rows")).collect()
    rows = sum(r["rows"] for r in by_pattern)
    capacity = {tuple(r[0]): int(r["n"]) for r in by_pattern}
    sizes: dict = {}
    for p, n in capacity.items():
        sizes[p[0]] = sizes.get(p[0], 0) + n
        for s in p[1:]:
            sizes.setdefault(s, 0)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = weights or {s: i % 3 + 1 for i, s in enumerate(order)}
    reach = {s: sum(n for p, n in capacity.items() if s in p) for s in sizes}
    goal = targets(sizes, weights) if all(len(p) == 1 for p in capacity) else {s: min(g, MOST_USES * reach[s]) for s, g in targets(reach, weights).items()}
    flow = min_cost_flow(capacity, {s: round(goal[s]) for s in sizes})
    spark = docs.sparkSession
    plan = [(list(p), sizes[p[0]], float(goal[p[0]]), sum(flow[p].values()), capacity[p]) for p in capacity]
    # one row for each pattern, as many as the catalogue has
    table = spark.createDataFrame(plan, "m array<string>, __source_size long, __target double, __tokens long, __held long")
    key = F.to_json(F.col("__members"), {"ignoreNullFields": "false"})
    table = table.withColumn("__key", F.to_json(F.col("m"), {"ignoreNullFields": "false"})).drop("m")
    if len(plan) <= 100_000:
        table = F.broadcast(table)
    buckets = max(1, rows // BUCKET_ROWS)
    drawn = given.withColumn("__key", key).join(table, "__key", "left")
    fixed = F.xxhash64(*[F.col(c) for c in docs.columns if dict(docs.dtypes)[c].split("<")[0] in ("bigint", "int", "string", "double")], F.lit(seed))
    drawn = drawn.withColumn("__draw", fixed).withColumn("__bucket", F.pmod(F.col("__draw"), F.lit(buckets)))
    before = drawn.groupBy("__key", "__bucket").agg(F.sum("__size").alias("b")).withColumn(
        "__before", F.sum("b").over(W.partitionBy("__key").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))).select("__key", "__bucket", F.coalesce("__before", F.lit(0)).alias("__before"))
    upto = F.col("__before") + F.coalesce(F.sum("__size").over(W.partitionBy("__key", "__bucket").orderBy("__draw", *[c for c in docs.columns if c == "doc_id"]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    full = F.when(F.col("__held") > 0, F.floor(F.col("__tokens") / F.col("__held"))).otherwise(0).cast("long")
    rest = F.col("__tokens") - full * F.col("__held")
    # the document at the boundary gives the words still wanting
    part = F.greatest(F.lit(0), F.least(F.col("__size"), rest - upto))
    taken = F.least(MOST_USES * F.col("__size"), full * F.col("__size") + part)
    return drawn.join(before, ["__key", "__bucket"]).withColumn("__taken", taken.cast("long")).select(
        *docs.columns, "__size", "__source_size", "__target", "__taken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix(durable(docs), F.col("size"), F.array("source"))
    return mixed.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))
