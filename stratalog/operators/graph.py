"""Similarity edges as a graph: canonical edges, variant groups, neighbourhoods, views, exports, supersession."""

from __future__ import annotations

import json
import tempfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Edge types that put their ends into one variant group.
MERGING = ("exact_copy", "normalized_equivalent", "semantic_variant_strong")
MOST_DEPTH, MOST_NODES, MOST_EDGES, MOST_EXPORT_BYTES = 4, 256, 1024, 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; in local mode without the setting a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.gettempdir() + "/stratalog-graph"


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def canonical(edge: DataFrame) -> DataFrame:
    """One row for each undirected (tenant, pair, type), its smaller end first."""
    ends = edge.where("src <> dst").withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
    return ends.dropDuplicates(["tenant_id", "src", "dst", "edge_type"])


def both_ways(edge: DataFrame) -> DataFrame:
    """Every edge from both of its ends: (node, other)."""
    rest = [c for c in edge.columns if c not in ("src", "dst")]
    return edge.select(F.col("src").alias("node"), F.col("dst").alias("other"), *rest).unionByName(edge.select(F.col("dst").alias("node"), F.col("src").alias("other"), *rest))


def variant_groups(edge: DataFrame, rounds: int = 50) -> DataFrame:
    """(tenant_id, artifact_id, group_id): components of merging edges, named by their least member; singletons have none.

    Each round a node takes the least label among its neighbours and then the
    label of its label (pointer jumping), so rounds grow with the logarithm of
    a chain's length.
    """
    links = durable(both_ways(edge.where(F.col("edge_type").isin(*MERGING))).select("tenant_id", "node", "other").distinct())
    label = links.select("tenant_id", "node").distinct().withColumn("label", F.col("node"))
    before = None
    for _ in range(rounds):
        near = links.join(label.select("tenant_id", F.col("node").alias("other"), "label"), ["tenant_id", "other"]).groupBy("tenant_id", "node").agg(F.min("label").alias("near"))
        least = label.join(near, ["tenant_id", "node"]).select("tenant_id", "node", F.least("label", "near").alias("label"))
        jump = least.select("tenant_id", F.col("node").alias("label"), F.col("label").alias("root"))
        label = durable(least.join(jump, ["tenant_id", "label"], "left").select("tenant_id", "node", F.least("label", F.coalesce("root", "label")).alias("label")))
        now = label.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"groups did not settle in {rounds} rounds")
    return label.select("tenant_id", F.col("node").alias("artifact_id"), F.col("label").alias("group_id"))


def group_members(groups: DataFrame, seeds: DataFrame) -> DataFrame:
    """Everyone in the seeds' groups."""
    wanted = groups.join(seeds, ["tenant_id", "artifact_id"], "left_semi").select("tenant_id", "group_id").distinct()
    return groups.join(wanted, ["tenant_id", "group_id"], "left_semi")


def expand(edge: DataFrame, seeds: DataFrame, *, depth: int, most_nodes: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (tenant_id, node, depth) within so many steps, at most most_nodes a tenant, and the tenants that were cut.

    Each frontier is cut to what the cap leaves as it is reached, the least ids first, so no more than most_nodes of a
    tenant are ever expanded.
    """
    links = both_ways(edge).select("tenant_id", "node", "other").distinct()
    room = W.partitionBy("tenant_id").orderBy("node")
    first = durable(seeds.select("tenant_id", F.col("artifact_id").alias("node")).distinct().withColumn("__n", F.row_number().over(room)).withColumn("__over", F.col("__n") > most_nodes))
    cut = first.where("__over").select("tenant_id")
    seen = front = first.where("NOT __over").select("tenant_id", "node", F.lit(0).alias("depth"))
    for step in range(1, min(depth, MOST_DEPTH) + 1):
        reached = links.join(front.select("tenant_id", "node"), ["tenant_id", "node"]).select("tenant_id", F.col("other").alias("node")).distinct()
        new = reached.join(seen, ["tenant_id", "node"], "left_anti")
        held = seen.groupBy("tenant_id").agg(F.count("*").alias("__held"))
        ranked = durable(new.withColumn("__n", F.row_number().over(room)).join(held, "tenant_id").withColumn("__over", F.col("__n") + F.col("__held") > most_nodes))
        cut = cut.unionByName(ranked.where("__over").select("tenant_id"))
        front = ranked.where("NOT __over").select("tenant_id", "node", F.lit(step).alias("depth"))
        seen = seen.unionByName(front)
    return seen, cut.distinct()


def neighborhood(edge: DataFrame, seeds: DataFrame, *, depth: int = 1, min_score: float | None = None, types: tuple[str, ...] | None = None, most_nodes: int = MOST_NODES) -> DataFrame:
    """(tenant_id, node, depth): nodes within so many steps, the nearest first, at most most_nodes a tenant."""
    kept = edge
    if min_score is not None:
        kept = kept.where(F.col("score") >= min_score)
    if types:
        kept = kept.where(F.col("edge_type").isin(*types))
    return expand(kept, seeds, depth=depth, most_nodes=most_nodes)[0]


def touching(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end in a set (tenant_id, artifact_id), each once."""
    a = nodes.select("tenant_id", F.col("artifact_id").alias("src"))
    b = nodes.select("tenant_id", F.col("artifact_id").alias("dst"))
    from_src = edge.join(a, ["tenant_id", "src"], "left_semi")
    return from_src.select(*edge.columns).unionByName(edge.join(b, ["tenant_id", "dst"], "left_semi").join(a, ["tenant_id", "src"], "left_anti").select(*edge.columns))


def inside(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in a set (tenant_id, artifact_id)."""
    a = nodes.select("tenant_id", F.col("artifact_id").alias("src"))
    b = nodes.select("tenant_id", F.col("artifact_id").alias("dst"))
    return edge.join(a, ["tenant_id", "src"], "left_semi").join(b, ["tenant_id", "dst"], "left_semi")


def weak_leads(edge: DataFrame, groups: DataFrame) -> DataFrame:
    """Other artifacts that a group's members touch by edges that merge nothing: (tenant_id, group_id, other)."""
    weak = both_ways(edge.where(~F.col("edge_type").isin(*MERGING))).select("tenant_id", F.col("node").alias("artifact_id"), "other")
    led = weak.join(groups, ["tenant_id", "artifact_id"]).select("tenant_id", "group_id", "other").distinct()
    own = groups.select("tenant_id", "group_id", F.col("artifact_id").alias("other"))
    return led.join(own, ["tenant_id", "group_id", "other"], "left_anti")


def supersede(edge: DataFrame, *, before: str, note: str) -> DataFrame:
    """Marks edges of another model version in their evidence (JSON), once."""
    done = F.coalesce(F.get_json_object("evidence", "$.superseded") == "true", F.lit(False))
    old = (F.col("model_version") == before) & ~done
    merged = F.to_json(F.map_concat(F.from_json(F.coalesce("evidence", F.lit("{}")), "map<string,string>"), F.create_map(F.lit("superseded"), F.lit("true"), F.lit("superseded_by"), F.lit(note))))
    return edge.withColumns({"was_superseded": old, "evidence": F.when(old, merged).otherwise(F.col("evidence"))})


def current(edge: DataFrame) -> DataFrame:
    return edge.where(F.coalesce(F.get_json_object("evidence", "$.superseded"), F.lit("false")) != "true")


def export(nodes: DataFrame, edges: DataFrame, fmt: str = "json") -> str:
    """A small graph (bounded by a neighbourhood's caps) as json, dot or graphml text in a fixed order."""
    n = sorted(r[0] for r in nodes.select("node").limit(MOST_NODES + 1).collect())
    e = sorted((r["src"], r["dst"], r["edge_type"], float(r["score"])) for r in edges.select("src", "dst", "edge_type", "score").limit(MOST_EDGES + 1).collect())
    if len(n) > MOST_NODES or len(e) > MOST_EDGES:
        raise ValueError("too large to export")
    if fmt == "json":
        text = json.dumps({"nodes": n, "edges": [dict(zip(("src", "dst", "type", "score"), x, strict=True)) for x in e]})
    elif fmt == "dot":
        text = "graph variants {\n" + "".join(f'  "{x}";\n' for x in n) + "".join(f'  "{a}" -- "{b}" [label="{t} {s:g}"];\n' for a, b, t, s in e) + "}\n"
    elif fmt == "graphml":
        body = "".join(f'<node id="{x}"/>' for x in n) + "".join(f'<edge source="{a}" target="{b}"><data key="type">{escape(t)}</data><data key="score">{s:g}</data></edge>' for a, b, t, s in e)
        text = f'<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="type" for="edge" attr.name="type"/><key id="score" for="edge" attr.name="score"/><graph edgedefault="undirected">{body}</graph></graphml>'
    else:
        raise ValueError(f"unknown format {fmt}")
    if len(text.encode()) > MOST_EXPORT_BYTES:
        raise ValueError("too large to export")
    return text
