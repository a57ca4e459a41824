"""Life cycles of hunts, edges, indexes and artifacts: enqueue, forward counters, views, bounded neighbourhoods, clean-up, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalog.operators import graph

KEY = ["tenant_id", "artifact_id"]
#: Conditions that a trigger may name, the least instructions of a function that tells something, and a page's bounds.
CONDITIONS = ("hunt_match", "malicious_verdict", "variant_join")
OPEN_STATES = ("QUEUED", "RUNNING", "VALIDATING", "PLANNED", "DRAFT")
MOST_RESPONSE_BYTES = 512 << 10
LEAST_INSTRUCTIONS, MOST_PAGE = 5, 1000


class NotFound(LookupError):
    pass


# --- writes ---------------------------------------------------------------------------


def put_absent(incoming: DataFrame, store: DataFrame, key: str = "sha256") -> DataFrame:
    """Blobs whose digest the store lacks, each once: a commit that never overwrites."""
    return incoming.dropDuplicates([key]).join(store.select(key).distinct(), key, "left_anti")


def replace_index(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """An index in which the rows of re-analysed artifacts are those of `fresh` alone."""
    return index.join(fresh.select(*KEY).distinct(), KEY, "left_anti").unionByName(fresh)


def append_gaps(gaps: DataFrame, batch: list[str], order: list[str]) -> DataFrame:
    """Gap events of a batch under the host of its first event."""
    first = gaps.groupBy(*batch).agg(F.min_by("host_name", F.struct(*order)).alias("host_name"))
    return gaps.drop("host_name").join(first, batch)


def checked_triggers(trigger: DataFrame) -> DataFrame:
    """trigger (url, condition): adds `error`, null for one that may be created. The condition is looked at first."""
    web = F.coalesce(F.col("url").startswith("http://") | F.col("url").startswith("https://"), F.lit(False))
    return trigger.withColumn("error", F.when(~F.coalesce(F.col("condition").isin(*CONDITIONS), F.lit(False)), "condition").when(~web, "url"))


def backdated(snapshot: DataFrame, taken_at: Column, received_at: Column) -> DataFrame:
    """A snapshot's files as occurrences observed when it was taken and truthfully received now."""
    return snapshot.withColumns({"observed_at": taken_at, "received_at": received_at})


def still_to_walk(files: DataFrame, done: DataFrame, path: str = "path") -> DataFrame:
    """Files outside the top directories that an interrupted walk had finished: done (top)."""
    return files.withColumn("top", F.split_part(F.ltrim(F.col(path), F.lit("/")), F.lit("/"), F.lit(1))).join(done.select("top").distinct(), "top", "left_anti")


# --- hunts ----------------------------------------------------------------------------


def enqueue(hunt: DataFrame, artifact: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """hunt (tenant_id, hunt_id, kind, state, watermark): pins a watermark once, plans what it covers, starts its counters anew.

    Only retro hunts that neither wait nor run are queued; others stay as they are, with `error` kind or state. One
    whose bundle doesn't compile, broken (tenant_id, hunt_id), fails with `error` compile. The watermark is the last of
    all committed artifacts, the plan counts committed endpoint artifacts up to it; a watermark that stands is kept, so
    a hunt that runs again covers what it covered.
    """
    bad = broken.select("tenant_id", "hunt_id").distinct().withColumn("__bad", F.lit(True)) if broken is not None else None
    asked = hunt.join(bad, ["tenant_id", "hunt_id"], "left") if bad is not None else hunt.withColumn("__bad", F.lit(False))
    error = F.when(F.col("kind") != "retro", "kind").when(F.col("state").isin("RUNNING", "QUEUED"), "state").when(F.coalesce("__bad", F.lit(False)), "compile")
    asked = asked.drop("planned", "error").withColumn("error", error).drop("__bad")
    committed = artifact.where(F.col("storage_state") == "committed")
    top = committed.groupBy("tenant_id").agg(F.max("seq").alias("__top"))
    pinned = asked.join(top, "tenant_id", "left").withColumn("watermark", F.when(F.col("error").isNull(), F.coalesce("watermark", "__top", F.lit(0))).otherwise(F.col("watermark")).cast("long"))
    planned = _covered(committed.where(F.col("scope") == "endpoint").select("tenant_id", "seq"), pinned.where("error IS NULL").select("tenant_id", "watermark").distinct(), top)
    fresh = F.col("error").isNull()
    zero = {c: F.when(fresh, F.lit(0)).otherwise(F.col(c) if c in hunt.columns else F.lit(None)).cast("long") for c in ("scanned", "matched", "timed_out", "failed", "cache_hits")}
    state = F.when(fresh, "QUEUED").when(F.col("error") == "compile", "FAILED").otherwise(F.col("state"))
    return pinned.join(planned, ["tenant_id", "watermark"], "left").withColumns(zero | {"planned": F.when(fresh, F.coalesce("planned", F.lit(0)).cast("long")), "state": state}).drop("__top")


def _covered(rows: DataFrame, marks: DataFrame, top: DataFrame, parts: int = 1024) -> DataFrame:
    """(tenant_id, watermark, planned): rows (tenant_id, seq) up to each mark.

    A tenant's numbers fall into ranges: whole ranges are counted and summed up in order, and a mark meets the rows of
    its own range alone, so no task gets a tenant.
    """
    width = top.select("tenant_id", (F.floor(F.col("__top") / parts) + 1).alias("__w"))
    placed = rows.join(width, "tenant_id").withColumn("__r", F.floor(F.col("seq") / F.col("__w")))
    at = marks.join(width, "tenant_id").withColumn("__r", F.floor(F.col("watermark") / F.col("__w")))
    counted = placed.groupBy("tenant_id", "__r").agg(F.count("*").alias("n"))
    # ranges of a tenant, not rows: a mark's range counts as zero rows of its own
    ranges = counted.unionByName(at.select("tenant_id", "__r", F.lit(0).cast("long").alias("n")).distinct()).groupBy("tenant_id", "__r").agg(F.sum("n").alias("n"))
    before = ranges.withColumn("__before", F.coalesce(F.sum("n").over(W.partitionBy("tenant_id").orderBy("__r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = at.join(placed.select("tenant_id", "__r", "seq"), ["tenant_id", "__r"], "left").groupBy("tenant_id", "__r", "watermark").agg(F.count_if(F.col("seq") <= F.col("watermark")).alias("__own"))
    return own.join(before, ["tenant_id", "__r"]).select("tenant_id", "watermark", (F.col("__before") + F.col("__own")).alias("planned"))


def activate(bundle: DataFrame, hunt: DataFrame) -> DataFrame:
    """bundle (tenant_id, rule_bundle_digest): the newest open retro hunt that activation uses again, or a null hunt_id for one to enqueue.

    `status` is the log's: reused or enqueued; a reused draft is to be enqueued as well (`enqueue`).
    """
    opened = hunt.where(F.col("state").isin(*OPEN_STATES) & (F.col("kind") == "retro")).groupBy("tenant_id", "rule_bundle_digest").agg(
        F.max_by(F.struct("hunt_id", "state"), F.struct("created_at", "hunt_id")).alias("h"))
    found = bundle.join(opened, ["tenant_id", "rule_bundle_digest"], "left")
    return found.withColumns({"hunt_id": F.col("h.hunt_id"), "status": F.when(F.col("h").isNotNull(), "reused").otherwise("enqueued"), "enqueue": F.col("h").isNull() | (F.col("h.state") == "DRAFT")}).drop("h")


def forward_counters(hunt: DataFrame, outcome: DataFrame) -> DataFrame:
    """Adds a batch of forward outcomes (tenant_id, hunt_id, status, n_rules) to the counters of their hunts; plans stay as they are."""
    more = outcome.groupBy("tenant_id", "hunt_id").agg(
        F.count_if(F.col("status").isin("clean", "matched")).alias("s"), F.coalesce(F.sum(F.when(F.col("status").isin("clean", "matched"), F.col("n_rules"))), F.lit(0)).alias("m"),
        F.count_if(F.col("status") == "timeout").alias("t"), F.count_if(F.col("status") == "error").alias("f"))
    add = {c: (F.col(c) + F.coalesce(x, F.lit(0))).cast("long") for c, x in (("scanned", "s"), ("matched", "m"), ("timed_out", "t"), ("failed", "f"))}
    return hunt.join(more, ["tenant_id", "hunt_id"], "left").withColumns(add).drop("s", "m", "t", "f")


# --- edges and views ------------------------------------------------------------------


def variant_joins(before: DataFrame, after: DataFrame) -> DataFrame:
    """(tenant_id, artifact_id, group_id): artifacts new to a group some of whose other members had a group before."""
    old = before.select(*KEY, F.lit(True).alias("old"))
    now = after.join(old, KEY, "left")
    stood = now.where("old").select("tenant_id", "group_id").distinct()
    return now.where("old IS NULL").join(stood, ["tenant_id", "group_id"], "left_semi").select(*KEY, "group_id")


def edge_filter(edge: DataFrame, *, model_version: str | None = None, min_score: float | None = None, types: tuple[str, ...] | None = None, include_weak: bool = True) -> DataFrame:
    if model_version is not None:
        edge = edge.where(F.col("model_version") == model_version)
    if min_score is not None:
        edge = edge.where(F.col("score") >= min_score)
    if types:
        edge = edge.where(F.col("edge_type").isin(*types))
    return edge if include_weak else edge.where(F.col("edge_type").isin(*graph.MERGING))


def bounded_view(edge: DataFrame, seeds: DataFrame, *, depth: int = 1, most_nodes: int = graph.MOST_NODES, most_edges: int = graph.MOST_EDGES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (tenant_id, node, depth), edges of the nodes that were expanded, and (tenant_id, truncated, too_large).

    An edge is listed if one of its ends was expanded, be its other end left out by the cap or not; edges between two
    outermost nodes aren't. Best scores first under the cap. A tenant whose answer passes MOST_RESPONSE_BYTES as JSON
    has it refused: too_large.
    """
    seen, cut = graph.expand(edge, seeds, depth=depth, most_nodes=most_nodes)
    opened = seen.where(F.col("depth") < min(depth, graph.MOST_DEPTH)).select("tenant_id", F.col("node").alias("artifact_id"))
    order = W.partitionBy("tenant_id").orderBy(F.desc("score"), "edge_type", "src", "dst")
    kept = graph.touching(edge, opened).withColumn("__n", F.row_number().over(order))
    over = kept.where(F.col("__n") > most_edges).select("tenant_id")
    kept = kept.where(F.col("__n") <= most_edges).drop("__n")
    full = over.unionByName(cut).distinct().withColumn("truncated", F.lit(True))
    line = F.octet_length(F.to_json(F.struct(*kept.columns))) + 1
    size = kept.groupBy("tenant_id").agg(F.sum(line).alias("b")).unionByName(seen.groupBy("tenant_id").agg(F.sum(F.octet_length(F.to_json(F.struct("node", "depth"))) + 1).alias("b"))).groupBy("tenant_id").agg(F.sum("b").alias("b"))
    flags = size.join(full, "tenant_id", "left").select("tenant_id", F.coalesce("truncated", F.lit(False)).alias("truncated"), (F.col("b") > MOST_RESPONSE_BYTES).alias("too_large"))
    return seen, kept, flags


def resolve_seed(spec: DataFrame, artifact: DataFrame) -> DataFrame:
    """spec (tenant_id, spec): the tenant's artifact by its id, else by its 64-digit digest; null where neither is known."""
    by_id = artifact.select("tenant_id", F.col("artifact_id").cast("string").alias("spec"), F.col("artifact_id").alias("a"))
    by_hash = artifact.select("tenant_id", F.col("sha256").alias("h"), F.col("artifact_id").alias("b"))
    asked = spec.withColumn("h", F.when(F.col("spec").rlike("^[0-9A-Fa-f]{64}$"), F.lower("spec")))
    return asked.join(by_id, ["tenant_id", "spec"], "left").join(by_hash, ["tenant_id", "h"], "left").select("tenant_id", "spec", F.coalesce("a", "b").alias("artifact_id"))


def variants_view(groups: DataFrame, seeds: DataFrame, artifact: DataFrame) -> DataFrame:
    """Members of the seeds' groups with their digests and classes."""
    return graph.group_members(groups, seeds).join(artifact.select(*KEY, "sha256", "artifact_class"), KEY)


def expansion(groups: DataFrame, matched: DataFrame, occurrence: DataFrame) -> DataFrame:
    """Group members of matched artifacts that did not match themselves, with how often and on how many hosts they were seen."""
    others = graph.group_members(groups, matched).join(matched.select(*KEY).distinct(), KEY, "left_anti").select(*KEY, "group_id")
    seen = occurrence.join(others.select(*KEY).distinct(), KEY, "left_semi").groupBy(*KEY).agg(F.count("*").alias("occurrences"), F.countDistinct("host_name").alias("hosts"))
    return others.join(seen, KEY, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("occurrences", "hosts")})


# --- functions, probes, clean-up --------------------------------------------------------


def significant(function: DataFrame) -> DataFrame:
    """Functions of at least LEAST_INSTRUCTIONS instructions that only jump elsewhere count for nothing."""
    return function.where((F.col("insns") >= LEAST_INSTRUCTIONS) & ~F.coalesce(F.col("is_thunk"), F.lit(False)))


def populated(index: DataFrame) -> bool:
    return not index.limit(1).isEmpty()


def lookup(table: DataFrame, key: str, value: object, *, tenant: str | None = None) -> DataFrame:
    """The row of one key, of the tenant's rows where one is named; NotFound without one."""
    wanted = F.col(key) == F.lit(value)
    found = table.where(wanted if tenant is None else wanted & (F.col("tenant_id") == tenant)).limit(1)
    if found.isEmpty():
        raise NotFound(f"{key} {value}")
    return found


def cleanup(gone: DataFrame, *, features: DataFrame, functions: DataFrame, edges: DataFrame, groups: DataFrame, held: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """Reports of deleting what is derived from artifacts (tenant_id, artifact_id), and groups touched (tenant_id, group_id, outcome).

    A report counts features, functions, edges by either end and group memberships. An artifact under legal hold is
    counted as in a dry run and keeps everything. The ledger, artifacts and opinions aren't touched. A group left with
    one member or none is removed, else repaired.
    """
    asked = gone.select(*KEY).distinct().join(held.select(*KEY).distinct().withColumn("legal_hold", F.lit(True)), KEY, "left").withColumn("legal_hold", F.coalesce("legal_hold", F.lit(False)))
    ends = graph.both_ways(edges).select("tenant_id", F.col("node").alias("artifact_id"))  # an edge from an artifact to itself isn't one
    report = asked.withColumn("dry_run", F.col("legal_hold") | F.lit(dry_run))
    for name, rows in (("features", features), ("functions", functions), ("edges", ends), ("group_memberships", groups)):
        n = rows.select(*KEY).join(asked, KEY, "left_semi").groupBy(*KEY).agg(F.count("*").alias(name))
        report = report.join(n, KEY, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    free = report.where("NOT dry_run").select(*KEY)
    touched = groups.join(free, KEY, "left_semi").select("tenant_id", "group_id").distinct()
    left = groups.join(touched, ["tenant_id", "group_id"], "left_semi").join(free, KEY, "left_anti").groupBy("tenant_id", "group_id").agg(F.count("*").alias("members"))
    return report, touched.join(left, ["tenant_id", "group_id"], "left").select("tenant_id", "group_id", F.when(F.coalesce("members", F.lit(0)) <= 1, "removed").otherwise("repaired").alias("outcome"))


def without(rows: DataFrame, report: DataFrame) -> DataFrame:
    """Rows of a family that stay after a clean-up; edges go by either end."""
    free = report.where("NOT dry_run").select(*KEY)
    if "src" in rows.columns:
        for end in ("src", "dst"):
            rows = rows.join(free.select("tenant_id", F.col("artifact_id").alias(end)), ["tenant_id", end], "left_anti")
        return rows
    return rows.join(free, KEY, "left_anti")


# --- orders and pages -------------------------------------------------------------------


def newest(rows: DataFrame, at: str, *then: Column | str, limit: int = 100) -> DataFrame:
    """Newest first, nulls last, 1 to MOST_PAGE rows."""
    return rows.orderBy(F.desc_nulls_last(at), *then).limit(max(1, min(limit, MOST_PAGE)))


def page(rows: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    """A page after a full sort; beyond the end it is empty."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(0, limit))


def top_ranked(rows: DataFrame, by: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
