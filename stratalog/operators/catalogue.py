"""Dimension tables: tenants, rules, analyzers, receipts; and the views that lists are ordered by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import scalars

#: Analyzers by name: version, what they read, whether they still run.
ANALYZERS = [("byte", "byte:v1", "any", True), ("normalized", "norm:v1", "pe,elf,macho", True), ("semantic", "sem:v1", "pe,elf", True), ("semantic", "sem:v0", "pe,elf", False), ("triage", "triage:v1", "any", True)]


def resolve_tenant(request: DataFrame, tenant: DataFrame, *, default: str = "default") -> DataFrame:
    """request (request_id, spec): the active tenant that a uuid or a slug names; an empty or missing spec means the default. Null if there is none."""
    wanted = F.lower(F.when(F.coalesce(F.trim("spec"), F.lit("")) == "", default).otherwise(F.trim("spec")))
    active = tenant.where("state = 'active'")
    by = active.select(F.explode(F.array("tenant_id", "slug")).alias("wanted"), "tenant_id").groupBy("wanted").agg(F.min("tenant_id").alias("tenant_id"))
    return request.withColumn("wanted", wanted).join(by, "wanted", "left").select("request_id", "tenant_id")


def rule_conflicts(rule: DataFrame) -> DataFrame:
    """Stable ids offered with more than one source: the same source again is no conflict."""
    return rule.groupBy("tenant_id", "namespace", "stable_id").agg(F.countDistinct("source").alias("sources"), F.count("*").alias("offers")).where("sources > 1")


def resolve_rule(spec: DataFrame, rule: DataFrame) -> DataFrame:
    """spec (tenant_id, spec): the tenant's rule by its uuid, else by its stable id."""
    by_id = rule.select("tenant_id", F.col("rule_id").alias("spec"), F.col("rule_id").alias("a"))
    by_name = rule.groupBy("tenant_id", F.col("stable_id").alias("spec")).agg(F.min("rule_id").alias("b"))
    return spec.join(by_id, ["tenant_id", "spec"], "left").join(by_name, ["tenant_id", "spec"], "left").select("tenant_id", "spec", F.coalesce("a", "b").alias("rule_id"))


def evidence_strip(evidence: Column, keep: tuple[str, ...] = ("type", "version", "score", "pairs", "receipt", "tau")) -> Column:
    """The few fields of an edge's evidence (JSON) that a neighbourhood shows."""
    fields = F.from_json(evidence, "map<string,string>")
    return F.to_json(F.map_filter(fields, lambda k, v: k.isin(*keep)))


def join_hash(names: Column) -> Column:
    """SHA-256 over sorted distinct lower-cased names, each ended by a zero byte."""
    low = F.array_sort(F.array_distinct(F.transform(names, F.lower)))
    return F.sha2(F.array_join(F.transform(low, lambda n: F.concat(n, F.lit("\0"))), ""), 256)


def section_entropy(section: DataFrame, key: list[str], whole: DataFrame | None = None) -> DataFrame:
    """Size-weighted mean and largest entropy of executable sections: section (key, size, entropy, executable).

    whole (key, entropy): of entire files, which stands in for those without executable sections.
    """
    code = section.where("executable AND size > 0")
    found = code.groupBy(*key).agg((F.sum(F.col("entropy") * F.col("size")) / F.sum("size")).alias("mean_entropy"), F.max("entropy").alias("max_entropy"))
    if whole is None:
        return found
    rest = whole.join(found, key, "left_anti").select(*key, F.col("entropy").alias("mean_entropy"), F.col("entropy").alias("max_entropy"))
    return found.unionByName(rest)


def next_due(queue: DataFrame, now: int, by: list[str]) -> DataFrame:
    """The job to lease next: the smallest priority, then id, among those due."""
    return queue.where(F.col("due_at") <= now).groupBy(*by).agg(F.min(F.struct("priority", "job_id")).alias("j")).select(*by, "j.priority", "j.job_id")


def analyzer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ANALYZERS, "name string, version string, formats string, active boolean")


def lookup_analyzer(request: DataFrame, registry: DataFrame) -> DataFrame:
    """request (request_id, version): active, retired or unknown."""
    return request.join(F.broadcast(registry.select("version", "active")), "version", "left").select(
        "request_id", "version", F.when(F.col("active"), "active").when(F.col("active").isNotNull(), "retired").otherwise("unknown").alias("status"))


def similar_view(edge: DataFrame, artifact: DataFrame) -> DataFrame:
    """Every edge from both ends with the other end's digest, best first for each artifact."""
    from stratalog.operators.graph import both_ways

    other = artifact.select("tenant_id", F.col("artifact_id").alias("other"), F.col("sha256").alias("other_sha256"))
    return both_ways(edge).join(other, ["tenant_id", "other"]).select("tenant_id", F.col("node").alias("artifact_id"), "other", "other_sha256", "edge_type", "score")


def validators(rows: DataFrame, host: str, segment: str, digest: str) -> DataFrame:
    return rows.withColumns({"host_ok": scalars.valid_host(F.col(host)), "segment_ok": scalars.valid_segment(F.col(segment)), "digest_ok": scalars.valid_sha256(F.col(digest))})
