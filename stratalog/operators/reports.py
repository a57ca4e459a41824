"""Compositions: continuous intel matching and the investigation of an artifact set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions import scalars
from stratalog.operators import analyst, events

_RANK = ["critical", "high", "medium", "low", "info"]


def continuous_intel(indicator: DataFrame, artifact: DataFrame, trigger: DataFrame, *, severity: str = "high") -> tuple[DataFrame, DataFrame]:
    """(detections, outbox rows) of artifacts that digests newly known as bad name."""
    hits = events.hash_hunt(indicator, artifact)
    found = events.detections_of(hits, severity, "intel")
    return found, events.fan_out(found.withColumn("condition", F.lit("malicious_verdict")), trigger)


def worst_severity(detection: DataFrame) -> DataFrame:
    """(tenant_id, artifact_id, worst)."""
    place = F.array_position(F.array(*[F.lit(s) for s in _RANK]), F.col("severity"))
    return detection.groupBy(*analyst.KEY).agg(F.min_by("severity", place).alias("worst"))


def investigate(artifact: DataFrame, matches: DataFrame, occurrence: DataFrame, opinion: DataFrame, detection: DataFrame) -> DataFrame:
    """One row an artifact: level, actions, techniques, rules, prevalence. matches (tenant_id, artifact_id, rule_id); detection (…, severity, mitre)."""
    rules = matches.groupBy(*analyst.KEY).agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("matched_rules"))
    spread = analyst.prevalence(occurrence)
    mitre = events.technique_rollup(detection, *analyst.KEY)
    joined = artifact.select(*analyst.KEY, "sha256")
    for more in (rules, spread, analyst.latest_opinion(opinion), worst_severity(detection), mitre):
        joined = joined.join(more, analyst.KEY, "left")
    hosts, matched = F.coalesce("host_count", F.lit(0)), F.col("matched_rules").isNotNull()
    return joined.select(
        *analyst.KEY, "sha256", scalars.severity(F.col("worst"), F.col("opinion"), matched, hosts).alias("level"),
        F.array_join(scalars.recommended_actions(F.col("worst"), F.col("opinion"), matched, hosts), ",").alias("actions"), F.coalesce("techniques", F.lit("")).alias("techniques"),
        F.coalesce("matched_rules", F.lit("")).alias("matched_rules"), hosts.alias("host_count"))
