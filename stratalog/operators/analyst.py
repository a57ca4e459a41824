"""Questions over the ledger: prevalence, rarity, droppers, first sightings, host roll-ups, coverage gaps, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEY = ["tenant_id", "artifact_id"]


def prevalence(occurrence: DataFrame, *by: str) -> DataFrame:
    return occurrence.groupBy(*(by or KEY)).agg(
        F.countDistinct("host_name").alias("host_count"), F.countDistinct("path").alias("path_count"), F.min("observed_at").alias("first_observed"), F.max("observed_at").alias("last_observed"))


def latest_opinion(opinion: DataFrame) -> DataFrame:
    return opinion.groupBy(*KEY).agg(F.max_by("opinion", F.struct("created_at", "opinion_id")).alias("opinion"))


def rarity_search(occurrence: DataFrame, *, max_hosts: int = 5, since: int | None = None, limit: int = 100, opinion: DataFrame | None = None, only: str | None = None) -> DataFrame:
    """Artifacts on few hosts and seen lately, the rarest first. opinion: adds each one's latest; only: keeps those with it."""
    found = prevalence(occurrence).where(F.col("host_count") <= max_hosts)
    if since is not None:
        found = found.where(F.col("last_observed") >= since)
    if opinion is not None:
        found = found.join(latest_opinion(opinion), KEY, "left")
        if only is not None:
            found = found.where(F.col("opinion") == only)
    return found.orderBy("host_count", F.desc_nulls_last("last_observed"), *KEY).limit(limit)


def first_observation(occurrence: DataFrame) -> DataFrame:
    """The first sighting of each artifact on each host; ties go to the smaller path."""
    first = F.min(F.struct("observed_at", "path"))
    return occurrence.groupBy(*KEY, "host_name").agg(first.alias("f")).select(*KEY, "host_name", F.col("f.observed_at").alias("observed_at"), F.col("f.path").alias("path"))


def dropper_candidates(occurrence: DataFrame, seeds: DataFrame, *, window_us: int, max_hosts: int = 3, limit: int | None = 100, limit_first: bool = False) -> DataFrame:
    """Artifacts first seen on a seed's host within a window of a seed's sighting, the closest first.

    The host is the equi-key. Times fall into buckets as wide as the window and a
    seed stands in its own and both neighbouring ones, so a busy host never
    meets all its rows with all its seed rows. limit_first: cut before the
    host-count filter.
    """
    seed = occurrence.join(seeds, KEY, "left_semi").select("tenant_id", "host_name", F.col("observed_at").alias("seed_at")).distinct()
    wide = max(window_us, 1)
    seed = seed.withColumn("slot", F.explode(F.array(*[F.floor(F.col("seed_at") / wide) + k for k in (-1, 0, 1)])))
    first = first_observation(occurrence).join(seeds, KEY, "left_anti").withColumn("slot", F.floor(F.col("observed_at") / wide))
    near = first.join(seed, ["tenant_id", "host_name", "slot"]).withColumn("delta", F.abs(F.col("observed_at") - F.col("seed_at"))).where(F.col("delta") <= window_us)
    close = near.groupBy(*KEY, "host_name", "path").agg(F.min("delta").alias("d"))
    spread = prevalence(occurrence.join(close.select(*KEY).distinct(), KEY, "left_semi")).select(*KEY, "host_count", "first_observed")
    found = close.join(spread, KEY).select(*KEY, "host_name", "path", "host_count", F.floor(F.col("d") / 1e6 + 0.5).cast("long").alias("min_time_delta_secs"), "first_observed")
    order = ["min_time_delta_secs", *KEY, "host_name", "path"]
    few = F.col("host_count") <= max_hosts
    if limit is None:
        return found.where(few)
    return found.orderBy(*order).limit(limit).where(few) if limit_first else found.where(few).orderBy(*order).limit(limit)


def host_rollup(occurrence: DataFrame, digest: str = "sha256") -> DataFrame:
    """Per host: its sorted distinct digests and paths, joined by commas, and its first and last sighting."""
    return occurrence.groupBy("tenant_id", "host_name").agg(
        F.array_join(F.array_sort(F.collect_set(F.col(digest).cast("string"))), ",").alias("digests"), F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths"),
        F.min("observed_at").alias("first_observed"), F.max("observed_at").alias("last_observed"))


def coverage_gaps(attempt: DataFrame, *, host: str | None = None, since: int | None = None, limit: int = 100, fine: tuple[str, ...] = ("CAPTURED", "ALREADY_PRESENT")) -> DataFrame:
    """Attempts that captured nothing, newest first."""
    gaps = attempt.where(~F.col("outcome").isin(*fine))
    if host is not None:
        gaps = gaps.where(F.col("host_name") == host)
    if since is not None:
        gaps = gaps.where(F.col("observed_at") >= since)
    return gaps.orderBy(F.desc_nulls_last("observed_at"), "host_name", "path").limit(limit)


def watermark(artifact: DataFrame, *, endpoint_only: bool = False) -> DataFrame:
    """The highest sequence number, 0 if there is none."""
    rows = artifact.where(F.col("scope") == "endpoint") if endpoint_only else artifact
    return rows.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("watermark"))


def planned(artifact: DataFrame, upto: Column | int) -> DataFrame:
    """What a hunt pinned at a watermark covers."""
    return artifact.where((F.col("storage_state") == "committed") & (F.col("scope") == "endpoint") & (F.col("seq") <= upto))


def attestation(artifact: DataFrame, matched: DataFrame) -> DataFrame:
    """Proof of absence: a row with the watermark and what was evaluated, only if nothing matched."""
    covered = planned(artifact, F.lit(2**62))
    proof = covered.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("watermark"), F.count("*").alias("artifacts_evaluated"))
    return proof.crossJoin(F.broadcast(matched.agg(F.count("*").alias("hits")))).where("hits = 0").drop("hits")


def blast_radius(matches: DataFrame, occurrence: DataFrame, opinion: DataFrame) -> DataFrame:
    """Per matched artifact: its rules, its prevalence, its latest opinion."""
    rules = matches.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("matched_rules"))
    spread = prevalence(occurrence.join(rules.select(*KEY), KEY, "left_semi"))
    return rules.join(spread, KEY, "left").join(latest_opinion(opinion), KEY, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("host_count", "path_count")})


#: States of a hunt that is under way, and opinions.
ACTIVE_STATES = ("QUEUED", "RUNNING", "VALIDATING", "PLANNED")
OPINIONS = ("trusted", "grayware", "vulnerable", "malicious", "suspicious")


def platform_metrics(*, artifact: DataFrame, occurrence: DataFrame, hunt: DataFrame, job: DataFrame, detection: DataFrame, bundle: DataFrame, agent: DataFrame, continuous: DataFrame) -> DataFrame:
    """Nine counters of each tenant, and of all (`everything`, null tenant): one pass over a tagged union.

    A job is counted while it isn't finished, under its hunt's tenant; one without a hunt counts nowhere.
    """
    open_jobs = job.where("finished_at IS NULL").select("hunt_id").join(hunt.select("hunt_id", "tenant_id"), "hunt_id")
    parts = {
        "artifacts": artifact.where("storage_state = 'committed'"), "occurrences": occurrence, "hunts_total": hunt, "hunts_active": hunt.where(F.col("state").isin(*ACTIVE_STATES)), "jobs": open_jobs,
        "detections": detection, "bundles": bundle.where("active"), "agents": agent, "continuous": continuous}
    out = None
    for name, df in parts.items():
        one = df.select("tenant_id", F.lit(name).alias("what"))
        out = one if out is None else out.unionByName(one)
    return out.rollup("tenant_id").agg((F.grouping("tenant_id") == 1).alias("everything"), *[F.count_if(F.col("what") == name).alias(name) for name in parts])


def set_opinions(opinion: DataFrame, request: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Opinions after requests (tenant_id, artifact_id, opinion_id, opinion, actor, reason, created_at), audit rows, trigger events, and what was refused.

    An opinion is taken in lower case and has to be one of OPINIONS. Each supersedes the artifact's last one before it,
    requests among themselves as well. Malicious and suspicious ones fire the trigger of verdicts.
    """
    asked = request.withColumn("opinion", F.lower("opinion"))
    good = F.coalesce(F.col("opinion").isin(*OPINIONS), F.lit(False))
    taken, refused = asked.where(good), request.join(asked.where(~good).select("opinion_id"), "opinion_id", "left_semi")
    stored = opinion.drop("superseded_by").unionByName(taken, allowMissingColumns=True)
    detail = F.to_json(F.struct("opinion", "reason", "opinion_id"))
    audit = taken.select("tenant_id", "actor", F.lit("opinion.set").alias("action"), F.col("artifact_id").cast("string").alias("target"), detail.alias("detail"), "created_at")
    payload = F.to_json(F.struct(F.lit("malicious_verdict").alias("type"), "artifact_id", "opinion", "actor", "reason"))
    fired = taken.where(F.col("opinion").isin("malicious", "suspicious")).select("tenant_id", F.lit("malicious_verdict").alias("condition"), payload.alias("payload"))
    return opinion_history(stored), audit, fired, refused


def opinion_history(opinion: DataFrame) -> DataFrame:
    """Every opinion with the one that superseded it."""
    order = W.partitionBy(*KEY).orderBy("created_at", "opinion_id")
    return opinion.withColumn("superseded_by", F.lead("opinion_id").over(order))


def current_opinion(opinion: DataFrame) -> DataFrame:
    return opinion_history(opinion).where("superseded_by IS NULL").drop("superseded_by")
