"""Intel, triggers, detections, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions import scalars
from stratalog.operators.ledger import upsert

SHA_KEYS = ("exe_sha256", "script_sha256", "file_sha256", "sha256")


def stix_indicators(bundle: DataFrame, column: str = "bundle") -> DataFrame:
    """(ioc_type, value, stix_id, pattern) of a STIX bundle's indicator objects; bundle: its JSON text."""
    objects = F.from_json(F.get_json_object(column, "$.objects"), "array<struct<type:string,id:string,pattern:string>>")
    one = bundle.select(F.explode(objects).alias("o")).where("o.type = 'indicator' AND o.pattern IS NOT NULL")
    return one.select("o.id", "o.pattern", F.explode(scalars.hash_tokens(F.col("o.pattern"))).alias("t")).select("t.ioc_type", "t.value", F.col("id").alias("stix_id"), "pattern")


def upsert_indicators(seen: DataFrame) -> DataFrame:
    """seen (tenant_id, source, ioc_type, value, raw, seen_at): one row a key, values lower-cased."""
    return upsert(seen.withColumn("value", F.lower("value")), ["tenant_id", "source", "ioc_type", "value"], "raw", "seen_at")


def hash_hunt(indicator: DataFrame, artifact: DataFrame) -> DataFrame:
    """Committed endpoint artifacts whose SHA-256 is an indicator of their tenant."""
    wanted = indicator.where(F.col("ioc_type") == "sha256").select("tenant_id", F.col("value").alias("sha256")).distinct()
    return artifact.where("scope = 'endpoint' AND storage_state = 'committed'").join(wanted, ["tenant_id", "sha256"], "left_semi")


def fan_out(event: DataFrame, trigger: DataFrame) -> DataFrame:
    """An outbox row for each event and enabled trigger of its tenant and condition."""
    return event.join(trigger.where("enabled").select("tenant_id", "condition", "trigger_id", "url"), ["tenant_id", "condition"])


def delivery(outbox: DataFrame, now: int, *, batch: int = 20, most_attempts: int = 8) -> DataFrame:
    """What is due, oldest first, with the state that a failed try leaves: next_attempt_at, given_up."""
    due = outbox.where((F.col("next_attempt_at") <= now) & ~F.col("delivered") & (F.col("attempts") < most_attempts))
    after = F.col("attempts") + 1
    return due.orderBy("next_attempt_at", "outbox_id").limit(batch).withColumns({"retry_at": now + scalars.backoff_seconds(F.col("attempts")) * 1_000_000, "given_up": after >= most_attempts})


def detections_of(hits: DataFrame, severity: str, source: str) -> DataFrame:
    return hits.withColumns({"severity": F.lit(severity), "source": F.lit(source), "mitre": scalars.techniques(F.array(F.col("label"))) if "label" in hits.columns else F.array().cast("array<string>")})


def technique_rollup(detection: DataFrame, *by: str) -> DataFrame:
    """Sorted distinct techniques of each group's detections, joined by commas."""
    return detection.groupBy(*by).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("mitre")))), ",").alias("techniques"))


def telemetry_identity(event: Column) -> Column:
    """(event_id, boot_id, source_seq, kind, artifact_sha256, observed_at) of a JSON event; event_id is null if it has none."""
    keys = dict.fromkeys(("event_id", "boot_id", "source_seq", "kind", "ts", *SHA_KEYS))
    parsed = F.from_json(event, "STRUCT<" + ", ".join(f"`{k}`: STRING" for k in keys) + ">")  # once for all keys

    def text(key: str, most: int) -> Column:
        value = F.trim(parsed[key])
        return F.when(F.length(value).between(1, most) & ~parsed[key].rlike(r"\p{Cntrl}"), value)

    boot, seq, ts = text("boot_id", 128), parsed["source_seq"].try_cast("long"), parsed["ts"].try_cast("double")
    shas = [F.when(scalars.valid_sha256(text(k, 64)), F.lower(text(k, 64))) for k in SHA_KEYS]
    return F.struct(
        F.coalesce(text("event_id", 256), F.concat(boot, F.lit(":"), seq.cast("string"))).alias("event_id"), F.coalesce(boot, F.lit("unknown")).alias("boot_id"), seq.alias("source_seq"),
        F.coalesce(text("kind", 64), F.lit("unknown")).alias("kind"), F.coalesce(*shas).alias("artifact_sha256"), F.when(ts >= 0, F.round(ts * 1e6).cast("long")).alias("observed_at"))


def telemetry_accept(segment: DataFrame) -> DataFrame:
    """segment (tenant_id, host_name, segment, event JSON): identified events, the first of each id; `accepted` tells repeats apart."""
    from pyspark.sql import Window as W

    known = segment.select("*", telemetry_identity(F.col("event")).alias("e")).select("tenant_id", "host_name", "segment", "e.*").where("event_id IS NOT NULL")
    order = W.partitionBy("tenant_id", "host_name", "event_id").orderBy("segment", "source_seq")
    return known.withColumn("accepted", F.row_number().over(order) == 1)


def sandbox_findings(report: Column) -> Column:
    """Up to 25 signatures and 25 techniques of a sandbox report: (category, summary, severity)."""
    r = F.from_json(report, "struct<signatures:array<struct<name:string,description:string,severity:bigint>>,ttps:array<struct<ttp:string>>>")
    none = F.array().cast("array<struct<category:string,summary:string,severity:bigint>>")
    signatures = F.transform(F.slice(r["signatures"], 1, 25), lambda s: F.struct(
        F.lit("signature").alias("category"), F.concat(F.coalesce(s["name"], F.lit("signature")), F.lit(": "), F.coalesce(s["description"], F.lit(""))).alias("summary"), F.coalesce(s["severity"], F.lit(1)).alias("severity")))
    ttps = F.transform(F.filter(F.slice(r["ttps"], 1, 25), lambda t: t["ttp"].isNotNull()), lambda t: F.struct(
        F.lit("attack").alias("category"), F.concat(F.lit("ATT&CK "), t["ttp"], F.lit(" (observed in sandbox)")).alias("summary"), F.lit(None).cast("bigint").alias("severity")))
    return F.concat(F.coalesce(signatures, none), F.coalesce(ttps, none))
