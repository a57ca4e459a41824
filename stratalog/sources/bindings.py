"""The driver's tables as tables of the model, and the same projections as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} AS timestamp_ntz))")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (tenant, content) of documents: the tenant is the source."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("tenant_id"), F.sha2("text", 256).alias("sha256"), "doc_id", "lang", F.octet_length("text").cast("long").alias("n"))
    return docs.groupBy("tenant_id", "sha256").agg(
        F.min("doc_id").alias("artifact_id"), F.min("doc_id").alias("seq"), F.max("n").alias("size_bytes"), F.min_by("lang", "doc_id").alias("artifact_class"),
    ).withColumns({"scope": F.lit("endpoint"), "storage_state": F.lit("committed")})


ARTIFACT = """artifact AS (SELECT source AS tenant_id, sha256(text) AS sha256, min(doc_id) AS artifact_id, min(doc_id) AS seq, max(strlen(text)) AS size_bytes,
  arg_min(lang, doc_id) AS artifact_class, 'endpoint' AS scope, 'committed' AS storage_state FROM documents GROUP BY 1, 2)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences from lineitem: parts seen at suppliers."""
    return table(spark, sf_dir, "lineitem").select(
        F.lit("t0").alias("tenant_id"), F.col("l_partkey").alias("artifact_id"), F.col("l_suppkey").alias("host_name"), F.col("l_orderkey").cast("string").alias("boot_id"),
        F.col("l_linenumber").cast("long").alias("agent_sequence"), F.concat("l_returnflag", "l_linestatus").alias("path"), micros("l_shipdate").alias("observed_at"))


LEDGER = """ledger AS (SELECT 't0' AS tenant_id, l_partkey AS artifact_id, l_suppkey AS host_name, CAST(l_orderkey AS VARCHAR) AS boot_id,
  CAST(l_linenumber AS BIGINT) AS agent_sequence, l_returnflag || l_linestatus AS path, epoch_us(l_shipdate) AS observed_at FROM lineitem)"""


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences from events, each of a document's artifact in its tenant."""
    docs = table(spark, sf_dir, "documents")
    known = docs.select(F.col("doc_id").alias("d"), F.col("source").alias("tenant_id"), F.sha2("text", 256).alias("sha256"))
    n = docs.agg(F.count("*").alias("n_docs"))
    events = table(spark, sf_dir, "events").crossJoin(F.broadcast(n)).withColumn("d", F.floor(F.col("value") * 10).cast("long") % F.col("n_docs"))
    seen = events.join(known, "d").select(
        "tenant_id", "sha256", F.col("user_id").alias("host_name"), F.to_date("ts").cast("string").alias("boot_id"), F.col("event_id").alias("agent_sequence"),
        F.col("event_type").alias("path"), micros("ts").alias("observed_at"), "props")
    return seen.join(artifacts(spark, sf_dir).select("tenant_id", "sha256", "artifact_id"), ["tenant_id", "sha256"])


OCCURRENCE = ARTIFACT + """, seen AS (SELECT d.source AS tenant_id, sha256(d.text) AS sha256, e.user_id AS host_name, CAST(CAST(e.ts AS DATE) AS VARCHAR) AS boot_id, e.event_id AS agent_sequence,
  e.event_type AS path, epoch_us(e.ts) AS observed_at, e.props FROM events e JOIN documents d ON d.doc_id = CAST(floor(e.value * 10) AS BIGINT) % (SELECT count(*) FROM documents)),
occurrence AS (SELECT seen.*, artifact_id FROM seen JOIN artifact USING (tenant_id, sha256))"""


def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts from labels, in the order of their documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("tenant_id"), F.sha2("text", 256).alias("sha256"))
    verdict = F.when(F.col("toxic") == 1, "malicious").when(F.col("quality") == 0, "grayware").otherwise("trusted")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").join(artifacts(spark, sf_dir).select("tenant_id", "sha256", "artifact_id"), ["tenant_id", "sha256"]).select(
        "tenant_id", "artifact_id", F.col("doc_id").alias("opinion_id"), verdict.alias("opinion"), F.col("doc_id").alias("created_at"))


OPINION = """opinion AS (SELECT a.tenant_id, a.artifact_id, l.doc_id AS opinion_id, CASE WHEN toxic = 1 THEN 'malicious' WHEN quality = 0 THEN 'grayware' ELSE 'trusted' END AS opinion, l.doc_id AS created_at
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id JOIN artifact a ON a.tenant_id = d.source AND a.sha256 = sha256(d.text))"""


def literal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One literal rule for each benchmark item: its whole text."""
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("rule_id"), F.col("text").alias("literal"))


RULE = "rule AS (SELECT 'item_' || item_id AS rule_id, text AS literal FROM benchmark)"


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts with their text."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("tenant_id"), F.col("doc_id").alias("artifact_id"), "text")
    return artifacts(spark, sf_dir).join(docs, ["tenant_id", "artifact_id"])


CONTENT = "content AS (SELECT a.*, d.text FROM artifact a JOIN documents d ON d.doc_id = a.artifact_id)"
