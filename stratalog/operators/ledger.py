"""Writes as transforms: dedup on announce, verified finalize, idempotent inserts, keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LEDGER_KEY = ["tenant_id", "agent_id", "boot_id", "agent_sequence"]


def announce(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """incoming (tenant_id, sha256, ...): adds disposition, ALREADY_PRESENT or UPLOAD_REQUIRED."""
    have = known.select("tenant_id", "sha256").distinct().withColumn("__known", F.lit(True))
    return incoming.join(have, ["tenant_id", "sha256"], "left").withColumn("disposition", F.when(F.col("__known"), "ALREADY_PRESENT").otherwise("UPLOAD_REQUIRED")).drop("__known")


def finalize(staged: DataFrame, *, content: str = "content", announced: str = "announced", size: str = "size_bytes") -> DataFrame:
    """Rehashes what was uploaded: adds sha256 and outcome, CAPTURED or HASH_MISMATCH."""
    digest = F.sha2(F.col(content).cast("binary"), 256)
    ok = (digest == F.lower(announced)) & (F.octet_length(content) == F.col(size))
    return staged.withColumns({"sha256": digest, "outcome": F.when(ok, "CAPTURED").otherwise("HASH_MISMATCH")})


def insert_once(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: an insert that does nothing on conflict."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def insert_absent(incoming: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows of incoming whose key isn't there yet."""
    return incoming.join(existing.select(*key).distinct(), key, "left_anti")


def upsert(rows: DataFrame, key: list[str], value: str, at: str) -> DataFrame:
    """Latest value of each key, with the first and the last time it was seen."""
    return rows.groupBy(*key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.max_by(value, F.struct(at, value)).alias(value))


def latest(rows: DataFrame, key: list[str], at: str, *then: str) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in rows.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(at, *then))
    return rows.groupBy(*key).agg(newest.alias("__r")).select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def sequence(rows: DataFrame, by: list[str], order: list[str], name: str = "agent_sequence") -> DataFrame:
    """Numbers rows from 1 within a boot."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "path", state: tuple[str, ...] = ("inode", "mtime", "size")) -> DataFrame:
    """Paths that are new, changed or gone between two walks."""
    a = before.select(key, F.struct(*state).alias("a"))
    b = after.select(key, F.struct(*state).alias("b"))
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")


def cleanup_counts(families: dict[str, DataFrame], artifacts: DataFrame) -> DataFrame:
    """Dry run of a clean-up: how many rows of each family hang on the artifacts (tenant_id, artifact_id)."""
    out = None
    for family, df in sorted(families.items()):
        n = df.join(artifacts, ["tenant_id", "artifact_id"], "left_semi").agg(F.count("*").alias("n")).select(F.lit(family).alias("family"), "n")
        out = n if out is None else out.unionByName(n)
    return out
