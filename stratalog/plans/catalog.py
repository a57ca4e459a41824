"""The registered queries and their DuckDB twins.

Every query and every twin runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import scalars as S
from stratalog.operators import analyst, catalogue, events, graph, hunts, ledger, reports, similarity
from stratalog.sources import bindings as B

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
DAY = 86_400_000_000
SINCE = 991_353_600_000_000  # 2001-06-01


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from stratalog.plans import lifecycle, similar  # noqa: F401  register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from stratalog.plans import lifecycle, similar  # noqa: F401

    return dict(_SQL)


# --- ledger analytics -------------------------------------------------------


@query(f"WITH {B.LEDGER} SELECT tenant_id, artifact_id, count(DISTINCT host_name) AS host_count, count(DISTINCT path) AS path_count, min(observed_at) AS first_observed, max(observed_at) AS last_observed FROM ledger GROUP BY 1, 2")
def prevalence(spark, sf_dir):
    return analyst.prevalence(B.ledger(spark, sf_dir))


@query(f"""WITH {B.LEDGER} SELECT tenant_id, artifact_id, count(DISTINCT host_name) AS host_count, count(DISTINCT path) AS path_count, min(observed_at) AS first_observed, max(observed_at) AS last_observed
FROM ledger GROUP BY 1, 2 HAVING count(DISTINCT host_name) <= 25 AND max(observed_at) >= {SINCE} ORDER BY host_count, last_observed DESC NULLS LAST, tenant_id, artifact_id LIMIT 100""")
def rarity_search(spark, sf_dir):
    return analyst.rarity_search(B.ledger(spark, sf_dir), max_hosts=25, since=SINCE, limit=100)


_LATEST = "latest AS (SELECT tenant_id, artifact_id, arg_max(opinion, created_at) AS opinion FROM opinion GROUP BY 1, 2)"


@query(f"""WITH {B.OCCURRENCE}, {B.OPINION}, {_LATEST}, p AS (SELECT tenant_id, artifact_id, count(DISTINCT host_name) AS host_count, count(DISTINCT path) AS path_count, min(observed_at) AS first_observed,
max(observed_at) AS last_observed FROM occurrence GROUP BY 1, 2) SELECT p.*, opinion FROM p JOIN latest USING (tenant_id, artifact_id) WHERE host_count <= 8 AND opinion = 'malicious'
ORDER BY host_count, last_observed DESC NULLS LAST, tenant_id, artifact_id LIMIT 50""")
def rarity_with_opinion(spark, sf_dir):
    return analyst.rarity_search(B.occurrences(spark, sf_dir), max_hosts=8, limit=50, opinion=B.opinions(spark, sf_dir), only="malicious")


@query(f"WITH {B.OCCURRENCE} SELECT tenant_id, artifact_id, host_name, arg_min(path, (observed_at, path)) AS path, min(observed_at) AS observed_at FROM occurrence GROUP BY 1, 2, 3")
def first_observation(spark, sf_dir):
    return analyst.first_observation(B.occurrences(spark, sf_dir)).select("tenant_id", "artifact_id", "host_name", "path", "observed_at")


def _seeds(spark, sf_dir):
    return B.opinions(spark, sf_dir).where("opinion = 'malicious'").select("tenant_id", "artifact_id").distinct()


@query(f"""WITH {B.OCCURRENCE}, {B.OPINION}, seeds AS (SELECT DISTINCT tenant_id, artifact_id FROM opinion WHERE opinion = 'malicious'),
s AS (SELECT DISTINCT o.tenant_id, o.host_name, o.observed_at FROM occurrence o SEMI JOIN seeds USING (tenant_id, artifact_id)),
f AS (SELECT tenant_id, artifact_id, host_name, min(observed_at) AS observed_at, arg_min(path, (observed_at, path)) AS path FROM occurrence o ANTI JOIN seeds USING (tenant_id, artifact_id) GROUP BY 1, 2, 3),
c AS (SELECT f.tenant_id, f.artifact_id, f.host_name, f.path, min(abs(f.observed_at - s.observed_at)) AS d FROM f JOIN s ON s.tenant_id = f.tenant_id AND s.host_name = f.host_name AND abs(f.observed_at - s.observed_at) <= {DAY} GROUP BY ALL),
h AS (SELECT tenant_id, artifact_id, count(DISTINCT host_name) AS host_count, min(observed_at) AS first_observed FROM occurrence GROUP BY 1, 2)
SELECT c.tenant_id, c.artifact_id, c.host_name, c.path, h.host_count, CAST(floor(d / 1e6 + 0.5) AS BIGINT) AS min_time_delta_secs, h.first_observed FROM c JOIN h USING (tenant_id, artifact_id) WHERE host_count <= 20""")
def dropper_candidates(spark, sf_dir):
    return analyst.dropper_candidates(B.occurrences(spark, sf_dir), _seeds(spark, sf_dir), window_us=DAY, max_hosts=20, limit=None)


@query(f"WITH {B.OCCURRENCE} SELECT tenant_id, host_name, string_agg(DISTINCT sha256, ',' ORDER BY sha256) AS digests, string_agg(DISTINCT path, ',' ORDER BY path) AS paths, min(observed_at) AS first_observed, max(observed_at) AS last_observed FROM occurrence GROUP BY 1, 2")
def host_rollup(spark, sf_dir):
    return analyst.host_rollup(B.occurrences(spark, sf_dir))


@query(f"WITH {B.ARTIFACT} SELECT tenant_id, sha256, artifact_id, seq, size_bytes, artifact_class, scope, storage_state FROM artifact")
def artifact_dedup(spark, sf_dir):
    return B.artifacts(spark, sf_dir)


@query(f"WITH {B.ARTIFACT} SELECT tenant_id, coalesce(max(seq), 0) AS watermark, count(*) AS planned FROM artifact WHERE scope = 'endpoint' AND storage_state = 'committed' GROUP BY 1")
def watermark_plan(spark, sf_dir):
    return analyst.planned(B.artifacts(spark, sf_dir), F.lit(2**62)).groupBy("tenant_id").agg(F.max("seq").alias("watermark"), F.count("*").alias("planned"))


_ATTEMPT = "attempt AS (SELECT CAST(user_id AS VARCHAR) AS host_name, event_type AS path, CASE WHEN event_type = 'error' THEN 'UPLOAD_FAILED' WHEN event_id % 7 = 0 THEN 'TOO_LARGE' WHEN event_id % 2 = 0 THEN 'CAPTURED' ELSE 'ALREADY_PRESENT' END AS outcome, epoch_us(ts) AS observed_at, event_id FROM events)"


def _attempts(spark, sf_dir):
    outcome = F.when(F.col("event_type") == "error", "UPLOAD_FAILED").when(F.col("event_id") % 7 == 0, "TOO_LARGE").when(F.col("event_id") % 2 == 0, "CAPTURED").otherwise("ALREADY_PRESENT")
    return B.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("host_name"), F.col("event_type").alias("path"), outcome.alias("outcome"), B.micros("ts").alias("observed_at"), "event_id")


@query(f"WITH {_ATTEMPT} SELECT host_name, path, outcome, observed_at FROM attempt WHERE outcome NOT IN ('CAPTURED', 'ALREADY_PRESENT') ORDER BY observed_at DESC NULLS LAST, host_name, path LIMIT 100")
def coverage_gaps(spark, sf_dir):
    return analyst.coverage_gaps(_attempts(spark, sf_dir).drop("event_id"))


@query(f"WITH {_ATTEMPT} SELECT host_name, outcome, count(*) AS n, min(observed_at) AS oldest FROM attempt GROUP BY 1, 2")
def outcome_counters(spark, sf_dir):
    return _attempts(spark, sf_dir).groupBy("host_name", "outcome").agg(F.count("*").alias("n"), F.min("observed_at").alias("oldest"))


# --- opinions -----------------------------------------------------------------


@query(f"WITH {B.ARTIFACT}, {B.OPINION} SELECT tenant_id, artifact_id, opinion_id, opinion, lead(opinion_id) OVER (PARTITION BY tenant_id, artifact_id ORDER BY created_at, opinion_id) AS superseded_by FROM opinion")
def opinion_history(spark, sf_dir):
    return analyst.opinion_history(B.opinions(spark, sf_dir)).drop("created_at")


@query(f"WITH {B.ARTIFACT}, {B.OPINION}, {_LATEST} SELECT tenant_id, artifact_id, opinion FROM latest")
def opinion_current(spark, sf_dir):
    return analyst.current_opinion(B.opinions(spark, sf_dir)).select("tenant_id", "artifact_id", "opinion")


# --- writes -------------------------------------------------------------------

_INCOMING = "incoming AS (SELECT 'src' || (page_id % 20) AS tenant_id, sha256(html) AS sha256, page_id FROM pages UNION ALL SELECT source, sha256(text), doc_id + 1000000000 FROM documents)"


def _incoming(spark, sf_dir):
    pages = B.table(spark, sf_dir, "pages").select(F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")).alias("tenant_id"), F.sha2("html", 256).alias("sha256"), "page_id")
    docs = B.table(spark, sf_dir, "documents").select(F.col("source").alias("tenant_id"), F.sha2("text", 256).alias("sha256"), (F.col("doc_id") + 1_000_000_000).alias("page_id"))
    return pages.unionByName(docs)


@query(f"WITH {B.ARTIFACT}, {_INCOMING} SELECT page_id, i.tenant_id, i.sha256, CASE WHEN a.sha256 IS NULL THEN 'UPLOAD_REQUIRED' ELSE 'ALREADY_PRESENT' END AS disposition FROM incoming i LEFT JOIN artifact a ON a.tenant_id = i.tenant_id AND a.sha256 = i.sha256")
def announce_disposition(spark, sf_dir):
    return ledger.announce(_incoming(spark, sf_dir), B.artifacts(spark, sf_dir))


@query("SELECT outcome, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM (SELECT strlen(text) AS size_bytes, CASE WHEN sha256(text) = CASE WHEN doc_id % 10 = 3 THEN sha256(text || 'x') ELSE sha256(text) END THEN 'CAPTURED' ELSE 'HASH_MISMATCH' END AS outcome FROM documents) GROUP BY 1")
def hash_mismatch_split(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select(
        F.encode("text", "utf-8").alias("content"), F.octet_length("text").cast("long").alias("size_bytes"), F.upper(F.when(F.col("doc_id") % 10 == 3, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))).alias("announced"))
    return ledger.finalize(docs).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


@query("SELECT l_orderkey, l_linenumber, arg_min(l_partkey, (l_shipdate, l_partkey)) AS l_partkey FROM lineitem GROUP BY 1, 2")
def occurrence_dedup(spark, sf_dir):
    return ledger.insert_once(B.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(epoch_us(ts)) AS heartbeat_at FROM events GROUP BY 1")
def latest_heartbeat(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").select("user_id", "event_type", B.micros("ts").alias("heartbeat_at"), "event_id")
    return ledger.latest(e, ["user_id"], "heartbeat_at", "event_id").drop("event_id")


@query("SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS boot_id, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS agent_sequence FROM events")
def boot_sequence(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("boot_id"), "event_id", "ts")
    return ledger.sequence(e, ["user_id", "boot_id"], ["ts", "event_id"]).drop("ts")


@query("""WITH a AS (SELECT o_orderkey AS path, o_custkey AS inode, epoch_us(o_orderdate) AS mtime, o_totalprice AS size FROM orders WHERE o_orderkey % 5 <> 1),
b AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 1 ELSE o_custkey END AS inode, epoch_us(o_orderdate) AS mtime, o_totalprice AS size FROM orders WHERE o_orderkey % 5 <> 2)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'gone' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.inode <> b.inode OR a.mtime <> b.mtime OR a.size <> b.size""")
def snapshot_diff(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("inode"), B.micros("o_orderdate").alias("mtime"), F.col("o_totalprice").alias("size"))
    after = o.where("path % 5 <> 2").withColumn("inode", F.when(F.col("path") % 11 == 0, F.col("inode") + 1).otherwise(F.col("inode")))
    return ledger.snapshot_diff(o.where("path % 5 <> 1"), after)


# --- rules and hunts -----------------------------------------------------------

_MATCH = f"{B.ARTIFACT}, {B.CONTENT}, {B.RULE}, hit AS (SELECT c.tenant_id, c.artifact_id, r.rule_id FROM content c JOIN rule r ON contains(c.text, r.literal))"


def _matches(spark, sf_dir):
    return hunts.literal_matches(B.contents(spark, sf_dir), B.literal_rules(spark, sf_dir))


@query(f"WITH {_MATCH} SELECT tenant_id, artifact_id, rule_id FROM hit")
def hunt_matches(spark, sf_dir):
    return _matches(spark, sf_dir)


@query("""SELECT sha256('rule-bundle-v1' || chr(0) || string_agg('item_' || item_id || chr(0) || text || chr(0), '' ORDER BY 'item_' || item_id) || 'v1') AS digest FROM benchmark""")
def bundle_digest(spark, sf_dir):
    return hunts.bundle_digest(B.literal_rules(spark, sf_dir), rule_id="rule_id", source="literal", config="v1")


_OUTCOME = f"""{B.ARTIFACT}, cache AS (SELECT tenant_id, sha256, CASE WHEN seq % 31 = 0 THEN 'timeout' ELSE 'clean' END AS status FROM artifact WHERE seq % 3 = 0),
outcome AS (SELECT a.tenant_id, a.artifact_id, CASE WHEN c.sha256 IS NOT NULL THEN c.status WHEN size_bytes > 20000 THEN 'error' WHEN artifact_class = 'de' THEN 'matched' ELSE 'clean' END AS status,
CASE WHEN c.sha256 IS NULL AND size_bytes <= 20000 AND artifact_class = 'de' THEN 1 ELSE 0 END AS n_rules, c.sha256 IS NOT NULL AS cached FROM artifact a LEFT JOIN cache c USING (tenant_id, sha256))"""


def _outcome(spark, sf_dir):
    a = B.artifacts(spark, sf_dir).withColumns({"artifact_sha256": F.col("sha256"), "rule_bundle_digest": F.lit("b1"), "engine_version": F.lit("e1"), "scan_config_digest": S.scan_config_digest()})
    cache = a.where("seq % 3 = 0").select(*hunts.CACHE_KEY, F.when(F.col("seq") % 31 == 0, "timeout").otherwise("clean").alias("status"), F.lit(0).alias("n_rules"))
    fresh = F.when(F.col("size_bytes") > 20000, "error").when(F.col("artifact_class") == "de", "matched").otherwise("clean")
    scanned = a.select("tenant_id", "artifact_id", fresh.alias("status"), (fresh == "matched").cast("int").alias("n_rules"))
    return hunts.execute(a.select("tenant_id", "artifact_id", *[c for c in hunts.CACHE_KEY if c != "tenant_id"]), cache, scanned)


@query(f"WITH {_OUTCOME} SELECT tenant_id, artifact_id, status, n_rules, cached FROM outcome")
def hunt_cache_replay(spark, sf_dir):
    return _outcome(spark, sf_dir)


@query(f"""WITH {_OUTCOME} SELECT *, CASE WHEN timed_out + failed > 0 THEN 'COMPLETED_PARTIAL' ELSE 'COMPLETED' END AS state FROM (SELECT count(*) AS planned, count(*) FILTER (NOT cached AND status NOT IN ('timeout', 'error')) AS scanned,
count(*) FILTER (cached) AS cache_hits, CAST(sum(n_rules) AS BIGINT) AS matched, count(*) FILTER (status = 'timeout') AS timed_out, count(*) FILTER (status = 'error') AS failed FROM outcome)""")
def hunt_counters(spark, sf_dir):
    return hunts.counters(_outcome(spark, sf_dir))


@query(f"""WITH {B.ARTIFACT} SELECT tenant_id, artifact_id, 'b' || b AS rule_bundle_digest FROM artifact CROSS JOIN (VALUES (1), (2)) v(b) WHERE NOT (b = 1 AND seq % 4 = 0)""")
def forward_matches(spark, sf_dir):
    a = B.artifacts(spark, sf_dir).select("tenant_id", "artifact_id", "seq", F.col("sha256").alias("artifact_sha256"))
    names = F.explode(F.array(*[F.struct(F.lit(b).alias("rule_bundle_digest"), F.lit(b != "b3").alias("active")) for b in ("b1", "b2", "b3")]))
    bundles = a.select("tenant_id").distinct().select("tenant_id", names.alias("b")).select("tenant_id", "b.*")
    cache = a.where("seq % 4 = 0").select("tenant_id", "artifact_sha256", F.lit("b1").alias("rule_bundle_digest"))
    return hunts.forward(a, bundles, cache).select("tenant_id", "artifact_id", "rule_bundle_digest")


_BLAST = f"""{B.OCCURRENCE}, {B.CONTENT}, {B.RULE}, hit AS (SELECT c.tenant_id, c.artifact_id, r.rule_id FROM content c JOIN rule r ON contains(c.text, r.literal)), {B.OPINION}, {_LATEST},
rules AS (SELECT tenant_id, artifact_id, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS matched_rules FROM hit GROUP BY 1, 2),
p AS (SELECT tenant_id, artifact_id, count(DISTINCT host_name) AS host_count, count(DISTINCT path) AS path_count, min(observed_at) AS first_observed, max(observed_at) AS last_observed FROM occurrence GROUP BY 1, 2)"""


@query(f"WITH {_BLAST} SELECT tenant_id, artifact_id, matched_rules, coalesce(host_count, 0) AS host_count, coalesce(path_count, 0) AS path_count, first_observed, last_observed, opinion FROM rules LEFT JOIN p USING (tenant_id, artifact_id) LEFT JOIN latest USING (tenant_id, artifact_id)")
def blast_radius_artifacts(spark, sf_dir):
    return analyst.blast_radius(_matches(spark, sf_dir), B.occurrences(spark, sf_dir), B.opinions(spark, sf_dir))


@query(f"WITH {_BLAST} SELECT tenant_id, host_name, string_agg(DISTINCT sha256, ',' ORDER BY sha256) AS digests, string_agg(DISTINCT path, ',' ORDER BY path) AS paths, min(observed_at) AS first_observed, max(observed_at) AS last_observed FROM occurrence SEMI JOIN rules USING (tenant_id, artifact_id) GROUP BY 1, 2")
def blast_radius_hosts(spark, sf_dir):
    found = _matches(spark, sf_dir).select("tenant_id", "artifact_id").distinct()
    return analyst.host_rollup(B.occurrences(spark, sf_dir).join(found, ["tenant_id", "artifact_id"], "left_semi"))


@query(f"WITH {B.ARTIFACT} SELECT coalesce(max(seq), 0) AS watermark, count(*) AS artifacts_evaluated FROM artifact WHERE NOT EXISTS (SELECT 1 FROM documents WHERE sha256(text) = 'no such digest')")
def absence_attestation(spark, sf_dir):
    a = B.artifacts(spark, sf_dir)
    return analyst.attestation(a, a.where("sha256 = 'no such digest'"))


_SEVERITY = f"""WITH {_BLAST}, joined AS (SELECT tenant_id, artifact_id, opinion, rules.matched_rules IS NOT NULL AS matched, coalesce(host_count, 0) AS hosts, CASE WHEN artifact_id % 50 = 7 THEN 'critical' END AS worst
FROM artifact LEFT JOIN rules USING (tenant_id, artifact_id) LEFT JOIN p USING (tenant_id, artifact_id) LEFT JOIN latest USING (tenant_id, artifact_id)),
base AS (SELECT *, CASE WHEN worst = 'critical' THEN 'critical' WHEN worst = 'high' OR opinion = 'malicious' THEN 'high' WHEN worst = 'medium' OR opinion = 'suspicious' OR matched THEN 'medium'
WHEN opinion IN ('grayware', 'vulnerable') THEN 'low' ELSE 'info' END AS b, (opinion IN ('malicious', 'suspicious')) IS TRUE OR (worst IN ('high', 'critical')) IS TRUE OR matched AS elevated FROM joined) """


def _investigated(spark, sf_dir):
    a = B.artifacts(spark, sf_dir).select("tenant_id", "artifact_id")
    hit = _matches(spark, sf_dir).select("tenant_id", "artifact_id").distinct().withColumn("m", F.lit(True))
    spread = analyst.prevalence(B.occurrences(spark, sf_dir)).select("tenant_id", "artifact_id", F.col("host_count").alias("h"))
    joined = a.join(hit, analyst.KEY, "left").join(spread, analyst.KEY, "left").join(analyst.latest_opinion(B.opinions(spark, sf_dir)), analyst.KEY, "left")
    return joined.withColumns({"matched": F.coalesce("m", F.lit(False)), "hosts": F.coalesce("h", F.lit(0)), "worst": F.when(F.col("artifact_id") % 50 == 7, "critical")})


@query(_SEVERITY + "SELECT tenant_id, artifact_id, CASE WHEN b = 'medium' AND hosts > 5 THEN 'high' ELSE b END AS level FROM base")
def severity_summary(spark, sf_dir):
    level = S.severity(F.col("worst"), F.col("opinion"), F.col("matched"), F.col("hosts"))
    return _investigated(spark, sf_dir).select("tenant_id", "artifact_id", level.alias("level"))


@query(_SEVERITY + "SELECT tenant_id, artifact_id, CASE WHEN NOT elevated THEN 'monitor' WHEN hosts > 0 THEN 'block_hash,contain_hosts,detonate,set_opinion' ELSE 'block_hash,detonate,set_opinion' END AS actions FROM base")
def recommended_actions(spark, sf_dir):
    names = S.recommended_actions(F.col("worst"), F.col("opinion"), F.col("matched"), F.col("hosts"))
    return _investigated(spark, sf_dir).select("tenant_id", "artifact_id", F.array_join(names, ",").alias("actions"))


# --- intel, triggers, telemetry ---------------------------------------------------

_SEEN = "seen AS (SELECT source AS tenant_id, 'feed' || (doc_id % 3) AS source, CASE WHEN lang = 'en' THEN 'sha256' ELSE 'md5' END AS ioc_type, CASE WHEN lang = 'en' THEN sha256(text) ELSE md5(text) END AS value, lang AS raw, doc_id AS seen_at FROM documents)"


def _seen(spark, sf_dir):
    """Every document, known by SHA-256 or, in other languages than English, by MD5 only."""
    sha = F.coalesce(F.col("lang") == "en", F.lit(False))
    return B.table(spark, sf_dir, "documents").select(
        F.col("source").alias("tenant_id"), F.concat(F.lit("feed"), (F.col("doc_id") % 3).cast("string")).alias("source"), F.when(sha, "sha256").otherwise("md5").alias("ioc_type"),
        F.upper(F.when(sha, F.sha2("text", 256)).otherwise(F.md5("text"))).alias("value"), F.col("lang").alias("raw"), F.col("doc_id").alias("seen_at"))


@query(f"WITH {_SEEN} SELECT tenant_id, source, ioc_type, value, min(seen_at) AS first_seen, max(seen_at) AS last_seen, arg_max(raw, seen_at) AS raw FROM seen GROUP BY 1, 2, 3, 4")
def indicator_upsert(spark, sf_dir):
    return events.upsert_indicators(_seen(spark, sf_dir))


@query(f"WITH {B.ARTIFACT}, {_SEEN} SELECT tenant_id, sha256, artifact_id FROM artifact WHERE (tenant_id, sha256) IN (SELECT tenant_id, value FROM seen WHERE ioc_type = 'sha256')")
def hash_hunt(spark, sf_dir):
    return events.hash_hunt(events.upsert_indicators(_seen(spark, sf_dir)), B.artifacts(spark, sf_dir)).select("tenant_id", "sha256", "artifact_id")


@query("""SELECT 'indicator--' || doc_id AS stix_id, unnest(['sha256', 'md5']) AS ioc_type, unnest([sha256(text), md5(text)]) AS value FROM documents WHERE lang = 'en'""")
def stix_hash_tokens(spark, sf_dir):
    return _stix(B.table(spark, sf_dir, "documents"), F.when(F.col("lang") == "en", "indicator").otherwise("malware"))


def _stix(docs, kind):
    pattern = F.concat(F.lit("[file:hashes.'SHA-256' = '"), F.upper(F.sha2("text", 256)), F.lit("' OR file:hashes.MD5 = '"), F.md5("text"), F.lit("']"))
    bundle = docs.select(F.to_json(F.struct(F.array(F.struct(kind.alias("type"), F.concat(F.lit("indicator--"), F.col("doc_id").cast("string")).alias("id"), pattern.alias("pattern"))).alias("objects"))).alias("bundle"))
    return events.stix_indicators(bundle).select("stix_id", "ioc_type", "value")


@query(f"""WITH {B.ARTIFACT}, {B.OPINION} SELECT o.tenant_id, o.artifact_id, o.opinion_id, t.trigger_id FROM opinion o JOIN (SELECT DISTINCT source AS tenant_id, 't' || k AS trigger_id, k FROM documents CROSS JOIN (VALUES (0), (1), (2)) v(k)) t
ON t.tenant_id = o.tenant_id WHERE o.opinion = 'malicious' AND t.k <> 1""")
def trigger_outbox(spark, sf_dir):
    tenants = B.table(spark, sf_dir, "documents").select(F.col("source").alias("tenant_id")).distinct()
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    triggers = tenants.select("tenant_id", k.alias("k")).select(
        "tenant_id", F.concat(F.lit("t"), F.col("k").cast("string")).alias("trigger_id"), F.lit("malicious_verdict").alias("condition"), F.lit("http://localhost/hook").alias("url"), (F.col("k") != 1).alias("enabled"))
    fired = B.opinions(spark, sf_dir).where("opinion = 'malicious'").withColumn("condition", F.lit("malicious_verdict"))
    return events.fan_out(fired, triggers).select("tenant_id", "artifact_id", "opinion_id", "trigger_id")


@query("SELECT event_id, CAST(least(300, 5 * pow(2, least(event_id % 12, 6))) AS BIGINT) AS seconds FROM events")
def backoff(spark, sf_dir):
    """How long each delivery waits after so many attempts."""
    return B.table(spark, sf_dir, "events").select("event_id", S.backoff_seconds(F.col("event_id") % 12).alias("seconds"))


@query(f"""WITH l AS (SELECT event_id, user_id, event_id % 3 AS k FROM events) SELECT event_id, CASE k WHEN 0 THEN 'T1055,T1486' WHEN 1 THEN 'T1055,T1071,T1027' ELSE 'T1055' END AS techniques FROM l""")
def mitre_heuristic(spark, sf_dir):
    k = F.col("event_id") % 3
    labels = F.array(F.concat(F.lit("Inject:"), F.col("event_type")), F.when(k == 0, "Ransom.x").when(k == 1, "packed C2").otherwise("plain"))
    return B.table(spark, sf_dir, "events").select("event_id", F.array_join(S.techniques(labels), ",").alias("techniques"))


@query("SELECT user_id, string_agg(DISTINCT t, ',' ORDER BY t) AS techniques FROM (SELECT user_id, unnest(CASE event_id % 3 WHEN 0 THEN ['T1055', 'T1486'] WHEN 1 THEN ['T1055', 'T1071', 'T1027'] ELSE ['T1055'] END) AS t FROM events) GROUP BY 1")
def technique_rollup(spark, sf_dir):
    k = F.col("event_id") % 3
    labels = F.array(F.lit("inject"), F.when(k == 0, "ransom").when(k == 1, "packed c2").otherwise("plain"))
    return events.technique_rollup(B.table(spark, sf_dir, "events").select("user_id", S.techniques(labels).alias("mitre")), "user_id")


@query("""WITH r AS (SELECT user_id AS host, event_id, ts, event_type, rep FROM events CROSS JOIN (VALUES (0), (1)) v(rep) WHERE rep = 0 OR event_id % 9 = 0)
SELECT CAST(host AS VARCHAR) AS host_name, count(*) AS total, count(DISTINCT event_id) AS accepted, count(*) - count(DISTINCT event_id) AS duplicates, max(epoch_us(ts)) AS last_observed FROM r GROUP BY 1""")
def telemetry_dedup(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    body = F.to_json(F.struct(F.concat(F.lit("boot"), F.col("user_id").cast("string")).alias("boot_id"), F.col("event_id").alias("source_seq"), F.col("event_type").alias("kind"), B.micros("ts").alias("us")))
    one = e.select(F.lit("t0").alias("tenant_id"), F.col("user_id").cast("string").alias("host_name"), F.lit("a.jsonl.gz").alias("segment"), body.alias("event"), "event_id", B.micros("ts").alias("us"))
    both = one.unionByName(one.where("event_id % 9 = 0").withColumn("segment", F.lit("b.jsonl.gz")))
    last = both.groupBy("host_name").agg(F.max("us").alias("last_observed"))
    found = events.telemetry_accept(both).groupBy("host_name").agg(F.count("*").alias("total"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("duplicates"))
    return found.join(last, "host_name")


# --- similarity and graph --------------------------------------------------------------

_BYTES = "bytes AS (SELECT page_id, unnest(regexp_extract_all(hex(encode(html)), '..')) AS b FROM pages)"


@query(f"WITH {_BYTES}, c AS (SELECT page_id, b, count(*) AS n FROM bytes GROUP BY 1, 2), e AS (SELECT page_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM c GROUP BY 1) SELECT page_id, round(coalesce(e, 0), 6) AS entropy FROM pages LEFT JOIN e USING (page_id)")
def entropy(spark, sf_dir):
    found = similarity.entropy(B.table(spark, sf_dir, "pages"), ["page_id"], F.encode("html", "utf-8"))
    return found.select("page_id", F.round("entropy", 6).alias("entropy"))


_DIGEST = "digest AS (SELECT doc_id, source AS tenant_id, lang, '96:' || substr(sha256(lang || (doc_id % 40)), 1, 20) || ':' || substr(sha256(text), 1, 4) AS fuzzy FROM documents)"


def _digests(spark, sf_dir):
    fuzzy = F.concat(F.lit("96:"), F.substring(F.sha2(F.concat("lang", (F.col("doc_id") % 40).cast("string")), 256), 1, 20), F.lit(":"), F.substring(F.sha2("text", 256), 1, 4))
    return B.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("tenant_id"), "lang", fuzzy.alias("fuzzy"))


_BANDS = _DIGEST + """, band AS (SELECT tenant_id, doc_id, i - 1 AS band_idx, '96:' || substr(split_part(fuzzy, ':', 2), i, 3) AS band_key FROM digest, range(1, 19) r(i)
UNION ALL SELECT tenant_id, doc_id, 17 + i, '96:' || substr(split_part(fuzzy, ':', 3), i, 3) FROM digest, range(1, 3) r(i))"""


def _bands(spark, sf_dir):
    return _digests(spark, sf_dir).select("tenant_id", F.col("doc_id").alias("artifact_id"), F.posexplode(S.lsh_bands(F.col("fuzzy"))).alias("band_idx", "band_key"))


@query(f"WITH {_BANDS} SELECT tenant_id, doc_id AS artifact_id, CAST(band_idx AS INTEGER) AS band_idx, band_key FROM band")
def lsh_bands(spark, sf_dir):
    return _bands(spark, sf_dir)


@query(f"""WITH {_BANDS}, pair AS (SELECT DISTINCT a.tenant_id, a.doc_id AS src, b.doc_id AS dst FROM band a JOIN band b ON a.tenant_id = b.tenant_id AND a.band_idx = b.band_idx AND a.band_key = b.band_key AND a.doc_id < b.doc_id)
SELECT * FROM pair QUALIFY row_number() OVER (PARTITION BY tenant_id, src ORDER BY dst) <= 512""")
def lsh_candidates(spark, sf_dir):
    return similarity.candidates(_bands(spark, sf_dir))


_FEATURE = "feature AS (SELECT tenant_id, artifact_id, artifact_class, seq // 20 % 13 AS norm, seq // 20 % 7 AS hint FROM artifact)"


def _feature(spark, sf_dir):
    return B.artifacts(spark, sf_dir).select("tenant_id", "artifact_id", "artifact_class", "size_bytes", (F.floor(F.col("seq") / 20) % 13).alias("norm"), (F.floor(F.col("seq") / 20) % 7).alias("hint"))


@query(f"WITH {B.ARTIFACT}, {_FEATURE} SELECT tenant_id, src, artifact_id AS dst FROM (SELECT *, min(artifact_id) OVER (PARTITION BY tenant_id, artifact_class, norm) AS src FROM feature) WHERE artifact_id > src")
def normalized_edges(spark, sf_dir):
    """Stars, not all pairs: a value shared by many would give the square of them."""
    return similarity.equal_edges(_feature(spark, sf_dir), "norm", "normalized_equivalent").select("tenant_id", "src", "dst")


@query(f"WITH {B.ARTIFACT}, {_FEATURE} SELECT tenant_id, src, artifact_id AS dst FROM (SELECT *, min(artifact_id) OVER (PARTITION BY tenant_id, hint) AS src FROM feature) WHERE artifact_id > src")
def provenance_edges(spark, sf_dir):
    return similarity.equal_edges(_feature(spark, sf_dir), "hint", "shared_provenance", within=None).select("tenant_id", "src", "dst")


_EDGES = """edge AS (SELECT 't' || (o_custkey % 3) AS tenant_id, least(o_custkey, (o_orderkey * 7) % 1000) AS src, greatest(o_custkey, (o_orderkey * 7) % 1000) AS dst,
CASE WHEN o_orderkey % 12 = 0 THEN 'normalized_equivalent' WHEN o_orderkey % 12 = 1 THEN 'semantic_variant_strong' WHEN o_orderkey % 3 = 1 THEN 'byte_similar' ELSE 'shared_provenance' END AS edge_type, o_orderkey % 100 + 1.0 AS score FROM orders),
one AS (SELECT DISTINCT tenant_id, src, dst, edge_type FROM edge WHERE src <> dst)"""


def _edges(spark, sf_dir):
    k, other = F.col("o_orderkey"), (F.col("o_orderkey") * 7) % 1000
    kind = F.when(k % 12 == 0, "normalized_equivalent").when(k % 12 == 1, "semantic_variant_strong").when(k % 3 == 1, "byte_similar").otherwise("shared_provenance")
    orders = B.table(spark, sf_dir, "orders")
    e = orders.select(
        F.concat(F.lit("t"), (F.col("o_custkey") % 3).cast("string")).alias("tenant_id"), F.col("o_custkey").alias("src"), other.alias("dst"), kind.alias("edge_type"), (k % 100 + 1).cast("double").alias("score"))
    return graph.canonical(e)


@query(f"WITH {_EDGES} SELECT tenant_id, src, dst, edge_type FROM one")
def canonical_edges(spark, sf_dir):
    return _edges(spark, sf_dir).drop("score")


_STRONG = """, strong AS (SELECT tenant_id, src AS a, dst AS b FROM one WHERE edge_type IN ('normalized_equivalent', 'semantic_variant_strong') UNION SELECT tenant_id, dst, src FROM one WHERE edge_type IN ('normalized_equivalent', 'semantic_variant_strong')),
reach(tenant_id, a, b) AS (SELECT tenant_id, a, a FROM strong UNION SELECT r.tenant_id, r.a, s.b FROM reach r JOIN strong s ON s.tenant_id = r.tenant_id AND s.a = r.b),
grp AS (SELECT tenant_id, a AS artifact_id, min(b) AS group_id FROM reach GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_EDGES}{_STRONG} SELECT * FROM grp")
def variant_groups(spark, sf_dir):
    return graph.variant_groups(_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {_EDGES}{_STRONG} SELECT g.tenant_id, g.group_id, count(*) AS members, min(artifact_id) AS least, max(artifact_id) AS greatest FROM grp g GROUP BY 1, 2")
def group_members(spark, sf_dir):
    g = graph.variant_groups(_edges(spark, sf_dir))
    return graph.group_members(g, g.select("tenant_id", "artifact_id")).groupBy("tenant_id", "group_id").agg(F.count("*").alias("members"), F.min("artifact_id").alias("least"), F.max("artifact_id").alias("greatest"))


_WAYS = ", ways AS (SELECT tenant_id, src AS node, dst AS other FROM one UNION SELECT tenant_id, dst, src FROM one)"


@query(f"""WITH {_EDGES}{_WAYS}, d0 AS (SELECT DISTINCT tenant_id, node FROM ways WHERE node = 7), d1 AS (SELECT DISTINCT w.tenant_id, w.other AS node FROM ways w JOIN d0 USING (tenant_id, node) EXCEPT SELECT tenant_id, node FROM d0),
d2 AS (SELECT DISTINCT w.tenant_id, w.other AS node FROM ways w JOIN d1 USING (tenant_id, node) EXCEPT (SELECT tenant_id, node FROM d0 UNION SELECT tenant_id, node FROM d1))
SELECT tenant_id, node, 0 AS depth FROM d0 UNION ALL SELECT tenant_id, node, 1 FROM d1 UNION ALL SELECT tenant_id, node, 2 FROM d2""")
def neighborhood_bfs(spark, sf_dir):
    e = _edges(spark, sf_dir)
    seeds = graph.both_ways(e).where("node = 7").select("tenant_id", F.col("node").alias("artifact_id")).distinct()
    return graph.neighborhood(e, seeds, depth=2, most_nodes=1_000_000)


@query(f"WITH RECURSIVE {_EDGES}{_STRONG} SELECT tenant_id, src, dst, edge_type FROM one JOIN grp a ON a.tenant_id = one.tenant_id AND a.artifact_id = src JOIN grp b ON b.tenant_id = one.tenant_id AND b.artifact_id = dst".replace("SELECT tenant_id, src, dst, edge_type FROM one JOIN", "SELECT one.tenant_id, src, dst, edge_type FROM one JOIN"))
def intra_group_edges(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graph.inside(e, graph.variant_groups(e)).select("tenant_id", "src", "dst", "edge_type")


@query(f"""WITH RECURSIVE {_EDGES}{_STRONG}, weak AS (SELECT tenant_id, src AS node, dst AS other FROM one WHERE edge_type IN ('byte_similar', 'shared_provenance') UNION SELECT tenant_id, dst, src FROM one WHERE edge_type IN ('byte_similar', 'shared_provenance'))
SELECT DISTINCT g.tenant_id, g.group_id, w.other FROM weak w JOIN grp g ON g.tenant_id = w.tenant_id AND g.artifact_id = w.node WHERE NOT EXISTS (SELECT 1 FROM grp h WHERE h.tenant_id = g.tenant_id AND h.group_id = g.group_id AND h.artifact_id = w.other)""")
def weak_leads(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graph.weak_leads(e, graph.variant_groups(e))


@query(f"WITH {_EDGES} SELECT edge_type, count(*) AS edges, count(*) FILTER (src % 2 = 0 AND src % 5 <> 0) AS superseded FROM one GROUP BY 1")
def supersede_dry_run(spark, sf_dir):
    e = _edges(spark, sf_dir).withColumns({"model_version": F.when(F.col("src") % 2 == 0, "v1").otherwise("v2"), "evidence": F.when(F.col("src") % 5 == 0, '{"superseded":"true"}').otherwise('{"score":"1"}')})
    return graph.supersede(e, before="v1", note="v2").groupBy("edge_type").agg(F.count("*").alias("edges"), F.count_if("was_superseded").alias("superseded"))


@query(f"""WITH {B.OCCURRENCE}, {B.OPINION}, gone AS (SELECT tenant_id, artifact_id FROM artifact WHERE artifact_class = 'de') SELECT 'artifact' AS family, (SELECT count(*) FROM artifact SEMI JOIN gone USING (tenant_id, artifact_id)) AS n
UNION ALL SELECT 'occurrence', (SELECT count(*) FROM occurrence SEMI JOIN gone USING (tenant_id, artifact_id)) UNION ALL SELECT 'opinion', (SELECT count(*) FROM opinion SEMI JOIN gone USING (tenant_id, artifact_id))""")
def cleanup_counts(spark, sf_dir):
    a = B.artifacts(spark, sf_dir)
    gone = a.where("artifact_class = 'de'").select("tenant_id", "artifact_id")
    return ledger.cleanup_counts({"artifact": a, "occurrence": B.occurrences(spark, sf_dir), "opinion": B.opinions(spark, sf_dir)}, gone)


@query(f"WITH {B.ARTIFACT} SELECT tenant_id, artifact_id, seq FROM artifact WHERE seq % 3 <> 0 OR seq % 2 = 0")
def backfill_frontier(spark, sf_dir):
    a = B.artifacts(spark, sf_dir)
    feature = a.where("seq % 3 = 0").select("tenant_id", "artifact_id", F.when(F.col("seq") % 2 == 0, "v0").otherwise("v1").alias("version"))
    return similarity.backfill_frontier(a, feature, "v1").select("tenant_id", "artifact_id", "seq")


# --- functions of artifacts: lines of the benchmark's items stand for functions -------------

_FUNCTIONS = """tok AS (SELECT item_id, p AS off, lower(unnest(string_split(text, ' '))) AS w FROM (SELECT item_id, 0 AS p, text FROM benchmark)),
fn AS (SELECT item_id, list_sort(list_distinct(list(concat(h[15:16], h[13:14], h[11:12], h[9:10], h[7:8], h[5:6], h[3:4], h[1:2])))) AS tokens FROM (SELECT item_id, sha256(w) AS h FROM tok WHERE w <> '') GROUP BY 1)"""


def _functions(spark, sf_dir):
    words = F.filter(F.transform(F.split("text", " "), F.lower), lambda w: w != "")
    return B.table(spark, sf_dir, "benchmark").select("item_id", F.array_sort(F.array_distinct(F.transform(words, S.token_hash))).alias("tokens"))


@query(f"WITH {_FUNCTIONS} SELECT item_id, tokens[1] AS first_band, tokens[-1] AS last_band, lpad(lower(hex(list_reduce(list_transform(tokens, lambda x: CAST('0x' || substr(x, 1, 8) AS UBIGINT)), lambda a, b: xor(a, b)))), 8, '0') || lpad(lower(hex(list_reduce(list_transform(tokens, lambda x: CAST('0x' || substr(x, 9, 8) AS UBIGINT)), lambda a, b: xor(a, b)))), 8, '0') AS fold_band, (CASE WHEN len(tokens) <= 4 THEN '0' WHEN len(tokens) <= 16 THEN '1' WHEN len(tokens) <= 64 THEN '2' ELSE '3' END) || ':' || tokens[len(tokens) // 2 + 1] AS middle_band FROM fn")
def function_bands(spark, sf_dir):
    b = S.function_bands(F.col("tokens"))
    return _functions(spark, sf_dir).select("item_id", F.get(b, 0).alias("first_band"), F.get(b, 1).alias("last_band"), F.get(b, 2).alias("fold_band"), F.get(b, 3).alias("middle_band"))


@query(f"""WITH {_FUNCTIONS}, t AS (SELECT item_id, len(tokens) AS n, unnest(tokens) AS k FROM fn), c AS (SELECT a.item_id AS src, b.item_id AS dst, count(*) AS both_n, any_value(a.n) AS na, any_value(b.n) AS nb FROM t a JOIN t b ON a.k = b.k AND a.item_id < b.item_id GROUP BY 1, 2)
SELECT src, dst, round(both_n / (na + nb - both_n), 6) AS jaccard FROM c WHERE both_n / (na + nb - both_n) >= 0.1""")
def jaccard_pairs(spark, sf_dir):
    f = _functions(spark, sf_dir)
    t = f.select("item_id", "tokens", F.explode("tokens").alias("k"))
    a, b = t.select(F.col("item_id").alias("src"), F.col("tokens").alias("ta"), "k"), t.select(F.col("item_id").alias("dst"), F.col("tokens").alias("tb"), "k")
    pairs = a.join(b, "k").where("src < dst").groupBy("src", "dst").agg(F.first("ta").alias("ta"), F.first("tb").alias("tb"))
    score = S.jaccard(F.col("ta"), F.col("tb"))
    return pairs.where(score >= 0.1).select("src", "dst", F.round(score, 6).alias("jaccard"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount >= 0.06 AND l_tax >= 0.06 AND l_linenumber >= 3 THEN 'semantic_variant_strong' WHEN l_discount >= 0.035 AND l_tax >= 0.035 THEN 'semantic_variant_weak' END AS edge_type FROM lineitem""")
def semantic_classify(spark, sf_dir):
    edge = S.semantic_edge(F.round(F.col("l_discount") * 10, 6), F.round(F.col("l_tax") * 10, 6), F.col("l_linenumber"))
    return B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", edge.alias("edge_type"))


@query("""SELECT event_id, CASE WHEN k = 0 THEN 'name_pattern:memcpy' WHEN k = 1 THEN 'name_pattern:std::' WHEN n < 12 AND t <= 4 THEN 'tiny_generic_shape' END AS reason FROM (SELECT event_id, event_id % 5 AS k, event_id % 30 AS n, event_id % 7 AS t FROM events)""")
def suppression(spark, sf_dir):
    k = F.col("event_id") % 5
    name = F.when(k == 0, "My_MemCpy_impl").when(k == 1, "std::sort").when(k == 2, "handle_request")
    return B.table(spark, sf_dir, "events").select("event_id", S.suppression(name, F.col("event_id") % 30, F.col("event_id") % 7).alias("reason"))


@query("""SELECT doc_id, CASE WHEN n = 0 THEN 0 WHEN n <= 2 THEN 1 WHEN n <= 5 THEN 2 WHEN n <= 10 THEN 3 WHEN n <= 20 THEN 4 WHEN n <= 40 THEN 5 ELSE 6 END AS bucket FROM (SELECT doc_id, length(text) - length(replace(text, '.', '')) AS n FROM documents)""")
def count_buckets(spark, sf_dir):
    """Documents by the bucket of how many full stops they hold."""
    n = F.length("text") - F.length(F.replace("text", F.lit("."), F.lit("")))
    return B.table(spark, sf_dir, "documents").select("doc_id", S.count_bucket(n).alias("bucket"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 6.0 AS m, l_linenumber % 4 AS imports, l_partkey % 2 = 0 AS overlay, l_partkey % 3 = 0 AS w, l_suppkey % 2 = 0 AS mk FROM lineitem),
f AS (SELECT *, (CASE WHEN w THEN 1 ELSE 0 END) + (CASE WHEN m > 7.2 THEN 1 ELSE 0 END) + (CASE WHEN m + 0.2 > 7.5 THEN 1 ELSE 0 END) + (CASE WHEN imports > 0 AND imports < 3 AND m > 6.5 THEN 1 ELSE 0 END) + (CASE WHEN overlay AND m > 6.8 THEN 1 ELSE 0 END) + (CASE WHEN mk THEN 1 ELSE 0 END) AS fired FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, fired, m > 7.2 OR (mk AND fired >= 2) OR (w AND m > 6.5) AS blocked FROM f""")
def triage_policy(spark, sf_dir):
    mean = F.col("l_quantity") / 6.0
    one = lambda c: c.cast("int")
    fired, blocked = similarity.triage(mean, mean + 0.2, F.col("l_linenumber") % 4, F.col("l_partkey") % 2 == 0, one(F.col("l_partkey") % 3 == 0), one(F.col("l_suppkey") % 2 == 0))
    return B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.size(fired).alias("fired"), blocked.alias("blocked"))


# --- scalar functions over tables ----------------------------------------------------------------


@query("SELECT page_id, ends_with(url, '.html') OR starts_with(url, 'http://m.') OR contains(url, 'blog') AS excluded FROM pages")
def path_exclusion(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", S.excluded(F.col("url"), ["*.html", "http://m.*", "blog"]).alias("excluded"))


@query("SELECT s_suppkey, regexp_full_match(lower(replace(s_name, '#', CASE WHEN s_suppkey % 2 = 0 THEN '-' ELSE '_' END)), '[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?') AS valid FROM supplier")
def slug_validation(spark, sf_dir):
    slug = F.lower(F.replace("s_name", F.lit("#"), F.when(F.col("s_suppkey") % 2 == 0, "-").otherwise("_")))
    return B.table(spark, sf_dir, "supplier").select("s_suppkey", S.valid_slug(slug).alias("valid"))


@query(f"WITH {B.ARTIFACT} SELECT tenant_id, artifact_id, substr(sha256(concat_ws('|', tenant_id, artifact_id, 'byte', 'v1', 'm1', 'c1', sha256, 'ok', size_bytes)), 1, 32) AS receipt_id FROM artifact")
def receipt_id(spark, sf_dir):
    c = F.lit
    return B.artifacts(spark, sf_dir).select(
        "tenant_id", "artifact_id", S.receipt_id(F.col("tenant_id"), F.col("artifact_id"), c("byte"), c("v1"), c("m1"), c("c1"), F.col("sha256"), c("ok"), F.col("size_bytes")).alias("receipt_id"))


@query("""SELECT DISTINCT source AS tenant_id, substr(sha256('byte_similar_min_score=40;size_ratio_max=4;entropy_delta_max=2;semantic_match_tau=0.35;semantic_weak_coverage=0.35;semantic_strong_coverage=0.6;semantic_strong_min_pairs=3;packed_entropy_limit=7.2;significance_min_insns=5'), 1, 32) AS model,
sha256('scan-config:v1:timeout_ms=10000:max_match_evidence=64') AS scan FROM documents""")
def config_digests(spark, sf_dir):
    """What each tenant's cache keys carry."""
    return B.table(spark, sf_dir, "documents").select(F.col("source").alias("tenant_id")).distinct().select("tenant_id", S.model_digest().alias("model"), S.scan_config_digest().alias("scan"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'initialize:900' WHEN event_id % 4 = 1 AND event_id BETWEEN 100 AND 900 THEN 'resume:' || event_id ELSE 'reconcile:900' END AS plan FROM events""")
def resume_plan(spark, sf_dir):
    k = F.col("event_id") % 4
    plan = S.resume_plan(F.when(k != 0, k), F.when(k != 0, F.col("event_id")), F.lit(1), F.lit(100), F.lit(900))
    return B.table(spark, sf_dir, "events").select("event_id", plan.alias("plan"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'ghcr.io' WHEN page_id % 4 = 1 THEN 'registry-1.docker.io' WHEN page_id % 4 = 2 THEN 'registry-1.docker.io' ELSE 'localhost:5000' END AS registry,
CASE WHEN page_id % 4 = 0 THEN 'acme/app' || page_id WHEN page_id % 4 = 1 THEN 'library/app' || page_id WHEN page_id % 4 = 2 THEN 'acme/app' || page_id ELSE 'app' || page_id END AS repository,
CASE WHEN page_id % 4 = 0 THEN 'v1' WHEN page_id % 4 = 1 THEN 'latest' WHEN page_id % 4 = 2 THEN 'sha256:ab' ELSE 'latest' END AS reference FROM pages""")
def image_reference(spark, sf_dir):
    k, app = F.col("page_id") % 4, F.concat(F.lit("app"), F.col("page_id").cast("string"))
    ref = F.when(k == 0, F.concat(F.lit("ghcr.io/acme/"), app, F.lit(":v1"))).when(k == 1, app).when(k == 2, F.concat(F.lit("acme/"), app, F.lit("@sha256:ab"))).otherwise(F.concat(F.lit("localhost:5000/"), app))
    return B.table(spark, sf_dir, "pages").select("page_id", S.image_ref(ref).alias("r")).select("page_id", "r.registry", "r.repository", "r.reference")


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'elf' WHEN 1 THEN 'script' WHEN 2 THEN 'macho' WHEN 3 THEN 'macho_fat' ELSE 'unknown' END AS artifact_class, upper(hex(encode(substr(text, 1, 1)))) AS first_byte FROM documents""")
def classify(spark, sf_dir):
    k = F.col("doc_id") % 5
    head = F.when(k == 0, F.unhex(F.lit("7F454C46"))).when(k == 1, F.unhex(F.lit("2321"))).when(k == 2, F.unhex(F.lit("CFFAEDFE"))).when(k == 3, F.unhex(F.lit("CAFEBABE"))).otherwise(F.unhex(F.lit("00")))
    return B.table(spark, sf_dir, "documents").select("doc_id", S.classify_bytes(F.concat(head, F.encode("text", "utf-8"))).alias("artifact_class"), F.hex(F.encode(F.substring("text", 1, 1), "utf-8")).alias("first_byte"))


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size_bytes, CASE WHEN strlen(text) > 16 THEN substr(hex(encode(text)), 33, 16) ELSE '' END AS range_hex FROM documents")
def content_range(spark, sf_dir):
    b = F.encode("text", "utf-8")
    return B.table(spark, sf_dir, "documents").select("doc_id", F.sha2(b, 256).alias("sha256"), F.octet_length(b).cast("long").alias("size_bytes"), F.hex(F.substring(b, 17, 8)).alias("range_hex"))


# --- dimensions and views ---------------------------------------------------------------------------


@query("""WITH tenant AS (SELECT 'id-' || s_suppkey AS tenant_id, 'slug-' || s_suppkey AS slug, CASE WHEN s_suppkey % 7 = 0 THEN 'suspended' ELSE 'active' END AS state FROM supplier UNION ALL SELECT 'id-default', 'default', 'active'),
request AS (SELECT event_id AS request_id, CASE event_id % 4 WHEN 0 THEN 'id-' || user_id WHEN 1 THEN ' SLUG-' || user_id || ' ' WHEN 2 THEN '' END AS spec FROM events)
SELECT request_id, t.tenant_id FROM request r LEFT JOIN tenant t ON t.state = 'active' AND lower(CASE WHEN coalesce(trim(spec), '') = '' THEN 'default' ELSE trim(spec) END) IN (t.tenant_id, t.slug)""")
def tenant_resolution(spark, sf_dir):
    k, name = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    tenant = B.table(spark, sf_dir, "supplier").select(F.concat(F.lit("id-"), name).alias("tenant_id"), F.concat(F.lit("slug-"), name).alias("slug"), F.when(k % 7 == 0, "suspended").otherwise("active").alias("state"))
    tenant = tenant.unionByName(spark.createDataFrame([("id-default", "default", "active")], "tenant_id string, slug string, state string"))
    k, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    spec = F.when(k == 0, F.concat(F.lit("id-"), user)).when(k == 1, F.concat(F.lit(" SLUG-"), user, F.lit(" "))).when(k == 2, "")
    return catalogue.resolve_tenant(B.table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), spec.alias("spec")), tenant)


@query("SELECT 't0' AS tenant_id, 'ns' || (p_size % 3) AS namespace, p_name AS stable_id, count(DISTINCT p_type) AS sources, count(*) AS offers FROM part GROUP BY 1, 2, 3 HAVING count(DISTINCT p_type) > 1")
def rule_conflicts(spark, sf_dir):
    p = B.table(spark, sf_dir, "part")
    return catalogue.rule_conflicts(p.select(F.lit("t0").alias("tenant_id"), F.concat(F.lit("ns"), (F.col("p_size") % 3).cast("string")).alias("namespace"), F.col("p_name").alias("stable_id"), F.col("p_type").alias("source")))


@query("""WITH rule AS (SELECT 't' || (p_partkey % 3) AS tenant_id, 'u' || p_partkey AS rule_id, 'r' || (p_partkey // 6) AS stable_id FROM part), spec AS (SELECT DISTINCT 't' || (l_suppkey % 3) AS tenant_id, CASE WHEN l_partkey % 2 = 0 THEN 'u' || l_partkey ELSE 'r' || (l_partkey // 3) END AS spec FROM lineitem)
SELECT s.tenant_id, spec, coalesce(a.rule_id, b.rule_id) AS rule_id FROM spec s LEFT JOIN rule a ON a.rule_id = spec AND a.tenant_id = s.tenant_id LEFT JOIN (SELECT tenant_id, stable_id, min(rule_id) AS rule_id FROM rule GROUP BY 1, 2) b ON b.stable_id = spec AND b.tenant_id = s.tenant_id""")
def rule_resolution(spark, sf_dir):
    named = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    p, k = F.col("p_partkey"), F.col("l_partkey")
    rule = B.table(spark, sf_dir, "part").select(named("t", p % 3).alias("tenant_id"), named("u", p).alias("rule_id"), named("r", F.floor(p / 6)).alias("stable_id"))
    spec = B.table(spark, sf_dir, "lineitem").select(named("t", F.col("l_suppkey") % 3).alias("tenant_id"), F.when(k % 2 == 0, named("u", k)).otherwise(named("r", F.floor(k / 3))).alias("spec")).distinct()
    return catalogue.resolve_rule(spec, rule)


@query("""SELECT event_id, '{"type":"' || event_type || '","score":"' || (event_id % 100) || '"}' AS evidence FROM events""")
def evidence_strip(spark, sf_dir):
    whole = F.to_json(F.struct(F.col("event_type").alias("type"), F.lit("x").alias("secret"), (F.col("event_id") % 100).cast("string").alias("score"), F.lit("y").alias("matched_feature")))
    return B.table(spark, sf_dir, "events").select("event_id", catalogue.evidence_strip(whole).alias("evidence"))


@query("""SELECT o_orderkey, sha256(string_agg(lower(n) || chr(0), '' ORDER BY lower(n))) AS import_hash FROM (SELECT o_orderkey, unnest([o_orderpriority, o_orderstatus, 'LoadLibrary']) AS n FROM orders) t GROUP BY 1""")
def import_set_hash(spark, sf_dir):
    names = F.array("o_orderpriority", "o_orderstatus", F.lit("LoadLibrary"), F.lit("loadlibrary"))
    return B.table(spark, sf_dir, "orders").select("o_orderkey", catalogue.join_hash(names).alias("import_hash"))


@query("""SELECT l_orderkey, round(sum(l_discount * 80 * l_linenumber) / sum(l_linenumber), 6) AS mean_entropy, round(max(l_discount * 80), 6) AS max_entropy FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1""")
def section_entropy(spark, sf_dir):
    s = B.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("size"), (F.col("l_discount") * 80).alias("entropy"), (F.col("l_returnflag") != "N").alias("executable"))
    return catalogue.section_entropy(s, ["l_orderkey"]).select("l_orderkey", F.round("mean_entropy", 6).alias("mean_entropy"), F.round("max_entropy", 6).alias("max_entropy"))


@query("SELECT user_id, arg_min(event_id % 5, (event_id % 5, event_id)) AS priority, arg_min(event_id, (event_id % 5, event_id)) AS job_id FROM events WHERE epoch_us(ts) <= 1705000000000000 GROUP BY 1")
def priority_queue(spark, sf_dir):
    q = B.table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 5).alias("priority"), F.col("event_id").alias("job_id"), B.micros("ts").alias("due_at"))
    return catalogue.next_due(q, 1_705_000_000_000_000, ["user_id"])


@query("SELECT event_id AS request_id, v AS version, CASE WHEN v = 'sem:v0' THEN 'retired' WHEN v = 'none' THEN 'unknown' ELSE 'active' END AS status FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'byte:v1' WHEN 1 THEN 'sem:v0' WHEN 2 THEN 'sem:v1' ELSE 'none' END AS v FROM events)")
def analyzer_registry(spark, sf_dir):
    k = F.col("event_id") % 4
    r = B.table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.when(k == 0, "byte:v1").when(k == 1, "sem:v0").when(k == 2, "sem:v1").otherwise("none").alias("version"))
    return catalogue.lookup_analyzer(r, catalogue.analyzer(spark))


@query(f"""WITH {B.ARTIFACT}, e AS (SELECT a.tenant_id, a.artifact_id AS src, b.artifact_id AS dst FROM artifact a JOIN artifact b ON a.tenant_id = b.tenant_id AND b.artifact_id = a.artifact_id + 40)
SELECT x.tenant_id, x.artifact_id, x.other, a.sha256 AS other_sha256 FROM (SELECT tenant_id, src AS artifact_id, dst AS other FROM e UNION ALL SELECT tenant_id, dst, src FROM e) x JOIN artifact a ON a.tenant_id = x.tenant_id AND a.artifact_id = x.other""")
def similar_view(spark, sf_dir):
    a = B.artifacts(spark, sf_dir)
    b = a.select("tenant_id", (F.col("artifact_id") - 40).alias("src"), F.col("artifact_id").alias("dst"))
    edge = a.select("tenant_id", F.col("artifact_id").alias("src")).join(b, ["tenant_id", "src"]).withColumns({"edge_type": F.lit("byte_similar"), "score": F.lit(50.0)})
    return catalogue.similar_view(edge, a).select("tenant_id", "artifact_id", "other", "other_sha256")


@query("""SELECT event_id, h NOT IN ('.', '..') AND regexp_full_match(h, '[A-Za-z0-9._-]+') AS host_ok, regexp_full_match(s, '[A-Za-z0-9._-]*[.]jsonl[.]gz') AS segment_ok, length(d) = 64 AS digest_ok
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'host-' || user_id WHEN 1 THEN '..' ELSE 'a b' END AS h, event_type || CASE WHEN event_id % 2 = 0 THEN '.jsonl.gz' ELSE '.jsonl' END AS s, substr(sha256(event_type), 1, CASE WHEN event_id % 5 = 0 THEN 63 ELSE 64 END) AS d FROM events)""")
def telemetry_validators(spark, sf_dir):
    k = F.col("event_id")
    e = B.table(spark, sf_dir, "events").select(
        "event_id", F.when(k % 3 == 0, F.concat(F.lit("host-"), F.col("user_id").cast("string"))).when(k % 3 == 1, "..").otherwise("a b").alias("h"), F.concat("event_type", F.when(k % 2 == 0, ".jsonl.gz").otherwise(".jsonl")).alias("s"),
        F.substring(F.sha2("event_type", 256), F.lit(1), F.when(k % 5 == 0, 63).otherwise(64)).alias("d"))
    return catalogue.validators(e, "h", "s", "d").select("event_id", "host_ok", "segment_ok", "digest_ok")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'e' || event_id ELSE 'b' || user_id || ':' || event_id END AS identity, 'b' || user_id AS boot_id, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN sha256(event_type) END AS artifact_sha256, event_id * 1000000 + 500000 AS observed_at FROM events""")
def telemetry_identity(spark, sf_dir):
    k = F.col("event_id")
    body = F.to_json(F.struct(
        F.when(k % 3 == 0, F.concat(F.lit("e"), k.cast("string"))).alias("event_id"), F.concat(F.lit("b"), F.col("user_id").cast("string")).alias("boot_id"), k.alias("source_seq"), F.col("event_type").alias("kind"),
        F.lit("not a digest").alias("exe_sha256"), F.when(k % 2 == 0, F.upper(F.sha2("event_type", 256))).alias("file_sha256"), (k + 0.5).alias("ts")))
    e = B.table(spark, sf_dir, "events").select("event_id", events.telemetry_identity(body).alias("i"))
    return e.select("event_id", F.col("i.event_id").alias("identity"), "i.boot_id", "i.kind", "i.artifact_sha256", "i.observed_at")


@query("""SELECT event_id AS outbox_id, CAST(900000000 + least(300, 5 * pow(2, least(event_id % 9, 6))) * 1000000 AS BIGINT) AS retry_at, event_id % 9 + 1 >= 8 AS given_up FROM events WHERE event_id % 9 < 8 AND event_id <= 900000000 AND event_id % 2 = 0 ORDER BY event_id LIMIT 20""")
def outbox_delivery(spark, sf_dir):
    box = B.table(spark, sf_dir, "events").select(F.col("event_id").alias("outbox_id"), F.col("event_id").alias("next_attempt_at"), (F.col("event_id") % 2 == 1).alias("delivered"), (F.col("event_id") % 9).alias("attempts"))
    return events.delivery(box, 900_000_000).select("outbox_id", "retry_at", "given_up")


@query("""SELECT event_id, 'signature' AS category, 'sig' || (event_id % 10) || ': d' AS summary, event_id % 10 AS severity FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'attack', 'ATT&CK T' || (1000 + event_id % 50) || ' (observed in sandbox)', NULL FROM events""")
def sandbox_findings(spark, sf_dir):
    k = F.col("event_id")
    sig = F.when(k % 2 == 0, F.array(F.struct(F.concat(F.lit("sig"), (k % 10).cast("string")).alias("name"), F.lit("d").alias("description"), (k % 10).alias("severity"))))
    report = F.to_json(F.struct(sig.alias("signatures"), F.array(F.struct(F.concat(F.lit("T"), (1000 + k % 50).cast("string")).alias("ttp"))).alias("ttps")))
    return B.table(spark, sf_dir, "events").select("event_id", F.explode(events.sandbox_findings(report)).alias("f")).select("event_id", "f.category", "f.summary", "f.severity")


@query("""WITH d AS (SELECT doc_id, substr(sha256(lang || (doc_id % 40)), 1, 20) AS h, source FROM documents), p AS (SELECT a.doc_id AS src, b.doc_id AS dst, a.h AS x, b.h AS y FROM d a JOIN d b ON a.source = b.source AND b.doc_id = a.doc_id + 40),
s AS (SELECT src, dst, x, y, EXISTS (SELECT 1 FROM range(1, 15) r(i) WHERE contains(y, substr(x, CAST(i AS BIGINT), 7))) AS common FROM p)
SELECT src, dst, CASE WHEN x = y THEN 100 WHEN common THEN CAST(least(100 - (100 * ((levenshtein(x, y) * 64) // 40)) // 64, 32 * 20) AS INTEGER) ELSE 0 END AS score FROM s""")
def fuzzy_compare(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("96:"), F.substring(F.sha2(F.concat("lang", (F.col("doc_id") % 40).cast("string")), 256), 1, 20), F.lit(":")).alias("h"))
    b = d.select((F.col("doc_id") - 40).alias("src"), F.col("doc_id").alias("dst"), "source", F.col("h").alias("g"))
    return d.withColumnRenamed("doc_id", "src").join(b, ["src", "source"]).select("src", "dst", S.fuzzy_compare(F.col("h"), F.col("g")).alias("score"))


# --- compositions -------------------------------------------------------------------------------------


@query(f"""WITH {_BLAST}, det AS (SELECT tenant_id, artifact_id, CASE WHEN artifact_id % 50 = 7 THEN 'critical' ELSE 'low' END AS worst FROM artifact WHERE artifact_id % 10 = 7),
base AS (SELECT a.tenant_id, a.artifact_id, a.sha256, opinion, worst, matched_rules, coalesce(host_count, 0) AS host_count FROM artifact a LEFT JOIN rules USING (tenant_id, artifact_id) LEFT JOIN p USING (tenant_id, artifact_id) LEFT JOIN latest USING (tenant_id, artifact_id) LEFT JOIN det USING (tenant_id, artifact_id)),
lev AS (SELECT *, CASE WHEN worst = 'critical' THEN 'critical' WHEN opinion = 'malicious' THEN 'high' WHEN matched_rules IS NOT NULL THEN 'medium' WHEN opinion = 'grayware' THEN 'low' ELSE 'info' END AS b, (opinion = 'malicious') IS TRUE OR (worst = 'critical') IS TRUE OR matched_rules IS NOT NULL AS up FROM base)
SELECT tenant_id, artifact_id, sha256, CASE WHEN b = 'medium' AND host_count > 5 THEN 'high' ELSE b END AS level, CASE WHEN NOT up THEN 'monitor' WHEN host_count > 0 THEN 'block_hash,contain_hosts,detonate,set_opinion' ELSE 'block_hash,detonate,set_opinion' END AS actions,
CASE WHEN worst IS NOT NULL THEN 'T1027,T1486' ELSE '' END AS techniques, coalesce(matched_rules, '') AS matched_rules, host_count FROM lev""")
def investigation(spark, sf_dir):
    a = B.artifacts(spark, sf_dir)
    detection = a.where("artifact_id % 10 = 7").select(
        "tenant_id", "artifact_id", F.when(F.col("artifact_id") % 50 == 7, "critical").otherwise("low").alias("severity"), S.techniques(F.array(F.lit("ransom"), F.lit("packed"))).alias("mitre"))
    return reports.investigate(a, _matches(spark, sf_dir), B.occurrences(spark, sf_dir), B.opinions(spark, sf_dir), detection)


@query(f"""WITH {B.ARTIFACT}, {_SEEN} SELECT tenant_id, artifact_id, 'high' AS severity, 'intel' AS source FROM artifact WHERE (tenant_id, sha256) IN (SELECT tenant_id, value FROM seen WHERE ioc_type = 'sha256')""")
def continuous_intel(spark, sf_dir):
    triggers = spark.createDataFrame([], "tenant_id string, condition string, trigger_id string, url string, enabled boolean")
    found, _ = reports.continuous_intel(events.upsert_indicators(_seen(spark, sf_dir)), B.artifacts(spark, sf_dir), triggers)
    return found.select("tenant_id", "artifact_id", "severity", "source")


@query()
def function_coverage(spark, sf_dir):
    """Items of the benchmark as artifacts, their sentences as functions; not told in SQL, as the matching is greedy."""
    words = lambda s: F.array_sort(F.array_distinct(F.transform(F.filter(F.split(s, " "), lambda w: w != ""), S.token_hash)))
    one = B.table(spark, sf_dir, "benchmark").select(F.lit("t0").alias("tenant_id"), F.col("item_id").alias("artifact_id"), F.posexplode(F.split("text", r"[.,]")).alias("offset", "s"))
    functions = one.select("tenant_id", "artifact_id", F.col("offset").cast("long").alias("offset"), words(F.col("s")).alias("tokens")).where(F.size("tokens") > 0)
    return similarity.coverage(functions, similarity.function_candidates(functions))
