"""Registered queries over life cycles, views and pages, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.operators import analyst, graph
from stratalog.operators import lifecycle as L
from stratalog.plans.catalog import _EDGES, _STRONG, _WAYS, DAY, _attempts, _edges, _seeds, query
from stratalog.sources import bindings as B


#: Some artifacts are quarantined and some come from feeds, so that plan and watermark differ.
_STORED = """stored AS (SELECT tenant_id, artifact_id, seq, CASE WHEN artifact_id % 7 = 0 THEN 'uploading' ELSE 'committed' END AS storage_state, CASE WHEN artifact_id % 5 = 0 THEN 'intel' ELSE 'endpoint' END AS scope FROM artifact)"""
_HUNT = """hunt AS (SELECT source AS tenant_id, doc_id AS hunt_id, CASE WHEN doc_id % 6 = 5 THEN 'forward' ELSE 'retro' END AS kind, ['DRAFT', 'COMPLETED', 'RUNNING', 'FAILED', 'QUEUED', 'PLANNED', 'VALIDATING'][doc_id % 7 + 1] AS state,
CASE WHEN doc_id % 3 > 0 THEN doc_id // 2 END AS w, doc_id % 11 = 0 AS broken FROM documents)"""


def _hunts(spark, sf_dir):
    d = F.col("doc_id")
    states = F.array(*map(F.lit, ("DRAFT", "COMPLETED", "RUNNING", "FAILED", "QUEUED", "PLANNED", "VALIDATING")))
    return B.table(spark, sf_dir, "documents").select(
        F.col("source").alias("tenant_id"), d.alias("hunt_id"), F.when(d % 6 == 5, "forward").otherwise("retro").alias("kind"), F.get(states, (d % 7).cast("int")).alias("state"),
        F.when(d % 3 > 0, F.floor(d / 2)).cast("long").alias("watermark"))


@query(f"""WITH {B.ARTIFACT}, {_STORED}, {_HUNT}, checked AS (SELECT *, CASE WHEN kind <> 'retro' THEN 'kind' WHEN state IN ('RUNNING', 'QUEUED') THEN 'state' WHEN broken THEN 'compile' END AS error FROM hunt),
pinned AS (SELECT tenant_id, hunt_id, state, error, CASE WHEN error IS NULL THEN coalesce(w, (SELECT max(seq) FROM stored s WHERE s.tenant_id = c.tenant_id AND storage_state = 'committed'), 0) ELSE w END AS watermark FROM checked c)
SELECT tenant_id, hunt_id, watermark, CASE WHEN error IS NULL THEN (SELECT count(*) FROM stored s WHERE s.tenant_id = p.tenant_id AND storage_state = 'committed' AND scope = 'endpoint' AND seq <= watermark) END AS planned,
CASE WHEN error IS NULL THEN 'QUEUED' WHEN error = 'compile' THEN 'FAILED' ELSE state END AS state, error FROM pinned p""")
def hunt_enqueue(spark, sf_dir):
    """Hunts of every kind and state, one to a document; the bundles of some don't compile."""
    k, hunt = F.col("artifact_id"), _hunts(spark, sf_dir)
    stored = B.artifacts(spark, sf_dir).withColumns({"storage_state": F.when(k % 7 == 0, "uploading").otherwise("committed"), "scope": F.when(k % 5 == 0, "intel").otherwise("endpoint")})
    return L.enqueue(hunt, stored, hunt.where("hunt_id % 11 = 0")).select("tenant_id", "hunt_id", "watermark", "planned", "state", "error")


@query("""SELECT 't' || (user_id % 3) AS tenant_id, CAST(user_id AS VARCHAR) AS hunt_id, 100 AS planned, count(*) FILTER (event_id % 5 < 3) AS scanned, CAST(coalesce(sum(event_id % 3) FILTER (event_id % 5 < 3), 0) AS BIGINT) AS matched,
count(*) FILTER (event_id % 5 = 3) AS timed_out, count(*) FILTER (event_id % 5 = 4) AS failed FROM events GROUP BY 1, 2""")
def forward_counters(spark, sf_dir):
    e, k = B.table(spark, sf_dir, "events"), F.col("event_id") % 5
    key = [F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"), F.col("user_id").cast("string").alias("hunt_id")]
    hunt = e.select(*key).distinct().withColumns({c: F.lit(100 if c == "planned" else 0) for c in ("planned", "scanned", "matched", "timed_out", "failed")})
    outcome = e.select(*key, F.when(k == 0, "matched").when(k < 3, "clean").when(k == 3, "timeout").otherwise("error").alias("status"), (F.col("event_id") % 3).alias("n_rules"))
    return L.forward_counters(hunt, outcome)


@query(f"""WITH {_HUNT}, h AS (SELECT tenant_id, hunt_id, kind, state, 'b' || (hunt_id % 20) AS d, hunt_id * 7 % 1000 AS created_at FROM hunt), bundle AS (SELECT DISTINCT tenant_id, 'b' || b AS d FROM hunt, range(25) r(b)),
open AS (SELECT tenant_id, d, arg_max((hunt_id, state), (created_at, hunt_id)) AS x FROM h WHERE kind = 'retro' AND state IN ('QUEUED', 'RUNNING', 'VALIDATING', 'PLANNED', 'DRAFT') GROUP BY 1, 2)
SELECT tenant_id, d AS rule_bundle_digest, x[1] AS hunt_id, CASE WHEN x IS NULL THEN 'enqueued' ELSE 'reused' END AS status, x IS NULL OR x[2] = 'DRAFT' AS enqueue FROM bundle LEFT JOIN open USING (tenant_id, d)""")
def activation(spark, sf_dir):
    h = _hunts(spark, sf_dir).withColumns({"rule_bundle_digest": F.concat(F.lit("b"), (F.col("hunt_id") % 20).cast("string")), "created_at": F.col("hunt_id") * 7 % 1000})
    bundle = h.select("tenant_id").distinct().select("tenant_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda b: F.concat(F.lit("b"), b.cast("string")))).alias("rule_bundle_digest"))
    return L.activate(bundle, h)


@query(f"""WITH RECURSIVE {_EDGES}{_STRONG}, one_before AS (SELECT * FROM one WHERE src % 10 <> 1 AND dst % 10 <> 1),
old AS (SELECT DISTINCT tenant_id, unnest([src, dst]) AS artifact_id FROM one_before WHERE edge_type IN ('normalized_equivalent', 'semantic_variant_strong'))
SELECT g.tenant_id, g.artifact_id, g.group_id FROM grp g ANTI JOIN old USING (tenant_id, artifact_id) WHERE EXISTS (SELECT 1 FROM grp h SEMI JOIN old USING (tenant_id, artifact_id) WHERE h.tenant_id = g.tenant_id AND h.group_id = g.group_id)""")
def variant_join_events(spark, sf_dir):
    """Nodes whose id ends in 1 come later than the others."""
    e = _edges(spark, sf_dir)
    before = graph.variant_groups(e.where("src % 10 <> 1 AND dst % 10 <> 1"))
    return L.variant_joins(before, graph.variant_groups(e))


@query(f"""WITH {_EDGES}{_WAYS}, d0 AS (SELECT DISTINCT tenant_id, node FROM ways WHERE node = 7), d1 AS (SELECT DISTINCT w.tenant_id, w.other AS node FROM ways w JOIN d0 USING (tenant_id, node)), opened AS (SELECT * FROM d0 UNION SELECT * FROM d1)
SELECT tenant_id, src, dst, edge_type FROM one WHERE (tenant_id, src) IN (SELECT * FROM opened) OR (tenant_id, dst) IN (SELECT * FROM opened)""")
def neighborhood_edges(spark, sf_dir):
    e = _edges(spark, sf_dir)
    seeds = graph.both_ways(e).where("node = 7").select("tenant_id", F.col("node").alias("artifact_id")).distinct()
    return L.bounded_view(e, seeds, depth=2, most_nodes=100_000, most_edges=1_000_000)[1].select("tenant_id", "src", "dst", "edge_type")


@query(f"""WITH {_EDGES}{_WAYS}, d0 AS (SELECT DISTINCT tenant_id, node FROM ways WHERE node = 7), d1 AS (SELECT DISTINCT w.tenant_id, w.other AS node FROM ways w JOIN d0 USING (tenant_id, node) EXCEPT SELECT tenant_id, node FROM d0)
SELECT tenant_id, node, 0 AS depth FROM d0 UNION ALL SELECT tenant_id, node, 1 FROM d1 QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY node) <= 2""")
def neighborhood_capped(spark, sf_dir):
    """At most three nodes of a tenant: the seed and two neighbours."""
    e = _edges(spark, sf_dir)
    seeds = graph.both_ways(e).where("node = 7").select("tenant_id", F.col("node").alias("artifact_id")).distinct()
    return L.bounded_view(e, seeds, depth=1, most_nodes=3)[0]


@query(f"""WITH {B.ARTIFACT}, spec AS (SELECT source AS tenant_id, CASE doc_id % 3 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN upper(sha256(text)) ELSE 'nothing' END AS spec FROM documents)
SELECT s.tenant_id, s.spec, coalesce(a.artifact_id, b.artifact_id) AS artifact_id FROM spec s LEFT JOIN artifact a ON a.tenant_id = s.tenant_id AND CAST(a.artifact_id AS VARCHAR) = spec LEFT JOIN artifact b ON b.tenant_id = s.tenant_id AND b.sha256 = lower(spec)""")
def seed_resolve(spark, sf_dir):
    k = F.col("doc_id") % 3
    spec = B.table(spark, sf_dir, "documents").select(F.col("source").alias("tenant_id"), F.when(k == 0, F.col("doc_id").cast("string")).when(k == 1, F.upper(F.sha2("text", 256))).otherwise("nothing").alias("spec"))
    return L.resolve_seed(spec, B.artifacts(spark, sf_dir))


_KINSHIP = """tie AS (SELECT tenant_id, artifact_id, min(artifact_id) OVER (PARTITION BY tenant_id, size_bytes) AS group_id, count(*) OVER (PARTITION BY tenant_id, size_bytes) AS n FROM artifact),
kin AS (SELECT tenant_id, artifact_id, group_id FROM tie WHERE n > 1)"""


def _kin(spark, sf_dir):
    """Artifacts of one size as groups."""
    a = B.artifacts(spark, sf_dir)
    g = a.groupBy("tenant_id", "size_bytes").agg(F.min("artifact_id").alias("group_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return a, a.join(g, ["tenant_id", "size_bytes"]).select("tenant_id", "artifact_id", "group_id")


@query(f"""WITH {B.ARTIFACT}, {_KINSHIP} SELECT tenant_id, artifact_id, group_id, sha256, artifact_class FROM kin JOIN artifact USING (tenant_id, artifact_id) WHERE (tenant_id, group_id) IN (SELECT tenant_id, group_id FROM kin JOIN artifact USING (tenant_id, artifact_id) WHERE artifact_class = 'de')""")
def variants_view(spark, sf_dir):
    a, kin = _kin(spark, sf_dir)
    return L.variants_view(kin, a.where("artifact_class = 'de'").select("tenant_id", "artifact_id"), a).select("tenant_id", "artifact_id", "group_id", "sha256", "artifact_class")


@query(f"""WITH {B.OCCURRENCE}, {_KINSHIP}, m AS (SELECT tenant_id, artifact_id FROM artifact WHERE artifact_class = 'de') SELECT k.tenant_id, k.artifact_id, k.group_id, count(o.artifact_id) AS occurrences, count(DISTINCT o.host_name) AS hosts
FROM kin k LEFT JOIN occurrence o ON o.tenant_id = k.tenant_id AND o.artifact_id = k.artifact_id WHERE (k.tenant_id, k.group_id) IN (SELECT tenant_id, group_id FROM kin JOIN m USING (tenant_id, artifact_id)) AND (k.tenant_id, k.artifact_id) NOT IN (SELECT * FROM m) GROUP BY 1, 2, 3""")
def variant_expansion(spark, sf_dir):
    a, kin = _kin(spark, sf_dir)
    return L.expansion(kin, a.where("artifact_class = 'de'").select("tenant_id", "artifact_id"), B.occurrences(spark, sf_dir))


_GONE = "gone AS (SELECT DISTINCT tenant_id, node AS artifact_id FROM ways WHERE node % 4 = 1), held AS (SELECT tenant_id, artifact_id FROM gone WHERE artifact_id % 8 = 1), free AS (SELECT * FROM gone EXCEPT SELECT * FROM held)"
_DERIVED = "feature AS (SELECT 't' || (l_partkey % 3) AS tenant_id, l_partkey AS artifact_id FROM lineitem), func AS (SELECT 't' || (l_partkey % 3) AS tenant_id, l_suppkey AS artifact_id FROM lineitem)"


def _cleaned(spark, sf_dir):
    e, l, t = _edges(spark, sf_dir), B.table(spark, sf_dir, "lineitem"), F.concat(F.lit("t"), (F.col("l_partkey") % 3).cast("string")).alias("tenant_id")
    gone = graph.both_ways(e).where("node % 4 = 1").select("tenant_id", F.col("node").alias("artifact_id")).distinct()
    return L.cleanup(gone, features=l.select(t, F.col("l_partkey").alias("artifact_id")), functions=l.select(t, F.col("l_suppkey").alias("artifact_id")), edges=e, groups=graph.variant_groups(e), held=gone.where("artifact_id % 8 = 1"))


@query(f"""WITH RECURSIVE {_EDGES}{_STRONG}{_WAYS}, {_GONE}, {_DERIVED}, ends AS (SELECT tenant_id, src AS artifact_id FROM one UNION ALL SELECT tenant_id, dst FROM one),
n AS (SELECT tenant_id, artifact_id, 'a' AS k FROM feature UNION ALL SELECT tenant_id, artifact_id, 'b' FROM func UNION ALL SELECT tenant_id, artifact_id, 'c' FROM ends UNION ALL SELECT tenant_id, artifact_id, 'd' FROM grp)
SELECT g.tenant_id, g.artifact_id, (g.tenant_id, g.artifact_id) IN (SELECT * FROM held) AS legal_hold, (g.tenant_id, g.artifact_id) IN (SELECT * FROM held) AS dry_run,
count(*) FILTER (k = 'a') AS features, count(*) FILTER (k = 'b') AS functions, count(*) FILTER (k = 'c') AS edges, count(*) FILTER (k = 'd') AS group_memberships FROM gone g LEFT JOIN n USING (tenant_id, artifact_id) GROUP BY 1, 2""")
def cleanup_families(spark, sf_dir):
    return _cleaned(spark, sf_dir)[0]


@query(f"""WITH RECURSIVE {_EDGES}{_STRONG}{_WAYS}, {_GONE} SELECT tenant_id, group_id, CASE WHEN count(*) FILTER ((tenant_id, artifact_id) NOT IN (SELECT * FROM free)) <= 1 THEN 'removed' ELSE 'repaired' END AS outcome
FROM grp WHERE (tenant_id, group_id) IN (SELECT tenant_id, group_id FROM grp SEMI JOIN free USING (tenant_id, artifact_id)) GROUP BY 1, 2""")
def cleanup_dissolved(spark, sf_dir):
    return _cleaned(spark, sf_dir)[1]


@query("SELECT sha256(html) AS sha256, min(page_id) AS page_id FROM pages WHERE page_id % 3 <> 0 AND sha256(html) NOT IN (SELECT sha256(html) FROM pages WHERE page_id % 3 = 0) GROUP BY 1")
def put_if_absent(spark, sf_dir):
    p = B.table(spark, sf_dir, "pages").select(F.sha2("html", 256).alias("sha256"), "page_id")
    first = p.where("page_id % 3 <> 0").groupBy("sha256").agg(F.min("page_id").alias("page_id"))
    return L.put_absent(first, p.where("page_id % 3 = 0"))


@query("""SELECT 't0' AS tenant_id, l_orderkey AS artifact_id, CASE WHEN n = 7 THEN 'new' ELSE 'old' || l_linenumber END AS band FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE n <> 7 OR l_linenumber = 7""")
def index_replace(spark, sf_dir):
    index = B.table(spark, sf_dir, "lineitem").select(F.lit("t0").alias("tenant_id"), F.col("l_orderkey").alias("artifact_id"), F.concat(F.lit("old"), F.col("l_linenumber").cast("string")).alias("band"))
    fresh = B.table(spark, sf_dir, "lineitem").where("l_linenumber = 7").select(F.lit("t0").alias("tenant_id"), F.col("l_orderkey").alias("artifact_id"), F.lit("new").alias("band"))
    return L.replace_index(index, fresh)


@query("SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS batch, arg_min(CAST(user_id AS VARCHAR), (ts, event_id)) OVER (PARTITION BY CAST(ts AS DATE)) AS host_name FROM events")
def gap_append(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").select("event_id", F.to_date("ts").cast("string").alias("batch"), F.col("user_id").cast("string").alias("host_name"), "ts")
    return L.append_gaps(e, ["batch"], ["ts", "event_id"]).drop("ts")


@query("""SELECT page_id, CASE WHEN c NOT IN ('hunt_match', 'malicious_verdict', 'variant_join') THEN 'condition' WHEN NOT (starts_with(u, 'http://') OR starts_with(u, 'https://')) THEN 'url' END AS error
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'ftp://x/' WHEN 1 THEN 'http:///x' WHEN 2 THEN upper(url) ELSE url END AS u, ['hunt_match', 'malicious_verdict', 'variant_join', 'intel_match'][page_id % 4 + 1] AS c FROM pages)""")
def trigger_checks(spark, sf_dir):
    k = F.col("page_id")
    condition = F.get(F.array(*map(F.lit, ("hunt_match", "malicious_verdict", "variant_join", "intel_match"))), (k % 4).cast("int"))
    t = B.table(spark, sf_dir, "pages").select("page_id", F.when(k % 5 == 0, "ftp://x/").when(k % 5 == 1, "http:///x").when(k % 5 == 2, F.upper("url")).otherwise(F.col("url")).alias("url"), condition.alias("condition"))
    return L.checked_triggers(t).select("page_id", "error")


@query("SELECT event_id, event_type, epoch_us(ts) AS at FROM events ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 1000")
def newest_detections(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").select("event_id", "event_type", B.micros("ts").alias("at"))
    return L.newest(e, "at", F.desc("event_id"), limit=5_000)


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 50 OFFSET 100")
def rule_page(spark, sf_dir):
    return L.page(B.table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 100, 50)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 5")
def top_findings(spark, sf_dir):
    return L.top_ranked(B.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 5)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity >= 5 AND l_returnflag <> 'A'")
def significant_functions(spark, sf_dir):
    f = B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("insns"), (F.col("l_returnflag") == "A").alias("is_thunk"))
    return L.significant(f).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT page_id, url AS path, 1000 + page_id % 7 AS observed_at, 5000 AS received_at FROM pages")
def snapshot_backfill(spark, sf_dir):
    p = B.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    return L.backdated(p, 1000 + F.col("page_id") % 7, F.lit(5000))


@query("""SELECT page_id, split_part(ltrim(replace(url, 'https:/', ''), '/'), '/', 1) AS top FROM (SELECT page_id, replace(url, 'http:/', '') AS url FROM pages)
WHERE split_part(ltrim(replace(url, 'https:/', ''), '/'), '/', 1) NOT IN (SELECT split_part(ltrim(replace(replace(url, 'http:/', ''), 'https:/', ''), '/'), '/', 1) FROM pages WHERE page_id % 50 = 0)""")
def walk_resume(spark, sf_dir):
    p = B.table(spark, sf_dir, "pages").select("page_id", F.replace(F.replace("url", F.lit("http:/"), F.lit("")), F.lit("https:/"), F.lit("")).alias("path"))
    done = p.where("page_id % 50 = 0").select(F.split_part(F.ltrim(F.col("path"), F.lit("/")), F.lit("/"), F.lit(1)).alias("top"))
    return L.still_to_walk(p, done).select("page_id", "top")


@query(f"""WITH {B.OCCURRENCE}, {B.OPINION}, seeds AS (SELECT DISTINCT tenant_id, artifact_id FROM opinion WHERE opinion = 'malicious'),
s AS (SELECT DISTINCT o.tenant_id, o.host_name, o.observed_at FROM occurrence o SEMI JOIN seeds USING (tenant_id, artifact_id)),
f AS (SELECT tenant_id, artifact_id, host_name, min(observed_at) AS observed_at FROM occurrence o ANTI JOIN seeds USING (tenant_id, artifact_id) GROUP BY 1, 2, 3),
c AS (SELECT f.tenant_id, f.artifact_id, min(abs(f.observed_at - s.observed_at)) AS d FROM f JOIN s ON s.tenant_id = f.tenant_id AND s.host_name = f.host_name AND abs(f.observed_at - s.observed_at) <= {DAY} GROUP BY ALL)
SELECT tenant_id, artifact_id, d FROM c ORDER BY d, tenant_id, artifact_id LIMIT 200""")
def dropper_nearest(spark, sf_dir):
    """The nearest 200 before any filter on how widespread they are."""
    found = analyst.dropper_candidates(B.occurrences(spark, sf_dir), _seeds(spark, sf_dir), window_us=DAY, max_hosts=2**31, limit=None)
    return _nearest(spark, sf_dir, found)


def _nearest(spark, sf_dir, found):
    occ, seeds = B.occurrences(spark, sf_dir), _seeds(spark, sf_dir)
    s = occ.join(seeds, L.KEY, "left_semi").select("tenant_id", "host_name", F.col("observed_at").alias("at")).distinct()
    first = occ.join(found.select(*L.KEY, "host_name"), [*L.KEY, "host_name"], "left_semi").groupBy(*L.KEY, "host_name").agg(F.min("observed_at").alias("observed_at"))
    near = first.join(s, ["tenant_id", "host_name"]).withColumn("d", F.abs(F.col("observed_at") - F.col("at"))).where(F.col("d") <= DAY)
    return near.groupBy(*L.KEY).agg(F.min("d").alias("d")).orderBy("d", *L.KEY).limit(200)


@query("""SELECT (SELECT count(*) FROM events WHERE event_id % 4 = 1) AS depth, (SELECT min(epoch_us(ts)) FROM events WHERE event_id % 4 = 1) AS oldest_pending""")
def queue_depth(spark, sf_dir):
    pending = _attempts(spark, sf_dir).where("event_id % 4 = 1")
    return pending.agg(F.count("*").alias("depth"), F.min("observed_at").alias("oldest_pending"))


# --- metrics and opinions ----------------------------------------------------------------


@query(f"""WITH {B.OCCURRENCE}, {_STORED}, {_HUNT}, agent AS (SELECT DISTINCT tenant_id, host_name FROM occurrence), bundle AS (SELECT DISTINCT tenant_id, hunt_id % 20 AS d FROM hunt),
u AS (SELECT tenant_id, 'a' AS w FROM stored WHERE storage_state = 'committed' UNION ALL SELECT tenant_id, 'b' FROM occurrence UNION ALL SELECT tenant_id, 'c' FROM hunt UNION ALL SELECT tenant_id, 'd' FROM hunt WHERE state IN ('QUEUED', 'RUNNING', 'VALIDATING', 'PLANNED')
UNION ALL SELECT tenant_id, 'e' FROM hunt WHERE hunt_id % 4 = 1 AND hunt_id % 3 <> 0 UNION ALL SELECT tenant_id, 'f' FROM artifact WHERE artifact_id % 10 = 7 UNION ALL SELECT tenant_id, 'g' FROM bundle WHERE d % 3 > 0 UNION ALL SELECT tenant_id, 'h' FROM agent UNION ALL SELECT tenant_id, 'i' FROM bundle)
SELECT tenant_id, grouping(tenant_id) = 1 AS everything, count(*) FILTER (w = 'a') AS artifacts, count(*) FILTER (w = 'b') AS occurrences, count(*) FILTER (w = 'c') AS hunts_total, count(*) FILTER (w = 'd') AS hunts_active, count(*) FILTER (w = 'e') AS jobs,
count(*) FILTER (w = 'f') AS detections, count(*) FILTER (w = 'g') AS bundles, count(*) FILTER (w = 'h') AS agents, count(*) FILTER (w = 'i') AS continuous FROM u GROUP BY ROLLUP (tenant_id)""")
def platform_metrics(spark, sf_dir):
    k, hunt, occurrence = F.col("artifact_id"), _hunts(spark, sf_dir), B.occurrences(spark, sf_dir)
    artifact = B.artifacts(spark, sf_dir).withColumn("storage_state", F.when(k % 7 == 0, "uploading").otherwise("committed"))
    bundle = hunt.select("tenant_id", (F.col("hunt_id") % 20).alias("d")).distinct().withColumn("active", F.col("d") % 3 > 0)
    job = hunt.where("hunt_id % 4 = 1").select("hunt_id", F.when(F.col("hunt_id") % 3 == 0, F.lit(1)).alias("finished_at"))
    return analyst.platform_metrics(
        artifact=artifact, occurrence=occurrence, hunt=hunt, job=job, detection=artifact.where(k % 10 == 7), bundle=bundle, agent=occurrence.select("tenant_id", "host_name").distinct(), continuous=bundle)


_ASKED = """asked AS (SELECT tenant_id, artifact_id, 1000000 + artifact_id AS opinion_id, lower(['Malicious', 'trusted', 'SUSPICIOUS', 'unheard', 'grayware'][artifact_id % 5 + 1]) AS opinion, 'a' || (artifact_id % 3) AS actor, 'r' || artifact_id AS reason, 2000000 + artifact_id AS created_at FROM artifact),
taken AS (SELECT * FROM asked WHERE opinion IN ('trusted', 'grayware', 'vulnerable', 'malicious', 'suspicious'))"""


def _asked(spark, sf_dir):
    a = F.col("artifact_id")
    opinion = F.get(F.array(*map(F.lit, ("Malicious", "trusted", "SUSPICIOUS", "unheard", "grayware"))), (a % 5).cast("int"))
    request = B.artifacts(spark, sf_dir).select("tenant_id", "artifact_id", (1_000_000 + a).alias("opinion_id"), opinion.alias("opinion"), F.concat(F.lit("a"), (a % 3).cast("string")).alias("actor"), F.concat(F.lit("r"), a.cast("string")).alias("reason"), (2_000_000 + a).alias("created_at"))
    return analyst.set_opinions(B.opinions(spark, sf_dir), request)


@query(f"""WITH {B.ARTIFACT}, {B.OPINION}, {_ASKED}, every AS (SELECT tenant_id, artifact_id, opinion_id, opinion, created_at FROM opinion UNION ALL SELECT tenant_id, artifact_id, opinion_id, opinion, created_at FROM taken)
SELECT tenant_id, artifact_id, opinion_id, opinion, lead(opinion_id) OVER (PARTITION BY tenant_id, artifact_id ORDER BY created_at, opinion_id) AS superseded_by FROM every""")
def opinion_set(spark, sf_dir):
    return _asked(spark, sf_dir)[0].select("tenant_id", "artifact_id", "opinion_id", "opinion", "superseded_by")


@query(f"""WITH {B.ARTIFACT}, {B.OPINION}, {_ASKED} SELECT tenant_id, 'audit' AS kind, CAST(artifact_id AS VARCHAR) AS target, actor, json_object('opinion', opinion, 'reason', reason, 'opinion_id', opinion_id)::VARCHAR AS body FROM taken
UNION ALL SELECT tenant_id, 'malicious_verdict', NULL, NULL, json_object('type', 'malicious_verdict', 'artifact_id', artifact_id, 'opinion', opinion, 'actor', actor, 'reason', reason)::VARCHAR FROM taken WHERE opinion IN ('malicious', 'suspicious')
UNION ALL SELECT tenant_id, 'refused', CAST(artifact_id AS VARCHAR), actor, opinion FROM asked WHERE opinion_id NOT IN (SELECT opinion_id FROM taken)""")
def opinion_effects(spark, sf_dir):
    """What setting opinions writes beside them: audit rows, trigger events, refusals."""
    _, audit, fired, refused = _asked(spark, sf_dir)
    none = F.lit(None).cast("string")
    return audit.select("tenant_id", F.lit("audit").alias("kind"), "target", "actor", F.col("detail").alias("body")).unionByName(
        fired.select("tenant_id", F.col("condition").alias("kind"), none.alias("target"), none.alias("actor"), F.col("payload").alias("body"))).unionByName(
        refused.select("tenant_id", F.lit("refused").alias("kind"), F.col("artifact_id").cast("string").alias("target"), "actor", F.col("opinion").alias("body")))
