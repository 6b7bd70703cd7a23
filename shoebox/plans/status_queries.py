"""Counts, coverage and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoebox.operators import embedding_state as E, status as R
from shoebox.plans.registry import at, query, text_time
from shoebox.plans.queue_queries import NOW, NOW_SQL


@query("visibility_histogram", "SELECT visibility_status, count(*) AS n FROM source_rows GROUP BY ALL")
def visibility_histogram(source_rows):
    return R.histogram(source_rows, "visibility_status")


@query("latest_source_update", "SELECT strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') AS updated_at FROM source_rows WHERE source_key = 'src0' AND duration IS NOT NULL")
def latest_source_update(source_rows):
    return source_rows.where("source_key = 'src0' AND duration IS NOT NULL").agg(text_time(F.max("updated_at")).alias("updated_at"))


@query("job_counts", f"SELECT count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'queued' AND scheduled_at <= {NOW_SQL}) AS eligible, strftime(min(CASE WHEN status = 'queued' AND scheduled_at > {NOW_SQL} THEN scheduled_at END), '%Y-%m-%d %H:%M:%S') AS next_eligible_at FROM jobs")
def job_counts(jobs):
    return R.job_counts(jobs, at(NOW)).withColumn("next_eligible_at", text_time("next_eligible_at"))


@query("root_counts", """WITH l AS (SELECT source_key, root_key, count(*) AS locations, count(*) FILTER (WHERE status = 'active') AS locations_active, count(*) FILTER (WHERE status = 'discovered') AS locations_discovered, count(*) FILTER (WHERE status = 'missing') AS locations_missing, count(*) FILTER (WHERE status = 'permission_blocked') AS locations_permission_blocked, count(DISTINCT asset_id) AS assets FROM locations GROUP BY ALL),
  j AS (SELECT source_key, root_key, count(*) FILTER (WHERE kind = 'metadata' AND status = 'queued') AS metadata_queued, count(*) FILTER (WHERE kind = 'metadata' AND status = 'running') AS metadata_running, count(*) FILTER (WHERE kind = 'metadata' AND status = 'failed') AS metadata_failed, count(*) FILTER (WHERE kind = 'thumbnail' AND status = 'queued') AS thumbnail_queued, count(*) FILTER (WHERE kind = 'thumbnail' AND status = 'running') AS thumbnail_running, count(*) FILTER (WHERE kind = 'thumbnail' AND status = 'failed') AS thumbnail_failed FROM jobs GROUP BY ALL)
  SELECT l.*, coalesce(metadata_queued, 0) AS metadata_queued, coalesce(metadata_running, 0) AS metadata_running, coalesce(metadata_failed, 0) AS metadata_failed, coalesce(thumbnail_queued, 0) AS thumbnail_queued, coalesce(thumbnail_running, 0) AS thumbnail_running, coalesce(thumbnail_failed, 0) AS thumbnail_failed FROM l LEFT JOIN j ON l.source_key = j.source_key AND l.root_key = j.root_key""")
def root_counts(locations, jobs):
    return R.root_counts(locations, jobs)


@query("processing_stats", "SELECT 'catalog' AS stage, visibility_status AS status, count(*) AS n FROM source_rows GROUP BY ALL UNION ALL SELECT 'locations', status, count(*) FROM locations GROUP BY ALL UNION ALL SELECT 'jobs', kind || '_' || status, count(*) FROM jobs GROUP BY ALL UNION ALL SELECT 'vectors', status, count(*) FROM vectors GROUP BY ALL")
def processing_stats(source_rows, locations, jobs, vectors):
    s = F.col("status")
    return R.processing_stats({"catalog": (source_rows, F.col("visibility_status")), "locations": (locations, s), "jobs": (jobs, F.concat_ws("_", "kind", "status")), "vectors": (vectors, s)})


def thumbnails(source_rows):
    i = F.col("upstream_asset_id").cast("bigint")
    return source_rows.select("source_key", F.col("upstream_asset_id").alias("asset_id"), F.when(i % 3 == 0, "failed").otherwise("ready").alias("status"))


@query("coverage", """WITH c AS (SELECT source_key, count(*) AS n, count(*) FILTER (WHERE visibility_status <> 'active') AS issues, count(*) FILTER (WHERE CAST(upstream_asset_id AS BIGINT) % 3 > 0) AS browsable FROM source_rows GROUP BY 1), f AS (SELECT 'src' || CAST(id % 4 AS VARCHAR) AS source_key, count(*) AS files FROM locations WHERE id % 9 = 0 GROUP BY 1),
  v AS (SELECT s.source_key, count(*) AS searchable FROM source_rows s JOIN (SELECT DISTINCT asset_id FROM vectors WHERE status = 'ready' AND source_key = 'src0') x ON x.asset_id = s.upstream_asset_id WHERE s.source_key = 'src0' GROUP BY 1)
  SELECT c.source_key, greatest(c.n, coalesce(files, 0)) AS found, browsable, coalesce(searchable, 0) AS searchable, issues FROM c LEFT JOIN f ON c.source_key = f.source_key LEFT JOIN v ON v.source_key = c.source_key""")
def coverage(source_rows, locations, vectors):
    files = locations.where("id % 9 = 0").select(F.concat(F.lit("src"), (F.col("id") % 4).cast("string")).alias("source_key"))
    return R.coverage(source_rows, files, thumbnails(source_rows), vectors.where("source_key = 'src0'"))


@query("over_sources", "WITH s AS (SELECT source_key, count(*) FILTER (WHERE status = 'ready') AS indexed, max(captured_at) AS built_at, CASE WHEN count(*) % 2 = 0 THEN 'ready' ELSE 'building' END AS status FROM vectors GROUP BY source_key) SELECT CAST(sum(indexed) AS BIGINT) AS indexed, strftime(max(built_at), '%Y-%m-%d %H:%M:%S') AS built_at, bool_and(status = 'ready') AS all_ready, bool_or(status = 'ready') AS any_ready, CASE WHEN bool_and(status = 'ready') THEN 'ready' WHEN bool_or(status = 'ready') THEN 'partial' ELSE 'missing' END AS status FROM s")
def over_sources(vectors):
    states = vectors.groupBy("source_key").agg(F.count_if(F.col("status") == "ready").alias("indexed"), F.max("captured_at").alias("built_at"), F.when(F.count("*") % 2 == 0, "ready").otherwise("building").alias("status"))
    return R.over_sources(states).withColumn("built_at", text_time("built_at"))


@query("profile_vectors", "WITH i AS (SELECT DISTINCT source_key, model_id FROM vectors UNION SELECT 'src9', 'model0') SELECT i.source_key, i.model_id, count(v.asset_id) AS vectors FROM i LEFT JOIN vectors v ON v.source_key = i.source_key AND v.model_id = i.model_id AND v.status = 'ready' GROUP BY ALL")
def profile_vectors(vectors):
    ids = vectors.select("source_key", "model_id").union(vectors.sparkSession.sql("SELECT 'src9', 'model0'")).distinct()
    return R.profiles(ids, vectors)


@query("edge_counts", "SELECT p.p_partkey AS ordinal, count(l.l_suppkey) AS edges FROM part p LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) l ON l.l_partkey = p.p_partkey GROUP BY 1")
def edge_counts(part, lineitem):
    edges = lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("ordinal"), F.col("l_suppkey").alias("neighbor"))
    return R.edge_counts(part.select(F.col("p_partkey").alias("ordinal")), edges)


@query("failure_report", "SELECT j.location_id, min(l.root_key) AS root_key, min(l.relative_path) AS relative_path, string_agg(DISTINCT j.kind, '+' ORDER BY j.kind) AS kinds, max(attempts) AS attempts FROM jobs j LEFT JOIN locations l ON l.id = j.location_id WHERE j.status = 'failed' GROUP BY 1")
def failure_report(jobs, locations):
    return R.failures(jobs, locations)


@query("due_runs", "WITH r AS (SELECT event_id AS id, 'root' || CAST(user_id AS VARCHAR) AS root_key, CASE WHEN event_type = 'click' THEN 'completed' ELSE 'running' END AS status, ts AS completed_at, event_id % 11 = 0 AS err FROM events), d AS (SELECT root_key, max_by(id, (completed_at, id)) AS run_id, max_by(err, (completed_at, id)) AS err, max(completed_at) AS last_at FROM r WHERE status = 'completed' GROUP BY 1) SELECT k.root_key, run_id, run_id IS NULL OR err OR last_at <= TIMESTAMP '2024-01-21' - INTERVAL 86400 SECOND AS due FROM (SELECT DISTINCT root_key FROM r) k LEFT JOIN d ON d.root_key = k.root_key")
def due_runs(events):
    counts = F.when(F.col("event_id") % 11 == 0, '{"read_error":2}').otherwise('{"hidden":1}')
    runs = events.select(F.col("event_id").alias("id"), F.concat(F.lit("root"), F.col("user_id").cast("string")).alias("root_key"), F.when(F.col("event_type") == "click", "completed").otherwise("running").alias("status"), F.col("ts").alias("completed_at"), counts.alias("skip_counts_json"))
    return R.latest_runs(runs, at(NOW), 86400)


@query("consistency_issues", """WITH v AS (SELECT source_key, model_id, status, CASE WHEN id % 13 = 0 THEN NULL WHEN id % 17 = 0 THEN list_slice(vector, 1, 60) ELSE vector END AS vector FROM vectors), r AS (SELECT * FROM v WHERE status = 'ready'), s AS (SELECT source_key, model_id, count(*) AS indexed FROM v WHERE status <> 'failed' GROUP BY ALL)
  SELECT source_key, model_id, 'wrong_dimension' AS issue, count(*) AS n FROM r WHERE len(vector) <> 64 GROUP BY ALL UNION ALL SELECT source_key, model_id, 'payload_missing', count(*) FROM r WHERE vector IS NULL GROUP BY ALL
  UNION ALL SELECT s.source_key, s.model_id, 'count_mismatch', abs(indexed - count(r.status)) FROM s LEFT JOIN r ON r.source_key = s.source_key AND r.model_id = s.model_id GROUP BY s.source_key, s.model_id, indexed HAVING indexed <> count(r.status)""")
def consistency_issues(vectors):
    v = vectors.withColumn("vector", F.when(F.col("id") % 13 > 0, F.when(F.col("id") % 17 == 0, F.slice("vector", 1, 60)).otherwise(F.col("vector"))))
    states = v.where("status <> 'failed'").groupBy("source_key", "model_id").agg(F.count("*").alias("indexed"))
    return R.consistency_issues(v, states, 64)


# The state of embeddings.

ELIGIBLE = "(SELECT source_key, asset_id, captured_at, id FROM vectors WHERE id % 10 < 9)"


def eligible(vectors):
    return vectors.where("id % 10 < 9").select("source_key", "asset_id", "captured_at")


def stored(vectors):
    return vectors.where("id % 3 > 0")


@query("embedding_progress", f"SELECT e.source_key, count(*) AS eligible, count(*) FILTER (WHERE v.status = 'ready') AS completed, count(*) FILTER (WHERE v.status = 'failed') AS failed FROM {ELIGIBLE} e LEFT JOIN vectors v ON v.source_key = e.source_key AND v.asset_id = e.asset_id AND v.model_id = 'model1' GROUP BY 1")
def embedding_progress(vectors):
    return E.progress(eligible(vectors), vectors, "model1")


PROFILED = "(SELECT *, CASE WHEN id % 9 = 0 THEN 'old' ELSE 'space' END AS vector_space_id, CASE WHEN id % 13 = 0 THEN 32 ELSE 64 END AS embedding_dim, CASE WHEN id % 5 > 0 THEN captured_at END AS generated_at FROM vectors WHERE id % 8 > 0)"


@query("assets_to_embed", f"SELECT e.source_key, e.asset_id, v.status AS vector_status, CASE WHEN v.status = 'failed' THEN 1 ELSE 0 END AS late FROM {ELIGIBLE} e LEFT JOIN {PROFILED} v ON v.source_key = e.source_key AND v.asset_id = e.asset_id AND v.model_id = 'model1' WHERE v.asset_id IS NULL OR v.vector_space_id <> 'space' OR v.embedding_dim <> 64 OR v.status NOT IN ('ready', 'failed') OR v.status = 'failed' AND (v.generated_at IS NULL OR v.generated_at <= TIMESTAMP '2024-01-01 01:00:00' OR e.id % 20 = 7) ORDER BY late, e.captured_at DESC, e.source_key, e.asset_id LIMIT 1280")
def assets_to_embed(vectors):
    i = F.col("id")
    own = vectors.where("id % 8 > 0").withColumns({"vector_space_id": F.when(i % 9 == 0, "old").otherwise("space"), "embedding_dim": F.when(i % 13 == 0, 32).otherwise(64), "generated_at": F.when(i % 5 > 0, F.col("captured_at"))})
    profile = {"model_id": "model1", "vector_space_id": "space", "embedding_dim": 64}
    return E.to_embed(eligible(vectors), own, vectors.where("id % 20 = 7"), profile, at(3600), 1280)


@query("stale_inputs", "SELECT i.asset_id, CASE WHEN i.id % 12 = 0 THEN 'wait' WHEN i.id % 3 = 0 THEN 'embed' WHEN i.id % 5 = 0 THEN 'embed_again' WHEN i.status = 'failed' AND i.id % 2 = 0 THEN 'retry' WHEN i.status = 'failed' THEN 'failed' ELSE 'ready' END AS todo FROM vectors i")
def stale_inputs(vectors):
    i = F.col("id")
    inputs = vectors.select("asset_id", F.when(i % 12 == 0, "").otherwise(F.sha2("asset_id", 256)).alias("fingerprint"))
    known = vectors.select("asset_id", F.when(i % 5 > 0, F.sha2("asset_id", 256)).alias("fingerprint"))
    return E.stale_inputs(inputs, stored(vectors), known, vectors.where("id % 2 = 0").select("asset_id"))


STATE = "(SELECT event_id AS id, event_id % 7 AS eligible, event_id % 5 AS completed, event_id % 3 AS failed, event_id % 6 AS indexed, event_id % 4 AS ag, event_id % 2 AS ig, event_id % 11 = 0 AS part, event_id % 13 = 0 AS fits FROM events)"
DONE = "(completed >= eligible OR failed >= eligible - greatest(completed, 0))"


@query("publish_decisions", f"SELECT id, CASE WHEN ag <> ig THEN CASE WHEN completed = 0 THEN {DONE} ELSE part OR {DONE} END WHEN indexed >= completed THEN NOT fits ELSE part OR {DONE} END AS publish, CASE WHEN indexed <= 0 THEN 1 ELSE greatest(CAST(ceil(indexed / 5.0) AS BIGINT), 1) END AS threshold, CASE WHEN completed = 0 AND eligible > 0 THEN 'pending' WHEN completed < eligible THEN 'backfilling' WHEN ag <> ig OR indexed < completed OR failed > 0 THEN 'indexing' ELSE 'ready' END AS status FROM {STATE}")
def publish_decisions(events):
    i = F.col("event_id")
    s = {"eligible": i % 7, "completed": i % 5, "failed": i % 3, "indexed": i % 6, "asset_generation": i % 4, "indexed_generation": i % 2}
    publish = E.publish_needed(s, i % 11 == 0, i % 13 == 0)
    status = E.backfill_status(s["eligible"], s["completed"], s["indexed"], s["asset_generation"] != s["indexed_generation"], F.lit(0), s["failed"])
    return events.select(i.alias("id"), publish.alias("publish"), E.partial_threshold(s["indexed"]).alias("threshold"), status.alias("status"))


@query("vector_upsert", "SELECT coalesce(o.asset_id, n.asset_id) AS asset_id, CASE WHEN n.asset_id IS NOT NULL THEN 'ready' ELSE o.status END AS status, coalesce(o.id % 3, 0) AS indexed_generation, round((CASE WHEN n.asset_id IS NOT NULL THEN n.vector ELSE o.vector END)[1]::DOUBLE, 5) AS x FROM (SELECT * FROM vectors WHERE id % 4 > 0) o FULL JOIN (SELECT * FROM vectors WHERE id % 2 = 0) n ON o.asset_id = n.asset_id AND o.source_key = n.source_key AND o.model_id = n.model_id")
def vector_upsert(vectors):
    old = vectors.where("id % 4 > 0").withColumn("indexed_generation", F.col("id") % 3)
    new = vectors.where("id % 2 = 0").withColumn("status", F.lit("ready"))
    return E.upserted(old, new).select("asset_id", "status", "indexed_generation", F.round(F.get("vector", F.lit(0)).cast("double"), 5).alias("x"))


@query("guarded_publish", "SELECT 'src' || CAST(c_custkey AS VARCHAR) AS source_key, c_custkey % 5 AS asset_generation, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 = c_custkey % 3 THEN c_custkey % 3 ELSE 0 END AS indexed_generation, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 = c_custkey % 3 THEN 100 ELSE 50 END AS indexed FROM customer")
def guarded_publish(customer):
    k = F.col("c_custkey")
    key = F.concat(F.lit("src"), k.cast("string")).alias("source_key")
    states = customer.select(key, (k % 5).alias("asset_generation"), F.lit(0).cast("bigint").alias("indexed_generation"), F.lit(50).alias("indexed"))
    return E.published(states, customer.where("c_custkey % 2 = 0").select(key, (k % 3).alias("generation"), F.lit(100).alias("indexed")))


@query("membership_problems", "WITH m AS (SELECT source_key, row_number() OVER (PARTITION BY source_key ORDER BY id) - 1 AS ordinal FROM vectors), g AS (SELECT source_key, ordinal + CASE WHEN source_key = 'src1' AND ordinal > 3 THEN 1 ELSE 0 END AS ordinal FROM m), c AS (SELECT source_key, count(*) AS members, max(ordinal) AS last FROM g GROUP BY 1) SELECT source_key, CASE WHEN source_key = 'src2' THEN 'count' ELSE 'ordinals' END AS problem FROM c WHERE source_key = 'src2' OR last + 1 <> members UNION ALL SELECT 'src9', 'count'")
def membership_problems(vectors):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("source_key").orderBy("id")) - 1
    members = vectors.select("source_key", n.alias("ordinal")).withColumn("ordinal", F.col("ordinal") + F.when((F.col("source_key") == "src1") & (F.col("ordinal") > 3), 1).otherwise(0))
    states = vectors.groupBy("source_key").agg((F.count("*") + F.when(F.col("source_key") == "src2", 1).otherwise(0)).alias("indexed"))
    return E.membership_problems(members, states.unionByName(vectors.sparkSession.sql("SELECT 'src9' AS source_key, 1L AS indexed")))


BATCHES = "(SELECT 'batch' || CAST(p_partkey AS VARCHAR) AS batch_id, CASE WHEN p_partkey = 3 THEN 6400 ELSE 12800 END AS n_bytes FROM part WHERE p_partkey < 25 AND p_partkey <> 5)"


def batches(part):
    return part.where("p_partkey < 25 AND p_partkey <> 5").select(F.concat(F.lit("batch"), F.col("p_partkey").cast("string")).alias("batch_id"), F.when(F.col("p_partkey") == 3, 6400).otherwise(12800).alias("n_bytes"))


@query("payload_reconcile", f"SELECT asset_id, CASE WHEN status = 'ready' AND (n_bytes IS NULL OR payload_offset + payload_bytes > n_bytes) THEN 'pending' ELSE status END AS status, CASE WHEN NOT (status = 'ready' AND (n_bytes IS NULL OR payload_offset + payload_bytes > n_bytes)) THEN v.batch_id END AS batch_id FROM vectors v LEFT JOIN {BATCHES} b ON b.batch_id = v.batch_id")
def payload_reconcile(vectors, part):
    return E.reconciled_payloads(vectors, batches(part))


@query("unreferenced_batches", f"SELECT batch_id FROM {BATCHES} b WHERE batch_id NOT IN (SELECT batch_id FROM vectors)")
def unreferenced_batches(vectors, part):
    return E.unreferenced(batches(part), vectors).select("batch_id")
