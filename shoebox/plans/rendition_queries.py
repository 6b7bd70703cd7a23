"""Renditions, thumbnails and the records of scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoebox.operators import renditions as R
from shoebox.plans.registry import at, query, text_time

ASSETS = "assets AS (SELECT source_key, asset_id, sha1(asset_id) AS sha1_hex, CAST(substr(asset_id, 2) AS BIGINT) AS i, visibility_status FROM local_assets)"
REND = f"{ASSETS}, rend AS (SELECT source_key, asset_id, kind, CASE WHEN i % 7 = 0 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN i % 9 > 0 THEN 'p' END AS relative_path, CASE WHEN i % 5 = 0 THEN 'old' ELSE sha1_hex END AS source_sha1_hex, i FROM assets, (VALUES ('preview'), ('detail_preview')) k(kind) WHERE NOT (kind = 'preview' AND i % 4 = 0))"
DONE = f"{REND}, done AS (SELECT r.source_key, r.asset_id FROM rend r JOIN assets a ON a.source_key = r.source_key AND a.asset_id = r.asset_id AND a.sha1_hex = r.source_sha1_hex WHERE status = 'ready' AND relative_path IS NOT NULL GROUP BY ALL HAVING count(DISTINCT kind) = 2)"


def assets_of(local_assets):
    return local_assets.select("source_key", "asset_id", F.sha1(F.col("asset_id").cast("binary")).alias("sha1_hex"), F.expr("CAST(substr(asset_id, 2) AS BIGINT)").alias("i"), "visibility_status")


def renditions_of(local_assets):
    i = F.col("i")
    rows = assets_of(local_assets).withColumn("kind", F.explode(F.array(*map(F.lit, R.KINDS)))).where("NOT (kind = 'preview' AND i % 4 = 0)")
    return rows.select("source_key", "asset_id", "kind", F.when(i % 7 == 0, "failed").otherwise("ready").alias("status"), F.when(i % 9 > 0, "p").alias("relative_path"), F.when(i % 5 == 0, "old").otherwise(F.col("sha1_hex")).alias("source_sha1_hex"), "i")


@query("complete_renditions", f"WITH {DONE} SELECT * FROM done")
def complete_renditions(local_assets):
    return R.complete(renditions_of(local_assets), assets_of(local_assets))


@query("rendition_upsert", f"WITH {REND} SELECT coalesce(r.source_key, a.source_key) AS source_key, coalesce(r.asset_id, a.asset_id) AS asset_id, coalesce(r.kind, a.kind) AS kind, CASE WHEN a.asset_id IS NOT NULL THEN 'ready' ELSE r.status END AS status, CASE WHEN a.asset_id IS NOT NULL THEN 'q' ELSE r.relative_path END AS relative_path, CASE WHEN a.asset_id IS NOT NULL THEN a.sha1_hex ELSE r.source_sha1_hex END AS source_sha1_hex FROM rend r FULL JOIN (SELECT *, 'preview' AS kind FROM assets WHERE i % 6 = 0) a ON a.source_key = r.source_key AND a.asset_id = r.asset_id AND a.kind = r.kind")
def rendition_upsert(local_assets):
    new = assets_of(local_assets).where("i % 6 = 0").select("source_key", "asset_id", F.lit("preview").alias("kind"), F.lit("q").alias("relative_path"), F.col("sha1_hex").alias("source_sha1_hex"))
    return R.made(renditions_of(local_assets), new)


@query("rendition_failure", f"WITH {REND} SELECT source_key, asset_id, kind, CASE WHEN i % 3 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN i % 3 > 0 THEN relative_path END AS relative_path, CASE WHEN i % 3 > 0 THEN source_sha1_hex END AS source_sha1_hex FROM rend UNION ALL SELECT source_key, asset_id, 'preview', 'failed', NULL, NULL FROM assets WHERE i % 12 = 0")
def rendition_failure(local_assets):
    return R.failed(renditions_of(local_assets), assets_of(local_assets).where("i % 3 = 0"))


@query("thumbnail_states", f"WITH {DONE} SELECT source_key, asset_id, CASE WHEN (source_key, asset_id) IN (SELECT (source_key, asset_id) FROM done) THEN 'ready' WHEN i % 7 = 0 THEN 'failed' ELSE 'pending' END AS thumbnail_status FROM assets")
def thumbnail_states(local_assets):
    return R.thumbnail_states(assets_of(local_assets), renditions_of(local_assets), renditions_of(local_assets).where("status = 'failed'").unionByName(assets_of(local_assets).where("i % 7 = 0"), allowMissingColumns=True))


CALM = "SELECT source_key, root_key, root_generation FROM roots WHERE root_key <> 'root2'"


@query("claimable_thumbnails", f"SELECT j.id FROM jobs j JOIN ({CALM}) r ON r.source_key = j.source_key AND r.root_key = j.root_key AND r.root_generation = j.root_generation WHERE kind = 'thumbnail' AND status = 'queued'")
def claimable_thumbnails(jobs, roots):
    return R.claimable(jobs, roots.withColumn("reconciliation_pending", F.col("root_key") == "root2")).select("id")


@query("missing_durations", "SELECT source_key, upstream_asset_id FROM source_rows WHERE media_type = 'video' AND visibility_status = 'active' AND trim(coalesce(duration, '')) = ''")
def missing_durations(source_rows):
    return R.missing_durations(source_rows).select("source_key", "upstream_asset_id")


GO = "root_key IN ('root1', 'root4')"


@query("accepted_roots", f"SELECT source_key, root_key, root_generation + CASE WHEN {GO} THEN 1 ELSE 0 END AS root_generation, {GO} OR root_key = 'root0' AS reconciliation_pending, CASE WHEN root_key = 'root1' THEN 'skipped' WHEN root_key = 'root2' THEN 'running' ELSE 'idle' END AS window_state, CASE WHEN {GO} THEN 'new' WHEN root_key = 'root3' THEN ' ' ELSE 'old' END AS root_identity FROM roots")
def accepted_roots(roots):
    k = F.col("root_key")
    state = roots.select("source_key", "root_key", "root_generation", (k == "root0").alias("reconciliation_pending"), F.when(k.isin("root1", "root2"), "running").otherwise("idle").alias("window_state"), F.when(k == "root3", " ").otherwise("old").alias("root_identity"))
    new = roots.where("root_key <> 'root0'").select("root_key", F.when(k == "root2", "old").otherwise("new").alias("identity")).distinct()
    return R.accepted_roots(state, new)


@query("current_jobs", "SELECT j.id FROM jobs j LEFT JOIN roots r ON r.source_key = j.source_key AND r.root_key = j.root_key WHERE r.root_generation IS NULL OR r.root_generation = j.root_generation")
def current_jobs(jobs, roots):
    return R.current_jobs(jobs, roots).select("id")


@query("directory_states", "SELECT p_partkey AS directory, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 5 > 0 THEN p_size + 100 ELSE p_size END AS mtime FROM part WHERE p_partkey % 7 > 0 AND (p_partkey % 2 = 0 OR p_partkey % 3 = 0 AND p_partkey % 5 > 0)")
def directory_states(part):
    rows = part.select(F.col("p_partkey").alias("directory"), F.col("p_size").alias("mtime"))
    d = F.col("directory")
    return R.directory_states(rows.where(d % 2 == 0), rows.where(d % 3 == 0).withColumn("mtime", F.col("mtime") + 100), rows.where(d % 7 == 0), rows.where(d % 5 == 0).select("directory"))


@query("finished_runs", "SELECT event_id AS id, CASE WHEN event_type = 'click' AND event_id % 3 > 0 THEN CASE WHEN event_id % 3 = 1 THEN 'failed' ELSE 'completed' END WHEN event_type = 'click' THEN 'running' ELSE event_type END AS status, CASE WHEN event_type = 'click' AND event_id % 3 > 0 THEN '2024-01-01 00:00:09' END AS completed_at, CASE WHEN event_type = 'click' AND event_id % 3 > 0 THEN '{}' END AS skip_counts_json FROM events")
def finished_runs(events):
    i = F.col("event_id")
    runs = events.select(i.alias("id"), F.when(F.col("event_type") == "click", "running").otherwise(F.col("event_type")).alias("status"), F.lit(None).cast("timestamp_ntz").alias("completed_at"), F.lit(None).cast("string").alias("skip_counts_json"))
    outcomes = events.where("event_id % 3 > 0").select(i.alias("id"), (i % 3 == 1).alias("failed"), F.lit("{}").alias("skip_counts_json"))
    return R.finished_runs(runs, outcomes, at(9)).withColumn("completed_at", text_time("completed_at"))


NAMED = [(f"local{s}", i, s + i / 8) for i in range(40) for s in (0, 1)]


@query("requested_rows", f"SELECT l.source_key, l.id, r.score FROM locations l JOIN (VALUES {', '.join(map(str, NAMED))}) r(source_key, id, score) ON l.source_key = r.source_key AND l.id = r.id")
def requested_rows(locations):
    """Rows named by a literal relation, as a broadcast join."""
    named = locations.sparkSession.createDataFrame(NAMED, "source_key string, id bigint, score double")
    return locations.join(F.broadcast(named), ["source_key", "id"]).select("source_key", "id", "score")  # a request's rows
