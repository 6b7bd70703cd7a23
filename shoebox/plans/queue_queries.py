"""Queues: what is next, and single steps of job, verification and retry states."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoebox.operators import queues as Q, verification as W
from shoebox.plans.registry import at, query, text_time

NOW = 20 * 86400
NOW_SQL = "TIMESTAMP '2024-01-21 00:00:00'"
DELAY = "CAST(least(30 * pow(2, least(greatest({0}, 1) - 1, 20)), 1800) AS BIGINT)"
SCHED = "strftime(scheduled_at, '%Y-%m-%d %H:%M:%S')"


@query("next_jobs", f"SELECT id, priority FROM jobs WHERE status = 'queued' AND scheduled_at <= {NOW_SQL} ORDER BY priority, sort_at DESC, scheduled_at, id LIMIT 100")
def next_jobs(jobs):
    return Q.next_jobs(jobs, 100, at(NOW)).select("id", "priority")


@query("next_metadata_jobs", f"WITH own AS (SELECT j.*, row_number() OVER (PARTITION BY j.source_key, j.root_key ORDER BY priority, sort_at DESC, j.id) AS n FROM jobs j JOIN roots r ON r.source_key = j.source_key AND r.root_key = j.root_key AND r.root_generation = j.root_generation WHERE j.kind = 'metadata' AND j.status = 'queued' AND j.scheduled_at <= {NOW_SQL} AND j.location_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM locations l WHERE l.id = j.location_id AND l.id % 3 = 0)) SELECT id, root_key FROM own WHERE n <= 20 ORDER BY priority, sort_at DESC, id LIMIT 20")
def next_metadata_jobs(jobs, roots, locations):
    """Every third location has changed so lately that it is left alone for a while; others were."""
    waits = locations.withColumn("metadata_not_before", F.when(F.col("id") % 3 == 0, at(NOW + 60)).when(F.col("id") % 3 == 1, at(NOW - 60)))
    return Q.next_metadata_jobs(jobs, roots, waits, 20, at(NOW)).select("id", "root_key")


@query("next_thumbnail_jobs", "WITH j AS (SELECT *, CASE WHEN location_id % 6 > 0 THEN 'a' || CAST(location_id % 5000 AS VARCHAR) END AS asset_id FROM jobs), own AS (SELECT j.*, row_number() OVER (PARTITION BY j.source_key, j.root_key ORDER BY priority, sort_at DESC, scheduled_at, j.id) AS n FROM j JOIN roots r ON r.source_key = j.source_key AND r.root_key = j.root_key AND r.root_generation = j.root_generation AND r.root_key <> 'root4' WHERE j.kind = 'thumbnail' AND j.status = 'queued' AND j.asset_id IS NOT NULL) SELECT o.id, o.root_key, coalesce(CASE WHEN a.primary_location_id % 4 = 0 THEN 'video' WHEN a.primary_location_id IS NOT NULL THEN 'image' END, '') AS media_type FROM (SELECT * FROM own WHERE n <= 30 ORDER BY priority, sort_at DESC, scheduled_at, id LIMIT 30) o LEFT JOIN local_assets a ON a.source_key = o.source_key AND a.asset_id = o.asset_id")
def next_thumbnail_jobs(jobs, roots, local_assets):
    own = jobs.withColumn("asset_id", F.when(F.col("location_id") % 6 > 0, F.concat(F.lit("a"), (F.col("location_id") % 5000).cast("string"))))
    assets = local_assets.withColumn("media_type", F.when(F.col("primary_location_id") % 4 == 0, "video").otherwise("image"))
    return Q.next_thumbnail_jobs(own, roots.withColumn("reconciliation_pending", F.col("root_key") == "root4"), assets, 30).select("id", "root_key", "media_type")


@query("current_generation_jobs", "SELECT j.id FROM jobs j JOIN roots r ON r.source_key = j.source_key AND r.root_key = j.root_key AND r.root_generation = j.root_generation")
def current_generation_jobs(jobs, roots):
    return jobs.join(roots, ["source_key", "root_key", "root_generation"]).select("id")


@query("failed_last", "SELECT id FROM vectors ORDER BY CASE WHEN status = 'failed' THEN 1 ELSE 0 END, captured_at DESC, id LIMIT 450")
def failed_last(vectors):
    return Q.failed_last(vectors, 450).select("id")


@query("first_view_order", "WITH r AS (SELECT 'asset-' || CAST(id * 7919 % 100003 AS VARCHAR) AS asset_id, mtime AS captured_at FROM locations), v AS (SELECT asset_id, row_number() OVER (ORDER BY captured_at DESC, asset_id) AS n FROM r) SELECT asset_id FROM v ORDER BY CASE WHEN n <= 50 THEN n ELSE 1000000 END, substr(asset_id, -8), asset_id LIMIT 400")
def first_view_order(locations):
    ids = F.concat(F.lit("asset-"), (F.col("id") * 7919 % 100003).cast("string"))
    return Q.first_view_order(locations.select(ids.alias("asset_id"), F.col("mtime").alias("captured_at")), 50, 400).select("asset_id")


@query("new_thumbnail_jobs", "WITH a AS (SELECT *, CASE WHEN primary_location_id % 4 = 0 THEN 'video' ELSE 'image' END AS media_type, CASE WHEN primary_location_id % 3 > 0 THEN 'pending' ELSE 'ready' END AS thumbnail_status FROM local_assets WHERE source_key = 'local1'), ranked AS (SELECT *, row_number() OVER (ORDER BY captured_at DESC, asset_id) AS n FROM a WHERE visibility_status = 'active' AND media_type = 'image') SELECT source_key, asset_id, CASE WHEN n <= 40 THEN 0 ELSE 10 END AS priority FROM ranked r WHERE thumbnail_status = 'pending' AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.source_key = r.source_key AND 'a' || CAST(j.location_id % 5000 AS VARCHAR) = r.asset_id AND j.kind = 'thumbnail' AND j.status IN ('queued', 'running')) ORDER BY CASE WHEN n <= 40 THEN n ELSE 1000000 END, substr(asset_id, -8), asset_id LIMIT 90")
def new_thumbnail_jobs(local_assets, jobs):
    i = F.col("primary_location_id")
    assets = local_assets.where("source_key = 'local1'").withColumns({"media_type": F.when(i % 4 == 0, "video").otherwise("image"), "thumbnail_status": F.when(i % 3 > 0, "pending").otherwise("ready")})
    own = jobs.withColumn("asset_id", F.concat(F.lit("a"), (F.col("location_id") % 5000).cast("string")))
    return Q.thumbnail_jobs(assets, own, 40, 90, videos=False).select("source_key", "asset_id", "priority")


@query("stalest_location", "SELECT l.id FROM locations l JOIN roots r ON r.source_key = l.source_key AND r.root_key = l.root_key WHERE status = 'active' AND asset_id IS NOT NULL AND l.id % 7 > 0 AND (verified_at IS NULL OR verified_at < TIMESTAMP '2024-01-01 00:15:00') AND attempted_at < TIMESTAMP '2024-01-01 00:15:00' AND (l.id % 2 > 0 OR attempted_at <= TIMESTAMP '2024-01-01 00:05:00') AND r.root_key <> 'root4' AND l.id > 10 ORDER BY attempted_at NULLS FIRST, l.id LIMIT 1")
def stalest_location(locations, roots):
    rows = locations.where("attempted_at IS NOT NULL AND id > 10").withColumns({"sha1_hex": F.when(F.col("id") % 7 > 0, "x"), "verification_error": F.when(F.col("id") % 2 == 0, "e")})
    return Q.stalest(rows, roots.withColumn("reconciliation_pending", F.col("root_key") == "root4"), at(900), at(300)).select("id")


@query("round_robin_quotas", "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY captured_at DESC, id) AS n FROM vectors) WHERE n <= CASE WHEN source_key = 'src0' THEN 34 ELSE 33 END")
def round_robin_quotas(vectors):
    from shoebox.request import round_quotas

    quotas = vectors.sparkSession.createDataFrame(list(zip(["src0", "src1", "src2"], round_quotas(100, 3), strict=True)), "source_key string, quota int")
    return Q.within_quotas(vectors, quotas).select("id")


@query("assets_without_job", "SELECT id FROM locations l WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.location_id = l.id AND j.status IN ('queued', 'running'))")
def assets_without_job(locations, jobs):
    return Q.without_active_job(locations.withColumnRenamed("id", "location_id"), jobs, ["location_id"]).select(F.col("location_id").alias("id"))


# Index jobs under leases.

INDEX_JOB = ["id", "status", "attempts", "last_error"]
EXPIRED = f"SELECT id, source_key, priority, attempts, CASE WHEN x THEN 'failed' ELSE status END AS status, CASE WHEN x THEN {NOW_SQL} ELSE scheduled_at END AS scheduled_at, CASE WHEN NOT x THEN lease_until END AS lease_until, CASE WHEN x THEN 'lease expired' ELSE last_error END AS last_error FROM (SELECT *, coalesce(status = 'running' AND lease_until <= {NOW_SQL}, false) AS x FROM index_jobs)"


def times(rows, *names):
    return rows.withColumns({n: text_time(n) for n in names})


@query("expired_leases", f"SELECT id, status, attempts, last_error, {SCHED} AS scheduled_at, strftime(lease_until, '%Y-%m-%d %H:%M:%S') AS lease_until FROM ({EXPIRED})")
def expired_leases(index_jobs):
    """Some running jobs have no lease, some one that ends later."""
    return times(Q.expired(index_jobs, at(NOW)), "scheduled_at", "lease_until").select(*INDEX_JOB, "scheduled_at", "lease_until")


@query("claimed_jobs", f"WITH e AS ({EXPIRED}), m AS (SELECT id AS mine FROM e WHERE source_key IN ('src2', 'src0') AND status IN ('queued', 'failed') AND scheduled_at <= {NOW_SQL} ORDER BY CASE source_key WHEN 'src2' THEN 1 ELSE 2 END, priority, scheduled_at, id LIMIT 150) SELECT id, CASE WHEN mine IS NULL THEN status ELSE 'running' END AS status, attempts + CASE WHEN mine IS NULL THEN 0 ELSE 1 END AS attempts, CASE WHEN mine IS NULL THEN last_error END AS last_error, strftime(CASE WHEN mine IS NULL THEN lease_until ELSE TIMESTAMP '2024-01-21 00:15:00' END, '%Y-%m-%d %H:%M:%S') AS lease_until FROM e LEFT JOIN m ON id = mine")
def claimed_jobs(index_jobs):
    """150 workers ask at once, for two of three sources."""
    return times(Q.claimed(index_jobs, ["src2", "src0"], at(NOW), at(NOW + 900), 150), "lease_until").select(*INDEX_JOB, "lease_until")


@query("job_reports", f"WITH r AS (SELECT *, id % 4 > 0 AS own, CASE WHEN id % 3 = 0 THEN 'done' ELSE 'failed' END AS result FROM index_jobs), k AS (SELECT *, own AND result = 'done' AND status = 'running' AS d, own AND result = 'failed' AND status IN ('running', 'completed') AS f FROM r) SELECT id, CASE WHEN d THEN 'completed' WHEN f THEN 'failed' ELSE status END AS status, attempts, CASE WHEN f THEN CASE WHEN id % 2 = 0 THEN 'e' ELSE '' END WHEN NOT d THEN last_error END AS last_error, strftime(CASE WHEN f THEN {NOW_SQL} + to_seconds({DELAY.format('attempts')}) ELSE scheduled_at END, '%Y-%m-%d %H:%M:%S') AS scheduled_at, d OR f OR lease_until IS NULL AS free FROM k")
def job_reports(index_jobs):
    """One report in four is of an earlier try."""
    result = F.when(F.col("id") % 3 == 0, "done").otherwise("failed")
    reports = index_jobs.select("id", (F.col("attempts") - F.when(F.col("id") % 4 > 0, 0).otherwise(1)).alias("attempts"), result.alias("result"), F.when(F.col("id") % 2 == 0, "e").alias("error"))
    return times(Q.reported(index_jobs, reports, at(NOW)), "scheduled_at").select(*INDEX_JOB, "scheduled_at", F.col("lease_until").isNull().alias("free"))


# Scan jobs.

SCAN = ["id", "status", "owner", "last_error"]
FILES = f"(SELECT *, CASE WHEN id % 3 = 0 THEN {NOW_SQL} + to_seconds(60) WHEN id % 3 = 1 THEN {NOW_SQL} - to_seconds(60) END AS settled FROM locations)"
REQUEUED_AT = f"strftime(CASE WHEN d AND kind = 'metadata' THEN greatest({NOW_SQL}, coalesce(settled, {NOW_SQL})) WHEN d THEN {NOW_SQL} ELSE scheduled_at END, '%Y-%m-%d %H:%M:%S') AS scheduled_at, strftime(CASE WHEN d AND kind = 'metadata' AND l.id IS NOT NULL THEN mtime ELSE sort_at END, '%Y-%m-%d %H:%M:%S') AS sort_at"


def settling(locations):
    return locations.withColumn("metadata_not_before", F.when(F.col("id") % 3 == 0, at(NOW + 60)).when(F.col("id") % 3 == 1, at(NOW - 60)))


def failing(jobs):
    return jobs.withColumn("last_error", F.when(F.col("status") == "failed", "boom"))


@query("job_outcomes", f"""WITH o AS (SELECT j.*, CASE j.id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'deferred' END AS r, j.id % 7 > 0 AND kind = 'metadata' AS ours, j.id % 11 > 0 AS there, r.root_key IS NOT NULL AS known FROM jobs j LEFT JOIN roots r ON r.source_key = j.source_key AND r.root_key = j.root_key AND r.root_generation = j.root_generation),
  k AS (SELECT *, coalesce(ours AND r = 'failed' AND known AND status IN ('queued', 'running'), false) AS f, coalesce(ours AND there AND status = 'running' AND (r = 'deferred' OR r = 'failed' AND NOT known), false) AS d FROM o WHERE r IS DISTINCT FROM 'done')
  SELECT k.id, CASE WHEN f THEN 'failed' WHEN d THEN 'queued' ELSE k.status END AS status, CASE WHEN NOT d THEN owner END AS owner, CASE WHEN f THEN CASE WHEN k.id % 2 = 0 THEN 'bad' END WHEN NOT d AND k.status = 'failed' THEN 'boom' END AS last_error, {REQUEUED_AT} FROM k LEFT JOIN {FILES} l ON l.id = k.location_id""")
def job_outcomes(jobs, roots, locations):
    """Some outcomes are of an earlier generation or of another file; some jobs' roots have moved on."""
    i = F.col("id")
    result = F.when(i % 4 == 0, "done").when(i % 4 == 1, "failed").when(i % 4 == 2, "deferred")
    outcomes = jobs.select("id", "source_key", "root_key", (F.col("root_generation") + F.when(i % 7 > 0, 0).otherwise(1)).alias("root_generation"), (F.col("location_id") + F.when(i % 11 > 0, 0).otherwise(1)).alias("location_id"), result.alias("result"), F.when(i % 2 == 0, "bad").otherwise("").alias("error"))
    return times(Q.scan_outcome(failing(jobs), outcomes.where("result IS NOT NULL"), roots, settling(locations), at(NOW)), "scheduled_at", "sort_at").select(*SCAN, "scheduled_at", "sort_at")


@query("running_reset", f"SELECT k.id, CASE WHEN d THEN 'queued' ELSE k.status END AS status, CASE WHEN NOT d THEN owner END AS owner, CASE WHEN k.status = 'failed' THEN 'boom' END AS last_error, {REQUEUED_AT} FROM (SELECT *, status = 'running' AND kind IN ('metadata', 'thumbnail') AS d FROM jobs) k LEFT JOIN {FILES} l ON l.id = k.location_id")
def running_reset(jobs, locations):
    return times(Q.reset_running(failing(jobs), settling(locations), at(NOW)), "scheduled_at", "sort_at").select(*SCAN, "scheduled_at", "sort_at")


@query("repaired_jobs", f"""WITH l AS (SELECT source_key, root_key, id, status, mtime, 'a' || CAST(id // 8 AS VARCHAR) AS asset_id FROM locations),
  a AS (SELECT source_key, asset_id, min(id) % 5 > 0 AS shown, CASE WHEN min(id) % 3 = 0 THEN max(id) END AS prime FROM l GROUP BY ALL),
  t AS (SELECT * FROM (SELECT l.*, root_generation, row_number() OVER (PARTITION BY source_key, asset_id, root_key ORDER BY id = prime DESC NULLS LAST, id) AS n FROM l JOIN a USING (source_key, asset_id) JOIN roots USING (source_key, root_key) WHERE status = 'active' AND shown) WHERE n = 1),
  m AS (SELECT * FROM jobs WHERE kind = 'metadata'),
  busy AS (SELECT DISTINCT l.source_key, asset_id FROM m JOIN l ON l.id = location_id AND l.source_key = m.source_key JOIN roots r ON r.source_key = m.source_key AND r.root_key = l.root_key AND r.root_generation = m.root_generation WHERE m.status IN ('queued', 'running')),
  idle AS (SELECT * FROM t ANTI JOIN busy USING (source_key, asset_id)),
  again AS (SELECT idle.source_key, idle.asset_id, max(m.id) AS job_id, max_by(mtime, m.id) AS mtime FROM idle JOIN m ON m.source_key = idle.source_key AND m.location_id = idle.id AND m.root_generation = idle.root_generation WHERE m.status = 'failed' GROUP BY ALL)
  SELECT j.id, j.location_id, CASE WHEN job_id IS NULL THEN j.status ELSE 'queued' END AS status, CASE WHEN job_id IS NULL THEN j.attempts ELSE 0 END AS attempts, CASE WHEN job_id IS NULL THEN j.priority ELSE 0 END AS priority, strftime(CASE WHEN job_id IS NULL THEN scheduled_at ELSE {NOW_SQL} END, '%Y-%m-%d %H:%M:%S') AS scheduled_at, strftime(CASE WHEN job_id IS NULL THEN sort_at ELSE mtime END, '%Y-%m-%d %H:%M:%S') AS sort_at
  FROM jobs j LEFT JOIN again ON j.id = job_id WHERE NOT (kind = 'metadata' AND j.status = 'failed' AND job_id IS NULL AND location_id IN (SELECT l.id FROM l SEMI JOIN t USING (source_key, asset_id)))
  UNION ALL SELECT NULL, id, 'queued', 0, 0, '2024-01-21 00:00:00', strftime(mtime, '%Y-%m-%d %H:%M:%S') FROM idle ANTI JOIN again USING (source_key, asset_id)""")
def repaired_jobs(jobs, locations, roots):
    """Assets of several files each, below several roots; some of them are hidden, some have a primary file."""
    own = locations.withColumn("asset_id", F.concat(F.lit("a"), F.floor(F.col("id") / 8).cast("string")))
    assets = own.groupBy("source_key", "asset_id").agg(F.when(F.min("id") % 5 > 0, "active").otherwise("missing").alias("visibility_status"), F.when(F.min("id") % 3 == 0, F.max("id")).alias("primary_location_id"))
    found = Q.repaired(jobs, assets, own, roots, at(NOW))
    return times(found, "scheduled_at", "sort_at").select("id", "location_id", "status", "attempts", "priority", "scheduled_at", "sort_at")


FAILED = "SELECT asset_id FROM vectors WHERE status = 'failed'"
CFAILED = "SELECT asset_id FROM vectors WHERE id % 3 = 0 AND status <> 'ready'"


@query("retry_targets", f"SELECT asset_id, 'source' AS scope FROM ({FAILED}) WHERE asset_id NOT IN ({CFAILED}) UNION ALL SELECT asset_id, 'canonical' FROM ({CFAILED})")
def retry_targets(vectors):
    return Q.retry_targets(vectors.where("status = 'failed'").select("asset_id"), vectors.where("id % 3 = 0 AND status <> 'ready'").select("asset_id"))


def old_requests(vectors):
    return vectors.where("id % 5 = 0").select("asset_id", at(60).alias("requested_at"))


@query("retry_requests", f"SELECT coalesce(o.asset_id, t.asset_id) AS asset_id, CASE WHEN t.asset_id IS NOT NULL THEN '2024-01-01 02:00:00' ELSE '2024-01-01 00:01:00' END AS requested_at FROM (SELECT asset_id FROM vectors WHERE id % 5 = 0) o FULL JOIN ({FAILED}) t ON o.asset_id = t.asset_id")
def retry_requests(vectors):
    return Q.retry_requests(old_requests(vectors), vectors.where("status = 'failed'"), at(7200)).withColumn("requested_at", text_time("requested_at"))


@query("consumed_requests", "SELECT asset_id FROM vectors WHERE id % 5 = 0 AND NOT (id % 2 = 0 AND id % 3 > 0)")
def consumed_requests(vectors):
    handled = vectors.where("id % 2 = 0").select("asset_id", F.when(F.col("id") % 3 > 0, at(60)).otherwise(at(59)).alias("requested_at"))
    return Q.consumed(old_requests(vectors), handled).select("asset_id")


@query("work_phase", "WITH w AS (SELECT event_id AS id, event_id % 50 - 5 AS m, event_id % 400 AS t, event_id % 700 AS e, event_id % 3 * 90 AS b, value / 100 AS draw FROM events), x AS (SELECT *, CASE WHEN m > 0 THEN greatest(least(m, 300) * 5.0, 100.0) ELSE 0.0 END AS wm, least(greatest(t, 0), 300) * 3.0 AS wt, CASE WHEN b > 0 AND e >= b THEN least(greatest(e, 0), 500) * 1.0 ELSE 0.0 END AS we FROM w) SELECT id, CASE WHEN wm + wt + we <= 0 THEN '' WHEN wm > 0 AND d < wm THEN 'metadata' WHEN wt > 0 AND d - wm < wt THEN 'thumbnails' WHEN we > 0 THEN 'embeddings' ELSE '' END AS phase FROM (SELECT *, least(greatest(draw, 0.0), 0.999999999999) * (wm + wt + we) AS d FROM x)")
def work_phase(events):
    i = F.col("event_id")
    return events.select(i.alias("id"), Q.phase(i % 50 - 5, i % 400, i % 700, i % 3 * 90, F.col("value") / 100).alias("phase"))


# Verification windows over the local roots.

DAY2, DAY3 = "TIMESTAMP '2024-01-02'", "TIMESTAMP '2024-01-03'"
OWN_COUNTERS = ", ".join(f"{5 + i} AS {c}" for i, c in enumerate(W.COUNTERS))
ROOTS = f"""vroots AS (SELECT source_key, root_key, root_generation, CASE WHEN root_key IN ('root1', 'root4') THEN 'running' WHEN root_key = 'root2' THEN 'completed' ELSE 'idle' END AS window_state,
  CASE WHEN root_key = 'root3' THEN NULL WHEN root_key = 'root2' THEN {DAY3} ELSE TIMESTAMP '2024-01-01' END AS scheduled_for, CASE WHEN root_key IN ('root1', 'root4') THEN TIMESTAMP '2024-01-01 01:00:00' END AS started_at,
  CASE WHEN root_key = 'root4' THEN TIMESTAMP '2024-01-01' WHEN root_key = 'root1' THEN TIMESTAMP '2024-01-09' END AS deadline, CAST(NULL AS TIMESTAMP) AS finished_at, CASE WHEN root_key = 'root0' THEN 'late' END AS skip_reason,
  source_key = 'local1' AND root_key IN ('root0', 'root1') AS reconciliation_pending, {OWN_COUNTERS} FROM roots)"""


def verification_roots(roots):
    k = F.col("root_key")
    state = F.when(k.isin("root1", "root4"), "running").when(k == "root2", "completed").otherwise("idle")
    return roots.select(
        "source_key", k, "root_generation", state.alias("window_state"), F.when(k == "root2", at(2 * 86400)).when(k != "root3", at(0)).alias("scheduled_for"), F.when(k.isin("root1", "root4"), at(3600)).alias("started_at"),
        F.when(k == "root4", at(0)).when(k == "root1", at(8 * 86400)).alias("deadline"), F.lit(None).cast("timestamp_ntz").alias("finished_at"), F.when(k == "root0", "late").alias("skip_reason"),
        ((F.col("source_key") == "local1") & k.isin("root0", "root1")).alias("reconciliation_pending"), *(F.lit(5 + i).alias(c) for i, c in enumerate(W.COUNTERS))
    )


WINDOW_TIMES = ("scheduled_for", "started_at", "deadline", "finished_at")
WINDOW = ["source_key", "root_key", "window_state", *WINDOW_TIMES, "skip_reason", *W.COUNTERS]


def windows(rows):
    return times(rows, *WINDOW_TIMES).select(*WINDOW)


def window_sql(go: str, state: str, counters: str | None = None, **values: str) -> str:
    """The windows with new values where `go` holds."""
    set_ = lambda c: f"CASE WHEN {go} THEN {values[c]} ELSE {c} END" if c in values else c
    own = [f"CASE WHEN {go} THEN '{state}' ELSE window_state END AS window_state", *(f"strftime({set_(c)}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in WINDOW_TIMES), f"{set_('skip_reason')} AS skip_reason"]
    own += [f"CASE WHEN {go} THEN {counters} ELSE {c} END AS {c}" if counters else c for c in W.COUNTERS]
    return f"WITH {ROOTS} SELECT source_key, root_key, {', '.join(own)} FROM vroots"


NEXT = f"window_state <> 'running' AND (scheduled_for IS NULL OR scheduled_for < {DAY2})"
OVER = {"started_at": "NULL", "deadline": "NULL", "finished_at": NOW_SQL, "skip_reason": "NULL"}


@query("verification_started", window_sql(f"{NEXT} AND NOT reconciliation_pending", "running", "0", scheduled_for=DAY2, started_at=NOW_SQL, deadline=DAY3, skip_reason="NULL"))
def verification_started(roots):
    return windows(W.started(verification_roots(roots), at(86400), at(2 * 86400), at(NOW)))


@query("verification_skipped", window_sql(NEXT, "skipped", "0", **OVER | {"scheduled_for": DAY2, "skip_reason": "'busy'"}))
def verification_skipped(roots):
    return windows(W.skipped(verification_roots(roots), at(86400), F.lit(" busy "), at(NOW)))


ADDED = ", ".join(f"{c} + CASE WHEN window_state = 'running' AND source_key = 'local0' THEN {max(0, 3 - i)} ELSE 0 END AS {c}" for i, c in enumerate(W.COUNTERS))


@query("verification_progress", f"WITH {ROOTS} SELECT source_key, root_key, {ADDED} FROM vroots")
def verification_progress(roots):
    """Each root reports, some of a window that was not the running one; a negative count adds nothing."""
    r = verification_roots(roots)
    began = F.when(F.col("source_key") == "local0", at(3600)).otherwise(at(3601))
    counts = r.select("source_key", "root_key", at(0).alias("scheduled_for"), began.alias("started_at"), *(F.lit(3 - i).alias(c) for i, c in enumerate(W.COUNTERS)))
    return W.progressed(r, counts).select("source_key", "root_key", *W.COUNTERS)


@query("verification_completed", window_sql("root_key = 'root1' AND source_key = 'local0'", "completed", **OVER))
def verification_completed(roots):
    r = verification_roots(roots)
    began = F.when(F.col("source_key") == "local0", at(3600)).otherwise(at(3601))
    done = r.where("root_key IN ('root0', 'root1')").select("source_key", "root_key", at(0).alias("scheduled_for"), began.alias("started_at"))
    return windows(W.completed(r, done, at(NOW)))


@query("verification_expired", window_sql(f"window_state = 'running' AND deadline <= {NOW_SQL}", "completed", **OVER))
def verification_expired(roots):
    return windows(W.expired(verification_roots(roots), at(NOW)))


@query("verification_runnable", f"WITH {ROOTS} SELECT source_key, root_key FROM vroots WHERE window_state = 'running' AND deadline > TIMESTAMP '2024-01-05' AND NOT reconciliation_pending")
def verification_runnable(roots):
    return W.runnable(verification_roots(roots), at(4 * 86400))


@query("verification_next_deadline", f"WITH {ROOTS} SELECT strftime(min(deadline), '%Y-%m-%d') AS deadline FROM vroots WHERE window_state = 'running'")
def verification_next_deadline(roots):
    return W.next_deadline(verification_roots(roots)).select(F.date_format("deadline", "yyyy-MM-dd").alias("deadline"))


RESULTS = "CASE id % 6 WHEN 0 THEN 'attempt' WHEN 1 THEN 'success' WHEN 2 THEN 'failure' WHEN 3 THEN 'restore' WHEN 4 THEN 'resettle' END"
TX = "'%Y-%m-%d %H:%M:%S'"
CHECKED = ["id", "status", "status_reason", "asset_id", "sha1_hex", "size_bytes", "verification_error"]


@query("verification_outcomes", f"""WITH {ROOTS}, l AS (SELECT *, 'h' || CAST(id % 100 AS VARCHAR) AS sha1_hex, CASE WHEN id % 5 = 0 THEN 'old' END AS verification_error FROM locations),
  o AS (SELECT l.*, id % 9 > 0 AND NOT reconciliation_pending AS trusted, id % 8 > 0 AS same, id % 13 > 0 AS same_hash, id % 4 > 0 AS newest, {RESULTS.replace('id %', 'l.id %')} AS res FROM l JOIN vroots v ON v.source_key = l.source_key AND v.root_key = l.root_key),
  k AS (SELECT *, CASE WHEN status = 'active' AND same_hash AND (res = 'failure' OR res = 'restore' AND newest AND attempted_at IS NOT NULL OR res = 'resettle' AND trusted OR res IN ('attempt', 'success') AND same AND trusted) THEN res END AS r FROM o)
  SELECT id, CASE WHEN r = 'resettle' THEN 'discovered' ELSE status END AS status, CASE WHEN r = 'resettle' THEN 'e' || CAST(id AS VARCHAR) ELSE status_reason END AS status_reason, CASE WHEN r IS DISTINCT FROM 'resettle' THEN asset_id END AS asset_id, CASE WHEN r IS DISTINCT FROM 'resettle' THEN sha1_hex END AS sha1_hex, CASE WHEN r = 'resettle' THEN size_bytes + 7 ELSE size_bytes END AS size_bytes,
    CASE WHEN r = 'failure' THEN 'e' || CAST(id AS VARCHAR) WHEN r = 'restore' THEN 'before' WHEN r IS NULL THEN verification_error END AS verification_error,
    strftime(CASE WHEN r = 'success' THEN {NOW_SQL} WHEN r IS DISTINCT FROM 'resettle' THEN verified_at END, {TX}) AS verified_at, strftime(CASE WHEN r IN ('attempt', 'success', 'failure', 'resettle') THEN {NOW_SQL} WHEN r = 'restore' THEN TIMESTAMP '2024-01-01' ELSE attempted_at END, {TX}) AS attempted_at,
    CASE WHEN r = 'resettle' THEN '2024-01-21 00:00:30' END AS metadata_not_before FROM k""")
def verification_outcomes(locations, roots):
    """Some files, hashes or generations are not what they were, some attempts not the last."""
    i = F.col("id")
    own = locations.withColumns({"sha1_hex": F.concat(F.lit("h"), (i % 100).cast("string")), "fast_signature": F.col("size_bytes").cast("string"), "verification_error": F.when(i % 5 == 0, "old"), "metadata_not_before": F.lit(None).cast("timestamp_ntz")})
    v = verification_roots(roots)
    known = own.join(v.select("source_key", "root_key", "root_generation"), ["source_key", "root_key"])
    outcomes = known.where("id % 6 < 5").select(
        "id", "source_key", "root_key", F.when(i % 9 > 0, F.col("root_generation")).otherwise(-1).alias("root_generation"), F.when(i % 13 > 0, F.col("sha1_hex")).otherwise("other").alias("sha1_hex"),
        (F.col("size_bytes") + F.when(i % 8 == 0, 1).otherwise(0)).alias("size_bytes"), "mtime", "fast_signature", "file_identity", F.expr(RESULTS).alias("result"), F.concat(F.lit("e"), i.cast("string")).alias("error"),
        F.when(i % 4 > 0, F.col("attempted_at")).otherwise(at(1)).alias("attempt_at"), at(0).alias("before_at"), F.lit("before").alias("before_error"), (F.col("size_bytes") + 7).alias("new_size_bytes"), F.col("mtime").alias("new_mtime"), F.lit("s").alias("new_fast_signature"), F.col("file_identity").alias("new_file_identity")
    )
    return times(W.verified(own, outcomes, v, at(NOW), 30), "verified_at", "attempted_at", "metadata_not_before").select(*CHECKED, "verified_at", "attempted_at", "metadata_not_before")
