"""Local roots: scans, locations, visibility and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoebox.functions import scalars as S
from shoebox.operators import locations as L
from shoebox.plans.registry import at, query

PATH = ["source_key", "root_key", "relative_path"]
SEEN = "seen AS (SELECT source_key, root_key, relative_path, CASE WHEN id % 6 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, mtime, CASE WHEN id % 25 = 0 THEN NULL ELSE file_identity END AS file_identity FROM locations WHERE id % 4 > 0 UNION ALL SELECT source_key, root_key, relative_path || '.new', size_bytes, mtime, file_identity FROM locations WHERE id % 50 = 0)"


def seen(locations):
    """What a scan sees: some files gone, changed, or new."""
    old = locations.where("id % 4 > 0").select(*PATH, F.when(F.col("id") % 6 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"), "mtime", F.when(F.col("id") % 25 > 0, F.col("file_identity")).alias("file_identity"))
    new = locations.where("id % 50 = 0").select("source_key", "root_key", F.concat("relative_path", F.lit(".new")).alias("relative_path"), "size_bytes", "mtime", "file_identity")
    return old.unionByName(new)


@query("location_upsert", f"""WITH {SEEN}, j AS (SELECT s.source_key, s.root_key, s.relative_path, o.id, o.status, coalesce(o.asset_id, '') <> '' AS has_asset, o.size_bytes IS NOT DISTINCT FROM s.size_bytes AND o.mtime IS NOT DISTINCT FROM s.mtime AND o.file_identity IS NOT DISTINCT FROM s.file_identity AS same FROM seen s LEFT JOIN locations o USING (source_key, root_key, relative_path)),
  a AS (SELECT *, CASE WHEN id IS NULL THEN 'insert' WHEN same AND status = 'active' THEN 'touch' WHEN same AND status IN ('missing', 'permission_blocked') AND has_asset THEN 'restore' WHEN same AND status = 'discovered' THEN 'touch_queue' WHEN same THEN 'reset' WHEN status = 'missing' THEN 'insert' ELSE 'reset' END AS action FROM j)
  SELECT source_key, root_key, relative_path, CASE WHEN action <> 'insert' THEN id END AS id, action, action IN ('insert', 'touch_queue', 'reset') AS queue_metadata, action IN ('restore', 'reset') AND has_asset AS visibility_dirty FROM a""")
def location_upsert(locations):
    return L.located(seen(locations), locations)


@query("absent_locations", f"WITH {SEEN} SELECT id FROM locations l WHERE status <> 'missing' AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.source_key = l.source_key AND s.root_key = l.root_key AND s.relative_path = l.relative_path) AND NOT (starts_with(relative_path, 'd1/') OR starts_with(relative_path, 'd7/e1/'))")
def absent_locations(locations):
    blocked = locations.sparkSession.sql("SELECT * FROM VALUES ('d1'), ('d7/e1') AS b(directory)")
    return L.absent_locations(seen(locations), locations, blocked).select("id")


@query("marked_missing", "SELECT id, relative_path, asset_id FROM locations WHERE id % 3 = 0 AND status <> 'missing'")
def marked_missing(locations):
    return L.marked(locations, locations.where("id % 3 = 0").select("id"), "missing")[1]


@query("marked_snapshot", "SELECT CASE WHEN id % 3 = 0 THEN 'missing' ELSE status END AS status, count(*) AS n FROM locations GROUP BY ALL")
def marked_snapshot(locations):
    return L.marked(locations, locations.where("id % 3 = 0").select("id"), "missing")[0].groupBy("status").agg(F.count("*").alias("n"))


@query("quick_scan_directories", """WITH stored AS (SELECT source_key || '/' || root_key || '/' || split_part(relative_path, '/', 1) AS directory, max(size_bytes) AS mtime, bool_or(id % 500 = 0) AS blocked FROM locations WHERE id % 2 = 0 GROUP BY 1),
  seen AS (SELECT source_key || '/' || root_key || '/' || split_part(relative_path, '/', 1) AS directory, max(size_bytes) AS mtime FROM locations WHERE id % 7 > 0 AND root_key <> 'root3' GROUP BY 1)
  SELECT coalesce(s.directory, o.directory) AS directory, CASE WHEN s.directory IS NULL THEN 'removed' WHEN o.directory IS NULL THEN 'new' WHEN s.mtime <> o.mtime THEN 'modified' ELSE 'retry' END AS change FROM seen s FULL JOIN stored o USING (directory) WHERE s.directory IS NULL OR o.directory IS NULL OR s.mtime <> o.mtime OR blocked""")
def quick_scan_directories(locations):
    folder = F.concat_ws("/", "source_key", "root_key", F.split_part("relative_path", F.lit("/"), F.lit(1))).alias("directory")
    stored = locations.where("id % 2 = 0").groupBy(folder).agg(F.max("size_bytes").alias("mtime"), F.bool_or(F.col("id") % 500 == 0).alias("blocked"))
    now = locations.where("id % 7 > 0 AND root_key <> 'root3'").groupBy(folder).agg(F.max("size_bytes").alias("mtime"))
    return L.changed_directories(now, stored)


VISIBLE = """best AS (SELECT source_key, asset_id, id FROM (SELECT *, row_number() OVER (PARTITION BY source_key, asset_id ORDER BY verified_at DESC NULLS LAST, mtime DESC, root_key, relative_path, id) AS n FROM locations WHERE status = 'active' AND asset_id IS NOT NULL) WHERE n = 1),
  vis AS (SELECT l.source_key, l.asset_id, CASE WHEN bool_or(status = 'active') THEN 'active' WHEN bool_or(status = 'permission_blocked') THEN 'permission_blocked' ELSE 'missing' END AS visibility_status, max(b.id) AS primary_location_id FROM locations l LEFT JOIN best b ON b.source_key = l.source_key AND b.asset_id = l.asset_id WHERE l.asset_id IS NOT NULL GROUP BY l.source_key, l.asset_id)"""


@query("asset_visibility", f"WITH {VISIBLE} SELECT * FROM vis")
def asset_visibility(locations):
    return L.asset_visibility(locations)


@query("visibility_changes", f"WITH {VISIBLE} SELECT a.source_key, a.asset_id, v.visibility_status AS new_status, v.primary_location_id AS new_location FROM local_assets a JOIN vis v ON a.source_key = v.source_key AND a.asset_id = v.asset_id WHERE a.visibility_status <> v.visibility_status OR a.primary_location_id IS DISTINCT FROM v.primary_location_id")
def visibility_changes(local_assets, locations):
    return L.visibility_changes(local_assets, locations)


@query("location_diagnostics", """SELECT l.source_key, l.root_key, l.relative_path, l.id, l.status, CASE WHEN trim(status_reason) <> '' THEN trim(status_reason) WHEN l.status = 'active' THEN 'active' WHEN l.status = 'discovered' THEN 'metadata_pending' WHEN l.status = 'missing' THEN 'phase0_absent' WHEN l.status = 'permission_blocked' THEN 'phase0_read_error' ELSE l.status END AS reason, r.root_state, a.visibility_status AS asset_status
  FROM locations l LEFT JOIN roots r ON r.source_key = l.source_key AND r.root_key = l.root_key LEFT JOIN local_assets a ON a.source_key = l.source_key AND a.asset_id = l.asset_id""")
def location_diagnostics(locations, roots, local_assets):
    return L.diagnostics(locations, roots, local_assets)


@query("capture_metadata_pending", "SELECT source_key, asset_id, root_key, id AS location_id FROM (SELECT l.*, row_number() OVER (PARTITION BY l.source_key, l.asset_id, l.root_key ORDER BY CASE WHEN l.id = a.primary_location_id THEN 0 ELSE 1 END, l.id) AS n FROM locations l JOIN local_assets a ON a.source_key = l.source_key AND a.asset_id = l.asset_id WHERE l.status = 'active' AND a.visibility_status = 'active' AND NOT EXISTS (SELECT 1 FROM locations d WHERE d.source_key = a.source_key AND d.asset_id = a.asset_id AND d.id % 3 = 2)) WHERE n = 1")
def capture_metadata_pending(locations, local_assets):
    done = locations.where("id % 3 > 0").select("source_key", "asset_id", (F.col("id") % 3).alias("version"), F.lit("UTC").alias("zone"))
    return L.pending_capture_metadata(locations, local_assets, done, 2, "UTC")


REGISTERED = "CASE WHEN checked OR captured_source IN ('file_mtime', 'scan_time') THEN {0} ELSE {1} END"


@query("local_registration", f"""WITH r AS (SELECT source_key, id AS location_id, sha1(CAST(id % 700 AS VARCHAR)) || '-' || CAST(id % 700 AS VARCHAR) AS asset_id, mtime AS t, CASE WHEN id % 5 = 0 THEN 'file_mtime' ELSE 'exif' END AS via, id % 4 = 0 AS chk, CASE WHEN id % 2 = 0 THEN 'D' || CAST(id AS VARCHAR) END AS d, id * 7919 % 10007 AS seq FROM locations WHERE id % 3 = 0),
  n AS (SELECT source_key, asset_id, min_by(location_id, seq) AS n_location, min_by(t, seq) AS n_t, min_by(via, seq) AS n_via, max_by(d, seq) FILTER (WHERE d IS NOT NULL) AS n_d FROM r GROUP BY ALL),
  o AS (SELECT source_key, sha1(CAST(id AS VARCHAR)) || '-' || CAST(id AS VARCHAR) AS asset_id, CASE WHEN id % 11 > 0 THEN id END AS primary_location_id, TIMESTAMP '1990-01-01' AS captured_at, CASE WHEN id % 2 = 0 THEN 'exif' ELSE 'scan_time' END AS captured_source, 'old' AS duration, CASE WHEN id % 7 = 0 THEN 'active' ELSE 'missing' END AS visibility_status FROM locations WHERE id < 600),
  b AS (SELECT coalesce(o.source_key, n.source_key) AS source_key, coalesce(o.asset_id, n.asset_id) AS asset_id, coalesce(primary_location_id, n_location) AS primary_location_id, coalesce(captured_at, n_t) AS captured_at, coalesce(captured_source, n_via) AS captured_source, coalesce(n_d, duration) AS duration, CASE WHEN n.asset_id IS NOT NULL THEN 'active' ELSE visibility_status END AS visibility_status, n.asset_id IS NOT NULL AS touched FROM o FULL JOIN n ON o.source_key = n.source_key AND o.asset_id = n.asset_id)
  SELECT b.source_key, b.asset_id, b.primary_location_id, strftime({REGISTERED.format('t', 'captured_at').replace('checked', 'chk')}, '%Y-%m-%d') AS captured_at, {REGISTERED.format('via', 'captured_source').replace('checked', 'chk')} AS captured_source, duration, visibility_status, touched FROM b LEFT JOIN r ON r.source_key = b.source_key AND r.asset_id = b.asset_id AND r.location_id = b.primary_location_id WHERE t IS NOT NULL
  UNION ALL SELECT source_key, asset_id, primary_location_id, strftime(captured_at, '%Y-%m-%d'), captured_source, duration, visibility_status, touched FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.source_key = b.source_key AND r.asset_id = b.asset_id AND r.location_id = b.primary_location_id)""")
def local_registration(locations):
    """Known assets with and without a primary file, with strong and weak times; reads of the primary file and of copies."""
    sha = lambda c: F.sha1(c.cast("string").cast("binary"))
    i, content = F.col("id"), F.col("id") % 700
    read = locations.where("id % 3 = 0").select("source_key", i.alias("location_id"), F.col("mtime").alias("captured_at"), F.when(i % 5 == 0, "file_mtime").otherwise("exif").alias("captured_source"), (i % 4 == 0).alias("checked"), sha(content).alias("sha1_hex"), content.alias("size_bytes"), F.lit("image").alias("media_type"), F.lit("f").alias("filename"), F.when(i % 2 == 0, F.concat(F.lit("D"), i.cast("string"))).alias("duration"), (i * 7919 % 10007).alias("seq"))
    old = locations.where("id < 600").select("source_key", S.local_asset_id(sha(i), i).alias("asset_id"), F.when(i % 11 > 0, i).alias("primary_location_id"), F.lit("1990-01-01").cast("timestamp_ntz").alias("captured_at"), F.when(i % 2 == 0, "exif").otherwise("scan_time").alias("captured_source"), F.lit("old").alias("duration"), F.when(i % 7 == 0, "active").otherwise("missing").alias("visibility_status"), F.lit("video").alias("media_type"), F.lit("g").alias("filename"), at(0).alias("updated_at"))
    found = L.registered(old, read, at(60)).withColumns({"captured_at": F.date_format("captured_at", "yyyy-MM-dd"), "touched": F.col("updated_at") == at(60)})
    return found.select("source_key", "asset_id", "primary_location_id", "captured_at", "captured_source", "duration", "visibility_status", "touched")


@query("skip_counts", """WITH c AS (SELECT root_key AS run_id, status AS reason, count(*) AS n FROM locations GROUP BY ALL) SELECT run_id, '{' || string_agg('"' || reason || '":' || CAST(n AS VARCHAR), ',' ORDER BY reason) || '}' AS skip_counts_json FROM c GROUP BY run_id""")
def skip_counts(locations):
    return L.skip_counts(locations.select(F.col("root_key").alias("run_id"), F.col("status").alias("reason")))
