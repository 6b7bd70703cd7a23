"""The upload ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoebox.operators import uploads as U
from shoebox.plans.registry import at, query, text_time

KEYS = "device_id, source_asset_id, version"
DAY = 86400


@query("upload_reservation", f"SELECT {KEYS}, upload_id, status FROM uploads WHERE version % 2 = 0 UNION ALL SELECT {KEYS}, min('n' || upload_id), 'active' FROM uploads WHERE version % 2 = 1 GROUP BY {KEYS}")
def upload_reservation(uploads):
    wanted = uploads.withColumn("upload_id", F.concat(F.lit("n"), "upload_id"))
    return U.reserved(uploads.where("version % 2 = 0"), wanted)


WRITE = "status = 'active' AND length(upload_id) % 2 = 0"


@query("upload_writes", f"SELECT upload_id, CASE WHEN {WRITE} THEN upload_offset + 1000 ELSE upload_offset END AS upload_offset, CASE WHEN status = 'active' AND CASE WHEN {WRITE} THEN upload_offset + 1000 ELSE upload_offset END >= expected_size THEN 'completed' ELSE status END AS status, {WRITE} AS accepted FROM uploads")
def upload_writes(uploads):
    u = uploads.withColumnRenamed("upload_offset", "offset")
    writes = u.select("upload_id", (F.col("offset") + F.length("upload_id") % 2).alias("at"), F.lit(1000).alias("n"))
    return U.advanced(u, writes).withColumnRenamed("offset", "upload_offset")


@query("upload_abort", "SELECT upload_id, CASE WHEN status = 'active' AND version = 0 THEN 'aborted' ELSE status END AS status FROM uploads")
def upload_abort(uploads):
    return U.aborted(uploads, uploads.where("version = 0")).select("upload_id", "status")


RANGE = "device_id = 'user' AND captured_at >= TIMESTAMP '2024-01-02' AND captured_at < TIMESTAMP '2024-01-04'"


@query("upload_range_reset", f"SELECT upload_id, CASE WHEN {RANGE} THEN 2 ELSE 1 END AS epoch, CASE WHEN {RANGE} THEN 'pending' ELSE status END AS status FROM uploads")
def upload_range_reset(uploads):
    return U.range_reset(uploads, "user", at(DAY), at(3 * DAY)).select("upload_id", "epoch", "status")


@query("upload_cleanup", "SELECT upload_id FROM uploads WHERE (status = 'active' AND expires_at IS NOT NULL AND expires_at <= TIMESTAMP '2024-01-11') OR (status = 'completed' AND updated_at < TIMESTAMP '2024-01-09') OR (status = 'aborted' AND updated_at < TIMESTAMP '2024-01-06') OR (status = 'failed' AND updated_at < TIMESTAMP '2024-01-10')")
def upload_cleanup(uploads):
    return uploads.where(U.removable(at(10 * DAY), 2 * DAY, 5 * DAY, DAY)).select("upload_id")


@query("upload_event_cleanup", "SELECT upload_id FROM uploads WHERE created_at < TIMESTAMP '2024-01-05' AND upload_id NOT IN (SELECT upload_id FROM uploads WHERE status = 'active') AND upload_id NOT IN (SELECT upload_id FROM uploads WHERE status = 'uploaded')")
def upload_event_cleanup(uploads):
    return U.removable_events(uploads.select("upload_id", "created_at"), uploads.where("status = 'active'"), uploads.where("status = 'uploaded'"), at(4 * DAY)).select("upload_id")


@query("upload_known", f"SELECT {KEYS}, EXISTS (SELECT 1 FROM uploads a WHERE a.status = 'uploaded' AND a.device_id = w.device_id AND a.source_asset_id = w.source_asset_id AND a.version = w.version) AS uploaded FROM uploads w")
def upload_known(uploads):
    return U.known(uploads.select("device_id", "source_asset_id", "version"), uploads)


@query("upload_devices", "SELECT device_id FROM uploads WHERE status = 'active' UNION SELECT device_id FROM uploads WHERE status = 'uploaded'")
def upload_devices(uploads):
    return U.devices(uploads.where("status = 'active'"), uploads.where("status = 'uploaded'"))


@query("last_uploads", "SELECT device_id, strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') AS last_uploaded_at FROM uploads WHERE status = 'uploaded' GROUP BY 1")
def last_uploads(uploads):
    return U.last_upload(uploads).withColumn("last_uploaded_at", text_time("last_uploaded_at"))
