"""The upload ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def reserved(uploads: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each (device_id, source_asset_id, version) once: what is there stays, of new wishes the least upload id."""
    keys = ["device_id", "source_asset_id", "version"]
    new = wanted.join(uploads, keys, "left_anti").groupBy(*keys).agg(F.min("upload_id").alias("upload_id"))
    return uploads.select(*keys, "upload_id", "status").unionByName(new.withColumn("status", F.lit("active")))


def advanced(uploads: DataFrame, writes: DataFrame) -> DataFrame:
    """Writes (upload_id, at, n) apply where the offset is still `at`; the upload is complete at its expected size."""
    both = uploads.join(writes, "upload_id", "left")
    ok = F.coalesce((F.col("status") == "active") & (F.col("offset") == F.col("at")), F.lit(False))
    both = both.select("upload_id", "expected_size", "status", ok.alias("accepted"), (F.col("offset") + F.when(ok, F.col("n")).otherwise(0)).alias("offset"))
    done = (F.col("status") == "active") & (F.col("offset") >= F.col("expected_size"))
    return both.select("upload_id", "offset", F.when(done, "completed").otherwise(F.col("status")).alias("status"), "accepted")


def aborted(uploads: DataFrame, ids: DataFrame) -> DataFrame:
    both = uploads.join(ids.select("upload_id").distinct().withColumn("stop", F.lit(True)), "upload_id", "left")
    return both.withColumn("status", F.when(F.col("stop") & (F.col("status") == "active"), "aborted").otherwise(F.col("status"))).drop("stop")


def range_reset(assets: DataFrame, device_id: str, low: Column, high: Column) -> DataFrame:
    """A device's assets of the range [low, high) are to be uploaded again, under a new epoch."""
    hit = (F.col("device_id") == device_id) & (F.col("captured_at") >= low) & (F.col("captured_at") < high)
    return assets.withColumns({"epoch": F.col("epoch") + F.when(hit, 1).otherwise(0), "status": F.when(hit, "pending").otherwise(F.col("status"))})


def removable(now: Column, completed_s: int, aborted_s: int, failed_s: int) -> Column:
    """Sessions that have run out, or ended longer ago than their kind is kept."""
    old = lambda status, s: (F.col("status") == status) & (F.col("updated_at") < now - F.make_dt_interval(secs=F.lit(s)))
    return ((F.col("status") == "active") & F.col("expires_at").isNotNull() & (F.col("expires_at") <= now)) | old("completed", completed_s) | old("aborted", aborted_s) | old("failed", failed_s)


def removable_events(events: DataFrame, sessions: DataFrame, assets: DataFrame, before: Column) -> DataFrame:
    """Old events of uploads that neither a session nor an asset needs; null ids are needed by none."""
    old = events.where(F.col("created_at") < before)
    return old.join(sessions.select("upload_id"), "upload_id", "left_anti").join(assets.select("upload_id"), "upload_id", "left_anti")


def known(wanted: DataFrame, assets: DataFrame) -> DataFrame:
    """Each wanted identity with whether it was uploaded before."""
    keys = ["device_id", "source_asset_id", "version"]
    have = assets.where(F.col("status") == "uploaded").select(*keys).distinct().withColumn("have", F.lit(True))
    return wanted.join(have, keys, "left").select(*keys, F.coalesce("have", F.lit(False)).alias("uploaded"))


def devices(sessions: DataFrame, assets: DataFrame) -> DataFrame:
    return sessions.select("device_id").union(assets.select("device_id")).distinct()


def last_upload(assets: DataFrame) -> DataFrame:
    return assets.where(F.col("status") == "uploaded").groupBy("device_id").agg(F.max("updated_at").alias("last_uploaded_at"))
