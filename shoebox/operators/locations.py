"""Files of local roots: what a scan found against what is stored, and the assets behind the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shoebox.functions import scalars as S

#: Sources of a capture time that any read of the primary location may replace.
WEAK_TIMES = ("file_mtime", "scan_time")


def changed_directories(seen: DataFrame, stored: DataFrame) -> DataFrame:
    """(directory, change): new and modified directories, and those that had been blocked; stored ones not seen are gone."""
    both = seen.select("directory", F.col("mtime").alias("now")).join(stored.select("directory", F.col("mtime").alias("before"), "blocked"), "directory", "full_outer")
    change = F.when(F.col("now").isNull(), "removed").when(F.col("before").isNull(), "new").when(~F.col("now").eqNullSafe(F.col("before")), "modified").when(F.coalesce("blocked", F.lit(False)), "retry")
    return both.select("directory", change.alias("change")).where("change IS NOT NULL")


def files_to_read(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Files of the directories that a quick scan has to look into."""
    return files.join(changes.where("change <> 'removed'"), "directory", "left_semi")


def located(seen: DataFrame, stored: DataFrame) -> DataFrame:
    """What becomes of each path that a scan saw, by (source_key, root_key, relative_path).

    The same size, time, signature and identity: active and discovered rows are touched (discovered ones stay queued),
    hidden ones with an asset are restored, others start over. Something else there: a missing row stays and a new one
    comes beside it, others start over. Of several stored rows of a path one that is not missing is meant, then the newest.
    """
    keys = ["source_key", "root_key", "relative_path"]
    pick = F.row_number().over(Window.partitionBy(*keys).orderBy(F.when(F.col("status") == "missing", 1).otherwise(0), F.col("id").desc()))
    own = stored.withColumn("n", pick).where("n = 1")
    mine = [F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("size_bytes", "mtime", "file_identity")]
    both = seen.alias("s").join(own.alias("o"), keys, "left")
    has_asset = F.coalesce(F.col("o.asset_id"), F.lit("")) != ""
    same = S.all_of(mine)
    action = (
        F.when(F.col("o.id").isNull(), "insert")
        .when(same & (F.col("o.status") == "active"), "touch")
        .when(same & F.col("o.status").isin("missing", "permission_blocked") & has_asset, "restore")
        .when(same & (F.col("o.status") == "discovered"), "touch_queue")
        .when(same, "reset")
        .when(F.col("o.status") == "missing", "insert")
        .otherwise("reset")
    )
    queue = action.isin("insert", "touch_queue", "reset")
    return both.select(*keys, F.when(action != "insert", F.col("o.id")).alias("id"), action.alias("action"), queue.alias("queue_metadata"), ((action.isin("restore", "reset")) & has_asset).alias("visibility_dirty"))


def absent_locations(seen: DataFrame, stored: DataFrame, blocked: DataFrame) -> DataFrame:
    """Stored paths that were not seen and do not lie in a directory that could not be read (directory)."""
    gone = stored.where(F.col("status") != "missing").join(seen, ["source_key", "root_key", "relative_path"], "left_anti")
    parts = F.split("relative_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    inside = gone.withColumn("above", F.explode(above)).join(blocked, F.col("above") == F.col("directory"), "left_semi").select("id").distinct()
    return gone.join(inside, "id", "left_anti")


def marked(stored: DataFrame, ids: DataFrame, status: str) -> tuple[DataFrame, DataFrame]:
    """The snapshot with the ids' status set, and the rows that this changed (id, relative_path, asset_id)."""
    affected = stored.join(ids, "id", "left_semi").where(F.col("status") != status)
    kept = stored.join(affected.select("id"), "id", "left_anti")
    return kept.unionByName(affected.withColumn("status", F.lit(status))), affected.select("id", "relative_path", "asset_id")


def asset_visibility(locations: DataFrame) -> DataFrame:
    """Of each asset: active with its best active location, else permission_blocked if any location is, else missing."""
    active = F.col("status") == "active"
    best = F.struct((-F.coalesce(F.unix_micros(F.col("verified_at").cast("timestamp")), F.lit(-(2**62)))).alias("v"), (-F.unix_micros(F.col("mtime").cast("timestamp"))).alias("m"), "root_key", "relative_path", "id")
    found = locations.where(F.coalesce("asset_id", F.lit("")) != "").groupBy("source_key", "asset_id").agg(
        F.min_by(F.when(active, F.col("id")), F.when(active, best)).alias("primary_location_id"), F.max(active.cast("int")).alias("a"), F.max((F.col("status") == "permission_blocked").cast("int")).alias("b")
    )
    status = F.when(F.col("a") == 1, "active").when(F.col("b") == 1, "permission_blocked").otherwise("missing")
    return found.select("source_key", "asset_id", status.alias("visibility_status"), "primary_location_id")


def visibility_changes(assets: DataFrame, locations: DataFrame) -> DataFrame:
    """Assets whose stored (visibility_status, primary_location_id) is not what their locations say, with the new values."""
    new = asset_visibility(locations).withColumnsRenamed({"visibility_status": "new_status", "primary_location_id": "new_location"})
    both = assets.join(new, ["source_key", "asset_id"], "left").withColumn("new_status", F.coalesce("new_status", F.lit("missing")))
    return both.where((F.col("visibility_status") != F.col("new_status")) | ~F.col("primary_location_id").eqNullSafe(F.col("new_location"))).select("source_key", "asset_id", "new_status", "new_location")


def registered(assets: DataFrame, read: DataFrame, now: Column) -> DataFrame:
    """Assets after metadata was read (source_key, location_id, sha1_hex, size_bytes, media_type, filename, captured_at,
    captured_source, checked, duration, seq), in the order of seq; an asset's id is that of its content. Of several reads of
    one location with one content the last counts.

    A new asset is what its first read says. Any read makes an asset active, gives it its duration, unless that is null, and
    a primary location if it has none. Only a read of the primary location changes the capture time that is there: if it
    was checked, or while the stored time is just that of the file or of the scan.
    """
    key = ["source_key", "asset_id"]
    told = ("media_type", "filename", "captured_at", "captured_source", "checked", "duration", "seq")
    new = read.withColumn("asset_id", S.local_asset_id(F.col("sha1_hex"), F.col("size_bytes")))
    new = new.groupBy(*key, "location_id").agg(F.max_by(F.struct(*told), "seq").alias("r")).select(*key, "location_id", "r.*")
    each = new.groupBy(*key).agg(F.min_by(F.struct("location_id", *told), "seq").alias("first"), F.max_by("duration", F.when(F.col("duration").isNotNull(), F.col("seq"))).alias("n_duration"))
    both = assets.join(each, key, "full_outer").withColumn("primary_location_id", F.coalesce("primary_location_id", "first.location_id"))
    had, is_read = F.col("visibility_status").isNotNull(), F.col("first").isNotNull()
    both = both.withColumns({c: F.when(had, F.col(c)).otherwise(F.col(f"first.{c}")) for c in ("media_type", "filename", "captured_at", "captured_source")})
    of_primary = new.select(*key, F.col("location_id").alias("primary_location_id"), F.struct("captured_at", "captured_source", "checked").alias("own"))
    both = both.join(of_primary, [*key, "primary_location_id"], "left")
    take = F.col("own").isNotNull() & (F.col("own.checked") | F.col("captured_source").isin(*WEAK_TIMES))
    out = {c: F.when(take, F.col(f"own.{c}")).otherwise(F.col(c)) for c in ("captured_at", "captured_source")}
    out |= {"visibility_status": F.when(is_read, "active").otherwise(F.col("visibility_status")), "duration": F.coalesce("n_duration", "duration"), "updated_at": F.when(is_read, now).otherwise(F.col("updated_at"))}
    return both.select(*(out[c].alias(c) if c in out else F.col(c) for c in assets.columns))


def diagnostics(locations: DataFrame, roots: DataFrame, assets: DataFrame) -> DataFrame:
    """Every location with its root's state and asset, and why it is as it is."""
    given = S.trimmed(F.coalesce("status_reason", F.lit("")))
    reason = F.when(given != "", given).otherwise(reason_of(F.col("status")))
    a = assets.select("source_key", "asset_id", F.col("visibility_status").alias("asset_status"))
    both = locations.join(roots, ["source_key", "root_key"], "left").join(a, ["source_key", "asset_id"], "left")
    return both.select("source_key", "root_key", "relative_path", "id", "status", reason.alias("reason"), "root_state", "asset_status")


def reason_of(status: Column) -> Column:
    names = {"active": "active", "discovered": "metadata_pending", "missing": "phase0_absent", "permission_blocked": "phase0_read_error", "failed": "failed"}
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), S.trimmed(status)), S.trimmed(status))


def pending_capture_metadata(locations: DataFrame, assets: DataFrame, done: DataFrame, version: int, zone: str) -> DataFrame:
    """(source_key, asset_id, root_key, location_id) of active assets that were not read by this version and zone yet, with
    the location of each root to read: the asset's primary one if it is active there, else the least id that is."""
    todo = assets.where(F.col("visibility_status") == "active").join(done.where((F.col("version") == version) & (F.col("zone") == zone)), ["source_key", "asset_id"], "left_anti")
    rows = locations.where(F.col("status") == "active").select("source_key", "asset_id", "root_key", "id").join(todo.select("source_key", "asset_id", "primary_location_id"), ["source_key", "asset_id"])
    order = F.struct((~F.col("id").eqNullSafe(F.col("primary_location_id"))).alias("other"), "id")
    return rows.groupBy("source_key", "asset_id", "root_key").agg(F.min_by("id", order).alias("location_id"))


def skip_counts(skipped: DataFrame) -> DataFrame:
    """(run_id, skip_counts_json): how often each reason was met, as a JSON object with sorted names."""
    counts = skipped.groupBy("run_id", "reason").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("reason", "n")))
    return counts.groupBy("run_id").agg(F.to_json(F.map_from_entries(pairs)).alias("skip_counts_json"))
