"""Sources, sinks and syncs: what is written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoebox.operators import order_index, timeline as T
from shoebox.plans.registry import at, query, text_time
from shoebox.plans.timeline_queries import POSITIONS
from shoebox.session import shared_dir
from shoebox.sources import exports, records, snapshots
from shoebox.streaming import window_sync


@query("generation_rebuild", f"WITH {POSITIONS} SELECT canonical_asset_id, global_position FROM pos WHERE global_position >= 500 AND global_position < 620")
def generation_rebuild(gallery):
    """A timeline is published, then rebuilt as the next generation; readers follow the pointer and seek in it."""
    store = snapshots.Snapshots(gallery.sparkSession, shared_dir(gallery.sparkSession, "timeline"))
    first = store.publish({"timeline": T.with_positions(gallery.where("media_type = 'video'"))})
    store.publish({"timeline": T.with_positions(gallery), "days": T.day_index(gallery)}, expected=first)
    return T.seek(store.read("timeline"), 500, 120).select("canonical_asset_id", "global_position")


@query("position_files", f"WITH {POSITIONS} SELECT canonical_asset_id, global_position FROM pos WHERE global_position >= 9000 AND global_position < 9060")
def position_files(gallery):
    """Files that each hold a range of positions, so that a seek skips all but one or two."""
    path = shared_dir(gallery.sparkSession, "positions")
    snapshots.write_sorted(T.with_positions(gallery), path, "global_position", 8)
    return T.seek(gallery.sparkSession.read.parquet(path), 9000, 60).select("canonical_asset_id", "global_position")


@query("positions_after_changes", "SELECT canonical_asset_id, global_position FROM (SELECT canonical_asset_id, row_number() OVER (ORDER BY captured_at DESC, canonical_asset_id) - 1 AS global_position FROM gallery WHERE canonical_asset_id % 10 > 0) WHERE global_position >= 500 AND global_position < 620")
def positions_after_changes(gallery):
    """Six tenths of the timeline, then the rest in and a tenth out: positions are kept up by the ranges that this touches."""
    store = snapshots.Snapshots(gallery.sparkSession, shared_dir(gallery.sparkSession, "order-index"))
    index = order_index.OrderIndex(store, range_rows=1000)
    index.build(gallery.where("canonical_asset_id % 10 < 6"))
    index.apply(gallery.where("canonical_asset_id % 10 >= 6"), removed=gallery.where("canonical_asset_id % 10 = 0"))
    return index.seek(500, 120).select("canonical_asset_id", "global_position")


@query("incremental_sync", "WITH b AS (SELECT o_orderkey AS id, o_orderstatus AS filename, floor(o_totalprice) AS size, 1 AS ord, false AS excluded FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, 'new', 7, 2, o_orderkey % 5 = 0 FROM orders WHERE o_orderkey % 2 = 0), l AS (SELECT id, max_by(filename, ord) FILTER (WHERE NOT excluded) AS filename, max_by(size, ord) FILTER (WHERE NOT excluded) AS size, max_by(excluded, ord) AS gone FROM b GROUP BY id) SELECT id, filename, CAST(size AS BIGINT) AS size, CASE WHEN gone THEN 'out_of_scope' ELSE 'active' END AS visibility_status FROM l WHERE filename IS NOT NULL")
def incremental_sync(orders):
    """Landed JSON pages are merged as a stream, window by window; a replayed page changes nothing."""
    spark = orders.sparkSession
    landed, store = shared_dir(spark, "landed"), snapshots.Snapshots(spark, shared_dir(spark, "library"))
    schema = "id bigint, filename string, size bigint, seq bigint, excluded boolean"
    empty = spark.createDataFrame([], "id bigint, filename string, size bigint, visibility_status string")
    store.publish({"rows": empty})
    first = orders.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("filename"), F.floor("o_totalprice").alias("size"), F.lit(1).alias("seq"), F.lit(False).alias("excluded"))
    second = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lit("new").alias("filename"), F.lit(7).alias("size"), F.lit(2).alias("seq"), (F.col("o_orderkey") % 5 == 0).alias("excluded"))
    cursor = shared_dir(spark, "cursor")
    for page in (first, second, second):
        page.write.mode("append").json(landed)
        window_sync.sync_once(spark, landed, schema, store, "rows", ["id"], ["filename", "size"], cursor)
    return store.read("rows")


@query("csv_report", "SELECT id, status, source_key FROM vectors WHERE status <> 'ready'")
def csv_report(vectors):
    """Failures as ordered CSV files with headers."""
    path = shared_dir(vectors.sparkSession, "report")
    rows = vectors.where("status <> 'ready'").select("id", "status", "source_key")
    exports.ordered_csv(rows, [F.col("status"), F.col("id")], path)
    return vectors.sparkSession.read.schema("id bigint, status string, source_key string").option("header", True).csv(path)


@query("manifest_assets", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS position, 'm' || CAST(n_nationkey AS VARCHAR) AS id, n_name AS filename FROM nation")
def manifest_assets(nation):
    """A static manifest, one small document, keeps the order of its file."""
    spark = nation.sparkSession
    path = shared_dir(spark, "manifest")
    asset = F.struct(F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("image").alias("type"), F.col("n_name").alias("originalFileName"))
    one = nation.agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), asset.alias("a")))).alias("x"))  # 25 nations
    one.select(F.lit(1).alias("version"), F.transform("x", lambda x: x["a"]).alias("assets")).write.json(path)
    return records.manifest(spark, path).select("position", "id", F.col("originalFileName").alias("filename"))


@query("snapshot_upsert", "SELECT 'a' AS key, '2024-01-01 00:01:00' AS updated_at UNION ALL SELECT 'b', '2024-01-01 00:01:00' UNION ALL SELECT 'c', '2024-01-01 00:00:00'")
def snapshot_upsert(region):
    row = region.where("r_regionkey = 0")
    old = exports.admin_snapshot(row, "b", at(0)).unionByName(exports.admin_snapshot(row, "c", at(0)))
    new = exports.admin_snapshot(row, "a", at(60)).unionByName(exports.admin_snapshot(row, "b", at(60)))
    return exports.latest_snapshots(old, new).select("key", text_time("updated_at").alias("updated_at"))
