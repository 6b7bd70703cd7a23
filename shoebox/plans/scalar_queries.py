"""Scalar rules, record decoding and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoebox.functions import scalars as S
from shoebox.plans.registry import at, query, text_time
from shoebox.sources import exports, records


@query("timestamp_texts", "SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS text FROM events")
def timestamp_texts(events):
    return events.select(F.col("event_id").alias("id"), S.timestamp_text(F.col("ts")).alias("text"))


@query("rank_maps", "SELECT DISTINCT visibility_status, CASE visibility_status WHEN 'active' THEN 0 WHEN 'permission_blocked' THEN 1 WHEN 'out_of_scope' THEN 2 WHEN 'missing' THEN 3 ELSE 4 END AS v, CASE datasource_kind WHEN 'local_filesystem' THEN 0 WHEN 'remote_mirror' THEN 1 ELSE 2 END AS d FROM source_rows")
def rank_maps(source_rows):
    return source_rows.select("visibility_status", S.rank_of(F.col("visibility_status"), S.VISIBILITY_RANKS).alias("v"), S.rank_of(F.col("datasource_kind"), S.DATASOURCE_RANKS).alias("d")).distinct()


@query("sha1_normalised", "SELECT upstream_asset_id, CASE WHEN CAST(upstream_asset_id AS BIGINT) % 4 = 0 THEN '' ELSE lower(content_sha1_hex) END AS sha FROM source_rows")
def sha1_normalised(source_rows):
    raw = F.when(F.col("upstream_asset_id").cast("bigint") % 4 == 0, F.substring("content_sha1_hex", 1, 39)).otherwise(F.concat(F.lit(" \t"), "content_sha1_hex", F.lit("\n")))
    return source_rows.select("upstream_asset_id", S.sha1_hex(raw).alias("sha"))


@query("place_labels", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN n_name || ', ' || r_name WHEN s_suppkey % 3 = 1 THEN n_name ELSE n_name || ', x, ' || r_name END AS label FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def place_labels(supplier, nation, region):
    rows = supplier.join(F.broadcast(nation), F.col("n_nationkey") == F.col("s_nationkey")).join(F.broadcast(region), F.col("r_regionkey") == F.col("n_regionkey"))  # 25 and 5 rows
    kind = F.col("s_suppkey") % 3
    middle = F.when(kind == 0, F.lit("  ")).when(kind == 1, F.lower("n_name")).otherwise(F.lit(" x\t"))
    return rows.select("s_suppkey", S.place_label(F.col("n_name"), middle, F.when(kind != 1, F.col("r_name"))).alias("label"))


@query("day_and_tail", "SELECT event_id AS id, substr(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 1, 10) AS captured_day, substr(props, -3) AS tail, least(event_id, user_id) AS low, CASE WHEN user_id % 2 = 0 THEN greatest(event_id, user_id) END AS high FROM events")
def day_and_tail(events):
    u = F.when(F.col("user_id") % 2 == 0, F.col("user_id"))
    return events.select(F.col("event_id").alias("id"), F.substring(S.timestamp_text(F.col("ts")), 1, 10).alias("captured_day"), F.substring("props", -3, 3).alias("tail"), F.least("event_id", "user_id").alias("low"), S.greater(F.col("event_id"), u).alias("high"))


@query("duration_texts", "SELECT o_orderkey AS id, printf('%d:%02d:%02d.%06d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000 * 1000) AS long, printf('%d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS short FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 40) AS BIGINT) AS ms FROM orders)")
def duration_texts(orders):
    ms = F.floor(F.col("o_totalprice") * 40)
    return orders.select(F.col("o_orderkey").alias("id"), S.duration_text(ms).alias("long"), S.duration_text(ms, 3).alias("short"))


@query("local_ids", "SELECT id, sha1(relative_path) || '-' || CAST(size_bytes AS VARCHAR) AS asset_id, CAST(size_bytes AS VARCHAR) || ':' || strftime(mtime, '%Y-%m-%dT%H:%M:%S') || '.000000000Z' AS signature FROM locations")
def local_ids(locations):
    return locations.select("id", S.local_asset_id(F.sha1(F.col("relative_path").cast("binary")), F.col("size_bytes")).alias("asset_id"), S.fast_signature(F.col("size_bytes"), F.col("mtime")).alias("signature"))


@query("input_fingerprints", "SELECT id, sha256('v1' || chr(0) || status || chr(0) || source_key || chr(0) || coalesce(asset_id, '') || chr(0) || sha1(relative_path) || chr(0) || CAST(size_bytes AS VARCHAR) || chr(0)) AS fingerprint FROM locations")
def input_fingerprints(locations):
    f = S.input_fingerprint(F.lit("v1"), F.concat(F.lit(" "), "status"), F.col("source_key"), F.col("asset_id"), F.upper(F.sha1(F.col("relative_path").cast("binary"))), F.col("size_bytes"), F.lit(None).cast("string"))
    return locations.select("id", F.sha2(f, 256).alias("fingerprint"))


@query("retry_delays", "SELECT id, CAST(least(30 * pow(2, least(greatest(id % 12, 1) - 1, 20)), 1800) AS BIGINT) AS seconds FROM jobs")
def retry_delays(jobs):
    return jobs.select("id", S.retry_delay(F.col("id") % 12).alias("seconds"))


@query("clean_paths", "SELECT id, CASE WHEN id % 6 = 0 THEN relative_path END AS path FROM locations")
def clean_paths(locations):
    bad = F.element_at(F.array(F.lit("/"), F.lit("../"), F.lit("a//"), F.lit("./"), F.lit("b/../")), (F.col("id") % 6).cast("int"))
    return locations.select("id", S.clean_relative_path(F.when(F.col("id") % 6 == 0, F.col("relative_path")).otherwise(F.concat(bad, "relative_path"))).alias("path"))


TAG = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


@query("capture_times", f"SELECT event_id AS id, {TAG.format('''CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) + INTERVAL 250 MILLISECOND WHEN 1 THEN date_trunc('second', ts) - INTERVAL 90 MINUTE WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('second', ts) - INTERVAL 1 HOUR ELSE TIMESTAMP '2024-01-01' END''')} AS captured_at FROM events WHERE ts < TIMESTAMP '2024-03-01'")
def capture_times(events):
    kind = F.col("event_id") % 6
    value = F.when(kind == 0, F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).when(kind < 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(kind == 4, "1904-01-01T00:00:00Z").otherwise("no date at all, yes")
    sub, offset = F.when(kind == 0, "25"), F.when(kind == 0, "Z").when(kind == 1, "+01:30").when(kind == 2, "+0000")
    source = F.when(kind == 0, "exif_original").otherwise("quicktime_creationdate")
    found = S.capture_time(value, sub, offset, source, F.lit("Europe/Paris"))
    return events.where("ts < TIMESTAMP_NTZ'2024-03-01'").select(F.col("event_id").alias("id"), F.date_format(S.first_capture_time(F.array(found), at(0)), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("captured_at"))


def json_records(events):
    """Records as a remote library sends them, their numbers and times in several forms."""
    i, k = F.col("event_id"), F.col("event_id") % 4
    time = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    sha = F.sha1(i.cast("string").cast("binary"))
    size, quoted = i.cast("string"), F.concat(F.lit('"'), i.cast("string"), F.lit('"'))
    return events.select(i.alias("i"), F.concat(F.lit('{"id":"'), size, F.lit('","type":"IMAGE","originalFileName":"f.jpg","checksum":"'), F.when(k == 0, F.base64(F.unhex(sha))).when(k == 1, F.upper(sha)).otherwise("?"), F.lit('","fileCreatedAt":"'), time, F.lit('","duration":'), F.when(k == 0, F.lit("61001")).when(k == 1, F.lit('"0:00:07"')).otherwise("null"), F.lit(',"isFavorite":'), F.when(k == 2, "true").otherwise('"false"'), F.lit(',"exifInfo":{"city":"Rome","state":"rome ","country":"Italy","fileSizeInByte":'), F.when(k == 3, quoted).otherwise(size), F.lit("}}")).alias("value"))


@query("decoded_records", """SELECT CAST(event_id AS VARCHAR) AS upstream_asset_id, 'image' AS media_type, CASE WHEN event_id % 4 < 2 THEN sha1(CAST(event_id AS VARCHAR)) ELSE '' END AS content_sha1_hex, event_id AS content_size_bytes, CASE WHEN event_id % 4 < 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS captured_at,
  CASE event_id % 4 WHEN 0 THEN '0:01:01.001' WHEN 1 THEN '0:00:07' END AS duration, event_id % 4 = 2 AS is_favorite, 'Rome, Italy' AS place_label FROM events""")
def decoded_records(events):
    found = records.decoded(json_records(events))
    return found.select("upstream_asset_id", "media_type", "content_sha1_hex", "content_size_bytes", text_time("captured_at").alias("captured_at"), "duration", "is_favorite", "place_label")


PAGES = "(SELECT event_id // 90 AS page, event_id AS id, ts AS updated_at, event_type FROM events UNION ALL SELECT event_id // 90 + 1, event_id, ts, event_type || '!' FROM events WHERE event_id % 90 > 80)"


@query("paged_export", f"SELECT id, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at, min(page) AS page, min_by(event_type, page) AS event_type FROM {PAGES} GROUP BY id, updated_at")
def paged_export(events):
    own = events.select(F.floor(F.col("event_id") / 90).alias("page"), F.col("event_id").alias("id"), F.col("ts").alias("updated_at"), "event_type")
    again = own.where("id % 90 > 80").withColumns({"page": F.col("page") + 1, "event_type": F.concat("event_type", F.lit("!"))})
    return records.paged_export(own.unionByName(again)).withColumn("updated_at", text_time("updated_at"))


@query("boundary_overflow", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def boundary_overflow(orders):
    pages = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"))
    return records.boundary_overflow(pages, 12).select(F.date_format("updated_at", "yyyy-MM-dd").alias("day"), "n")


@query("admin_snapshots", "SELECT 'visibility' AS key, '{\"n\":' || CAST(count(*) AS VARCHAR) || ',\"visibility_status\":\"' || visibility_status || '\"}' AS payload_json FROM source_rows GROUP BY visibility_status")
def admin_snapshots(source_rows):
    from shoebox.operators.status import histogram

    return exports.admin_snapshot(histogram(source_rows, "visibility_status"), "visibility", at(0)).select("key", "payload_json")


HEX = "hex(CAST(x::FLOAT::BIT AS BLOB))"  # high byte first


CHECKSUMS = f"SELECT vec_id, len(embedding) AS dim, sha256(unhex(list_aggregate(list_transform(embedding, lambda x: substr({HEX}, 7, 2) || substr({HEX}, 5, 2) || substr({HEX}, 3, 2) || substr({HEX}, 1, 2)), 'string_agg', ''))) AS checksum FROM embeddings"


@query("vector_checksums", CHECKSUMS)
def vector_checksums(embeddings):
    return exports.vector_checksums(embeddings, "vec_id", "embedding")


@query("optional_source_filter", "SELECT id FROM locations WHERE source_key = 'local1' AND status = 'active'")
def optional_source_filter(locations):
    source = "local1"  # an empty name would be no filter
    cond = F.col("status") == "active"
    return locations.where(cond & (F.col("source_key") == source) if source else cond).select("id")


@query("payload_round_trip", CHECKSUMS)
def payload_round_trip(embeddings):
    """Vectors packed into batches, and read back from their byte ranges."""
    from shoebox.sources import payloads
    from shoebox.session import shared_dir

    spark, path = embeddings.sparkSession, shared_dir(embeddings.sparkSession, "payloads")
    rows, batches = payloads.packed(embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    rows.write.parquet(f"{path}/rows")
    batches.write.parquet(f"{path}/batches")
    found = payloads.fetched(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/batches")).where("intact")
    return exports.vector_checksums(found.select(F.col("id").alias("vec_id"), F.col("vector").alias("embedding")), "vec_id", "embedding")
