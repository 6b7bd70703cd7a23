"""Timelines: pages, positions and days."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from shoebox.operators import timeline as T
from shoebox.plans.registry import query, text_time
from shoebox.request import SearchRequest, resolve

TS = "strftime(captured_at, '%Y-%m-%d %H:%M:%S')"
FILTER = SearchRequest(media_types=("Video ",), captured_from="1996-01-01T00:00:00Z", captured_to="1997-07-01T00:00:00Z", page=3, page_size=20)
WHERE = "media_type = 'video' AND captured_at >= TIMESTAMP '1996-01-01' AND captured_at < TIMESTAMP '1997-07-01'"
POSITIONS = "pos AS (SELECT *, row_number() OVER (ORDER BY captured_at DESC, canonical_asset_id) - 1 AS global_position FROM gallery)"


def shown(rows, *more):
    return rows.select("canonical_asset_id", text_time("captured_at").alias("captured_at"), "media_type", *more)


@query("timeline_page", "SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS captured_at, event_type AS media_type FROM events ORDER BY ts DESC, event_id LIMIT 60")
def timeline_page(events):
    rows = events.select(F.col("event_id").alias("id"), F.col("ts").alias("captured_at"), F.col("event_type").alias("media_type"))
    return T.page(rows, resolve(SearchRequest()), "id").withColumn("captured_at", text_time("captured_at"))


@query("timeline_filtered_page", f"SELECT canonical_asset_id, {TS} AS captured_at, media_type FROM gallery WHERE {WHERE} ORDER BY gallery.captured_at DESC, canonical_asset_id LIMIT 20 OFFSET 60")
def timeline_filtered_page(gallery):
    return shown(T.page(gallery, resolve(FILTER)))


@query("timeline_deep_page", f"SELECT canonical_asset_id, {TS} AS captured_at, media_type FROM gallery ORDER BY gallery.captured_at DESC, canonical_asset_id LIMIT 10 OFFSET 5000")
def timeline_deep_page(gallery):
    return shown(T.page(gallery, resolve(SearchRequest(page=500, page_size=10))))


@query("timeline_look_ahead", f"SELECT canonical_asset_id, {TS} AS captured_at, true AS has_more, 211 AS total, 'lowerBound' AS total_kind FROM (SELECT * FROM gallery ORDER BY captured_at DESC, canonical_asset_id LIMIT 70 OFFSET 140) AS gallery WHERE (SELECT count(*) FROM orders) > 210")
def timeline_look_ahead(gallery):
    page = T.look_ahead(gallery, resolve(SearchRequest(page=2, page_size=70)))
    return page.select("canonical_asset_id", text_time("captured_at").alias("captured_at"), "has_more", F.col("total").cast("int").alias("total"), "total_kind")


@query("page_boundaries", "SELECT source_key, page, CAST(greatest(0, least(70, n - page * 70)) AS BIGINT) AS n_items, CASE WHEN page > 0 AND n - page * 70 <= 0 THEN 'pastEnd' WHEN n > (page + 1) * 70 THEN 'more' ELSE 'end' END AS boundary FROM (SELECT source_key, n, unnest(generate_series(0, (n + 69) // 70)) AS page FROM (SELECT source_key, count(*) AS n FROM gallery GROUP BY source_key))")
def page_boundaries(gallery):
    return T.page_boundaries(gallery, 70, "source_key")


#: The canonical JSON of a request for one media type, in two parts around it.
REQUEST = resolve(SearchRequest(media_types=("video",), captured_from="2024-01-01T00:00:00Z")).canonical_json.split("video")


@query("collection_keys", f"SELECT DISTINCT media_type, 'search_v1:' || rtrim(translate(to_base64(unhex(substr(sha256('{REQUEST[0]}' || media_type || '{REQUEST[1]}'), 1, 32))), '+/', '-_'), '=') AS collection_key FROM gallery")
def collection_keys(gallery):
    from shoebox.functions.scalars import collection_key

    request = F.concat(F.lit(REQUEST[0]), "media_type", F.lit(REQUEST[1]))
    return gallery.select("media_type").distinct().select("media_type", collection_key(request).alias("collection_key"))


@query("timeline_exact_total", f"SELECT count(*) AS total FROM gallery WHERE {WHERE}")
def timeline_exact_total(gallery):
    return gallery.where(T.matches(resolve(FILTER))).agg(F.count("*").alias("total"))


@query("timeline_positions", f"WITH {POSITIONS} SELECT canonical_asset_id, global_position FROM pos")
def timeline_positions(gallery):
    return T.with_positions(gallery).select("canonical_asset_id", "global_position")


@query("timeline_seek", f"WITH {POSITIONS} SELECT canonical_asset_id, {TS} AS captured_at, media_type, global_position FROM pos WHERE global_position >= 1234 AND global_position < 1290")
def timeline_seek(gallery):
    return shown(T.seek(T.with_positions(gallery), 1234, 56), "global_position")


@query("day_histogram", "SELECT strftime(captured_at, '%Y-%m-%d') AS captured_day, count(*) AS item_count FROM gallery GROUP BY ALL")
def day_histogram(gallery):
    return T.day_index(gallery).select("captured_day", "item_count")


@query("day_starts", "WITH days AS (SELECT strftime(captured_at, '%Y-%m-%d') AS captured_day, count(*) AS item_count FROM gallery GROUP BY ALL) SELECT captured_day, item_count, CAST(coalesce(sum(item_count) OVER (ORDER BY captured_day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM days")
def day_starts(gallery):
    return T.day_index(gallery)


@query("day_at_offset", f"WITH {POSITIONS} SELECT strftime(p.captured_at, '%Y-%m-%d') AS captured_day, 7000 - (SELECT min(global_position) FROM pos q WHERE date_trunc('day', q.captured_at) = date_trunc('day', p.captured_at)) AS within FROM pos p WHERE global_position = 700 + 6300")
def day_at_offset(gallery):
    return T.day_at(T.day_index(gallery), 7000).select("captured_day", F.col("within").cast("bigint").alias("within"))


@query("day_anchored_page", f"WITH {POSITIONS} SELECT canonical_asset_id, {TS} AS captured_at, media_type FROM pos WHERE global_position >= 3000 AND global_position < 3100")
def day_anchored_page(gallery):
    return shown(T.page_by_day(gallery, T.day_index(gallery), 3000, 100))


@query("keyset_page", f"SELECT canonical_asset_id, {TS} AS captured_at, media_type FROM gallery WHERE captured_at < TIMESTAMP '1997-03-03' OR captured_at = TIMESTAMP '1997-03-03' AND canonical_asset_id >= 5000 ORDER BY gallery.captured_at DESC, canonical_asset_id LIMIT 40")
def keyset_page(gallery):
    return shown(T.keyset_page(gallery, datetime(1997, 3, 3), 5000, 40))


@query("rank_of_boundary", "SELECT count(*) AS position FROM gallery WHERE captured_at > TIMESTAMP '1996-06-15 12:00:00'")
def rank_of_boundary(gallery):
    return T.rank_of_time(gallery, T.day_index(gallery), datetime(1996, 6, 15, 12))


@query("late_payload", "SELECT o.o_orderkey AS canonical_asset_id, o.o_totalprice, o.o_orderpriority FROM orders o WHERE o.o_orderkey IN (SELECT canonical_asset_id FROM gallery ORDER BY captured_at DESC, canonical_asset_id LIMIT 50 OFFSET 100)")
def late_payload(gallery, orders):
    keys = T.page(gallery, resolve(SearchRequest(page=2, page_size=50)))
    payload = orders.select(F.col("o_orderkey").alias("canonical_asset_id"), "o_totalprice", "o_orderpriority")
    return T.late_payload(keys, payload, "canonical_asset_id")


@query("first_view_priority", "SELECT canonical_asset_id AS asset_id, CASE WHEN row_number() OVER (ORDER BY captured_at DESC, canonical_asset_id) <= 500 THEN 0 ELSE 10 END AS priority FROM gallery")
def first_view_priority(gallery):
    from shoebox.operators.queues import with_priority

    return with_priority(gallery.withColumnRenamed("canonical_asset_id", "asset_id"), 500).select("asset_id", "priority")
