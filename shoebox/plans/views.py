"""Catalog tables made from the driver tables, for Spark and, as the same text, for the SQL oracle.

{at}(x) is a time x seconds after 2024-01-01, without a zone; it is the one thing that the two dialects spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from shoebox.session import table

VIEWS = {
    # a photo library in several datasources
    "source_rows": """
SELECT d.source AS source_key, CAST(d.doc_id AS STRING) AS upstream_asset_id,
  CASE WHEN d.doc_id % 3 = 0 THEN 'local_filesystem' ELSE 'remote_mirror' END AS datasource_kind,
  CASE WHEN d.doc_id % 4 = 0 THEN 'video' ELSE 'image' END AS media_type,
  CASE WHEN d.doc_id % 13 = 0 THEN 'sha1-path' WHEN d.doc_id % 2 = 0 THEN 'sha1' ELSE '' END AS checksum_algorithm,
  CASE WHEN d.doc_id % 5 = 0 THEN upper(sha1(d.text)) ELSE sha1(d.text) END AS content_sha1_hex, d.n_chars AS content_size_bytes,
  CASE WHEN d.doc_id % 26 = 0 THEN sha1(d.text) END AS canonical_sha1_hex, CASE WHEN d.doc_id % 26 = 0 THEN d.n_chars END AS canonical_size_bytes,
  {at}(d.doc_id * 37) AS captured_at, 'IMG_' || CAST(d.doc_id AS STRING) || CASE WHEN d.doc_id % 4 = 0 THEN '.mp4' ELSE '.JPG' END AS filename,
  CASE WHEN d.doc_id % 8 = 0 THEN ' ' WHEN d.doc_id % 4 = 0 THEN '0:00:' || CAST(10 + d.doc_id % 50 AS STRING) END AS duration,
  d.text AS description, d.lang AS place_label, coalesce(l.quality = 1, false) AS is_favorite,
  CASE WHEN l.toxic = 1 THEN 'out_of_scope' WHEN d.doc_id % 29 = 0 THEN 'missing' WHEN d.doc_id % 31 = 0 THEN 'permission_blocked' ELSE 'active' END AS visibility_status,
  {at}(d.doc_id * 11) AS first_seen_at, {at}(d.doc_id * 41) AS updated_at
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    # what a timeline shows
    "gallery": "SELECT o_orderkey AS canonical_asset_id, o_orderdate AS captured_at, CASE WHEN o_custkey % 4 = 0 THEN 'video' ELSE 'image' END AS media_type, 'src' || CAST(o_custkey % 3 AS STRING) AS source_key FROM orders",
    # files below local roots
    "locations": """
SELECT o_orderkey AS id, 'local' || CAST(o_custkey % 2 AS STRING) AS source_key, 'root' || CAST(o_custkey % 5 AS STRING) AS root_key,
  'd' || CAST(o_custkey % 40 AS STRING) || '/e' || CAST(o_custkey % 3 AS STRING) || '/f' || CAST(o_orderkey AS STRING) || '.jpg' AS relative_path,
  CASE WHEN o_orderkey % 17 <> 0 THEN 'a' || CAST(o_orderkey % 4000 AS STRING) END AS asset_id,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'discovered' WHEN o_orderstatus = 'O' THEN 'active' WHEN o_orderstatus = 'F' THEN 'missing' ELSE 'permission_blocked' END AS status,
  CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, o_orderdate AS mtime, 'inode' || CAST(o_orderkey AS STRING) AS file_identity,
  CASE WHEN o_orderkey % 4 > 0 THEN {at}(o_orderkey % 1000) END AS verified_at, CASE WHEN o_orderkey % 3 > 0 THEN {at}(o_orderkey % 5000) END AS attempted_at,
  CASE WHEN o_orderkey % 9 = 0 THEN ' busy ' ELSE '' END AS status_reason
FROM orders""",
    "local_assets": "SELECT source_key, asset_id, CASE WHEN min(id) % 2 = 0 THEN 'active' ELSE 'missing' END AS visibility_status, min(id) AS primary_location_id, max(mtime) AS captured_at, CAST(NULL AS STRING) AS duration FROM locations WHERE asset_id IS NOT NULL GROUP BY source_key, asset_id",
    "roots": "SELECT source_key, root_key, CAST(count(*) % 3 AS BIGINT) AS root_generation, CASE WHEN count(*) % 2 = 0 THEN 'online' ELSE 'offline' END AS root_state FROM locations GROUP BY source_key, root_key",
    # queued work
    "jobs": """
SELECT event_id AS id, 'local' || CAST(user_id % 2 AS STRING) AS source_key, 'root' || CAST(user_id % 5 AS STRING) AS root_key, event_id * 7 % 15000 AS location_id,
  CASE WHEN event_id % 3 = 0 THEN 'thumbnail' ELSE 'metadata' END AS kind,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued' ELSE 'queued' END AS status,
  user_id % 5 AS priority, user_id % 4 AS attempts, CAST(user_id % 3 AS BIGINT) AS root_generation, ts AS scheduled_at, {at}(event_id * 13 % 9999) AS sort_at,
  CASE WHEN event_type = 'click' THEN 'worker' || CAST(user_id % 2 AS STRING) END AS owner, CASE WHEN event_type = 'click' THEN ts END AS lease_until
FROM events""",
    "index_jobs": """
SELECT event_id AS id, 'src' || CAST(user_id % 3 AS STRING) AS source_key, user_id % 5 AS priority, user_id % 4 AS attempts,
  CASE event_type WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'completed' ELSE 'queued' END AS status, ts AS scheduled_at,
  CASE WHEN event_type = 'click' AND event_id % 6 > 0 THEN ts END AS lease_until, CASE WHEN event_type = 'error' THEN 'boom' END AS last_error
FROM events""",
    # vectors of assets
    "vectors": """
SELECT vec_id AS id, 'src' || CAST(label % 3 AS STRING) AS source_key, CAST(vec_id AS STRING) AS asset_id, 'model' || CAST(label % 2 AS STRING) AS model_id,
  CASE WHEN vec_id % 7 = 0 THEN 'failed' WHEN vec_id % 11 = 0 THEN 'pending' ELSE 'ready' END AS status, embedding AS vector, {at}(vec_id * 60) AS captured_at,
  CASE WHEN vec_id % 4 = 0 THEN 'video' ELSE 'image' END AS media_type, 'c' || CAST(vec_id % 300 AS STRING) AS canonical_asset_id,
  'batch' || CAST(vec_id % 20 AS STRING) AS batch_id, vec_id % 50 * 256 AS payload_offset, CAST(256 AS BIGINT) AS payload_bytes
FROM embeddings""",
    # uploads of devices
    "uploads": """
SELECT 'u' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS upload_id, role AS device_id, CAST(conv_id AS STRING) AS source_asset_id, turn AS version,
  CASE WHEN conv_id % 5 = 0 THEN 'completed' WHEN conv_id % 5 = 1 THEN 'aborted' WHEN conv_id % 5 = 2 THEN 'failed' WHEN conv_id % 5 = 3 THEN 'uploaded' ELSE 'active' END AS status,
  {at}(conv_id * 3600) AS updated_at, {at}(conv_id * 3000) AS created_at, {at}(conv_id * 1800) AS captured_at, CASE WHEN conv_id % 3 > 0 THEN {at}(conv_id * 3600 + 86400) END AS expires_at,
  CAST(length(text) AS BIGINT) AS expected_size, CAST(length(text) % 7 * 10 AS BIGINT) AS upload_offset, CAST(1 AS BIGINT) AS epoch
FROM conversations""",
    # two snapshots of one source
    "old_rows": "SELECT o_orderkey AS id, o_orderstatus AS filename, o_totalprice AS size, 'active' AS visibility_status, {at}(0) AS updated_at FROM orders WHERE o_orderkey % 10 < 8",
    "new_rows": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS filename, CASE WHEN o_orderkey % 6 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 12 = 5 THEN NULL ELSE o_totalprice END AS size, 'active' AS visibility_status, {at}(60) AS updated_at FROM orders WHERE o_orderkey % 10 >= 2",
    # a library that has hidden and missing rows, some as the source says them now
    "stored_rows": "SELECT l_orderkey AS id, l_returnflag AS filename, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_extendedprice END AS size, CASE WHEN l_orderkey % 4 = 1 THEN 'out_of_scope' WHEN l_orderkey % 11 = 2 THEN 'missing' ELSE 'active' END AS visibility_status, {at}(CASE WHEN l_orderkey % 3 = 0 THEN 4 ELSE 1 END) AS updated_at FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 5 > 0",
    # what syncs of one source say: all of it, and a batch of it
    "line_rows": "SELECT l_orderkey AS id, l_returnflag AS filename, l_extendedprice AS size, l_orderkey * 100 + l_linenumber * 10 + CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS ord, l_partkey, l_suppkey, l_quantity, l_linenumber % 4 = 0 AS excluded, CASE WHEN l_linenumber < 4 OR l_orderkey % 7 > 0 THEN {at}(l_linenumber) END AS updated_at FROM lineitem",
}
#: What each view reads.
NEEDS = {"source_rows": ("documents", "labels"), "gallery": ("orders",), "locations": ("orders",), "local_assets": ("locations",), "roots": ("locations",), "jobs": ("events",), "index_jobs": ("events",), "vectors": ("embeddings",), "uploads": ("conversations",), "old_rows": ("orders",), "new_rows": ("orders",), "line_rows": ("lineitem",), "stored_rows": ("lineitem",)}
AT = re.compile(r"\{at\}\(")


def _at(sql: str, before: str, after: str) -> str:
    """Each {at}(...) with its own brackets, spelled for one dialect."""
    while m := AT.search(sql):
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[: m.start()]}{before}{sql[m.end() : end - 1]}{after}{sql[end:]}"
    return sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A catalog table, or a driver table."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    sql = _at(VIEWS[name], "(TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, ", "))")
    inputs = {n: view(spark, sf_dir, n) for n in NEEDS[name]}
    for n in inputs:
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **inputs)


def oracle(sql: str) -> str:
    """The SQL with the views that it names in front, for DuckDB."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for n in VIEWS:
            if re.search(rf"\b(FROM|JOIN) {n}\b", text) and n not in wanted:
                need(VIEWS[n])
                wanted.append(n)

    need(sql)
    own = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in dict.fromkeys(wanted))
    sql = sql.strip()
    start = "WITH RECURSIVE " if sql.startswith("WITH RECURSIVE ") else "WITH "
    text = sql if not own else f"{start}{own}, {sql.removeprefix(start)}" if sql.startswith(start) else f"WITH {own} {sql}"
    return _at(text, "(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(", "))")


def text_time(column: str) -> str:
    """A time as text in the oracle."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
