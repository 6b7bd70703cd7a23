"""Canonical de-duplication over a library in several datasources."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoebox.functions import scalars as S
from shoebox.operators import canonical as C, projection, timeline as T
from shoebox.plans.registry import query, text_time
from shoebox.session import shared_dir

#: The canonical id in SQL: NUL-ended parts of the content, or of the key.
CA = """CASE WHEN ok THEN 'ca1_' || sha256('content' || chr(0) || media_type || chr(0) || lower(sha) || chr(0) || CAST(size AS VARCHAR) || chr(0))
    ELSE 'ca1_' || sha256('source' || chr(0) || source_key || chr(0) || upstream_asset_id || chr(0)) END"""
LINKED = f"""ident AS (SELECT *, CASE WHEN canonical_sha1_hex IS NOT NULL AND canonical_size_bytes > 0 THEN canonical_sha1_hex WHEN checksum_algorithm IN ('', 'sha1') THEN content_sha1_hex END AS sha,
    CASE WHEN canonical_sha1_hex IS NOT NULL AND canonical_size_bytes > 0 THEN canonical_size_bytes WHEN checksum_algorithm IN ('', 'sha1') THEN content_size_bytes END AS size FROM source_rows),
  linked AS (SELECT *, {CA} AS canonical_asset_id,
    CASE visibility_status WHEN 'active' THEN 0 WHEN 'permission_blocked' THEN 1 WHEN 'out_of_scope' THEN 2 WHEN 'missing' THEN 3 ELSE 4 END AS vr, CASE datasource_kind WHEN 'local_filesystem' THEN 0 WHEN 'remote_mirror' THEN 1 ELSE 2 END AS dr
    FROM (SELECT *, sha IS NOT NULL AND size > 0 AS ok FROM ident))"""
CANON = f"""{LINKED},
  firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_asset_id ORDER BY vr, dr, captured_at DESC, source_key, upstream_asset_id) AS n FROM linked) WHERE n = 1),
  durations AS (SELECT canonical_asset_id, duration AS other FROM (SELECT *, row_number() OVER (PARTITION BY canonical_asset_id ORDER BY vr, dr, captured_at DESC, source_key, upstream_asset_id) AS n FROM linked WHERE visibility_status = 'active' AND trim(coalesce(duration, '')) <> '') WHERE n = 1),
  folded AS (SELECT canonical_asset_id, count(*) AS source_count, bool_or(is_favorite) AS is_favorite, min(first_seen_at) AS first_seen_at FROM linked GROUP BY canonical_asset_id),
  canon AS (SELECT f.canonical_asset_id, f.source_key AS primary_source_key, f.upstream_asset_id AS primary_upstream_asset_id, f.media_type, f.filename, f.captured_at,
    CASE WHEN trim(coalesce(f.duration, '')) = '' THEN coalesce(d.other, f.duration) ELSE f.duration END AS duration, f.visibility_status, f.datasource_kind, f.sha AS content_sha1_hex, f.size AS content_size_bytes, g.source_count, g.source_count - 1 AS duplicate_source_count, g.is_favorite, g.first_seen_at
    FROM firsts f JOIN folded g USING (canonical_asset_id) LEFT JOIN durations d USING (canonical_asset_id))"""


@query("canonical_ids", f"WITH {LINKED} SELECT source_key, upstream_asset_id, canonical_asset_id FROM linked")
def canonical_ids(source_rows):
    return C.with_canonical_ids(source_rows).select(*C.KEY, "canonical_asset_id")


@query("canonical_assets", f"WITH {CANON} SELECT canonical_asset_id, primary_source_key, primary_upstream_asset_id, media_type, filename, duration, visibility_status, content_sha1_hex, content_size_bytes, source_count, duplicate_source_count, is_favorite, strftime(captured_at, '%Y-%m-%d %H:%M:%S') AS captured_at, strftime(first_seen_at, '%Y-%m-%d %H:%M:%S') AS first_seen_at FROM canon")
def canonical_assets(source_rows):
    c = C.canonical_assets(C.with_canonical_ids(source_rows))
    return c.select("canonical_asset_id", "primary_source_key", "primary_upstream_asset_id", "media_type", "filename", "duration", "visibility_status", "content_sha1_hex", "content_size_bytes", "source_count", "duplicate_source_count", "is_favorite", text_time("captured_at").alias("captured_at"), text_time("first_seen_at").alias("first_seen_at"))


@query("canonical_refresh", f"WITH {CANON} SELECT canonical_asset_id, primary_source_key, primary_upstream_asset_id, content_sha1_hex, content_size_bytes, source_count, is_favorite, strftime(first_seen_at, '%Y-%m-%d %H:%M:%S') AS first_seen_at FROM canon")
def canonical_refresh(source_rows):
    """Affected ids worked out anew after a change equal a full recomputation."""
    rows = C.with_canonical_ids(source_rows)
    before = C.canonical_assets(rows.withColumn("is_favorite", F.lit(False)))
    c = C.refreshed(before, rows, rows.where("is_favorite"))
    return c.select("canonical_asset_id", "primary_source_key", "primary_upstream_asset_id", "content_sha1_hex", "content_size_bytes", "source_count", "is_favorite", text_time("first_seen_at").alias("first_seen_at"))


@query("primary_sources", f"WITH {CANON} SELECT source_key, upstream_asset_id, canonical_asset_id, source_count FROM firsts JOIN folded USING (canonical_asset_id)")
def primary_sources(source_rows):
    rows = C.with_canonical_ids(source_rows)
    return C.primary_sources(rows, C.canonical_assets(rows)).select(*C.KEY, "canonical_asset_id", "source_count")


@query("copies_of_named", f"WITH {LINKED} SELECT a.source_key AS named_source, a.upstream_asset_id AS named_id, a.canonical_asset_id, b.source_key, b.upstream_asset_id FROM linked a JOIN linked b ON a.canonical_asset_id = b.canonical_asset_id WHERE CAST(a.upstream_asset_id AS BIGINT) % 5 = 0 AND b.visibility_status = 'active' AND b.datasource_kind = 'remote_mirror'")
def copies_of_named(source_rows):
    rows = C.with_canonical_ids(source_rows)
    return C.copies_of(rows, rows.where("CAST(upstream_asset_id AS BIGINT) % 5 = 0").select(*C.KEY))


@query("deduplication_status", f"WITH {CANON} SELECT (SELECT count(*) FROM linked) AS source_rows, count(*) AS canonical_assets, count(*) FILTER (WHERE visibility_status = 'active') AS active_assets, CAST(coalesce(sum(duplicate_source_count), 0) AS BIGINT) AS duplicate_source_rows, 0 AS unlinked_source_rows, 0 AS orphan_canonical_rows, false AS needs_repair FROM canon")
def deduplication_status(source_rows):
    rows = C.with_canonical_ids(source_rows)
    return C.deduplication_status(rows, C.canonical_assets(rows))


@query("unlinked_rows", f"WITH {LINKED} SELECT source_key, upstream_asset_id FROM linked l WHERE NOT EXISTS (SELECT 1 FROM linked a WHERE a.canonical_asset_id = l.canonical_asset_id AND a.visibility_status = 'active')")
def unlinked_rows(source_rows):
    """Rows whose canonical asset is not among those built from active rows."""
    rows = C.with_canonical_ids(source_rows)
    return rows.join(C.canonical_assets(rows.where("visibility_status = 'active'")), "canonical_asset_id", "left_anti").select(*C.KEY)


@query("repair_flag", f"WITH {LINKED} SELECT EXISTS (SELECT 1 FROM linked l WHERE NOT EXISTS (SELECT 1 FROM linked a WHERE a.canonical_asset_id = l.canonical_asset_id AND a.visibility_status = 'active')) AS needs_repair")
def repair_flag(source_rows):
    rows = C.with_canonical_ids(source_rows)
    return C.needs_repair(rows, C.canonical_assets(rows.where("visibility_status = 'active'")))


@query("displayed_sources", f"WITH {LINKED} SELECT canonical_asset_id, source_key, upstream_asset_id FROM (SELECT *, row_number() OVER (PARTITION BY canonical_asset_id ORDER BY source_key, upstream_asset_id) AS n FROM linked WHERE source_key IN ('src0', 'src1', 'src2') AND visibility_status = 'active') WHERE n = 1")
def displayed_sources(source_rows):
    return C.displayed_source(C.with_canonical_ids(source_rows), ["src0", "src1", "src2"]).select("canonical_asset_id", *C.KEY)


@query("preferred_sources", f"WITH {LINKED} SELECT canonical_asset_id, source_key, upstream_asset_id FROM (SELECT *, row_number() OVER (PARTITION BY canonical_asset_id ORDER BY dr, source_key, upstream_asset_id) AS n FROM linked WHERE visibility_status = 'active') WHERE n = 1")
def preferred_sources(source_rows):
    return C.preferred_source(C.with_canonical_ids(source_rows)).select("canonical_asset_id", *C.KEY)


@query("linked_asset_count", f"WITH {LINKED} SELECT count(DISTINCT canonical_asset_id) AS n FROM linked WHERE source_key IN ('src0', 'src3') AND visibility_status = 'active'")
def linked_asset_count(source_rows):
    from shoebox.operators.status import linked_assets

    return linked_assets(C.with_canonical_ids(source_rows), ["src0", "src3"])


def renditions(rows):
    """Renditions of some local rows: two kinds for even ids, one for the others, some of other content."""
    local = rows.where("datasource_kind = 'local_filesystem'").withColumn("i", F.col("upstream_asset_id").cast("bigint"))
    kinds = F.when(F.col("i") % 2 == 0, F.array(F.lit("preview"), F.lit("detail_preview"))).otherwise(F.array(F.lit("detail_preview")))
    sha = F.when(F.col("i") % 10 == 0, F.lit("old")).otherwise(F.lower("content_sha1_hex"))
    return local.select("source_key", F.col("upstream_asset_id").alias("asset_id"), F.explode(kinds).alias("kind"), sha.alias("source_sha1_hex"), F.when(F.col("i") % 7 == 0, "failed").otherwise("ready").alias("status"), F.when(F.col("i") % 9 > 0, F.lit("p")).when(F.col("i") % 2 > 0, F.lit(" ")).alias("relative_path"))


REND = """rend AS (SELECT source_key, upstream_asset_id AS asset_id, unnest(CASE WHEN i % 2 = 0 THEN ['preview', 'detail_preview'] ELSE ['detail_preview'] END) AS kind, CASE WHEN i % 10 = 0 THEN 'old' ELSE lower(content_sha1_hex) END AS source_sha1_hex,
    CASE WHEN i % 7 = 0 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN i % 9 > 0 THEN 'p' WHEN i % 2 > 0 THEN ' ' END AS relative_path FROM (SELECT *, CAST(upstream_asset_id AS BIGINT) AS i FROM source_rows WHERE datasource_kind = 'local_filesystem'))"""


def local_states(rows):
    """The local assets behind local rows; of some the file is gone, was changed, or has no thumbnail yet."""
    i = F.col("upstream_asset_id").cast("bigint")
    sha = F.when(i % 16 == 0, F.lit("new")).otherwise(F.lower("content_sha1_hex"))
    return rows.where("datasource_kind = 'local_filesystem'").select("source_key", F.col("upstream_asset_id").alias("asset_id"), sha.alias("sha1_hex"), F.when(i % 14 == 0, "missing").otherwise("active").alias("visibility_status"), F.when(i % 22 == 0, "pending").otherwise("ready").alias("thumbnail_status"))


LOCAL = """loc AS (SELECT source_key, upstream_asset_id AS asset_id, CASE WHEN i % 16 = 0 THEN 'new' ELSE lower(content_sha1_hex) END AS sha1_hex, CASE WHEN i % 14 = 0 THEN 'missing' ELSE 'active' END AS visibility_status,
    CASE WHEN i % 22 = 0 THEN 'pending' ELSE 'ready' END AS thumbnail_status FROM (SELECT *, CAST(upstream_asset_id AS BIGINT) AS i FROM source_rows WHERE datasource_kind = 'local_filesystem'))"""
#: Which datasources show assets, as what, and which local ones fall back to remote copies.
ROLES = {"local": range(12), "remote": range(3, 17), "local_fallback": range(0, 20, 3)}
CONFIGURED = "(VALUES " + ", ".join(f"('{role}', 'src{n}')" for role, own in ROLES.items() for n in own) + ")"


@query("ready_assets", f"""WITH {CANON}, {REND}, {LOCAL}, configured(role, source_key) AS {CONFIGURED},
  ranked AS (SELECT l.canonical_asset_id, l.source_key, l.upstream_asset_id, l.datasource_kind, row_number() OVER (PARTITION BY l.canonical_asset_id ORDER BY CASE l.datasource_kind WHEN 'local_filesystem' THEN 0 ELSE 1 END, l.source_key, l.upstream_asset_id) AS n
    FROM linked l JOIN configured g ON g.source_key = l.source_key AND (g.role = 'local' AND l.datasource_kind = 'local_filesystem' OR g.role = 'remote' AND l.datasource_kind = 'remote_mirror') WHERE l.visibility_status = 'active')
  SELECT c.canonical_asset_id, s.source_key, s.upstream_asset_id FROM canon c JOIN ranked s ON s.canonical_asset_id = c.canonical_asset_id AND s.n = 1
  WHERE c.visibility_status = 'active' AND (s.datasource_kind <> 'local_filesystem'
    OR EXISTS (SELECT 1 FROM configured g WHERE g.role = 'local_fallback' AND g.source_key = s.source_key) AND EXISTS (SELECT 1 FROM ranked f WHERE f.canonical_asset_id = c.canonical_asset_id AND f.datasource_kind = 'remote_mirror')
    OR (SELECT count(DISTINCT r.kind) FROM rend r JOIN loc a ON a.source_key = r.source_key AND a.asset_id = r.asset_id AND a.sha1_hex = r.source_sha1_hex WHERE r.source_key = s.source_key AND r.asset_id = s.upstream_asset_id
      AND r.kind IN ('preview', 'detail_preview') AND r.status = 'ready' AND r.relative_path IS NOT NULL AND trim(r.relative_path) <> '' AND a.visibility_status = 'active' AND a.thumbnail_status = 'ready') = 2)""")
def ready_assets(source_rows):
    rows = C.with_canonical_ids(source_rows)
    configured = rows.sparkSession.sql(f"SELECT * FROM {CONFIGURED[1:-1]} AS c(role, source_key)")
    return T.ready_assets(C.canonical_assets(rows), rows, renditions(source_rows), local_states(source_rows), configured).select("canonical_asset_id", "source_key", "upstream_asset_id")


@query("embeddable_rows", f"WITH {REND} SELECT source_key, upstream_asset_id FROM source_rows s WHERE visibility_status = 'active' AND (datasource_kind <> 'local_filesystem' OR (media_type = 'image' AND EXISTS (SELECT 1 FROM rend r WHERE r.source_key = s.source_key AND r.asset_id = s.upstream_asset_id AND r.kind IN ('detail_preview', 'preview') AND r.status = 'ready' AND r.relative_path IS NOT NULL)))")
def embeddable_rows(source_rows):
    return T.embeddable(source_rows, renditions(source_rows)).select(*C.KEY)


EMBEDDED = [f"src{n}" for n in range(0, 20, 2)]


@query("embedding_inputs", f"""WITH {CANON}, {REND}, {LOCAL},
  copies AS (SELECT *, row_number() OVER (PARTITION BY canonical_asset_id ORDER BY CASE datasource_kind WHEN 'local_filesystem' THEN 0 WHEN 'remote_mirror' THEN 1 ELSE 2 END, captured_at DESC, source_key, upstream_asset_id) AS n
    FROM linked WHERE visibility_status = 'active' AND source_key IN ({", ".join(f"'{s}'" for s in EMBEDDED)})),
  inputs AS (SELECT c.canonical_asset_id, coalesce(p.source_key, '') AS source_key, coalesce(p.upstream_asset_id, '') AS upstream_asset_id, coalesce(p.datasource_kind, '') AS kind,
    coalesce((SELECT min_by(r.kind, CASE r.kind WHEN 'detail_preview' THEN 0 ELSE 1 END) FROM rend r JOIN loc a ON a.source_key = r.source_key AND a.asset_id = r.asset_id WHERE r.source_key = p.source_key AND r.asset_id = p.upstream_asset_id AND r.kind IN ('detail_preview', 'preview')
      AND r.status = 'ready' AND r.relative_path IS NOT NULL AND trim(r.relative_path) <> '' AND r.source_sha1_hex = a.sha1_hex AND a.visibility_status = 'active'), '') AS rendition
    FROM canon c LEFT JOIN copies p ON p.canonical_asset_id = c.canonical_asset_id AND p.n = 1 WHERE c.visibility_status = 'active')
  SELECT canonical_asset_id, CASE WHEN kind = 'local_filesystem' AND rendition <> '' THEN 'local_' || rendition WHEN kind = 'remote_mirror' THEN 'remote_preview' ELSE '' END AS embedding_input,
    CASE WHEN kind = 'local_filesystem' AND rendition = '' THEN '' ELSE source_key END AS embedding_source_key, CASE WHEN kind = 'local_filesystem' AND rendition = '' THEN '' ELSE upstream_asset_id END AS embedding_upstream_asset_id FROM inputs""")
def embedding_inputs(source_rows):
    rows = C.with_canonical_ids(source_rows)
    return T.embedding_inputs(C.canonical_assets(rows), rows, renditions(source_rows), local_states(source_rows), EMBEDDED)


# A remote library of files that local roots have too: paths of orders, as the remote sees them.

MAPPINGS = "SELECT * FROM VALUES (0, 'remote0', '/mnt/photos', 'local0', 'root0'), (1, 'remote0', '/mnt/photos/d1', 'local1', 'root1'), (2, 'remote1', '/srv/', 'local1', 'root2'), (3, 'remote0', '/mnt', 'local0', 'root3') AS m(position, source_key, prefix, local_source, root_key)"
MAPS_SQL = "maps(position, source_key, prefix, local_source, root_key) AS (VALUES (0, 'remote0', '/mnt/photos', 'local0', 'root0'), (1, 'remote0', '/mnt/photos/d1', 'local1', 'root1'), (2, 'remote1', '/srv', 'local1', 'root2'), (3, 'remote0', '/mnt', 'local0', 'root3'))"
REMOTE_SQL = "remote AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'remote1' ELSE 'remote0' END AS source_key, CASE WHEN id % 3 = 0 THEN '/srv/' WHEN id % 3 = 1 THEN '/mnt/photos/' ELSE '/mnt/photos' END || relative_path AS original_path, relative_path FROM locations)"


def remote_paths(locations):
    prefix = F.when(F.col("id") % 3 == 0, "/srv/").when(F.col("id") % 3 == 1, "/mnt/photos/").otherwise("/mnt/photos")
    return locations.select("id", F.when(F.col("id") % 3 == 0, "remote1").otherwise("remote0").alias("source_key"), F.concat(prefix, "relative_path").alias("original_path"))


def untidy_paths(locations):
    """The same, of which some are spelled in a longer way."""
    i, path = F.col("id"), F.col("original_path")
    return remote_paths(locations).withColumn("original_path", F.when(i % 4 == 0, F.concat(F.lit(" /."), path)).when(i % 4 == 1, F.regexp_replace(path, "/", "//")).when(i % 4 == 2, F.regexp_replace(path, "/f", "/x/../f")).otherwise(path))


def _mapped(agg: str) -> str:
    return f"""WITH {REMOTE_SQL}, {MAPS_SQL}, hits AS (SELECT r.id, m.position, m.local_source, m.root_key, substr(r.original_path, length(m.prefix) + 2) AS relative_path FROM remote r JOIN maps m ON r.source_key = m.source_key AND starts_with(r.original_path, m.prefix || '/'))
  SELECT id, {agg}(local_source, position) AS local_source, {agg}(root_key, position) AS root_key, {agg}(relative_path, position) AS relative_path FROM hits GROUP BY id"""


@query("mapped_paths_first", _mapped("min_by"))
def mapped_paths_first(locations):
    return C.mapped_paths(untidy_paths(locations), locations.sparkSession.sql(MAPPINGS)).select("id", "local_source", "root_key", "relative_path")


@query("mapped_paths_last", _mapped("max_by"))
def mapped_paths_last(locations):
    return C.mapped_paths(untidy_paths(locations), locations.sparkSession.sql(MAPPINGS), last_wins=True).select("id", "local_source", "root_key", "relative_path")


def remote_rows(locations):
    """Remote rows that only know a checksum of their path; some carry an identity from before."""
    p = remote_paths(locations)
    old = F.when(F.col("id") % 5 == 0, F.sha1(F.col("id").cast("string").cast("binary"))).when(F.col("id") % 5 == 1, F.lit("0" * 40))
    return p.select("source_key", F.col("id").cast("string").alias("upstream_asset_id"), F.lit("image").alias("media_type"), F.lit("sha1-path").alias("checksum_algorithm"), S.path_checksum(F.col("original_path")).alias("content_sha1_hex"), old.alias("canonical_sha1_hex"), F.when(F.col("id") % 5 < 2, F.col("id")).alias("canonical_size_bytes"))


def local_files(locations, active_only=True):
    rows = locations.where("status = 'active'") if active_only else locations
    return rows.select(F.col("source_key").alias("local_source"), "root_key", "relative_path", F.lit("image").alias("media_type"), F.sha1(F.col("id").cast("string").cast("binary")).alias("sha1_hex"), F.col("id").alias("size_bytes"), "id", "status")


BEHIND = f"""{REMOTE_SQL}, {MAPS_SQL}, files AS (SELECT source_key AS local_source, root_key, relative_path, sha1(CAST(id AS VARCHAR)) AS sha1_hex, id AS size_bytes, id, status FROM locations),
  behind AS (SELECT m.source_key, m.prefix || '/' || f.relative_path AS path, max_by(f.sha1_hex, m.position) AS sha1_hex, max_by(f.size_bytes, m.position) AS size_bytes FROM files f JOIN maps m USING (local_source, root_key) WHERE status = 'active' GROUP BY ALL),
  desired AS (SELECT r.source_key, CAST(r.id AS VARCHAR) AS upstream_asset_id, b.sha1_hex AS canonical_sha1_hex, b.size_bytes AS canonical_size_bytes FROM remote r JOIN behind b ON r.source_key = b.source_key AND r.original_path = b.path)"""


@query("external_identities", f"WITH {BEHIND} SELECT * FROM desired")
def external_identities(locations):
    return C.external_identities(remote_rows(locations), local_files(locations), locations.sparkSession.sql(MAPPINGS))


@query("reconciled_identities", f"""WITH {BEHIND}, old AS (SELECT source_key, CAST(id AS VARCHAR) AS upstream_asset_id, CASE WHEN id % 5 = 0 THEN sha1(CAST(id AS VARCHAR)) WHEN id % 5 = 1 THEN repeat('0', 40) END AS old_sha1, CASE WHEN id % 5 < 2 THEN id END AS old_size FROM remote)
  SELECT source_key, upstream_asset_id, canonical_sha1_hex AS new_sha1, canonical_size_bytes AS new_size, CASE WHEN canonical_sha1_hex IS NULL THEN 'clear' WHEN old_sha1 IS NULL THEN 'set' ELSE 'replace' END AS action FROM old LEFT JOIN desired USING (source_key, upstream_asset_id) WHERE old_sha1 IS DISTINCT FROM canonical_sha1_hex OR old_size IS DISTINCT FROM canonical_size_bytes""")
def reconciled_identities(locations):
    rows = remote_rows(locations)
    desired = C.external_identities(rows, local_files(locations), locations.sparkSession.sql(MAPPINGS))
    return C.reconciled_identities(rows, desired).select(*C.KEY, "new_sha1", "new_size", "action")


@query("identity_fallback", f"""WITH {BEHIND}, lost AS (SELECT local_source, root_key, relative_path FROM files WHERE id % 2 = 0), paths AS (SELECT m.source_key, m.prefix || '/' || l.relative_path AS path, max_by(l.local_source, position) AS local_source, max_by(l.root_key, position) AS root_key, max_by(l.relative_path, position) AS relative_path FROM lost l JOIN maps m USING (local_source, root_key) GROUP BY ALL),
  now AS (SELECT local_source, root_key, relative_path, max_by(sha1_hex, id) AS new_sha1, max_by(size_bytes, id) AS new_size FROM files WHERE status = 'active' GROUP BY ALL)
  SELECT r.source_key, CAST(r.id AS VARCHAR) AS upstream_asset_id, p.relative_path, new_sha1, new_size FROM remote r JOIN paths p ON r.source_key = p.source_key AND r.original_path = p.path LEFT JOIN now n ON n.local_source = p.local_source AND n.root_key = p.root_key AND n.relative_path = p.relative_path""")
def identity_fallback(locations):
    lost = local_files(locations, False).where("id % 2 = 0").select("local_source", "root_key", "relative_path")
    return C.identity_fallback(remote_rows(locations), lost, local_files(locations, False), locations.sparkSession.sql(MAPPINGS))


CHANGED = f"{LINKED}, kept AS (SELECT * FROM linked WHERE CAST(upstream_asset_id AS BIGINT) % 10 >= 2), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_asset_id ORDER BY dr, source_key, upstream_asset_id) AS n FROM kept WHERE visibility_status = 'active') WHERE n = 1)"


def changed_projection(source_rows):
    """A projection after three batches: some rows as active ones, then all as they are and some gone, then all again."""
    digit = F.col("upstream_asset_id").cast("bigint") % 10
    rows = C.source_rank(C.with_canonical_ids(source_rows)).select(*projection.COLUMNS, digit.alias("digit"))
    rows = rows.withColumns({"gone": F.col("digit") < 2, "datasource_rank": F.col("datasource_rank").cast("int")})
    p = projection.Projection(source_rows.sparkSession, shared_dir(source_rows.sparkSession, "projection"))
    p.apply(rows.where("digit < 8").withColumns({"gone": F.lit(False), "visibility_status": F.lit("active")}))
    p.apply(rows)
    p.apply(rows)
    return p


@query("projection_by_changes", f"WITH {CHANGED} SELECT canonical_asset_id, source_key, upstream_asset_id, source_count FROM best JOIN (SELECT canonical_asset_id, count(*) AS source_count FROM kept GROUP BY 1) USING (canonical_asset_id)")
def projection_by_changes(source_rows):
    return changed_projection(source_rows).shown().select("canonical_asset_id", *C.KEY, "source_count")


@query("projection_days_by_changes", f"WITH {CHANGED} SELECT strftime(captured_at, '%Y-%m-%d') AS day, count(*) AS n FROM best GROUP BY 1")
def projection_days_by_changes(source_rows):
    return changed_projection(source_rows).days()
