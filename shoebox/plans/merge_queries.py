"""Snapshots merged with full and incremental syncs."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoebox.operators import merge as M
from shoebox.plans.registry import at, query, text_time

COLS = ["filename", "size"]
DIFF = "(o.filename IS DISTINCT FROM n.filename OR o.size IS DISTINCT FROM n.size)"
LAST = "last_of AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, size DESC) AS rn FROM line_rows) WHERE rn = 1)"
SEQ = ["ord", "l_partkey", "l_suppkey", "l_quantity", "size"]


@query("full_replace", f"""SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN o.filename ELSE n.filename END AS filename, CASE WHEN n.id IS NULL THEN o.size ELSE n.size END AS size, CASE WHEN n.id IS NULL THEN 'missing' ELSE 'active' END AS visibility_status,
  CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'hidden' WHEN {DIFF} THEN 'changed' ELSE 'same' END AS change, CASE WHEN o.id IS NOT NULL AND n.id IS NOT NULL AND NOT {DIFF} THEN '2024-01-01 00:00:00' ELSE '2024-01-01 00:02:00' END AS updated_at
  FROM old_rows o FULL JOIN new_rows n ON o.id = n.id""")
def full_replace(old_rows, new_rows):
    return M.replaced(old_rows, new_rows, ["id"], COLS, now=at(120)).withColumn("updated_at", text_time("updated_at"))


@query("full_replace_limited", "SELECT CASE WHEN n.id IS NULL THEN 'out_of_scope' ELSE 'active' END AS visibility_status, count(*) AS n FROM old_rows o FULL JOIN new_rows n ON o.id = n.id GROUP BY ALL")
def full_replace_limited(old_rows, new_rows):
    return M.replaced(old_rows, new_rows, ["id"], COLS, scope_limited=True).groupBy("visibility_status").agg(F.count("*").alias("n"))


@query("change_detection", f"SELECT coalesce(o.id, n.id) AS id, o.id IS NULL OR n.id IS NULL OR o.filename IS DISTINCT FROM n.filename AS semantic_changed FROM old_rows o FULL JOIN new_rows n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR {DIFF}")
def change_detection(old_rows, new_rows):
    return M.changes(old_rows, new_rows, ["id"], COLS, ["filename"])


@query("dirty_state", f"WITH c AS (SELECT o.id IS NULL OR n.id IS NULL OR o.filename IS DISTINCT FROM n.filename AS s FROM old_rows o FULL JOIN new_rows n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR {DIFF}) SELECT 4 + CASE WHEN bool_or(s) THEN 1 ELSE 0 END AS asset_generation, count(*) > 0 AS refresh_required, count(*) AS changed_ids FROM c")
def dirty_state(old_rows, new_rows):
    return M.dirty_state(M.changes(old_rows, new_rows, ["id"], COLS, ["filename"]), 4)


@query("last_occurrence", f"WITH {LAST} SELECT id, filename, size, excluded FROM last_of")
def last_occurrence(line_rows):
    return M.last_of_each(line_rows.withColumn("seq", F.struct(*SEQ)), ["id"], "seq").select("id", "filename", "size", "excluded")


MERGED = f"""{LAST}, merged AS (SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.excluded IS NOT DISTINCT FROM false THEN n.filename ELSE o.filename END AS filename, CASE WHEN n.excluded IS NOT DISTINCT FROM false THEN n.size ELSE o.size END AS size,
  CASE WHEN n.id IS NULL THEN o.visibility_status WHEN n.excluded THEN 'out_of_scope' ELSE 'active' END AS visibility_status,
  CASE WHEN n.id IS NULL THEN o.updated_at WHEN n.excluded THEN coalesce(n.updated_at, o.updated_at) ELSE n.updated_at END AS updated_at,
  CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'same' WHEN n.excluded THEN CASE WHEN o.visibility_status <> 'out_of_scope' OR coalesce(n.updated_at, o.updated_at) <> o.updated_at THEN 'excluded' ELSE 'same' END
    WHEN {DIFF} OR o.updated_at IS DISTINCT FROM n.updated_at OR o.visibility_status <> 'active' THEN 'changed' ELSE 'same' END AS change
  FROM stored_rows o FULL JOIN last_of n ON o.id = n.id WHERE o.id IS NOT NULL OR NOT n.excluded)"""
SYNCED = "id, filename, size, visibility_status, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at"


def batch(rows):
    return rows.withColumn("seq", F.struct(*SEQ)).select("id", "filename", "size", "excluded", "seq", "updated_at")


@query("incremental_merge", f"WITH {MERGED} SELECT {SYNCED}, change FROM merged")
def incremental_merge(stored_rows, line_rows):
    """Stored rows are active, hidden or missing, and some are just what the batch says; rows of the batch come in any state."""
    return M.merged(stored_rows, batch(line_rows), ["id"], COLS, source_time="updated_at").withColumn("updated_at", text_time("updated_at"))


@query("merge_replay", f"WITH {MERGED} SELECT {SYNCED}, 'same' AS change FROM merged")
def merge_replay(stored_rows, line_rows):
    """The same batch twice gives what it gives once, and no change."""
    once = M.merged(stored_rows, batch(line_rows), ["id"], COLS, source_time="updated_at").drop("change")
    return M.merged(once, batch(line_rows), ["id"], COLS, source_time="updated_at").withColumn("updated_at", text_time("updated_at"))


@query("requeue_jobs", "SELECT coalesce(j.id, w.id) AS id, CASE WHEN w.id IS NOT NULL AND coalesce(j.status NOT IN ('running', 'queued', 'failed'), true) THEN 'queued' ELSE j.status END AS status, CASE WHEN w.id IS NOT NULL AND coalesce(j.status NOT IN ('running', 'queued', 'failed'), true) THEN 0 ELSE j.attempts END AS attempts FROM (SELECT id, CASE WHEN id % 4 = 0 THEN 'done' ELSE status END AS status, attempts FROM jobs WHERE id % 3 > 0) j FULL JOIN (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 = 0) w ON j.id = w.id")
def requeue_jobs(jobs, orders):
    old = jobs.where("id % 3 > 0").withColumn("status", F.when(F.col("id") % 4 == 0, "done").otherwise(F.col("status")))
    return M.requeued(old, orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("id")), ["id"])


@query("tables_equal", "SELECT 'left' AS side, id, filename, size FROM (SELECT id, filename, size FROM old_rows EXCEPT ALL SELECT id, filename, size FROM new_rows) UNION ALL SELECT 'right', id, filename, size FROM (SELECT id, filename, size FROM new_rows EXCEPT ALL SELECT id, filename, size FROM old_rows)")
def tables_equal(old_rows, new_rows):
    return M.equal_tables(old_rows.select("id", *COLS), new_rows.select("id", *COLS))


@query("changed_or_new_union", f"SELECT n.id, 'changed' AS why FROM new_rows n JOIN old_rows o ON o.id = n.id WHERE {DIFF} UNION ALL SELECT n.id, 'new' FROM new_rows n WHERE n.id NOT IN (SELECT id FROM old_rows)")
def changed_or_new_union(old_rows, new_rows):
    changed = old_rows.alias("o").join(new_rows.alias("n"), "id").where(M.differs(COLS)).select("id", F.lit("changed").alias("why"))
    return changed.unionByName(new_rows.join(old_rows, "id", "left_anti").select("id", F.lit("new").alias("why")))


@query("published_membership", "SELECT id, row_number() OVER (ORDER BY id) - 1 AS ordinal, 7 AS generation FROM vectors WHERE status = 'ready'")
def published_membership(vectors):
    return M.generation_of(vectors.where("status = 'ready'"), 7).select("id", "ordinal", "generation")


@query("guarded_metadata_refresh", f"SELECT o.id, coalesce(n.filename, o.filename) AS filename, coalesce(n.size, o.size) AS size, coalesce((n.filename IS NOT NULL AND n.filename IS DISTINCT FROM o.filename) OR (n.size IS NOT NULL AND n.size IS DISTINCT FROM o.size), false) AS rewritten FROM old_rows o LEFT JOIN new_rows n ON o.id = n.id")
def guarded_metadata_refresh(old_rows, new_rows):
    return M.refreshed_metadata(old_rows.select("id", *COLS), new_rows.select("id", *COLS), ["id"], COLS)
