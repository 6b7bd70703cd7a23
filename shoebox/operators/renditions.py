"""Renditions of local assets, and the scan's own records. Each function is one step for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("preview", "detail_preview")
KEY = ["source_key", "asset_id"]


def complete(renditions: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets (source_key, asset_id) with both renditions ready, at a path, and made of their present content."""
    ready = renditions.where((F.col("status") == "ready") & F.col("kind").isin(*KINDS) & F.col("relative_path").isNotNull())
    own = assets.select(*KEY, F.col("sha1_hex").alias("source_sha1_hex"))
    return ready.join(own, [*KEY, "source_sha1_hex"]).groupBy(*KEY).agg(F.countDistinct("kind").alias("kinds")).where(F.col("kinds") == len(KINDS)).select(*KEY)


def made(renditions: DataFrame, new: DataFrame) -> DataFrame:
    """Renditions with new ready ones (source_key, asset_id, kind, relative_path, source_sha1_hex) in."""
    keys = [*KEY, "kind"]
    n = new.select(*keys, F.col("relative_path").alias("n_path"), F.col("source_sha1_hex").alias("n_sha"), F.lit(True).alias("fresh"))
    both = renditions.join(n, keys, "full_outer")
    pick = lambda a, b: F.when(F.col("fresh"), F.col(a)).otherwise(F.col(b)).alias(b)
    return both.select(*keys, F.when(F.col("fresh"), "ready").otherwise(F.col("status")).alias("status"), pick("n_path", "relative_path"), pick("n_sha", "source_sha1_hex"))


def failed(renditions: DataFrame, assets: DataFrame) -> DataFrame:
    """Both kinds of the assets failed: what was there of them is void, what was not is recorded."""
    kinds = assets.select(*KEY).distinct().withColumn("kind", F.explode(F.array(*map(F.lit, KINDS)))).withColumn("failed", F.lit(True))
    both = renditions.join(kinds, [*KEY, "kind"], "full_outer")
    keep = lambda c: F.when(F.col("failed").isNull(), F.col(c)).alias(c)
    return both.select(*KEY, "kind", F.when(F.col("failed"), "failed").otherwise(F.col("status")).alias("status"), keep("relative_path"), keep("source_sha1_hex"))


def thumbnail_states(assets: DataFrame, renditions: DataFrame, failures: DataFrame) -> DataFrame:
    """(source_key, asset_id, thumbnail_status): ready with both renditions, failed where the last job failed, else pending."""
    r = complete(renditions, assets).withColumn("ready", F.lit(True))
    f = failures.select(*KEY).distinct().withColumn("failed", F.lit(True))
    both = assets.join(r, KEY, "left").join(f, KEY, "left")
    return both.select(*KEY, F.when(F.col("ready"), "ready").when(F.col("failed"), "failed").otherwise("pending").alias("thumbnail_status"))


def claimable(jobs: DataFrame, roots: DataFrame) -> DataFrame:
    """Queued thumbnail jobs of the present generation of roots that are not to be reconciled first."""
    calm = roots.where(~F.col("reconciliation_pending")).select("source_key", "root_key", "root_generation")
    return jobs.where((F.col("kind") == "thumbnail") & (F.col("status") == "queued")).join(calm, ["source_key", "root_key", "root_generation"], "left_semi")


def missing_durations(assets: DataFrame) -> DataFrame:
    """Active videos without a duration."""
    return assets.where((F.col("media_type") == "video") & (F.col("visibility_status") == "active") & (F.trim(F.coalesce("duration", F.lit(""))) == ""))


def accepted_roots(roots: DataFrame, identities: DataFrame) -> DataFrame:
    """Roots whose new identity (root_key, identity) is accepted: another generation, to be reconciled; a running
    verification is skipped. The same or a blank identity changes nothing."""
    both = roots.join(identities.select("root_key", F.col("identity").alias("new")), "root_key", "left")
    go = F.coalesce((F.trim(F.coalesce("root_identity", F.lit(""))) != "") & (F.trim("root_identity") != F.col("new")), F.lit(False))
    out = {
        "root_generation": F.col("root_generation") + F.when(go, 1).otherwise(0),
        "reconciliation_pending": go | F.col("reconciliation_pending"),
        "window_state": F.when(go & (F.col("window_state") == "running"), "skipped").otherwise(F.col("window_state")),
        "root_identity": F.when(go, F.col("new")).otherwise(F.col("root_identity")),
    }
    return both.select(*(out[c].alias(c) if c in out else F.col(c) for c in roots.columns))


def current_jobs(jobs: DataFrame, roots: DataFrame) -> DataFrame:
    """Jobs without those of generations of their root that are over."""
    old = roots.select("source_key", "root_key", F.col("root_generation").alias("present"))
    both = jobs.join(old, ["source_key", "root_key"], "left")
    return both.where(F.col("present").isNull() | (F.col("root_generation") == F.col("present"))).drop("present")


def directory_states(stored: DataFrame, seen: DataFrame, removed: DataFrame, retried: DataFrame) -> DataFrame:
    """Directory times after a scan: seen ones take the new time, unless they are to be tried again; removed ones go."""
    new = seen.join(retried, "directory", "left_anti").select("directory", F.col("mtime").alias("now"))
    both = stored.select("directory", "mtime").join(new, "directory", "full_outer").join(removed.select("directory"), "directory", "left_anti")
    return both.select("directory", F.coalesce("now", "mtime").alias("mtime"))


def finished_runs(runs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Running runs end as (id, failed, skip_counts_json) says."""
    both = runs.join(outcomes.select("id", "failed", F.col("skip_counts_json").alias("counts")), "id", "left")
    end = F.coalesce((F.col("status") == "running") & F.col("failed").isNotNull(), F.lit(False))
    out = {"status": F.when(end, F.when(F.col("failed"), "failed").otherwise("completed")).otherwise(F.col("status")), "completed_at": F.when(end, now).otherwise(F.col("completed_at")), "skip_counts_json": F.when(end, F.col("counts")).otherwise(F.col("skip_counts_json"))}
    return both.select(*(out[c].alias(c) if c in out else F.col(c) for c in runs.columns))
