"""Counts and checks over the catalog."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def linked_assets(rows: DataFrame, sources: list[str]) -> DataFrame:
    """One row: how many canonical assets the configured sources have, exactly."""
    return rows.where(F.col("source_key").isin(sources) & (F.col("visibility_status") == "active")).agg(F.countDistinct("canonical_asset_id").alias("n"))


def job_counts(jobs: DataFrame, now: Column) -> DataFrame:
    """One row, from one pass: jobs by status, those due, and when the next is due."""
    queued = F.col("status") == "queued"
    return jobs.agg(
        F.count_if(queued).alias("queued"), F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(queued & (F.col("scheduled_at") <= now)).alias("eligible"), F.min(F.when(queued & (F.col("scheduled_at") > now), F.col("scheduled_at"))).alias("next_eligible_at"),
    )


def root_counts(locations: DataFrame, jobs: DataFrame) -> DataFrame:
    """A row a root: locations by status, assets, and jobs by kind and status; one aggregation for each table."""
    keys = ["source_key", "root_key"]
    by = [F.count_if(F.col("status") == s).alias(f"locations_{s}") for s in ("active", "discovered", "missing", "permission_blocked")]
    found = locations.groupBy(*keys).agg(F.count("*").alias("locations"), *by, F.countDistinct("asset_id").alias("assets"))
    kinds = [F.count_if((F.col("kind") == k) & (F.col("status") == s)).alias(f"{k}_{s}") for k in ("metadata", "thumbnail") for s in ("queued", "running", "failed")]
    work = jobs.groupBy(*keys).agg(*kinds)
    names = work.columns[2:]
    return found.join(work, keys, "left").select(*found.columns, *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


def processing_stats(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(stage, status, n) over all stages: {stage: (rows, status expression)}; each is one grouped count."""
    parts = [rows.groupBy(status.alias("status")).agg(F.count("*").alias("n")).select(F.lit(stage).alias("stage"), "status", "n") for stage, (rows, status) in tables.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def coverage(rows: DataFrame, locations: DataFrame, thumbnails: DataFrame, vectors: DataFrame) -> DataFrame:
    """A row a source: found (the greater of locations and catalog rows), browsable and searchable assets, and issues."""
    c = rows.groupBy("source_key").agg(F.count("*").alias("catalog"), F.count_if(F.col("visibility_status") != "active").alias("issues"))
    files = locations.groupBy("source_key").agg(F.count("*").alias("files"))
    shown = rows.join(thumbnails.where(F.col("status") == "ready").select("source_key", F.col("asset_id").alias("upstream_asset_id")).distinct(), ["source_key", "upstream_asset_id"], "left_semi").groupBy("source_key").agg(F.count("*").alias("browsable"))
    known = rows.join(vectors.where(F.col("status") == "ready").select("source_key", F.col("asset_id").alias("upstream_asset_id")).distinct(), ["source_key", "upstream_asset_id"], "left_semi").groupBy("source_key").agg(F.count("*").alias("searchable"))
    both = c.join(files, "source_key", "left").join(shown, "source_key", "left").join(known, "source_key", "left")
    n = lambda x: F.coalesce(F.col(x), F.lit(0))
    return both.select("source_key", F.greatest("catalog", n("files")).alias("found"), n("browsable").alias("browsable"), n("searchable").alias("searchable"), "issues")


def over_sources(states: DataFrame) -> DataFrame:
    """One row from a state a source: sums, the last build, and the common status."""
    one = states.agg(F.coalesce(F.sum("indexed"), F.lit(0)).alias("indexed"), F.max("built_at").alias("built_at"), F.coalesce(F.bool_and(F.col("status") == "ready"), F.lit(False)).alias("all_ready"), F.coalesce(F.bool_or(F.col("status") == "ready"), F.lit(False)).alias("any_ready"))
    return one.withColumn("status", F.when(F.col("all_ready"), "ready").when(F.col("any_ready"), "partial").otherwise("missing"))


def profiles(identities: DataFrame, vectors: DataFrame) -> DataFrame:
    """How many ready vectors each identity (source_key, model_id) has."""
    ready = vectors.where(F.col("status") == "ready")
    return identities.join(ready, ["source_key", "model_id"], "left").groupBy("source_key", "model_id").agg(F.count("asset_id").alias("vectors"))


def edge_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.groupBy("ordinal").agg(F.count("neighbor").alias("edges")), "ordinal", "left").select("ordinal", F.coalesce("edges", F.lit(0)).alias("edges"))


def failures(jobs: DataFrame, locations: DataFrame) -> DataFrame:
    """Failed jobs with what is known of their place: the least root, and all kinds joined by '+' in order."""
    failed = jobs.where(F.col("status") == "failed").join(locations.select(F.col("id").alias("location_id"), F.col("relative_path"), F.col("root_key").alias("l_root")), "location_id", "left")
    return failed.groupBy("location_id").agg(F.min("l_root").alias("root_key"), F.min("relative_path").alias("relative_path"), F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("kinds"), F.max("attempts").alias("attempts"))


def latest_runs(runs: DataFrame, now: Column, every_seconds: int) -> DataFrame:
    """A row a root: its last completed run, and whether the next is due: none yet, read errors, or too long ago."""
    done = runs.where(F.col("status") == "completed").groupBy("root_key").agg(F.max_by(F.struct("id", "completed_at", "skip_counts_json"), F.struct("completed_at", "id")).alias("r"))
    both = runs.select("root_key").distinct().join(done, "root_key", "left")
    errors = F.coalesce(F.element_at(F.from_json("r.skip_counts_json", "map<string,bigint>"), "read_error"), F.lit(0))
    due = F.col("r").isNull() | (errors > 0) | (F.col("r.completed_at") <= now - F.make_dt_interval(secs=F.lit(every_seconds)))
    return both.select("root_key", F.col("r.id").alias("run_id"), due.alias("due"))


def consistency_issues(vectors: DataFrame, states: DataFrame, dim: int) -> DataFrame:
    """(source_key, model_id, issue, n): vectors of a wrong size or without a payload, and states whose count is wrong."""
    keys = ["source_key", "model_id"]
    ready = vectors.where(F.col("status") == "ready")
    wrong = ready.where(F.col("vector").isNotNull() & (F.size("vector") != dim)).groupBy(*keys).agg(F.count("*").alias("n")).withColumn("issue", F.lit("wrong_dimension"))
    empty = ready.where(F.col("vector").isNull()).groupBy(*keys).agg(F.count("*").alias("n")).withColumn("issue", F.lit("payload_missing"))
    counts = states.join(ready.groupBy(*keys).agg(F.count("*").alias("vectors")), keys, "left").withColumn("off", F.col("indexed") - F.coalesce("vectors", F.lit(0))).where("off <> 0")
    off = counts.select(*keys, F.abs("off").alias("n"), F.lit("count_mismatch").alias("issue"))
    cols = [*keys, "issue", "n"]
    return wrong.select(cols).unionByName(empty.select(cols)).unionByName(off.select(cols))
