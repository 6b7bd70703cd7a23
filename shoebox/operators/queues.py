"""Work queues as tables: what is next, and what each step makes of a job. Each function is one step for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shoebox.functions import scalars as S

ACTIVE = ("queued", "running")


def next_jobs(jobs: DataFrame, n: int, now: Column) -> DataFrame:
    """The n queued jobs that are due: by priority, the newest first, then by when they were scheduled and id."""
    due = jobs.where((F.col("status") == "queued") & (F.col("scheduled_at") <= now))
    return due.orderBy("priority", F.col("sort_at").desc(), "scheduled_at", "id").limit(n)


def next_of_roots(jobs: DataFrame, roots: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Jobs of roots of the current generation in the order: n of each root at most, then n in all."""
    own = jobs.join(roots.select("source_key", "root_key", "root_generation"), ["source_key", "root_key", "root_generation"])
    each = F.row_number().over(Window.partitionBy("source_key", "root_key").orderBy(*order))
    return own.withColumn("n", each).where(F.col("n") <= n).orderBy(*order).limit(n).drop("n")


def next_metadata_jobs(jobs: DataFrame, roots: DataFrame, locations: DataFrame, n: int, now: Column) -> DataFrame:
    """The next queued metadata jobs that are due, by root and then in all: by priority, the newest first, then by id. Jobs
    of locations that are to be left alone until later (metadata_not_before) wait."""
    due = jobs.where((F.col("kind") == "metadata") & (F.col("status") == "queued") & (F.col("scheduled_at") <= now) & F.col("location_id").isNotNull())
    unsettled = locations.where(F.col("metadata_not_before") > now).select(F.col("id").alias("location_id"))
    return next_of_roots(due.join(unsettled, "location_id", "left_anti"), roots, [F.col("priority"), F.col("sort_at").desc(), F.col("id")], n)


def next_thumbnail_jobs(jobs: DataFrame, roots: DataFrame, assets: DataFrame, n: int) -> DataFrame:
    """The next queued thumbnail jobs of roots that need no reconciliation, by root and then in all, with the asset's media
    type ('' if it is gone): by priority, the newest first, then by when they were scheduled and id."""
    own = jobs.where((F.col("kind") == "thumbnail") & (F.col("status") == "queued") & F.col("asset_id").isNotNull())
    order = [F.col("priority"), F.col("sort_at").desc(), F.col("scheduled_at"), F.col("id")]
    page = next_of_roots(own, roots.where(~F.col("reconciliation_pending")), order, n)
    return page.join(assets.select("source_key", "asset_id", "media_type"), ["source_key", "asset_id"], "left").withColumn("media_type", F.coalesce("media_type", F.lit("")))


def failed_last(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.when(F.col("status") == "failed", 1).otherwise(0), F.col("captured_at").desc(), "id").limit(n)


def first_view_order(assets: DataFrame, first: int, n: int) -> DataFrame:
    """The newest `first` assets come first in that order; the others as if shuffled, by the end of their ids.

    Ids may repeat: each row has its own place. Of the first + n rows that are ahead in the shuffled order n at least are
    not among the newest, so no join over all rows is needed.
    """
    others = [c for c in assets.columns if c not in ("captured_at", "asset_id")]
    order, shuffled = [F.col("captured_at").desc(), F.col("asset_id"), *others], [F.substring("asset_id", -8, 8), F.col("asset_id")]
    newest = assets.orderBy(*order).limit(first)
    rest = assets.orderBy(*shuffled, *order).limit(first + n).exceptAll(newest).withColumn("view_rank", F.lit(1_000_000))
    ranked = newest.withColumn("view_rank", F.row_number().over(Window.orderBy(*order)))  # first rows
    return ranked.unionByName(rest).orderBy("view_rank", *shuffled).limit(n)


def thumbnail_jobs(assets: DataFrame, jobs: DataFrame, first: int, n: int, high: int = 0, low: int = 10, videos: bool = True) -> DataFrame:
    """(source_key, asset_id, priority, sort_at) of the next n thumbnail jobs to be queued for one source: its active images,
    and videos, that wait for a thumbnail and have no queued or running thumbnail job.

    The newest `first` of all active ones, waiting or not, come first and get the high priority; the others follow as if
    shuffled, by the end of their ids.
    """
    pool = assets.where((F.col("visibility_status") == "active") & F.col("media_type").isin("image", *["video"] * videos))
    order = [F.col("captured_at").desc(), F.col("asset_id")]
    newest = pool.orderBy(*order).limit(first).select("source_key", "asset_id", F.row_number().over(Window.orderBy(*order)).alias("view_rank"))  # first rows
    busy = jobs.where((F.col("kind") == "thumbnail") & F.col("status").isin(*ACTIVE)).select("source_key", "asset_id")
    waiting = pool.where(F.col("thumbnail_status") == "pending").join(busy, ["source_key", "asset_id"], "left_anti").join(newest, ["source_key", "asset_id"], "left")
    next_ = waiting.orderBy(F.coalesce("view_rank", F.lit(1_000_000)), F.substring("asset_id", -8, 8), "asset_id").limit(n)
    return next_.select("source_key", "asset_id", F.when(F.col("view_rank").isNotNull(), high).otherwise(low).alias("priority"), F.col("captured_at").alias("sort_at"))


def with_priority(assets: DataFrame, first: int, high: int = 0, low: int = 10) -> DataFrame:
    """The newest `first` assets get the high priority."""
    newest = assets.orderBy(F.col("captured_at").desc(), "asset_id").limit(first).select("asset_id", F.lit(high).alias("p"))
    return assets.join(newest, "asset_id", "left").withColumn("priority", F.coalesce("p", F.lit(low))).drop("p")


def stalest(locations: DataFrame, roots: DataFrame, cutoff: Column, retry_before: Column) -> DataFrame:
    """The active location with a known content that was verified and tried before the cutoff or never, and, if that went
    wrong, not since retry_before, of a root that needs no reconciliation: the one tried longest ago, never first, by id."""
    steady = roots.where(~F.col("reconciliation_pending")).select("source_key", "root_key")
    before = lambda c: F.col(c).isNull() | (F.col(c) < cutoff)
    known = (F.col("status") == "active") & F.col("asset_id").isNotNull() & F.col("sha1_hex").isNotNull()
    retry = F.col("verification_error").isNull() | F.col("attempted_at").isNull() | (F.col("attempted_at") <= retry_before)
    due = locations.where(known & before("verified_at") & before("attempted_at") & retry)
    return due.join(steady, ["source_key", "root_key"]).orderBy(F.col("attempted_at").asc_nulls_first(), "id").limit(1)


def within_quotas(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """Of each source's rows the newest, as many as its quota.

    The greatest quota is looked up first: as a constant it lets each task drop what lies beyond it before rows of a
    source meet.
    """
    most = quotas.agg(F.max("quota")).first()[0] or 0
    n = F.row_number().over(Window.partitionBy("source_key").orderBy(F.col("captured_at").desc(), "id"))
    return rows.withColumn("n", n).where(F.col("n") <= most).join(quotas, "source_key").where(F.col("n") <= F.col("quota")).drop("n", "quota")


def without_active_job(assets: DataFrame, jobs: DataFrame, on: list[str]) -> DataFrame:
    return assets.join(jobs.where(F.col("status").isin(*ACTIVE)), on, "left_anti")


# Index jobs: one worker holds a job for the time of its lease; which try it is on tells its reports from late ones.


def expired(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease is over have failed; they may be claimed again at once, and no try is added."""
    over = F.coalesce((F.col("status") == "running") & (F.col("lease_until") <= now), F.lit(False))
    return _changed(jobs, over, status=F.lit("failed"), scheduled_at=now, lease_until=F.lit(None), last_error=F.lit("lease expired"))


def claimed(jobs: DataFrame, sources: list[str], now: Column, until: Column, n: int = 1) -> DataFrame:
    """After leases that are over are: the n next jobs run until their new lease ends, on one more try.

    Queued and failed jobs that are due are taken: by the order of the sources, then by priority, the time they are due,
    and id. Jobs of other sources are left alone.
    """
    jobs = expired(jobs, now)
    place = F.array_position(F.array(*map(F.lit, sources)), F.col("source_key"))
    due = jobs.where(F.col("status").isin("queued", "failed") & (F.col("scheduled_at") <= now) & (place > 0))
    mine = due.orderBy(place, "priority", "scheduled_at", "id").limit(n).select(F.col("id").alias("__id"))
    both = jobs.join(F.broadcast(mine), F.col("id") == F.col("__id"), "left")  # n rows
    return _changed(both, F.col("__id").isNotNull(), status=F.lit("running"), attempts=F.col("attempts") + 1, lease_until=until, last_error=F.lit(None)).drop("__id")


def reported(jobs: DataFrame, reports: DataFrame, now: Column) -> DataFrame:
    """Jobs after (id, attempts, result, error): only reports of the try that a job is on count. A running job is completed;
    a running one, or one that was completed meanwhile, fails and is due after the delay of its tries."""
    r = reports.select(F.col("id").alias("__id"), F.col("attempts").alias("__try"), "result", "error")
    both = jobs.join(r, (F.col("id") == F.col("__id")) & (F.col("attempts") == F.col("__try")), "left")
    done = F.coalesce((F.col("result") == "done") & (F.col("status") == "running"), F.lit(False))
    failed = F.coalesce((F.col("result") == "failed") & F.col("status").isin("running", "completed"), F.lit(False))
    wait = now + F.make_dt_interval(secs=S.retry_delay(F.col("attempts")))
    both = _changed(both, done | failed, last_error=F.when(failed, F.coalesce("error", F.lit(""))), lease_until=F.lit(None), scheduled_at=F.when(failed, wait).otherwise(F.col("scheduled_at")), status=F.when(done, "completed").otherwise("failed"))
    return both.drop("__id", "__try", "result", "error")


def _changed(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    """rows with new values in the columns that they have, where the condition holds."""
    rows = rows.withColumn("__go", where)
    own = {c: F.when(F.col("__go"), v.cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items() if c in rows.columns}
    return rows.withColumns(own).drop("__go")


# Scan jobs: one process works on a queue of files; a failure stays until it is repaired.


def scan_outcome(jobs: DataFrame, outcomes: DataFrame, roots: DataFrame, locations: DataFrame, now: Column) -> DataFrame:
    """Metadata jobs after (id, source_key, root_key, root_generation, location_id, result, error), where the result's
    root and generation are the job's.

    Done jobs go. A queued or running job that failed is failed, without a delay, if its root still has that generation;
    else it is deferred. A running job of that location that is deferred is queued again: as _requeued() says.
    """
    o = outcomes.select("id", *(F.col(c).alias(f"o_{c}") for c in ("source_key", "root_key", "root_generation", "location_id")), "result", F.col("error").alias("o_error"))
    current = roots.select("source_key", "root_key", "root_generation", F.lit(True).alias("current"))
    both = jobs.join(o, "id", "left").join(current, ["source_key", "root_key", "root_generation"], "left")
    ours = F.coalesce(S.all_of([F.col(c) == F.col(f"o_{c}") for c in ("source_key", "root_key", "root_generation")]) & (F.col("kind") == "metadata"), F.lit(False))
    both = both.where(~F.coalesce(F.col("result") == "done", F.lit(False)))
    fails = ours & (F.col("result") == "failed")
    failed = fails & F.col("current").isNotNull() & F.col("status").isin(*ACTIVE)
    deferred = ours & ((F.col("result") == "deferred") | fails & F.col("current").isNull()) & (F.col("status") == "running") & (F.col("location_id") == F.col("o_location_id"))
    both = both.withColumns({"__failed": F.coalesce(failed, F.lit(False)), "__deferred": F.coalesce(deferred, F.lit(False))})
    both = _changed(both, F.col("__failed"), status=F.lit("failed"), last_error=F.nullif(F.col("o_error"), F.lit("")))
    return _requeued(both, F.col("__deferred"), locations, now).select(jobs.columns)


def _requeued(jobs: DataFrame, where: Column, locations: DataFrame, now: Column) -> DataFrame:
    """Queued again, free, without an error, due now; metadata jobs not before their file has settled, and in the order of
    the time that the file has now."""
    file = locations.select(F.col("id").alias("location_id"), F.col("mtime").alias("__mtime"), F.col("metadata_not_before").alias("__settled"))
    both = jobs.withColumn("__again", where).join(file, "location_id", "left")
    reads = F.col("kind") == "metadata"
    due = F.when(reads, F.greatest(now, F.col("__settled"))).otherwise(now)
    sort_at = F.when(reads, F.coalesce("__mtime", "sort_at")).otherwise(F.col("sort_at"))
    both = _changed(both, F.col("__again"), status=F.lit("queued"), scheduled_at=due, sort_at=sort_at, owner=F.lit(None), lease_until=F.lit(None), last_error=F.lit(None))
    return both.drop("__again", "__mtime", "__settled")


def reset_running(jobs: DataFrame, locations: DataFrame, now: Column) -> DataFrame:
    """After a restart nothing runs: running metadata and thumbnail jobs are queued again."""
    where = (F.col("status") == "running") & F.col("kind").isin("metadata", "thumbnail")
    return _requeued(jobs, where, locations, now).select(jobs.columns)


def repaired(jobs: DataFrame, assets: DataFrame, locations: DataFrame, roots: DataFrame, now: Column, priority: int = 0) -> DataFrame:
    """The jobs after metadata of the given assets, those of them that are active, is to be read again; new jobs have no id.

    In each root that has a state, an asset's target is its primary location if that is active, else the active one with
    the least id. An asset of which any location, whatever its status, has a queued or running metadata job of its root's
    generation is left alone. Else the newest failed metadata job of its targets, of their roots' generations, is queued
    as new; without any each target gets a job. Failed metadata jobs at any location of an asset with a target are gone then.
    """
    key, state = ["source_key", "asset_id"], roots.select("source_key", "root_key", "root_generation")
    own = assets.where(F.col("visibility_status") == "active").select(*key, "primary_location_id")
    first = F.struct((~F.col("id").eqNullSafe(F.col("primary_location_id"))).alias("other"), "id")
    place = locations.where(F.col("status") == "active").join(own, key).groupBy(*key, "root_key").agg(F.min_by(F.struct(F.col("id").alias("location_id"), "mtime"), first).alias("l"))
    targets = place.join(state, ["source_key", "root_key"]).select(*key, "root_key", "root_generation", "l.location_id", "l.mtime")
    whose = locations.where(F.col("asset_id").isNotNull()).select(*key, "root_key", F.col("id").alias("location_id"))
    reading = jobs.where(F.col("kind") == "metadata")
    live = reading.where(F.col("status").isin(*ACTIVE)).select("source_key", "location_id", "root_generation").join(whose, ["source_key", "location_id"])
    busy = live.join(state, ["source_key", "root_key", "root_generation"], "left_semi").select(*key).distinct()
    idle = targets.join(busy, key, "left_anti")
    failed = reading.where(F.col("status") == "failed").select(F.col("id").alias("__id"), "source_key", "location_id", "root_generation")
    again = idle.join(failed, ["source_key", "location_id", "root_generation"]).groupBy(*key).agg(F.max_by(F.struct("__id", F.col("mtime").alias("__mtime")), "__id").alias("j"))
    new = idle.join(again, key, "left_anti")
    theirs = whose.join(targets.select(*key).distinct(), key, "left_semi").select("location_id", F.lit(True).alias("__theirs")).distinct()
    both = jobs.join(again.select("j.*"), F.col("id") == F.col("__id"), "left").join(theirs, "location_id", "left")
    gone = F.col("__theirs").isNotNull() & (F.col("kind") == "metadata") & (F.col("status") == "failed") & F.col("__id").isNull()
    both = _changed(both.where(~F.coalesce(gone, F.lit(False))), F.col("__id").isNotNull(), status=F.lit("queued"), priority=F.lit(priority), attempts=F.lit(0), scheduled_at=now, sort_at=F.coalesce("__mtime", "sort_at"), owner=F.lit(None), lease_until=F.lit(None), last_error=F.lit(None))
    given = {"kind": F.lit("metadata"), "status": F.lit("queued"), "priority": F.lit(priority), "attempts": F.lit(0), "scheduled_at": now, "sort_at": F.col("mtime")}
    values = [given.get(f.name, F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in jobs.schema]
    return both.select(jobs.columns).unionByName(new.select(*values))


def retry_targets(failures: DataFrame, canonical_failures: DataFrame) -> DataFrame:
    """Assets to embed again: failures of sources without a canonical vector, and those of canonical inputs."""
    legacy = failures.join(canonical_failures, "asset_id", "left_anti").withColumn("scope", F.lit("source"))
    return legacy.unionByName(canonical_failures.withColumn("scope", F.lit("canonical")))


def retry_requests(old: DataFrame, targets: DataFrame, now: Column) -> DataFrame:
    """Requests inserted, or renewed, for all targets."""
    both = old.select("asset_id", "requested_at").join(targets.select("asset_id").distinct().withColumn("wanted", F.lit(True)), "asset_id", "full_outer")
    return both.select("asset_id", F.when(F.col("wanted"), now).otherwise(F.col("requested_at")).alias("requested_at"))


def consumed(requests: DataFrame, handled: DataFrame) -> DataFrame:
    """Requests left after those handled at the very time that they now have."""
    return requests.join(handled, ["asset_id", "requested_at"], "left_anti")


def phase(metadata: Column, thumbnails: Column, embeddings: Column, batch: Column, draw: Column) -> Column:
    """Which kind of work comes next: weights from capped queue lengths, and one draw from 0 to 1."""
    cap = lambda c, most: F.least(F.greatest(c, F.lit(0)), F.lit(most)).cast("double")
    m = cap(metadata, 300) * 5
    m = F.when(m > 0, F.greatest(m, F.lit(100.0))).otherwise(0.0)
    t = cap(thumbnails, 300) * 3
    e = F.when((batch > 0) & (embeddings >= batch), cap(embeddings, 500)).otherwise(0.0)
    at = F.least(F.greatest(draw, F.lit(0.0)), F.lit(0.999999999999)) * (m + t + e)
    return F.when(m + t + e <= 0, "").when((m > 0) & (at < m), "metadata").when((t > 0) & (at - m < t), "thumbnails").when(e > 0, "embeddings").otherwise("")
