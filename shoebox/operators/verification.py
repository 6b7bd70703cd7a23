"""Windows in which a root's files are verified, and what a verification makes of a location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shoebox.functions.scalars import all_of

COUNTERS = ("processed", "verified", "changed", "failed", "read_bytes")
ROOT = ("source_key", "root_key")
#: What must still be as it was when a file was chosen.
SIGNATURE = ("size_bytes", "mtime", "fast_signature", "file_identity")


def started(roots: DataFrame, schedule: Column, deadline: Column, now: Column) -> DataFrame:
    """Roots without a running window, and that need no reconciliation, start one for a schedule that is newer than the
    last one they had; their counters are 0 then. A deadline that is not after the schedule is an error."""
    ahead = F.when(deadline > schedule, F.lit(True)).otherwise(F.raise_error(F.lit("the deadline must follow the schedule")).cast("boolean"))
    go = ahead & _next(schedule) & ~F.col("reconciliation_pending")
    return _set(roots, go, window_state=F.lit("running"), scheduled_for=schedule, started_at=now, deadline=deadline, skip_reason=F.lit(None), **dict.fromkeys(COUNTERS, F.lit(0)))


def skipped(roots: DataFrame, schedule: Column, reason: Column, now: Column) -> DataFrame:
    """Roots without a running window pass over a newer schedule, whether they need reconciliation or not."""
    over = dict(scheduled_for=schedule, started_at=F.lit(None), deadline=F.lit(None), finished_at=now, skip_reason=F.nullif(F.trim(reason), F.lit("")))
    return _set(roots, _next(schedule), window_state=F.lit("skipped"), **over, **dict.fromkeys(COUNTERS, F.lit(0)))


def progressed(roots: DataFrame, counts: DataFrame) -> DataFrame:
    """Running windows add what (source_key, root_key, scheduled_for, started_at, counters) say of that very window;
    negative counts are none."""
    own = counts.select(*ROOT, F.col("scheduled_for").alias("__s"), F.col("started_at").alias("__b"), *(F.greatest(F.col(c), F.lit(0)).alias(f"__{c}") for c in COUNTERS))
    both = roots.join(own, list(ROOT), "left")
    go = (F.col("window_state") == "running") & (F.col("scheduled_for") == F.col("__s")) & (F.col("started_at") == F.col("__b"))
    return _set(both, go, **{c: F.col(c) + F.col(f"__{c}") for c in COUNTERS}).select(roots.columns)


def completed(roots: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """The windows (source_key, root_key, scheduled_for, started_at) are over."""
    own = done.select(*ROOT, F.col("scheduled_for").alias("__s"), F.col("started_at").alias("__b")).distinct()
    both = roots.join(own, list(ROOT), "left")
    return _over(both, (F.col("scheduled_for") == F.col("__s")) & (F.col("started_at") == F.col("__b")), now).select(roots.columns)


def expired(roots: DataFrame, now: Column) -> DataFrame:
    """Running windows whose deadline has come are completed."""
    return _over(roots, (F.col("window_state") == "running") & (F.col("deadline") <= now), now)


def runnable(roots: DataFrame, now: Column) -> DataFrame:
    """Roots of which another file may be verified."""
    open_ = (F.col("window_state") == "running") & F.col("started_at").isNotNull() & (F.col("deadline") > now) & ~F.col("reconciliation_pending")
    return roots.where(open_).select(*ROOT)


def next_deadline(roots: DataFrame) -> DataFrame:
    return roots.where(F.col("window_state") == "running").agg(F.min("deadline").alias("deadline"))


def _next(schedule: Column) -> Column:
    return (F.col("window_state") != "running") & (F.col("scheduled_for").isNull() | (F.col("scheduled_for") < schedule))


def _over(roots: DataFrame, go: Column, now: Column) -> DataFrame:
    return _set(roots, go, window_state=F.lit("completed"), finished_at=now, started_at=F.lit(None), deadline=F.lit(None), skip_reason=F.lit(None))


def _set(rows: DataFrame, go: Column, **values: Column) -> DataFrame:
    rows = rows.withColumn("__go", F.coalesce(go, F.lit(False)))
    return rows.withColumns({c: F.when(F.col("__go"), v.cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}).drop("__go")


def verified(locations: DataFrame, outcomes: DataFrame, roots: DataFrame, now: Column, settle_seconds: int = 0) -> DataFrame:
    """Locations after outcomes (id, source_key, root_key, root_generation, sha1_hex, signature..., result, error,
    attempt_at, before_at, before_error, new_...), the first columns being what the file was chosen by.

    Every result needs an active location of that root with that hash. An attempt and a success also need the same
    signature, and these and resettle a root of that generation that needs no reconciliation. An attempt sets attempted_at, a
    success verified_at, too; both clear the error, which a failure sets. restore puts back what was there before an attempt,
    if that is still the last one. resettle makes the location a discovered one with the file's new signature (new_...),
    to be read when it has settled.
    """
    chosen = [*ROOT, "sha1_hex", *SIGNATURE]
    rest = ["result", "error", "attempt_at", "before_at", "before_error", *(f"new_{c}" for c in SIGNATURE)]
    o = outcomes.select("id", *(F.col(c).alias(f"__{c}") for c in [*chosen, "root_generation", *rest]))
    steady = roots.where(~F.col("reconciliation_pending")).select(*(F.col(c).alias(f"__{c}") for c in (*ROOT, "root_generation")), F.lit(True).alias("__steady"))
    both = locations.join(o.join(steady, [f"__{c}" for c in (*ROOT, "root_generation")], "left"), "id", "left")
    here = (F.col("status") == "active") & all_of([F.col(c) == F.col(f"__{c}") for c in (*ROOT, "sha1_hex")])
    same, trusted = all_of([F.col(c) == F.col(f"__{c}") for c in SIGNATURE]), F.col("__steady").isNotNull()
    r = F.col("__result")
    holds = F.when(r.isin("attempt", "success"), same & trusted).when(r == "resettle", trusted).when(r == "restore", F.col("attempted_at") == F.col("__attempt_at")).otherwise(r == "failure")
    both = both.withColumn("__r", F.when(here & holds, r))
    is_ = lambda *names: F.col("__r").isin(*names)
    values = {
        "attempted_at": F.when(is_("restore"), F.col("__before_at")).otherwise(now),
        "verification_error": F.when(is_("restore"), F.col("__before_error")).when(is_("failure"), F.nullif(F.col("__error"), F.lit(""))),
    }
    both = both.withColumns({c: F.when(F.col("__r").isNotNull(), v).otherwise(F.col(c)) for c, v in values.items()})
    both = both.withColumn("verified_at", F.when(is_("success"), now).when(is_("resettle"), F.lit(None)).otherwise(F.col("verified_at")))
    anew = {"status": F.lit("discovered"), "status_reason": F.col("__error"), "asset_id": F.lit(None), "sha1_hex": F.lit(None), "metadata_not_before": now + F.make_dt_interval(secs=F.lit(settle_seconds)), **{c: F.col(f"__new_{c}") for c in SIGNATURE}}
    return _set(both, is_("resettle"), **anew).select(locations.columns)
