"""The state of embeddings: what is eligible, done and published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def progress(eligible: DataFrame, vectors: DataFrame, model_id: str) -> DataFrame:
    """A row a source: eligible assets, ready and failed vectors of the model."""
    own = vectors.where(F.col("model_id") == model_id).select("source_key", "asset_id", F.col("status").alias("vector_status"))
    both = eligible.join(own, ["source_key", "asset_id"], "left")
    return both.groupBy("source_key").agg(F.count("*").alias("eligible"), F.count_if(F.col("vector_status") == "ready").alias("completed"), F.count_if(F.col("vector_status") == "failed").alias("failed"))


def to_embed(eligible: DataFrame, vectors: DataFrame, requests: DataFrame, profile: dict, retry_before: Column, n: int) -> DataFrame:
    """The next n eligible assets that have no vector of the profile (model_id, vector_space_id, embedding_dim): none at
    all, one of another space or length, one that is still to be made, or one that failed before retry_before, at no known
    time, or is asked for again. Failed ones come last, then the newest first, by source and id."""
    keys = ["source_key", "asset_id"]
    model = F.col("model_id") == profile["model_id"]
    own = vectors.where(model).select(*keys, F.col("status").alias("vector_status"), "vector_space_id", "embedding_dim", "generated_at")
    asked = requests.where(model).select(*keys, F.lit(True).alias("asked")).distinct()
    both = eligible.join(own, keys, "left").join(asked, keys, "left")
    failed = F.col("vector_status") == "failed"
    again = failed & (F.col("generated_at").isNull() | (F.col("generated_at") <= retry_before) | F.coalesce("asked", F.lit(False)))
    other = (F.col("vector_space_id") != profile["vector_space_id"]) | (F.col("embedding_dim") != profile["embedding_dim"])
    open_ = F.col("vector_status").isNull() | other | ~F.col("vector_status").isin("ready", "failed") | again
    late = F.when(failed, 1).otherwise(0)
    return both.where(open_).orderBy(late, F.col("captured_at").desc(), *keys).limit(n).select(*keys, "vector_status", late.alias("late"))


def stale_inputs(inputs: DataFrame, vectors: DataFrame, stored: DataFrame, requests: DataFrame) -> DataFrame:
    """What to do about each embedding input by its vector, the stored fingerprint and requests: a chain of left joins."""
    v = vectors.select("asset_id", F.col("status").alias("vector_status"))
    s = stored.select("asset_id", F.col("fingerprint").alias("stored_fingerprint"))
    r = requests.select("asset_id", F.lit(True).alias("asked")).distinct()
    both = inputs.join(v, "asset_id", "left").join(s, "asset_id", "left").join(r, "asset_id", "left")
    todo = (
        F.when(F.col("fingerprint") == "", "wait")
        .when(F.col("vector_status").isNull(), "embed")
        .when(~F.col("fingerprint").eqNullSafe(F.col("stored_fingerprint")), "embed_again")
        .when((F.col("vector_status") == "failed") & F.coalesce("asked", F.lit(False)), "retry")
        .when(F.col("vector_status") == "failed", "failed")
        .otherwise("ready")
    )
    return both.select("asset_id", todo.alias("todo"))


def settled(eligible: Column, completed: Column, failed: Column) -> Column:
    return (completed >= eligible) | (failed >= eligible - F.greatest(completed, F.lit(0)))


def publish_needed(s: dict[str, Column], allow_partial: Column, index_matches: Column) -> Column:
    """Whether the index is to be built anew; s: eligible, completed, failed, indexed, asset_generation, indexed_generation."""
    done = settled(s["eligible"], s["completed"], s["failed"])
    return (
        F.when(s["asset_generation"] != s["indexed_generation"], F.when(s["completed"] == 0, done).otherwise(allow_partial | done))
        .when(s["indexed"] >= s["completed"], ~index_matches)
        .otherwise(allow_partial | done)
    )


def partial_threshold(indexed: Column) -> Column:
    """New vectors from which a part is published: a fifth of the indexed, rounded up, at least 1."""
    return F.when(indexed <= 0, F.lit(1)).otherwise(F.greatest(F.ceil(indexed / 5), F.lit(1))).cast("long")


def backfill_status(eligible: Column, completed: Column, indexed: Column, mismatched: Column, pending_jobs: Column, failed_jobs: Column) -> Column:
    return (
        F.when((completed == 0) & (eligible > 0), "pending")
        .when(completed < eligible, "backfilling")
        .when(mismatched | (indexed < completed) | (pending_jobs > 0) | (failed_jobs > 0), "indexing")
        .otherwise("ready")
    )


def upserted(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors with new ones in; what was published of them (indexed_generation) stays as it was."""
    keys = ["source_key", "asset_id", "model_id"]
    n = new.select(*keys, F.col("status").alias("n_status"), F.col("vector").alias("n_vector"))
    both = vectors.join(n, keys, "full_outer")
    fresh = F.col("n_status").isNotNull()
    return both.select(*keys, F.coalesce("n_status", "status").alias("status"), F.when(fresh, F.col("n_vector")).otherwise(F.col("vector")).alias("vector"), F.coalesce("indexed_generation", F.lit(0)).alias("indexed_generation"))


def published(states: DataFrame, built: DataFrame) -> DataFrame:
    """States after builds (source_key, generation, indexed): only a build of the state's present generation counts."""
    b = built.select("source_key", F.col("generation").alias("b_generation"), F.col("indexed").alias("b_indexed"))
    both = states.join(b, "source_key", "left")
    ok = F.coalesce(F.col("asset_generation") == F.col("b_generation"), F.lit(False))
    return both.select("source_key", "asset_generation", F.when(ok, F.col("b_generation")).otherwise(F.col("indexed_generation")).alias("indexed_generation"), F.when(ok, F.col("b_indexed")).otherwise(F.col("indexed")).alias("indexed"))


def membership_problems(members: DataFrame, states: DataFrame) -> DataFrame:
    """Sources whose published members are not what the state says: their count, or gaps in the ordinals."""
    got = members.groupBy("source_key").agg(F.count("*").alias("members"), F.max("ordinal").alias("last"), F.countDistinct("ordinal").alias("ordinals"))
    both = states.join(got, "source_key", "left").withColumn("members", F.coalesce("members", F.lit(0)))
    bad = F.when(F.col("members") != F.col("indexed"), "count").when((F.col("members") > 0) & ((F.col("ordinals") != F.col("members")) | (F.col("last") + 1 != F.col("members"))), "ordinals")
    return both.select("source_key", bad.alias("problem")).where("problem IS NOT NULL")


def reconciled_payloads(vectors: DataFrame, batches: DataFrame) -> DataFrame:
    """Vectors that point into a missing or too short batch (batch_id, n_bytes) are pending again."""
    both = vectors.join(batches, "batch_id", "left")
    bad = (F.col("status") == "ready") & (F.col("n_bytes").isNull() | (F.col("payload_offset") + F.col("payload_bytes") > F.col("n_bytes")))
    return both.select("asset_id", F.when(bad, "pending").otherwise(F.col("status")).alias("status"), F.when(~bad, F.col("batch_id")).alias("batch_id"))


def unreferenced(batches: DataFrame, vectors: DataFrame) -> DataFrame:
    return batches.join(vectors.where(F.col("batch_id").isNotNull()), "batch_id", "left_anti")
