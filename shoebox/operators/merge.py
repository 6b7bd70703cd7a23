"""Snapshots merged with what a source says now. Tables are immutable: each function returns the next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shoebox.functions.scalars import any_of
from shoebox.operators.ordinals import numbered


def differs(columns: list[str], old: str = "o", new: str = "n") -> Column:
    """Whether any column differs, null being a value of its own."""
    return any_of([~F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}")) for c in columns])


def paired(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key with the structs o and n, null where there is none."""
    o = old.select(*(F.col(k) for k in keys), F.struct(*old.columns).alias("o"))
    n = new.select(*(F.col(k) for k in keys), F.struct(*new.columns).alias("n"))
    return o.join(n, keys, "full_outer")


def replaced(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], scope_limited: bool = False, touched: str = "updated_at", now: Column | None = None) -> DataFrame:
    """The snapshot after a full sync: changed rows take the new columns, new ones come in, absent ones are hidden as
    missing (out_of_scope if the sync was limited), and unchanged rows keep everything. `change` tells which."""
    hidden = F.lit("out_of_scope" if scope_limited else "missing")
    both = paired(old, new, keys)
    absent = F.col("n").isNull()
    change = F.when(F.col("o").isNull(), "new").when(absent & (F.col("o.visibility_status") != hidden), "hidden").when(~absent & differs(columns), "changed").otherwise("same")
    both = both.withColumn("change", change)
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.col(c))
        elif c == touched and now is not None:
            out.append(F.when(F.col("change") == "same", F.col(f"o.{c}")).otherwise(now).alias(c))
        elif c == "visibility_status":
            out.append(F.when(F.col("change") == "hidden", hidden).when(absent, F.col("o.visibility_status")).otherwise(F.col("n.visibility_status")).alias(c))
        elif c in columns:
            out.append(F.when(absent, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        else:
            out.append((F.coalesce(f"o.{c}", f"n.{c}") if c in new.columns else F.col(f"o.{c}")).alias(c))
    return both.select(*out, "change")


def changes(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], semantic: list[str]) -> DataFrame:
    """Keys whose row is new, gone or different, and whether what embeddings depend on is."""
    both = paired(old, new, keys)
    gone = F.col("o").isNull() | F.col("n").isNull()
    return both.where(gone | differs(columns)).select(*keys, (gone | differs(semantic)).alias("semantic_changed"))


def last_of_each(batch: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the greatest seq of each key, aggregated before the shuffle."""
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")


def merged(old: DataFrame, batch: DataFrame, keys: list[str], columns: list[str], seq: str = "seq", excluded: str = "excluded", source_time: str | None = None) -> DataFrame:
    """The snapshot after an incremental batch; the last row of a key wins. Merging the same batch again changes nothing.

    A row that the batch names is active again (or what the batch's own visibility_status says), and that alone is a change.
    An excluded row is out of scope from then on, keeps its columns, but takes the source's time (source_time) if the batch
    has one, which is a change, too; one that was never there adds nothing.
    """
    new = last_of_each(batch, keys, seq)
    both = paired(old, new, keys)
    drop = F.coalesce(F.col(f"n.{excluded}"), F.lit(False))
    both = both.where(F.col("o").isNotNull() | ~drop)
    shown = F.coalesce("n.visibility_status", F.lit("active")) if "visibility_status" in new.columns else F.lit("active")
    compared = [*columns, *([source_time] if source_time and source_time not in columns else [])]
    hides = ~F.col("o.visibility_status").eqNullSafe(F.lit("out_of_scope"))
    if source_time:
        hides = hides | (F.col(f"n.{source_time}").isNotNull() & ~F.col(f"n.{source_time}").eqNullSafe(F.col(f"o.{source_time}")))
    alters = differs(compared) | ~F.col("o.visibility_status").eqNullSafe(shown)
    change = F.when(F.col("n").isNull(), "same").when(drop, F.when(hides, "excluded").otherwise("same")).when(F.col("o").isNull(), "new").when(alters, "changed").otherwise("same")
    both = both.withColumn("change", change)
    out = [F.col(k) for k in keys]
    for c in old.columns:
        if c == "visibility_status":
            out.append(F.when(drop, "out_of_scope").when(F.col("n").isNotNull(), shown).otherwise(F.col("o.visibility_status")).alias(c))
        elif c == source_time:
            out.append(F.when(drop, F.coalesce(f"n.{c}", f"o.{c}")).when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        elif c in columns:
            out.append(F.when(F.col("n").isNotNull() & ~drop, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        elif c not in keys:
            out.append(F.col(f"o.{c}").alias(c))
    return both.select(*out, "change")


def requeued(jobs: DataFrame, wanted: DataFrame, keys: list[str], live: tuple[str, ...] = ("running", "queued", "failed")) -> DataFrame:
    """Upsert of wanted jobs: those that are there in a live state keep it, others are queued (again)."""
    both = jobs.select(*keys, "status", "attempts").join(wanted.select(*keys, F.lit(True).alias("wanted")), keys, "full_outer")
    again = F.col("wanted") & ~F.coalesce(F.col("status").isin(*live), F.lit(False))
    return both.select(*keys, F.when(again, "queued").otherwise(F.col("status")).alias("status"), F.when(again, 0).otherwise(F.col("attempts")).alias("attempts"))


def equal_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, counted with their copies; empty if the tables are equal."""
    left = a.exceptAll(b).withColumn("side", F.lit("left"))
    return left.unionByName(b.select(a.columns).exceptAll(a).withColumn("side", F.lit("right")))


def generation_of(snapshot: DataFrame, generation: int, id_col: str = "id") -> DataFrame:
    """A generation's rows with their ordinal from 0 by id, whatever the ids are."""
    return numbered(snapshot, [F.col(id_col)], "ordinal").withColumn("generation", F.lit(generation))


def dirty_state(changed: DataFrame, generation: int) -> DataFrame:
    """One row: the next generation if anything semantic changed, and whether a refresh is due."""
    one = changed.agg(F.count("*").alias("changed_ids"), F.count_if("semantic_changed").alias("semantic_ids"))
    return one.select((F.lit(generation) + F.when(F.col("semantic_ids") > 0, 1).otherwise(0)).alias("asset_generation"), (F.col("changed_ids") > 0).alias("refresh_required"), "changed_ids")


def refreshed_metadata(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Only rows that really differ are rewritten; null new values keep the old."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, keys, "left")
    changed = any_of([F.col(f"n.{c}").isNotNull() & ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in columns])
    out = [F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in columns else F.col(c) if c in keys else F.col(f"o.{c}") for c in old.columns]
    return both.select(*out, changed.alias("rewritten"))
