"""Source rows of several datasources become one canonical asset for each content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shoebox.functions import scalars as S

KEY = ["source_key", "upstream_asset_id"]


def with_canonical_ids(rows: DataFrame) -> DataFrame:
    """Source rows with canonical_asset_id, from their content identity or else their own key."""
    sha1, size = S.content_identity(F.col("content_sha1_hex"), F.col("content_size_bytes"), F.col("checksum_algorithm"), F.col("canonical_sha1_hex"), F.col("canonical_size_bytes"))
    return rows.withColumn("canonical_asset_id", S.canonical_id(F.col("media_type"), sha1, size, F.col("source_key"), F.col("upstream_asset_id")))


def source_rank(rows: DataFrame) -> DataFrame:
    """rows with visibility_rank and datasource_rank."""
    return rows.withColumns({"visibility_rank": S.rank_of(F.col("visibility_status"), S.VISIBILITY_RANKS), "datasource_rank": S.rank_of(F.col("datasource_kind"), S.DATASOURCE_RANKS)})


def canonical_assets(rows: DataFrame) -> DataFrame:
    """One row for each canonical id of rows that have one: the primary source's columns, merged with the others'.

    The primary has the least visibility rank, then datasource rank, then the latest time, source key and id. A blank
    duration is taken from the first active source that has one; first_seen_at is the least; favourite if any is. The
    content hash and size are the primary's content identity: a hash of its path is none. All is one aggregation with map-side merging, so an id with very many sources does not meet in one task.
    """
    sha1, size = S.content_identity(F.col("content_sha1_hex"), F.col("content_size_bytes"), F.col("checksum_algorithm"), F.col("canonical_sha1_hex"), F.col("canonical_size_bytes"))
    ranked = source_rank(rows).where(F.col("canonical_asset_id").isNotNull()).withColumns({"content_sha1_hex": sha1, "content_size_bytes": size})
    order = F.struct("visibility_rank", "datasource_rank", (-F.unix_micros(F.col("captured_at").cast("timestamp"))).alias("late"), *KEY)
    primary = F.struct(*KEY, "media_type", "filename", "captured_at", "duration", "visibility_status", "datasource_kind", "place_label", "description", "content_sha1_hex", "content_size_bytes")
    timed = (F.col("visibility_status") == "active") & ~S.blank(F.col("duration"))
    found = ranked.groupBy("canonical_asset_id").agg(
        F.min_by(primary, order).alias("p"), F.min_by(F.when(timed, F.col("duration")), F.when(timed, order)).alias("other_duration"), F.count("*").alias("source_count"),
        F.max("is_favorite").alias("is_favorite"), F.min("first_seen_at").alias("first_seen_at"), F.max("updated_at").alias("updated_at"),
    )
    duration = F.when(S.blank(F.col("p.duration")), F.coalesce("other_duration", "p.duration")).otherwise(F.col("p.duration"))
    return found.select(
        "canonical_asset_id", F.col("p.source_key").alias("primary_source_key"), F.col("p.upstream_asset_id").alias("primary_upstream_asset_id"), "p.media_type", "p.filename", "p.captured_at",
        duration.alias("duration"), "p.visibility_status", "p.datasource_kind", "source_count", (F.col("source_count") - 1).alias("duplicate_source_count"), "is_favorite", "p.place_label",
        "p.description", "p.content_sha1_hex", "p.content_size_bytes", "first_seen_at", "updated_at",
    )


def kept_first_seen(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rebuilt canonical rows; an id that was there before keeps its first_seen_at."""
    before = old.select("canonical_asset_id", F.col("first_seen_at").alias("seen_before"))
    return new.join(before, "canonical_asset_id", "left").withColumn("first_seen_at", F.coalesce("seen_before", "first_seen_at")).drop("seen_before")


def refreshed(canonical: DataFrame, rows: DataFrame, changed: DataFrame) -> DataFrame:
    """canonical with the ids of `changed` worked out anew from rows; equal to canonical_assets(rows) if those are all."""
    ids = changed.select("canonical_asset_id").distinct()
    new = kept_first_seen(canonical_assets(rows.join(ids, "canonical_asset_id", "left_semi")), canonical)
    return canonical.join(ids, "canonical_asset_id", "left_anti").unionByName(new)


def primary_sources(rows: DataFrame, canonical: DataFrame) -> DataFrame:
    """The canonical asset of each source row that is its primary."""
    on = (rows.source_key == canonical.primary_source_key) & (rows.upstream_asset_id == canonical.primary_upstream_asset_id)
    return rows.join(canonical.select(F.col("canonical_asset_id").alias("primary_of"), "primary_source_key", "primary_upstream_asset_id", "source_count"), on)


def copies_of(rows: DataFrame, named: DataFrame, kind: str = "remote_mirror") -> DataFrame:
    """Active rows of one kind of datasource with the canonical id of a row named by (source_key, upstream_asset_id)."""
    ids = rows.join(named, KEY, "left_semi").select(F.col("canonical_asset_id"), F.col("source_key").alias("named_source"), F.col("upstream_asset_id").alias("named_id"))
    others = rows.where((F.col("visibility_status") == "active") & (F.col("datasource_kind") == kind))
    return ids.join(others, "canonical_asset_id").select("named_source", "named_id", "canonical_asset_id", *KEY)


def deduplication_status(rows: DataFrame, canonical: DataFrame) -> DataFrame:
    """One row: counts of source rows, canonical assets, active ones, duplicates, unlinked and orphan rows."""
    linked = rows.groupBy("canonical_asset_id").agg(F.count("*").alias("rows"))
    assets = canonical.select(F.col("canonical_asset_id").alias("asset"), (F.col("visibility_status") == "active").alias("active"), "duplicate_source_count")
    both = linked.join(assets, F.col("canonical_asset_id") == F.col("asset"), "full_outer")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = both.agg(
        total("rows").alias("source_rows"), F.count("asset").alias("canonical_assets"), F.count_if("active").alias("active_assets"), total("duplicate_source_count").alias("duplicate_source_rows"),
        total(F.when(F.col("asset").isNull(), F.col("rows"))).alias("unlinked_source_rows"), F.count_if(F.col("rows").isNull()).alias("orphan_canonical_rows"),
    )
    return one.withColumn("needs_repair", (F.col("unlinked_source_rows") > 0) | (F.col("orphan_canonical_rows") > 0))


def needs_repair(rows: DataFrame, canonical: DataFrame) -> DataFrame:
    """One row: whether any row lacks its canonical asset, by looking for one."""
    missing = rows.where(F.col("canonical_asset_id").isNull()).select(F.lit(1).alias("x")).limit(1)
    missing = missing.unionByName(rows.join(canonical, "canonical_asset_id", "left_anti").select(F.lit(1).alias("x")).limit(1))
    return missing.agg((F.count("*") > 0).alias("needs_repair"))


def _first_of_each(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The first row of each group, found by partial aggregation: a group with very many rows never meets in one task."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(F.col(group).alias("__group")).agg(first.alias("r")).select("r.*")


def displayed_source(rows: DataFrame, sources: list[str]) -> DataFrame:
    """The first active copy of each canonical asset on the configured sources, by source key and id."""
    mine = rows.where(F.col("source_key").isin(sources) & (F.col("visibility_status") == "active"))
    return _first_of_each(mine, "canonical_asset_id", KEY)


def preferred_source(rows: DataFrame) -> DataFrame:
    """The best active copy of each canonical asset: local ones first, then by source key and id."""
    return _first_of_each(source_rank(rows).where(F.col("visibility_status") == "active"), "canonical_asset_id", ["datasource_rank", *KEY])


# Paths that a remote library shares with a local root


def mapped_paths(paths: DataFrame, mappings: DataFrame, last_wins: bool = False) -> DataFrame:
    """paths (id, source_key, original_path) with (local_source, root_key, relative_path) of the mapping (position,
    source_key, prefix, local_source, root_key) whose prefix and '/' start the path; the first by position wins, or the last.

    A source's mappings are configuration, some dozens; they come to each path as one array that is searched in place, so
    paths are neither multiplied nor grouped. Paths and prefixes are cleaned first. Of mappings at one position the least (or greatest) in the other columns wins.
    """
    prefix = S.clean_path(F.col("prefix"))
    own = F.struct("position", prefix.alias("prefix"), "local_source", "root_key")
    m = mappings.groupBy(F.col("source_key").alias("m_source")).agg(F.collect_list(own).alias("mappings"))
    p = paths.withColumn("path", S.clean_path(F.col("original_path"))).join(m, F.col("source_key") == F.col("m_source"))
    hits = F.filter("mappings", lambda x: (x["prefix"] != "") & F.startswith(F.col("path"), F.concat(x["prefix"], F.lit("/"))))
    rest = lambda x: S.clean_relative_path(F.substr(F.col("path"), F.length(x["prefix"]) + 2))
    found = F.transform(hits, lambda x: F.struct(x["position"].alias("position"), x["local_source"].alias("local_source"), x["root_key"].alias("root_key"), rest(x).alias("relative_path")))
    found = F.filter(found, lambda x: x["relative_path"].isNotNull())
    best = p.withColumn("m", (F.array_max if last_wins else F.array_min)(found)).where("m IS NOT NULL")
    return best.select("id", "source_key", "original_path", "m.local_source", "m.root_key", "m.relative_path")


def _key(sha1: Column) -> Column:
    """The hash as a join key of its own column, normalised once."""
    return S.given(sha1, S.sha1_hex)


def external_identities(rows: DataFrame, local: DataFrame, mappings: DataFrame) -> DataFrame:
    """The content identity of remote rows whose checksum is that of their path, from the local file behind the path.

    local: (local_source, root_key, relative_path, media_type, sha1_hex, size_bytes) of active locations. A path that
    several mappings make belongs to the last of them.
    """
    prefix = S.clean_path(F.col("prefix"))
    m = mappings.select("position", F.col("source_key").alias("m_source"), prefix.alias("prefix"), "local_source", "root_key")
    behind = local.join(m, ["local_source", "root_key"])
    behind = behind.withColumn("checksum", S.path_checksum(F.concat("prefix", F.lit("/"), "relative_path")))
    behind = behind.groupBy("m_source", "media_type", "checksum").agg(F.max_by(F.struct("sha1_hex", "size_bytes"), F.struct("position", "relative_path")).alias("found"))
    mine = rows.where(F.col("checksum_algorithm") == "sha1-path").select(*KEY, "media_type", _key(F.col("content_sha1_hex")).alias("own_checksum"))
    on = (mine.source_key == behind.m_source) & (mine.media_type == behind.media_type) & (mine.own_checksum == behind.checksum)
    return mine.join(behind, on).select(mine.source_key, mine.upstream_asset_id, F.col("found.sha1_hex").alias("canonical_sha1_hex"), F.col("found.size_bytes").alias("canonical_size_bytes"))


def reconciled_identities(rows: DataFrame, desired: DataFrame) -> DataFrame:
    """Rows whose set identity must change, with the new one (null: to be cleared)."""
    now = rows.select(*KEY, F.col("canonical_sha1_hex").alias("old_sha1"), F.col("canonical_size_bytes").alias("old_size"))
    both = now.join(desired.withColumnsRenamed({"canonical_sha1_hex": "new_sha1", "canonical_size_bytes": "new_size"}), KEY, "left")
    changed = ~F.col("old_sha1").eqNullSafe(F.col("new_sha1")) | ~F.col("old_size").eqNullSafe(F.col("new_size"))
    return both.where(changed).withColumn("action", F.when(F.col("new_sha1").isNull(), "clear").when(F.col("old_sha1").isNull(), "set").otherwise("replace"))


def identity_fallback(rows: DataFrame, lost: DataFrame, locations: DataFrame, mappings: DataFrame) -> DataFrame:
    """For lost local paths (local_source, root_key, relative_path): the remote rows that had their identity from them,
    with the newest other active location of that path (the greatest id), or nulls. Of several mappings the last wins."""
    prefix = S.clean_path(F.col("prefix"))
    m = mappings.select("position", F.col("source_key").alias("m_source"), prefix.alias("prefix"), "local_source", "root_key")
    paths = lost.join(m, ["local_source", "root_key"]).withColumn("checksum", S.path_checksum(F.concat("prefix", F.lit("/"), "relative_path")))
    paths = paths.groupBy("m_source", "checksum").agg(F.max_by(F.struct("local_source", "root_key", "relative_path"), "position").alias("path")).select("m_source", "checksum", "path.*")
    mine = rows.where(F.col("checksum_algorithm") == "sha1-path").select(*KEY, _key(F.col("content_sha1_hex")).alias("own_checksum"))
    hit = mine.join(paths, (F.col("source_key") == F.col("m_source")) & (F.col("own_checksum") == F.col("checksum")))
    active = locations.where(F.col("status") == "active").groupBy("local_source", "root_key", "relative_path").agg(F.max_by(F.struct("sha1_hex", "size_bytes"), "id").alias("now"))
    return hit.join(active, ["local_source", "root_key", "relative_path"], "left").select(*KEY, "relative_path", F.col("now.sha1_hex").alias("new_sha1"), F.col("now.size_bytes").alias("new_size"))
