"""The gallery timeline: newest first, then by id; positions, days and pages."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from shoebox.operators.ordinals import numbered
from shoebox.request import Resolved


def newest_first(id_col: str = "canonical_asset_id") -> list[Column]:
    return [F.col("captured_at").desc(), F.col(id_col).asc()]


def matches(r: Resolved) -> Column:
    """Media types and the half-open time range; both reach the scan."""
    cond = F.lit(True)
    if r.media_types:
        cond = cond & F.col("media_type").isin(*r.media_types)
    if r.captured_from is not None:
        cond = cond & (F.col("captured_at") >= F.lit(r.captured_from).cast("timestamp_ntz"))
    if r.captured_to is not None:
        cond = cond & (F.col("captured_at") < F.lit(r.captured_to).cast("timestamp_ntz"))
    return cond


def page(assets: DataFrame, r: Resolved, id_col: str = "canonical_asset_id") -> DataFrame:
    """One page: a top-k over offset + size rows, not a sort of all."""
    return assets.where(matches(r)).orderBy(*newest_first(id_col)).offset(r.offset).limit(r.page_size)


def look_ahead(assets: DataFrame, r: Resolved, id_col: str = "canonical_asset_id") -> DataFrame:
    """The page with has_more and total: exact on the first page and with filters, else the lower bound that one row
    more than the page shows."""
    more = assets.where(matches(r)).orderBy(*newest_first(id_col)).offset(r.offset).limit(r.page_size + 1)
    rows = more.withColumn("n", F.row_number().over(Window.orderBy(*newest_first(id_col))))  # page_size + 1 rows
    exact = r.page == 0 or bool(r.media_types) or r.captured_from is not None or r.captured_to is not None
    total = assets.where(matches(r)).agg(F.count("*").alias("total")) if exact else more.agg((F.count("*") + r.offset).alias("total"))
    ahead = more.agg((F.count("*") > r.page_size).alias("has_more"))
    return rows.where(F.col("n") <= r.page_size).drop("n").join(total.join(ahead)).withColumn("total_kind", F.lit("exact" if exact else "lowerBound"))


def page_boundaries(assets: DataFrame, size: int, group: str) -> DataFrame:
    """(group, page, n_items, boundary) of every page of each group's timeline, and of the one after its last: where the
    page lies, as page_boundary() of requests tells. A group's count alone decides."""
    sizes = assets.groupBy(group).agg(F.count("*").alias("n"))
    pages = sizes.withColumn("page", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / size))))
    items = F.greatest(F.lit(0), F.least(F.lit(size), F.col("n") - F.col("page") * size))
    where = F.when((F.col("page") > 0) & (F.col("n_items") == 0), "pastEnd").when(F.col("n") > (F.col("page") + 1) * size, "more").otherwise("end")
    return pages.withColumn("n_items", items).select(group, "page", "n_items", where.alias("boundary"))


def keyset_page(assets: DataFrame, captured_at, last_id: str, size: int, id_col: str = "canonical_asset_id") -> DataFrame:
    """The rows from (captured_at, id) on, that row included."""
    at = F.lit(captured_at).cast("timestamp_ntz")
    return assets.where((F.col("captured_at") <= at) & ((F.col("captured_at") < at) | (F.col(id_col) >= last_id))).orderBy(*newest_first(id_col)).limit(size)


def day_index(assets: DataFrame) -> DataFrame:
    """(captured_day, item_count, start): rows of each day and the position of its first."""
    days = assets.groupBy(F.date_format("captured_at", "yyyy-MM-dd").alias("captured_day")).agg(F.count("*").alias("item_count"))
    before = Window.orderBy(F.col("captured_day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return days.withColumn("start", F.coalesce(F.sum("item_count").over(before), F.lit(0)))  # one row a day


def with_positions(assets: DataFrame, id_col: str = "canonical_asset_id") -> DataFrame:
    """assets with global_position from 0."""
    return numbered(assets, newest_first(id_col), "global_position")


def seek(positions: DataFrame, start: int, size: int) -> DataFrame:
    """Rows start to start + size - 1 of a table with positions: a range filter that files sorted by position skip by."""
    return positions.where((F.col("global_position") >= start) & (F.col("global_position") < start + size))


def day_at(days: DataFrame, offset: int) -> DataFrame:
    """The day that has position `offset`, and the row's number within it."""
    return days.where((F.col("start") <= offset) & (offset < F.col("start") + F.col("item_count"))).withColumn("within", F.lit(offset) - F.col("start"))


def page_by_day(assets: DataFrame, days: DataFrame, offset: int, size: int, id_col: str = "canonical_asset_id") -> DataFrame:
    """The same rows as page(), from the days that the page touches only; where they start is looked up first."""
    touched = days.where((F.col("start") < offset + size) & (F.col("start") + F.col("item_count") > offset))
    start, first, last = touched.agg(F.min("start"), F.max("captured_day"), F.min("captured_day")).first()
    if start is None:  # past the end
        return assets.limit(0)
    return assets.where(of_days(last, first)).orderBy(*newest_first(id_col)).offset(offset - start).limit(size)


def of_days(first: str, last: str) -> Column:
    """From the start of the first day to the end of the last, as a range of times that files are skipped by."""
    start, stop = date.fromisoformat(first), date.fromisoformat(last) + timedelta(days=1)
    return (F.col("captured_at") >= F.lit(str(start)).cast("timestamp_ntz")) & (F.col("captured_at") < F.lit(str(stop)).cast("timestamp_ntz"))


def rank_of_time(assets: DataFrame, days: DataFrame, moment: datetime) -> DataFrame:
    """How many rows are newer than the moment: whole days by their counts, the moment's own day by its rows."""
    day = str(moment.date())
    whole = days.where(F.col("captured_day") > day).agg(F.coalesce(F.sum("item_count"), F.lit(0)).alias("whole"))
    part = assets.where(of_days(day, day) & (F.col("captured_at") > F.lit(moment).cast("timestamp_ntz"))).agg(F.count("*").alias("part"))
    return whole.join(part).select((F.col("whole") + F.col("part")).alias("position"))


def late_payload(keys: DataFrame, payload: DataFrame, id_col: str) -> DataFrame:
    """A page of keys with the wide columns looked up afterwards."""
    return payload.join(F.broadcast(keys.select(id_col)), id_col)  # a page


def ready_assets(canonical: DataFrame, rows: DataFrame, renditions: DataFrame, local_assets: DataFrame, configured: DataFrame) -> DataFrame:
    """(canonical_asset_id, source_key, upstream_asset_id, media_type, filename, captured_at, duration) of active canonical
    assets that can be shown, with the source that shows them.

    configured: (role, source_key). The source is the best active copy on a local datasource of role 'local' or a remote
    one of role 'remote': local ones first, then by source key and id. It shows the asset if it is not local; if it has the
    role 'local_fallback', too, and the asset has a copy of role 'remote'; or if both renditions of its active local
    asset, whose thumbnail must be ready, are ready, have a path and are of its current content.
    """
    roles = configured.select("role", F.col("source_key").alias("c_source")).distinct()
    kind = F.when(F.col("role") == "local", "local_filesystem").when(F.col("role") == "remote", "remote_mirror")
    usable = roles.select("c_source", kind.alias("c_kind")).where("c_kind IS NOT NULL")
    found = rows.where(F.col("visibility_status") == "active").join(F.broadcast(usable), (F.col("source_key") == F.col("c_source")) & (F.col("datasource_kind") == F.col("c_kind")))  # configuration
    order = F.struct((F.col("datasource_kind") != "local_filesystem").alias("late"), "source_key", "upstream_asset_id")
    best = found.groupBy("canonical_asset_id").agg(F.min(order).alias("s"), F.max(F.col("datasource_kind") == "remote_mirror").alias("has_remote"))
    best = best.select("canonical_asset_id", "has_remote", (~F.col("s.late")).alias("is_local"), "s.source_key", "s.upstream_asset_id")
    fallback = roles.where("role = 'local_fallback'").select("c_source", F.lit(True).alias("may_fall_back"))
    best = best.join(F.broadcast(fallback), F.col("source_key") == F.col("c_source"), "left")  # configuration
    current = local_assets.where((F.col("visibility_status") == "active") & (F.col("thumbnail_status") == "ready")).select("source_key", "asset_id", F.col("sha1_hex").alias("source_sha1_hex"))
    made = renditions.where((F.col("status") == "ready") & F.col("kind").isin("preview", "detail_preview") & (F.trim(F.coalesce("relative_path", F.lit(""))) != ""))
    shown = made.join(current, ["source_key", "asset_id", "source_sha1_hex"]).groupBy("source_key", F.col("asset_id").alias("upstream_asset_id")).agg(F.countDistinct("kind").alias("kinds"))
    best = best.join(shown, ["source_key", "upstream_asset_id"], "left")
    ready = best.where(~F.col("is_local") | (F.col("has_remote") & F.col("may_fall_back")) | (F.col("kinds") == 2))
    columns = ["canonical_asset_id", "source_key", "upstream_asset_id", "media_type", "filename", "captured_at", "duration"]
    return canonical.where(F.col("visibility_status") == "active").join(ready.select(*columns[:3]), "canonical_asset_id").select(*columns)


def embeddable(rows: DataFrame, renditions: DataFrame) -> DataFrame:
    """Active rows that can be embedded: remote ones, and local images with a ready rendition that has a path."""
    ready = renditions.where((F.col("status") == "ready") & F.col("kind").isin("detail_preview", "preview") & F.col("relative_path").isNotNull()).select("source_key", F.col("asset_id").alias("upstream_asset_id")).distinct().withColumn("rendered", F.lit(True))
    both = rows.where(F.col("visibility_status") == "active").join(ready, ["source_key", "upstream_asset_id"], "left")
    return both.where((F.col("datasource_kind") != "local_filesystem") | ((F.col("media_type") == "image") & F.coalesce("rendered", F.lit(False)))).drop("rendered")


def embedding_inputs(canonical: DataFrame, rows: DataFrame, renditions: DataFrame, local_assets: DataFrame, sources: list[str]) -> DataFrame:
    """What each active canonical asset is embedded from: a rendition of the local file (the detailed one first) that is of
    its current content, nothing while a local asset has none, else the remote preview.

    The copy is the best active one on the configured sources: local ones first, then remote ones, then the latest, by
    source key and id. Without such a copy there is nothing to embed.
    """
    mine = rows.where((F.col("visibility_status") == "active") & F.col("source_key").isin(sources))
    rank = F.when(F.col("datasource_kind") == "local_filesystem", 0).when(F.col("datasource_kind") == "remote_mirror", 1).otherwise(2)
    order = F.struct(rank.alias("rank"), (-F.unix_micros(F.col("captured_at").cast("timestamp"))).alias("late"), "source_key", "upstream_asset_id")
    copy = mine.groupBy("canonical_asset_id").agg(F.min_by(F.struct("source_key", "upstream_asset_id", "datasource_kind"), order).alias("c")).select("canonical_asset_id", "c.*")
    current = local_assets.where(F.col("visibility_status") == "active").select("source_key", "asset_id", F.col("sha1_hex").alias("source_sha1_hex"))
    made = renditions.where((F.col("status") == "ready") & F.col("kind").isin("detail_preview", "preview") & (F.trim(F.coalesce("relative_path", F.lit(""))) != ""))
    prefer = F.when(F.col("kind") == "detail_preview", 0).otherwise(1)
    best = made.join(current, ["source_key", "asset_id", "source_sha1_hex"]).groupBy("source_key", F.col("asset_id").alias("upstream_asset_id")).agg(F.min_by("kind", prefer).alias("rendition_kind"))
    both = canonical.where(F.col("visibility_status") == "active").select("canonical_asset_id").join(copy, "canonical_asset_id", "left").join(best, ["source_key", "upstream_asset_id"], "left")
    local, has = F.col("datasource_kind") == "local_filesystem", F.col("rendition_kind").isNotNull()
    kind = F.when(local & has, F.concat(F.lit("local_"), "rendition_kind")).when(F.col("datasource_kind") == "remote_mirror", "remote_preview").otherwise("")
    of = lambda c: F.when(local & ~has, "").otherwise(F.coalesce(c, F.lit(""))).alias(f"embedding_{c}")
    return both.select("canonical_asset_id", kind.alias("embedding_input"), of("source_key"), of("upstream_asset_id"))
