"""JSON that remote libraries send: tolerant decoding into source rows, static manifests, paged exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shoebox.functions import scalars as S

#: Every field as text: numbers come as numbers or strings, times in several forms.
RECORD = "id string, type string, originalFileName string, checksum string, fileCreatedAt string, updatedAt string, duration string, isFavorite string, visibility string, exifInfo struct<city:string,state:string,country:string,description:string,fileSizeInByte:string>"
TIME_FORMS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]X", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def any_time(c: Column) -> Column:
    """By the first form that fits; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in TIME_FORMS)).cast("timestamp_ntz")


def any_duration(c: Column) -> Column:
    """Milliseconds become H:MM:SS.fff; other text stays."""
    ms = c.try_cast("bigint")
    return F.when(ms.isNotNull(), S.duration_text(ms, 3)).otherwise(c)


def any_sha1(c: Column) -> Column:
    """Hex as it is, base64 of 20 bytes as hex, else ''."""
    b64 = F.when(c.rlike("^[A-Za-z0-9+/]{27}=$"), F.lower(F.hex(F.unbase64(c))))
    return F.when(S.sha1_hex(c) != "", S.sha1_hex(c)).otherwise(F.coalesce(b64, F.lit("")))


def decoded(lines: DataFrame, column: str = "value") -> DataFrame:
    """Source rows from a column of JSON records; a record that is no JSON gives nulls."""
    r = lines.select(F.from_json(column, RECORD).alias("r")).select("r.*")
    return r.select(
        F.col("id").alias("upstream_asset_id"), F.lower("type").alias("media_type"), F.col("originalFileName").alias("filename"), any_sha1(F.col("checksum")).alias("content_sha1_hex"),
        F.col("exifInfo.fileSizeInByte").try_cast("bigint").alias("content_size_bytes"), any_time(F.col("fileCreatedAt")).alias("captured_at"), any_time(F.col("updatedAt")).alias("source_updated_at"),
        any_duration(F.col("duration")).alias("duration"), F.coalesce(F.lower("isFavorite").isin("true", "1"), F.lit(False)).alias("is_favorite"),
        S.place_label(F.col("exifInfo.city"), F.col("exifInfo.state"), F.col("exifInfo.country")).alias("place_label"), F.coalesce("exifInfo.description", F.lit("")).alias("description"),
    )


def paged_export(pages: DataFrame) -> DataFrame:
    """Rows of landed pages (page, id, updated_at, ...): pages overlap at their edges, so each (id, updated_at) counts
    once, from its first page."""
    rest = [c for c in pages.columns if c not in ("id", "updated_at")]
    return pages.groupBy("id", "updated_at").agg(F.min_by(F.struct(*rest), "page").alias("r")).select("id", "updated_at", "r.*")


def boundary_overflow(pages: DataFrame, most: int = 1000) -> DataFrame:
    """Times that more than `most` rows share: a pager that goes on from a time can't pass them."""
    return pages.groupBy("updated_at").agg(F.countDistinct("id").alias("n")).where(F.col("n") > most)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A version 1 manifest's assets in file order, with their position; another version or a blank id raises."""
    asset = "struct<id:string,type:string,originalFileName:string,fileCreatedAt:string,duration:string,previewPath:string,originalPath:string>"
    doc = spark.read.schema(f"version int, assets array<{asset}>").json(path, multiLine=True)
    rows = doc.select("version", F.posexplode("assets").alias("position", "a")).select("version", "position", "a.*")
    bad = F.coalesce(F.col("version"), F.lit(0)) != 1
    checked = F.when(bad, F.raise_error(F.lit("unknown manifest version"))).when(S.blank(F.col("id")), F.raise_error(F.lit("manifest asset without an id"))).otherwise(F.col("id"))
    return rows.withColumn("id", checked).drop("version")
