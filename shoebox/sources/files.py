"""Files of a tree as rows, read by Spark's own listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What counts as media, and the folders that a scan leaves alone.
IMAGES = ("jpg", "jpeg", "png", "webp", "heic", "heif")
VIDEOS = ("mp4", "mov")
SYSTEM_FOLDERS = ("@eadir", "@recycle", "#recycle", "@recently-snapshot")
PACKAGE_ENDINGS = ("app", "bundle", "photoslibrary", "library")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))


def media_type_of(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(*IMAGES), "image").when(ext.isin(*VIDEOS), "video")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, directory, size_bytes, mtime, media_type, skip_reason) of all files under root.

    skip_reason is null for the files that count. The files themselves are not read: their content column is pruned.
    Spark's listing leaves out hidden names by itself: those that start with '.', and also with '_'.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    rows = files.select(F.col("path").alias("p"), F.lit(base).alias("b"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    rows = rows.select(F.expr("substring(p, locate(b, p) + length(b) + 1)").alias("relative_path"), "size_bytes", "mtime")
    directory = F.regexp_replace("relative_path", r"/?[^/]*$", "")
    rows = rows.withColumns({"directory": directory, "media_type": media_type_of(F.col("relative_path"))})
    folders = F.split("directory", "/")
    reason = (
        F.when(F.exists(folders, lambda f: F.lower(F.trim(f)).isin(*SYSTEM_FOLDERS)), "system_directory")
        .when(F.exists(folders, lambda f: extension(f).isin(*PACKAGE_ENDINGS)), "package_directory")
        .when(F.col("media_type").isNull(), "unsupported_extension")
    )
    return rows.withColumn("skip_reason", reason)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """The media files under root."""
    return listed(spark, root).where("skip_reason IS NULL").drop("skip_reason")
