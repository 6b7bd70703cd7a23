"""Reports as files."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


def ordered_csv(rows: DataFrame, order: list[Column], path: str) -> None:
    """A report as CSV files with headers, whose names follow the order of the rows; as many files as that takes."""
    rows.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def admin_snapshot(rows: DataFrame, key: str, now: Column) -> DataFrame:
    """(key, payload_json, updated_at): each row as a JSON object under a key."""
    return rows.select(F.lit(key).alias("key"), F.to_json(F.struct(*sorted(rows.columns))).alias("payload_json"), now.alias("updated_at"))


def latest_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshots by key; new ones replace old ones."""
    return old.join(new, "key", "left_anti").unionByName(new)


@F.pandas_udf(T.StringType())
def payload_checksum(vectors: pd.Series) -> pd.Series:
    """The digest of each vector's stored bytes, 32-bit numbers with the low byte first; null for null."""
    return vectors.map(lambda v: None if v is None else hashlib.sha256(np.asarray(v, "<f4").tobytes()).hexdigest())


def vector_checksums(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, checksum): a vector's digest over its bytes, so that any changed bit shows. No built-in function gives the
    bytes of a float."""
    return vectors.select(id_col, F.size(vector_col).alias("dim"), payload_checksum(F.col(vector_col).cast("array<float>")).alias("checksum"))
