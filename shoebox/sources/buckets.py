"""Keyed tables of which a change rewrites only the buckets that it touches.

A table's rows lie in buckets by a hash of their key. A generation is a list that names the folder of each bucket of each
table, so all tables change at once, and what was not touched is neither read nor written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from shoebox.sources.snapshots import Snapshots


class BucketTables:
    """tables: the key columns and the schema of each. `read_buckets` counts the buckets that were opened."""

    def __init__(self, store: Snapshots, tables: dict[str, tuple[list[str], str]], buckets: int = 64):
        self.store, self.spark, self.tables, self.buckets = store, store.spark, tables, buckets
        self.generation, self.read_buckets = store.current(), 0
        listed = store.read("buckets", self.generation).collect() if self.generation else []  # tables * buckets rows
        self.folders = {(r.name, r.bucket): r.folder for r in listed}

    def bucket(self, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, keys: list[str]) -> list[int]:
        """The buckets of the rows' keys; `buckets` numbers at most."""
        return sorted(r.bucket for r in rows.select(self.bucket(keys).alias("bucket")).distinct().collect())

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of some buckets, or of all."""
        own = [f for (n, b), f in self.folders.items() if n == name and (buckets is None or b in buckets)]
        self.read_buckets += len(own)
        schema = self.tables[name][1]
        return self.spark.read.schema(schema).parquet(*own) if own else self.spark.createDataFrame([], schema)

    def staged(self, name: str, rows: DataFrame, buckets: list[int]) -> dict[tuple[str, int], str | None]:
        """Writes all rows that the buckets have from now on; their folders, for publish()."""
        keys = self.tables[name][0]
        folder = f"{self.store.root}/data/{name}-{uuid.uuid4().hex}"
        placed = rows.withColumn("bucket", self.bucket(keys))
        placed.repartitionByRange("bucket", *keys).write.partitionBy("bucket").parquet(folder)
        found = {r.bucket for r in self.spark.read.schema(f"{self.tables[name][1]}, bucket int").parquet(folder).select("bucket").distinct().collect()}
        return {(name, b): f"{folder}/bucket={b}" if b in found else None for b in buckets}

    def publish(self, changes: dict[tuple[str, int], str | None], more: dict[str, DataFrame] | None = None) -> int:
        """All staged buckets, and further whole tables, as the next generation; fails if another came meanwhile."""
        folders = {k: f for k, f in (self.folders | changes).items() if f}
        listed = self.spark.createDataFrame([(n, b, f) for (n, b), f in folders.items()], "name string, bucket int, folder string")
        self.generation = self.store.publish({"buckets": listed} | (more or {}), expected=self.generation)
        self.folders = folders
        return self.generation
