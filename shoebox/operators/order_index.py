"""Positions of a timeline that survive changes: rows in ranges of the order, and a prefix sum over the ranges.

A row's position is that of its range's first row plus its place within the range, so a change moves no row but those of the
ranges it falls into. These are written anew; one that grew too large is split, one that became small goes with the next. What is
known of each range (where it begins, how many rows it has, where they are) is the index: a row for every RANGE_ROWS rows.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from shoebox.sources.snapshots import Snapshots

RANGE_ROWS = 100_000
#: Ranges of a table, about: beyond, ranges have more than the rows asked for, so that the index stays small.
MOST_RANGES = 256


@dataclass
class Range:
    """Rows from (late, id) on, up to where the next begins."""

    late: int
    id: object
    n: int
    folder: str


def late() -> Column:
    """The newest first."""
    return -F.unix_micros(F.col("captured_at").cast("timestamp"))


class OrderIndex:
    """rows: any columns with id_col and captured_at, in the order of the newest first, then by id; ids differ.

    build() and apply() publish the store's next generation, and fail if another was published meanwhile.
    """

    def __init__(self, store: Snapshots, id_col: str = "canonical_asset_id", range_rows: int = RANGE_ROWS):
        self.store, self.spark, self.id_col, self.range_rows = store, store.spark, id_col, range_rows
        self.generation = store.current()
        found = store.read("ranges", self.generation).collect() if self.generation else []  # a row a range
        self.ranges = sorted((Range(r.late, r.id, r.n, r.folder) for r in found), key=lambda r: (r.late, r.id))
        self.written = 0

    @property
    def starts(self) -> list[int]:
        """The position of each range's first row, and at the end how many rows there are."""
        return [0, *accumulate(r.n for r in self.ranges)]

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({"__late": late(), "__id": F.col(self.id_col)})

    def _write(self, rows: DataFrame) -> list[Range]:
        """rows (keyed) as ranges, one for each value of __part."""
        folder = f"{self.store.root}/ranges/{uuid.uuid4().hex}"
        rows.sortWithinPartitions("__part", "__late", "__id").write.partitionBy("__part").parquet(folder)
        written = self.spark.read.schema(rows.schema).parquet(folder)
        own = written.groupBy("__part").agg(F.min(F.struct("__late", "__id")).alias("first"), F.count("*").alias("n")).collect()  # a row a range
        self.written += len(own)
        return [Range(r["first"]["__late"], r["first"]["__id"], r.n, f"{folder}/__part={r['__part']}") for r in own]

    def _publish(self, ranges: list[Range], schema) -> int:
        kind = schema[self.id_col].dataType.simpleString()
        listed = self.spark.createDataFrame([(r.late, r.id, r.n, r.folder) for r in ranges], f"late bigint, id {kind}, n bigint, folder string")
        sample = self.spark.createDataFrame([], schema)
        self.generation = self.store.publish({"ranges": listed, "columns": sample}, expected=self.generation)
        self.ranges = sorted(ranges, key=lambda r: (r.late, r.id))
        return self.generation

    def _size(self, n: int) -> int:
        """Rows of a range of a table of n."""
        return max(self.range_rows, -(-n // MOST_RANGES))

    def build(self, rows: DataFrame) -> int:
        n = rows.count()
        parts = max(1, -(-n // self._size(n)))
        keyed = self._keyed(rows).repartitionByRange(parts, "__late", "__id")
        return self._publish(self._write(keyed.withColumn("__part", F.spark_partition_id().cast("bigint"))), rows.schema)

    def _range_of(self, rows: DataFrame) -> DataFrame:
        """keyed rows with __range, the number of the range they belong to, by binary search in the ranges' first keys."""
        if not self.ranges:
            return rows.withColumn("__range", F.lit(0))
        # constants: as a column the bounds would be copied into each row
        lates, ids = F.lit([r.late for r in self.ranges]).cast("array<bigint>"), F.lit([r.id for r in self.ranges])
        steps = [1 << k for k in reversed(range(len(self.ranges).bit_length()))]

        def step(at: Column, width: Column) -> Column:
            x, y = F.get(lates, at + width - 1), F.get(ids, at + width - 1)
            return F.when((F.col("__late") > x) | (F.col("__late") == x) & (F.col("__id") >= y), at + width).otherwise(at)

        place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)
        return rows.withColumn("__range", F.greatest(F.lit(0), place - 1))

    def _rows(self, ranges: list[Range]) -> DataFrame:
        schema = self.store.read("columns", self.generation).schema
        return self.spark.read.schema(schema).parquet(*(r.folder for r in ranges)) if ranges else self.spark.createDataFrame([], schema)

    def apply(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> int:
        """Rows come in and rows (id_col, captured_at) go; a row that is there already is replaced."""
        schema = self.store.read("columns", self.generation).schema
        added = self.spark.createDataFrame([], schema) if added is None else added.select(schema.names)
        if not self.ranges:
            return self.build(added)
        key = [self.id_col, "captured_at"]
        gone = added.select(*key) if removed is None else added.select(*key).unionByName(removed.select(*key))
        touched = sorted(r["__range"] for r in self._range_of(self._keyed(gone)).select("__range").distinct().collect())
        if not touched:
            return self.generation
        keyed = lambda numbers: self._range_of(self._keyed(self._rows([self.ranges[k] for k in numbers]).join(gone.distinct(), key, "left_anti")))
        new = self._range_of(self._keyed(added))
        sizes = {r["__range"]: r.n for r in keyed(touched).unionByName(new).groupBy("__range").agg(F.count("*").alias("n")).collect()}
        total = sum(sizes.values()) + sum(r.n for k, r in enumerate(self.ranges) if k not in set(touched))
        group, pieces, more = self._groups(touched, sizes, self._size(total))
        rows = keyed([*touched, *more]).unionByName(new)
        of, cut = (F.lit([found.get(k, 0) for k in range(len(self.ranges))]) for found in (group, pieces))  # by number
        rows = rows.withColumn("__group", F.get(of, F.col("__range")))
        # a group has two ranges' rows and what comes into them
        place = F.row_number().over(Window.partitionBy("__group").orderBy("__late", "__id")) - 1
        part = F.col("__group").cast("bigint") * (1 << 32) + F.floor(place / F.get(cut, F.col("__group")))
        own = self._write(rows.withColumn("__part", part).drop("__range", "__group"))
        kept = [r for k, r in enumerate(self.ranges) if k not in group]
        return self._publish(kept + own, schema)

    def _groups(self, touched: list[int], sizes: dict[int, int], size: int) -> tuple[dict[int, int], dict[int, int], list[int]]:
        """Which ranges become which group, into how many rows a piece each group is cut, and which untouched ranges join."""
        group, total, more = {}, {}, []
        for k in touched:
            if k in group:
                continue
            group[k], total[k] = k, sizes.get(k, 0)
            other = k + 1 if k + 1 < len(self.ranges) else k - 1
            if total[k] < size // 4 and other >= 0 and other not in group:
                group[other] = k
                total[k] += sizes.get(other, 0) if other in touched else self.ranges[other].n
                more += [] if other in touched else [other]
        pieces = {k: -(-max(1, n) // max(1, -(-n // size) if n > 2 * size else 1)) for k, n in total.items()}
        return group, pieces, more

    def seek(self, start: int, size: int) -> DataFrame:
        """(rows, global_position) from position `start` on, of the ranges that have them only."""
        starts = self.starts
        wanted = [k for k, r in enumerate(self.ranges) if starts[k] < start + size and starts[k] + r.n > start]
        if not wanted:
            return self._rows([]).withColumn("global_position", F.lit(0).cast("bigint"))
        rows = self._range_of(self._keyed(self._rows([self.ranges[k] for k in wanted])))
        first = F.create_map(*(F.lit(x) for k in wanted for x in (k, starts[k])))[F.col("__range")]
        place = F.row_number().over(Window.partitionBy("__range").orderBy("__late", "__id")) - 1
        found = rows.withColumn("global_position", (first + place).cast("bigint")).drop("__late", "__id", "__range")
        return found.where((F.col("global_position") >= start) & (F.col("global_position") < start + size))

    def rank(self, captured_at, id_: object) -> int:
        """How many rows stand before (captured_at, id)."""
        at = self.spark.range(1).select(F.lit(captured_at).cast("timestamp_ntz").alias("captured_at")).select(late().alias("late")).first().late
        k = max(0, bisect_right([(r.late, r.id) for r in self.ranges], (at, id_)) - 1)
        before = self._keyed(self._rows(self.ranges[k : k + 1])).where((F.col("__late") < at) | (F.col("__late") == at) & (F.col("__id") < F.lit(id_)))
        return self.starts[k] + before.count()
