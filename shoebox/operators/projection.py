"""The gallery kept up by changes: what it shows, how many sources each asset has and how many assets each day has.

A batch becomes signed changes, a row that is out and a row that is in, which are folded into the state of their assets.
Counts are sums of signs. The displayed copy of an asset is the least of its active ones; one that comes in is compared with
it, and only where the displayed copy itself goes out are that asset's rows read. Days take the assets whose displayed copy
changed. Nothing but the buckets of touched rows and assets is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shoebox.operators import canonical as C
from shoebox.operators.merge import differs
from shoebox.sources.buckets import BucketTables
from shoebox.sources.snapshots import Snapshots

KEY = C.KEY
ROW = "source_key string, upstream_asset_id string, canonical_asset_id string, visibility_status string, datasource_rank int, captured_at timestamp_ntz, media_type string"
COLUMNS = [c.split(" ")[0] for c in ROW.split(", ")]
BEST = "struct<datasource_rank:int,source_key:string,upstream_asset_id:string,captured_at:timestamp_ntz,media_type:string>"
ASSET = f"canonical_asset_id string, source_count bigint, best {BEST}"
ASSET_KEY = ["canonical_asset_id"]


def _best() -> Column:
    """What an active row is compared by, and what is shown of it."""
    return F.when(F.col("visibility_status") == "active", F.struct("datasource_rank", *KEY, "captured_at", "media_type").cast(BEST))


def day_of(best: str) -> Column:
    return F.date_format(F.col(f"{best}.captured_at"), "yyyy-MM-dd")


class Projection:
    """A stored projection; apply() brings it from one generation to the next.

    Tables: rows by key and, the same, by asset; assets (canonical_asset_id, source_count, best); days (day, n).
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.store = spark, Snapshots(spark, root)
        self.tables = BucketTables(self.store, {"rows": (KEY, ROW), "by_asset": (ASSET_KEY, ROW), "assets": (ASSET_KEY, ASSET)}, buckets)

    def days(self) -> DataFrame:
        return self.store.read("days", self.tables.generation) if self.tables.generation else self.spark.createDataFrame([], "day string, n bigint")

    def assets(self) -> DataFrame:
        return self.tables.read("assets")

    def shown(self) -> DataFrame:
        """(canonical_asset_id, source_key, upstream_asset_id, captured_at, media_type, source_count) of assets with an active copy."""
        return self.assets().where("best IS NOT NULL").select("canonical_asset_id", "best.source_key", "best.upstream_asset_id", "best.captured_at", "best.media_type", "source_count")

    def changes(self, batch: DataFrame) -> DataFrame:
        """Signed changes (ROW, sign) of a batch (ROW, gone): rows that differ from what is there; a key may be in it once."""
        buckets = self.tables.touched(batch, KEY)
        o, n = self.tables.read("rows", buckets), batch.select(*COLUMNS, "gone")
        both = n.select(*KEY, F.struct(*n.columns).alias("n")).join(o.select(*KEY, F.struct(*o.columns).alias("o")), KEY, "left")
        comes, was = ~F.col("n.gone"), F.col("o").isNotNull()
        both = both.where(F.when(comes & was, differs(COLUMNS)).otherwise(comes | was))
        row = lambda of, sign: F.struct(*(F.col(f"{of}.{c}").alias(c) for c in COLUMNS), F.lit(sign).alias("sign"))
        signed = F.filter(F.array(F.when(was, row("o", -1)), F.when(comes, row("n", 1))), lambda x: x.isNotNull())
        return both.select(F.explode(signed).alias("c")).select("c.*")

    def _patched(self, name: str, changes: DataFrame, keys: list[str], buckets: list[int]) -> dict:
        """The buckets of a table of rows without those that are out and with those that are in."""
        out = changes.where("sign < 0").select(*KEY, *(k for k in keys if k not in KEY))
        kept = self.tables.read(name, buckets).join(out, out.columns, "left_anti")
        return self.tables.staged(name, kept.unionByName(changes.where("sign > 0").select(*COLUMNS)), buckets)

    def apply(self, batch: DataFrame) -> int:
        """The generation after the batch; the current one if nothing changed."""
        folder = self.store.staged({"changes": self.changes(batch)})
        changes = self.store.in_folder(folder, "changes")
        if changes.isEmpty():
            return self.tables.generation
        keys, assets = self.tables.touched(changes, KEY), self.tables.touched(changes.where("canonical_asset_id IS NOT NULL"), ASSET_KEY)
        staged = self._patched("rows", changes, KEY, keys)
        linked = changes.where("canonical_asset_id IS NOT NULL")
        by_asset = self._patched("by_asset", linked, ASSET_KEY, assets)
        folded = linked.groupBy("canonical_asset_id").agg(F.sum("sign").alias("more"), F.min(F.when(F.col("sign") > 0, _best())).alias("comes"), F.collect_set(F.when(F.col("sign") < 0, F.struct(*KEY))).alias("went"))
        old = self.tables.read("assets", assets).withColumnsRenamed({"source_count": "had", "best": "was"})
        both = old.join(folded, "canonical_asset_id", "full_outer")
        lost = F.col("was").isNotNull() & F.coalesce(F.array_contains("went", F.struct(*(F.col(f"was.{k}").alias(k) for k in KEY))), F.lit(False))
        both = both.withColumn("lost", lost)
        # only of assets that lost what they showed are all rows looked at
        look = both.where("lost").select("canonical_asset_id")
        now = [f for f in by_asset.values() if f]
        rows = self.spark.read.schema(ROW).parquet(*now) if now else self.spark.createDataFrame([], ROW)
        again = rows.join(look, "canonical_asset_id", "left_semi").groupBy("canonical_asset_id").agg(F.min(_best()).alias("found"))
        both = both.join(again, "canonical_asset_id", "left")
        best = F.when(F.col("lost"), F.col("found")).otherwise(F.least("was", "comes"))
        both = both.select("canonical_asset_id", (F.coalesce("had", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("source_count"), best.alias("best"), "was")
        state = self.store.in_folder(self.store.staged({"assets": both}), "assets")
        staged |= by_asset | self.tables.staged("assets", state.where("source_count > 0").select("canonical_asset_id", "source_count", "best"), assets)
        moved = state.where(~day_of("was").eqNullSafe(day_of("best")))
        deltas = moved.select(F.explode(F.array(F.struct(day_of("was").alias("day"), F.lit(-1).alias("n")), F.struct(day_of("best").alias("day"), F.lit(1).alias("n")))).alias("d")).select("d.*").where("day IS NOT NULL")
        days = self.days().unionByName(deltas.groupBy("day").agg(F.sum("n").alias("n"))).groupBy("day").agg(F.sum("n").alias("n")).where("n > 0")
        return self.tables.publish(staged, {"days": days})
