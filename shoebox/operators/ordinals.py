"""Dense positions over all rows of a table, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shoebox.session import shared_dir


def numbered(rows: DataFrame, order: list[Column], position: str) -> DataFrame:
    """rows with their position (bigint) from 0 in the order, which must tell all rows apart.

    Rows are sorted in ranges of the whole order, so that any ties in its first columns are spread, and numbered within;
    the starts of ranges are summed up. The sorted rows are a table in the shared folder, as a range must not be cut
    anew when it is read again.
    """
    # the number of a range in the upper bits, that of a row in its range in the lower 33
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    path = shared_dir(rows.sparkSession, "numbered")
    at.write.parquet(path)
    found = rows.sparkSession.read.schema(at.schema).parquet(path).withColumn("__range", F.shiftright("__at", 33))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range, that is a task
    starts = found.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return found.join(F.broadcast(starts), "__range").withColumn(position, place).drop("__at", "__range", "__start")
