"""Candidates by metadata: all of them, ranked without a window over all rows."""

from pyspark.sql import functions as F

from shoebox.operators import search


def table(spark, n):
    """Vectors whose scores rise with the id, ten of each score."""
    ids = spark.range(n, numPartitions=8)
    vectors = ids.select("id", F.lit("s").alias("source_key"), F.lit("2024-01-01").cast("timestamp_ntz").alias("captured_at"), F.array(F.floor(F.col("id") / 10).cast("float")).alias("vector"))
    rows = ids.select("id", F.lit("active").alias("visibility_status"), F.lit("beach").alias("filename"), F.lit("").alias("place_label"), F.lit("").alias("description"), F.lit(False).alias("is_favorite"))
    return vectors, rows


def test_all_matches_are_candidates(spark):
    vectors, rows = table(spark, 5000)
    found = search.metadata_candidates(vectors, rows, "beach", [1.0])
    want = sorted(range(5000), key=lambda i: (-(i // 10), i))
    assert [(r.id, r.rank) for r in found.select("id", "rank").orderBy("rank").collect()] == [(i, n) for n, i in enumerate(want)]
    top = search.metadata_candidates(vectors, rows, "beach", [1.0], 25)
    assert [r.id for r in top.orderBy("rank").collect()] == want[:25]
    assert search.metadata_candidates(vectors, rows, "mountain", [1.0]).count() == 0


def test_equal_scores_are_spread(spark):
    vectors, rows = table(spark, 5000)
    same = search.with_rank_of_all(vectors.withColumn("score", F.lit(1.0)))
    assert [(r.id, r.rank) for r in same.orderBy("id").select("id", "rank").collect()] == [(i, i) for i in range(5000)]
