"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shoebox.llm.common import Scratch


def _starred(links: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v), u > v: all links of a node are drawn to the smallest node beside it; they may repeat.

    The minimum is aggregated before the shuffle and joined back, so that a node with very many links is split
    like any skewed join instead of meeting in one task.
    """
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    drawn = both.join(least, F.col("u") == F.col("k")).select("u", "v", "m")
    if large:
        drawn = drawn.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        drawn = drawn.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return drawn.where("u <> v")


def _are_stars(links: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u: then v is the smallest node that u reaches, as u > v in each link."""
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("out")).unionByName(links.select(F.col("v").alias("n"), F.lit(0).alias("out")))
    return ends.groupBy("n").agg(F.sum("out").alias("outs"), F.count("*").alias("all")).where("outs > 1 OR outs > 0 AND outs < all").isEmpty()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of the links (u, v): the smallest node that it reaches. Links may repeat.

    Each round is written to the scratch folder; there are O(log n) of them. A node's least neighbour is found by partial
    minima, one row a node and task, so a node with very many links reads few rows; its links are then a join with that
    one row, which may be split.
    """
    links = scratch.written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    while not _are_stars(links):
        links = scratch.written(_starred(_starred(links, large=True), large=False).distinct(), "links")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
