"""Search by name, by metadata and by vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from shoebox.functions import vectors as V
from shoebox.functions.scalars import FAVORITE_WORDS
from shoebox.operators import timeline
from shoebox.operators.ordinals import numbered
from shoebox.request import Resolved

#: Candidates of one ranking, how many of them are diversified, and from which likeness on two are near copies.
CANDIDATES, DIVERSIFIED, NEAR_COPY = 4096, 80, 0.86


def has_text(c: Column, text: str) -> Column:
    """Whether the column has the text, whatever the case; there are no wildcards to escape."""
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.strip().lower()))


def by_filename(assets: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """Assets of which any active source row's filename has the text."""
    hit = rows.where((F.col("visibility_status") == "active") & has_text(F.col("filename"), text))
    return assets.join(hit, "canonical_asset_id", "left_semi")


def metadata_match(text: str) -> Column:
    """In the filename, place or description."""
    return has_text(F.col("filename"), text) | has_text(F.col("place_label"), text) | has_text(F.col("description"), text)


def by_metadata(rows: DataFrame, text: str) -> DataFrame:
    """Active rows that match; or that are favourites, if the text is a word for that. These come apart, so that both
    filters on texts stand below a join that tells favourites and no text is shuffled."""
    active, found = rows.where(F.col("visibility_status") == "active"), metadata_match(text)
    if text.strip().lower() not in FAVORITE_WORDS:
        return active.where(found)
    return active.where(found).unionByName(active.where(~found & F.col("is_favorite")))


def ranked(vectors: DataFrame, query: list[float], limit: int = CANDIDATES, id_col: str = "id") -> DataFrame:
    """The limit vectors most like the query, exactly: (id, captured_at, source_key, vector, score), a top-k over one scan."""
    scored = vectors.withColumn("score", V.dot_with(F.col("vector"), query)).where("score IS NOT NULL")
    return scored.orderBy(F.col("score").desc(), F.col("captured_at").desc(), "source_key", id_col).limit(limit)


def with_rank(scored: DataFrame, id_col: str = "id") -> DataFrame:
    """rank from 0, by score, time, source and id; for rankings, which are bounded."""
    w = Window.orderBy(F.col("score").desc(), F.col("captured_at").desc(), "source_key", id_col)
    return scored.withColumn("rank", F.row_number().over(w) - 1)


def with_rank_of_all(scored: DataFrame, id_col: str = "id") -> DataFrame:
    """The ranks of with_rank() for any number of rows, without a window over them."""
    return numbered(scored, [F.col("score").desc(), F.col("captured_at").desc(), F.col("source_key"), F.col(id_col)], "rank")


def metadata_candidates(vectors: DataFrame, rows: DataFrame, text: str, query: list[float], limit: int | None = None) -> DataFrame:
    """Indexed rows that match the text, or are favourites where the text asks for these, scored and ranked: all of them,
    or the limit ones most like the query."""
    active = rows.where(F.col("visibility_status") == "active")
    named = active.where(has_text(F.col("filename"), text) | has_text(F.col("place_label"), text) | has_text(F.col("description"), text)).select("id")
    starred = active.where(F.col("is_favorite") & F.lit(text.strip().lower() in FAVORITE_WORDS)).select("id")
    hits = vectors.join(named.union(starred).distinct(), "id", "left_semi")
    return with_rank_of_all(hits.withColumn("score", V.dot_with(F.col("vector"), query))) if limit is None else with_rank(ranked(hits, query, limit))


def promoted(ranking: DataFrame, matching: DataFrame) -> DataFrame:
    """The ranking with the ids of `matching` first, the order otherwise kept."""
    flagged = ranking.join(matching.select("id").distinct().withColumn("match", F.lit(0)), "id", "left")
    w = Window.orderBy(F.coalesce("match", F.lit(1)), "rank")
    return flagged.withColumn("rank", F.row_number().over(w) - 1).drop("match")


def diversified(ranking: DataFrame, first: int = DIVERSIFIED, near: float = NEAR_COPY) -> DataFrame:
    """(id, rank) with near copies deferred: each of the first rows goes behind the kept ones if its vector is as near
    to one kept before it; the rest follows. Only the first rows meet in one task."""
    head = ranking.where(F.col("rank") < first).select(F.lit(0).alias("one"), "id", F.col("rank").cast("int").alias("rank"), "vector")

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        kept, late, own = [], [], []
        for i, v in zip(pdf["id"], pdf["vector"], strict=True):
            v = np.asarray(v, np.float64)
            if any(float(v[: len(k)] @ k[: len(v)]) >= near for k in own):
                late.append(i)
            else:
                kept.append(i)
                own.append(v)
        return pd.DataFrame({"id": kept + late, "rank": range(len(pdf))})

    dealt = head.groupBy("one").applyInPandas(deal, head.select("id", "rank").schema)
    return dealt.unionByName(ranking.where(F.col("rank") >= first).select("id", F.col("rank").cast("int").alias("rank")))


def resolved(ranking: DataFrame, assets: DataFrame, r: Resolved) -> DataFrame:
    """A page of a ranking (id, rank, score): one row for each canonical asset, at its best rank; filters come after the
    ranking was cut, so a rare filter may leave few rows."""
    best = ranking.join(assets, "id").withColumn("n", F.row_number().over(Window.partitionBy("canonical_asset_id").orderBy("rank"))).where("n = 1").drop("n")
    return best.where(timeline.matches(r)).orderBy("rank").offset(r.offset).limit(r.page_size)
