"""Vectors as array<float> columns; sums are in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


#: Longer sums would outgrow a generated method.
UNROLLED = 256


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length; null if either is null."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_with(a: Column, query: list[float]) -> Column:
    """With one fixed vector, over the shorter length; up to UNROLLED numbers as plain arithmetic that code is generated
    for."""
    if len(query) > UNROLLED:
        return dot(a, F.lit([float(q) for q in query]))
    total = F.lit(0.0)
    for i, q in enumerate(query):
        total = total + F.coalesce(F.get(a, F.lit(i)).cast("double"), F.lit(0.0)) * F.lit(float(q))
    return F.when(a.isNotNull(), total)


def normalised(v: Column) -> Column:
    """To length 1; a zero vector stays."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(size == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / size))


def graph_level(asset_id: Column, most: int = 5) -> Column:
    """How many bytes from the start of the id's SHA-256 have their two lowest bits unset, at most `most`."""
    digest = F.sha2(asset_id, 256)
    digits = F.regexp_extract(digest, rf"^(([0-9a-f][048c]){{0,{most}}})", 1)
    return F.floor(F.length(digits) / 2).cast("int")
