"""Stored vectors: round trips bit for bit, equal contents once, damage found."""

import struct

import numpy as np
from pyspark.sql import functions as F

from shoebox.sources import payloads as P

SCHEMA = "id bigint, vector array<float>"


def rows_of():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype("f4").tolist()) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(20)] + [(200, []), (201, None), (202, [float("nan"), -0.0, float("inf")]), (203, rng.normal(size=500).astype("f4").tolist())]
    return rows


def test_round_trip_and_equal_contents_once(spark):
    rows = rows_of()
    table = spark.createDataFrame(rows, SCHEMA)
    index, batches = (df.cache() for df in P.packed(table.repartition(3), batch_bytes=200))
    found = {r.id: r for r in P.fetched(index, batches).collect()}
    bits = lambda v: struct.pack(f"<{len(v)}f", *v)
    assert {i: bits(r.vector) for i, r in found.items()} == {i: bits(v) for i, v in rows if v is not None} and all(r.intact for r in found.values())
    stored = batches.collect()
    assert sum(len(r.payload) for r in stored) == 60 * 32 + 0 + 12 + 2000 and len(stored) > 8
    places = {r.id: (r.batch, r.offset) for r in index.collect()}
    assert all(places[i] == places[100 + i] for i in range(20))
    again = P.packed(table.orderBy(F.col("id").desc()).repartition(7), batch_bytes=200)[1]
    assert sorted(r.batch for r in again.collect()) == sorted(r.batch for r in stored)


def test_damage_is_found_and_pinned_batches_stay(spark):
    index, batches = (df.cache() for df in P.packed(spark.createDataFrame(rows_of(), SCHEMA), batch_bytes=300))
    row = index.where("id = 7").first()
    flip = F.udf(lambda b: bytes([*b[: row.offset], b[row.offset] ^ 1, *b[row.offset + 1 :]]), "binary")
    bad = batches.withColumn("payload", F.when(F.col("batch") == row.batch, flip("payload")).otherwise(F.col("payload")))
    assert sorted((r.id, r.vector) for r in P.fetched(index, bad).where("NOT intact").collect()) == [(7, None), (107, None)]  # one content
    lost = P.fetched(index, batches.where(F.col("batch") != row.batch)).where("NOT intact")
    assert sorted(r.id for r in lost.collect()) == sorted(r.id for r in index.where(F.col("batch") == row.batch).where("length > 0").collect())
    now, pinned = index.where("id < 5"), index.where("id = 203")
    kept = {r.batch for r in P.swept(batches, [now, pinned]).collect()}
    assert kept == {r.batch for r in now.union(pinned).collect()} and len(kept) < batches.count()


def test_no_rows(spark):
    index, batches = P.packed(spark.createDataFrame([(1, None)], SCHEMA))
    assert index.collect() == [] and batches.collect() == [] and P.fetched(index, batches).collect() == []
