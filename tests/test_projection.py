"""The projection kept up by changes against a rebuild after each batch."""

import random

from pyspark.sql import functions as F

from shoebox.operators import projection as P

SCHEMA = f"{P.ROW}, gone boolean"


def made(rng, n, ids, t=0):
    import datetime as dt

    out = []
    for i in rng.sample(range(ids), n):
        asset = rng.choice([None, *(f"c{k}" for k in range(ids // 3))])
        day = dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(5), seconds=rng.randrange(9))
        out.append((f"s{i % 3}", str(i), asset, rng.choice(["active", "active", "missing"]), i % 2, day, "image", rng.random() < 0.25))
    return out


def rebuilt(state):
    """(shown, days) by plain code."""
    assets, days = {}, {}
    for r in state.values():
        if r[2] is not None:
            assets.setdefault(r[2], []).append(r)
    shown = {}
    for a, rows in assets.items():
        active = sorted((r[4], r[0], r[1], r[5]) for r in rows if r[3] == "active")
        if active:
            shown[a] = (active[0][1], active[0][2], active[0][3], len(rows))
            day = active[0][3].strftime("%Y-%m-%d")
            days[day] = days.get(day, 0) + 1
    return shown, days, {a: len(r) for a, r in assets.items()}


def test_a_stream_of_batches_equals_a_rebuild_after_each(spark, tmp_path):
    rng, state = random.Random(4), {}
    p = P.Projection(spark, str(tmp_path / "p"), buckets=8)
    for n in (40, 12, 5, 1, 25):
        batch = made(rng, n, 60)
        p.apply(spark.createDataFrame(batch, SCHEMA))
        for r in batch:
            state.pop((r[0], r[1]), None)
            if not r[-1]:
                state[r[0], r[1]] = r
        p = P.Projection(spark, str(tmp_path / "p"), buckets=8)  # as another process finds it
        shown, days, counts = rebuilt(state)
        assert {r.canonical_asset_id: (r.source_key, r.upstream_asset_id, r.captured_at, r.source_count) for r in p.shown().collect()} == shown
        assert {r.day: r.n for r in p.days().collect()} == days and {r.canonical_asset_id: r.source_count for r in p.assets().collect()} == counts
    generation = p.tables.generation
    again = spark.createDataFrame([(*r[:-1], False) for r in state.values()], SCHEMA)
    assert p.apply(again) == generation and p.apply(again.where("false")) == generation
    assert p.apply(again.withColumn("gone", F.lit(True))) == generation + 1 and p.shown().isEmpty() and p.days().isEmpty() and p.assets().isEmpty()


def test_a_small_batch_reads_few_buckets(spark, tmp_path):
    rng = random.Random(5)
    p = P.Projection(spark, str(tmp_path / "p"), buckets=32)
    p.apply(spark.createDataFrame([(*r[:-1], False) for r in made(rng, 900, 1000)], SCHEMA))
    p.tables.read_buckets = 0
    before = dict(p.tables.folders)
    p.apply(spark.createDataFrame(made(rng, 2, 1000), SCHEMA))
    # two rows, each with an old and a new asset, in three tables
    assert p.tables.read_buckets <= 2 + 2 + 4 + 4 and sum(before.get(k) != f for k, f in p.tables.folders.items()) <= 10
