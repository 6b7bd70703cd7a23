"""Positions after changes against sorting all rows."""

import datetime as dt
import random

from shoebox.operators import order_index
from shoebox.operators.order_index import OrderIndex
from shoebox.sources.snapshots import Snapshots

SCHEMA = "canonical_asset_id bigint, captured_at timestamp_ntz, name string"
DAY = dt.datetime(2024, 1, 1)


def row(i, rng):
    return (i, DAY + dt.timedelta(seconds=rng.randrange(60)), f"n{i}")


def ordered(state):
    return [r[0] for r in sorted(state.values(), key=lambda r: (-(r[1] - DAY).total_seconds(), r[0]))]


def test_positions_after_each_batch(spark, tmp_path):
    rng = random.Random(2)
    store = Snapshots(spark, str(tmp_path / "t"))
    state = {i: row(i, rng) for i in range(200)}
    index = OrderIndex(store, range_rows=20)
    index.build(spark.createDataFrame(list(state.values()), SCHEMA).repartition(3))
    assert len(index.ranges) == 10
    for step, (come, go) in enumerate([(3, 2), (60, 0), (1, 150), (40, 40)]):
        new = [row(1000 * (step + 1) + k, rng) for k in range(come)]
        gone = rng.sample(sorted(state), go)
        before = {r.folder for r in index.ranges}
        index.written = 0
        index.apply(spark.createDataFrame(new, SCHEMA), spark.createDataFrame([state[g] for g in gone], SCHEMA) if gone else None)
        for g in gone:
            del state[g]
        state |= {r[0]: r for r in new}
        want = ordered(state)
        for start, size in ((0, 30), (len(want) // 2, 25), (len(want) - 5, 50), (len(want), 5)):
            found = sorted((r.global_position, r.canonical_asset_id) for r in index.seek(start, size).collect())
            assert found == list(enumerate(want))[start : start + size]
        some = state[rng.choice(want)]
        assert index.rank(some[1], some[0]) == want.index(some[0]) and index.rank(some[1] - dt.timedelta(days=9), 0) == len(want)
        assert sum(r.n for r in index.ranges) == len(want) and max(r.n for r in index.ranges) <= 40
        kept = before & {r.folder for r in index.ranges}
        if step == 0:
            # five rows fall into five ranges at most, each goes with another at most
            assert index.written <= 5 and len(kept) >= 4
    other = OrderIndex(store, range_rows=20)  # as another process finds it
    assert [r.canonical_asset_id for r in other.seek(0, 1000).orderBy("global_position").collect()] == ordered(state)
    row_ = next(iter(state.values()))
    other.apply(spark.createDataFrame([(row_[0], row_[1], "renamed")], SCHEMA))
    assert other.seek(0, 1000).where("name = 'renamed'").count() == 1 and other.starts[-1] == len(state)
    other.apply(removed=spark.createDataFrame(list(state.values()), SCHEMA))
    assert other.seek(0, 10).collect() == [] and other.starts[-1] == 0
    other.apply(spark.createDataFrame([row(1, rng)], SCHEMA))
    assert [r.global_position for r in other.seek(0, 10).collect()] == [0]


def test_a_large_table_has_a_bounded_number_of_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(order_index, "MOST_RANGES", 4, raising=False)
    rng = random.Random(3)
    state = {i: row(i, rng) for i in range(200)}
    index = OrderIndex(Snapshots(spark, str(tmp_path / "t")), range_rows=2)
    index.build(spark.createDataFrame(list(state.values()), SCHEMA))
    assert len(index.ranges) <= 4
    new = [row(1000 + i, rng) for i in range(300)]
    index.apply(spark.createDataFrame(new, SCHEMA), spark.createDataFrame([state.pop(3)], SCHEMA))
    state |= {r[0]: r for r in new}
    assert len(index.ranges) <= 8 and index.starts[-1] == len(state)
    assert [r.canonical_asset_id for r in index.seek(0, 999).orderBy("global_position").collect()] == ordered(state)
