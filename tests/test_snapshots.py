"""Commits that rebase, pins and retention."""

import os

import pytest
from pyspark.sql import functions as F

from shoebox.sources.snapshots import Conflict, LostRace, Snapshots


@pytest.fixture()
def store(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    store.publish({"rows": spark.createDataFrame([(i, "old") for i in range(6)], "key int, v string")})
    return store


def change(spark, store, keys, value, meanwhile=None):
    """A change of some keys; `meanwhile` runs once, after the change was worked out."""
    runs = []

    def make(generation):
        rows = store.read("rows", generation)
        new = rows.withColumn("v", F.when(F.col("key").isin(keys), value).otherwise(F.col("v")))
        if meanwhile and not runs:
            meanwhile()
        runs.append(generation)
        return {"rows": new}, spark.createDataFrame([(k,) for k in keys], "key int")

    return make, runs


def state(store):
    return {r.key: r.v for r in store.read("rows").collect()}


def test_disjoint_writers_both_land_and_others_conflict(spark, store):
    first, _ = change(spark, store, [1, 2], "a")
    second, runs = change(spark, store, [3], "b", lambda: store.commit(first))
    assert store.commit(second) == 3 and runs == [1, 2]
    assert state(store) == {0: "old", 1: "a", 2: "a", 3: "b", 4: "old", 5: "old"}
    third, _ = change(spark, store, [1, 4], "c", lambda: store.commit(change(spark, store, [4, 5], "d")[0]))
    with pytest.raises(Conflict):
        store.commit(third)
    assert state(store) == {0: "old", 1: "a", 2: "a", 3: "b", 4: "d", 5: "d"} and store.current() == 4
    with pytest.raises(LostRace):
        store.publish({"rows": store.read("rows")}, expected=2)


def test_pruned_generations_go_and_pinned_ones_stay(spark, store, tmp_path):
    for value in "abcd":
        store.commit(change(spark, store, [0], value)[0])
    folders = {g: store.folder(g) for g in store.generations()}
    with store.pinned(2) as held:
        old = store.read("rows", held)
        assert store.prune(keep=2) == [1, 3] and store.generations() == [2, 4, 5]
        assert {r.v for r in old.where("key = 0").collect()} == {"a"}
        assert not os.path.exists(folders[1]) and not os.path.exists(folders[3]) and os.path.exists(folders[2])
    assert store.prune(keep=1) == [2, 4] and store.generations() == [5] and state(store)[0] == "d" and store.prune(keep=0) == []
    with pytest.raises(RuntimeError, match="gone"), store.pinned(2):
        pass
    staged = store.staged({"rows": store.read("rows")})
    store.prune()
    assert os.path.exists(tmp_path / "s" / staged)
    store.prune(unpublished_seconds=-5)
    assert not os.path.exists(tmp_path / "s" / staged) and state(store)[0] == "d"
