"""The vector index against all dot products."""

import math

import numpy as np
import pytest

from shoebox.operators import vector_index as X
from shoebox.plans import QUERIES
from shoebox.sources.snapshots import Snapshots
from tests.conftest import SMALL


def brute(rows, queries, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: float(a[: min(len(a), len(b))] @ b[: min(len(a), len(b))])
    return {q: [(i, round(s, 6)) for s, i in sorted(((round(dot(v, w), 9), i) for i, w in good), key=lambda x: (-x[0], x[1]))[:k]] for q, v in good if q in queries}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r["rank"] == len(out.setdefault(r.query_id, []))
        out[r.query_id].append((r.id, round(r.score, 6)))
    return out


@pytest.fixture()
def store(spark, tmp_path):
    return Snapshots(spark, str(tmp_path / "index"))


def test_exact_search_with_ties_copies_and_odd_vectors(spark, store, monkeypatch):
    monkeypatch.setattr(X, "PART", 16)
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(400)]  # many equal vectors and equal products
    rows += [(1000 + i, [3.0, 3.0, 3.0, 3.0]) for i in range(200)] + [(5000, None), (None, [1.0] * 4), (5001, [math.nan] * 4), (5002, [1.0, None, 1.0, 1.0]), (5003, [2.0]), (5004, []), (5005, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id bigint, vector array<float>").repartition(5)
    X.build(df, store, cells=12)
    queries = {i for i, _ in rows if i is not None and i % 20 == 0} | {5003, 5004, 5005}
    index = X.VectorIndex(store)
    for k in (1, 7, 100):
        assert found(index.search(df.where(df.id.isin(list(queries))), k, exact=True)) == brute(rows, queries, k)
    assert all(len(r) == 5 for r in found(index.search(df.where("id % 20 = 0"), 5)).values())
    with pytest.raises(ValueError):
        index.search(df, X.MOST_K + 1)


def test_empty_and_tiny_tables(spark, store):
    none = spark.createDataFrame([], "id bigint, vector array<float>")
    X.build(none, store)
    assert X.VectorIndex(store).search(none).collect() == []
    one = spark.createDataFrame([(3, [1.0, 2.0])], "id bigint, vector array<float>")
    X.build(one, store)
    assert found(X.VectorIndex(store).search(one)) == {3: [(3, 5.0)]} and X.VectorIndex(store, 1).search(one).collect() == []


def test_generations_and_lost_races(spark, store):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id bigint, vector array<float>")
    assert X.build(rows.where("id < 25"), store) == 1
    old = X.VectorIndex(store)
    assert X.build(rows, store, expected=1) == 2
    with pytest.raises(RuntimeError):
        X.build(rows, store, expected=1)
    q = rows.where("id = 20")
    assert found(old.search(q, 1, exact=True)) == {20: [(24, 481.0)]} and found(X.VectorIndex(store).search(q, 1, exact=True)) == {20: [(49, 981.0)]}


def test_few_cells_are_read_where_vectors_are_clustered(spark, store):
    rng = np.random.default_rng(1)
    heads = rng.normal(size=(40, 16)) * 10
    rows = [(i, (heads[i % 40] + rng.normal(size=16)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    X.build(df, store, cells=40)
    index = X.VectorIndex(store)
    assert index.model.probes <= 8
    want, got = found(index.search(df.where("id % 20 = 0"), 10, exact=True)), found(index.search(df.where("id % 20 = 0"), 10))
    assert sum(len(set(want[q]) & set(got[q])) for q in want) >= 0.9 * sum(map(len, want.values()))
    assert index.store.read("entries").count() == 4000


def test_recall_of_the_query(spark):
    exact, near = (found(QUERIES[n](spark, SMALL)) for n in ("vectors_top_10_each", "vectors_ann_top_10_each"))
    assert exact.keys() == near.keys() and sum(len(set(exact[q]) & set(near[q])) for q in exact) >= 0.9 * sum(map(len, exact.values()))


def test_tasks_work_on_bounded_pieces():
    """10,000 queries of a batch and 4,096 cells are 41 million promises, and each chosen cell sends the query's vector."""
    for n, each in ((10_000, 4096), (3, 1 << 30), (0, 7), (10, 0)):
        runs = X._pieces(n, each)
        assert [i for a, b in runs for i in range(a, b)] == list(range(n))
        assert all(b - a == 1 or (b - a) * each <= X.AT_ONCE for a, b in runs)
