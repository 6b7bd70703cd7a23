"""The trigram index against scans of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from shoebox.operators import text_index as X
from shoebox.sources.snapshots import Snapshots

SCHEMA = "id bigint, name string, body string, other int"


def made(n, seed=0):
    rng = random.Random(seed)
    words = ["Beach", "sun", "ÉTÉ", "straße", "😀 smile", "a", "", "THE", "then", "x" * 50, "it's 100%", "under_score", "İstanbul"]
    return [(i, rng.choice([None, "", f"IMG_{i}.JPG"]), rng.choice([None, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))]), i % 3) for i in range(n)]


def holds(row, phrase, fields=("name", "body")):
    return any(phrase.strip().lower() in (row[SCHEMA.split(", ").index(f"{f} string")] or "").lower() for f in fields)


@pytest.fixture()
def index(spark, tmp_path):
    return X.TextIndex(Snapshots(spark, str(tmp_path / "index")), ["id"], ["name", "body"])


PHRASES = ["the", " THE ", "beach sun", "été", "aße", "😀 s", "0%", "100%", "r_s", "_12", "12", "xxx", "nowhere at all", "g_1", "e", "", "stanbul"]


def ids(df):
    return sorted(r.id for r in df.collect())


def test_equal_to_a_scan(spark, index, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 16)
    rows = made(400)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index.apply(table)
    for phrase in PHRASES:
        want = ids(table.where(X.has_phrase(F.col("name"), phrase) | X.has_phrase(F.col("body"), phrase)))
        assert ids(index.search(phrase)) == want
        if "i" not in phrase and "stanbul" not in phrase:
            assert want == [r[0] for r in rows if holds(r, phrase)]
    assert ids(index.search("img", ["body"])) == [] and len(ids(index.search("img", ["name"]))) > 100
    monkeypatch.setattr(X, "NAMED", 5)  # candidates are joined
    assert ids(index.search("the")) == [r[0] for r in rows if holds(r, "the")]
    assert index.search("the").columns == ["id", "name", "body", "other"]


def test_segments_tombstones_and_merges(spark, index, monkeypatch):
    monkeypatch.setattr(X, "SEGMENTS", 2)
    state, rng = {}, random.Random(9)
    for step in range(4):
        new = [(i, *r[1:]) for i, r in zip(rng.sample(range(200), 25), made(25, step), strict=True)]
        gone = rng.sample(range(200), 5)
        gone = [g for g in gone if g not in {r[0] for r in new}]
        index.apply(spark.createDataFrame(new, SCHEMA), spark.createDataFrame([(g,) for g in gone], "id bigint"))
        state = {k: v for k, v in state.items() if k not in gone} | {r[0]: r for r in new}
        if step > 0:
            for phrase in ("the", "beach sun", "e"):
                assert ids(index.search(phrase)) == sorted(i for i, r in state.items() if holds(r, phrase))
    assert len(index._segments(index.store.current())) <= X.SEGMENTS
    index.merge()
    assert len(index._segments(index.store.current())) == 1 and ids(index.rows()) == sorted(state)
    index.apply(gone=spark.createDataFrame([(i,) for i in state], "id bigint"))
    assert ids(index.search("the")) == [] and ids(index.search("e")) == []


def test_only_candidates_are_read(spark, index):
    rows = [(i, f"n{i}", f"filler text number {i} " + ("needle" if i == 777 else ""), 0) for i in range(2000)]
    index.apply(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    found = index.search("needle")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc" in plan or "PushedFilters: [IsNotNull(doc), EqualTo(doc" in plan or "EqualTo(doc," in plan
    assert [r.id for r in found.collect()] == [777] and ids(index.candidates("needle").withColumnRenamed("doc", "id")) == [777]
    grams = index._rarest(index._segments(1), "needle")
    assert 1 <= len(grams) <= X.MOST_GRAMS and index.candidates("nowhere") is None


def test_a_frequent_trigram_is_split_and_an_empty_table(spark, index, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 8)
    index.apply(spark.createDataFrame([], SCHEMA))
    assert ids(index.search("the")) == [] and ids(index.search("")) == []
    index.apply(spark.createDataFrame([(i, None, "same same", 0) for i in range(400)], SCHEMA).repartition(2))
    segment = index._segments(index.store.current())[-1]
    postings = spark.read.parquet(f"{segment[1]}/postings").where(F.col("gram") == int(X.grams_of("sam")[0]))
    assert postings.count() >= 50 and postings.agg(F.max(F.size("docs"))).first()[0] <= 8
    assert len(ids(index.search("same same"))) == 400
