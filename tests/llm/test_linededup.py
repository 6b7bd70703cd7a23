import os
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from shoebox.llm import common, linededup as L
from tests.conftest import SMALL, same_rows

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(docs, least, first=False):
    seen = defaultdict(set)
    for n, (_, t) in enumerate(docs):
        for line in (t or "").split("\n"):
            if key(line):
                seen[key(line)].add(n)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        gone = [bool(key(x)) and len(seen[key(x)]) >= least and not (first and i == min(docs[n][0] for n in seen[key(x)])) for x in lines]
        out.append((i, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), sum(gone)))
    return sorted(out)


TEXTS = ["a\nB \nc", " A\nb\n\nc\n", "a\na\na", "\u00a0a\nx", "", None, "\n\n", "\r\na\x0b\r\ny", "B\nz\nB", "c"]


def test_query_against_sql(spark, duck):
    assert same_rows(L.op10_line_dedup(spark, SMALL).toPandas(), duck.execute(L.ORACLE).df())


def test_against_brute_force(docs_of):
    docs = list(enumerate(TEXTS))
    for least, keep in ((1, "none"), (2, "first"), (3, "first"), (3, "none"), (99, "first")):
        found = L.dedup_lines(docs_of(docs), least, keep=keep, more=("lang", "key")).collect()
        assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found) == brute(docs, least, keep == "first")
        assert {(r.lang, r.key) for r in found} == {("en", 1)}


def test_repeated_rows_and_null_ids(docs_of):
    docs = [(1, "a\nu"), (1, "a\nu"), (None, "a\nv"), (None, "a\nv"), (2, "a")]
    assert sorted((repr(r.doc_id), r.text) for r in L.dedup_lines(docs_of(docs), 5).collect()) == [("1", "u"), ("1", "u"), ("2", ""), ("None", "v"), ("None", "v")]
    assert sorted((repr(r.doc_id), r.text) for r in L.dedup_lines(docs_of(docs), 6).collect()) == [("1", "a\nu"), ("1", "a\nu"), ("2", "a"), ("None", "a\nv"), ("None", "a\nv")]
    assert L.dedup_lines(docs_of([])).count() == 0


def batches_of(spark, n, width=9):
    """n batches of (key, first) with keys that many of them share."""
    rows = [[(bytes([(b * 3 + d * p) % width]), 10 * b + d) for d in range(3) for p in range(3)] for b in range(n)]
    return rows, [spark.createDataFrame(r, "key binary, first int") for r in rows]


def test_batches_are_anti_joined_with_the_runs_and_add_their_own(spark):
    """Sixteen batches reach the third level; what is settled is not counted again, and the sum is that of all rows."""
    rows, frames = batches_of(spark, 16, 40)
    count, first = Counter(k for r in rows for k, _ in r), {}
    for r in rows:
        for k, i in r:
            first[k] = min(i, first.get(k, i))
    with common.Scratch(spark, "test") as scratch:
        runs = L.LineRuns(scratch, 6, "int")
        for n, frame in enumerate(frames):
            before = {bytes(r.key) for r in runs._read(runs.settled).collect()}
            runs.admit(frame)
            assert all(len(level) < L.FANOUT for level in runs.levels)
            added = {bytes(r.key) for p in runs.levels[0][-1:] for r in runs._read([p]).collect()} if (n + 1) % L.FANOUT else set()
            assert not before & added
        assert len(runs.levels) == 3 and len(runs.levels[2]) == 1 and not runs.levels[0] and not runs.levels[1]
        found = runs.common().collect()
        assert {bytes(r.key): r.n_docs for r in found} == {k: c for k, c in count.items() if c >= 6} and len(found) == len({r.key for r in found})
        assert {bytes(r.key): r.first for r in found} == {k: first[k] for k, c in count.items() if c >= 6}
        assert L.LineRuns(scratch, 6).common().count() == 0


def test_the_number_of_batches_leaves_the_result_alone(docs_of):
    docs = [(i, f"common\n{i % 7}\nown {i}\n{i % 3}x") for i in range(60)] + [(None, "common\n1"), (None, "z")]
    want = None
    for batches in (1, 16):
        for keep in ("none", "first"):
            found = sorted(map(repr, L.dedup_lines(docs_of(docs), 9, keep=keep, batches=batches).collect()))
            want = (want or {}) | {keep: (want or {}).get(keep, found)}
            assert found == want[keep]
    assert sorted(r.text for r in L.dedup_lines(docs_of(docs), 9, batches=16).collect() if r.doc_id == 6) == ["6\nown 6"]


def test_hot_lines_are_broadcast(docs_of, monkeypatch):
    docs = [(i, f"common\n{i % 7}\nown {i}\n{i % 3}x") for i in range(60)]
    want = [sorted(map(repr, L.dedup_lines(docs_of(docs), 5, keep=keep).collect())) for keep in ("none", "first")]
    monkeypatch.setattr(L, "HOT_LINES", 6)  # only the commonest is hot then
    assert [sorted(map(repr, L.dedup_lines(docs_of(docs), 5, keep=keep).collect())) for keep in ("none", "first")] == want


def test_very_many_lines_take_about_linear_time(docs_of):
    def seconds(n):
        docs = docs_of([(1, "\n".join(f"line {i % (n - 5)}" for i in range(n)))])
        start = time.time()
        (row,) = L.dedup_lines(docs, 1).collect()
        assert (row.n_lines, row.n_dropped, row.text) == (n, n, "")
        return time.time() - start

    seconds(1_000)
    a, b = seconds(40_000), seconds(160_000)
    assert b < 2.5 * a + 2, (a, b)


def test_keys_are_equal_but_for_the_case_of_a_to_z(spark):
    texts = ["Az", "aZ", "\u00c9", "\u00e9", "\u00c3\u00a9", "\u3a4b", "\u0130", "i", "\u1e9e", "\U0001f600", "\u00d7", "\u00df", "\u00f7"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", common.az_folded(F.col("t")).alias("f")).collect()
    for a in rows:
        for b in rows:
            assert (a.f == b.f) == (key(a.t) == key(b.t))


def test_only_the_hits_are_left_on_disk(spark, docs_of):
    top = common.shared_dir(spark, "x").rsplit("/", 1)[0]
    os.makedirs(top, exist_ok=True)
    before = set(os.listdir(top))
    L.dedup_lines(docs_of([(i, "a") for i in range(12)])).collect()
    assert [n.split("-")[0] + "-" + n.split("-")[1] for n in set(os.listdir(top)) - before] == ["line-hits"]


def test_no_python_in_the_plan(spark):
    plan = L.op10_line_dedup(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
