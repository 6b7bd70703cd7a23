import random

import numpy as np
import pytest
import xxhash

from shoebox.llm import common, graph, simhash as S
from tests.conftest import SMALL


def brute_fingerprint(text):
    w = [x.decode() for x in S.WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())]
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_groups(fps):
    """The least index reachable over links of 3 differing bits or fewer."""
    x = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[:i]) <= 3):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return [find(i) for i in range(len(fps))]


def test_query_against_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    fps = [brute_fingerprint(t) for _, t in docs]
    want = {i: (f"{fp:016x}", docs[g][0]) for (i, _), fp, g in zip(docs, fps, brute_groups(fps), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in S.op6_simhash_near_dedup(spark, SMALL).collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_links_of_up_to_three_bits(spark, seed):
    """Chains, stars and pairs at every small distance, among random fingerprints."""
    rng = random.Random(seed)
    fps = []
    for _ in range(40):
        x = rng.getrandbits(64)
        fps.append(x)
        for d in range(1, 7):
            y = x
            for b in rng.sample(range(64), d):
                y ^= 1 << b
            fps.append(y)
        for _ in range(5):  # a chain of steps of three
            for b in rng.sample(range(64), 3):
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps))
    groups = brute_groups(fps)
    with common.Scratch(spark, "test") as scratch:
        found = {r.fp & (2**64 - 1): r.group & (2**64 - 1) for r in S.fingerprint_groups(spark.createDataFrame([(S._signed(x),) for x in fps], "fp bigint"), scratch).collect()}
    parts, want = {}, {}
    for x, g in zip(fps, groups, strict=True):
        want.setdefault(g, set()).add(x)
        parts.setdefault(found[x], set()).add(x)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want.values()))


def test_long_text_in_blocks():
    rng = random.Random(4)
    text = " ".join(rng.choices(["alpha", "Beta", "gamma", "x"], k=5000))
    whole, at_once = S.fingerprint(text), (S.LONG_BYTES, S.WORDS_AT_ONCE)
    S.LONG_BYTES, S.WORDS_AT_ONCE = 10, 7
    try:
        assert S.fingerprint(text) == whole == S._signed(brute_fingerprint(text))
        assert [S.fingerprint(t) for t in ("a", "a b", "a b c", " ", None)] == [S._signed(brute_fingerprint(t)) for t in ("a", "a b", "a b c", " ", None)]
    finally:
        S.LONG_BYTES, S.WORDS_AT_ONCE = at_once


def test_edges(docs_of):
    docs = docs_of([(7, None), (3, ""), (9, " \n"), (4, "one two three four"), (4, "one two three four"), (2, "ONE two\tthree four"), (None, "other words of its own here")])
    got = {(r.doc_id, r.fp == 0, r.component_id) for r in S.near_duplicates(docs).collect()}
    assert got == {(7, True, 3), (3, True, 3), (9, True, 3), (4, False, 2), (2, False, 2), (None, False, None)}
    assert S.near_duplicates(docs).count() == 7 and S.near_duplicates(docs_of([])).count() == 0


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2001 + i) for i in range(50)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for pair in links if pair[0] != pair[1] for x in pair}
    with common.Scratch(spark, "test") as scratch:
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "u bigint, v bigint"), scratch).collect()}
        assert got == want
        assert graph.components(spark.createDataFrame([], "u bigint, v bigint"), scratch).count() == 0


def test_a_hub_of_very_many_links(spark):
    """One node with 100,000 links, each end of which has one more: two rounds, and one component."""
    hub = spark.range(1, 100_001).selectExpr("id AS u", "500000L AS v").unionByName(spark.range(1, 100_001).selectExpr("id AS u", "id + 1000000 AS v"))
    with common.Scratch(spark, "test") as scratch:
        row = graph.components(hub, scratch).selectExpr("count(*) AS n", "min(component) AS a", "max(component) AS b").first()
    assert (row.n, row.a, row.b) == (200_001, 1, 1)
