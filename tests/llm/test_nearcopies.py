"""Near copies against all pairs, and their recall by likeness."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from shoebox.llm import common, nearcopies as N
from tests.conftest import SMALL


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def classes(nodes, links):
    top = {n: n for n in nodes}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(rows, seeds=N.SEEDS):
    """rows: (id, text), ids different."""
    texts, links = dict(rows), []
    fps = {i: N.fingerprints_of(t, seeds) for i, t in rows}
    for s in range(seeds):
        near = [(a, b) for a, b in combinations(texts, 2) if ((fps[a][s] ^ fps[b][s]) & (2**64 - 1)).bit_count() <= 3]
        group = classes(texts, near)
        links += [(a, b) for a, b in combinations(texts, 2) if group[a] == group[b] and likeness(texts[a], texts[b]) >= 0.8]
    return classes(texts, links)


def edited(rng, text, share):
    return " ".join(f"w{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def made(rng, n):
    return " ".join(f"v{int(rng.paretovariate(0.9))}" for _ in range(n))


def of(df, **more):
    return {r.doc_id: r.component_id for r in N.near_copies(df, **more).collect()}


def test_all_links_of_families_chains_and_odd_texts(spark, docs_of, monkeypatch):
    monkeypatch.setattr(N, "HUBS", 1)
    rng = random.Random(3)
    rows, at = [], 0
    for _ in range(4):
        text = made(rng, rng.randrange(60, 400))
        for k in range(7):
            rows.append((at := at + 1, text))
            # chains: each a copy of the last, so their ends are not alike; and copies of one text
            text = edited(rng, text if k % 2 else rows[-k - 1 if k else -1][1], rng.choice([0.005, 0.015, 0.03]))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "One  TWO"), (1005, "one three"), (1006, made(rng, 30_000))]
    rows.append((1007, edited(rng, rows[-1][1], 0.01)))
    got = of(docs_of(rows))
    assert got == brute(rows) and got[1000] == got[1001] == got[1002] == 1000 and got[1004] == 1003 and got[1005] == 1005 and got[1007] == 1006


def test_repeated_rows_null_ids_and_no_rows(spark, docs_of):
    df = docs_of([(5, "a b c"), (5, "a b c"), (3, "a b c"), (None, "a b c"), (None, "x y z")])
    assert sorted(map(tuple, N.near_copies(df).collect()), key=repr) == sorted([(5, 3), (5, 3), (3, 3), (None, 3), (None, None)], key=repr)
    assert N.near_copies(df.where("false")).collect() == []


@pytest.mark.parametrize(("low", "high", "least"), [(0.8, 0.85, 0.9), (0.85, 0.9, 0.9), (0.9, 0.95, 0.95), (0.95, 1.0, 0.98)])
def test_recall_by_likeness(spark, low, high, least):
    """Texts of the tables with words replaced at random: how often any fingerprint is within three bits."""
    rng, found = random.Random(7), []
    texts = [r.text for r in common.table(spark, SMALL.replace("sf0.001", "sf0.01"), "documents").where("length(text) BETWEEN 600 AND 14000").orderBy("doc_id").limit(400).collect()]
    for text in texts:
        for share in (0.002, 0.005, 0.01, 0.015, 0.02, 0.024):
            other = edited(rng, text, share)
            if low <= likeness(text, other) < high:
                found.append(any(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in zip(N.fingerprints_of(text), N.fingerprints_of(other), strict=True)))
    assert len(found) > 60 and sum(found) >= least * len(found), (len(found), sum(found) / len(found))


def test_no_link_below_the_likeness_and_all_above_on_the_tables(spark):
    docs = common.table(spark, SMALL, "documents").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = of(docs)
    assert got == brute(rows)
    want = classes(dict(rows), [(a, b) for (a, s), (b, t) in combinations(rows, 2) if likeness(s, t) >= 0.8])
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
    assert N.near_copies(docs).agg(F.count("*")).first()[0] == len(rows)


@pytest.fixture
def one_group(monkeypatch):
    """All texts pass the sieve and are in one group; the names of the tables that are written."""
    names, written = [], N.Scratch.written
    monkeypatch.setattr(N, "fingerprint_groups", lambda fps, scratch: fps.withColumn("group", F.lit(0).cast("bigint")))
    monkeypatch.setattr(N, "sieved", lambda least: least.select("key"))
    monkeypatch.setattr(N.Scratch, "written", lambda self, df, what: names.append(what) or written(self, df, what))
    return names


def test_texts_in_one_group_by_chance_are_not_compared(spark, docs_of, one_group):
    rng = random.Random(5)
    passage = made(rng, 40)
    rows = [(i, f"{passage} {' '.join(f'u{rng.randrange(10**6)}' for _ in range(60))}") for i in range(80)]
    rows += [(100 + i, edited(rng, rows[i][1], 0.02)) for i in range(0, 80, 4)]
    want = classes(dict(rows), [(a, b) for (a, s), (b, t) in combinations(rows, 2) if likeness(s, t) >= 0.8])
    assert of(docs_of(rows)) == want and len(set(want.values())) < 100
    # as many rounds as the group's size has binary digits before
    assert one_group.count("hubs") == 1


@pytest.mark.parametrize("hubs", [1, 2])
def test_all_links_of_families_in_one_group(spark, docs_of, one_group, monkeypatch, hubs):
    monkeypatch.setattr(N, "HUBS", hubs)
    monkeypatch.setattr(N, "MORE", 2)
    rng, rows = random.Random(hubs), []
    for n in (5, 6, 9, 10, 40, 150, 300):
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
        rows += [(len(rows) + k, edited(rng, text, share)) for k, share in enumerate([0, 0, *[0.01, 0.02, 0.03, 0.04] * 4])]
    links = [(a, b) for (a, s), (b, t) in combinations(rows, 2) if likeness(s, t) >= 0.8]
    assert of(docs_of(rows)) == classes(dict(rows), links) and len(links) > 100


def family(rng, n):
    """Texts made of one of 150 words: up to 7 places edited, cut or continued, some with places edited alike; none of under two
    edits, so few are alike."""
    base = [f"w{i}" for i in range(150)]
    shared = [[(rng.randrange(150), f"s{k}{j}") for j in range(3)] for k in range(4)]
    for k in range(n):
        words = list(base)
        for at, word in rng.choice(shared) if k % 5 == 0 else []:
            words[at] = word
        for _ in range(rng.randrange(2, 8)):
            words[rng.randrange(150)] = f"u{rng.randrange(10**6)}"
        if k % 7 == 0:
            words = words[rng.randrange(0, 40) :]
        if k % 11 == 0:
            words += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(30))]
        yield " ".join(words)


def counted(monkeypatch):
    """The number of rows of each table of pairs."""
    counts, before = [], N.Scratch.written

    def written(self, df, what):
        found = before(self, df, what)
        if what == "pairs":
            counts.append(found.count())
        return found

    monkeypatch.setattr(N.Scratch, "written", written)
    return counts


def test_a_large_family_of_texts_that_are_hardly_alike_is_not_compared_by_pairs(spark, docs_of, one_group, monkeypatch):
    counts = counted(monkeypatch)
    rows = list(enumerate(family(random.Random(11), 160)))
    links = [(a, b) for (a, s), (b, t) in combinations(rows, 2) if likeness(s, t) >= 0.8]
    want = classes(dict(rows), links)
    assert of(docs_of(rows)) == want and 10 < len(links) and len(set(want.values())) > 40
    # 7,639 by what the family shares
    assert sum(counts) < 4 * len(rows)


@pytest.mark.parametrize("seed", range(3))
def test_all_links_where_a_group_has_a_core_or_none(spark, docs_of, one_group, seed):
    """One family, and texts that have nothing to do with it: as many, so that no shingle is in over half, or a few."""
    rng = random.Random(seed)
    texts = [*family(rng, 60), *(made(rng, rng.randrange(3, 200)) for _ in range((0, 20, 70)[seed]))]
    texts += [edited(rng, t, 0.015) for t in texts[::3]]
    rows = list(enumerate(texts))
    links = [(a, b) for (a, s), (b, t) in combinations(rows, 2) if likeness(s, t) >= 0.8]
    assert of(docs_of(rows)) == classes(dict(rows), links) and len(links) > 10


def test_likeness_of_exactly_the_least_links_and_less_does_not(spark, docs_of, one_group):
    words = [f"w{i}" for i in range(94)]  # 90 shingles
    # 80 of 100 shingles in common, and 79 of 101
    rows = [(1, " ".join(words)), (2, " ".join([*words[10:], *(f"x{i}" for i in range(10))])), (3, " ".join([*(f"y{i}" for i in range(11)), *words[11:]]))]
    rows += [(10 + i, " ".join(words[5 * i : 5 * i + 40])) for i in range(4)]
    assert likeness(rows[0][1], rows[1][1]) == 0.8 > likeness(rows[0][1], rows[2][1])
    links = [(a, b) for (a, s), (b, t) in combinations(rows, 2) if likeness(s, t) >= 0.8]
    assert of(docs_of(rows)) == classes(dict(rows), links) and (1, 2) in links and (1, 3) not in links
