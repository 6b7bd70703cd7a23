"""Text quality: measures by plain code, tables by hand, held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from shoebox.llm import common, quality as Q
from tests.conftest import SMALL

WORDS = "the and of water house there small river which under light stone because morning between".split()


def prose(rng, n):
    return ". ".join(" ".join(rng.choice(WORDS) for _ in range(9)).capitalize() for _ in range(n)) + "."


def junk(rng, n):
    kind = rng.randrange(3)
    return [" ".join(rng.choice(WORDS) + "###" for _ in range(9 * n)), (rng.choice(WORDS) + " ") * 9 * n, " | ".join(rng.choice(WORDS).upper() for _ in range(9 * n))][kind]


def test_measures_by_plain_code():
    text = "One two two. THREE ab### | x\n\nOne two two. THREE ab### | x\nEnd, 42!"
    words, got = text.split(), dict(zip(Q.MEASURES, Q.measures(text), strict=True))
    letters = [c for c in text if c.isalpha()]
    assert got["words"] == pytest.approx(np.log1p(len(words))) and got["word_length"] == pytest.approx(sum(map(len, words)) / len(words))
    assert got["upper_letters"] == pytest.approx(sum(c.isupper() for c in letters) / len(letters)) and got["digits"] == pytest.approx(2 / sum(map(len, words)))
    assert got["capital_words"] == pytest.approx(2 / 16) and got["marked_words"] == pytest.approx(5 / 16) and got["lone_symbols"] == pytest.approx(2 / 16)
    assert got["repeated_words"] == pytest.approx(0 / 16) and got["top_word"] == pytest.approx(2 / 16) and got["repeated_lines"] == pytest.approx(28 / len(text))
    assert got["repeated_pairs"] == pytest.approx((15 - len(set(zip(words, words[1:], strict=False)))) / 16) and got["ended_lines"] == pytest.approx(1 / 3) and got["commas"] == pytest.approx(1 / 16)
    assert all(np.isfinite(Q.measures(t)).all() for t in (None, "", " \n", "x", "...", "\ud800", "é" * 99, "\n".join("ab"))) and Q.measures(None) == Q.measures("") == Q.measures("\n ")


def test_long_texts_are_measured_whole(monkeypatch):
    rng = random.Random(1)
    text = prose(rng, 400) + " " + junk(random.Random(3), 400)
    whole = Q.measures(text)
    monkeypatch.setattr(Q, "BLOCK_CHARS", 999)
    assert "".join(Q._blocks(text)).replace(" ", "") == text.replace(" ", "") and len(list(Q._blocks(text))) > 10
    cut = Q.measures(text)
    same = ["words", "word_length", "long_words", "upper_letters", "capital_words", "symbols", "digits", "marked_words", "lone_symbols", "commas"]
    assert all(cut[k] == pytest.approx(whole[k], rel=1e-3) for k in map(Q.MEASURES.index, same))
    assert Q.measures("x" * 5000) and len(list(Q._blocks("x" * 5000))) == 1


def test_tree_cuts_where_the_gradient_changes():
    g = np.array([[1.0], [1.0], [-1.0], [-1.0], [1.0], [1.0]]) * 50
    tree = Q.shallow_tree(g, np.full((6, 1), 25.0), np.full((6, 1), 100.0))
    assert (np.sign(tree) == np.sign(g)).all() and len(set(tree.ravel().round(9))) == 3 - (tree[0, 0] == tree[5, 0])
    both = np.array([[60.0, -20.0], [-60.0, 40.0]])  # a greedy first cut needs some gain
    assert (np.sign(Q.shallow_tree(both, np.full((2, 2), 25.0), np.full((2, 2), 50.0))) == np.sign(both)).all()


def test_score_is_a_sum_of_lookups_and_pairs_learn_what_single_measures_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    m = Q.fit_model(x[:3000], y[:3000])
    s = m.score(x[3000:])
    assert ((s > 0.5) == y[3000:]).mean() > 0.9 and (0, 1) in m.pairs
    for row, got in zip(x[3000:3020], s, strict=False):
        total = m.bias + sum(t[int((c <= v).sum())] for c, t, v in zip(m.cuts, m.tables, row, strict=True))
        total += sum(t[int((m.coarse[i] <= row[i]).sum()), int((m.coarse[j] <= row[j]).sum())] for (i, j), t in zip(m.pairs, m.pair_tables, strict=True))
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


@pytest.mark.parametrize("y", [[], [1] * 30, [0] * 30])
def test_one_label_or_none(y):
    s = Q.fit_model(np.random.rand(len(y), len(Q.MEASURES)), np.array(y, int)).score(np.zeros((2, len(Q.MEASURES))))
    assert s[0] == s[1] == pytest.approx((sum(y) + 1) / (len(y) + 2))


def test_odd_tables(spark, docs_of):
    rng = random.Random(2)
    good, bad = [prose(rng, 5 + i) for i in range(60)], [junk(rng, 5 + i) for i in range(60)]
    docs = docs_of([*enumerate(good + bad), (1000, None), (1001, ""), (1002, "x " * 200_000), (None, good[0]), (0, good[0]), (0, good[0])])
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120) if i % 3] + [(None, 0), (5, None), (7, 9), (1, 0), (99999, 1)], "doc_id bigint, quality int").selectExpr("*", "1 AS y", "'t' AS h")
    model = Q.fit(docs, labels)
    found = [(r.doc_id, r.score) for r in Q.scored(docs, model).collect()]
    assert len(found) == 126 and all(0 <= s <= 1 for _, s in found)
    s = dict(found)
    assert sum(s[i] >= Q.THRESHOLD for i in range(0, 60, 3)) >= 19 and sum(s[i] < Q.THRESHOLD for i in range(60, 120, 3)) >= 19 and s[1002] < Q.THRESHOLD and s[1000] == s[1001] and s[None] == s[0]
    assert Q.scored(docs.where("false"), model).collect() == []
    assert {r.score for r in Q.scored(docs, Q.fit(docs, labels.where("false"))).collect()} == {0.5}


def test_few_rows_are_a_sample_of_any_order(spark, docs_of):
    rng = random.Random(4)
    docs = docs_of([prose(rng, 8) if i % 2 else junk(rng, 8) for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    a, b = Q.fit(docs, labels, max_rows=40), Q.fit(docs.repartition(7), labels.orderBy("quality"), max_rows=40)
    assert a.bias == b.bias and all((x == y).all() for x, y in zip(a.tables + a.pair_tables, b.tables + b.pair_tables, strict=True))


def test_query_on_held_out_documents(spark):
    found = {r.doc_id: r for r in Q.op12_quality(spark, SMALL).collect()}
    docs = {r.doc_id: r.text for r in common.table(spark, SMALL, "documents").collect()}
    assert found.keys() == docs.keys() and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for i, r in found.items())
    y = {r.doc_id: r.quality for r in common.table(spark, SMALL, "labels").collect()}
    out = [(found[i].predicted, y[i]) for i in y if found[i].held_out]
    assert sum(p == q for p, q in out) >= 0.9 * len(out) and len({q for _, q in out}) == 2
