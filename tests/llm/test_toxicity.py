import itertools
import random

import numpy as np

from shoebox.llm import toxicity as X
from tests.conftest import SMALL

CLEAN = [f"word{c}{d}" for c in "abcdefgh" for d in "klmnop"]
BAD = ["vileish", "vileness", "vileful", "scummo"]


def doc(rng, toxic, n=60):
    w = rng.choices(CLEAN, k=n)
    for _ in range(3 if toxic else 0):
        w[rng.randrange(n)] = rng.choice(BAD)
    return " ".join(w)


def sample(n=200, seed=1):
    rng = random.Random(seed)
    labels = [i % 2 for i in range(n)]
    return [doc(rng, y) for y in labels], labels


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(3)
    move, first, e = rng.normal(size=(2, 2)), 0.4, rng.normal(size=7) * 2
    grid, lengths, row, column = X.gridded(e, [7])
    p, parts = X.forward_backward(grid, lengths, first, move)
    total, tags, moves = 0.0, np.zeros(7), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=7):
        s = np.exp(first * y[0] + sum(e[i] for i in range(7) if y[i]) + sum(move[a, b] for a, b in itertools.pairwise(y)))
        total += s
        tags += s * np.array(y)
        for a, b in itertools.pairwise(y):
            moves[a, b] += s
    assert np.allclose(p[column, row], tags / total) and np.allclose(X.expected_moves(grid, lengths, parts, move), moves / total)


def test_sequences_keep_to_their_texts():
    tagger = X.fit_tagger(*sample())
    words = [["worda"] * 3, [], ["vileful"] * 150, ["wordak"] * 64]
    together = tagger.marginals(words)
    assert [len(p) for p in together] == [3, 0, 150, 64]
    for w, p in zip(words, together, strict=True):
        if w:
            assert np.allclose(tagger.marginals([w])[0], p)


def test_unseen_forms_and_spans(docs_of):
    tagger = X.fit_tagger(*sample())
    texts = ["wordak VILEFUL wordbm. Vileless wordcn", "wordak wordbm", None, "", "12 ??", "wordak " * 3000 + "scummo", "wordak " * 3000]
    found = {r.doc_id: r for r in X.scored(docs_of(texts), tagger).collect()}
    assert [found[i].score >= 0.7 for i in range(7)] == [True, False, False, False, False, True, False]
    assert [(s.start, s.stop) for s in found[0].spans] == [(7, 14), (23, 31)] and found[2].score == 0.0
    s = found[5].spans
    assert len(s) == 1 and texts[5][s[0].start : s[0].stop] == "scummo"


def test_held_out_documents(spark):
    """On the smallest tables few labels are left to learn from; a larger made-up corpus shows the accuracy."""
    found = X.op8_toxicity(spark, SMALL).collect()
    assert len(found) == spark.read.parquet(f"{SMALL}/documents.parquet").count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    texts, labels = sample(300, seed=2)
    tagger = X.fit_tagger(texts[:200], labels[:200])
    held = [max(p, default=0.0) >= 0.7 for p in tagger.marginals([t.split() for t in texts[200:]])]
    assert held == [bool(y) for y in labels[200:]]


def test_held_out_documents_of_the_tables(spark):
    """Where the tables have enough labels to learn from, most held-out toxic documents are found and no clean one is."""
    folder = SMALL.replace("sf0.001", "sf0.01")
    found = {r.doc_id: r for r in X.op8_toxicity(spark, folder).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(labels[i], r.predicted) for i, r in found.items() if r.held_out and labels.get(i) is not None]
    toxic, clean = [p for y, p in held if y == 1], [p for y, p in held if y == 0]
    assert len(toxic) >= 10 and sum(toxic) >= 0.75 * len(toxic) and sum(clean) == 0, (sum(toxic), len(toxic), sum(clean), len(clean))


def brute_score(tagger, text):
    """The most certain token of the text, sequence by sequence, each over all of its paths by plain recursion."""
    words, best = [m[0].lower() for m in X.WORD.finditer(text or "")], 0.0
    for k in range(0, len(words), X.SEQUENCE):
        own = words[k : k + X.SEQUENCE]
        e = [min(30.0, max(-30.0, tagger.b + sum(float(tagger.w[f]) for f in X.features(w)))) for w in own]
        move = tagger.move
        forward = [(0.0, tagger.first + e[0])]
        for x in e[1:]:
            a, b = forward[-1]
            forward.append((np.logaddexp(a + move[0, 0], b + move[1, 0]), np.logaddexp(a + move[0, 1], b + move[1, 1]) + x))
        backward = [(0.0, 0.0)]
        for x in e[:0:-1]:
            a, b = backward[-1]
            backward.append((np.logaddexp(a + move[0, 0], b + move[0, 1] + x), np.logaddexp(a + move[1, 0], b + move[1, 1] + x)))
        total = np.logaddexp(*forward[-1])
        best = max([best, *(float(np.exp(f[1] + g[1] - total)) for f, g in zip(forward, backward[::-1], strict=True))])
    return best


def test_query_against_brute_force(spark):
    folder = SMALL.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    tagger = X.fit(docs, labels.where("pmod(crc32(CAST(doc_id AS STRING)), 3) <> 1"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in X.op8_toxicity(spark, folder).collect():
        if len(texts[r.doc_id] or "") < 2_000 or r.score > 0.3:
            assert abs(r.score - brute_score(tagger, texts[r.doc_id])) < 1e-6 and r.predicted == int(r.score >= 0.7)


def test_fit_from_tables(spark, docs_of):
    texts, labels = sample()
    docs = docs_of(texts + [None])
    table = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)] + [(None, 1, 1), (200, 0, 1), (0, 0, None)], "doc_id bigint, quality int, toxic int")
    tagger = X.fit(docs, table)
    assert tagger.marginals([["vileish", "wordak"]])[0][0] > 0.7 > tagger.marginals([["vileish", "wordak"]])[0][1]
    assert X.fit(docs, table.limit(0)).marginals([["vileish"]])[0][0] < 0.01
    assert X.fit(docs_of([]), table).marginals([["vileish"]])[0][0] < 0.01
    assert X.scored(docs_of([]), tagger).count() == 0


def test_near_copies_make_no_marks():
    rng = random.Random(5)
    texts, labels = sample(120)
    rare = " ".join(f"zebra{c}xx" for c in "abcdefghijkl")
    copies = [f"{rare} {rng.choice(CLEAN)} vileful scummo" for _ in range(60)]
    tagger = X.fit_tagger(texts + copies, labels + [1] * 60)
    assert tagger.marginals([rare.split()])[0].max() < 0.5


def test_labels_are_no_input(docs_of):
    tagger = X.fit_tagger(*sample())
    texts = sample(20, 9)[0]
    score = lambda lang: [r.score for r in X.scored(docs_of([(i, t, lang) for i, t in enumerate(texts)]), tagger).orderBy("doc_id").collect()]
    assert score("en") == score("de")


def test_long_texts_are_done_in_blocks():
    tagger = X.fit_tagger(*sample())
    rng = random.Random(6)
    text = " ".join(rng.choice(CLEAN + BAD[:1]) for _ in range(2000)) + "."
    whole = tagger.marginals([[w.lower() for w in X.WORD.findall(text)]])[0]
    want = (float(whole.max()), tagger.spans(list(X.WORD.finditer(text)), whole))
    at_once = X.SEQUENCES_AT_ONCE
    X.SEQUENCES_AT_ONCE = 3
    try:
        score, spans = tagger.long_text(text)
    finally:
        X.SEQUENCES_AT_ONCE = at_once
    assert abs(score - want[0]) < 1e-12 and tagger.long_text("") == (0.0, [])
    assert {i for s in spans for i in range(s["start"], s["stop"]) if text[i] != " "} == {i for s in want[1] for i in range(s["start"], s["stop"]) if text[i] != " "}
