import random
import re

import pytest

from shoebox.llm import decontam as D
from tests.conftest import SMALL, same_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    grams = {}
    for item, t in items:
        w = words(t)
        k = min(D.WINDOW, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    sizes = {len(g) for g in grams}
    out = {}
    for i, t in docs:
        w, hit, own = words(t), set(), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if (g := tuple(w[j : j + k])) in grams:
                    hit.update(range(j, j + k))
                    own |= grams[g]
        out[i] = (len(w), len(hit), sorted(own))
    return out


def random_text(rng, n):
    return " ".join(rng.choices(["the", "The", "cat", "sat's", "on", "mät", "42", "-", "ok!"], k=n))


def test_query_against_sql(spark, duck):
    assert same_rows(D.op4_decontamination(spark, SMALL).toPandas(), duck.execute(D.ORACLE).df())


def test_against_brute_force_in_one_and_more_blocks(spark, docs_of):
    rng = random.Random(11)
    items = [(i, random_text(rng, n)) for i, n in enumerate([0, 1, 3, 9, 10, 11, 40, 60])] + [(8, None), (9, "zebra quagga okapi")]
    texts = [random_text(rng, n) for n in (0, 5, 30, 200, 400)] + [f"x {items[6][1]} y {items[7][1][:60]}", "a zebra QUAGGA, okapi!", None, ""]
    bench = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "1 AS item")
    want = brute(list(enumerate(texts)), items)
    for size in (D.BLOCK_WINDOWS, 30):  # the longest item has 51 windows
        found = D.scan_documents(docs_of(texts), bench, block_windows=size, carry=("lang",)).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in found} == want and len(found) == len(texts)
        for r in found:
            assert r.lang == "en" and r.n_hit == sum(len(words(texts[r.doc_id][s.start : s.stop])) for s in r.spans)


@pytest.mark.parametrize("size", [D.BLOCK_WINDOWS, 12])
def test_a_window_of_very_many_items(spark, docs_of, size, monkeypatch):
    """A prompt line that all items share stands in the broadcast once, without their names."""
    prompt = "answer the question below with one of the four letters given"
    items = [(i, f"{prompt} q{i} r{i} s{i}") for i in range(60)] + [(100, "short one")]
    texts = [f"x {prompt} y", f"{prompt} q7 r7 s7 t7", "a short one", "none of it", None, f"x {prompt} y"]
    bench = spark.createDataFrame(items, "item_id int, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in D.scan_documents(docs_of(texts), bench, block_windows=size).collect()}
    assert found == brute(list(enumerate(texts)), items) and len(found[0][2]) == 60
    sets, made = [], D.Windows.__init__
    monkeypatch.setattr(D.Windows, "__init__", lambda self, rows: sets.extend(rows) or made(self, rows))
    D.scan_documents(docs_of(texts), bench, block_windows=size)
    assert sum(isinstance(own, int) for _, own in sets) == 2 and max(len(own) for _, own in sets if not isinstance(own, int)) <= D.INLINE


def test_repeated_rows_with_several_sets(spark, docs_of):
    bench = spark.createDataFrame([("i", " ".join(f"w{k}" for k in range(40)))], "item_id string, text string")
    docs = docs_of([(1, "w1 " * 3 + " ".join(f"w{k}" for k in range(3, 30)))] * 3 + [(None, " ".join(f"w{k}" for k in range(12)))] * 2 + [(2, None)])
    one, many = (sorted(map(repr, D.scan_documents(docs, bench, block_windows=n, carry=("lang",)).collect())) for n in (100, 4))
    assert one == many and len(one) == 6 and sum("n_hit=27" in r for r in one) == 3
    with pytest.raises(ValueError, match="items"):
        D.scan_documents(docs.selectExpr("*", "1 AS items"), bench, carry=("items",))


def test_removal(spark, docs_of):
    bench = spark.createDataFrame([("i", "one two three four")], "item_id string, text string")
    docs = docs_of(["a ONE, two three: four! b", "clean", None, "one two three four", "one two three four one two three four."])
    assert sorted((r.doc_id, r.text) for r in D.decontaminate(docs, bench, "spans").collect() if r.text is not None) == [(0, "a ! b"), (1, "clean"), (3, ""), (4, ".")]
    assert sorted(r.doc_id for r in D.decontaminate(docs, bench).collect()) == [1, 2]


def test_edges(spark, docs_of):
    none = spark.createDataFrame([], "item_id string, text string")
    docs = docs_of([(1, "a b"), (1, "a b"), (None, None)])
    assert sorted((repr(r.doc_id), r.n_words, r.n_hit) for r in D.scan_documents(docs, none).collect()) == [("1", 2, 0), ("1", 2, 0), ("None", 0, 0)]
    nulls = spark.createDataFrame([(None, "a"), (None, None), ("x", "?!")], "item_id string, text string")
    assert {tuple(r["items"]) for r in D.scan_documents(docs, nulls).collect()} == {("null",), ()}
    assert D.scan_documents(docs_of([]), nulls).count() == 0
