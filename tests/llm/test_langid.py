import random

import numpy as np
import pytest

from shoebox.llm import langid as L
from tests.conftest import SMALL

LANGS = {"en": ["the", "house", "with", "which", "thing", "there"], "de": ["der", "haus", "nicht", "schön", "über", "einen"], "fr": ["le", "maison", "avec", "être", "où", "chose"]}


def sentence(lang, n, seed):
    return " ".join(random.Random(seed).choices(LANGS[lang], k=n)).capitalize() + "."


def train_rows():
    return [(k, sentence(lang, 60, k), lang) for k, lang in enumerate(list(LANGS) * 12)]


def brute_phrases(sample, text):
    """Greedy longest phrases that occur in the sample; a letter that it lacks is one phrase of its own."""
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample and text[at : at + k] in sample:
            k += 1
        at += k
        n += 1
    return n


@pytest.mark.parametrize("stretch", [3, 17, L.STRETCH])
def test_phrases_against_brute_force(stretch, monkeypatch):
    """However the texts are cut into stretches, the phrases are those of the whole."""
    monkeypatch.setattr(L, "STRETCH", stretch)
    samples = {lang: sentence(lang, 80, 1) for lang in LANGS}
    parser = L.CrossParser(samples)
    plain = {lang: parser._spaced(t) for lang, t in samples.items()}
    texts = ["", "Ω", "Ωthe", "the house the", sentence("en", 80, 1) * 3, "日本 12 the"]
    texts += [sentence(random.Random(seed).choice(list(LANGS)), 40 * (1 + seed % 5), seed + 100) + " xyz 12 Ω" for seed in range(12)]
    spaced = [parser._spaced(t) for t in texts]
    got = parser.phrases([parser.codes(t) for t in spaced])
    assert got.tolist() == [[brute_phrases(plain[lang], t) for lang in parser.langs] for t in spaced]


@pytest.mark.parametrize("stretch", [4, 7, 64])
def test_periodic_texts_have_the_phrases_of_the_whole(stretch, monkeypatch):
    """Where a text repeats itself, no two parses may ever share a place; then it is walked from the left."""
    monkeypatch.setattr(L, "STRETCH", stretch)
    samples = {"en": "aaa abab the theth banana", "de": "aaaaa babab c"}
    parser = L.CrossParser(samples)
    texts = [unit * (300 // len(unit)) for unit in ("a", "ab", "aab", "abac", "the ", "thethe a", "Ωa")] + ["x" + "a" * 200 + "b" + "ab" * 90, "a" * 100 + "Ω" + "a" * 100]
    spaced = [parser._spaced(t) for t in texts]
    assert parser.phrases([parser.codes(t) for t in spaced]).tolist() == [[brute_phrases(parser._spaced(samples[lang]), t) for lang in parser.langs] for t in spaced]


def test_time_of_a_periodic_text_grows_like_its_length():
    import time

    parser, took = L.CrossParser({"en": "aaa the house", "de": "das haus aaa"}), []
    for n in (100_000, 800_000):
        began = time.process_time()
        assert parser.phrases([parser.codes("a" * n)]).min() == -(-n // 3)
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0]


def brute_prediction(parser, plain, text):
    spaced = parser._spaced(text or "")
    if not spaced.strip():
        return "und"
    costs = [brute_phrases(plain[lang], spaced) * np.log2(max(2, len(plain[lang]))) for lang in parser.langs]
    return parser.langs[int(np.argmin(costs))]


def test_query_against_brute_force(spark):
    """Each document's language is that of the fewest bits, found by plain search in the whole texts."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    train = docs.where("pmod(crc32(CAST(doc_id AS STRING)), 5) <> 0")
    parser, samples = L.fit(train), {}
    assert parser.langs == sorted(r.lang for r in train.select("lang").distinct().collect() if r.lang)
    short = [r for r in train.where("text <> '' AND lang IS NOT NULL").selectExpr("lang", "text", "xxhash64(text) AS h", "pmod(xxhash64(xxhash64(text)), 1099511627776) AS u").distinct().collect()]
    for lang in parser.langs:
        own = sorted((r for r in short if r.lang == lang), key=lambda r: (len(r.text) > L.TRAIN_SHORT, r.u, r.h))[: L.TRAIN_DOCS]
        samples[lang] = parser._spaced(" ".join(r.text for r in sorted(own, key=lambda r: (r.h, r.text))))
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: r.lang_pred for r in L.op5_language_id(spark, SMALL).collect()}
    some = sorted((i for i in texts if len(texts[i] or "") < 3000))[:60]
    assert {i: found[i] for i in some} == {i: brute_prediction(parser, samples, texts[i]) for i in some}


def test_a_null_id_is_not_held_out(spark):
    rows = spark.createDataFrame([(None,), (7,)], "doc_id bigint").select(L.held_out("doc_id", 5, 0).alias("x")).collect()
    assert rows[0].x is False and rows[1].x is not None


def test_held_out_accuracy(spark):
    found = {r.doc_id: r for r in L.op5_language_id(spark, SMALL).collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held = [i for i, r in found.items() if r.held_out]
    assert len(found) == len(langs) and held
    assert sum(found[i].lang_pred == langs[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_edges(docs_of):
    parser = L.fit(docs_of(train_rows()))
    assert parser.langs == ["de", "en", "fr"]
    docs = docs_of([(1, None), (2, ""), (3, "12 +-"), (4, sentence("fr", 3000, 9)), (4, sentence("fr", 3000, 9)), (None, "the thing"), (6, "日本")])
    got = sorted(((repr(r.doc_id), r.lang_pred, r.score > 0) for r in L.predicted(docs, parser, carry=("lang", "key")).collect()))
    assert got[:5] == [("1", "und", False), ("2", "und", False), ("3", "und", False), ("4", "fr", True), ("4", "fr", True)]
    assert got[5][1] in parser.langs and got[6] == ("None", "en", True)
    assert L.predicted(docs_of([]), parser).count() == 0


def test_nothing_to_learn_from(docs_of):
    parser = L.fit(docs_of([(1, "some text", None), (2, None, "en")]))
    assert parser.langs == [] and {r.lang_pred for r in L.predicted(docs_of(["a", None]), parser).collect()} == {"und"}


def test_the_prediction_does_not_see_labels(docs_of):
    parser = L.fit(docs_of(train_rows()))
    texts = [sentence(lang, 30, 77) for lang in LANGS]
    a = [r.score for r in L.predicted(docs_of([(i, t, "en") for i, t in enumerate(texts)]), parser).orderBy("doc_id").collect()]
    b = [r.score for r in L.predicted(docs_of([(i, t, "de") for i, t in enumerate(texts)]), parser).orderBy("doc_id").collect()]
    assert a == b


def test_least_hashes_are_bounded_and_different(spark):
    rows = spark.range(20000).selectExpr("'a' AS g", "id % 5000 AS h", "false AS late").unionByName(spark.range(7).selectExpr("'b' AS g", "id AS h", "id > 3 AS late"))
    got = L.least_hashes(rows, "g", 100).collect()
    assert len({r.h for r in got if r.g == "a"}) == 100 and sorted(r.h for r in got if r.g == "b") == list(range(7))
    assert sorted(r.h for r in L.least_hashes(rows, "g", 4).collect() if r.g == "b") == [0, 1, 2, 3]
