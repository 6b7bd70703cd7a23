"""The pipeline against brute-force versions of its stages."""

import hashlib
import os

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from shoebox.llm import common
from tests.conftest import SMALL
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_nearcopies import brute as brute_classes


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = common.table(spark, SMALL, "documents"), []
    for name, stage in C.STAGES:
        before, docs = docs, common.written(stage(spark, docs, SMALL), name)
        out.append((before, docs))
    return out


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_columns(stages):
    assert all(tuple(after.columns) == C.COLUMNS for _, after in stages[:-1]) and [n for n, _ in C.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "bpe_encoding"]


def test_language_keeps_what_has_letters(stages):
    before, after = stages[0]
    assert texts(after) == [(i, t) for i, t in texts(before) if t and any(c.isalpha() for c in t)]
    given = {r.doc_id: r.lang for r in before.collect()}
    got = after.collect()
    assert sum(given[r.doc_id] == r.lang for r in got) >= 0.97 * len(got)


def test_lines(stages):
    before, after = stages[1]
    assert texts(after) == [(i, t) for i, t, _, _ in brute_lines(texts(before), 10, first=True)]
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_duplicates(stages):
    before, after = stages[2]
    rows = texts(before)
    found = brute_classes(rows)
    assert texts(after) == [(i, t) for i, t in rows if found[i] == i]


def test_contamination(spark, stages):
    before, after = stages[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hits = brute_hits(texts(before), items)
    assert texts(after) == [(i, t) for i, t in texts(before) if hits[i][1] == 0]


def test_encoding(stages):
    before, after = stages[4]
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in texts(before)}
    got = after.collect()
    assert {r.doc_id: [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)] for r in got} == want
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts(before)}


def test_run_is_the_last_stage(spark, stages):
    top = common.shared_dir(spark, "x").rsplit("/", 1)[0]
    os.makedirs(top, exist_ok=True)
    before = set(os.listdir(top))
    C.run(spark, SMALL).collect()
    assert ["-".join(n.split("-")[:2]) for n in set(os.listdir(top)) - before] == ["pipeline-decontamination"]
    assert sorted(map(tuple, C.run(spark, SMALL).collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_odd_documents(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "words of a text that is fine " * 3), (3, "words of a text that is fine " * 3), (None, "a text without an id stays here"), (5, "12 34")]).select(*C.COLUMNS)
    for _, stage in C.STAGES[:3]:
        docs = common.written(stage(spark, docs, SMALL), "odd")
    assert sorted(repr(r.doc_id) for r in docs.collect()) == ["3", "None"]
    empty = docs.limit(0)
    for _, stage in C.STAGES:
        empty = common.written(stage(spark, empty, SMALL), "empty")
    assert empty.count() == 0
