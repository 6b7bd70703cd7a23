"""Token counts, and BPE encoding and decoding, against the tokenizers library itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from shoebox.llm import bpe, tokencount
from tests.conftest import SMALL

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\n \t", "Hello, World's we'LL  don't\u00a0x", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext|", "é e\u0301 ΑΣ ΑΣΑ ß İ ǅ \ufb01", "日本語のテキスト 한국어 العربية", "😀👩‍👩‍👧 \u200b\u2028 x\x1cy\x1fz\x85w", "123 4567 ٣٤ ½ Ⅷ",
    "\x00\x01\x7f", "\ud7ff\ue000\U0010ffff", "x" * 500, "ab" * 400, "é" * 300, "   " * 200 + "x", "!?" * 300, "'s 'S 'll' 're", "a\r\nb\rc", "_under_score_ #tag @user", "\u0300\u0301abc", "ﷺ ﷽",
]
ALPHABET = st.text(alphabet=st.one_of(st.sampled_from("aAbs'  \n\t.!<|>endoftxt1é\u0301Σß\u00a0\x1c日😀"), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module")
def tools():
    return bpe.ByteBPE(BYTES), tokencount.WordCounter(WORDS, tokencount.whole_tokens(WORDS)), Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


def agree(tools, text):
    own, counter, lib, words = tools
    ids = lib.encode(text, add_special_tokens=False).ids
    packed = own.encode(text)
    assert bpe.ids_array(packed).tolist() == ids
    assert own.decode(packed) == lib.decode(ids, skip_special_tokens=False)
    assert counter.count(text) == len(words.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", [t for t in ODD if t is not None])
def test_odd_texts(tools, text):
    agree(tools, text)


@given(ALPHABET)
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    agree(_tools(), text)


_CACHE = []


def _tools():
    if not _CACHE:
        _CACHE.append((bpe.ByteBPE(BYTES), tokencount.WordCounter(WORDS, tokencount.whole_tokens(WORDS)), Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)))
    return _CACHE[0]


def test_tree_concatenation(tools):
    """Long unsplit text by halves is the same as at once."""
    own = tools[0]
    rng = random.Random(5)
    for _ in range(60):
        data = "".join(rng.choices("abcdeinorstth", k=rng.randint(90, 2500))).encode()
        assert own.tree(data) == own.merged(data)
    for _ in range(200):
        data = "".join(rng.choices("theinanrs", k=rng.randint(2, 60))).encode()
        cut = rng.randint(0, len(data))
        assert own.joined(own.merged(data[:cut]), own.merged(data[cut:])) == own.merged(data)


def brute(texts):
    """What op7 returns for texts, by the library alone."""
    tok, out = Tokenizer.from_file(BYTES), []
    for t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        out.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return out


def test_queries_against_the_library(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want = dict(zip(texts, brute(texts.values()), strict=True))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op7_bpe_encode_decode(spark, SMALL).collect()} == want
    lib = Tokenizer.from_file(WORDS)
    for r in tokencount.op3_token_counts(spark, SMALL).collect():
        t = texts[r.doc_id] or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 2048)


def test_long_texts_go_through_parts(docs_of):
    rng = random.Random(3)
    words = [" ".join(rng.choices(["the", "cat", "sat", "42", "é", "\n", "<|endoftext|>"], k=900)), "x" * 700, "ab" * 200 + " " + "yz" * 333, *[t or "" for t in ODD], "a" * 65]
    found = {r.doc_id: r for r in bpe.encoded(docs_of(words), BYTES, long_chars=64).collect()}
    small = bpe.PART_CHARS
    bpe.PART_CHARS = 50  # the workers see their own; what is tested here is the driver's cut
    try:
        parts = [p for row, _ in bpe._parts(bpe.loaded(BYTES), words[0]) for p in row]
        assert "".join(parts) == words[0]
    finally:
        bpe.PART_CHARS = small
    for i, want in enumerate(brute(words)):
        assert (len(found[i].ids) // 4, hashlib.sha256(found[i].ids).hexdigest(), hashlib.sha256(found[i].decoded.encode()).hexdigest()) == want


def test_glue_of_a_cut_pre_token():
    import pandas as pd

    own = bpe.loaded(BYTES)
    text = "x" * 3 + " " + "theanin" * 40 + " end"
    pieces = list(own.pieces(text))
    rows, glued = [], []
    for p in pieces:
        cuts = [p[i : i + 33] for i in range(0, len(p), 33)]
        for k, c in enumerate(cuts):
            rows.append([c])
            glued.append(k > 0)
    packed = [[own.packed(p) for p in r] for r in rows]
    frame = pd.DataFrame({"doc_id": 1, "row": 0, "part": range(len(rows)), "glued": glued, "head": [f[0] for f in packed], "body": [b"".join(f[1:-1]) for f in packed], "tail": [f[-1] if len(f) > 1 else b"" for f in packed]})
    out = bpe._glue(BYTES, "doc_id")(frame.sample(frac=1, random_state=1))
    assert np.frombuffer(out.ids[0], "<u4").tolist() == Tokenizer.from_file(BYTES).encode(text).ids and out.decoded[0] == text


def test_edges(docs_of):
    docs = docs_of([(1, None), (1, None), (None, ""), (2, "a b"), (2, "a b")])
    assert sorted((repr(r.doc_id), len(r.ids), r.decoded) for r in bpe.encoded(docs, BYTES).collect()) == [("1", 0, ""), ("1", 0, ""), ("2", 8, "a b"), ("2", 8, "a b"), ("None", 0, "")]
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens) for r in tokencount.token_counts(docs, WORDS).collect()) == [("1", 0, 0), ("1", 0, 0), ("2", 3, 2), ("2", 3, 2), ("None", 0, 0)]
    assert bpe.encoded(docs_of([]), BYTES).count() == 0 and tokencount.token_counts(docs_of([]), WORDS).count() == 0


def test_proven_set():
    proven = tokencount.whole_tokens(WORDS)
    lib = Tokenizer.from_file(WORDS)
    some = random.Random(1).sample(sorted(w for w in proven if w.isalpha() and w == w.lower()), 500)
    assert len(proven) > 20_000 and all(len(lib.encode(w, add_special_tokens=False).ids) == 1 for w in some)
