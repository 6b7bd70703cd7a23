"""Vector codes against plain code over all entries, in Python's whole numbers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from shoebox.llm import vectorcodes as V
from tests.conftest import SMALL, same_rows


def brute(rows, rounds=6):
    """rows: (vec_id, vector, label), ids different. Returns (code, error) by id and the codebooks' digest."""
    good = sorted((i, [math.floor(4096 * Fraction(x)) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    part = lambda v, p: v[p * len(v) // 8 : (p + 1) * len(v) // 8]
    books = [[part(v, p) for _, v in good[:16]] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(8):
            own = {}
            for _, v in good:
                own.setdefault(near(part(v, p), books[p])[1], []).append(part(v, p))
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    codes = {i: [near(part(v, p), books[p]) for p in range(8)] for i, v in good}
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: ("".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c)) for i, c in codes.items()}, digest


SCHEMA = "vec_id bigint, embedding array<float>, label int"


def of(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(3).selectExpr("*", "'x' AS code", "1 AS part", "2 AS error", "3 AS n")
    books = V.train(df)
    found = V.encoded(df, books).collect()
    return {r.vec_id: (r.code, r.error) for r in found}, books.digest()


def singles(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]


def test_ties_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 16).astype(float).tolist(), i % 3) for i in range(300)]  # many equal distances and equal entries
    rows += [(1000, None, 1), (1001, [None] + [0.0] * 15, 1), (1002, [math.nan] * 16, 1), (1003, [math.inf] + [0.0] * 15, None), (1004, [-math.inf] * 16, 2)]
    assert of(spark, rows) == brute(rows)


def test_negative_and_huge_components(spark):
    rng = np.random.default_rng(2)
    rows = singles([(i, (rng.normal(size=8) * 10.0 ** rng.integers(-6, 38)).tolist(), None) for i in range(120)] + [(500, [-3.4e38, 3.4e38] * 4, 1)])
    codes, digest = of(spark, rows)
    want, want_digest = brute(rows)
    assert digest == want_digest and codes == {i: (c, e if e < 1 << 63 else None) for i, (c, e) in want.items()}


def test_doubles_and_few_rows(spark):
    rows = [(7, [1e300] * 8, 1), (3, [-1e300] * 8, 1), (5, [0.1] * 8, 2)]
    codes, digest = of(spark, rows, SCHEMA.replace("float", "double"))
    want, want_digest = brute(rows)
    assert digest == want_digest and codes == {i: (c, e if e < 1 << 63 else None) for i, (c, e) in want.items()}


@pytest.mark.parametrize("size", [0, 3, 13])
def test_lengths_that_parts_do_not_divide(spark, size):
    rows = [(i, [float(i % 5)] * size, 1) for i in range(40)] + [(99, [1.0] * (size + 1), 1)]
    codes, _ = of(spark, rows)
    assert sorted(codes) == list(range(40)) and all(len(c) == 16 and e == 0 for c, e in codes.values())


def test_repeated_and_null_ids_and_no_rows(spark):
    codes = V.encoded(df := spark.createDataFrame([(None, [1.0] * 8, None)] * 3 + [(1, [2.0] * 8, None)] * 2, SCHEMA), V.train(df))
    assert sorted((r.vec_id or 0, r.error, r.label_error) for r in V.with_label_error(codes).collect()) == [(0, 0, 0)] * 3 + [(1, 0, 0)] * 2
    assert V.train(df.where("false")) is None and V.train(spark.createDataFrame([(1, None, 1)], SCHEMA)) is None


def test_many_labels_by_a_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i)] * 8, None if i % 4 == 0 else i % 4) for i in range(100)], SCHEMA)
    codes = V.encoded(df, V.train(df))
    few = sorted(map(tuple, V.with_label_error(codes).select("vec_id", "label_error").collect()))
    monkeypatch.setattr(V, "MOST_LABELS", 2)
    assert few == sorted(map(tuple, V.with_label_error(codes).select("vec_id", "label_error").collect())) and len({e for _, e in few}) == 4


def test_search_is_exact_with_lower_ties():
    rng = np.random.default_rng(3)
    for k in (1, 2, 7, 16):
        entries, x = rng.integers(-4, 5, (k, 5)), rng.integers(-6, 7, (500, 5))
        at, far = V.KdTree(entries).nearest(x)
        d = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        assert (at == d.argmin(1)).all() and (far == d.min(1)).all()


def test_query(spark, duck, tmp_path):
    assert same_rows(V.op13_vector_codes(spark, SMALL).toPandas(), duck.execute(V.ORACLE).df())
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    none = V.op13_vector_codes(spark, str(tmp_path))
    assert none.collect() == [] and dict(none.dtypes) == {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}
