import hashlib
import random

from pyspark.sql import functions as F

from shoebox.llm import fingerprint as P
from tests.conftest import SMALL


def shingles(text, n=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


WORDS = [f"w{i}" for i in range(4000)]


def text(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def test_query_against_brute_force(spark):
    found = {r.doc_id: r for r in P.op1_document_fingerprints(spark, SMALL).collect()}
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    assert len(found) == len(docs)
    for (i, t), (_, following) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - jaccard(shingles(t), shingles(edited))) < 0.2
        assert abs(r.near_next - jaccard(shingles(t), shingles(following))) < 0.2
    same = {}
    for i, t in docs:
        assert same.setdefault(t, found[i].fingerprint) == found[i].fingerprint
    assert len(set(same.values())) == len(same)


def test_estimates(spark, docs_of):
    a, b = text(1, 3000), text(1, 3000)[: 15000 // 2] + " " + text(2, 1500)
    both = P.with_sketches(spark.createDataFrame([(a, b)], "a string, b string"), {"a": "x", "b": "y"})
    r = both.select(P.resemblance(F.col("x"), F.col("y")).alias("r"), P.containment(F.col("x"), F.col("y")).alias("c"), P.distinct_shingles(F.col("x")).alias("n")).first()
    sa, sb = shingles(a), shingles(b)
    assert abs(r.r - jaccard(sa, sb)) < 0.15 and abs(r.c - len(sa & sb) / len(sa)) < 0.2 and abs(r.n / len(sa) - 1) < 0.3


def test_parts_merge_into_the_whole(docs_of):
    docs = docs_of([text(3, 5000), text(4, 37), None, "", " \n", "one", "one two three four", "A b C d E", "a B c d e"])
    whole = {r.doc_id: r for r in P.sketched(docs).collect()}
    parts = {r.doc_id: r for r in P.sketched(docs, part_words=16).collect()}
    assert len(whole) == 9 and {i: r.sketch for i, r in whole.items()} == {i: r.sketch for i, r in parts.items()}
    assert [len(whole[i].sketch) for i in (2, 3, 4, 5, 6, 7)] == [0, 0, 0, 1, 1, 1] and whole[7].sketch == whole[8].sketch
    assert whole[2].n_shingles == 0 and whole[5].n_shingles == 1


def test_merging_sketches(spark):
    parts = P.with_sketches(spark.createDataFrame([(1, text(i, 400)) for i in range(5)] + [(2, "")], "k int, t string"), {"t": "sketch"})
    merged = {r.k: r.sketch for r in P.merged_sketches(parts, ["k"]).collect()}
    assert merged[1] == sorted({h for r in parts.where("k = 1").collect() for h in r.sketch})[: P.K] and merged[2] == []


def hashed(docs):
    return docs.select("doc_id", "text").withColumn("hash", F.xxhash64("text"))


def test_next_rows_with_ties_nulls_and_wide_gaps(docs_of):
    ids = [5, 5, None, -7, 10**12, 10**12 + 1, 3, 4, 6, 2, None, None]
    docs = hashed(docs_of([(i, f"t{n}") for n, i in enumerate(ids)]))
    hashes = {r.text: r.hash for r in docs.collect()}
    for size in (1, 2, 100):
        ranged = P.in_ranges(docs, "doc_id", "hash", range_rows=size)
        got = {r.text: r.n for r in ranged.select("text", "__end", P.next_in_range("text", "doc_id", "hash").alias("n")).where("__end = 0").collect()}
        order = [t for _, _, t in sorted((-(10**15) if i is None else i, hashes[f"t{n}"], f"t{n}") for n, i in enumerate(ids))]
        assert got == dict(zip(order, order[1:] + order[:1], strict=True))


def test_ranges_are_even_for_any_ids(spark):
    """Dense, clustered, hashed and null ids and ids that repeat: no range is far above its share."""
    for ids in ("id", "(id % 4) * 1125899906842624 + id", "xxhash64(id)", "CAST(NULL AS BIGINT)", "CAST(id % 3 AS BIGINT)", "CAST(id AS DOUBLE) / 7", "if(id % 2 = 0, NULL, id)"):
        rows = spark.range(20000).selectExpr(f"{ids} AS doc_id", "xxhash64(id, 7) AS hash")
        most = P.in_ranges(rows, "doc_id", "hash", 250).where("__end = 0").groupBy("__range").count().agg(F.max("count"), F.count("*")).first()
        assert most[0] <= 4 * 250 and most[1] >= 40, (ids, most)


def test_empty_table(docs_of):
    assert P.sketched(docs_of([])).count() == 0
    assert P.in_ranges(hashed(docs_of([])), "doc_id", "hash").count() == 0
    one = P.in_ranges(hashed(docs_of(["a"])), "doc_id", "hash")
    assert one.select("__end", P.next_in_range("text", "doc_id", "hash").alias("n")).where("__end = 0").first().n == "a"


def test_parts_of_a_row_merge_into_the_whole(spark):
    texts = [text(3, 500), text(3, 16), text(3, 17), text(3, 20), text(3, 21), "one", "", None, "a a a a a a a a a a a a a a a a a a a a a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    whole, parts = (P.with_sketches(rows, {"t": "s"}, part_words=p).orderBy("n").collect() for p in (P.PART_WORDS, 16))
    assert [r.s for r in whole] == [r.s for r in parts]


def test_no_python_in_the_plan(spark):
    plan = P.op1_document_fingerprints(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_estimates_containment_and_shingles(spark):
    """Against the shingles themselves: exact where the sketch holds them all, else within a few standard errors."""
    found = {r.doc_id: r for r in P.op1_document_fingerprints(spark, SMALL).collect()}
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    for k, (i, text) in enumerate(docs):
        half = len(text) // 2
        edited = text[: len(text) - half] + docs[(k + 1) % len(docs)][1][:half]
        own, other = shingles(text), shingles(edited)
        assert abs(found[i].contained_in_edited - len(own & other) / max(1, len(own))) <= 0.25
        assert found[i].n_shingles == len(own) if len(own) < P.K else abs(found[i].n_shingles / len(own) - 1) <= 0.45
