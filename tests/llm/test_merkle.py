"""Merkle manifests against a tree that plain code builds level by level."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from shoebox.llm import common, merkle
from tests.conftest import SMALL, same_rows


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(digests):
    """(root, proofs): each proof a list of (left, right)."""
    proofs, at, own = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(own) > 1:
        for i, k in enumerate(at):
            run = own[k // 3 * 3 : k // 3 * 3 + 3]
            proofs[i].append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
        own, at = [digest("".join(own[k : k + 3])) for k in range(0, len(own), 3)], [k // 3 for k in at]
    return own[0], proofs


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r, t: digest("".join(map(field, (*r[:4], t))))
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([leaf(r, r[4]) for r in sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))]) for s in names}
    root, upper = tree([subs[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for r, proof in zip(sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))), subs[s][1], strict=True):
            cut = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf(r, r[4].replace("\n", "") if cut else r[4])
            for left, right in proof + upper[k]:
                node = digest(left + node + right)
            out.append((r[0], leaf(r, r[4]), subs[s][0], root, digest("".join(a + b for a, b in proof + upper[k])), node, node == root))
    return sorted(out, key=repr)


def of(df):
    even = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    return lambda **more: sorted(
        (
            (r.doc_id, r.leaf, r.subroot, r.root, r.p, r.f, r.f == r.root)
            for r in merkle.manifest(df, text=F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text")), **more)
            .select("*", merkle.proof_digest(F.col("lefts"), F.col("rights")).alias("p"), merkle.folded(F.col("altered_leaf"), F.col("lefts"), F.col("rights")).alias("f"))
            .collect()
        ),
        key=repr,
    )


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"
ODD = [(None, None, None, None, None), (1, "", "en", 0, ""), (2, None, "en", 3, "a\nb"), (3, "é", None, 1, "é\n"), (3, "é", None, 1, "é\n"), (3, "é", None, 2, "x"), (4, "z", "de", None, "\n\n"), (-5, "z", "-", -1, None), (6, "1:a", "x", 9, "y" * 70000 + "\n"), (10, "Z", "en", 1, "long\n" * 3)]


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_odd_rows_and_any_superblock(spark, levels):
    rows = ODD + [(100 + i, "hot", "en", i, f"t\n{i}") for i in range(100)] + [(1000, f"s{i}", "en", i, f"u\n{i}") for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 AS tree", "2 AS i", "'x' AS leaf", "3 AS block", "'y' AS id", "0 AS copy")
    assert of(df)(levels=levels) == brute(rows)


@pytest.mark.parametrize("n", [1, 3, 4, 28, 730])
def test_one_source(spark, n):
    rows = [(i, "s", "en", i, f"text\n{i}") for i in range(n)]
    assert of(spark.createDataFrame(rows, SCHEMA).repartition(3))() == brute(rows)


def test_empty_table(spark):
    found = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert found.collect() == [] and found.columns == ["doc_id", "source", "leaf", "altered_leaf", "lefts", "rights", "subroot", "root"]


def test_untouched_copy_verifies_and_any_change_shows(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "en", 1, f"t{i}") for i in range(40)], SCHEMA)
    change = lambda c: [r.ok for r in merkle.manifest(df, **c).select((merkle.folded(F.col("altered_leaf"), F.col("lefts"), F.col("rights")) == F.col("root")).alias("ok")).collect()]
    assert all(change({})) and not any(change({"text": F.concat("text", F.lit(" "))})) and not any(change({"lang": F.lit(None).cast("string")}))


def test_query(spark, duck):
    found = merkle.op11_merkle_manifest(spark, SMALL)
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in common.table(spark, SMALL, "documents").collect()]
    assert sorted(map(tuple, found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr) == brute(rows)
    assert same_rows(found.toPandas(), duck.execute(merkle.ORACLE).df())
