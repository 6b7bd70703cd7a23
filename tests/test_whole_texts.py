"""Searches look at whole texts: against SQL over the driver tables themselves, which shares no view with the queries."""

import pytest

from shoebox import plans
from shoebox.operators import search
from tests.conftest import SMALL


@pytest.mark.parametrize(
    ("name", "found"),
    [
        ("phrase_search", "contains(lower(d.text), 'er th')"),
        ("metadata_search", "active AND (contains('img_' || doc_id, '19') OR contains(d.lang, '19') OR contains(d.text, '19'))"),
        ("favorite_search", "active AND (quality = 1 OR contains(lower(d.text), 'starred'))"),
    ],
)
def test_whole_texts_are_searched(spark, duck, name, found):
    rows = "SELECT d.source, CAST(d.doc_id AS VARCHAR) FROM (SELECT d.*, l.quality, coalesce(l.toxic, 0) <> 1 AND d.doc_id % 29 > 0 AND d.doc_id % 31 > 0 AS active FROM documents d LEFT JOIN labels l USING (doc_id)) d"
    got = sorted((r.source_key, r.upstream_asset_id) for r in plans.QUERIES[name](spark, SMALL).collect())
    assert got == sorted(duck.execute(f"{rows} WHERE {found}").fetchall())


def test_a_phrase_past_the_first_letters_is_found(spark, tmp_path):
    spark.createDataFrame([(1, "x " * 500 + "deeper thought", "en", "s", 1014)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [r.upstream_asset_id for r in plans.QUERIES["phrase_search"](spark, str(tmp_path)).collect()] == ["1"]


def test_favorites_that_match_come_once_and_texts_are_not_shuffled(spark):
    rows = [(1, "starred", True), (2, "none", True), (3, "Starred too", False), (4, "none", False)]
    table = spark.createDataFrame([(i, "f", "", d, s, "active") for i, d, s in rows], "id int, filename string, place_label string, description string, is_favorite boolean, visibility_status string")
    assert sorted(r.id for r in search.by_metadata(table, "Starred").collect()) == [1, 2, 3]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plans.QUERIES["favorite_search"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sides = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(sides) == 4 and all("text" not in below for above, below in zip(plan.splitlines(), plan.splitlines()[1:]) if "Exchange hashpartitioning" in above)
