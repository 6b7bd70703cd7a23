from datetime import datetime

import pytest

from shoebox.request import InvalidRequest, SearchRequest, UnsupportedRequest, next_page, next_source, page_boundary, resolve, round_quotas


def test_defaults():
    r = resolve(SearchRequest(page=2))
    assert (r.kind, r.page_size, r.offset, r.sort_by, r.media_types) == ("timeline", 60, 120, "captured_at", ())
    assert resolve(SearchRequest(page_size=500)).page_size == 200


def test_media_types_and_times():
    r = resolve(SearchRequest(media_types=(" VIDEO", "image", "image"), captured_from="2024-01-01T00:00:00Z", captured_to="2024-01-02T00:00:00.5Z"))
    assert r.media_types == ("image", "video")
    assert (r.captured_from, r.captured_to) == (datetime(2024, 1, 1), datetime(2024, 1, 2, 0, 0, 0, 500000))


@pytest.mark.parametrize(
    "bad",
    [SearchRequest(text="x"), SearchRequest(kind="search"), SearchRequest(page=-1), SearchRequest(page=2**30, page_size=100), SearchRequest(media_types=("audio",)), SearchRequest(captured_from="2024-01-01T00:00:00"), SearchRequest(captured_from="soonZ"), SearchRequest(captured_from="2024-01-02T00:00:00Z", captured_to="2024-01-02T00:00:00Z")],
)
def test_invalid(bad):
    with pytest.raises(InvalidRequest):
        resolve(bad)


@pytest.mark.parametrize("bad", [SearchRequest(kind="map"), SearchRequest(mode="magic"), SearchRequest(sort_by="name"), SearchRequest(descending=False), SearchRequest(sort_by="relevance")])
def test_unsupported(bad):
    with pytest.raises(UnsupportedRequest):
        resolve(bad)


def test_modes():
    search = SearchRequest(kind="search", text="sea")
    assert resolve(search).mode == "semantic" and resolve(search).sort_by == "relevance"
    assert resolve(search, has_index=False).mode == "filename"
    assert resolve(SearchRequest(kind="search", text="se"), has_index=False).mode == "semantic"


def test_collection_key_ignores_the_page():
    a = SearchRequest(page_size=10)
    key = resolve(a).collection_key
    assert key.startswith("search_v1:") and key == resolve(next_page(a)).collection_key
    assert key != resolve(SearchRequest(page_size=10, media_types=("image",))).collection_key


def test_rounds_and_boundaries():
    assert round_quotas(100, 3) == [34, 33, 33] and round_quotas(0, 3) == []
    assert next_source(["a", "b", "c"], 0) == "b" and next_source(["a", "b", "c"], 2) == "b" and next_source(["a"], 0) == "a" and next_source([], 0) == ""
    assert [page_boundary(*x) for x in ((1, 0, False), (0, 0, False), (0, 5, True))] == ["pastEnd", "end", "more"]


def test_collection_keys_as_columns(spark):
    from pyspark.sql import functions as F

    from shoebox.functions.scalars import collection_key

    for r in (SearchRequest(), SearchRequest(kind="search", text="Größe"), SearchRequest(media_types=("video",), captured_from="2024-01-01T00:00:00Z")):
        key = resolve(r).collection_key
        assert spark.range(1).select(collection_key(F.lit(resolve(r).canonical_json)).alias("k")).first().k == key
        assert resolve(next_page(r)).collection_key == key
