"""Exact values, edge cases and plans of the catalog's operators."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.functions import scalars as S, vectors as V
from shoebox.operators import canonical, locations, merge, queues, search, timeline, uploads
from shoebox.request import SearchRequest, resolve
from shoebox.sources import files, records, snapshots
from shoebox.streaming import window_sync


def values(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def assets(spark):
    """6,001 assets, one a second, newest first by number."""
    start = datetime(2026, 1, 1)
    return spark.createDataFrame([(f"asset-{i:06d}", start - timedelta(seconds=i), "image") for i in range(6001)], "canonical_asset_id string, captured_at timestamp_ntz, media_type string")


def test_deep_page(assets):
    page = timeline.look_ahead(assets, resolve(SearchRequest(page=500, page_size=10))).orderBy("canonical_asset_id").collect()
    assert [r.canonical_asset_id for r in page] == [f"asset-{i:06d}" for i in range(5000, 5010)]
    assert {(r.total, r.total_kind, r.has_more) for r in page} == {(5011, "lowerBound", True)}


def test_pages_agree(assets):
    days = timeline.day_index(assets)
    positions = timeline.with_positions(assets)
    assert timeline.page_by_day(assets, days, 7000, 20).count() == 0
    for offset in (0, 17, 5990):
        want = [r.canonical_asset_id for r in assets.orderBy(*timeline.newest_first()).offset(offset).limit(20).collect()]
        assert sorted(r.canonical_asset_id for r in timeline.page_by_day(assets, days, offset, 20).collect()) == sorted(want)
        assert [r.canonical_asset_id for r in timeline.seek(positions, offset, 20).orderBy("global_position").collect()] == want


def test_ties_in_one_second(spark):
    rows = spark.createDataFrame([(f"a{i:03d}", datetime(2026, 1, 1), "image") for i in range(50)] + [("b", datetime(2026, 1, 2), "image")], "canonical_asset_id string, captured_at timestamp_ntz, media_type string")
    got = [r.canonical_asset_id for r in timeline.with_positions(rows).orderBy("global_position").collect()]
    assert got == ["b"] + [f"a{i:03d}" for i in range(50)]


def test_filters_reach_the_scan(spark, assets, tmp_path):
    assets.write.parquet(str(tmp_path / "a"))
    r = resolve(SearchRequest(media_types=("image",), captured_from="2025-12-31T00:00:00Z"))
    plan = timeline.page(spark.read.parquet(str(tmp_path / "a")), r)._jdf.queryExecution().toString()
    assert "PushedFilters: [Is" in plan and "GreaterThanOrEqual(" in plan and "TakeOrderedAndProject" in plan


def test_one_asset_of_each_content_is_one_window_free_aggregate(spark):
    row = dict(datasource_kind="local_filesystem", media_type="image", checksum_algorithm="sha1", content_sha1_hex="A" * 40, content_size_bytes=1234, canonical_sha1_hex=None, canonical_size_bytes=None, filename="f", duration=None, place_label="", description="", is_favorite=False, visibility_status="active", captured_at=datetime(2024, 1, 1), first_seen_at=datetime(2024, 1, 3), updated_at=datetime(2024, 1, 3))
    schema = "source_key string, upstream_asset_id string, datasource_kind string, media_type string, checksum_algorithm string, content_sha1_hex string, content_size_bytes bigint, canonical_sha1_hex string, canonical_size_bytes bigint, filename string, duration string, place_label string, description string, is_favorite boolean, visibility_status string, captured_at timestamp_ntz, first_seen_at timestamp_ntz, updated_at timestamp_ntz"
    names = [f.split()[0] for f in schema.split(", ")]
    remote = row | dict(source_key="r", upstream_asset_id="1", datasource_kind="remote_mirror", content_sha1_hex="a" * 40 + " ", duration="0:01", is_favorite=True, first_seen_at=datetime(2024, 1, 2))
    rows = [row | dict(source_key="l", upstream_asset_id="9"), remote, row | dict(source_key="r", upstream_asset_id="2", checksum_algorithm="sha1-path"), row | dict(source_key=None, upstream_asset_id=None, media_type=None, content_sha1_hex=None)]
    df = canonical.with_canonical_ids(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema))
    c = canonical.canonical_assets(df)
    got = {(r.primary_source_key, r.primary_upstream_asset_id, r.duration, r.source_count, r.duplicate_source_count, r.is_favorite, r.first_seen_at) for r in c.collect()}
    assert got == {("l", "9", "0:01", 2, 1, True, datetime(2024, 1, 2)), ("r", "2", None, 1, 0, False, datetime(2024, 1, 3)), (None, None, None, 1, 0, False, datetime(2024, 1, 3))}
    plan = c._jdf.queryExecution().toString()
    assert "Window" not in plan.split("== Physical Plan ==")[1]
    assert canonical.canonical_assets(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("rows", "order"),
    [
        ([("primary", 0.9, [1.0, 0.0]), ("near", 0.89, [0.98, 0.02]), ("other", 0.88, [0.0, 1.0]), ("also", 0.87, [0.7, 0.7])], ["primary", "other", "also", "near"]),
        ([("a", 0.9, [1.0, 0.0]), ("b", 0.89, [0.0, 1.0]), ("c", 0.88, [0.7, 0.7])], ["a", "b", "c"]),
    ],
)
def test_diversified(spark, rows, order):
    ranking = spark.createDataFrame([(i, n, v) for n, (i, _, v) in enumerate(rows)], "id string, rank int, vector array<float>")
    assert [r.id for r in search.diversified(ranking).orderBy("rank").collect()] == order


def test_only_the_first_rows_are_diversified(spark):
    ranking = spark.createDataFrame([(i, i, [1.0, 0.0]) for i in range(6)], "id int, rank int, vector array<float>")
    assert [r.id for r in search.diversified(ranking, first=3).orderBy("rank").collect()] == [0, 1, 2, 3, 4, 5]
    assert search.diversified(ranking.limit(0)).count() == 0


def test_scalars(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first().x
    assert pick(S.timestamp_text(F.lit("2026-07-18 04:02:31.184090").cast("timestamp_ntz"))) == "2026-07-18T04:02:31.184090000Z"
    assert pick(S.sha1_hex(F.lit("\t" + "AB" * 20 + "\n"))) == "ab" * 20 and pick(S.sha1_hex(F.lit("zz" * 20))) == "" and pick(S.sha1_hex(F.lit(None).cast("string"))) == ""
    assert pick(S.place_label(F.lit(" Rome"), F.lit(""), F.lit("ROME"), F.lit(None).cast("string"), F.lit("Italy"))) == "Rome, Italy"
    assert pick(S.duration_text(F.lit(3723004))) == "1:02:03.004000" and pick(S.duration_text(F.lit(3723004), 3)) == "1:02:03.004"
    assert [pick(S.retry_delay(F.lit(n))) for n in (0, 1, 2, 6, 7, 99)] == [30, 30, 60, 960, 1800, 1800]
    assert pick(S.greater(F.lit(1), F.lit(None).cast("int"))) is None
    assert [pick(S.clean_relative_path(F.lit(p))) for p in ("a/b", "/a", "a//b", "../a", "a/..", "", "a/./b", "..a/b")] == ["a/b", None, None, None, None, None, None, "..a/b"]


def test_clean_paths(spark):
    import posixpath

    paths = ["/a//b/./c/", "/", "//", "/..", "/../a/..", "a/../..", "../a", "./", "a/b/../../..", " /x ", "/a/b/../c", "..", "a..b/.c"]
    rows = spark.createDataFrame([(p,) for p in paths] + [("",), (" ",), (None,)], "p string").select("p", S.clean_path(F.col("p")).alias("c")).collect()
    want = {p: posixpath.normpath(p.strip()) for p in paths} | {"": "", " ": "", None: None}
    assert {r.p: r.c for r in rows} == {p: "/" if c == "//" else c for p, c in want.items()}


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0]), ([], [1.0]), ([0.0, 0.0], [0.0, 0.0])], "a array<float>, b array<float>")
    assert [r.x for r in rows.select(V.dot(F.col("a"), F.col("b")).alias("x")).collect()] == [14.0, 0.0, 0.0]
    assert [r.x for r in rows.select(V.dot_with(F.col("a"), [2.0, 1.0]).alias("x")).collect()] == [4.0, 0.0, 0.0]
    long = [0.5] * 300
    assert spark.createDataFrame([(long,)], "a array<float>").select(V.dot_with(F.col("a"), long).alias("x")).first().x == 75.0
    assert [r.x for r in rows.select(V.normalised(F.col("b")).alias("x")).collect()][1:] == [[1.0], [0.0, 0.0]]


def test_merge_handles_nulls_and_replays(spark):
    old = spark.createDataFrame([(1, "a", "active"), (2, None, "active"), (3, "c", "active")], "id int, name string, visibility_status string")
    batch = spark.createDataFrame([(2, "b", False, 1), (2, None, False, 2), (3, "c", True, 1), (4, "d", True, 1), (5, "e", False, 1)], "id int, name string, excluded boolean, seq int")
    once = merge.merged(old, batch, ["id"], ["name"])
    assert sorted(values(once.select("id", "name", "visibility_status", "change"))) == [(1, "a", "active", "same"), (2, None, "active", "same"), (3, "c", "out_of_scope", "excluded"), (5, "e", "active", "new")]
    again = merge.merged(once.drop("change"), batch, ["id"], ["name"])
    assert merge.equal_tables(once.drop("change"), again.drop("change")).isEmpty()
    assert {r.change for r in again.collect()} == {"same"}
    full = merge.replaced(old, batch.where("seq = 1").select("id", "name", F.lit("active").alias("visibility_status")), ["id"], ["name"])
    assert {(r.id, r.visibility_status, r.change) for r in full.collect()} == {(1, "missing", "hidden"), (2, "active", "changed"), (3, "active", "same"), (4, "active", "new"), (5, "active", "new")}


def test_excluded_rows_come_back_and_exclusions_take_times(spark):
    cols = "id int, name string, visibility_status string, t int"
    old = spark.createDataFrame([(1, "a", "out_of_scope", 5), (2, "b", "out_of_scope", 5), (3, "c", "out_of_scope", 5), (4, "d", "missing", None), (5, "e", "active", 5), (6, "f", "active", 5)], cols)
    batch = spark.createDataFrame([(1, "a", False, 5), (2, "b", True, 6), (3, "c", True, None), (4, "d", True, None), (5, "e", False, 5), (6, "f", False, None), (7, "g", True, 1)], "id int, name string, excluded boolean, t int").withColumn("seq", F.lit(1))
    found = merge.merged(old, batch, ["id"], ["name"], source_time="t")
    assert sorted((r.id, r.visibility_status, r.t, r.change) for r in found.collect()) == [(1, "active", 5, "changed"), (2, "out_of_scope", 6, "excluded"), (3, "out_of_scope", 5, "same"), (4, "out_of_scope", None, "excluded"), (5, "active", 5, "same"), (6, "active", None, "changed")]


def test_window_with_a_deadline_before_its_schedule_is_an_error(spark):
    from shoebox.operators import verification

    roots = spark.sql("SELECT 's' AS source_key, 'r' AS root_key, 'idle' AS window_state, CAST(NULL AS INT) AS scheduled_for, 0 AS started_at, 0 AS deadline, '' AS skip_reason, false AS reconciliation_pending, 1 AS processed, 1 AS verified, 1 AS changed, 1 AS failed, 1 AS read_bytes")
    assert verification.started(roots, F.lit(5), F.lit(6), F.lit(1)).first().window_state == "running"
    with pytest.raises(Exception, match="deadline must follow"):
        verification.started(roots, F.lit(5), F.lit(5), F.lit(1)).collect()


def test_absent_locations_under_blocked_directories(spark):
    stored = spark.createDataFrame([(1, "s", "r", "a/b/c.jpg", "active"), (2, "s", "r", "ab/c.jpg", "active"), (3, "s", "r", "x.jpg", "missing")], "id int, source_key string, root_key string, relative_path string, status string")
    blocked = spark.createDataFrame([("a",)], "directory string")
    assert [r.id for r in locations.absent_locations(stored.limit(0), stored, blocked).collect()] == [2]


def test_upload_offsets(spark):
    u = spark.createDataFrame([("a", 0, 10, "active"), ("b", 5, 10, "active"), ("c", 0, 10, "aborted")], "upload_id string, offset int, expected_size int, status string")
    w = spark.createDataFrame([("a", 0, 10), ("b", 4, 5), ("c", 0, 10)], "upload_id string, at int, n int")
    assert sorted(values(uploads.advanced(u, w))) == [("a", 10, "completed", True), ("b", 5, "active", False), ("c", 0, "aborted", False)]


def test_file_scan(spark, tmp_path):
    for p in ("a/one.JPG", "a/b/two.mp4", "a/note.txt", ".hidden/three.jpg", "x/@eaDir/four.jpg", "My.photoslibrary/five.jpg", "a/.six.jpg", "sp ace+x%.png"):
        (tmp_path / "root" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / p).write_bytes(b"12345")
    rows = files.scan(spark, str(tmp_path / "root"))
    assert sorted((r.relative_path, r.directory, r.size_bytes, r.media_type) for r in rows.collect()) == [("a/b/two.mp4", "a/b", 5, "video"), ("a/one.JPG", "a", 5, "image"), ("sp ace+x%.png", "", 5, "image")]
    reasons = {r.relative_path: r.skip_reason for r in files.listed(spark, str(tmp_path / "root")).collect() if r.skip_reason}
    assert reasons == {"a/note.txt": "unsupported_extension", "x/@eaDir/four.jpg": "system_directory", "My.photoslibrary/five.jpg": "package_directory"}
    assert "content" not in rows._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"version": 1,\n "assets": [{"id": "b"}, {"id": "a"}]}')
    assert [(r.position, r.id) for r in records.manifest(spark, str(tmp_path / "m.json")).collect()] == [(0, "b"), (1, "a")]
    (tmp_path / "n.json").write_text('{"version": 2, "assets": [{"id": "b"}]}')
    with pytest.raises(Exception, match="unknown manifest version"):
        records.manifest(spark, str(tmp_path / "n.json")).collect()


def test_decoding_of_broken_records(spark):
    lines = spark.createDataFrame([("no json",), (None,), ('{"id":7,"checksum":null,"fileCreatedAt":"2024-02-30"}',)], "value string")
    assert [(r.upstream_asset_id, r.content_sha1_hex, r.captured_at) for r in records.decoded(lines).collect()] == [(None, "", None), (None, "", None), ("7", "", None)]


def test_snapshots_refuse_a_race(spark, tmp_path):
    store = snapshots.Snapshots(spark, str(tmp_path / "s"))
    assert store.current() == 0
    assert store.publish({"t": spark.range(3)}) == 1
    with pytest.raises(RuntimeError):
        store.publish({"t": spark.range(9)}, expected=0)
    assert store.current() == 1 and store.read("t").count() == 3
    # two writers that both saw generation 1: the second finds its pointer taken
    late = snapshots.Snapshots(spark, store.root)
    late.current = lambda: 1
    assert store.publish({"t": spark.range(5)}, expected=1) == 2
    with pytest.raises(RuntimeError):
        late.publish({"t": spark.range(7)}, expected=1)
    assert store.current() == 2 and store.read("t").count() == 5 and store.read("t", 1).count() == 3


def test_a_sync_that_was_overtaken_raises(spark, tmp_path):
    """Another writer publishes between the read and the publish; its rows must not be lost."""
    store, schema = snapshots.Snapshots(spark, str(tmp_path / "s")), "id bigint, name string, visibility_status string"
    store.publish({"rows": spark.createDataFrame([(1, "a", "active")], schema)})
    spark.createDataFrame([(2, "b", 1, False)], "id bigint, name string, seq int, excluded boolean").write.json(str(tmp_path / "landed"))

    def overtaken(new, changed):
        store.publish({"rows": spark.createDataFrame([(9, "other", "active")], schema)})
        return {}

    with pytest.raises(Exception, match="was published"):
        window_sync.sync_once(spark, str(tmp_path / "landed"), "id bigint, name string, seq int, excluded boolean", store, "rows", ["id"], ["name"], str(tmp_path / "cursor"), more=overtaken)
    assert [r.name for r in store.read("rows").collect()] == ["other"]


def test_positions_of_ties_and_sparse_ids(spark):
    rows = spark.range(3000).selectExpr("xxhash64(id) AS id", "xxhash64(id) AS canonical_asset_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS captured_at")
    ids = sorted(r.id for r in rows.collect())
    for found, position in ((merge.generation_of(rows, 3), "ordinal"), (timeline.with_positions(rows), "global_position")):
        got = {r[position]: r.id for r in found.collect()}
        assert [got[i] for i in range(3000)] == ids
    assert merge.generation_of(rows.limit(0), 1).count() == 0


def test_days_are_ranges_of_times(spark, tmp_path):
    spark.sql("SELECT id AS canonical_asset_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(id % 9, id % 24) AS captured_at FROM range(500)").write.parquet(str(tmp_path / "g"))
    assets = spark.read.parquet(str(tmp_path / "g"))
    days = timeline.day_index(assets)
    page = timeline.page_by_day(assets, days, 120, 30)
    assert [r.canonical_asset_id for r in page.collect()] == [r.canonical_asset_id for r in assets.orderBy(*timeline.newest_first()).offset(120).limit(30).collect()]
    assert "GreaterThanOrEqual(captured_at" in page._jdf.queryExecution().executedPlan().toString()
    moment = datetime(2024, 1, 5, 7)
    assert timeline.rank_of_time(assets, days, moment).first().position == assets.where(F.col("captured_at") > F.lit(moment).cast("timestamp_ntz")).count()


def test_readiness_needs_every_condition(spark):
    """One asset for each condition that fails, beside one that meets all."""
    source = "canonical_asset_id string, source_key string, upstream_asset_id string, datasource_kind string, visibility_status string"
    names = ["all", "gone", "no thumbnail", "other content", "no path", "one kind", "failed", "unconfigured", "falls back", "wrong role"]
    rows = [(n, "x" if n == "unconfigured" else "f" if n in ("falls back",) else "r" if n == "wrong role" else "l", n, "local_filesystem", "active") for n in names]
    rows += [("falls back", "r", "m", "remote_mirror", "active"), ("no path", "r", "m2", "remote_mirror", "active"), ("remote", "r", "m3", "remote_mirror", "active"), ("blocked", "r", "m4", "remote_mirror", "missing")]
    canonical_rows = [(n, "active", "image", "f", datetime(2024, 1, 1), None) for n in [*names, "remote", "blocked"]]
    local = [(r[1], r[2], "new" if r[2] == "other content" else "sha", "missing" if r[2] == "gone" else "active", "pending" if r[2] == "no thumbnail" else "ready") for r in rows[: len(names)] if r[2] != "falls back"]
    made = [(r[1], r[2], k, "sha", "failed" if r[2] == "failed" and k == "preview" else "ready", " " if r[2] == "no path" and k == "preview" else "p") for r in rows[: len(names)] if r[2] != "falls back" for k in ("preview", "detail_preview") if not (r[2] == "one kind" and k == "preview")]
    found = timeline.ready_assets(
        spark.createDataFrame(canonical_rows, "canonical_asset_id string, visibility_status string, media_type string, filename string, captured_at timestamp_ntz, duration string"),
        spark.createDataFrame(rows, source),
        spark.createDataFrame(made, "source_key string, asset_id string, kind string, source_sha1_hex string, status string, relative_path string"),
        spark.createDataFrame(local, "source_key string, asset_id string, sha1_hex string, visibility_status string, thumbnail_status string"),
        spark.createDataFrame([("local", "l"), ("local", "f"), ("remote", "r"), ("local_fallback", "f")], "role string, source_key string"),
    )
    assert sorted((r.canonical_asset_id, r.source_key) for r in found.collect()) == [("all", "l"), ("falls back", "f"), ("remote", "r")]


def test_sync_without_changes_publishes_nothing(spark, tmp_path):
    store = snapshots.Snapshots(spark, str(tmp_path / "s"))
    store.publish({"rows": spark.createDataFrame([(1, "a", "active")], "id bigint, name string, visibility_status string")})
    landed = str(tmp_path / "landed")
    page = spark.createDataFrame([(1, "a", 1, False)], "id bigint, name string, seq int, excluded boolean")
    sync = lambda: window_sync.sync_once(spark, landed, "id bigint, name string, seq int, excluded boolean", store, "rows", ["id"], ["name"], str(tmp_path / "cursor"))
    page.write.mode("append").json(landed)
    assert sync() == 1
    page.withColumn("name", F.lit("b")).write.mode("append").json(landed)
    assert sync() == 2 and [r.name for r in store.read("rows").collect()] == ["b"]
    with pytest.raises(ValueError):
        window_sync.window(datetime(2024, 1, 2), datetime(2024, 1, 1))


def test_first_view_order_of_repeated_ids(spark):
    """Each row has a place of its own, though its id comes again; rows that are equal stay as often as they come."""
    day = datetime(2026, 1, 1)
    rows = [(i * 7919 % 23, day - timedelta(seconds=i // 2 % 40)) for i in range(200)]
    rows += [(5, day)] * 4
    rows = [(f"asset-{i:05d}", t) for i, t in rows]
    newest = sorted(rows, key=lambda r: (-r[1].timestamp(), r[0]))
    df = spark.createDataFrame(rows, "asset_id string, captured_at timestamp_ntz").repartition(3)
    for first in (0, 1, 3, 30, 300):
        want = newest[:first] + sorted(newest[first:], key=lambda r: (r[0][-8:], r[0]))
        for n in (2, 40, 500):
            assert [r.asset_id for r in queues.first_view_order(df, first, n).collect()] == [r[0] for r in want[:n]]


def test_a_capture_time_is_made_in_few_steps(spark, capsys):
    """Each part of the rule stands in the plan once, not once for each use of a use."""
    c = F.col
    times = spark.createDataFrame([("2024:05:06 07:08:09", "5", "+02:00", "exif_original"), (" 2024-05-06 07:08:09", None, None, "exif_original"), ("2024-05-06T07:08:09", "x", "Z", "exif_original"), ("1970-01-01T00:00:00", None, "Z", "container_creation_time"), (None, None, None, None)], "v string, s string, o string, k string")
    found = times.select(S.capture_time(F.concat(c("v"), F.lit("")), c("s"), c("o"), c("k"), F.lit("Europe/Paris")).alias("t"))
    assert [r.t for r in found.collect()] == [datetime(2024, 5, 6, 5, 8, 9, 500000), datetime(2024, 5, 6, 5, 8, 9), None, None, None]
    found.explain("extended")
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert plan.count("regexp_replace") + plan.count("RLIKE") <= 10


def test_hashes_of_paths_are_made_once_for_their_joins(spark, capsys):
    """No hash is normalised anew in a join's condition, and white space goes without a regular expression."""
    from shoebox.plans import QUERIES
    from tests.conftest import SMALL

    for name in ("external_identities", "reconciled_identities", "identity_fallback"):
        QUERIES[name](spark, SMALL).explain("extended")
        plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
        assert not [line for line in plan.splitlines() if "Join" in line and "RLIKE" in line]
        assert "regexp_replace(concat" not in plan
    texts = spark.createDataFrame([(" \t\x0b a b\n\f\r",), ("\xa0a ",), (" \n",), (None,)], "c string")
    assert [r[0] for r in texts.select(S.trimmed(F.col("c"))).collect()] == ["a b", "\xa0a", "", None]
