"""The pager against a library that answers like a real one, and the stream from its checkpoint."""

import json
import threading
from datetime import datetime, timedelta, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from shoebox.sources import pager as P
from shoebox.sources.records import decoded

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def record(i, taken_ms, updated_s=0, visibility="timeline"):
    return {"id": f"a{i}", "type": "IMAGE", "visibility": visibility, "fileCreatedAt": P.as_text(START + timedelta(milliseconds=taken_ms)), "updatedAt": P.as_text(START + timedelta(seconds=updated_s))}


class Library:
    """Rows of a visibility in the window, the newest first, a page of them."""

    def __init__(self, rows):
        self.rows, self.asked, self.time = {r["id"]: r for r in rows}, [], START + timedelta(days=1)

    def answer(self, q):
        self.asked.append(q)
        assert q["page"] == 1 and q["size"] <= 1000
        at = lambda k: P.as_time(q[k]) if k in q else None
        after, before, taken = at("updatedAfter"), at("updatedBefore"), at("takenBefore")
        fits = lambda r: r["visibility"] == q["visibility"] and (not after or P.as_time(r["updatedAt"]) >= after) and (not before or P.as_time(r["updatedAt"]) <= before) and (not taken or P.as_time(r["fileCreatedAt"]) < taken)
        rows = sorted(filter(fits, self.rows.values()), key=lambda r: (P.as_time(r["fileCreatedAt"]), r["id"]), reverse=True)
        return {"items": rows[: q["size"]], "nextPage": "2" if len(rows) > q["size"] else None}


def ids(library, size=7, after=None, before=None):
    return [r["id"] for page in P.pages(library.answer, "timeline", after, before, size) for r in page]


def test_every_row_comes_once():
    library = Library([record(i, i // 3) for i in range(100)])  # three rows a millisecond
    found = ids(library)
    assert sorted(found) == sorted(library.rows) and len(set(found)) == 100
    bounds = [q["takenBefore"] for q in library.asked if "takenBefore" in q]
    assert list(map(P.as_time, bounds)) == sorted(map(P.as_time, bounds), reverse=True) and len(set(bounds)) == len(bounds)


def test_rows_that_leave_meanwhile_shift_nothing():
    library, found = Library([record(i, i) for i in range(60)]), []
    for page in P.pages(library.answer, "timeline", None, None, 10):
        found += [r["id"] for r in page]
        if len(found) == 10:
            for i in range(55, 60):  # already read
                del library.rows[f"a{i}"]
    assert sorted(found) == sorted(f"a{i}" for i in range(60))


def test_a_crowded_time_takes_larger_pages_or_is_an_error():
    library = Library([record(i, 5) for i in range(40)] + [record(99, 1)])
    assert sorted(ids(library)) == sorted(library.rows) and [q["size"] for q in library.asked][-1] == 1000
    with pytest.raises(ValueError, match="one capture time"):
        ids(Library([record(i, 5) for i in range(1001)] + [record(9999, 1)]))
    with pytest.raises(ValueError, match="capture time"):
        list(P.pages(lambda q: {"items": [{"id": "x", "fileCreatedAt": None}], "nextPage": "2"}, "timeline", None, None))
    with pytest.raises(ValueError, match="no rows"):
        list(P.pages(lambda q: {"items": [], "nextPage": "2"}, "timeline", None, None))


@pytest.fixture()
def served():
    library = Library([record(i, i * 10, i, "archive" if i % 10 == 0 else "timeline") for i in range(50)])

    class Handler(BaseHTTPRequestHandler):
        def send(self, out):
            body = json.dumps(out).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self):
            self.send({"assets": library.answer(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))})

        def do_GET(self):
            self.send({"time": P.as_text(library.time)})

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield library, f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_batches_and_a_stream_with_a_restart(spark, served, tmp_path):
    library, url = served
    spark.dataSource.register(P.LibraryPages)
    batch = spark.read.format("library_pages").options(url=f"{url}/search", clock=f"{url}/time", size="8").load()
    assert sorted(r.upstream_asset_id for r in decoded(batch).collect()) == sorted(library.rows) and batch.groupBy("scope").count().count() == 2
    seen = []

    def sync():
        stream = spark.readStream.format("library_pages").options(url=f"{url}/search", clock=f"{url}/time", size="8").load()
        take = lambda df, _: seen.append(sorted((r.scope, r.id) for r in df.select("scope", F.get_json_object("value", "$.id").alias("id")).collect()))
        seen.clear()
        stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "cursor")).trigger(availableNow=True).start().awaitTermination()
        return [x for part in seen for x in part]

    assert len(sync()) == 50
    hour = (library.time - START).total_seconds()
    library.rows["a3"] = record(3, 30, hour, "hidden")  # at the very time of the cursor: it leaves the timeline
    library.rows["a60"] = record(60, 600, hour + 60)
    library.time += timedelta(hours=1)
    assert sync() == [("hidden", "a3"), ("timeline", "a60")]
    library.time -= timedelta(hours=3)
    with pytest.raises(Exception, match="clock went back"):
        sync()
    library.time += timedelta(hours=4)
    library.rows["a61"] = record(61, 610, hour + 3700)
    assert ("timeline", "a61") in sync() + sync()
    assert sync() == []
