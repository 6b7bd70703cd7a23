"""A remote library's search as a source of Spark: format("library_pages"), for batches and for streams.

A task pages one scope of visibility. Each request asks for page one of a range of capture times that shrinks: its upper bound is the
oldest time of the page before, to the whole millisecond, so rows that leave the range meanwhile shift nothing; what
pages share at their edges is dropped. If a page does not get below its bound, larger pages are asked for, and a
millisecond with more rows than the largest page is an error, never a gap.

As a stream the offset is the library's own time. A batch has what changed from the last offset on, that instant
included, up to the time of the request, in all scopes, so that rows that left one are seen in another. It moves only
when Spark's checkpoint does; a library whose clock went back is refused.

Options: url (POST, search), clock (GET, {"time": ...}), token (sent as x-api-key), scopes, size, after, before.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from shoebox.streaming.window_sync import window

SCOPES = ("timeline", "hidden", "archive")
PAGE, LARGEST_PAGE = 200, 1000
SCHEMA = "scope string, value string"


def as_time(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(timezone.utc)


def as_text(time: datetime) -> str:
    return time.astimezone(timezone.utc).isoformat().replace("+00:00", "Z")


def pages(ask: Callable[[dict], dict], scope: str, after: str | None, before: str | None, size: int = PAGE) -> Iterator[list[dict]]:
    """The records of each page that were not on the one before; ask() answers a request with {"items", "nextPage"}."""
    bound, seen = None, {}
    while True:
        request = {"page": 1, "size": size, "order": "desc", "visibility": scope}
        if after:
            request |= {"updatedAfter": after, "withDeleted": True}
        if before:
            request["updatedBefore"] = before
        if bound:
            request["takenBefore"] = as_text(bound)
        answer = ask(request)
        items, more = answer["items"], answer.get("nextPage") is not None
        if more and not items:
            raise ValueError("a page that is not the last has no rows")
        if more and any(not r.get("fileCreatedAt") for r in items):
            raise ValueError("rows without a capture time can't be paged")
        yield [r for r in items if seen.get(r["id"]) != r.get("updatedAt")]
        if not more:
            return
        oldest = min(as_time(r["fileCreatedAt"]) for r in items)
        next_bound = oldest.replace(microsecond=oldest.microsecond // 1000 * 1000) + timedelta(milliseconds=1)
        # only rows of the last millisecond can come again
        seen = (seen if next_bound == bound else {}) | {r["id"]: r.get("updatedAt") for r in items if as_time(r["fileCreatedAt"]) < next_bound}
        if bound is not None and next_bound >= bound:
            if size >= LARGEST_PAGE:
                raise ValueError(f"more than {LARGEST_PAGE} rows have one capture time; the rest can't be reached")
            size = LARGEST_PAGE
        else:
            bound = next_bound


class Scope(InputPartition):
    def __init__(self, scope: str, after: str | None, before: str | None):
        self.scope, self.after, self.before = scope, after, before


class _Reader:
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}

    def scopes(self) -> list[str]:
        return [s.strip() for s in self.options.get("scopes", ",".join(SCOPES)).split(",")]

    def ask(self, body: dict | None, url: str) -> dict:
        headers = {"Content-Type": "application/json"} | ({"x-api-key": t} if (t := self.options.get("token")) else {})
        request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=float(self.options.get("timeout", "60"))) as response:
            return json.load(response)

    def now(self) -> str:
        return self.ask(None, self.options["clock"])["time"]

    def read(self, part: Scope) -> Iterator[tuple[str, str]]:
        ask = lambda body: self.ask(body, self.options["url"])["assets"]
        for page in pages(ask, part.scope, part.after, part.before, int(self.options.get("size", PAGE))):
            for r in page:
                if str(r.get("id", "")).strip():
                    yield part.scope, json.dumps(r, sort_keys=True)


class PageReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Scope]:
        return [Scope(s, self.options.get("after"), self.options.get("before")) for s in self.scopes()]


class WindowReader(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"through": self.options.get("after")}

    def latestOffset(self) -> dict:
        return {"through": self.now()}

    def partitions(self, start: dict, end: dict) -> list[Scope]:
        past, upto = as_time(start["through"]) if start["through"] else None, as_time(end["through"])
        if past is not None and upto < past:
            # Spark has noted this offset and asks again. Once the clock is right the batch is empty, and the next begins at
            # the earlier time: it reads some rows again, which a merge does not mind
            window(past, as_time(self.now()))
            return []
        return [Scope(s, start["through"], end["through"]) for s in self.scopes()]


class LibraryPages(DataSource):
    """spark.dataSource.register(LibraryPages); rows are (scope, value), a record's JSON for records.decoded()."""

    @classmethod
    def name(cls) -> str:
        return "library_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> WindowReader:
        return WindowReader(self.options)
