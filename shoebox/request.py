"""Search requests: checked and normalised before any plan is built."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import asdict, dataclass, replace
from datetime import UTC, datetime

PAGE_SIZE, PAGE_SIZE_MOST = 60, 200
MEDIA_TYPES = ("image", "video")
MODES = ("auto", "filename", "semantic")
#: Characters from which text may be looked up by its parts.
LEAST_TEXT = 3


class InvalidRequest(ValueError):
    """The request can't be answered by anyone."""


class UnsupportedRequest(ValueError):
    """The request is well formed, but this engine doesn't answer it."""


@dataclass(frozen=True)
class SearchRequest:
    kind: str = ""
    text: str = ""
    mode: str = ""
    media_types: tuple[str, ...] = ()
    captured_from: str = ""
    captured_to: str = ""
    sort_by: str = ""
    descending: bool = True
    page: int = 0
    page_size: int = 0


@dataclass(frozen=True)
class Resolved:
    kind: str
    text: str
    mode: str
    media_types: tuple[str, ...]
    captured_from: datetime | None
    captured_to: datetime | None
    sort_by: str
    page: int
    page_size: int

    @property
    def offset(self) -> int:
        return self.page * self.page_size

    @property
    def canonical_json(self) -> str:
        """The same for requests that differ only in page."""
        own = {k: v for k, v in asdict(self).items() if k not in ("page", "page_size")}
        return json.dumps(own | {"version": 1}, sort_keys=True, default=str)

    @property
    def collection_key(self) -> str:
        return "search_v1:" + base64.urlsafe_b64encode(hashlib.sha256(self.canonical_json.encode()).digest()[:16]).decode().rstrip("=")


def utc_time(text: str) -> datetime | None:
    if not text:
        return None
    if not text.endswith("Z"):
        raise InvalidRequest(f"times end in Z: {text}")
    try:
        return datetime.fromisoformat(text.removesuffix("Z") + "+00:00").astimezone(UTC).replace(tzinfo=None)
    except ValueError as e:
        raise InvalidRequest(f"not a time: {text}") from e


def media_types(given) -> tuple[str, ...]:
    """In lower case, each once, in the order of MEDIA_TYPES; none given: no filter."""
    wanted = {m.strip().lower() for m in given}
    if bad := wanted - set(MEDIA_TYPES):
        raise InvalidRequest(f"unknown media types: {sorted(bad)}")
    return tuple(m for m in MEDIA_TYPES if m in wanted)


def resolve(r: SearchRequest, has_index: bool = True) -> Resolved:
    """kind defaults to timeline, size to 60 (200 at most). Text means a semantic search in auto mode if there is an
    index, and one by filename without an index for LEAST_TEXT characters or more. Timelines take no text."""
    kind, text, mode = r.kind.strip().lower() or "timeline", r.text.strip(), r.mode.strip().lower() or "auto"
    if kind not in ("timeline", "search"):
        raise UnsupportedRequest(f"kind {kind}")
    if mode not in MODES:
        raise UnsupportedRequest(f"mode {mode}")
    if kind == "timeline" and text:
        raise InvalidRequest("a timeline takes no text")
    if kind == "search" and not text:
        raise InvalidRequest("a search needs text")
    size = min(r.page_size or PAGE_SIZE, PAGE_SIZE_MOST)
    if r.page < 0 or size < 0 or r.page * size > 2**31 - 1:
        raise InvalidRequest("page out of range")
    lo, hi = utc_time(r.captured_from), utc_time(r.captured_to)
    if lo is not None and hi is not None and lo >= hi:
        raise InvalidRequest("an empty range of time")
    if kind == "search" and mode == "auto":
        mode = "semantic" if has_index else "filename" if len(text) >= LEAST_TEXT else "semantic"
    sort_by = r.sort_by.strip().lower() or ("relevance" if kind == "search" and mode == "semantic" else "captured_at")
    allowed = "relevance" if kind == "search" and mode == "semantic" else "captured_at"
    if sort_by != allowed or not r.descending:
        raise UnsupportedRequest(f"sort by {sort_by}")
    return Resolved(kind, text, mode, media_types(r.media_types), lo, hi, sort_by, r.page, size)


def next_page(r: SearchRequest) -> SearchRequest:
    return replace(r, page=r.page + 1)


def page_boundary(page: int, n_items: int, has_more: bool) -> str:
    """Where the page lies: an empty one after the first is past the end."""
    return "pastEnd" if page > 0 and n_items == 0 else "more" if has_more else "end"


def round_quotas(budget: int, sources: int) -> list[int]:
    """The budget dealt over the sources; the first ones take what is left over."""
    if budget <= 0 or sources <= 0:
        return []
    return [budget // sources + (i < budget % sources) for i in range(sources)]


def next_source(sources: list[str], last: int) -> str:
    """Where the next round starts; a round over all sources moves the start on by one."""
    if not sources or last < 0:
        return ""
    at = (last + 1) % len(sources)
    return sources[1 if at == 0 and len(sources) > 1 else at]
