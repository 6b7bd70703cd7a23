"""Scalar rules of the catalog, as column expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: What each status and kind of datasource ranks as; anything else comes last.
VISIBILITY_RANKS = {"active": 0, "permission_blocked": 1, "out_of_scope": 2, "missing": 3}
DATASOURCE_RANKS = {"local_filesystem": 0, "remote_mirror": 1}
FAVORITE_WORDS = ("favorite", "favorites", "favourite", "favourites", "starred", "お気に入り")
RETRY_SECONDS, RETRY_MOST_SECONDS = 30, 1800


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends; trim() alone takes blanks only."""
    return F.trim(c, F.lit(" \t\n\x0b\f\r"))


def given(c: Column, make: Callable[[Column], Column]) -> Column:
    """make(c), for which c is evaluated once however often it is used: as a plain column it would be written out anew, and
    evaluated, at each use, and what uses that again at each of its own."""
    return F.get(F.transform(F.array(c), make), F.lit(0))


def blank(c: Column) -> Column:
    return F.coalesce(trimmed(c), F.lit("")) == ""


def rank_of(c: Column, ranks: dict[str, int]) -> Column:
    pairs = [x for name, rank in ranks.items() for x in (F.lit(name), F.lit(rank))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce(trimmed(c), F.lit(""))), F.lit(len(ranks)))


def timestamp_text(c: Column) -> Column:
    """Fixed width with nanoseconds, so that the order of texts is that of times; times here have microseconds."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'000Z'")


def sha1_hex(c: Column) -> Column:
    """The 40 digits in lower case; '' if they are not that."""
    x = F.lower(trimmed(F.coalesce(c, F.lit(""))))
    return F.when(x.rlike("^[0-9a-f]{40}$"), x).otherwise(F.lit(""))


def content_identity(own_sha1: Column, own_size: Column, algorithm: Column, set_sha1: Column, set_size: Column) -> tuple[Column, Column]:
    """(sha1, size) that name the content: the set pair if valid, else the own pair if it is a hash of content."""
    valid = (sha1_hex(set_sha1) != "") & (F.coalesce(set_size, F.lit(0)) > 0)
    own = trimmed(F.coalesce(algorithm, F.lit(""))).isin("", "sha1")
    return F.when(valid, set_sha1).when(own, own_sha1), F.when(valid, set_size).when(own, own_size)


def hashed_id(*parts: Column) -> Column:
    return F.concat(F.lit("ca1_"), F.sha2(F.concat(*(x for p in parts for x in (trimmed(F.coalesce(p, F.lit(""))), F.lit("\0")))), 256))


def canonical_id(media_type: Column, sha1: Column, size: Column, source_key: Column, upstream_id: Column) -> Column:
    """One id for equal content of one media type; rows without a content identity stand alone."""
    content = (sha1_hex(sha1) != "") & (F.coalesce(size, F.lit(0)) > 0)
    return F.when(content, hashed_id(F.lit("content"), media_type, sha1_hex(sha1), size.cast("string"))).otherwise(hashed_id(F.lit("source"), source_key, upstream_id))


def collection_key(request: Column) -> Column:
    """The key of a request's canonical JSON: 16 bytes of its hash, in the base64 of urls without padding."""
    start = F.unhex(F.substring(F.sha2(request.cast("binary"), 256), 1, 32))
    return F.concat(F.lit("search_v1:"), F.regexp_replace(F.translate(F.base64(start), "+/", "-_"), "=+$", ""))


def place_label(*parts: Column) -> Column:
    """Parts that are not blank, each once whatever its case, joined by ', '."""
    texts = F.filter(F.transform(F.array(*parts), lambda p: trimmed(F.coalesce(p, F.lit("")))), lambda p: p != "")
    keep = F.aggregate(texts, F.array().cast("array<string>"), lambda acc, p: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(p)), acc).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(keep, ", ")


def duration_text(ms: Column, digits: int = 6) -> Column:
    """H:MM:SS and a fraction of 6 or 3 digits."""
    s, rest = F.floor(ms / 1000), F.pmod(ms, F.lit(1000))
    fraction = rest * 1000 if digits == 6 else rest
    return F.format_string(f"%d:%02d:%02d.%0{digits}d", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)), fraction.cast("long"))


def retry_delay(attempts: Column) -> Column:
    """Seconds: RETRY_SECONDS, doubled for each attempt after the first, RETRY_MOST_SECONDS at most."""
    steps = F.least(F.greatest(attempts, F.lit(1)) - 1, F.lit(20))
    return F.least(F.lit(RETRY_SECONDS) * F.pow(F.lit(2), steps), F.lit(RETRY_MOST_SECONDS)).cast("long")


def local_asset_id(sha1: Column, size: Column) -> Column:
    return F.concat_ws("-", sha1, size.cast("string"))


def fast_signature(size: Column, mtime: Column) -> Column:
    return F.concat_ws(":", size.cast("string"), timestamp_text(mtime))


def input_fingerprint(version: Column, kind: Column, source_key: Column, asset_id: Column, sha1: Column, size: Column, rendition: Column) -> Column:
    """Joined by NUL; concat_ws drops nulls, so they become empty first."""
    parts = [version, trimmed(kind), trimmed(source_key), trimmed(asset_id), F.lower(trimmed(sha1)), F.coalesce(size, F.lit(0)).cast("string"), F.lower(trimmed(rendition))]
    return F.concat_ws("\0", *(F.coalesce(p, F.lit("")) for p in parts))


def clean_path(c: Column) -> Column:
    """The shortest equal path: no empty and '.' parts, and none before a '..'; '' for a blank one."""
    path = trimmed(c)
    rooted = F.startswith(path, F.lit("/"))

    def step(done: Column, part: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        up = F.when((F.size(done) > 0) & (last != ".."), F.slice(done, 1, F.size(done) - 1)).when(rooted, done).otherwise(F.concat(done, F.array(F.lit(".."))))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    parts = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(path == "", "").when(rooted, F.concat(F.lit("/"), parts)).when(parts == "", ".").otherwise(parts)


def clean_relative_path(c: Column) -> Column:
    """The path if it is relative and has no empty, '.' or '..' part; else null."""
    bad = (c == "") | c.startswith("/") | c.rlike(r"(^|/)(\.{0,2})(/|$)")
    return F.when(~bad, c)


def path_checksum(path: Column) -> Column:
    return F.sha1(F.concat(F.lit("path:"), trimmed(path)).cast("binary"))


def greater(a: Column, b: Column) -> Column:
    """Null if either is null, unlike greatest()."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def capture_time(value: Column, subsecond: Column, offset: Column, source: Column, zone: Column) -> Column:
    """UTC time of one dated tag, or null: EXIF dates with ':', a fraction from its own tag, an offset, else the zone.

    Zero times of containers (1904 and 1970) mean that there is no date.
    """
    known = source.isin("exif_original", "exif_digitized", "quicktime_creationdate", "container_creation_time", "video_stream_creation_time")
    m = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(\.\d{1,9})?(Z|[+-]\d{2}:?\d{2})?$"

    def with_fraction(v: Column) -> Column:
        v = F.regexp_replace(v, r"^(\d{4}):(\d{2}):", "$1-$2-")
        v = F.regexp_replace(v, r"^(.{10}) ", "$1T")
        return given(v, lambda v: given(trimmed(F.coalesce(subsecond, F.lit(""))), lambda sub: F.when((sub != "") & (F.length(v) == 19), F.when(sub.rlike(r"^\d+$"), F.concat(v, F.lit("."), F.substring(sub, 1, 6)))).otherwise(v)))

    def in_utc(v: Column, mark: Column) -> Column:
        text = F.concat_ws(" ", F.regexp_extract(v, m, 1), F.concat(F.regexp_extract(v, m, 2), F.regexp_extract(v, m, 3)))
        local = F.when(v.rlike(m), F.try_to_timestamp(text).cast("timestamp_ntz"))
        minutes = F.when(mark == "Z", F.lit(0)).otherwise(
            F.when(F.substring(mark, 1, 1) == "-", -1).otherwise(1) * (F.substring(mark, 2, 2).try_cast("int") * 60 + F.right(mark, F.lit(2)).try_cast("int"))
        )
        return given(local, lambda local: F.when(mark != "", local - F.make_dt_interval(mins=minutes)).otherwise(F.convert_timezone(zone, F.lit("UTC"), local)))

    def dated(utc: Column) -> Column:
        zero = utc.isin(F.lit("1904-01-01 00:00:00").cast("timestamp_ntz"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")) & ~source.startswith("exif_")
        return F.when(known & (F.year(utc) >= 1) & ~zero, utc)

    v = given(trimmed(value), lambda v: F.when(F.length(v).between(19, 64), v))
    v = F.concat(with_fraction(v), trimmed(F.coalesce(offset, F.lit(""))))
    return given(given(v, lambda v: given(F.regexp_extract(v, m, 4), lambda mark: in_utc(v, mark))), dated)


def first_capture_time(candidates: Column, fallback: Column) -> Column:
    """The first candidate time that is there, in order; else the fallback (the file's time, else that of the scan)."""
    return F.coalesce(F.get(F.array_compact(candidates), F.lit(0)), fallback)


def all_of(conditions: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions, F.lit(False))
