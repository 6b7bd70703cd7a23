"""Helpers that the text operators share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from shoebox import session
from shoebox.session import remove

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_INSIDE: ContextVar[str | None] = ContextVar("inside", default=None)


@contextlib.contextmanager
def inside(spark: SparkSession, what: str) -> Iterator[None]:
    """All folders that shared_dir() names within are below one, which is deleted at the end."""
    top = shared_dir(spark, what)
    before = _INSIDE.set(top)
    try:
        yield
    finally:
        _INSIDE.reset(before)
        remove(spark, top)


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder's path below the application's own (session.shared_root()), or below that of inside()."""
    if top := _INSIDE.get():
        return f"{top}/{what}-{uuid.uuid4().hex}"
    return session.shared_dir(spark, what)


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lost executors cost no recomputation."""
    return saved(df, shared_dir(df.sparkSession, what))


def saved(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that are read only inside a `with`; they are deleted at its end.

    What must be read later goes through written().
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root, self.n = spark, shared_dir(spark, what), 0

    def path(self, what: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{what}"

    def written(self, df: DataFrame, what: str) -> DataFrame:
        return saved(df, self.path(what))

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.root)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """The rows over as many partitions as shuffles have: for small tables of which each row becomes very many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def exists(spark: SparkSession, path: str) -> bool:
    p, files = session.hadoop(spark, path)
    return files.exists(p)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a Python worker never holds many texts as strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lower_az(c: Column) -> Column:
    """A-Z to a-z and nothing else, unlike lower()."""
    return F.translate(c, UPPER, UPPER.lower())


def az_folded(c: Column) -> Column:
    """For keys and hashes: two texts have equal images exactly if they are equal but for the case of A-Z.

    Much cheaper than lower_az(). The UTF-8 bytes are read as Latin-1 and lower-cased. Beside A-Z that moves only the
    bytes 0xC0 to 0xDE, which start characters of two bytes, to 0xE0 to 0xFE, which start longer ones; as the number of
    bytes that follow tells these apart, no two texts are confused. ASCII characters stay what they are, so blanks can
    be searched in the image.
    """
    return F.lower(F.decode(c.cast("binary"), "ISO-8859-1"))


def cut_points(df: DataFrame, key: Column, parts: int, oversample: int = 8) -> list:
    """At most parts - 1 values of `key` (numbers, strings or structs of them) that cut df's different keys, null keys
    left out, into parts of about one size.

    From oversample * parts keys at most, those of the greatest hash in as many cells of a hash; so it is one aggregation,
    the same for any partitioning, and however the keys cluster, no part is far above its share.
    """
    cell = F.pmod(F.xxhash64("k"), F.lit(parts * oversample))
    rows = df.select(key.alias("k")).where("k IS NOT NULL").groupBy(cell).agg(F.max_by("k", F.xxhash64("k", F.lit(1))).alias("k"))
    found = [r.k for r in rows.select("k").orderBy("k").collect()]
    step = max(1.0, len(found) / parts)
    return [found[int(i * step)] for i in range(1, parts) if int(i * step) < len(found)]


def part_of(key: Column, cuts: list) -> Column:
    """The number of a few cuts, ascending, that are not above the key; null keys: 0."""
    return sum((F.when(key >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))


def _numbers(values: list, kind: str) -> Column:
    """A constant array; one string to parse once, as thousands of literals are slow to plan."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def range_of(first: Column, second: Column, cuts: list, kind: str) -> Column:
    """The number of the cuts, ascending pairs of numbers, that are not above the pair, by binary search; a null first
    number: 0. kind is the type of the first numbers, the second are bigint."""
    if not cuts:
        return F.lit(0)
    a, b = _numbers([c[0] for c in cuts], kind), _numbers([c[1] for c in cuts], "bigint")
    steps = [1 << n for n in reversed(range(len(cuts).bit_length()))]

    def step(at: Column, width: Column) -> Column:
        x, y, i = first.cast(kind), second, at + width - 1
        return F.when((x > F.get(a, i)) | (x == F.get(a, i)) & (y >= F.get(b, i)), at + width).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)
