"""A trigram index over text columns: for a phrase, the rows that have it, without reading the texts of others.

Rows come in segments. A segment has the rows themselves, numbered in the order in which they stand in its files; for each
trigram of their lower-cased texts the numbers of the rows that have it, as blocks sorted by trigram; and how many rows
these are. A search looks the phrase's trigrams up, takes the rarest, intersects their blocks and reads only the rows that
are left, to verify the whole phrase. New rows are a new segment, rows that went are tombstones, and many segments are
merged. A very frequent trigram has many blocks, over which the sorted files are cut like anywhere else.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shoebox.functions.scalars import any_of
from shoebox.sources.snapshots import Snapshots

#: Rows of one block at most.
BLOCK = 4096
#: A trigram is looked up if it has at most so many times the rows of the rarest, and so many are at most.
WIDER, MOST_GRAMS = 20, 6
#: Up to so many candidates are named to the reader, which then skips all pages without them; more are joined.
NAMED = 20_000
#: Segments beyond which an index is merged.
SEGMENTS = 8


def has_phrase(c: Column, phrase: str) -> Column:
    """Whether the text has the phrase, whatever the case; null has none."""
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(normal(phrase)))


def normal(phrase: str) -> str:
    return phrase.strip().lower()


def grams_of(text: str) -> np.ndarray:
    """The different trigrams as numbers, three code points of 21 bits each."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:])


def _blocks(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(gram, base, docs): rows base + docs have the trigram; rows: (doc, fields), doc rising within a file."""
    source = rows.select("doc", F.array(*(F.lower(F.coalesce(f, F.lit(""))) for f in fields)).alias("texts"))

    def block(docs: list[int], grams: list[np.ndarray]) -> pa.RecordBatch:
        base = docs[0]
        flat, place = np.concatenate(grams), np.repeat(np.array([d - base for d in docs], np.int32), [len(g) for g in grams])
        order = np.argsort(flat, kind="stable")
        flat, place = flat[order], place[order]
        starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, int)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(flat)], pa.int32()), pa.array(place, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(flat[starts]), pa.array(np.full(len(starts), base)), lists], names=["gram", "base", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[int] = []
        grams: list[np.ndarray] = []
        for b in batches:
            for doc, texts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if docs and not 0 < doc - docs[0] < BLOCK:
                    yield block(docs, grams)
                    docs, grams = [], []
                docs.append(doc)
                grams.append(np.unique(np.concatenate([grams_of(t) for t in texts.as_py()])))
        if docs:
            yield block(docs, grams)

    return source.mapInArrow(run, "gram bigint, base bigint, docs array<int>")


class TextIndex:
    """An index of rows told apart by `keys`, over the texts in `fields`; other columns are kept with the rows.

    Each method that changes the index publishes the store's next generation and fails if another was published meanwhile.
    """

    def __init__(self, store: Snapshots, keys: list[str], fields: list[str]):
        self.store, self.keys, self.fields = store, keys, fields

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def _segments(self, generation: int) -> list[tuple[int, str, int]]:
        """(number, folder, rows), a few."""
        return sorted((r.segment, r.folder, r.n) for r in self.store.read("segments", generation).collect()) if generation else []

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        """A segment's folder, and how many rows it has."""
        folder = f"{self.store.root}/segments/{uuid.uuid4().hex}"
        rows.withColumn("doc", F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")
        own = self.spark.read.parquet(f"{folder}/rows")
        _blocks(own, self.fields).repartitionByRange("gram", "base").sortWithinPartitions("gram", "base").write.parquet(f"{folder}/postings")
        counts = self.spark.read.parquet(f"{folder}/postings").groupBy("gram").agg(F.sum(F.size("docs")).alias("n"))
        counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{folder}/grams")
        return folder, own.count()

    def _read(self, segments: list[tuple[int, str, int]], table: str) -> DataFrame:
        """A table of all segments, with the segment's number."""
        found = None
        for number, folder, _ in segments:
            one = self.spark.read.parquet(f"{folder}/{table}").withColumn("segment", F.lit(number))
            found = one if found is None else found.unionByName(one)
        return found

    def _publish(self, segments: list[tuple[int, str, int]], dead: DataFrame, generation: int) -> int:
        listed = self.spark.createDataFrame(segments, "segment int, folder string, n bigint")
        return self.store.publish({"segments": listed, "tombstones": dead}, expected=generation)

    def _dead(self, generation: int) -> DataFrame:
        return self.store.read("tombstones", generation) if generation else self.spark.createDataFrame([], "segment int, doc bigint")

    def apply(self, rows: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """Rows come in, in place of those with their keys; rows with the keys in `gone` go. A key may be in `rows` once."""
        generation = self.store.current()
        segments, dead = self._segments(generation), self._dead(generation)
        out = [df.select(*self.keys) for df in (rows, gone) if df is not None]
        if segments and out:
            names = out[0] if len(out) == 1 else out[0].unionByName(out[1])
            old = self._read(segments, "rows").select(*self.keys, "segment", "doc")
            dead = dead.unionByName(old.join(names.distinct(), self.keys, "left_semi").select("segment", "doc")).distinct()
        if rows is not None:
            segments = [*segments, (segments[-1][0] + 1 if segments else 0, *self._write(rows))]
        generation = self._publish(segments, dead, generation)
        return self.merge() if len(segments) > SEGMENTS else generation

    def rows(self, generation: int | None = None) -> DataFrame | None:
        """All rows that are there; None before the first segment."""
        generation = generation or self.store.current()
        segments = self._segments(generation)
        return self._read(segments, "rows").join(self._dead(generation), ["segment", "doc"], "left_anti").drop("segment", "doc") if segments else None

    def merge(self) -> int:
        """One segment of all rows that are there."""
        generation = self.store.current()
        if (rows := self.rows(generation)) is None:
            return generation
        return self._publish([(0, *self._write(rows))], self._dead(0), generation)

    def _rarest(self, segments: list[tuple[int, str, int]], phrase: str) -> list[int] | None:
        """The trigrams to look up, the rarest first; None if one is in no row."""
        wanted = [int(g) for g in grams_of(phrase)]
        counts = self._read(segments, "grams").where(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum("n").alias("n"))
        found = sorted((r.n, r.gram) for r in counts.collect())  # a phrase's trigrams
        return [g for n, g in found if n <= WIDER * found[0][0]][:MOST_GRAMS] if len(found) == len(wanted) else None

    def candidates(self, phrase: str) -> DataFrame | None:
        """(segment, doc) of rows that are there and have the phrase's rarest trigrams; None if no row can have it."""
        generation = self.store.current()
        segments = self._segments(generation)
        grams = self._rarest(segments, normal(phrase)) if segments else None
        if grams is None:
            return None
        blocks = self._read(segments, "postings").where(F.col("gram").isin(grams))
        each = blocks.select("segment", F.explode("docs").alias("place"), "base").select("segment", (F.col("base") + F.col("place")).alias("doc"))
        # a row and a trigram meet once
        return each.groupBy("segment", "doc").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("segment", "doc").join(self._dead(generation), ["segment", "doc"], "left_anti")

    def search(self, phrase: str, fields: list[str] | None = None) -> DataFrame:
        """The rows that have the phrase in any of the fields, whatever the case.

        A phrase of fewer than three letters has no trigram; all rows are read then.
        """
        match = any_of([has_phrase(F.col(f), phrase) for f in fields or self.fields])
        if len(normal(phrase)) < 3:
            return self.rows().where(match)
        segments = self._segments(self.store.current())
        every = self._read(segments, "rows")
        found = self.candidates(phrase)
        if found is None:
            return every.where("false").drop("segment", "doc")
        some = found.limit(NAMED + 1).collect()
        if len(some) > NAMED:
            return every.join(found, ["segment", "doc"], "left_semi").where(match).drop("segment", "doc")
        out = None
        for number, folder, _ in segments:
            docs = [r.doc for r in some if r.segment == number]
            if docs or out is None:
                one = self.spark.read.parquet(f"{folder}/rows").where(F.col("doc").isin(docs)).where(match).drop("doc")
                out = one if out is None else out.unionByName(one)
        return out
