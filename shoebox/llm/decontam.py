"""Benchmark decontamination: a broadcast hash set of benchmark n-grams, scanned over the documents' token windows.

The windows of all items are made and counted by Spark and dealt by their hash into sets of about BLOCK_WINDOWS, so that
neither a long item nor a large benchmark makes a broadcast larger. For each set the documents are scanned once. Words are
numbered by the set's vocabulary, so a document becomes an array of small integers (0: in no window). Rolling hashes of its
windows are looked up in the sorted hashes of the set, and each hit is verified word by word. The first set's scan gives
every document's row; what others hit, without any text, is written and merged into these rows.

A window stands in a set with the items that have it, if these are INLINE at most. A wider one, as a prompt line that a
million items share, stands there with a number only; which items it has is a table that the documents' hits are joined with.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from shoebox.llm.common import Scratch, slices, table, written

WINDOW = 10
#: Different windows in one broadcast set; more of them take several scans, one a set.
BLOCK_WINDOWS = 400_000
#: Items that stand beside their window in memory.
INLINE = 16
#: Word bytes are 0-9, A-Z (lower-cased), a-z and all bytes from 0x80; the others become blanks.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash of every window of `size` ids."""
    n = len(ids) - size + 1
    mixed = ids.astype(np.uint64) * FACTOR
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= FACTOR
        out += mixed[j : j + n]
    return out


class Windows:
    """Benchmark windows (words joined by blanks, items that have it or, for a wide one, its number), by their length."""

    def __init__(self, windows: list[tuple[bytes, list[str] | int]]):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, list] = {}
        for gram, items in windows:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in gram.split(b" ")]
            found.setdefault(len(ids), []).append((ids, items))
        self.by_size = {}
        for k, own in found.items():
            grams = np.array([ids for ids, _ in own], dtype=np.int64).reshape(len(own), k)
            hashes = np.array([window_hashes(g, k)[0] for g in grams], np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.by_size[k] = (hashes[order], grams[order], [own[i][1] for i in order])

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str], set[int]]:
        """Which words are hit (None: none), by which items, and by which wide windows."""
        hit, items, wide = None, set(), set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for k, (hashes, grams, owners) in self.by_size.items():
            if len(ids) < k:
                continue
            at = np.flatnonzero(known[k:] - known[:-k] == k)  # windows of benchmark words only
            if not len(at):
                continue
            mine = window_hashes(ids, k)[at]
            first = np.searchsorted(hashes, mine)
            same = first < len(hashes)
            same[same] = hashes[first[same]] == mine[same]
            for i, j in zip(at[same].tolist(), first[same].tolist(), strict=True):
                h = hashes[j]
                while j < len(hashes) and hashes[j] == h:  # other windows may share a hash
                    if (grams[j] == ids[i : i + k]).all():
                        hit = np.zeros(len(ids), bool) if hit is None else hit
                        hit[i : i + k] = True
                        if isinstance(owners[j], int):
                            wide.add(owners[j])
                        else:
                            items.update(owners[j])
                    j += 1
        return hit, items, wide


def runs_of(text: str, hit: np.ndarray) -> list[dict]:
    """The runs of hit words: numbers of the first word and of that after the last, and their code points' span."""
    runs: list[dict] = []
    for i, m in enumerate(WORD.finditer(text)):
        if hit[i]:
            if runs and runs[-1]["after"] == i:
                runs[-1].update(after=i + 1, stop=m.end())
            else:
                runs.append({"first": i, "after": i + 1, "start": m.start(), "stop": m.end()})
    return runs


RUNS = "array<struct<first:bigint,after:bigint,start:bigint,stop:bigint>>"
ARROW_RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "after", "start", "stop")]))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(gram binary, item string): each different window of each item, its words joined by blanks."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                words = words_of(text)
                k = min(size, len(words))
                grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if words else []
                for at in range(0, len(grams), 10_000):
                    some = grams[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([item] * len(some), pa.string())], names=["gram", "item"])

    return items.mapInArrow(cut, "gram binary, item string").distinct()


def scan_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_windows: int = BLOCK_WINDOWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *carry, n_words, n_hit, items array<string> sorted, spans array<(start, stop)>): one row a document.

    A word inside any occurrence of a window is hit; an item of fewer than WINDOW words, but at least one, is one
    window. Null texts and ids are legal: null has no words, null item ids are listed as 'null'. Repeated rows and
    equal items count as they stand. An empty benchmark hits nothing. Only the named columns are read;
    those in carry are passed on, and may not be named like the results.
    """
    if clash := {"n_words", "n_hit", "items", "spans", "runs", "wide"} & {id_col, *carry}:
        raise ValueError(f"carried columns are named like results: {sorted(clash)}")
    names = [id_col, *carry]
    source = docs.select(F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("__hash"), *names)
    out, more = None, []
    none = F.array().cast("array<string>")
    with Scratch(docs.sparkSession, "windows") as scratch:
        windows = scratch.written(benchmark_windows(benchmark, item_col, item_text_col), "windows")
        # one item has a window once
        grams = scratch.written(windows.groupBy("gram").agg(F.count("*").alias("n")).withColumn("number", F.monotonically_increasing_id()), "grams")
        wide = grams.where(F.col("n") > INLINE).select("gram", "number")
        few = scratch.written(windows.join(wide, "gram", "left_anti").groupBy("gram").agg(F.collect_list("item").alias("items")), "few")  # INLINE at most
        members = written(windows.join(wide, "gram").select("number", "item"), "wide-windows")
        # as many sets as the different windows need
        blocks = max(1, -(-grams.count() // block_windows))
        for n in range(blocks):
            of_block = F.pmod(F.xxhash64("gram"), F.lit(blocks)) == n
            rows = [(bytes(r.gram), r["items"]) for r in few.where(of_block).collect()] + [(bytes(r.gram), r.number) for r in wide.where(of_block).collect()]  # about block_windows
            shared = docs.sparkSession.sparkContext.broadcast(Windows(sorted(rows, key=lambda r: r[0])))
            found = scanned(source, shared, names, n == 0)
            if n == 0:
                out = found
            else:
                first = [F.first(c).alias(c) for c in ("runs", "items", "wide")]
                more.append(written(found.groupBy(F.col(id_col).alias("hit_id"), F.col("__hash").alias("hit_hash")).agg(*first), "hits"))
                shared.unpersist()
    same = F.col(id_col).eqNullSafe(F.col("hit_id")) & (F.col("__hash") == F.col("hit_hash"))
    if more:
        hits = more[0]
        for other in more[1:]:
            hits = hits.unionByName(other)
        hits = hits.groupBy("hit_id", "hit_hash").agg(*(F.flatten(F.collect_list(c)).alias(f"more_{c}") for c in ("runs", "items", "wide")))
        out = out.join(hits, same, "left").drop("hit_id", "hit_hash")
        out = out.withColumn("items", F.array_distinct(F.concat("items", F.coalesce("more_items", none))))
        out = out.withColumn("wide", F.concat("wide", F.coalesce("more_wide", F.array().cast("array<bigint>"))))
        out = out.withColumn("runs", merged_runs(F.concat("runs", F.coalesce("more_runs", F.array().cast(RUNS)))))
    if not members.isEmpty():
        # a second scan, for what few documents hit; equal rows hit the same
        hits = out.where(F.size("wide") > 0).select(F.col(id_col).alias("hit_id"), F.col("__hash").alias("hit_hash"), F.explode("wide").alias("number")).distinct()
        theirs = hits.join(members, "number").groupBy("hit_id", "hit_hash").agg(F.collect_set("item").alias("wide_items"))
        out = out.join(theirs, same, "left").drop("hit_id", "hit_hash")
        out = out.withColumn("items", F.array_distinct(F.concat("items", F.coalesce("wide_items", none))))
    n_hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r["after"] - r["first"])
    spans = F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop")))
    return out.select(*names, "n_words", n_hit.alias("n_hit"), F.sort_array("items").alias("items"), spans.alias("spans"))


def scanned(source: DataFrame, shared, names: list[str], every: bool) -> DataFrame:
    """(__hash, *names, n_words, runs, items, wide) of every row of source, or of those with hits."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in slices(batches):
            n_words, runs, items, wide, kept = [], [], [], [], []
            for row, text in enumerate(batch.column(0).to_pylist()):
                words = words_of(text)
                hit, found, many = w.scan(words)
                if hit is not None or every:
                    kept.append(row)
                    n_words.append(len(words))
                    runs.append([] if hit is None else runs_of(text, hit))
                    items.append(sorted(found))
                    wide.append(sorted(many))
            columns = [batch.column(i + 1).take(pa.array(kept, pa.int32())) for i in range(len(names) + 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(runs, ARROW_RUNS), pa.array(items, pa.list_(pa.string())), pa.array(wide, pa.list_(pa.int64()))], names=["__hash", *names, "n_words", "runs", "items", "wide"])

    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("first", "after", "start", "stop")]))), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("wide", T.ArrayType(T.LongType()))]
    return source.mapInArrow(scan, T.StructType([source.schema["__hash"], *(source.schema[c] for c in names), *fields]))


def merged_runs(runs: Column) -> Column:
    """Runs of hit words that touch or overlap as one."""
    field = lambda x, n: x[n].alias(n)

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(field(last, "first"), F.greatest(last["after"], x["after"]).alias("after"), field(last, "start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        touching = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["after"] >= x["first"])
        return F.when(touching, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(runs), F.array().cast(RUNS), step)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col, n_hit): documents without hits (remove='documents'), or all with the hit spans cut out ('spans').

    A cut leaves what stood around the span, unchanged.
    """
    found = scan_documents(docs, benchmark, id_col, text_col, carry=(text_col,))
    if remove == "documents":
        return found.where("n_hit = 0").select(id_col, text_col, "n_hit")
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("at"))
    piece = lambda acc, x: F.struct(F.concat(acc["text"], F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))).alias("text"), x["stop"].alias("at"))
    done = lambda acc: F.concat(acc["text"], F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), F.length(text_col)))
    cut = F.when(F.size("spans") > 0, F.aggregate("spans", start, piece, done)).otherwise(F.col(text_col))
    return found.select(id_col, cut.alias(text_col), "n_hit")


def op4_decontamination(spark, sf_dir):
    """Hits of all benchmark items in every document; null and empty texts have no words and no hits, repeated rows one row
    each; an empty benchmark hits nothing, no documents: no rows."""
    found = scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The same by joins of word tables.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(words)) AS k, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS gram FROM b, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS t(i) WHERE len(words) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT n, i, k, array_to_string(words[i:i + k - 1], ' ') AS gram FROM d, ks, unnest(range(1, len(words) - k + 2)) AS t(i) WHERE len(words) >= k),
m AS (SELECT n, i, dw.k, item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.k = bw.k),
h AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT n, i, k FROM m) AS x, unnest(range(i, i + k)) AS t(p) GROUP BY n),
it AS (SELECT n, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT n, item_id::VARCHAR AS item_id FROM m) GROUP BY n)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (n) LEFT JOIN it USING (n)
"""
