"""Line dedup: levelled sorted runs of line hashes, compacted periodically.

A run is a Parquet folder of (key, n_docs) sorted by key: lines of one batch of documents and the number of its
documents that hold each. Batches come one after another. Each counts its lines, parts by a merge join those that the runs
have settled already, that is those known to be common, from those that they have not (its anti-join), and adds the latter
as a run of its own to level 0. Once a level has FANOUT runs, they are merged into one of the next level, and keys that reach the threshold there move
to the settled runs; so n batches leave O(FANOUT log n) runs, each key is rewritten O(log n) times, and a line that very
many documents hold is soon kept out of all levels. Lines that are common in the end are taken out of the
documents by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shoebox.llm.common import Scratch, az_folded, cut_points, exists, part_of, remove, table, written

BLANKS = " \t\n\x0b\x0c\r"
FANOUT = 4
#: Keys that are in 1/HOT_LINES of all lines or more are broadcast.
HOT_LINES = 10_000
#: Batches that a corpus is dealt into; one more than FANOUT, so that a level fills and a batch comes after it.
BATCHES = 5


def line_table(docs: DataFrame, id_col: str, text_col: str, batch: Column) -> DataFrame:
    """(id, text_hash, batch, pos, key, first): one row a line that is not blank; first marks one of a document's lines of
    that key. The key is a 128-bit hash of the line without outer blanks and with A-Z lower-cased.

    Equal lines are told by sorting the document's own keys, so a text of very many lines takes n log n steps.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), batch.alias("batch"))
    lines = F.transform(F.split(az_folded(F.coalesce("text", F.lit(""))), "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)))
    keyed = F.transform(lines, lambda line, i: F.struct(F.when(line != "", F.unhex(F.md5(line))).alias("key"), i.alias("pos")))
    d = d.select("id", F.xxhash64("text").alias("text_hash"), "batch", F.sort_array(F.filter(keyed, lambda x: x["key"].isNotNull())).alias("lines"))
    first = lambda x, i: (i == 0) | (F.get("lines", i - 1)["key"] != x["key"])
    flagged = F.transform("lines", lambda x, i: F.struct(x["pos"].alias("pos"), x["key"].alias("key"), first(x, i).alias("first")))
    return d.select("id", "text_hash", "batch", F.explode(flagged).alias("line")).select("id", "text_hash", "batch", "line.*")


class LineRuns:
    """The runs of one corpus. A run is complete before it is listed; a failed admit leaves none.

    Keys that min_docs documents hold are settled. With first, the type of ids, runs also hold the least id of a document
    that has the key; batches must then come in the order of ids, as settled keys are not looked at again.
    """

    def __init__(self, scratch: Scratch, min_docs: int, first: str | None = None):
        self.scratch, self.spark, self.min_docs = scratch, scratch.spark, min_docs
        self.schema = "key binary, n_docs bigint" + (f", first {first}" if first else "")
        self.firsts = [F.min("first").alias("first")] if first else []
        self.levels: list[list[str]] = [[]]
        self.settled: list[str] = []
        self.again: list[str] = []  # counts of settled keys in later batches

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _add(self, counted: DataFrame, level: int) -> None:
        """A run of counted keys: known ones only add to the counts, those of min_docs documents or more are settled, the
        others go to the level."""
        path, kind = self.scratch.path("run"), F.when(F.col("n_docs") >= self.min_docs, "settled").otherwise("new")
        if self.settled:
            known = self._read(self.settled).select("key").distinct().withColumn("known", F.lit(True))
            counted = counted.hint("merge").join(known, "key", "left")
            kind = F.when(F.col("known"), "again").otherwise(kind)
        split = counted.withColumn("kind", kind).select(*(c.split()[0] for c in self.schema.split(", ")), "kind")
        split.sortWithinPartitions("kind", "key").write.partitionBy("kind").parquet(path)
        if level == len(self.levels):
            self.levels.append([])
        for kind, runs in (("again", self.again), ("settled", self.settled), ("new", self.levels[level])):
            if exists(self.spark, f"{path}/kind={kind}"):
                runs.append(f"{path}/kind={kind}")

    def admit(self, keys: DataFrame) -> None:
        """keys: (key[, first]), a row for each document of the batch that holds the key; first is the document's id."""
        self._add(keys.groupBy("key").agg(F.count("*").alias("n_docs"), *self.firsts), 0)
        self.compact()

    def compact(self) -> None:
        """Merges each level that has FANOUT runs into one run of the next."""
        for level in range(len(self.levels)):
            runs = self.levels[level]
            if len(runs) >= FANOUT:
                self._add(self._merged(runs), level + 1)
                self.levels[level] = []
                for old in runs:
                    remove(self.spark, old)

    def _merged(self, runs: list[str]) -> DataFrame:
        return self._read(runs).groupBy("key").agg(F.sum("n_docs").alias("n_docs"), *self.firsts)

    def common(self) -> DataFrame:
        """(key, n_docs[, first]) of the keys that min_docs documents hold in all batches together."""
        runs = [p for level in self.levels for p in level]
        return self._merged(self.settled + self.again + runs).where(F.col("n_docs") >= self.min_docs)


def dedup_lines(
    docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text", keep: str = "none", more: tuple[str, ...] = (), batches: int = BATCHES,
) -> DataFrame:
    """(id_col, text_col, n_lines, n_dropped, *more): the text without the lines whose key is in min_docs documents or more.

    A document is a row; a line counts once in it. keep='first' leaves such lines in the document of the least id, so
    that no line is lost. Blank lines always stay. Null and empty texts are one empty line. Only the
    named columns are read. Rows that repeat, ids that repeat and null ids are separate documents; all rows of the
    least id keep the line. The documents are dealt into batches by ascending id, null ids last; their number leaves
    the result alone.
    """
    spark, id_ = docs.sparkSession, F.col(id_col)
    kept = keep == "first"
    others = F.struct(*(F.col(c) for c in more)) if more else F.lit(None)
    with Scratch(spark, "lines") as scratch:
        batch = F.when(id_.isNull(), batches - 1).otherwise(part_of(id_, cut_points(docs, id_, batches)))
        table_ = line_table(docs, id_col, text_col, batch.cast("int"))
        path = scratch.path("lines")
        table_.write.partitionBy("batch").parquet(path)
        lines = spark.read.schema(table_.schema).parquet(path)
        runs = LineRuns(scratch, min_docs, lines.schema["id"].dataType.simpleString() if kept else None)
        for n in range(batches):
            runs.admit(lines.where((F.col("batch") == n) & F.col("first")).select("key", *[F.col("id").alias("first")] * kept))
        places, how = lines.select("id", "text_hash", "pos", "key"), "inner" if kept else "left_semi"
        common = scratch.written(runs.common(), "common")
        # at most HOT_LINES keys are in that share of the lines; they are broadcast, so that none meets whole in one task
        hot = F.col("n_docs") >= max(min_docs, lines.count() // HOT_LINES)
        hottest = F.broadcast(common.where(hot).drop("n_docs"))
        rest = places.join(hottest.select("key"), "key", "left_anti").join(common.where(~hot).drop("n_docs"), "key", how)
        hits = places.join(hottest, "key", how).unionByName(rest)
        if kept:
            hits = hits.where(~F.col("first").eqNullSafe(F.col("id"))).drop("first")
        # a document has at most as many hits as lines; the rows of equal documents are merged here
        hits = written(hits.groupBy(F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).agg(F.collect_set("pos").alias("hits")), "line-hits")
    d = docs.select(id_.alias("id"), F.col(text_col).alias("text"), others.alias("others")).withColumn("text_hash", F.xxhash64("text"))
    d = d.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    d = d.select("id", "text", "others", split.alias("lines"), "hits")
    n, none = F.size("lines"), F.array().cast("array<int>")
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("hits", none))
    out = F.when(F.col("hits").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return d.select(F.col("id").alias(id_col), out.alias(text_col), n.cast("long").alias("n_lines"), F.size(F.coalesce("hits", none)).cast("long").alias("n_dropped"), *(F.col("others")[c].alias(c) for c in more))


def op10_line_dedup(spark, sf_dir):
    """Every document without its common lines. Null and empty texts are one empty line, which has no key and stays; a line
    counts once a document, however often it stands there; repeated rows are documents of their own; an empty table gives no
    rows."""
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT n, doc_id, pos, lines[pos] AS line,
    translate(trim(lines[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM d, unnest(range(1, len(lines) + 1)) AS t(pos)),
c AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT n) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE c.key IS NOT NULL))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN c USING (key) GROUP BY n, doc_id
"""
