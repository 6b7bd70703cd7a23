"""A clustered inverted file over vectors: for a set of query vectors, the k with the greatest dot products.

Every vector lies in the cell of its nearest centre. A search meets, for each query, only the vectors of its most promising
cells, and scores these exactly. How many cells that takes is measured when the index is built, for a share of the true
results (RECALL) among a bounded sample. exact=True goes on until no other cell can hold a better vector: a cell's
radius bounds every dot product in it.

Equal vectors are one entry of the index, with the first of their ids by order; so a vector that very many rows share is
neither scored nor sent more than once. Cells are cut into parts of bounded size, so that a large one is many tasks' work.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from shoebox.sources.snapshots import Snapshots

#: The centres are fit, and the probes measured, on so many different vectors at most: those with the least hashes of
#: their id. Every vector is indexed.
SAMPLE = 32_768
FEWEST_CELLS, MOST_CELLS, FIT_ROUNDS, TEST_QUERIES = 256, 4096, 10, 256
#: The share of the true results that a search is to find; a little more is asked of the sample.
RECALL, MARGIN = 0.9, 0.04
#: Ids that are kept of equal vectors, and so the largest k.
MOST_K = 100
#: Vectors and queries of a cell that meet in one task.
PART = 4096
SALTS = 64
#: Numbers that a task in Python works on at once: scores, promises, or the vectors that it sends on.
AT_ONCE = 1 << 20


@dataclass
class Centres:
    """centres (cell, place), and how many cells a search probes."""

    centres: np.ndarray
    probes: int

    def promise(self, queries: np.ndarray, radii: np.ndarray) -> np.ndarray:
        """The greatest dot product that a query can have with a vector of each cell."""
        return queries @ self.centres.T + np.linalg.norm(queries, axis=1)[:, None] * radii


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and the distance to it."""
    half = (centres**2).sum(1) / 2
    at = np.concatenate([(half - x[i : i + 4096] @ centres.T).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)
    return at, np.linalg.norm(x - centres[at], axis=1)


def _pieces(n: int, each: int) -> list[tuple[int, int]]:
    """(start, end) of runs of n rows of `each` numbers: AT_ONCE numbers a run at most, one row at least."""
    step = max(1, AT_ONCE // max(1, each))
    return [(i, min(i + step, n)) for i in range(0, n, step)]


def fit_centres(x: np.ndarray, cells: int, recall: float = RECALL + MARGIN, k: int = 10) -> Centres:
    """k-means on a sample of different vectors, from spread rows on; then the fewest probes for the recall among the
    sample's own top k."""
    rng = np.random.default_rng(len(x))
    centres = x[rng.permutation(len(x))[:cells]].copy()
    for _ in range(FIT_ROUNDS):
        at, _ = _nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    at, far = _nearest(x, centres)
    radii = np.zeros(len(centres))
    np.maximum.at(radii, at, far)
    found = Centres(centres, len(centres))
    queries = x[rng.permutation(len(x))[:TEST_QUERIES]]
    top = np.argsort(-(queries @ x.T), axis=1, kind="stable")[:, :k]
    order = np.argsort(-found.promise(queries, radii), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], 1)
    needed = np.sort(np.take_along_axis(place, at[top], 1).ravel())
    found.probes = int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1 if len(needed) else 1
    return found


def _good(rows: DataFrame) -> DataFrame:
    """(id, vector) as doubles; rows without an id or a vector of finite numbers are not searched."""
    v = F.transform("vector", lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(finite).select("id", v.alias("vector"))


def _wide(width: int) -> Column:
    """Shorter vectors end in zeros, longer ones are cut: as a dot product over the shorter length has it."""
    return F.slice(F.concat("vector", F.array_repeat(F.lit(0.0), width)), 1, width).alias("vector")


def _by_cell(sizes) -> Column:
    """Into how many parts a cell is cut; one constant to parse, as thousands of literals are slow to plan."""
    return F.get(F.split(F.lit(",".join(str(max(1, -(-int(n) // PART))) for n in sizes)), ",").cast("array<int>"), F.col("cell"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def build(vectors: DataFrame, store: Snapshots, cells: int | None = None, sample: int = SAMPLE, expected: int | None = None) -> int:
    """Publishes the index of (id, vector) as the store's next generation and returns its number.

    Tables: centres (cell, centre, radius, n, probes); entries (vector, id, copies, cell, far), sorted by cell, where id is the
    least of equal vectors; members (entry, id, place), the first MOST_K ids of each entry that has several.
    """
    rows = _good(vectors)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    width = size.width or 0
    rows = rows.select("id", _wide(width))
    chance = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 40)) / float(1 << 40)
    some = rows.where(chance < 2.0 * sample / max(1, size.n)).orderBy(chance, "id").limit(sample).select("vector").toArrow()
    x = np.unique(_matrix(some["vector"], width), axis=0) if some.num_rows else np.zeros((0, width))
    # the square root of the vectors, but few enough at first for queries times probes to grow like the queries
    want = cells or max(1, min(size.n // 4, MOST_CELLS, max(FEWEST_CELLS, round(math.sqrt(size.n)))))
    model = fit_centres(x, min(want, len(x))) if len(x) else Centres(np.zeros((1, width)), 1)

    groups = rows.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    kind = rows.schema["id"].dataType
    shared = rows.sparkSession.sparkContext.broadcast(model.centres)  # MOST_CELLS centres

    def assign(batches):
        for b in (b.slice(i, j - i) for b in batches for i, j in _pieces(b.num_rows, max(width, len(shared.value)))):
            at, far = _nearest(_matrix(b.column(0), width), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32()), pa.array(far)], names=["vector", "id", "copies", "cell", "far"])

    schema = T.StructType([T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("id", kind), T.StructField("copies", T.LongType()), T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])
    placed = groups.mapInArrow(assign, schema)
    folder = store.staged({"entries": placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")})
    placed = store.in_folder(folder, "entries")
    per_cell = placed.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
    centres = rows.sparkSession.createDataFrame([(i, c.tolist(), model.probes) for i, c in enumerate(model.centres)], "cell int, centre array<double>, probes int")
    centres = centres.join(per_cell, "cell", "left").select("cell", "centre", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("n", F.lit(0)).alias("n"), "probes")
    several = placed.where("copies > 1").select("vector", F.col("id").alias("entry"))
    members = rows.join(several, "vector").select("entry", "id")
    # twice, as very many rows may have one vector
    for extra in (["salt"], []):
        place = F.row_number().over(Window.partitionBy("entry", *extra).orderBy("id"))
        members = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("place", place).where(F.col("place") <= MOST_K)
    return store.publish({"centres": centres, "members": members.select("entry", "id", (F.col("place") - 1).alias("place"))}, expected=expected, staged=folder)


class VectorIndex:
    """A published generation of an index; searches of it see that one, whatever is published meanwhile."""

    def __init__(self, store: Snapshots, generation: int | None = None):
        self.store, self.generation = store, generation or store.current()
        cells = sorted(store.read("centres", self.generation).collect(), key=lambda r: r.cell)  # MOST_CELLS rows
        self.model = Centres(np.array([r.centre for r in cells], float).reshape(len(cells), -1), cells[0].probes)
        self.radii, self.sizes = np.array([r.radius for r in cells]), np.array([r.n for r in cells])
        self.width = self.model.centres.shape[1]

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def _probed(self, queries: DataFrame, least: bool) -> DataFrame:
        """(id, vector, cell) for each cell that a query probes; with `least` (a bound to reach, and how many cells were
        probed already), the others that may still hold as much."""
        model, radii, sizes, width = self.model, self.radii, self.sizes, self.width
        shared = self.spark.sparkContext.broadcast((model, radii, sizes))

        def choose(batches):
            model, radii, sizes = shared.value
            for b in (b.slice(i, j - i) for b in batches for i, j in _pieces(b.num_rows, max(width, len(sizes)))):
                x = _matrix(b.column(1), width)
                promise = np.where(sizes > 0, model.promise(x, radii), -np.inf)
                order = np.argsort(-promise, axis=1, kind="stable")
                far = np.arange(promise.shape[1])[None, :] >= model.probes
                value = np.take_along_axis(promise, order, 1)
                # a hair of room, as sums of products are rounded
                room = 1e-9 * (1 + np.abs(value))
                take = (far & (value + room >= b.column(2).to_numpy(zero_copy_only=False)[:, None])) if least else ~far
                row, col = np.nonzero(take & np.isfinite(value))
                for i, j in _pieces(len(row), width):
                    some, cell = row[i:j], order[row[i:j], col[i:j]]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(some), b.column(1).take(some), pa.array(cell, pa.int32())], names=["id", "vector", "cell"])

        return queries.mapInArrow(choose, T.StructType([queries.schema["id"], queries.schema["vector"], T.StructField("cell", T.IntegerType())]))

    def _scored(self, probed: DataFrame, k: int) -> DataFrame:
        """(query_id, entry, copies, score): k entries of each query and part of a cell at most."""
        width, entries = self.width, self.store.read("entries", self.generation)
        asked = {r.cell: r.n for r in probed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # MOST_CELLS rows
        n, nq = _by_cell(self.sizes), _by_cell([asked.get(c, 0) for c in range(len(self.sizes))])
        own = lambda of: F.pmod(F.xxhash64(F.col("id").cast("string")), of).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), of - 1))
        if len(asked) < len(self.sizes):
            entries = entries.where(F.col("cell").isin(sorted(asked)))
        e = entries.select("cell", own(n).alias("part"), every(nq).alias("q_part"), "id", "vector", "copies")
        q = probed.select("cell", every(n).alias("part"), own(nq).alias("q_part"), "id", "vector")
        kind = entries.schema["id"].dataType
        names = ["query_id", "entry", "copies", "score"]

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            rows, cols, kept = [], [], []
            if left.num_rows and right.num_rows:
                x, y, ids = _matrix(left["vector"], width), _matrix(right["vector"], width), right["id"].to_numpy()
                for i, j in _pieces(len(x), len(y)):
                    for at, row in enumerate(x[i:j] @ y.T, i):
                        least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                        some = np.flatnonzero(row >= least)
                        cols.append(some[np.lexsort((ids[some], -row[some]))][:k])
                        rows.append(np.full(len(cols[-1]), at))
                        kept.append(row[cols[-1]])
            r, c = (np.concatenate(x) if x else np.zeros(0, int) for x in (rows, cols))
            return pa.table([left["id"].take(r), right["id"].take(c), right["copies"].take(c), pa.array(np.concatenate(kept) if kept else np.zeros(0))], names=names)

        key = ["cell", "part", "q_part"]
        schema = T.StructType([T.StructField("query_id", probed.schema["id"].dataType), T.StructField("entry", kind), T.StructField("copies", T.LongType()), T.StructField("score", T.DoubleType())])
        return q.groupBy(*key).cogroup(e.groupBy(*key)).applyInArrow(best, schema)

    def search(self, queries: DataFrame, k: int = 10, exact: bool = False) -> DataFrame:
        """(query_id, id, rank, score) for each row of queries (id, vector): the k greatest dot products, equal ones by id.

        Without `exact` some of the true ones may be missing, as measured when the index was built. Queries of equal vectors
        are searched once; those without an id or a finite vector have no rows. k is MOST_K at most.
        """
        if not 0 < k <= MOST_K:
            raise ValueError(f"k must be from 1 to {MOST_K}")
        own = _good(queries)
        wide = own.select("id", _wide(self.width))
        different = wide.groupBy("vector").agg(F.min("id").alias("id")).select("id", "vector")
        found = self._scored(self._probed(different, False), k)
        if exact:
            # the k-th so far, of entries with all their copies
            at = Window.partitionBy("query_id").orderBy(F.col("score").desc())
            so_far = F.sum("copies").over(at.rowsBetween(Window.unboundedPreceding, 0))
            least = found.withColumn("so_far", so_far).where(F.col("so_far") >= k).groupBy(F.col("query_id").alias("id")).agg(F.max("score").alias("least"))
            more = different.join(least, "id", "left").select("id", "vector", F.coalesce("least", F.lit(-math.inf)).alias("least"))
            found = found.unionByName(self._scored(self._probed(more, True), k))
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "entry"))
        found = found.withColumn("n", best).where(F.col("n") <= k)
        members = self.store.read("members", self.generation)
        single = found.where("copies = 1").select("query_id", F.col("entry").alias("id"), "score")
        several = found.where("copies > 1").join(members.where(F.col("place") < k), "entry").select("query_id", "id", "score")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
        ranked = single.unionByName(several).withColumn("n", place).where(F.col("n") <= k)
        # every query of a vector has the rows of the one that was searched
        who = wide.join(different.select(F.col("id").alias("query_id"), "vector"), "vector").select(F.col("id").alias("asked"), "query_id")
        return ranked.join(who, "query_id").select(F.col("asked").alias("query_id"), "id", (F.col("n") - 1).alias("rank"), "score")
