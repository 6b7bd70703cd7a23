"""Product codes of vectors: each of PARTS equal parts of a vector is replaced by the number of the nearest entry of that
part's codebook, and the codebooks are fit to all vectors, exactly, in whole numbers.

Each round broadcasts a kd-tree of each codebook (ENTRIES entries at most). Tasks search it by branch and bound and add up
the parts of each entry; the sums of all tasks, PARTS * ENTRIES rows, make the next codebooks. No floats are summed, so the
result does not depend on how rows are dealt or in which order tasks end.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shoebox.llm.common import table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Up to so many labels their sums are broadcast; beyond, they are joined by shuffles.
MOST_LABELS = 100_000
#: Sums are added up in pieces of so many bits, as many as the components' type may need.
PIECE = 32
PIECES = {"float": 5}
MORE_PIECES = 34
ROWS_AT_ONCE = 16_384


def _fits(d: int) -> int:
    """The size below which squared distances of d components stay within 64 bits."""
    return int((2.0**61 / max(1, d)) ** 0.5 / 2)


class KdTree:
    """A codebook's entries as a tree; each node knows the box around its entries, and a leaf is one entry."""

    def __init__(self, entries: np.ndarray, numbers: np.ndarray | None = None):
        numbers = np.arange(len(entries)) if numbers is None else numbers
        own = entries[numbers]
        self.low, self.high, self.number, self.sides = own.min(0), own.max(0), int(numbers[0]), None
        if len(numbers) > 1:
            wide = int(np.argmax(self.high - self.low)) if entries.shape[1] else 0
            order = numbers[np.argsort(own[:, wide], kind="stable")] if entries.shape[1] else numbers
            self.sides = (KdTree(entries, order[: len(order) // 2]), KdTree(entries, order[len(order) // 2 :]))

    def bound(self, x: np.ndarray) -> np.ndarray:
        """The squared distance of each row to the box; to the entry, for a leaf."""
        gap = np.maximum(np.maximum(self.low - x, x - self.high), 0)
        return (gap * gap).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest entry, the least one of equals; its squared distance) for each row."""
        best = np.full(len(x), 1 << 6000 if x.dtype == object else np.iinfo(np.int64).max, x.dtype)
        at = np.full(len(x), len(x) and 1 << 30, np.int64)
        if len(x):
            self._visit(x, np.arange(len(x)), self.bound(x), best, at)
        return at, best

    def _visit(self, x: np.ndarray, rows: np.ndarray, bound: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        # an equal bound may hide an equal entry with a lower number
        open_ = np.asarray(bound <= best[rows], bool)
        rows, bound = rows[open_], bound[open_]
        if not len(rows):
            return
        if self.sides is None:
            take = np.asarray((bound < best[rows]) | (self.number < at[rows]), bool)
            best[rows[take]], at[rows[take]] = bound[take], self.number
            return
        left, right = self.sides
        own = x[rows]
        a, b = left.bound(own), right.bound(own)
        first = np.asarray(a <= b, bool)
        for near, far, side, da, db in ((left, right, first, a, b), (right, left, ~first, b, a)):
            near._visit(x, rows[side], da[side], best, at)
            far._visit(x, rows[side], db[side], best, at)


def quantised(values: np.ndarray, limit: int) -> np.ndarray:
    """floor(SCALE * x), as 64-bit numbers where all are below the limit, else as Python's."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if not scaled.size or np.abs(scaled).max() < limit:
        return scaled.astype(np.int64)
    exact = np.floor(values.astype(np.longdouble) * SCALE)
    return np.array([int(x) for x in exact.ravel()], object).reshape(exact.shape)


def part_bounds(size: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """(from, to) of each part; where parts do not divide the size, the first ones are one longer."""
    sizes = [size // parts + (i < size % parts) for i in range(parts)]
    return [(sum(sizes[:i]), sum(sizes[: i + 1])) for i in range(parts)]


def _matrix(column: pa.Array, size: int, limit: int) -> np.ndarray:
    return quantised(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size), limit)


class Codebooks:
    """entries: for each part an array of (entry, place) of whole numbers."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = entries
        self.size = sum(e.shape[1] for e in entries)

    def trees(self) -> list[KdTree]:
        return [KdTree(e) for e in self.entries]

    def digest(self) -> str:
        return sha256(",".join(str(int(x)) for e in self.entries for x in e.ravel()).encode()).hexdigest()


def _whole(rows: list[list[int]], width: int) -> np.ndarray:
    """Rows of whole numbers as an array; of 64-bit numbers where these suffice."""
    fits = all(abs(x) < _fits(width) for r in rows for x in r)
    return np.array(rows, np.int64 if fits else object).reshape(len(rows), width)


def _joined(x: np.ndarray, tree: KdTree) -> tuple[np.ndarray, np.ndarray]:
    """nearest(), with both sides as Python numbers if one is."""
    return tree.nearest(x.astype(object) if tree.low.dtype == object else x)


def kept(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Rows with a vector of finite components only."""
    good = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & good)


def _sums(rows: DataFrame, books: Codebooks, kind: str) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) to the number of parts that are nearest to it and the sum of these, place by place; of one round."""
    spark, size = rows.sparkSession, books.size
    trees, bounds = spark.sparkContext.broadcast(books.trees()), part_bounds(size, len(books.entries))
    n_entries, limit, pieces = len(books.entries[0]), _fits(max(b - a for a, b in bounds)), PIECES.get(kind, MORE_PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(bounds), n_entries), np.int64)
        totals = [np.zeros((n_entries, b - a), object) for a, b in bounds]
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                x = _matrix(batch.column(0).slice(k, ROWS_AT_ONCE), size, limit)
                for p, (a, b) in enumerate(bounds):
                    own = x[:, a:b]
                    at, _ = _joined(own, trees.value[p])
                    counts[p] += np.bincount(at, minlength=n_entries)
                    for e in np.unique(at):
                        totals[p][e] += own[at == e].sum(0)
        out = []
        for p, (a, b) in enumerate(bounds):
            for e in np.flatnonzero(counts[p]).tolist():
                for place in range(max(1, b - a)):
                    s, cut = int(totals[p][e][place]) if b > a else 0, []
                    for _ in range(pieces - 1):
                        cut.append(s & ((1 << PIECE) - 1))
                        s >>= PIECE
                    out.append((p, e, place, int(counts[p][e]), *cut, s))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    names = ["part", "entry", "place", "n", *(f"s{i}" for i in range(pieces))]
    found = rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in names)).groupBy("part", "entry", "place").agg(*(F.sum(n).alias(n) for n in names[3:]))
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in sorted(found.collect(), key=lambda r: r[:3]):  # PARTS * ENTRIES rows a place of a part
        out.setdefault((r.part, r.entry), (r.n, []))[1].append(sum(int(r[4 + i]) << (PIECE * i) for i in range(pieces)))
    trees.destroy()
    return out


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks from all good vectors; None without any.

    They start as the parts of the first vectors: by id, null ids last, of equal ids by their components. Vectors of another
    length than the first one's are left out. With fewer vectors than entries, there are as many entries.
    """
    rows = kept(vectors.select(id_col, vector_col), vector_col)
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    head = rows.orderBy(F.col(id_col).asc_nulls_last(), F.col(vector_col)).limit(1).collect()
    if not head:
        return None
    size = len(head[0][1])
    own = rows.where(F.size(vector_col) == size)
    starts = [r[0] for r in own.orderBy(F.col(id_col).asc_nulls_last(), F.col(vector_col)).limit(entries).select(vector_col).collect()]
    bounds = part_bounds(size, parts)
    first = quantised(np.array(starts, np.float64).reshape(len(starts), size), _fits(1))
    books = Codebooks([_whole([[int(v) for v in r[a:b]] for r in first], b - a) for a, b in bounds])
    for _ in range(rounds):
        sums = _sums(own.select(vector_col), books, kind)
        books = Codebooks([_whole([[s // sums[p, e][0] for s in sums[p, e][1]][: b - a] if (p, e) in sums else [int(v) for v in books.entries[p][e]] for e in range(len(starts))], b - a) for p, (a, b) in enumerate(bounds)])
    return books


def encoded(vectors: DataFrame, books: Codebooks, vector_col: str = "embedding", carry: tuple[str, ...] = ("vec_id", "label")) -> DataFrame:
    """(carry..., code, error): two hex digits for each part, and the squared distance of the vector to what they stand for,
    null beyond 64 bits. Rows without a good vector of the codebooks' length go; repeated rows stay."""
    source = kept(vectors.select(F.col(vector_col).alias("__vector"), *carry), "__vector").where(F.size("__vector") == books.size)
    trees, bounds, size = vectors.sparkSession.sparkContext.broadcast(books.trees()), part_bounds(books.size, len(books.entries)), books.size
    limit = _fits(max(b - a for a, b in bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(k, ROWS_AT_ONCE)
                x = _matrix(batch.column(0), size, limit)
                codes, errors = np.empty((len(x), len(bounds)), np.uint8), np.zeros(len(x), object)
                for p, (a, b) in enumerate(bounds):
                    at, far = _joined(x[:, a:b], trees.value[p])
                    codes[:, p] = at
                    errors = errors + far
                flat = codes.tobytes().hex()
                width = 2 * len(bounds)
                texts = [flat[i : i + width] for i in range(0, len(flat), width)]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([int(e) if e < 1 << 63 else None for e in errors], pa.int64())], names=[*carry, "code", "error"])

    return source.mapInArrow(run, T.StructType([*(T.StructField(c, source.schema[c].dataType) for c in carry), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def with_label_error(codes: DataFrame, label_col: str = "label") -> DataFrame:
    """codes with label_error, the sum of error over equal labels, nulls together; null where no error or beyond 64 bits.

    One row a label is broadcast while these are MOST_LABELS at most; more labels are joined by a shuffle, where Spark may
    split a frequent one.
    """
    sums = codes.groupBy(F.col(label_col).alias("__label")).agg(F.expr("try_cast(sum(CAST(error AS DECIMAL(38, 0))) AS BIGINT)").alias("label_error"))
    sums = written(sums, "label-errors")
    few = len(sums.limit(MOST_LABELS + 1).select(F.lit(1)).collect()) <= MOST_LABELS
    return codes.join(F.broadcast(sums) if few else sums, F.col(label_col).eqNullSafe(F.col("__label"))).drop("__label")


def op13_vector_codes(spark, sf_dir):
    """Codes of all embeddings; rows whose vector is null or holds a null, NaN or infinity are dropped. An empty table, or
    one without a good vector, gives no rows; repeated rows are coded alike."""
    vectors = table(spark, sf_dir, "embeddings")
    books = train(vectors)
    if books is None:
        return vectors.where("false").select("vec_id", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    found = with_label_error(written(encoded(vectors, books), "codes"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _oracle() -> str:
    """Each round as tables of its own: (a) the nearest entry of each part, (c) the entries after it."""
    nearest = "SELECT p.vec_id, p.label, p.part, any_value(p.x) AS x, min({'d': CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(p.x, c.x)]) AS BIGINT), 'e': c.e}) AS m FROM p JOIN c%d c ON p.part = c.part GROUP BY p.vec_id, p.label, p.part"
    rounds = [
        f"a{r} AS MATERIALIZED ({nearest % r}), c{r + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT part, e, list(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END ORDER BY k) AS x FROM "
        f"(SELECT part, m.e AS e, k, sum(x[k]) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(x) + 1)) AS k FROM a{r}) GROUP BY part, m.e, k) GROUP BY part, e) m ON c.part = m.part AND c.e = m.e)"
        for r in range(ROUNDS)
    ]
    return f"""
WITH kept AS (SELECT vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) t(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x FROM p WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
{", ".join(rounds)},
a{ROUNDS} AS MATERIALIZED ({nearest % ROUNDS}),
codes AS (SELECT vec_id, label, string_agg(format('{{:02x}}', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, e, k)) FROM (SELECT part, e, unnest(range(1, len(x) + 1)) AS k, unnest(x) AS v FROM c{ROUNDS})) AS codebooks_sha256
FROM codes
"""


ORACLE = _oracle()
