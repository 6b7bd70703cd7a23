"""SimHash near-duplicates: meet-in-the-middle ball hashing of 64-bit fingerprints, to 3 differing bits.

Every different fingerprint emits itself and its 64 variants of one flipped bit; two that are within two bits share a
variant and meet there. Three is odd, so of a pair with three differing bits one must emit a variant of two flips.

These would be 2016 for each fingerprint, so only those are emitted that can meet one of another group. A sieve tells:
with one third of the bits erased, a pair of three differing bits is within two bits in what remains if the third has
one of the three (or is equal there if it has all of them), so both have one cell (what remains, with one flip or none)
in common. In cells that more than one group shares, first all members within three bits of the least are linked; what
still is of more than one group then emits its variants of that cell: as they are, and with a flip of an erased bit (two
flips where nothing else differs).

At a point, one flip away at most are the singles, two flips away the others. All are drawn to the least single as a
star, not as pairs, and each link is verified.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from shoebox.llm.common import Scratch, slices, spread, table, written
from shoebox.llm.graph import components

SEED = 42
SHINGLE = 3
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Texts above this are cut into words piece by piece.
LONG_BYTES = 4_000_000
WORDS_AT_ONCE = 100_000
#: The bits of the three parts that the sieve erases.
PARTS = ((0, 22), (22, 43), (43, 64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(data: bytes) -> Iterator[list[bytes]]:
    if len(data) <= LONG_BYTES:
        yield data.split()
        return
    found = (m[0] for m in WORD.finditer(data))
    last: list[bytes] = []
    while block := list(islice(found, WORDS_AT_ONCE)):
        yield last + block
        last = (last + block)[-(SHINGLE - 1) :]


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    h = xxhash.xxh64_intdigest
    for words in _blocks(text.encode("utf-8", "surrogatepass").lower() if text else b""):
        if len(words) >= SHINGLE:
            hashes = [h(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(SHINGLE)), strict=False)]
        elif n == 0 and words:
            hashes = [h(b" ".join(words), SEED)]
        else:
            continue
        n += len(hashes)
        ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return _signed(sum(1 << int(i) for i in np.flatnonzero(2 * ones > n)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp): one row a document; null and blank texts have 0."""
    source = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.int64())], names=[id_col, "fp"])

    return source.mapInArrow(run, T.StructType([source.schema[id_col], T.StructField("fp", T.LongType())]))


def _flips(bits: range) -> list[int]:
    return [_signed(1 << i) for i in bits]


def _variants(x: Column, masks: list[int]) -> Column:
    """An array of x with each mask's bits flipped."""
    return F.transform(F.lit(masks).cast("array<bigint>"), lambda m: x.bitwiseXOR(m))


def _stars(points: DataFrame) -> DataFrame:
    """Links (u, v) of each point's members to its least single; points: (point, fp, single)."""
    at = Window.partitionBy("point")
    met = points.withColumn("hub", F.min(F.when(F.col("single"), F.col("fp"))).over(at)).where("hub <> fp")
    met = met.select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()
    return met.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 3)


def _cells(part: int) -> Column:
    """An array of (part, cell, exact): what remains of fp without the part's bits, and that with one flip."""
    a, b = PARTS[part]
    keep = _signed(((1 << 64) - 1) ^ ((1 << b) - (1 << a)))
    kept = F.col("fp").bitwiseAND(F.lit(keep))
    flipped = _variants(kept, _flips([i for i in range(64) if not a <= i < b]))
    cell = lambda v, exact: F.struct(F.lit(part).alias("part"), v.alias("cell"), F.lit(exact).alias("exact"))
    return F.concat(F.array(cell(kept, True)), F.transform(flipped, lambda v: cell(v, False)))


def _by_part(masks: list[list[int]], of: Column) -> Column:
    """The array of masks that the number `of` names."""
    found = F.lit(None).cast("array<bigint>")
    for n, own in enumerate(masks):
        found = F.when(of == n, F.lit(own).cast("array<bigint>")).otherwise(found)
    return found


def _erased(masks: list[int], of: Column) -> Column:
    found = F.lit(0).cast("bigint")
    for n, mask in enumerate(masks):
        found = F.when(of == n, F.col("fp").bitwiseAND(F.lit(mask))).otherwise(found)
    return found


def _far_points(shared: DataFrame) -> DataFrame:
    """(point, fp, single) for members (part, cell, exact, fp, group, exact_mixed) of cells that several groups share."""
    halves = [h for a, b in PARTS for h in ((a, (a + b) // 2), ((a + b) // 2, b))]
    base = shared.withColumn("base", F.col("cell").bitwiseOR(_erased([_signed((1 << b) - (1 << a)) for a, b in PARTS], F.col("part"))))
    flip = lambda masks, of: F.explode(F.transform(_by_part(masks, of), lambda m: F.col("base").bitwiseXOR(m))).alias("point")

    equal = base.withColumn("half", F.explode(F.array(F.col("part") * 2, F.col("part") * 2 + 1)))
    equal = equal.withColumn("value", _erased([_signed((1 << b) - (1 << a)) for a, b in halves], F.col("half")))
    at = Window.partitionBy("cell", "half", "value")
    equal = equal.withColumns({"least": F.min("group").over(at), "most": F.max("group").over(at)}).where("least <> most")
    other = F.col("half") + 1 - F.col("half") % 2 * 2
    near = equal.select(F.col("base").alias("point"), "fp", F.lit(True).alias("single")).unionByName(
        equal.select(flip([[_signed(1 << i) for i in range(a, b)] for a, b in halves], other), "fp", F.lit(False).alias("single"))
    )
    inside = base.where("exact AND exact_mixed")
    ones = [[0, *(_signed(1 << i) for i in range(a, b))] for a, b in PARTS]
    twos = [[_signed(1 << i | 1 << j) for i in range(a, b) for j in range(i + 1, b)] for a, b in PARTS]
    part = F.col("part")
    return near.unionByName(inside.select(flip(ones, part), "fp", F.lit(True).alias("single"))).unionByName(inside.select(flip(twos, part), "fp", F.lit(False).alias("single"))).distinct()


def _regrouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with their group replaced by its component (node, component), where it has one."""
    both = rows.join(groups, F.col("group") == F.col("node"), "left").withColumn("group", F.coalesce("component", "group"))
    return both.drop("node", "component")


def _shared_cells(members: DataFrame) -> DataFrame:
    """Members of cells that more than one group shares; exact_mixed: so do the cell's exact members."""
    at = Window.partitionBy("part", "cell")
    exact = F.when(F.col("exact"), F.col("group"))
    wide = members.withColumns({"least": F.min("group").over(at), "most": F.max("group").over(at), "e_least": F.min(exact).over(at), "e_most": F.max(exact).over(at)})
    wide = wide.where("least <> most").withColumn("exact_mixed", F.coalesce(F.col("e_least") != F.col("e_most"), F.lit(False)))
    return wide.drop("least", "most", "e_least", "e_most")


def fingerprint_groups(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, group) for different fingerprints (fp): group is the least fingerprint reachable by links of 3 bits or fewer."""
    near = spread(fps, "fp").select("fp", F.explode(_variants(F.col("fp"), [0, *_flips(range(64))])).alias("point"), F.lit(True).alias("single"))
    first = components(_stars(near), scratch)
    known = fps.withColumn("group", F.col("fp"))
    known = scratch.written(_regrouped(known, first), "groups")

    cells = spread(known, "fp").select("fp", "group", F.explode(F.concat(*(_cells(p) for p in range(len(PARTS))))).alias("c")).select("fp", "group", "c.*")
    shared = scratch.written(_shared_cells(cells).drop("exact_mixed"), "shared")
    hub = F.min(F.struct("fp", "group")).over(Window.partitionBy("part", "cell"))
    met = shared.withColumn("hub", hub).where((F.col("hub.group") != F.col("group")) & (F.bit_count(F.col("hub.fp").bitwiseXOR(F.col("fp"))) <= 3))
    second = scratch.written(components(met.select(F.col("group").alias("u"), F.col("hub.group").alias("v")), scratch), "second")

    left = scratch.written(_shared_cells(_regrouped(shared, second)), "left")
    ends = left.select("fp", "group").distinct()
    a, b = ends.select(F.col("fp").alias("a"), F.col("group").alias("ga")), ends.select(F.col("fp").alias("b"), F.col("group").alias("gb"))
    between = _stars(_far_points(left)).join(a, F.col("u") == F.col("a")).join(b, F.col("v") == F.col("b"))
    third = components(between.select(F.col("ga").alias("u"), F.col("gb").alias("v")), scratch)
    return _regrouped(_regrouped(known, second), third)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component_id) for each row of docs; component_id is the smallest id of the linked group.

    Blank and null texts share fingerprint 0 and link like any other. Repeated rows stay. Null ids never name a group
    unless all its ids are null. An empty table gives no rows. Only the two named columns are read.
    """
    found = written(fingerprints(docs, id_col, text_col).select(F.col(id_col).alias("id"), "fp"), "fingerprints")
    with Scratch(docs.sparkSession, "groups") as scratch:
        least = scratch.written(found.groupBy("fp").agg(F.min("id").alias("id")), "least")
        groups = scratch.written(fingerprint_groups(least.select("fp"), scratch), "fp-groups")
        named = groups.join(least, "fp").groupBy("group").agg(F.min("id").alias("component_id"))
        named = written(groups.join(named, "group").select(F.col("fp").alias("own"), "component_id"), "components")
    return found.join(named, F.col("fp") == F.col("own")).select(F.col("id").alias(id_col), "fp", "component_id")


def op6_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and class of every text. Null and blank texts have fingerprint zero and link like any other; repeated rows
    stay; the least id names a class, whatever the order; an empty table gives no rows."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
