"""Near copies of texts: SimHash candidates of several fingerprints, each verified by the likeness of five-word shingles.

A SimHash of three-word shingles at three bits, as simhash.py has it, misses most copies of which a fifth of the five-word
shingles differ. Fingerprints of single words move less: here a word counts as the root of how often it comes, so that neither the rare
words nor the few that every text of a language has decide alone. SEEDS fingerprints of other hashes of each text go through the
same ball hashing; texts that have fingerprints which are connected at three bits are candidates of each other.

Ball hashing is for texts that may have a near copy. Two texts alike by LEAST share most of their SIEVE least shingle hashes, so a
text of which fewer than SHARED in SIEVE are in any other text is left out: for a copy at a likeness of 0.8 that happens in
0.03 percent of cases, and a passage that many texts share leaves few of them in.

Candidates are verified exactly, by the share of their shingles. A group's core are the shingles that over half of its texts have, and
each text stands for its differences: those that it has beside the core and those of the core that it lacks. Two texts differ in
as many shingles as their differences do, and they are alike by LEAST if that is at most one in NINTH of all their shingles. So
two whose differences are that few together are alike without a comparison: all such are linked through the text that
is nearest to the core. Any other two that are alike have a difference in common. If all texts order their differences
alike, from the rarest up, the first that two have in common comes after no more others than either may have for itself.
Texts of one group that have a difference in common, so far up for at least one other, make a bucket. A family of near copies is
so taken apart by where its texts were edited, which few share, not by what all of them have.

Within a bucket all are compared with some of them, the hubs, and those alike are one class
from then on. Hubs are taken outside the bucket's largest class, MORE times as many in each round, until those that were no
hubs are of one class: then every two texts of different classes were compared. So no link of a group is lost, and texts that are in
one group by chance take no comparisons.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from shoebox.llm.common import Scratch, slices, written
from shoebox.llm.graph import components
from shoebox.llm.simhash import LONG_BYTES, WORD, WORDS_AT_ONCE, _signed, fingerprint_groups

#: Fingerprints of a text; an even number, as one hash of a word gives two.
SEEDS = 4
SHINGLE, LEAST = 5, 0.8
#: Of a and b shingles, two texts alike by LEAST differ in (a + b) / NINTH at most.
NINTH = round((1 + LEAST) / (1 - LEAST))
#: Least shingle hashes of a text, and how many of these others must have.
SIEVE, SHARED = 16, 6
#: Hubs of a bucket in the first round, and times as many in each further one.
HUBS, MORE = 2, 16


def _words(text: str | None) -> Iterator[list[bytes]]:
    data = text.encode("utf-8", "surrogatepass").lower() if text else b""
    if len(data) <= LONG_BYTES:
        yield data.split()
        return
    found = (m[0] for m in WORD.finditer(data))
    while block := list(islice(found, WORDS_AT_ONCE)):
        yield block


def fingerprints_of(text: str | None, seeds: int = SEEDS) -> list[int]:
    """SEEDS signed 64-bit fingerprints; a bit is set if over half of the weight has it; 0 without words."""
    counts: Counter = Counter()
    for words in _words(text):
        counts.update(words)
    if not counts:
        return [0] * seeds
    weights = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    out = []
    for seed in range(seeds // 2):
        ones = np.zeros(128)
        names = iter(counts)
        for at in range(0, len(weights), WORDS_AT_ONCE):
            some = b"".join(xxhash.xxh3_128_digest(w, seed) for w in islice(names, WORDS_AT_ONCE))
            ones += weights[at : at + WORDS_AT_ONCE] @ np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, 16), axis=1)
        bits = np.packbits(2 * ones > weights.sum()).tobytes()
        out += [_signed(int.from_bytes(bits[:8])), _signed(int.from_bytes(bits[8:]))]
    return out


def shingles_of(text: str | None) -> np.ndarray:
    """The different hashes of five words in a row; of all words if there are fewer, even none."""
    parts, last = [], []
    n = 0
    for words in _words(text):
        n += len(words)
        own = last + words
        if len(own) >= SHINGLE:
            parts.append(np.array([xxhash.xxh64_intdigest(b" ".join(s)) for s in zip(*(own[i:] for i in range(SHINGLE)), strict=False)], np.uint64))
        last = own[-(SHINGLE - 1) :]
    if not parts:
        parts = [np.array([xxhash.xxh64_intdigest(b" ".join(last))], np.uint64)]
    return np.unique(np.concatenate(parts)).view(np.int64)


def least_of(text: str | None) -> list[int]:
    """The SIEVE least shingle hashes; the order of the hashes' bits turned round, so that it is not that of anything else."""
    return np.sort(shingles_of(text) * np.int64(-7046029254386353131))[:SIEVE].tolist()


def sieved(least: DataFrame) -> DataFrame:
    """The keys of (key, least) of which enough hashes are in other texts, too."""
    flat = least.select("key", F.size("least").alias("of"), F.explode("least").alias("h"))
    common = flat.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("common"))
    met = flat.join(common, F.col("h") == F.col("common")).groupBy("key", "of").agg(F.count("*").alias("n"))
    return met.where(f"n * {SIEVE} >= of * {SHARED}").select("key")


def _mapped(rows: DataFrame, make, name: str) -> DataFrame:
    """rows (key, text) with text replaced by an array of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([make(t) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["key", name])

    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField(name, T.ArrayType(T.LongType()))]))


def _different(rows: DataFrame, by: str, *within: str, order: Column | None = None) -> DataFrame:
    """rows (by, no) of one value of `by`, that of the least order, for each set of several numbers; sets are told apart by
    their hashes and by the columns `within`, which a value has one of."""
    hashes = [F.bit_xor(F.xxhash64("no", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]
    first = F.min(F.lit(0) if order is None else order).alias("first")
    sets = rows.groupBy(by, *within).agg(F.min("no").alias("a"), F.max("no").alias("b"), F.count("*").alias("n"), *hashes, first).where("a <> b")
    one = sets.groupBy("a", "b", "n", "x1", "x2", *within).agg(F.min_by(by, F.struct("first", by)).alias("g")).select("g")
    return rows.join(one, F.col(by) == F.col("g"), "left_semi")


def _differences(members: DataFrame, sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(group, no, of, off, differences) for members (group, no) and their sets (no, shingles), off being the number of
    differences; and (group, e, rank) of the differences that several of a group have."""
    own = members.join(sets.select("no", "shingles"), "no")
    seen = own.select("group", F.explode("shingles").alias("e")).groupBy("group", "e").agg(F.count("*").alias("n")).where("n > 1")
    seen = scratch.written(seen.join(members.groupBy("group").agg(F.count("*").alias("all")), "group").withColumn("in_core", F.expr("2 * n > all")), "seen")
    core = seen.where("in_core").groupBy("group").agg(F.collect_list("e").alias("core"))
    found = own.join(core, "group", "left").withColumn("core", F.coalesce("core", F.array().cast("array<bigint>")))
    found = found.withColumn("differences", F.concat(F.array_except("shingles", "core"), F.array_except("core", "shingles")))
    found = found.select("group", "no", F.size("shingles").alias("of"), F.size("differences").alias("off"), "differences")
    return scratch.written(found, "differences"), seen.select("group", "e", F.expr("IF(in_core, all - n, n)").alias("rank")).where("rank > 1")


def _near_core(found: DataFrame) -> DataFrame:
    """(g, least, least_of, least_off): the text of each group that may differ in most others from the rest."""
    least = found.groupBy("group").agg(F.max_by(F.struct("no", "of", "off"), F.struct(F.col("of") - NINTH * F.col("off"), "no")).alias("m"))
    return least.select(F.col("group").alias("g"), F.col("m.no").alias("least"), F.col("m.of").alias("least_of"), F.col("m.off").alias("least_off"))


def _buckets(found: DataFrame, several: DataFrame, near: DataFrame) -> DataFrame:
    """(bucket, no, of, off, at): a bucket for each group and difference among the rarest of a text, `at` being how many of
    its differences come before. Buckets of the same texts stand once, the one that comes first. A bucket's number is a
    hash; that two are one by chance costs comparisons."""
    flat = found.select("group", "no", "of", "off", F.explode("differences").alias("e")).join(several, ["group", "e"])
    met = flat.groupBy("group", "no", "of", "off").agg(F.sort_array(F.collect_list(F.struct("rank", "e"))).alias("shared"))
    # the differences that no other text has come first; then those before which no more come than any text of the group leaves
    before = F.col("off") - F.size("shared")
    most = F.least(F.floor(F.col("of") * (1 + 1 / LEAST) / NINTH), F.floor((F.col("of") + F.col("least_of") + NINTH * (F.col("off") - F.col("least_off"))) / (2 * NINTH)))
    met = met.join(near, F.col("group") == F.col("g")).withColumns({"before": before, "taken": (most - before + 1).cast("int")}).where("taken > 0")
    rows = met.select("group", "no", "of", "off", "before", F.posexplode(F.slice("shared", 1, F.col("taken"))).alias("pos", "s"))
    rows = rows.select("group", F.xxhash64("group", "s.e").alias("bucket"), "no", "of", "off", (F.col("before") + F.col("pos")).alias("at"), "s")
    return _different(rows, "bucket", "group", order=F.col("s")).drop("group", "s")


def _may_be_alike() -> Column:
    """Whether a text and a hub, of which `at` and `hub_at` differences come before one that both have, may be alike."""
    both, more = F.col("of") + F.col("hub_of"), NINTH * (F.col("off") - F.col("hub_off"))
    return (2 * NINTH * F.col("at") <= both + more) & (2 * NINTH * F.col("hub_at") <= both - more)


def _mixed(members: DataFrame) -> DataFrame:
    """Members (group, comp, ...) of groups that have several classes."""
    several = members.groupBy("group").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select(F.col("group").alias("g"))
    return members.join(several, F.col("group") == F.col("g"), "left_semi")


def _joined(members: DataFrame, classes: DataFrame) -> DataFrame:
    """members with comp replaced by its class (node, component), where it has one."""
    both = members.join(classes, F.col("comp") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "comp"))
    return both.drop("node", "component")


def _open(members: DataFrame) -> DataFrame:
    """Members (bucket, of, off, at, comp) of buckets that have several classes, without those that _may_be_alike() rules out
    against all texts of the bucket: by the text that leaves most, and by the one that needs least."""
    leaves, needs = F.col("of") - NINTH * F.col("off"), F.expr(f"{2 * NINTH} * at - of - {NINTH} * off")
    ends = members.groupBy(F.col("bucket").alias("g")).agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.max(leaves).alias("left"), F.min(needs).alias("needed")).where("a <> b")
    both = members.join(ends, (F.col("bucket") == F.col("g")) & (needs <= F.col("left")) & (F.col("needed") <= leaves))
    return both.drop("g", "a", "b", "left", "needed")


def _hubs(members: DataFrame, n: int) -> DataFrame:
    """(g, hub, hub_of, hub_off, hub_at, hub_comp): some n members of each bucket outside its largest class; all of these if the bucket has n at most."""
    sizes = members.groupBy("bucket", "comp").agg(F.count("*").alias("size"))
    largest = sizes.groupBy(F.col("bucket").alias("g")).agg(F.max_by("comp", F.struct("size", "comp")).alias("largest"), F.max("size").alias("most"), F.sum("size").alias("all"))
    free = members.join(largest, F.col("bucket") == F.col("g")).where("comp <> largest OR most = 1")
    order = F.xxhash64("no", F.lit(n))
    one = free.groupBy("bucket", F.when(F.col("all") <= n, order).otherwise(F.pmod(order, F.lit(n))).alias("slot")).agg(F.min_by(F.struct("no", "of", "off", "at", "comp"), order).alias("hub"))
    return one.select(F.col("bucket").alias("g"), F.col("hub.no").alias("hub"), *(F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("of", "off", "at", "comp")))


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of numbers of sets (no, shingles) that are alike by LEAST."""
    both = pairs.join(sets.select(F.col("no").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("no").alias("b"), F.col("shingles").alias("set_b")), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(shared >= F.lit(LEAST) * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def _classes(members: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the classes of keys that links between members (group, key) of one group make; sets has (no, key, shingles)."""
    members = members.join(sets.select("key", "no"), "key").select("group", "no")
    differing, several = _differences(scratch.written(_different(members, "group"), "different"), sets, scratch)
    near = scratch.written(_near_core(differing), "near")
    free = differing.join(near, F.col("group") == F.col("g")).where((F.col("no") != F.col("least")) & (NINTH * (F.col("off") + F.col("least_off")) <= F.col("of") + F.col("least_of")))
    links = scratch.written(free.select(F.col("no").alias("u"), F.col("least").alias("v")).distinct(), "free")
    found = components(links, scratch)
    members = scratch.written(_buckets(differing, several, near).withColumn("comp", F.col("no")), "buckets")
    members = scratch.written(_open(scratch.written(_joined(_open(members), found), "joined")), "members")
    n = HUBS
    while not members.isEmpty():
        hubs = scratch.written(_hubs(members, n), "hubs")
        both = members.join(hubs, (F.col("bucket") == F.col("g")) & (F.col("comp") != F.col("hub_comp")) & _may_be_alike())
        # written first, so that few of them are broadcast and the sets stay where they are
        pairs = scratch.written(both.select(F.least("no", "hub").alias("a"), F.greatest("no", "hub").alias("b")).distinct(), "pairs")
        met = scratch.written(_alike(pairs, sets).select(F.col("a").alias("u"), F.col("b").alias("v")), "met")
        if not met.isEmpty():
            links = links.unionByName(met)
            found = components(links, scratch)
        # all of the bucket were compared with its hubs, which need no more
        rest = members.join(hubs, (F.col("bucket") == F.col("g")) & (F.col("no") == F.col("hub")), "left_anti").withColumn("comp", F.col("no"))
        members = scratch.written(_open(scratch.written(_joined(rest, found), "joined")), "members")
        n *= MORE
    name = sets.select("no", "key")
    named = found.join(name.withColumnsRenamed({"no": "node", "key": "node_key"}), "node").join(name.withColumnsRenamed({"no": "component", "key": "component_key"}), "component")
    return named.select(F.col("node_key").alias("node"), F.col("component_key").alias("component"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: int = SEEDS) -> DataFrame:
    """(id_col, component_id) for each row of docs: the smallest id of the documents that links of likeness LEAST or more
    reach, between texts of which two fingerprints are connected at three bits.

    Null and blank texts are alike and link like any other; so do texts of under five words, if they have the same ones.
    Repeated rows stay. Null ids never name a class unless all its ids are null. An empty table gives no rows. Only the two
    named columns are read.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("key", F.md5(F.col("text").cast("binary")))
    with Scratch(docs.sparkSession, "near-copies") as scratch:
        found = written(source.select("id", "key"), "keys")
        # the fingerprints, and behind them the sieve's hashes
        prints = _mapped(source.select("key", "text"), lambda t: [*fingerprints_of(t, seeds), *least_of(t)], "numbers").groupBy("key").agg(F.first("numbers").alias("numbers"))
        prints = scratch.written(prints.select("key", F.slice("numbers", 1, seeds).alias("fps"), F.slice("numbers", seeds + 1, SIEVE).alias("least")), "fingerprints")
        near = scratch.written(sieved(prints.select("key", "least")), "sieved")
        # all fingerprints go through one ball hashing; that two of different hashes meet by chance costs a comparison
        own = scratch.written(prints.join(near, "key", "left_semi").select("key", F.explode("fps").alias("fp")), "own")
        groups = fingerprint_groups(own.select("fp").distinct(), scratch).withColumnRenamed("fp", "own")
        members = own.join(groups, F.col("fp") == F.col("own")).select("group", "key").distinct().withColumn("comp", F.col("key"))
        members = scratch.written(_mixed(members).select("group", "key"), "groups")
        texts = source.select("key", "text").join(members.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
        sets = scratch.written(_mapped(texts, shingles_of, "shingles").withColumn("no", F.monotonically_increasing_id()), "shingles")
        named = prints.select(F.col("key").alias("own"), F.col("key").alias("comp"))
        named = _joined(named, _classes(members, sets, scratch))
        least = found.join(named, F.col("key") == F.col("own")).groupBy("comp").agg(F.min("id").alias("component_id"))
        named = written(named.join(least, "comp").select("own", "component_id"), "components")
    return found.join(named, F.col("key") == F.col("own")).select(F.col("id").alias(id_col), "component_id")
