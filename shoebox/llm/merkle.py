"""A Merkle manifest of a table: one root over all rows, and for each row what it takes to check that row alone.

Rows are leaves, in order within their source. While more than one node of a source remains, every FANOUT consecutive ones
(the last run may be shorter, even of one) become the digest of their digests; what remains is the source's subroot, and
the subroots, in order of their sources, become the root in the same way.

The tree is not built level by level: FANOUT**LEVELS consecutive nodes of a tree are a superblock, whose levels are
reduced together in one group of applyInPandas. The superblocks' roots, so many times fewer, are reduced in the same way
until each tree has one, and a proof is a superblock's own followed by that of its root. No group is larger than a
superblock, so a source with a third of all rows is reduced by as many tasks as it has superblocks.

A proof has two digest strings for each level: the run's siblings to the left and to the right of the node. So a node's
parent is the digest of left + node + right, whatever the fanout.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from shoebox.llm.common import Scratch, table, written

FANOUT, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(name: str) -> Column:
    """'-' for null, else the value's UTF-8 length, ':' and the value; no two rows have one concatenation."""
    value = F.col(f"`{name}`").cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(names: tuple[str, ...] = FIELDS, **replaced: Column) -> Column:
    """The digest of a row's fields; replaced: columns to take instead of a field's text."""
    values = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) if (c := replaced.get(n)) is not None else field(n) for n in names]
    return F.sha2(F.concat(*values), 256)


def folded(node: Column, lefts: Column, rights: Column) -> Column:
    """The root that a node leads to with the siblings of a proof."""
    return F.aggregate(F.zip_with(lefts, rights, lambda left, right: F.struct(left.alias("l"), right.alias("r"))), node, lambda at, s: F.sha2(F.concat(s["l"], at, s["r"]), 256))


def proof_digest(lefts: Column, rights: Column) -> Column:
    """The digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.zip_with(lefts, rights, lambda left, right: F.concat(left, right))), 256)


def _reduced(digests: list[str], levels: int, fanout: int) -> tuple[str, list[list[str]], list[list[str]]]:
    """The one node that a block becomes in so many levels, and each of its nodes' siblings, level by level."""
    lefts, rights = [[] for _ in digests], [[] for _ in digests]
    width = 1
    for _ in range(levels):
        runs = [digests[i : i + fanout] for i in range(0, len(digests), fanout)]
        sides = [("".join(run[:k]), "".join(run[k + 1 :])) for run in runs for k in range(len(run))]
        for i in range(len(lefts)):
            left, right = sides[i // width]
            lefts[i].append(left)
            rights[i].append(right)
        digests, width = [sha256("".join(run).encode()).hexdigest() for run in runs], width * fanout
    return digests[0], lefts, rights


def _superblocks(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """nodes: (tree, i, n, digest, ...). Each superblock is reduced by as many levels as its tree still has, `levels` at
    most. Adds (block, lefts, rights, top); further columns are passed on."""
    at = nodes.withColumns({"height": _height(F.col("n"), fanout), "block": F.floor(F.col("i") / fanout**levels).cast("bigint")})

    def collapse(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("i")
        top, lefts, rights = _reduced(own["digest"].tolist(), min(levels, int(own["height"].iloc[0])), fanout)
        return own.drop(columns="height").assign(lefts=lefts, rights=rights, top=top)

    schema = T.StructType([f for f in at.schema if f.name != "height"]).add("lefts", T.ArrayType(T.StringType())).add("rights", T.ArrayType(T.StringType())).add("top", T.StringType())
    return at.groupBy("tree", "block").applyInPandas(collapse, schema)


def _height(n: Column, fanout: int) -> Column:
    """How often n nodes are reduced until one is left: the powers of the fanout below n."""
    powers = F.lit([fanout**k for k in range(64) if fanout**k < 1 << 62]).cast("array<bigint>")
    return F.size(F.filter(powers, lambda p: p < n))


def trees(nodes: DataFrame, scratch: Scratch, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """nodes: (tree, i, n, digest, ...), i from 0 to n - 1 in each tree. Returns the nodes with (block, lefts, rights), their
    proofs within a superblock; and for each superblock (tree, block, lefts, rights, root): its root's proof from there
    on, and what the tree ends in.

    The superblocks' roots of a round are a table, 1 / fanout**levels of the round before.
    """
    size = fanout**levels
    own = written(_superblocks(nodes, fanout, levels), "superblocks")
    tops = own.where(F.col("i") == F.col("block") * size).select("tree", "block", "n", "top")
    none = F.array().cast("array<string>")
    done = tops.where(F.col("n") <= size).select("tree", "block", none.alias("lefts"), none.alias("rights"), F.col("top").alias("root"))
    above = tops.where(F.col("n") > size).select("tree", F.col("block").alias("i"), F.ceil(F.col("n") / size).cast("bigint").alias("n"), F.col("top").alias("digest"))
    if above.isEmpty():
        return own, done
    lower, upper = trees(scratch.written(above, "tops"), scratch, fanout, levels)
    both = whole(lower, upper).select("tree", F.col("i").alias("block"), "lefts", "rights", "root")
    return own, done.unionByName(both)


def whole(own: DataFrame, above: DataFrame) -> DataFrame:
    """The nodes that trees() returned, each with its whole proof, and with what `above` has besides."""
    upper = above.withColumnsRenamed({"tree": "__tree", "block": "__block", "lefts": "__lefts", "rights": "__rights"})
    both = own.join(upper, (F.col("tree") == F.col("__tree")) & (F.col("block") == F.col("__block")))
    return both.withColumns({c: F.concat(c, f"__{c}") for c in ("lefts", "rights")}).drop("__tree", "__block", "__lefts", "__rights")


def _indexed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with i, their place from 0 within their tree, and n, the tree's size; rows: (tree, order...), in that order.

    Rows are sorted in ranges of the whole order, and numbered within. A tree's rows are together in a range, so only one
    row for each tree and range is needed to know how many of its rows stand in earlier ranges.
    """
    order = [F.col(c) for c in rows.columns]
    found = scratch.written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    found = found.withColumn("range", F.shiftright("at", 33))
    within = found.groupBy("tree", "range").agg(F.count("*").alias("own"), F.min("at").alias("first"))
    of_tree = Window.partitionBy("tree")  # one row a range
    before = F.coalesce(F.sum("own").over(of_tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = within.select(F.col("tree").alias("t"), F.col("range").alias("r"), (before - F.col("first")).alias("shift"), F.sum("own").over(of_tree).alias("n"))
    both = found.join(within, (F.col("tree") == F.col("t")) & (F.col("range") == F.col("r")))
    return scratch.written(both.withColumn("i", F.col("at") + F.col("shift")).drop("t", "r", "range", "at", "shift"), "indexed")


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = FIELDS, fanout: int = FANOUT, levels: int = LEVELS, **altered: Column) -> DataFrame:
    """(id_col, source_col, leaf, altered_leaf, lefts, rights, subroot, root), one row for each row of docs.

    Leaves of a source ascend by id, a null id first; repeated ids by their leaves, so equal rows have neighbouring
    places. A null source is a source of its own and comes first, others in the order of their UTF-8 bytes. altered:
    columns in place of a field's text for altered_leaf, as a copy of the table has them; without any it equals leaf. An
    empty table gives no rows. Only the named fields are read, and texts only once.
    """
    names = tuple(dict.fromkeys((id_col, source_col, *fields)))
    source = docs.select(*(F.col(f"`{n}`") for n in names))
    tree = F.when(F.col(f"`{source_col}`").isNull(), "").otherwise(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")))
    # `copy` spreads rows that are equal over ranges
    leaves = source.select(tree.alias("tree"), F.col(f"`{id_col}`").alias("id"), leaf(fields).alias("leaf"), leaf(fields, **altered).alias("altered_leaf"), F.monotonically_increasing_id().alias("copy"))
    with Scratch(docs.sparkSession, "merkle") as scratch:
        rows = _indexed(scratch.written(leaves, "leaves"), scratch).drop("copy").withColumnRenamed("leaf", "digest")
        own, above = trees(rows, scratch, fanout, levels)
        subroots = above.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("digest"))
        sources = whole(*trees(_indexed(scratch.written(subroots, "subroots"), scratch), scratch, fanout, levels))
        sources = sources.select("source", F.col("digest").alias("subroot"), F.col("root").alias("top"), F.col("lefts").alias("up_lefts"), F.col("rights").alias("up_rights"))
        # one row a superblock meets that of its source; only then do all rows meet that of their superblock
        above = above.join(sources, F.col("tree") == F.col("source"))
        longer = [F.concat(c, f"up_{c}").alias(c) for c in ("lefts", "rights")]
        above = written(above.select("tree", "block", *longer, "subroot", F.col("top").alias("root")), "above")
    name = F.when(F.col("tree") != "", F.substring("tree", 2, (1 << 31) - 1)).cast(docs.schema[source_col].dataType)
    return whole(own, above).select(F.col("id").alias(id_col), name.alias(source_col), F.col("digest").alias("leaf"), "altered_leaf", "lefts", "rights", "subroot", "root")


def op11_merkle_manifest(spark, sf_dir):
    """The manifest of documents, checked against a copy that lost its line feeds in every document whose id has an even
    crc32 (null texts and rows with a null id stay as they are)."""
    even = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    copy = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = manifest(table(spark, sf_dir, "documents"), text=copy)
    found = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("lefts"), F.col("rights")).alias("proof_sha256"), folded(F.col("altered_leaf"), F.col("lefts"), F.col("rights")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_field_sql(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"


#: The whole tree, level by level, of all sources, then that of the subroots; the proofs by joins with each level. The
#: remainder of crc32 by its definition: bytes are xor-ed in (values from 0), each followed by eight shifts (-1).
ORACLE = f"""
WITH RECURSIVE
d AS (SELECT *, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
    lambda a, o: CASE WHEN o >= 0 THEN xor(a, o) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS crc FROM documents),
leaves AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS tree, {_leaf_sql("text")} AS leaf,
    {_leaf_sql("CASE WHEN (crc & 1) = 1 THEN replace(text, chr(10), '') ELSE text END")} AS altered,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
t AS (SELECT 0 AS level, tree, i, n, leaf AS digest FROM leaves
  UNION ALL SELECT level + 1, tree, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY level, tree, i // 3, n),
subs AS (SELECT tree, level, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, i, n, digest FROM subs
  UNION ALL SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 3, n),
low AS (SELECT a.tree, a.level, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
  FROM t a JOIN t b ON a.tree = b.tree AND a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.tree, a.level, a.i),
high AS (SELECT a.level, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
  FROM u a JOIN u b ON a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.level, a.i),
steps AS (SELECT doc_id, low.level, l, r FROM leaves JOIN low ON leaves.tree = low.tree AND low.i = leaves.i // CAST(pow(3, low.level) AS BIGINT)
  UNION ALL SELECT doc_id, subs.level + high.level, l, r FROM leaves JOIN subs USING (tree) JOIN high ON high.i = subs.i // CAST(pow(3, high.level) AS BIGINT)),
proofs AS (SELECT doc_id, string_agg(l || r, '' ORDER BY level) AS proof FROM steps GROUP BY doc_id),
f AS (SELECT doc_id, 0 AS level, altered AS node FROM leaves
  UNION ALL SELECT f.doc_id, f.level + 1, sha256(l || node || r) FROM f JOIN steps ON f.doc_id = steps.doc_id AND f.level = steps.level),
ends AS (SELECT doc_id, max_by(node, level) AS folded_root FROM f GROUP BY doc_id)
SELECT doc_id, leaf, subs.digest AS subroot, (SELECT digest FROM u WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = (SELECT digest FROM u WHERE n = 1) AS verified
FROM leaves JOIN subs USING (tree) LEFT JOIN proofs USING (doc_id) JOIN ends USING (doc_id)
"""
