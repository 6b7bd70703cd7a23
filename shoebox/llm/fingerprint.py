"""Document fingerprints: bottom-k sketches of word shingle hashes, with DataFrame functions only.

A sketch is the sorted array of the k least different 64-bit hashes of a text's shingles. Hashes are compared as signed
numbers, so the least possible one stands for 0 and the greatest for 1. Sketches of parts merge into that of the whole;
every text is sketched so, PART_WORDS words at a time, and each part merges into the sketch of those before. Sketches give estimates of resemblance, containment and
the number of different shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shoebox.llm.common import az_folded, cut_points, range_of, table

#: Hashes in a sketch, words in a shingle. The standard error of a resemblance of 1/2 is 1/(2 sqrt(K)) = 0.044.
K, SHINGLE = 128, 5
#: Words of one part of a text.
PART_WORDS = 8_192
BLANKS = r"[ \t-\r]+"
#: Rows to one range of ids, and the greatest number of such ranges (more rows go to each then).
RANGE_ROWS, RANGES = 250, 16_384


def split_words(text: Column) -> Column:
    """The words, cut at ASCII blanks; no words for null and blank texts."""
    words = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")), BLANKS)
    return F.filter(words, lambda w: w != "")


def words_of(text: Column) -> Column:
    """Images of the words that are the same for words that differ in the case of A-Z only."""
    return split_words(az_folded(text))


def _least(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def _sketch(w: Column, k: int, shingle: int, part_words: int) -> Column:
    """The sketch of a text's word hashes w, part by part."""
    n = F.size(w)
    shingles = F.greatest(n - (shingle - 1), F.least(n, F.lit(1)))

    def merged(sketch: Column, at: Column) -> Column:
        # the hash of the word hash h at i and those after it; missing ones are skipped
        part = F.transform(F.slice(w, at + 1, F.least(F.lit(part_words), shingles - at)), lambda h, i: F.xxhash64(h, *(F.get(w, at + i + j) for j in range(1, shingle))))
        return _least(F.concat(sketch, part), k)

    return F.aggregate(F.sequence(F.lit(0), F.greatest(shingles - 1, F.lit(0)), F.lit(part_words)), F.array().cast("array<bigint>"), merged)


def with_sketches(df: DataFrame, columns: dict[str, str], k: int = K, shingle: int = SHINGLE, part_words: int = PART_WORDS) -> DataFrame:
    """df with the sketch (array<bigint>) of each text column; columns: {text column: new column}.

    A text of fewer words than a shingle has, but one, is one shingle; without words the sketch is empty. Beside the text
    a row holds one number a word, and the hashes of one part.
    """
    names = list(columns.values())
    for text, new in columns.items():
        df = df.withColumn(f"__w_{new}", F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)))
    # `__w` is read by several expressions, so it is worked out once for each row
    for new in names:
        df = df.withColumn(new, _sketch(F.col(f"__w_{new}"), k, shingle, part_words))
    return df.drop(*(f"__w_{new}" for new in names))


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE, part_words: int = PART_WORDS) -> DataFrame:
    """(id_col, sketch, n_shingles) for each row of docs; n_shingles estimates the number of different shingles.

    Very long texts are cut into parts that overlap by a shingle less a word; these are sketched as rows of their own, in
    several tasks, and merged. Null and blank texts have an empty sketch. Repeated rows and ids stay: a row is told by its number.
    """
    source = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    long = F.length("__text") > 2 * part_words
    short = with_sketches(source.where(F.coalesce(~long, F.lit(True))), {"__text": "sketch"}, k, shingle).select(id_col, "sketch")
    rows = source.where(long).withColumn("__row", F.monotonically_increasing_id())
    rows = rows.select(F.col(id_col), "__row", split_words(F.col("__text")).alias("__words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("__words") - shingle, F.lit(0)), F.lit(part_words))
    parts = rows.select(F.col(id_col), "__row", "__words", F.explode(starts).alias("__at"))
    part = F.array_join(F.slice("__words", F.col("__at") + 1, part_words + shingle - 1), " ")
    parts = with_sketches(parts.select(F.col(id_col), "__row", part.alias("__text")), {"__text": "sketch"}, k, shingle)
    merged = merged_sketches(parts, ["__row"], k, {id_col: F.first(id_col)}).select(id_col, "sketch")
    found = short.unionByName(merged)
    return found.withColumn("n_shingles", distinct_shingles(F.col("sketch"), k))


def merged_sketches(parts: DataFrame, keys: list[str], k: int = K, more: dict[str, Column] | None = None) -> DataFrame:
    """One sketch for each key of the parts' column `sketch`; equal to that of all their shingles together.

    Each task merges what it has, k numbers at a time, so a key with very many parts does not meet whole in one task.
    """
    flat = parts.select("*", F.posexplode_outer("sketch").alias("__pos", "__h")).groupBy(*keys, F.pmod(F.xxhash64("__h"), F.lit(16)).alias("__salt"))
    some = flat.agg(F.collect_set("__h").alias("__set"), *(c.alias(n) for n, c in (more or {}).items()))
    some = some.withColumn("__set", F.slice(F.sort_array("__set"), 1, k))
    kept = some.groupBy(*keys).agg(F.flatten(F.collect_list("__set")).alias("__all"), *(F.first(n).alias(n) for n in more or {}))
    return kept.withColumn("sketch", _least(F.col("__all"), k)).drop("__all")


def _share(h: Column) -> Column:
    """A hash as a number from 0 to 1."""
    return (h.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """The number of different shingles: exact below k, estimated from the greatest of the k least hashes above."""
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / _share(F.element_at(sketch, -1)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Of two sketches: the share of the least k hashes of both together that both have. 1 if both are empty."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared / F.greatest(F.size(both), F.lit(1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's shingles that b has: of a's hashes up to the greatest that both sketches cover."""
    top = F.least(F.when(F.size(a) < k, F.lit(2**63 - 1)).otherwise(F.element_at(a, -1)), F.when(F.size(b) < k, F.lit(2**63 - 1)).otherwise(F.element_at(b, -1)))
    own = F.filter(a, lambda h: h <= top)
    return F.when(F.size(own) == 0, F.when(F.size(a) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(own, b)) / F.size(own))


def text_form(sketch: Column) -> Column:
    """The sketch as a string: its hashes, 8 bytes each, in base64."""
    return F.base64(F.unhex(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def in_ranges(docs: DataFrame, id_col: str, second: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """docs with __range and __end, so that next_in_range() needs one shuffle and no window over all rows.

    Rows are ordered by id (numbers; null ids come first of all) and, within one id, by the bigint column `second`, a hash.
    They go into ranges of about range_rows rows, cut at quantiles of these pairs, so clustered ids, null ids and ids
    that repeat are dealt as evenly as others; only rows equal in both stay together. A copy of the next range's first
    row stands at the end of each with __end = 1; after the last range comes the first.
    """
    kind = "bigint" if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long") else "double"
    number = F.col(id_col).cast(kind)
    rows, known = docs.agg(F.count("*"), F.count(id_col)).first()
    range_rows = max(range_rows, rows // RANGES)
    cuts = cut_points(docs.where(F.col(id_col).isNotNull()), F.struct(number.alias("a"), F.col(second).alias("b")), known // range_rows + 1)
    nulls = (rows - known) // range_rows + 1
    of_null = F.least(F.floor((F.col(second) / F.lit(2.0**64) + 0.5) * nulls), F.lit(nulls - 1)).cast("int") - nulls
    ranged = docs.withColumn("__range", F.when(F.col(id_col).isNull(), of_null).otherwise(range_of(number, F.col(second), cuts, kind)))
    firsts = ranged.groupBy("__range").agg(F.min(F.struct(id_col, second)).alias("__first"))  # about RANGES rows at most
    before = F.lag("__range").over(Window.orderBy("__range"))
    last = F.max("__range").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select(F.col("__range").alias("__own"), "__first", F.coalesce(before, last).alias("__to"))
    is_first = (F.col("__range") == F.col("__own")) & F.col(id_col).eqNullSafe(F.col("__first")[id_col]) & (F.col(second) == F.col("__first")[second])
    heads = ranged.join(F.broadcast(firsts), is_first)
    heads = heads.withColumn("__n", F.row_number().over(Window.partitionBy("__range").orderBy(second))).where("__n = 1")
    heads = heads.withColumn("__range", F.col("__to")).drop("__n", "__own", "__first", "__to")
    return ranged.withColumn("__end", F.lit(0)).unionByName(heads.withColumn("__end", F.lit(1)))


def next_in_range(column: str, id_col: str, second: str) -> Column:
    """The column's value in the next row of a table from in_ranges()."""
    return F.lead(column).over(Window.partitionBy("__range").orderBy("__end", F.col(id_col).asc_nulls_first(), second))


def op1_document_fingerprints(spark, sf_dir):
    """Sketches of every text and of its edited form. Null texts are empty; empty texts and texts of no words have an empty
    sketch and are alike by 1; texts of fewer than five words are one shingle. Repeated ids are told apart by their texts, equal rows
    have equal results; null ids come first. A table of one row is its own next; an empty one gives no rows. Beside what
    is asked for: how much of the text the edited one contains, and how many different shingles it has, both estimated."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    docs = in_ranges(docs, "doc_id", "hash").select("*", next_in_range("text", "doc_id", "hash").alias("next_text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    docs = docs.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    docs = docs.withColumn("n_chars", n.cast("long")).withColumn("edited_sha256", F.sha2("edited", 256)).drop("next_text")
    docs = with_sketches(docs, {"text": "own", "edited": "changed"})
    docs = docs.select("*", next_in_range("own", "doc_id", "hash").alias("next")).where("__end = 0")
    return docs.select(
        "doc_id", "n_chars", "edited_sha256", text_form(F.col("own")).alias("fingerprint"), text_form(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed")).alias("near_edited"), resemblance(F.col("own"), F.col("next")).alias("near_next"),
        containment(F.col("own"), F.col("changed")).alias("contained_in_edited"), distinct_shingles(F.col("own")).alias("n_shingles"),
    )
