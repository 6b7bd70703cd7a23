"""A training corpus in five stages over documents: each works on all that its predecessor kept.

A stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shoebox.llm import bpe, common, decontam, langid, linededup, nearcopies

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letters, or null) go; lang becomes the predicted one.

    The parser learns from the documents that have a lang, by the rule of the language query. Where none has, every
    document with a letter stays as it is.
    """
    parser = langid.fit(docs.where(~langid.held_out("doc_id", 5, 0)))
    if not parser.langs:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = langid.predicted(docs, parser, carry=("text", "source", "n_chars"))
    return found.where("lang_pred <> 'und'").withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in 10 documents or more stay in the first of these only; no document goes."""
    found = linededup.dedup_lines(docs, keep="first", more=("lang", "source"))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near copies stays, once; rows without an id all stay.

    Candidates come from SimHash by ball hashing, and two texts are linked at a five-word likeness of 0.8.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    kept = nearcopies.near_copies(named).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept_id")).distinct()
    one = Window.partitionBy("kept_id").orderBy(F.xxhash64("text"), "lang", "source")
    # the window needs no shuffle of its own after the join
    rows = named.join(kept, F.col("doc_id") == F.col("kept_id")).withColumn("copy", F.row_number().over(one)).where("copy = 1")
    return rows.select(*COLUMNS).unionByName(docs.where(F.col("doc_id").isNull()).select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    found = decontam.scan_documents(docs, common.table(spark, sf_dir, "benchmark"), carry=("text", "lang", "source", "n_chars"))
    return found.where("n_hit = 0").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the token ids as little-endian 32-bit integers."""
    import public_tokenizers

    found = bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: SQL has no word for the first, third and last stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared folder and read again.

    A result is deleted once the next is there, and what a stage wrote for itself once its own is.
    """
    docs, last = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = common.shared_dir(spark, f"pipeline-{name}")
        with common.inside(spark, f"pipeline-{name}-tables"):
            docs = common.saved(stage(spark, docs, sf_dir), path)
        if last:
            common.remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
