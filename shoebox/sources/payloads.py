"""Vectors as stored bytes: packed into batches that are named by their content, read back by byte ranges.

Equal vectors are stored once. Contents are dealt into shards by their digest and packed in the digests' order, so the same
contents always make the same batches, whatever rows or partitions they come in; a batch's name is the digest of its bytes.
A row knows its batch, offset and length, and the digest of its own bytes, by which what is read is verified.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

BATCH_BYTES = 4_000_000


@F.pandas_udf(T.BinaryType())
def vector_bytes(vectors: pd.Series) -> pd.Series:
    """32-bit floats, the low byte first; there is no built-in for a float's bytes."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def packed(vectors: DataFrame, batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, DataFrame]:
    """From (id, vector): (id, batch, offset, length, checksum) and (batch, payload). Null vectors are not stored.

    A batch has batch_bytes at most, or one vector that is larger. A shard has about as many bytes as a batch.
    """
    own = vectors.where("vector IS NOT NULL").select("id", vector_bytes("vector").alias("bytes")).withColumn("checksum", F.sha2("bytes", 256))
    contents = own.groupBy("checksum").agg(F.first("bytes").alias("bytes"))
    total = contents.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    shards = max(1, -(-total // batch_bytes))
    placed = contents.withColumns({"shard": F.pmod(F.conv(F.substring("checksum", 1, 15), 16, 10).cast("bigint"), F.lit(shards)), "length": F.length("bytes").cast("bigint")})
    before = F.sum("length").over(Window.partitionBy("shard").orderBy("checksum").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    placed = placed.withColumn("piece", F.floor(before / batch_bytes))

    def join(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("checksum")
        payload = b"".join(own["bytes"])
        offsets = own["length"].cumsum() - own["length"]
        first = [payload] + [None] * (len(own) - 1)
        return pd.DataFrame({"checksum": own["checksum"], "batch": sha256(payload).hexdigest(), "offset": offsets, "length": own["length"], "payload": first})

    stored = placed.groupBy("shard", "piece").applyInPandas(join, "checksum string, batch string, offset bigint, length bigint, payload binary")
    return own.select("id", "checksum").join(stored.drop("payload"), "checksum").select("id", "batch", "offset", "length", "checksum"), stored.where("payload IS NOT NULL").select("batch", "payload")


def fetched(rows: DataFrame, batches: DataFrame) -> DataFrame:
    """(id, vector, intact) of rows (id, batch, offset, length, checksum): of each batch the rows' byte ranges. A row whose batch
    is gone or whose bytes are not what they were has intact = false and no vector."""
    kind = rows.schema["id"].dataType.simpleString()

    def read(own: pd.DataFrame, payloads: pd.DataFrame) -> pd.DataFrame:
        payload = bytes(payloads["payload"].iloc[0]) if len(payloads) else b""
        parts = [payload[o : o + n] for o, n in zip(own["offset"], own["length"], strict=True)]
        good = [len(p) == n and sha256(p).hexdigest() == c for p, n, c in zip(parts, own["length"], own["checksum"], strict=True)]
        vectors = [np.frombuffer(p, "<f4") if g else None for p, g in zip(parts, good, strict=True)]
        return pd.DataFrame({"id": own["id"], "vector": pd.Series(vectors, own.index, dtype=object), "intact": pd.Series(good, own.index, dtype=bool)})

    # copies of rows of one batch are dealt, so that a batch that very many rows name is read in several tasks
    slots = F.pmod(F.xxhash64("id"), F.lit(8))
    # new names, as rows and batches may come from one table
    dealt = batches.select(F.col("batch").alias("of_batch"), F.col("payload").alias("payload"), F.explode(F.array(*(F.lit(k).cast("bigint") for k in range(8)))).alias("of_slot"))
    own = rows.select("id", F.col("batch").alias("batch"), "offset", "length", "checksum", slots.alias("slot"))
    return own.groupBy("batch", "slot").cogroup(dealt.groupBy("of_batch", "of_slot")).applyInPandas(read, f"id {kind}, vector array<float>, intact boolean")


def swept(batches: DataFrame, live: list[DataFrame]) -> DataFrame:
    """The batches that any of the live rows (batch), those of published or pinned generations, still names."""
    named = live[0].select("batch")
    for rows in live[1:]:
        named = named.unionByName(rows.select("batch"))
    return batches.join(named.distinct(), "batch", "left_semi")
