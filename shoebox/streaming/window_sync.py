"""Incremental syncs: landed pages of a remote library as a stream, merged window by window.

The file source's checkpoint is the cursor: it moves only after a batch is merged and published. Windows overlap at
their edges; the merge makes a repeated page a no-op.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shoebox.operators import merge
from shoebox.sources.snapshots import Snapshots


def sync_once(spark: SparkSession, landed: str, schema: str, store: Snapshots, table: str, keys: list[str], columns: list[str], checkpoint: str, more: Callable[[DataFrame, DataFrame], dict[str, DataFrame]] | None = None) -> int:
    """Merges all landed files that were not merged yet (availableNow), one generation a batch with changes; returns
    the generation then published. `more` derives further tables (new snapshot, changes) for the same generation."""

    def apply(batch: DataFrame, _: int) -> None:
        generation = store.current()
        old = store.read(table, generation)
        both = merge.merged(old, batch, keys, columns)
        changed = both.where("change <> 'same'")
        if changed.isEmpty():
            return
        new = both.drop("change")
        store.publish({table: new} | (more(new, changed) if more else {}), expected=generation)

    stream = spark.readStream.schema(schema).json(landed)
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return store.current()


def window(synced_through, server_now):
    """(from, to, new cursor): from the cursor, inclusive, to the server's own time; a clock that went back raises."""
    if synced_through is not None and server_now < synced_through:
        raise ValueError("the remote clock went back")
    return synced_through, server_now, server_now
