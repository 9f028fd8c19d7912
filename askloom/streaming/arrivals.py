"""Insert-if-absent for documents that arrive as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from askloom.sources.sinks import append_new_rows, first_per_key, stored_table


#: Folders of the target, by a hash of the key.
KEY_FOLDERS = 256


def _insert_batch(
    batch: DataFrame, target: str, key: Sequence[str], order: Sequence[str]
) -> None:
    """One micro-batch. Stored keys are read from the folders that the batch falls
    into only; at most one number per folder is fetched."""
    folder = F.pmod(F.xxhash64(*key), F.lit(KEY_FOLDERS)).cast("int")
    fresh = first_per_key(batch, key, order).withColumn("key_folder", folder).persist()
    try:
        used = [row[0] for row in fresh.select("key_folder").distinct().collect()]
        stored = stored_table(batch.sparkSession, target, fresh.schema)
        known = stored.where(F.col("key_folder").isin(used)).select(*key)
        new = fresh.join(known, list(key), "left_anti")
        append_new_rows(new.repartition("key_folder"), target, ["key_folder"])
    finally:
        fresh.unpersist()


def streaming_insert_if_absent(
    stream: DataFrame,
    target: str,
    key: Sequence[str],
    order: Sequence[str],
    checkpoint: str,
    *,
    event_time: str | None = None,
    watermark: str | None = None,
    **trigger: object,
) -> StreamingQuery:
    """Start a query that appends the rows whose key the target lacks. The target
    has folders by ``key_folder``, a hash of the key.

    A replayed batch finds its keys stored and adds nothing. With an event time
    and a watermark, repeats inside the watermark are dropped by Spark's own
    state before they reach the target.
    """
    if event_time and watermark:
        stream = stream.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(
            list(key)
        )
    return (
        stream.writeStream.foreachBatch(
            lambda batch, _epoch: _insert_batch(batch, target, key, order)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
