"""Late files as a file-source stream."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from stocktide.sources.sinks import append_transactions


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """Id that Spark keeps in the checkpoint of a stream."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def append_stream(spark: SparkSession, folder: str, schema: StructType, table: str, checkpoint: str,
                  normalize: Callable[[DataFrame], DataFrame], sep: str = ",", key: str = "transaction_key",
                  order: list[str] | None = None, span: str | None = None) -> StreamingQuery:
    """Take in every file that has arrived and stop; run it again for the next ones.

    Batch and stream share ``append_transactions``: the stored table is the
    memory of what was seen, so no state grows in the stream itself, and a batch
    reads only the slices of its own months (``span``) and keys. A slice is
    named by the stream's own id, which lives in its checkpoint, and the batch:
    a repeated batch rewrites its slice, and no other stream or later checkpoint
    can share it.
    """
    files = spark.readStream.schema(schema).option("sep", sep).option("header", True).csv(folder)

    def take(batch: DataFrame, batch_id: int) -> None:
        stream = stream_id(batch.sparkSession, checkpoint)
        append_transactions(normalize(batch), table, f"stream-{stream}-{batch_id}", key, order, span)

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
