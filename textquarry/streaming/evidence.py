"""A stream of documents into selected evidence: each micro-batch selects blocks of its new documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.generators import line_blocks
from ..plans.retrieval import unified


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files_at_a_time: int = 64) -> DataFrame:
    """New documents of the folder; with a column of their time in the schema, ``once_stream`` drops those that come again."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_a_time).parquet(path)


def select_stream(docs: DataFrame, target: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], available_now: bool = True) -> StreamingQuery:
    """Writes the selected blocks of every new document below ``target``; ``score`` adds ``similarity`` to blocks.

    A document is whole in its row, so a micro-batch is enough to select its blocks. The batch's number names its
    folder: a batch that runs again after a failure replaces what it had written. The checkpoint skips what is done.
    """

    def write(batch: DataFrame, number: int) -> None:
        once = batch.dropDuplicates(["doc_id"])
        unified(score(line_blocks(once))).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def once_stream(docs: DataFrame, key: str = "doc_id", at: str = "arrived", within: str = "1 day") -> DataFrame:
    """``docs`` without rows whose key has come already, in this micro-batch or one before.

    The state keeps a key for ``within`` after its time ``at`` and then forgets it, so it does not grow with the stream; a copy
    that comes later than that passes again. Rows without a time take no part. Of rows of one key one passes; a null
    key is a key as any other.
    """
    return docs.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events (ts, event_type, value) by window and type; rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
