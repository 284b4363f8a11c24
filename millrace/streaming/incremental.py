"""Rules over a stream of documents: each micro-batch re-evaluates what changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from millrace.functions.text import fingerprint


def changed_documents(stream: DataFrame, key: str = "document_id", text: str = "text", time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Documents whose fingerprint was not seen yet; with a time column, state is kept for as long as rows may be late."""
    marked = stream.withColumn("fingerprint", fingerprint(F.col(text)))
    if time is None:
        return marked.dropDuplicates([key, "fingerprint"])
    return marked.withWatermark(time, late).dropDuplicatesWithinWatermark([key, "fingerprint"])


def evaluate_stream(stream: DataFrame, evaluate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Findings of each micro-batch's documents, written under its number: a repeated batch replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        evaluate(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/{number}")

    writer: DataStreamWriter = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
