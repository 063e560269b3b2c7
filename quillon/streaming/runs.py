"""Incremental runs: files or result rows that arrive are validated once and appended; a checkpoint makes a run resumable."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import records


def validate_stream(spark: SparkSession, source: str, schema, template: Sequence, out: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Reads result rows that arrive under `source`, validates them, appends them to `out`, then calls on_batch with the batch.
    It works off what is there and ends; run again with the same checkpoint, it goes on after the last finished batch."""
    rows = records.validated(spark.readStream.schema(schema).parquet(source), template).drop("fields")

    def write(batch: DataFrame, n: int) -> None:
        # a batch that is run again after a failure overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
        if on_batch:
            on_batch(batch, n)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_stream(spark: SparkSession, source: str, schema, checkpoint: str, on_batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Running totals of the processing log that arrives under `source` (batch_id, phase, processing_time, success, field_count):
    on_batch gets the whole table of (batch_id, phase) totals after each batch. The state has one row for each batch and phase."""
    log = spark.readStream.schema(schema).parquet(source)
    totals = log.groupBy("batch_id", "phase").agg(F.count("*").alias("records"), F.count_if("success").alias("successful"), F.sum("processing_time").alias("total_time"), F.sum("field_count").alias("fields"))
    return totals.writeStream.outputMode("complete").foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files that no earlier run has finished."""
    return files.join(done.select("path"), "path", "left_anti")
