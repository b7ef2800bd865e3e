"""Predictions that arrive over time: scored batch by batch, and counts of events by window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prediction_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """JSON lines of a folder as a stream."""
    return spark.readStream.schema("instance_id string, model_output string, pos long").option("maxFilesPerTrigger", files_per_batch).json(folder)


def score_each_batch(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Score each batch and write it under its number, so a batch that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts and sums of events by window and type; events later than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
