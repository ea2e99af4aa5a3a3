"""Streams of observations into the result store, and windowed statistics of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import ResultStore


def feed(observations: DataFrame, store: ResultStore, checkpoint: str) -> StreamingQuery:
    """Upsert each micro-batch; a batch that is replayed after a failure changes nothing."""
    return observations.writeStream.foreachBatch(lambda batch, _: store.upsert_results(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_statistics(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean and extremes of value per event_type and tumbling window; works on streams and tables."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    w = F.window("ts", width)
    return events.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.min("value").alias("least"), F.max("value").alias("greatest")).select(F.col("window.start").alias("window_start"), "event_type", "n", "mean_value", "least", "greatest")
