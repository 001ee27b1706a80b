"""Streams: documents that arrive as files into postings, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.functions import text as X
from granary.operators import retrieval

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, path: str, schema: str = DOCUMENTS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def into_postings(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Cleans each micro-batch and writes its postings to a folder of the batch's own, so that a batch that runs again
    writes the same rows to the same place. Stops when all that is there is read."""

    def write(batch: DataFrame, number: int) -> None:
        clean = batch.select("doc_id", X.cleaned("text").alias("text"))
        retrieval.postings(clean).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by kind in tumbling windows; events later than ``late`` are left out."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
