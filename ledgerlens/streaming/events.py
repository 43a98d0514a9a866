"""Structured Streaming: ledger rows arrive as events, are deduplicated within a watermark and summed in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def arriving(spark: SparkSession, folder: str, per_trigger: int = 16) -> DataFrame:
    """Files of events as they appear in folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def sums(events: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Count and exact sum per kind and window; repeats of an id and events later than the watermark don't count."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    per = once.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return per.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def run(result: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Into a table in memory, as tests read it; use writeStream with a file sink for production."""
    return result.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
