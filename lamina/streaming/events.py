"""Streams: windows of files as they land, events once each, hourly counts with late data, and delivery watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """Files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once_each(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events counted once by id, remembered for as long as they may come late: one that comes again after ``delay`` counts again.

    Where that must not be, ``state.insert_absent`` against the table of all seen ids settles it.
    """
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, size: str = "1 day") -> DataFrame:
    """Events and values by kind and window."""
    cut = events.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return cut.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def drained(frame: DataFrame, checkpoint: str, path: str) -> None:
    """Run until nothing new is left, then stop (T02): append mode to Parquet, exactly once by checkpoint."""
    frame.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def deliver(news: DataFrame, watermarks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what is new for each account, watermarks after delivery): news later than the account's watermark, once."""
    fresh = news.join(watermarks, "user_id", "left").filter(F.col("last_watermark").isNull() | (F.col("news_at") > F.col("last_watermark"))).drop("last_watermark")
    seen = fresh.groupBy("user_id").agg(F.max("news_at").alias("seen"))
    after = watermarks.join(seen, "user_id", "full_outer").select("user_id", F.greatest("last_watermark", "seen").alias("last_watermark"))
    return fresh, after
