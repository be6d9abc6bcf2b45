"""Windowed statistics of a stream of events.

The batch engine has no stream; this is the same statistics bundle over event-time windows with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet files that appear in a folder, with the batch table's schema."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_statistics(events: DataFrame, window: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """n, avg_value and std_value by event type and window; later events than `lateness` are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    g = e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("avg_value"), F.stddev_samp("value").alias("std_value"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "avg_value", "std_value")
