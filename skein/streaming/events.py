"""Event streams: windowed counts with a watermark, first-seen filtering, latest row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def source(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def hopping_counts(events: DataFrame, size: str = "1 hour", step: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Counts and sums of each type in hopping windows; rows later than the watermark are left out of a stream."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size, step), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def first_seen(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows whose id was not seen within the watermark: what was reported before is not reported again."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "user_id")
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")
    )
