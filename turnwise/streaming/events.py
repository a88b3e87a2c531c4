"""Extension beyond the reference's scope: the interval operators over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, ts: str, keys: list[str], window: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of value by event-time window; state is dropped behind the watermark."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, window).alias("w"), *keys)
        .agg(F.count("*").alias("n"), F.sum("value").alias("value"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "value")
    )


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions that a gap ends: the streaming form of the gap merge."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.session_window(ts, gap).alias("w"), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
    )
