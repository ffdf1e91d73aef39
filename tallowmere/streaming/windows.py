"""Counts over the event log in event time; an extension, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def files(spark: SparkSession, path: str, schema: StructType | str, at_once: int = 100) -> DataFrame:
    """New Parquet files below ``path`` as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).parquet(path)


def tumbling(events: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    """Rows and value sums of windows of ``width``; rows later than ``late`` are left out."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width), by)
    return w.agg(F.count("*").alias("rows"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "rows", "total")


def sliding(events: DataFrame, time: str, by: str, width: str, step: str, late: str) -> DataFrame:
    w = events.withWatermark(time, late).groupBy(F.window(time, width, step), by)
    return w.agg(F.count("*").alias("rows")).select(F.col("window.start").alias("start"), by, "rows")


def sessions(events: DataFrame, time: str, by: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key that end after ``gap`` without a row."""
    w = events.withWatermark(time, late).groupBy(F.session_window(time, gap), by)
    return w.agg(F.count("*").alias("rows"), F.sum("value").alias("total")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "rows", "total")


def once(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key once while its watermark lasts: a retried delivery counts once."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
