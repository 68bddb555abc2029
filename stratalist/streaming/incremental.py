"""The same operators over streams of listings and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_listings(stream: DataFrame, keys: list[str], at: str, late: str = "10 days") -> DataFrame:
    """Each listing once, however often a source repeats it within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, by: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    rows = stream.withWatermark(at, late).groupBy(F.window(at, size), by).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), by, "n")


def run_available(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """One scheduled run: everything that is there, then stop. Files are written once, even after a failure."""
    return rows.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
