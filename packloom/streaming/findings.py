"""Streams: findings of pages that arrive in a folder, counted by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.operators import detect


def page_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """Pages dropped into a folder as Parquet files (path, html, ts)."""
    return spark.readStream.schema("path string, html string, ts timestamp").option("maxFilesPerTrigger", per_trigger).parquet(folder)


def findings_by_window(pages: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Accessibility findings by reason and window; rows later than the watermark
    are dropped, so state stays bounded. Works on tables as well."""
    rows = pages.withWatermark("ts", late).select("ts", F.explode(detect.accessibility(F.col("html"))).alias("x"))
    return rows.groupBy(F.window("ts", window).alias("w"), F.col("x.reason").alias("reason")).agg(F.count("*").alias("n")).select("w.start", "reason", "n")
