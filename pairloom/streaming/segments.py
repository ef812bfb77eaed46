"""Streaming forms of the series operators, for segment files that still grow (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "segment STRING, step LONG, at TIMESTAMP, value DOUBLE"


def read_segments(spark: SparkSession, folder: str, schema: str = SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    """Rows of CSV segment files as they arrive."""
    return spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(folder)


def unique_rows(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows delivered twice or late within the watermark count once per segment and step; state is dropped behind it."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["segment", "step"])


def zero_sessions(stream: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """``start``, ``end``, ``n`` of sessions of rows with value zero, per segment; a pause of ``gap`` ends one."""
    s = stream.withWatermark("at", late).filter("value = 0")
    g = s.groupBy("segment", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("segment", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_counts(stream: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """``n``, ``mean`` per segment and tumbling window."""
    g = stream.withWatermark("at", late).groupBy("segment", F.window("at", window).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return g.select("segment", F.col("w.start").alias("start"), "n", "mean")
