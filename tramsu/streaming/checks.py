"""Structured Streaming forms of the order-dependent checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_questions(stream: DataFrame, at: str = "created_at", within: str = "1 day") -> DataFrame:
    """Drops items whose question (case and blanks aside) came within the watermark."""
    key = F.lower(F.regexp_replace(F.trim("question"), r"(?U)\s+", " "))
    return stream.withColumn("_q", key).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, within).dropDuplicatesWithinWatermark(["_q"]).drop("_q")


def key_counts(stream: DataFrame, at: str = "created_at", window: str = "1 day", within: str = "1 day") -> DataFrame:
    """Items per answer key and window, with late items up to the watermark."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, within).groupBy(F.window(at, window), "answer_key").agg(F.count("*").alias("n"))
