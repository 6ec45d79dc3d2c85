"""Sinks: Parquet, CSV, JSON lines, text reports, and the item's JSON schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramsu.sources.readers import ITEM


def write_parquet(df: DataFrame, path: str, *by: str) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header; bom puts a byte order mark before its first name."""
    named = df.toDF(*[("﻿" if bom and i == 0 else "") + c for i, c in enumerate(df.columns)])
    named.write.mode("overwrite").csv(path, header=True)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str, template: str, *cols: str | Column) -> None:
    """A line of text a row, in one file of the rows' order."""
    df.select(F.format_string(template, *cols).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def item_schema(spark: SparkSession) -> str:
    return T.StructType.fromDDL(ITEM).json()
