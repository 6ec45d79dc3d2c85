"""Descriptive aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, *cols: str, top: int | None = None) -> DataFrame:
    """Groups and their sizes, largest first (ties by the values); the first top if given."""
    out = df.groupBy(*cols).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *cols)
    return out.limit(top) if top else out


def quantiles(df: DataFrame, col: str, by: str) -> DataFrame:
    """by, n, least, q25, median, q75, most, mean: exact, interpolated."""
    p = lambda q: F.round(F.percentile(col, F.lit(q)), 4)
    return df.groupBy(by).agg(
        F.count(col).alias("n"), F.min(col).cast("double").alias("least"), p(0.25).alias("q25"), p(0.5).alias("median"), p(0.75).alias("q75"),
        F.max(col).cast("double").alias("most"), F.round(F.avg(col), 4).alias("mean"),
    )


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """bin (from 0), n: equal widths from the least to the most, the most in the last bin."""
    lim = df.agg(F.min(col).cast("double").alias("a"), F.max(col).cast("double").alias("b"))
    i = F.when(F.col("b") > F.col("a"), F.least(F.lit(bins - 1), F.floor((F.col(col) - F.col("a")) / (F.col("b") - F.col("a")) * bins))).otherwise(0)
    return df.where(F.col(col).isNotNull()).crossJoin(lim).groupBy(i.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def rates(df: DataFrame, by: str, **flags) -> DataFrame:
    """by, n and the share of rows for which each flag holds (null: it does not)."""
    return df.groupBy(by).agg(F.count("*").alias("n"), *[F.round(F.avg(F.coalesce(f, F.lit(False)).cast("double")), 6).alias(k) for k, f in flags.items()])
