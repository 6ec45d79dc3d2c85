"""Readers: Parquet splits, CSV with a byte order mark, JSON arrays, JSON lines of nested items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The nested record of a multiple-choice item.
ITEM = """schema_version string, item_id string, generator struct<method string, variant string, model_name string, params_hash string>,
source struct<dataset string, context_id string, context string, title string, is_vietnam boolean>,
request struct<bloom_requested string, wh_type_requested string>, question string,
options array<struct<label string, text string, is_correct boolean, entity_type string, provenance string>>, answer_key string, answer_text string,
evidence struct<sentence string, char_start int, char_end int, found_in_context boolean>,
metadata struct<wh_type_detected string, bloom_predicted string, difficulty_score double, difficulty_band string, topic string, tags array<string>>,
generation_trace struct<latency_ms double, cost_usd double, n_llm_calls int, retrieved_context_ids array<string>>,
verification struct<status string, verifier_score double, checks map<string, struct<score double, passed boolean, reason string>>, violations array<string>>,
dedup map<string, string>, created_at string"""


def read_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """All splits of a dataset as one table; the split's name becomes a column."""
    out = None
    for name, path in paths.items():
        one = spark.read.parquet(path).withColumn("split", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; a byte order mark before the first name is no part of it."""
    df = spark.read.option("multiLine", True).csv(path, header=True, schema=schema)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_json_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold a JSON array of records; the file's name is kept, broken files give no rows."""
    df = spark.read.schema(schema + ", _broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(path)
    return df.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).where("_broken is null").drop("_broken")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Nested items, one a line; blank lines are skipped, lines that are no record give none."""
    df = spark.read.schema(ITEM + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return df.where("_broken is null and item_id is not null").drop("_broken")


def flat_bank(items: DataFrame, accepted_only: bool = True, default_score: float = 0.5) -> DataFrame:
    """The bank's flat columns of nested items, with three of the check scores."""
    rows = items.where("verification.status = 'accepted'") if accepted_only else items
    check = lambda n: F.coalesce(F.try_element_at("verification.checks", F.lit(n))["score"], F.lit(0.0)).alias(n)
    return rows.select(
        "item_id", F.col("generator.method").alias("method"), "question", "answer_key", "answer_text", "options", "source.context_id", "source.title", "source.is_vietnam",
        F.coalesce("metadata.bloom_predicted", "request.bloom_requested").alias("bloom"), F.col("request.wh_type_requested").alias("wh_type"),
        F.coalesce("verification.verifier_score", F.lit(default_score)).alias("verifier_score"), F.col("verification.status").alias("status"), "verification.violations",
        check("evidence_match"), check("bloom_fidelity"), check("duplicate_check"),
    )
