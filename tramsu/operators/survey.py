"""What a collection of titles offers before a bank is built from it: guessed domains and whether it is enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of titles that make them history; blanks at the end count.
HISTORY_KEYWORDS = [
    "nhà ", "triều", "vương triều", "hoàng đế", "vua ", "chúa ",
    "chiến tranh", "chiến dịch", "khởi nghĩa", "kháng chiến", "trận ",
    "cách mạng", "bắc thuộc", "phong kiến", "độc lập", "thống nhất",
    "lý ", "trần ", "lê ", "nguyễn", "đinh ", "hồ ", "mạc ", "tây sơn",
    "ngô ", "tiền lê", "hậu lê", "quang trung", "gia long", "minh mạng",
    "hồ chí minh", "điện biên", "việt minh", "đông dương", "pháp thuộc",
    "lịch sử", "thời kỳ", "thời đại", "đế quốc", "vương quốc", "quốc gia",
]
#: Passages that are enough, and that are enough under conditions.
GO, CONDITIONAL = 1500, 800


def guess_history(title: Column) -> Column:
    """Whether a title has one of the keywords; false for null."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.exists(F.array(*map(F.lit, HISTORY_KEYWORDS)), lambda k: F.contains(low, k))


def go_no_go(passages: Column) -> Column:
    """go, conditional or no_go by a number of passages; no_go for null."""
    return F.when(passages >= GO, "go").when(passages >= CONDITIONAL, "conditional").otherwise("no_go")


def survey(passages: DataFrame) -> DataFrame:
    """passages: context_id, title. One row: n_titles, n_passages, n_history (passages of titles guessed to be history), decision."""
    history = passages.agg(
        F.countDistinct("title").alias("n_titles"), F.count("*").alias("n_passages"), F.count_if(guess_history(F.col("title"))).alias("n_history")
    )
    return history.withColumn("decision", go_no_go(F.col("n_history")))


def call_totals(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls: model, prompt_tokens, completion_tokens; prices: model, prompt_price, completion_price for a million tokens.
    model, n_calls, prompt_tokens, completion_tokens, cost (six decimals; null where the model has no price). Null counts are none."""
    sums = calls.groupBy("model").agg(
        F.count("*").alias("n_calls"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens")
    )
    cost = (F.col("prompt_tokens") * F.col("prompt_price") + F.col("completion_tokens") * F.col("completion_price")) / 1_000_000
    return sums.join(prices, "model", "left").select("model", "n_calls", "prompt_tokens", "completion_tokens", F.round(cost, 6).alias("cost"))


def skip_counters(made: DataFrame, reason: str = "skipped") -> DataFrame:
    """reason, n of the rows that were left out (a reason that is not null), most frequent first is left to the caller."""
    return made.where(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n"))
