"""From raw question rows to passages, question pairs and a split without leaks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramsu.functions import normalize as N

#: Tokens a passage needs, and the shares of the splits.
MIN_TOKENS = 40
SHARES = {"train": 0.8, "dev": 0.1, "test": 0.1}


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of every key by the given order (ties: by the row's hash). Null keys are one key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order, F.xxhash64(*df.columns)))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def passage_statistics(passages: DataFrame, text: str = "context") -> DataFrame:
    """Adds n_tokens, n_years, year_density and primary_year of the text."""
    years = N.years_of(F.col(text))
    return passages.withColumns({"n_tokens": N.count_tokens(F.col(text)), "n_years": F.size(years), "primary_year": N.primary_year(years)}).withColumn(
        "year_density", N.year_density(F.col("n_years"), F.col("n_tokens"))
    )


def title_inventory(rows: DataFrame) -> DataFrame:
    """title, n_passages, n_answerable_q, n_unanswerable_q."""
    return rows.groupBy("title").agg(
        F.countDistinct("context_id").alias("n_passages"),
        F.count_if(~F.col("is_impossible")).alias("n_answerable_q"),
        F.count_if("is_impossible").alias("n_unanswerable_q"),
    )


def build(raw: DataFrame, inventory: DataFrame, min_tokens: int = MIN_TOKENS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """raw: title, context, question, answers struct<text, answer_start>, is_impossible, plausible,
    pos (the input order); inventory: title, is_history, is_vietnam. Returns (corpus, qa, counters).

    Rows of titles outside the inventory's history and of passages under min_tokens are skipped and
    counted; passages are keyed by the hash of their normal form, and the first row gives the title."""
    wanted = inventory.where("is_history = 1").select(N.passage_form(F.col("title")).alias("title"), (F.col("is_vietnam") == 1).alias("is_vietnam")).distinct()
    rows = raw.withColumns({"title": N.passage_form(F.col("title")), "context": N.passage_form(F.col("context"))})
    rows = rows.join(wanted, "title", "left").withColumn("known", F.col("is_vietnam").isNotNull())
    rows = rows.withColumn("long", N.count_tokens(F.coalesce("context", F.lit(""))) >= min_tokens)
    counters = rows.agg(F.count("*").alias("rows_seen"), F.count_if(~F.col("known")).alias("skipped_title"), F.count_if(F.col("known") & ~F.col("long")).alias("skipped_short"))
    kept = rows.where("known and long").withColumn("context_id", N.short_id("ctx_", F.col("context")))
    corpus = passage_statistics(keep_first(kept.select("context_id", "title", "context", "is_vietnam", "pos"), "context_id", "pos"))
    answer = F.coalesce(N.passage_form(F.try_element_at("answers.text", F.lit(1))), F.lit(""))
    start = F.try_element_at("answers.answer_start", F.lit(1))
    qa = kept.select(
        N.short_id("qa_", F.col("title"), F.col("question"), answer).alias("qa_id"), "context_id", "title", N.passage_form(F.col("question")).alias("question"),
        answer.alias("answer_text"), start.alias("answer_start"), N.span_ok(F.col("context"), answer, start, F.col("is_impossible")).alias("answer_span_ok"),
        "is_impossible", F.coalesce("plausible", F.lit("")).alias("plausible_answer"), "is_vietnam",
    )
    return corpus.drop("pos"), qa, counters


def _fold(shares: dict[str, float]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "title"], ascending=[False, True])
        room = {s: pdf["size"].sum() * p for s, p in shares.items()}
        out = []
        for n in pdf["size"]:
            s = max(room, key=room.get)
            room[s] -= n
            out.append(s)
        return pdf.assign(split=out)[["title", "is_vietnam", "size", "split"]]

    return run


def balanced_split(titles: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """titles: title, is_vietnam, size. Each domain is split for itself, largest title first, to the
    split furthest below its share. One task a domain: for tables of titles, not of rows."""
    return titles.groupBy("is_vietnam").applyInPandas(_fold(shares or SHARES), "title string, is_vietnam boolean, size long, split string")


def split_report(corpus: DataFrame) -> DataFrame:
    """split, titles, passages, vn, world, pct (of all passages, two decimals)."""
    per = corpus.groupBy("split").agg(
        F.countDistinct("title").alias("titles"), F.count("*").alias("passages"), F.count_if("is_vietnam").alias("vn"), F.count_if(~F.col("is_vietnam")).alias("world")
    )
    return per.crossJoin(per.agg(F.sum("passages").alias("n"))).select("split", "titles", "passages", "vn", "world", F.round(100 * F.col("passages") / F.col("n"), 2).alias("pct"))


def leak_check(corpus: DataFrame, qa: DataFrame, split) -> DataFrame:
    """context_id and the splits of its passage and its questions, where they are several."""
    both = corpus.select("context_id", split(F.col("split")).alias("s")).unionByName(qa.select("context_id", split(F.col("split")).alias("s")))
    return both.where("s is not null").groupBy("context_id").agg(F.countDistinct("s").alias("n_splits")).where("n_splits > 1")
