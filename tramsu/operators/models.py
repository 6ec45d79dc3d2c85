"""Where models plug in: taggers, scorers, prompts, and a level classifier that is trained here."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Other names of the types that taggers give.
TYPE_NAMES = {"PERSON": "PER", "LOCATION": "LOC", "ORGANIZATION": "ORG", "PER": "PER", "LOC": "LOC", "ORG": "ORG"}
#: Titles before a person's name, and words that are no person.
TITLES = ["Chủ tịch", "Tổng thống", "Đại tướng", "Tướng", "Vua", "Hoàng đế", "Thủ tướng", "Tổng bí thư", "Giáo hoàng", "Nữ hoàng", "Quốc vương", "Hoàng hậu", "Thái tử", "Công tước", "Bá tước", "Thủ lĩnh", "Ông", "Bà"]
NO_PERSON = {"Người", "Bác", "Đảng", "Nhà nước", "Chính phủ", "Ông", "Bà"}
_TITLE = re.compile("^(?:" + "|".join(TITLES) + r")\s+")
_SENTENCE = re.compile(r"[^.!?]+[.!?]*\s*")


def extract_named(passages: DataFrame, tagger: Callable[[str], Iterable[tuple[str, str]]]) -> DataFrame:
    """context_id, surface, type, char_start, char_end: what tagger finds in every sentence, with
    titles taken off persons and words that are no person left out. Offsets are code points of the
    passage; a repeated surface of a sentence stands where it stands next. Null texts give none."""

    def run(batches):
        for pdf in batches:
            rows = []
            for cid, text in zip(pdf["context_id"], pdf["context"], strict=True):
                for m in _SENTENCE.finditer(text or ""):
                    at = 0
                    for surface, kind in tagger(m.group()):
                        kind = TYPE_NAMES.get(kind.upper())
                        i = m.group().find(surface, at)
                        if kind is None or i < 0:
                            continue
                        at = i + len(surface)
                        bare = _TITLE.sub("", surface) if kind == "PER" else surface
                        if bare and not (kind == "PER" and bare in NO_PERSON):
                            start = m.start() + i + len(surface) - len(bare)
                            rows.append((cid, bare, kind, start, start + len(bare)))
            yield pd.DataFrame(rows, columns=["context_id", "surface", "type", "char_start", "char_end"])

    kind = passages.schema["context_id"].dataType.simpleString()
    return passages.select("context_id", "context").mapInPandas(run, f"context_id {kind}, surface string, type string, char_start int, char_end int")


def score_once(rows: DataFrame, keys: list[str], scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with what scorer adds to keys; every different key is scored once, however often it comes."""
    scored = scorer(rows.select(*keys).distinct())
    new = [c for c in scored.columns if c not in keys]
    scored = scored.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *new)
    on = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_key_{k}"))
        on = one if on is None else on & one
    return rows.join(scored, on, "left").drop(*[f"_key_{k}" for k in keys])


def prompt(context: Column, title: Column, wh: Column, level: Column, instructions: dict[str, str], limit: int = 2000) -> Column:
    """A generation prompt: passage, what is asked (by a table of instructions), level and format."""
    ask = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in instructions.items() for x in kv]), wh), F.lit(""))
    return F.format_string(
        "Passage (%s):\n%s\n\nWrite one question. %s Level: %s. Answer as JSON with question, correct_answer, distractors, evidence_sentence, bloom_level.",
        F.coalesce(title, F.lit("")), F.substring(context, 1, limit), ask, level,
    )


def char_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams of the text's words, each word between blanks."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != "")

    def grams(w: Column) -> Column:
        s = F.concat(F.lit(" "), w, F.lit(" "))
        each = [F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i, n=n: F.substring(s, i, n))).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)]
        return F.concat(*each)

    return F.flatten(F.transform(words, grams))


def train_level_classifier(rows: DataFrame, text: str, label: str, features: int = 20_000) -> tuple[PipelineModel, StringIndexerModel]:
    """TF-IDF of character n-grams and a logistic regression with classes weighted to balance."""
    index = StringIndexer(inputCol=label, outputCol="y", handleInvalid="skip").fit(rows)
    data = index.transform(rows).withColumn("grams", char_ngrams(F.col(text)))
    share = data.groupBy("y").agg(F.count("*").alias("n_y"))
    n, k = data.count(), len(index.labels)
    data = data.join(share, "y").withColumn("w", F.lit(float(n)) / (k * F.col("n_y")))
    steps = [
        CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=features), IDF(inputCol="tf", outputCol="tfidf"), Normalizer(inputCol="tfidf", outputCol="features"),
        LogisticRegression(labelCol="y", weightCol="w", maxIter=30, regParam=0.001),
    ]
    return Pipeline(stages=steps).fit(data), index


def predict_level(model: tuple[PipelineModel, StringIndexerModel], rows: DataFrame, text: str) -> DataFrame:
    """rows and predicted."""
    fitted, index = model
    names = F.array(*map(F.lit, index.labels))
    out = fitted.transform(rows.withColumn("grams", char_ngrams(F.col(text))))
    return out.select(*rows.columns, F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"))


def class_report(pairs: DataFrame, label: str, predicted: str) -> DataFrame:
    """class, n, precision, recall, f1 (six decimals; 0 where nothing was predicted)."""
    c = pairs.where(f"{label} is not null").groupBy(label, predicted).agg(F.count("*").alias("n"))
    t = c.groupBy(F.col(label).alias("class")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"))
    p = c.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("said"))
    j = t.join(p, "class", "left").fillna(0, ["said"])
    pr, re_ = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)), F.col("hit") / F.col("n")
    return j.select("class", "n", F.round(pr, 6).alias("precision"), F.round(re_, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * pr * re_, pr + re_), F.lit(0.0)), 6).alias("f1"))
