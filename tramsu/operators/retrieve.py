"""Lexical and dense retrieval, and their fusion. Postings, norms and ranks are tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramsu.session import cut

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60


def tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf and dl of lower-cased, blank-separated terms."""
    words = F.filter(F.split(F.lower(F.translate(text, "\u00a0", " ")), r"\s+"), lambda w: w != "")
    rows = docs.select(F.col(key).alias("doc"), words.alias("w")).select("doc", F.size("w").alias("dl"), F.explode("w").alias("term"))
    return rows.groupBy("doc", "dl", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, top: int = 10) -> DataFrame:
    """queries: q, text. q, doc, score, rank of the top documents with a score above 0 by BM25 Okapi
    (negative inverse document frequencies become a quarter of the mean one); ties by doc. A term
    repeated in a query counts repeatedly. Only the terms of queries are joined with the postings."""
    post = cut(tokens(docs, key, text))  # read three times
    lengths = post.select("doc", "dl").distinct().agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = post.groupBy("term").agg(F.count("*").alias("df")).crossJoin(lengths)
    idf = df.select("term", "avgdl", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    mean = idf.agg(F.avg("raw").alias("mean"))
    idf = idf.crossJoin(mean).select("term", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    asked = tokens(queries, "q", "text").select(F.col("doc").alias("q"), "term", F.col("tf").alias("times"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = asked.join(idf, "term").join(post, "term").groupBy("q", "doc").agg(F.round(F.sum(F.col("times") * weight), 6).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def dense(vectors: DataFrame, queries: DataFrame, key: str, vec: str, top: int = 5, block: int = 256) -> DataFrame:
    """queries: q, vec. q, doc, score, rank by inner product of unit vectors, exact.

    Queries go in blocks of bounded size against all rows; every task keeps its own best top for
    each query of the block, so only those are shuffled. Null vectors are left out."""
    rows = queries.where("vec is not null").select("q", "vec").orderBy("q").toPandas()  # the stated query set, see the README
    ids, mat = rows["q"].to_numpy(), np.array(rows["vec"].tolist(), dtype=np.float64)
    held = vectors.sparkSession.sparkContext.broadcast((ids, mat))
    kind = vectors.schema[key].dataType.simpleString()

    def best(batches):
        ids, mat = held.value
        for pdf in batches:
            if not len(pdf) or not len(ids):
                continue
            docs, x = pdf[key].to_numpy(), np.array(pdf[vec].tolist(), dtype=np.float64)
            for lo in range(0, len(ids), block):
                s = mat[lo : lo + block] @ x.T
                k = min(top, s.shape[1])
                # all that tie with the k-th are kept, so the order by doc decides
                edge = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                i, j = np.nonzero(s >= edge - 1e-9)
                yield pd.DataFrame({"q": ids[lo + i], "doc": docs[j], "score": np.round(s[i, j], 4)})

    near = vectors.where(F.col(vec).isNotNull()).select(key, vec).mapInPandas(best, f"q {queries.schema['q'].dataType.simpleString()}, doc {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc"))
    return near.withColumn("rank", rank).where(F.col("rank") <= top)


def fuse(first: DataFrame, second: DataFrame, top: int = 5) -> DataFrame:
    """q, doc, score, rank: reciprocal ranks of two ranked lists added; ties by doc."""
    both = first.select("q", "doc", "rank").unionByName(second.select("q", "doc", "rank"))
    scored = both.groupBy("q", "doc").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)
