"""Groups of questions that ask the same, across contexts and methods."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramsu.functions.text import fold_words_of
from tramsu.llm.overlap import HELD, sharing
from tramsu.llm.same import same_question
from tramsu.operators.graph import connected_components
from tramsu.session import cut, keep, spread


def _rid(words: str) -> int:
    """64 bits of the hash of a text's folded words."""
    return int.from_bytes(hashlib.sha256(words.encode()).digest()[:8], "big", signed=True)


class _Folded(dict):
    """Folded words of blank-free chunks, joined by blanks. It is emptied when it holds HELD."""

    def __missing__(self, chunk: str) -> str:
        if len(self) >= HELD:
            self.clear()
        got = self[chunk] = " ".join(fold_words_of.__wrapped__(chunk))
        return got


def _canon(batches):
    folded = _Folded()
    for pdf in batches:
        words = [" ".join(filter(None, map(folded.__getitem__, x.split()))) for x in pdf["text"]]
        pdf["rid"] = pd.array([_rid(w) if w else None for w in words], dtype="Int64")
        yield pdf


def canon_of(rows: DataFrame, *extra: str) -> DataFrame:
    """rows: key (string), text and extra columns. Returns key, extra, text and rid, the hash of the
    text's folded words; null keys, null texts and texts without a word are dropped."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    cols = ["key", *extra, "text"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in cols) + ", rid long"
    known = rows.select(*cols).where("key is not null and text is not null")
    return known.mapInPandas(_canon, schema).where("rid is not null")


def with_text(rows: DataFrame, *marks) -> DataFrame:
    """rows: key, text, rid. rid, the text that stands for all with the same words (the least record's, of its texts the least) and the
    aggregates marks. Texts are shuffled once, into as many parts as there are cores or more: they are read by part again and again."""
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "rid").groupBy("rid").agg(F.min(F.struct("key", "text")).alias("m"), *marks).withColumn("text", F.col("m.text")).drop("m")


def _verify(same):
    def run(batches):
        for pdf in batches:
            keep = [same(a, b) for a, b in zip(pdf["ta"], pdf["tb"], strict=True)]
            yield pdf.loc[keep, ["x", "y"]]

    return run


#: The least weight that the common words of one question in two wordings have (see overlap.sharing).
SHARE = 0.65


#: Bits of the map of the records that stand in a pair: 1 MB, whatever the data's size.
BITS = 1 << 23


def of_pairs(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """nodes (rid) without most of those that stand in no pair x, y (which is read twice: cut it before), so that their
    texts need not be shuffled. None that stands in a pair is missing; a few others, with the same bit, are left."""
    at = pairs.select(F.explode(F.array("x", "y")).alias("rid")).select(F.pmod("rid", F.lit(BITS)).cast("int").alias("bit")).distinct()
    bits = np.zeros(BITS, dtype=np.uint8)
    bits[at.toPandas()["bit"].to_numpy(dtype=np.int64)] = 1  # at most BITS rows
    held = nodes.sparkSession.sparkContext.broadcast(np.packbits(bits))

    @F.pandas_udf("boolean")
    def stands(rid: pd.Series) -> pd.Series:
        bit = rid.to_numpy(dtype=np.int64) % BITS
        return pd.Series((held.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool))

    return nodes.where(stands("rid"))


def same_pairs(nodes: DataFrame, share: float = SHARE, same=same_question) -> DataFrame:
    """nodes: rid, text, left, right. Pairs x, y whose common words weigh share and that pass same(text, text)."""
    found = cut(sharing(nodes, share))
    text = of_pairs(nodes.select("rid", "text"), found)
    with_a = found.join(text.select(F.col("rid").alias("x"), F.col("text").alias("ta")), "x")
    with_b = with_a.join(text.select(F.col("rid").alias("y"), F.col("text").alias("tb")), "y")
    return with_b.select("x", "y", "ta", "tb").mapInPandas(_verify(same), "x long, y long")


def groups(items: DataFrame, key: str = "item_id", text: str = "question") -> tuple[DataFrame, DataFrame]:
    """Returns (members, links): key, group of every item (the group's name is its least item's
    key), and the links x, y between representatives of different texts that the groups come from.

    Questions with the same words in the same order (case, accents, punctuation and blanks aside)
    have one representative, the least key, which keeps a hot group of copies from meeting itself.
    Representatives with the common words that same_question asks for (see sharing) are compared word by word (see
    same_question): typos, some words more, less or other, clauses in another order are small
    edits; another name, number or year is not. Groups are the components of these links.

    An item under several texts joins their groups. Null and wordless questions are in no group;
    further columns are ignored; an empty table gives none.
    """
    source = items.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    rows = keep(canon_of(spread(source)))
    nodes = keep(with_text(rows).select("rid", "text", F.lit(True).alias("left"), F.lit(True).alias("right")))
    links = cut(same_pairs(nodes))
    own = rows.select("key", F.col("rid").alias("node")).distinct()
    edges = links.select("x", "y")
    # items ties too, but only such as stand under several texts
    several = own.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    ties = own.join(several, "key").where("node <> least").select(F.col("node").alias("x"), F.col("least").alias("y"))
    comp = connected_components(edges.unionByName(ties))
    placed = own.join(comp, "node", "left").select("key", F.coalesce("component", "node").alias("component")).distinct()
    names = placed.groupBy("component").agg(F.min("key").alias("group"))
    return placed.join(names, "component").select("key", "group"), links


def pairs(members: DataFrame) -> DataFrame:
    """a, b: all pairs of different keys of one group, the smaller first by binary order."""
    a = members.select("group", F.col("key").alias("a"))
    b = members.select("group", F.col("key").alias("b"))
    return a.join(b, "group").where("a < b").select("a", "b").distinct()
