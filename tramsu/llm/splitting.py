"""Splits of records into train, dev and test that keep related records together."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramsu.functions.splits import split_name
from tramsu.functions.text import same_title
from tramsu.operators.graph import connected_components
from tramsu.operators.ordered import running_sums
from tramsu.session import cut

PROPORTIONS = {"train": 0.8, "dev": 0.1, "test": 0.1}


def rows_of(corpus: DataFrame, qa: DataFrame) -> DataFrame:
    """title key, context_id and split of all rows of both tables, counted (rows). Null and blank
    titles tie nothing."""
    cols = ["title", "context_id", "split"]
    both = corpus.select(*cols).unionByName(qa.select(*cols)).groupBy(*cols).agg(F.count("*").alias("rows"))
    titles = both.select("title").distinct().select("title", same_title(F.col("title")).alias("key"))
    return (
        both.join(titles, both["title"].eqNullSafe(titles["title"]))
        .select(F.when(F.col("key") != "", F.col("key")).alias("key"), "context_id", split_name(F.col("split")).alias("split"), "rows")
        .groupBy("key", "context_id", "split").agg(F.sum("rows").alias("rows"))
    )


def groups(rows: DataFrame, per_task: int = 250_000) -> DataFrame:
    """Adds the group of every row: rows of one title or one context_id are in one group, also
    through further rows. A row without either is its own group only with its like (group null).

    Every context is first tied to its least title, which leaves links between titles only (a
    forest of depth one for each context, built by partial aggregation however hot it is); union-find
    forests over the titles are then merged level by level.
    """
    ties = rows.where("context_id is not null and key is not null").groupBy("context_id", "key").agg(F.lit(1).alias("one"))
    least = ties.groupBy("context_id").agg(F.min("key").alias("least"))
    links = ties.join(least, "context_id").select("key", "least").distinct()
    titles = connected_components(links, per_task=per_task)
    home = least.join(titles, least["least"] == titles["node"]).select("context_id", F.col("component").alias("by_context"))
    out = rows.join(home, "context_id", "left").join(titles.select(F.col("node").alias("key"), F.col("component").alias("by_title")), "key", "left")
    alone = F.coalesce(F.concat(F.lit("title:"), "key"), F.concat(F.lit("context:"), "context_id"))
    tied = F.concat(F.lit("title:"), F.coalesce("by_context", "by_title"))
    return out.select("key", "context_id", "split", "rows", F.coalesce(tied, alone).alias("group"))


def quotas(sizes: list[tuple[int, int]], shares: dict[str, float], total: int) -> list[tuple[int, dict[str, int]]]:
    """sizes: (size, count of groups), any order. How many groups of each size every split gets if the largest group goes
    first, and each to the split furthest below its target (ties: the split named first).

    Equal groups are dealt in one step: of the values below - j * size of all splits the count greatest
    are taken, found by halving, and the last few one by one."""
    below = {s: Fraction(str(p)) * total for s, p in shares.items()}
    out = []
    for size, count in sorted(sizes, reverse=True):
        near = {s: float(v) for s, v in below.items()}
        low, high = min(near.values()) - size * (count + 1.0), max(near.values())
        for _ in range(80 if count > 1 else 0):
            level = (low + high) / 2
            if sum(max(0, math.ceil((v - level) / size)) for v in near.values()) > count:
                low = level
            else:
                high = level
        high += 1e-6 * size  # what is this near the level is dealt one by one, exactly
        taken = {s: max(0, math.ceil((v - high) / size)) for s, v in near.items()}
        for s, n in taken.items():
            below[s] -= n * size
        for _ in range(count - sum(taken.values())):
            s = max(below, key=below.get)
            below[s] -= size
            taken[s] += 1
        out.append((size, taken))
    return out


def assign(grouped: DataFrame, proportions: dict[str, float] | None = None) -> DataFrame:
    """group, size, new_split: largest group first, each to the split furthest below its target.

    The fold goes over sizes and how many groups have each (of N rows there are at most about the root of 2 N
    sizes); within a size groups are alike, and the splits' quotas are handed out by rank of the
    group's name, a running sum over all partitions. No rows give none.
    """
    shares = proportions or PROPORTIONS
    sizes = cut(grouped.groupBy("group").agg(F.sum("rows").alias("size")))
    counts = sizes.groupBy("size").agg(F.count("*").alias("n")).collect()
    dealt = quotas([(r["size"], r["n"]) for r in counts], shares, sum(r["size"] * r["n"] for r in counts))
    rows, names = [], list(shares)
    for size, taken in dealt:
        upto = 0
        for s in names:
            if taken[s]:
                rows.append((size, upto, upto + taken[s], s))
                upto += taken[s]
    spans = grouped.sparkSession.createDataFrame(rows, "size long, low long, high long, new_split string")
    ranked = running_sums(sizes.withColumn("one", F.lit(1).cast("long")), ["group"], {"rank": "one"}, by=("size",))
    return ranked.join(spans, "size").where("rank > low and rank <= high").select("group", "size", "new_split")


def keep_together(corpus: DataFrame, qa: DataFrame, proportions: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns (plan, broken): plan is context_id, group, new_split of every passage; broken is
    context_id, group, splits of each corpus passage whose group lies in more than one split now.

    Both tables need title, context_id, split; other columns are ignored. Split names count without
    regard to case, blanks and wording, a null split is none. Rows delivered again weigh again.
    Rows without a context_id join groups by title but are not in the plan. Empty tables give empty results.
    """
    rows = cut(groups(cut(rows_of(corpus, qa))))
    splits = rows.where("split is not null").groupBy("group").agg(F.sort_array(F.collect_set("split")).alias("splits"))
    passages = rows.where("context_id is not null").select("context_id", "group").distinct()
    plan = passages.join(assign(rows.where("group is not null"), proportions), "group").select("context_id", "group", "new_split")
    own = corpus.select("context_id").where("context_id is not null").distinct()
    broken = passages.join(own, "context_id", "left_semi").join(splits.where(F.size("splits") > 1), "group").select("context_id", "group", "splits")
    return plan, broken
