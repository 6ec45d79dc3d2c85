"""Selection of an examination from a bank: by score, at random, or the best under constraints."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramsu.functions.normalize import LEVELS


def targets(spark: SparkSession, ratio: dict[str, float], k: int) -> DataFrame:
    """level, target: the normalised shares of k, each rounded half to even, the last level what is left."""
    rows = [(i, level, float(ratio.get(level, 0.0))) for i, level in enumerate(LEVELS)]
    t = spark.createDataFrame(rows, "i int, level string, r double")
    t = t.withColumn("raw", F.bround(F.lit(k) * F.col("r") / F.sum("r").over(Window.partitionBy(F.lit(0))), 0).cast("long"))
    before = F.coalesce(F.sum("raw").over(Window.partitionBy(F.lit(0)).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.select("level", F.when(F.col("i") == len(LEVELS) - 1, F.greatest(F.lit(0), F.lit(k) - before)).otherwise(F.col("raw")).alias("target"))


def usable(bank: DataFrame) -> DataFrame:
    """One row an item with a score from 0 to 1 and a level of the scale: item_id, bloom, context_id, title, score."""
    good = bank.where(F.col("bloom").isin(*LEVELS) & F.col("verifier_score").between(0, 1) & ~F.isnan("verifier_score"))
    return good.groupBy("item_id").agg(*[F.min(c).alias(c) for c in ("bloom", "context_id", "title")], F.max("verifier_score").alias("score"))


def shortlist(items: DataFrame, k: int, per_context: int) -> DataFrame:
    """Items among which there is a best selection of k, with must: whether their title has to be covered. A context belongs to
    its least title. Titles of two items or more must be covered, if they are no more than k; null is no title.

    Kept are, of the per_context best of each context and level, the 2 k best of each level and the best of each level of
    each title that must be covered. That is enough: a selected item outside of it that is not its title's only one has
    2 k better ones of its level, of which at most k - 1 are selected and as many again stand in
    contexts that are full; the only one of its title can give way to that title's best of the level, as none of that
    title's contexts has another. So there are at most 3 k x levels rows, whatever the bank's size."""
    by = lambda *c: Window.partitionBy(*c).orderBy(F.desc("score"), "item_id")
    home = items.groupBy(F.col("context_id").alias("place")).agg(F.min("title").alias("home"))
    placed = items.drop("title").join(home, F.col("context_id").eqNullSafe(F.col("place"))).withColumnRenamed("home", "title").drop("place")
    many = placed.where("title is not null").groupBy("title").agg(F.count("*").alias("n")).where("n > 1").select("title")
    some = many.limit(k + 1)  # one more than may be covered tells that none has to be
    must = some.join(some.agg(F.count("*").alias("titles")), F.col("titles") <= k).select("title", F.lit(True).alias("must"))
    first = placed.withColumn("r", F.row_number().over(by("context_id", "bloom"))).where(F.col("r") <= per_context).drop("r")
    cols = ["item_id", "bloom", "context_id", "title", "score"]
    of_level = first.withColumn("r", F.row_number().over(by("bloom"))).where(F.col("r") <= 2 * k).select(*cols)
    of_title = first.join(must, "title", "left_semi").withColumn("r", F.row_number().over(by("title", "bloom"))).where("r = 1").select(*cols)
    return of_level.union(of_title).distinct().join(must, "title", "left").select(*cols, F.coalesce("must", F.lit(False)).alias("must"))


def greedy(items: DataFrame, k: int, target: dict[str, int], per_context: int = 2) -> DataFrame:
    """The selected items by score (ties: item_id): first no level beyond its target plus one, then,
    if fewer than k are found, regardless of level; never more than per_context of a context."""

    def fold(batches):
        frames = list(batches)
        if not frames:
            return
        pdf = pd.concat(frames, ignore_index=True).sort_values(["score", "item_id"], ascending=[False, True])
        level, context, taken = dict.fromkeys(LEVELS, 0), {}, []
        for strict in (True, False):
            for row in pdf.itertuples():
                if len(taken) == k:
                    break
                if row.Index in taken or context.get(row.context_id, 0) >= per_context or strict and level[row.bloom] >= target.get(row.bloom, 0) + 1:
                    continue
                taken.append(row.Index)
                level[row.bloom] += 1
                context[row.context_id] = context.get(row.context_id, 0) + 1
        yield pdf.loc[taken]

    return shortlist(items, k, per_context).drop("must").coalesce(1).mapInPandas(fold, "item_id string, bloom string, context_id string, title string, score double")


def at_random(items: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k items in the order of the md5 of seed and item_id."""
    return items.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), "item_id")), "item_id").limit(k)


class Flow:
    """Minimum-cost flow by successive shortest paths with potentials; costs may be negative at first."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[float] = []

    def arc(self, a: int, b: int, cap: int, cost: float) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def push(self, s: int, t: int, units: int) -> int:
        n = len(self.out)
        height = [0.0] * n
        for _ in range(n):  # Bellman-Ford, once, as costs are negative
            moved = False
            for a in range(n):
                for e in self.out[a]:
                    if self.cap[e] > 0 and height[a] + self.cost[e] < height[self.to[e]] - 1e-12:
                        height[self.to[e]] = height[a] + self.cost[e]
                        moved = True
            if not moved:
                break
        sent = 0
        while sent < units:
            dist, via, heap = [float("inf")] * n, [-1] * n, [(0.0, s)]
            dist[s] = 0.0
            while heap:
                d, a = heapq.heappop(heap)
                if d > dist[a] + 1e-12:
                    continue
                for e in self.out[a]:
                    b = self.to[e]
                    nd = d + self.cost[e] + height[a] - height[b]
                    if self.cap[e] > 0 and nd < dist[b] - 1e-12:
                        dist[b], via[b] = nd, e
                        heapq.heappush(heap, (nd, b))
            if dist[t] == float("inf"):
                break
            for a in range(n):
                if dist[a] < float("inf"):
                    height[a] += dist[a]
            room, a = units - sent, t
            while a != s:
                room, a = min(room, self.cap[via[a]]), self.to[via[a] ^ 1]
            a = t
            while a != s:
                self.cap[via[a]] -= room
                self.cap[via[a] ^ 1] += room
                a = self.to[via[a] ^ 1]
            sent += room
        return sent


def best(items: DataFrame, k: int, target: dict[str, int], per_context: int = 2, slack: int = 2) -> DataFrame:
    """The k items of the greatest total score such that each level with a target and items is within
    slack of it, no context has more than per_context, and, if they are no more than k, every title
    with two items or more has one. Empty if that cannot be. A context belongs to its least title.

    It is a flow: start, level, item, context, title, end; exact, as flows are whole. Solved in one
    task over the shortlist, whose size k and the number of titles bound."""

    def solve(batches):
        frames = list(batches)
        if not frames:
            return
        pdf = pd.concat(frames, ignore_index=True).sort_values("item_id", ignore_index=True)
        asked = pdf.drop(columns="must")
        for c in ("context_id", "title"):  # none is not the empty one
            pdf[c] = [(isinstance(v, str), v if isinstance(v, str) else "") for v in pdf[c]]
        levels, contexts, titles = sorted(pdf["bloom"].unique()), sorted(set(pdf["context_id"])), sorted(set(pdf["title"]))
        must = set(pdf.loc[pdf["must"], "title"])
        n0 = 1 + len(levels)
        node_c = {c: n0 + 2 * len(pdf) + i for i, c in enumerate(contexts)}
        node_t = {t: n0 + 2 * len(pdf) + len(contexts) + i for i, t in enumerate(titles)}
        end = n0 + 2 * len(pdf) + len(contexts) + len(titles)
        flow, force, big = Flow(end + 1), [], 1e4
        for i, level in enumerate(levels):
            want = target.get(level, 0)
            low, high = (max(0, want - slack), want + slack) if want > 0 else (0, k)
            low = min(low, k)
            if low:
                force.append(flow.arc(0, 1 + i, low, -big))
            flow.arc(0, 1 + i, high - low, 0.0)
        arcs = []
        for j, row in enumerate(pdf.itertuples()):
            a, b = n0 + 2 * j, n0 + 2 * j + 1
            flow.arc(1 + levels.index(row.bloom), a, 1, 0.0)
            arcs.append(flow.arc(a, b, 1, -row.score))
            flow.arc(b, node_c[row.context_id], 1, 0.0)
        for c, t in dict(zip(pdf["context_id"], pdf["title"], strict=True)).items():
            flow.arc(node_c[c], node_t[t], per_context, 0.0)
        for t in titles:
            if t in must:
                force.append(flow.arc(node_t[t], end, 1, -big))
            flow.arc(node_t[t], end, k, 0.0)
        sent = flow.push(0, end, k)
        feasible = sent == k and all(flow.cap[e] == 0 for e in force)
        yield asked[[feasible and flow.cap[e] == 0 for e in arcs]]

    return shortlist(items, k, per_context).coalesce(1).mapInPandas(solve, "item_id string, bloom string, context_id string, title string, score double")


def numbered(selected: DataFrame) -> DataFrame:
    """The selection sorted by level and title (ties: item_id), numbered from 1."""
    return selected.withColumn("no", F.row_number().over(Window.orderBy("bloom", "title", "item_id")))


def statistics(selected: DataFrame, target: DataFrame) -> DataFrame:
    """level, n, target, near (within one)."""
    n = selected.groupBy(F.col("bloom").alias("level")).agg(F.count("*").alias("n"))
    return target.join(n, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"), "target", (F.abs(F.coalesce("n", F.lit(0)) - F.col("target")) <= 1).alias("near"))


def method_counts(selected: DataFrame, bank: DataFrame) -> DataFrame:
    """method, n, titles: how many selected items come from each method, and how many titles these cover."""
    of = bank.groupBy("item_id").agg(F.min("method").alias("method"))
    return selected.join(of, "item_id").groupBy("method").agg(F.count("*").alias("n"), F.countDistinct("title").alias("titles"))


def compare(selections: dict[str, DataFrame], base: str) -> DataFrame:
    """strategy, n, score, avg_score, gain_pct over the base's score, one decimal."""
    all_ = None
    for name, s in selections.items():
        one = s.agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("score"), F.lit(0.0)), 4).alias("score")).select(F.lit(name).alias("strategy"), "n", "score")
        all_ = one if all_ is None else all_.unionByName(one)
    ground = all_.where(F.col("strategy") == base).select(F.col("score").alias("b"))
    return all_.crossJoin(ground).select("strategy", "n", "score", F.round(F.try_divide("score", "n"), 4).alias("avg_score"), F.round(100 * F.try_divide(F.col("score") - F.col("b"), "b"), 1).alias("gain_pct"))
