"""Connected components by union-find forests that are merged level by level."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramsu.session import cut


def forest(pairs, rank) -> dict:
    """Union-find with path halving over pairs; each node's root is the least of its tree by rank."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent.setdefault(parent[x], parent[x])
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            if rank(b) < rank(a):
                a, b = b, a
            parent[b] = a
    return {x: find(x) for x in list(parent)}


def _local_forests(level: int):
    def run(batches):
        def pairs():
            for pdf in batches:
                yield from zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True)

        import xxhash

        memo: dict = {}

        def rank(x):
            if x not in memo:
                memo[x] = (xxhash.xxh64_intdigest(str(x).encode(), seed=level), x)
            return memo[x]

        roots = forest(pairs(), rank)
        rows = [(x, r) for x, r in roots.items() if x != r]
        for i in range(0, len(rows), 50_000):
            yield pd.DataFrame(rows[i : i + 50_000], columns=["a", "b"])

    return run


def connected_components(edges: DataFrame, per_task: int = 250_000) -> DataFrame:
    """edges: two columns of one type, any names. Returns node and component (the least node of it,
    by the type's order); a node needs an edge (a loop will do) to be returned.

    Each level cuts the edges into tasks of about per_task edges, turns every task's edges into a
    local union-find forest (at most one edge a node), lets every node keep one root and hands on
    only what ties the remaining roots together. Which node is a root is drawn anew at each level,
    so a constant share of the nodes leaves; once all edges fit one task, one forest ends it.
    No task ever gets more than its share, and the driver gets none.
    Null ends are dropped; loops, repeated and reversed edges do no harm; no edges give no rows.
    """
    x, y = edges.columns[:2]
    kind = edges.schema[0].dataType.simpleString()
    edges = edges.select(F.col(x).alias("a"), F.col(y).cast(kind).alias("b")).where("a is not null and b is not null")
    nodes = edges.select("a").union(edges.select("b")).distinct()
    todo = cut(edges.where("a <> b").distinct())
    kept: list[DataFrame] = []
    level = 0
    while n := todo.count():
        tasks = max(1, math.ceil(n / per_task))
        spread = todo.coalesce(1) if tasks == 1 else todo.repartition(tasks, F.xxhash64(F.least("a", "b"), F.lit(level)))
        roots = spread.mapInPandas(_local_forests(level), f"a {kind}, b {kind}")
        if tasks == 1:
            kept.append(cut(roots))
            break
        roots = cut(roots)
        own = roots.groupBy("a").agg(F.min("b").alias("r"))
        rest = roots.join(own, "a").where("b <> r").select(F.col("b").alias("a"), F.col("r").alias("b"))
        still = own.join(roots.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", F.col("r").alias("b"))
        kept.append(cut(own.join(still, "a", "left_anti").select("a", F.col("r").alias("b"))))
        todo = cut(rest.union(still).distinct())
        level += 1
    found = None
    for own in reversed(kept):
        if found is None:
            found = own
        else:
            up = found.select(F.col("a").alias("r"), F.col("b").alias("top"))
            found = found.union(own.join(up, own["b"] == up["r"], "left").select("a", F.coalesce("top", "b").alias("b")))
    if found is None:
        return nodes.select(F.col("a").alias("node"), F.col("a").alias("component"))
    labelled = nodes.join(found, "a", "left").select(F.col("a").alias("node"), F.coalesce("b", "a").alias("root"))
    least = labelled.groupBy("root").agg(F.min("node").alias("component"))
    return labelled.join(least, "root").select("node", "component")
