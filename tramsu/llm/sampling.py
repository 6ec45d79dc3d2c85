"""Samples whose shares of categories match given targets, by systematic unequal-probability sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramsu.functions.text import fold, same_title
from tramsu.operators.ordered import running_sums
from tramsu.session import cut

#: Inclusion probabilities are whole numbers of this unit, so sums are exact in any partitioning.
UNIT = 1_000_000_000


def level_key(c: Column) -> Column:
    """A level without regard to case, accents and separators; empty for null and blank."""
    return F.regexp_replace(F.coalesce(fold(c), F.lit("")), r"[^\p{L}\p{N}]+", "")


def _draw(seed: int, *cols: str) -> Column:
    """A uniform 60-bit number that depends on seed and cols alone."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]), 256), 1, 15), 16, 10).cast("long")


def needed(blueprint: DataFrame) -> DataFrame:
    """The wanted rows: blueprint_id, bloom, level, title key, target (decimal) and needed, the
    larger of min_items and sample_size x target_share in decimals, rounded up."""
    share = F.col("sample_size").cast("decimal(18,0)") * F.col("target_share").cast("decimal(12,9)")
    target = F.greatest(share, F.col("min_items").cast("decimal(18,9)"))
    return blueprint.select(
        "blueprint_id",
        "bloom",
        level_key(F.col("bloom")).alias("level"),
        same_title(F.col("title")).alias("want_title"),
        F.col("min_items").cast("long").alias("floor_items"),
        target.cast("double").alias("target"),
        F.ceil(target).cast("long").alias("needed"),
    ).distinct()


def available(bank: DataFrame) -> DataFrame:
    """Distinct item_id, level and title key of the items with a verifier_score from 0 to 1 (null
    and NaN are not). An item that is delivered again counts once."""
    score = F.col("verifier_score")
    good = bank.where(score.isNotNull() & ~F.isnan(score) & score.between(0.0, 1.0) & F.col("item_id").isNotNull())
    return (
        good.select("item_id", "bloom", "title")
        .distinct()
        .select("item_id", level_key(F.col("bloom")).alias("level"), same_title(F.col("title")).alias("item_title"))
        .distinct()
    )


def sample(bank: DataFrame, blueprint: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Draws every sample of blueprint from bank. Returns (sample, report).

    sample: blueprint_id, bloom, item_id, how ('systematic' or 'floor').
    report: blueprint_id, bloom, available, needed, selected, unmet.

    Within a blueprint the items stand in the order of the levels, in random order within a level;
    inclusion probabilities (target over available, 1 at most) are summed over that order across
    all partitions, and an item is taken where the sum passes a whole number after one random
    start. A level that then has fewer than its floor gets further items in its random order.
    A level with fewer items than needed is taken whole and reported as unmet.

    Bank: needs item_id, bloom, title, verifier_score; other columns are ignored. Null or unknown
    bloom is of no level, a null title of no title; an empty bank gives an empty sample and a
    report of every wanted row; a blueprint without rows gives neither. Repeated blueprint rows count once.
    """
    want, items = needed(blueprint), cut(available(bank))
    whole = want.where("want_title is null").join(items, "level").drop("item_title")
    titled = want.where("want_title is not null").join(
        items.withColumnRenamed("item_title", "want_title"), ["level", "want_title"]
    )
    # an item whose title was delivered in two spellings of one title is one item
    frame = cut(whole.unionByName(titled).select("blueprint_id", "level", "item_id", "floor_items", "target").distinct())
    size = frame.groupBy("blueprint_id", "level").agg(F.count("*").alias("n"))
    frame = frame.join(size, ["blueprint_id", "level"]).withColumns(
        {
            "p": F.least(F.lit(UNIT), F.floor(F.lit(UNIT) * F.col("target") / F.col("n"))).cast("long"),
            "draw": _draw(seed, "blueprint_id", "level", "item_id"),
        }
    )
    summed = running_sums(frame, ["level", "draw", "item_id"], {"upto": "p"}, by=("blueprint_id",))
    start = F.pmod(_draw(seed + 1, "blueprint_id"), F.lit(UNIT))
    whole_before = F.floor((F.col("upto") - F.col("p") + start) / UNIT)
    taken = summed.withColumn("taken", F.floor((F.col("upto") + start) / UNIT) > whole_before)
    # floors: how many more a level needs, and its first items in random order that were not taken
    counts = taken.groupBy("blueprint_id", "level").agg(
        F.sum(F.col("taken").cast("long")).alias("got"), F.first("floor_items").alias("floor_items")
    )
    short = counts.where("got < floor_items").select("blueprint_id", "level", (F.col("floor_items") - F.col("got")).alias("more"))
    spare = taken.where(~F.col("taken")).join(short, ["blueprint_id", "level"])
    rank = Window.partitionBy("blueprint_id", "level").orderBy("draw", "item_id")
    spare = spare.withColumn("k", F.row_number().over(rank)).where("k <= more")
    cols = ["blueprint_id", "level", "item_id"]
    drawn = taken.where("taken").select(*cols, F.lit("systematic").alias("how")).unionByName(spare.select(*cols, F.lit("floor").alias("how")))
    drawn = cut(drawn)
    names = want.select("blueprint_id", "level", "bloom", "needed")
    got = drawn.groupBy("blueprint_id", "level").agg(F.count("*").alias("selected"))
    zero = {"n": 0, "selected": 0}
    report = (
        names.join(size, ["blueprint_id", "level"], "left").join(got, ["blueprint_id", "level"], "left").fillna(zero)
        .select(
            "blueprint_id", "bloom", F.col("n").alias("available"), "needed", "selected",
            # a level that cannot be met is taken whole
            ((F.col("selected") >= F.col("n")) & (F.col("n") < F.col("needed"))).alias("unmet"),
        )
    )
    return drawn.join(names, ["blueprint_id", "level"]).select("blueprint_id", "bloom", "item_id", "how"), report
