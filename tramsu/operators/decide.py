"""Multi-criteria decisions over long tables (alternative, criterion, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The criteria and their pairwise comparison (upper triangle by rows), and the random indices by size.
CRITERIA = ["vqr", "evidence_match", "single_correct", "distractor_type_match", "historical_correctness", "question_clarity", "bloom_fidelity", "duplicate_check"]
COMPARISON = [[2, 3, 3, 2, 2, 3, 4], [2, 2, 2, 2, 2, 3], [2, 1, 2, 2, 3], [1, 1, 2, 3], [2, 2, 3], [1, 2], [2]]
RANDOM_INDEX = {1: 0.0, 2: 0.0, 3: 0.58, 4: 0.90, 5: 1.12, 6: 1.24, 7: 1.32, 8: 1.41, 9: 1.45, 10: 1.49}


def comparison_matrix(spark: SparkSession, names: list[str] | None = None, upper: list[list[float]] | None = None) -> DataFrame:
    """i, j, value of a reciprocal matrix given by its upper triangle."""
    names, upper = names or CRITERIA, upper or COMPARISON
    rows = [(c, c, 1.0) for c in names]
    for a, line in enumerate(upper):
        for k, v in enumerate(line):
            rows += [(names[a], names[a + 1 + k], float(v)), (names[a + 1 + k], names[a], 1.0 / v)]
    return spark.createDataFrame(rows, "i string, j string, value double")


def ahp(matrix: DataFrame) -> DataFrame:
    """criterion, weight, lambda_max, cr: columns normalised, rows averaged; the ratio of
    consistency by the random index of the matrix's size (0 up to two criteria)."""
    col = matrix.groupBy("j").agg(F.sum("value").alias("s"))
    w = matrix.join(col, "j").groupBy("i").agg(F.avg(F.col("value") / F.col("s")).alias("w"))
    product = matrix.join(w.select(F.col("i").alias("j"), F.col("w").alias("wj")), "j").groupBy("i").agg(F.sum(F.col("value") * F.col("wj")).alias("aw"))
    whole = product.join(w, "i").agg(F.avg(F.col("aw") / F.col("w")).alias("l"), F.count("*").alias("n"))
    index = F.create_map(*[F.lit(x) for kv in RANDOM_INDEX.items() for x in kv])
    ri = F.try_element_at(index, F.col("n").cast("int"))
    cr = F.when(ri > 0, ((F.col("l") - F.col("n")) / (F.col("n") - 1)) / ri).otherwise(0.0)
    return w.crossJoin(whole).select(F.col("i").alias("criterion"), F.round("w", 4).alias("weight"), F.round("l", 4).alias("lambda_max"), F.round(cr, 4).alias("cr"), F.col("w").alias("exact"))


def topsis(values: DataFrame, weights: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """values: alternative, criterion, value (by, if weights differ by it); weights: criterion,
    weight, benefit, by. alternative, topsis_score, d_pis, d_nis, rank within by: vector
    normalisation, distances to the best and the worst, closeness. Ties by alternative."""
    t = values.join(weights, ["criterion"])
    one = Window.partitionBy(*by, "criterion")
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(one))
    t = t.withColumn("v", F.col("weight") * F.col("value") / F.when(norm == 0, 1e-10).otherwise(norm))
    hi, lo = F.max("v").over(one), F.min("v").over(one)
    t = t.withColumns({"best": F.when(F.col("benefit"), hi).otherwise(lo), "worst": F.when(F.col("benefit"), lo).otherwise(hi)})
    d = t.groupBy(*by, "alternative").agg(
        F.sqrt(F.sum((F.col("v") - F.col("best")) ** 2)).alias("dp"), F.sqrt(F.sum((F.col("v") - F.col("worst")) ** 2)).alias("dn")
    )
    score = F.col("dn") / (F.col("dp") + F.col("dn") + 1e-10)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("topsis_score"), "alternative") if by else Window.orderBy(F.desc("topsis_score"), "alternative"))
    out = d.select(*by, "alternative", F.round(score, 4).alias("topsis_score"), F.round("dp", 4).alias("d_pis"), F.round("dn", 4).alias("d_nis"))
    return out.withColumn("rank", rank)


def live_topsis(values: DataFrame, weights: DataFrame) -> DataFrame:
    """topsis with weights as a user set them: divided by their sum (equal ones if that is 0), every criterion a benefit."""
    total = weights.agg(F.sum("weight").alias("total"), F.count("*").alias("n"))
    share = F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(1 / F.col("n"))
    return topsis(values, weights.join(total).select("criterion", share.alias("weight"), F.lit(True).alias("benefit")))


def sensitivity(values: DataFrame, weights: DataFrame, vary: str, steps: int = 20, low: float = 0.01, high: float = 0.50) -> DataFrame:
    """step, w, alternative, topsis_score for weights of one criterion from low to high, the others
    scaled to what is left."""
    spark = values.sparkSession
    grid = spark.range(steps).select(F.col("id").alias("step"), (F.lit(low) + F.col("id") * (high - low) / (steps - 1)).alias("w"))
    old = weights.where(F.col("criterion") == vary).select(F.col("weight").alias("w_old"))
    varied = weights.crossJoin(grid).crossJoin(old)
    new = F.when(F.col("criterion") == vary, F.col("w")).otherwise(F.col("weight") * (1 - F.col("w")) / (1 - F.col("w_old")))
    varied = varied.select("step", "w", "criterion", "benefit", new.alias("raw"))
    varied = varied.withColumn("weight", F.col("raw") / F.sum("raw").over(Window.partitionBy("step"))).drop("raw")
    scored = topsis(values, varied, by=("step", "w"))
    return scored.select("step", F.round("w", 3).alias("weight_varied"), "alternative", "topsis_score")


def crossovers(scores: DataFrame) -> DataFrame:
    """a, b, step, weight: where the order of two alternatives changes between neighbouring steps,
    at the middle of their weights."""
    b = scores.select("step", F.col("alternative").alias("b"), F.col("topsis_score").alias("sb"))
    both = scores.select("step", "weight_varied", F.col("alternative").alias("a"), F.col("topsis_score").alias("sa")).join(b, "step").where("a < b")
    w = Window.partitionBy("a", "b").orderBy("step")
    ahead = F.col("sa") > F.col("sb")
    both = both.withColumns({"now": ahead, "was": F.lag(ahead).over(w), "w_was": F.lag("weight_varied").over(w)})
    return both.where("was is not null and now <> was").select("a", "b", "step", F.round((F.col("weight_varied") + F.col("w_was")) / 2, 4).alias("weight"))


def strengths(values: DataFrame) -> DataFrame:
    """alternative, best_at: the criteria at which it alone is best (sorted), else the one at which it stands highest."""
    one = Window.partitionBy("criterion")
    top = F.max("value").over(one)
    t = values.withColumn("top", top)
    t = t.withColumn("lead", F.col("value") == F.col("top"))
    t = t.withColumn("alone", F.col("lead") & (F.sum(F.col("lead").cast("int")).over(one) == 1))
    per = t.groupBy("alternative").agg(F.sort_array(F.collect_set(F.when(F.col("alone"), F.col("criterion")))).alias("w"), F.max(F.struct("value", "criterion")).alias("m"))
    return per.select("alternative", F.when(F.size("w") > 0, F.array_join("w", ",")).otherwise(F.col("m.criterion")).alias("best_at"))
