"""Checks of items, each a score from 0 to 1 and whether it passes, and the verdict over them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramsu.functions import normalize as N
from tramsu.operators.ordered import running_sums
from tramsu.session import cut

#: The checks in order with their weights, and the bounds of the verdict.
WEIGHTS = {
    "evidence_match": 0.20, "single_correct": 0.18, "distractor_type_match": 0.14, "historical_correctness": 0.12,
    "question_clarity": 0.10, "duplicate_check": 0.10, "bloom_fidelity": 0.10, "answer_position_ok": 0.06,
}
ACCEPTED, REVIEW = 0.75, 0.55
#: Pronouns without antecedent, and scores by distance of levels.
PRONOUNS = ["nó", "điều này", "điều đó", "đây", "đó", "họ", "chúng"]
LEVEL_SCORES = [1.0, 0.6, 0.2, 0.0]


def evidence_match(label: Column) -> Column:
    """The score of an inference label of passage and answer."""
    return F.when(label == "entailment", 1.0).when(label == "neutral", 0.4).otherwise(0.0)


def single_correct(labels: DataFrame) -> DataFrame:
    """labels: item_id, is_correct, label, one row an option. 1 if the correct option alone is
    entailed, 0.5 if it and one more are, else 0."""
    yes = F.col("label") == "entailment"
    per = labels.groupBy("item_id").agg(F.count_if(yes).alias("n"), F.count_if(yes & F.col("is_correct")).alias("right"))
    return per.select("item_id", F.when((F.col("n") == 1) & (F.col("right") == 1), 1.0).when((F.col("right") == 1) & (F.col("n") <= 2), 0.5).otherwise(0.0).alias("single_correct"))


def distractor_type(options: Column, sims: Column | None = None) -> Column:
    """0.6 of the share of distractors of the answer's type (one without a type counts) plus 0.4 of
    the share of similarities from 0.3 to 0.95 (0.8 without similarities); 0.7 for the first part
    where the answer has no type."""
    right = F.try_element_at(F.filter(options, lambda o: o["is_correct"]), F.lit(1))["entity_type"]
    wrong = F.filter(options, lambda o: ~o["is_correct"])
    fit = F.size(F.filter(wrong, lambda o: o["entity_type"].isNull() | (o["entity_type"] == right))) / F.greatest(F.size(wrong), F.lit(1))
    kind = F.when(right.isNull(), 0.7).otherwise(fit)
    near = F.lit(0.8) if sims is None else F.size(F.filter(sims, lambda s: s.between(0.3, 0.95))) / F.greatest(F.size(sims), F.lit(1))
    return F.round(0.6 * kind + 0.4 * near, 4)


def known_in(answer: Column, facts: Column) -> Column:
    """1 for an answer among the passage's known names, 0.85 if one contains the other, 0.5 if not,
    0.7 where nothing is known of the passage. Blank names are no knowledge."""
    a = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    names = F.filter(F.transform(facts, lambda s: F.lower(F.trim(s))), lambda s: s != "")
    part = (a != "") & F.exists(names, lambda s: F.contains(s, a) | F.contains(a, s))
    return F.when(facts.isNull() | (F.size(names) == 0), 0.7).when(F.array_contains(names, a), 1.0).when(part, 0.85).otherwise(0.5)


def clarity(question: Column) -> Column:
    """1 less: 0.7 under 4 tokens, 0.4 under 6, 0.2 over 50; 0.3 without a question mark, 0.2 with
    several; 0.15 for a pronoun without antecedent (as a word, not as the beginning of one); 0.2
    for two negations within five words. At least 0, at most 1."""
    q = F.coalesce(question, F.lit(""))
    n = N.count_tokens(q)
    low = F.lower(q)
    marks = F.length(q) - F.length(F.replace(q, F.lit("?"), F.lit("")))
    pronoun = low.rlike(r"^(" + "|".join(PRONOUNS) + r") ") | low.rlike(r" (" + "|".join(PRONOUNS) + r") ")
    negated = low.rlike(r"(^| )(không|chưa)( [^ ]+){0,4} (không|chưa)( |\?|$)")
    s = F.lit(1.0) - F.when(n < 4, 0.7).when(n < 6, 0.4).when(n > 50, 0.2).otherwise(0.0) - F.when(marks == 0, 0.3).when(marks > 1, 0.2).otherwise(0.0)
    s = s - F.when(pronoun, 0.15).otherwise(0.0) - F.when(negated, 0.2).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)), 4)


def level_fidelity(predicted: Column, wanted: Column) -> Column:
    """Score by the distance of two levels on their scale; null where either is unknown."""
    scale = F.array(*map(F.lit, N.LEVELS))
    p, w = F.array_position(scale, predicted), F.array_position(scale, wanted)
    d = F.abs(p - w).cast("int")
    return F.when((p > 0) & (w > 0), F.element_at(F.array(*map(F.lit, LEVEL_SCORES)), d + 1))


def position_balance(items: DataFrame, order: list[str], key: str = "answer_key") -> DataFrame:
    """Adds answer_position_ok: after each item in order, 1 - 4 x the largest deviation of a key's
    share from a quarter, at least 0, three decimals. Items without one of the keys get null and
    count for none. A running sum over all partitions, not a window in one."""
    counts = {f"_{k}": f"_is{k}" for k in "ABCD"}
    known = items.where(F.col(key).isin(*"ABCD")).withColumns({f"_is{k}": (F.col(key) == k).cast("long") for k in "ABCD"})
    summed = running_sums(known, order, counts)
    total = F.col("_A") + F.col("_B") + F.col("_C") + F.col("_D")
    deviation = F.greatest(*[F.abs(F.col(f"_{k}") / total - 0.25) for k in "ABCD"])
    score = F.round(F.greatest(F.lit(0.0), 1 - 4 * deviation), 3)
    done = summed.select(*[F.col(c) for c in items.columns], score.alias("answer_position_ok"))
    rest = items.where(F.col(key).isNull() | ~F.col(key).isin(*"ABCD")).withColumn("answer_position_ok", F.lit(None).cast("double"))
    return done.unionByName(rest)


def _sketch() -> dict[str, Column]:
    """Four times 64 bits: of each bit, whether an odd number of the grams falls to it. Two sketches differ in no
    more bits than there are grams that only one set has."""
    return {f"s{w}": F.expr(f"aggregate(g, 0L, (a, v) -> a ^ if(pmod(v, 256L) div 64 = {w}, shiftleft(1L, cast(pmod(v, 64L) as int)), 0L))") for w in range(4)}


def similar_questions(items: DataFrame, order: str, least: float = 0.85) -> DataFrame:
    """item, earlier, similarity: the most similar earlier question by Jaccard over character
    trigrams, where it reaches least (ties: the least item). items: item_id, question and the order column;
    of items with the same trigrams the first in order stands for all.

    Exact. Two sets that reach least differ in at most d grams, a number that their sizes bound. Grams are dealt by hash to
    d + 1 parts, of which at least one is the same in both sets, and texts are joined by whole parts. Sizes fall into
    classes, and the number of parts is that of the larger one's class. Before texts are compared, their
    parity sketches must differ in no more than d bits.

    Joins are by sorting: the planner takes grams and parts to be about as large as the scanned file and would broadcast them."""
    span = (1 - least) / (1 + least)
    grams = F.array_sort(F.array_distinct(F.transform(N.trigrams(F.lower(F.col("question"))), lambda x: F.xxhash64(x))))
    t = cut(items.select("item_id", F.col(order).alias("pos"), grams.alias("g")).where("size(g) > 0").withColumn("sig", F.xxhash64("g")))
    texts = t.groupBy("sig").agg(F.min(F.struct("pos", "item_id")).alias("m"), F.first("g").alias("g")).select("sig", F.col("m.pos").alias("pos"), F.col("m.item_id").alias("item"), "g", F.size("g").alias("n"))
    texts = cut(texts.withColumns(_sketch()))
    again = t.join(texts.select("sig", F.col("item").alias("earlier")).hint("merge"), "sig").where("item_id <> earlier")
    again = again.select(F.col("item_id").alias("item"), F.lit(1.0).alias("similarity"), "earlier").distinct()
    own = F.floor(F.round(F.log("n") / -math.log(least), 9)).cast("int")
    parts = (F.floor(2 * span * F.pow(F.lit(1 / least), F.col("c") + 1)) + 1).cast("int")
    keyed = texts.withColumn("c", F.explode(F.array(own, own + 1))).withColumn("parts", parts)
    part = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.xxhash64(F.col("c"), k, F.filter("g", lambda v: F.pmod(v, F.col("parts")) == k)))
    keyed = keyed.select("sig", "item", "pos", "n", *[f"s{w}" for w in range(4)], F.explode(part).alias("key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    differ = None
    for w in range(4):
        bits = F.bit_count(F.col(f"a.s{w}").bitwiseXOR(F.col(f"b.s{w}")))
        differ = bits if differ is None else differ + bits
    met = a.join(b.hint("merge"), F.col("a.key") == F.col("b.key")).where(
        (F.struct("b.pos", "b.item") < F.struct("a.pos", "a.item")) & (F.col("b.n") >= least * F.col("a.n") - 1e-9) & (F.col("a.n") >= least * F.col("b.n") - 1e-9)
        & (differ <= span * (F.col("a.n") + F.col("b.n")) + 1e-9)
    )
    cand = met.select(F.col("a.sig").alias("x"), F.col("b.sig").alias("y")).distinct()
    full = cand.join(texts.select(F.col("sig").alias("x"), "item", F.col("g").alias("ga")).hint("merge"), "x")
    full = full.join(texts.select(F.col("sig").alias("y"), F.col("item").alias("earlier"), F.col("g").alias("gb")).hint("merge"), "y")
    near = full.withColumn("similarity", F.round(N.jaccard(F.col("ga"), F.col("gb")), 6)).where(F.col("similarity") >= least)
    best = near.groupBy("item").agg(F.min(F.struct((-F.col("similarity")).alias("far"), "earlier")).alias("m"))
    return again.unionByName(best.select("item", (-F.col("m.far")).alias("similarity"), F.col("m.earlier").alias("earlier")))


def verdict(items: DataFrame) -> DataFrame:
    """Adds score (weighted sum of the checks, four decimals; a null check counts 0) and verdict."""
    s = None
    for name, w in WEIGHTS.items():
        term = w * F.coalesce(F.col(name), F.lit(0.0))
        s = term if s is None else s + term
    scored = items.withColumn("score", F.round(s, 4))
    return scored.withColumn("verdict", F.when(F.col("score") >= ACCEPTED, "accepted").when(F.col("score") >= REVIEW, "needs_review").otherwise("rejected"))


#: The score from which a check passes; knowledge never fails.
PASSES = {
    "evidence_match": 1.0, "single_correct": 1.0, "distractor_type_match": 0.6, "historical_correctness": 0.0,
    "question_clarity": 0.6, "duplicate_check": 0.15, "bloom_fidelity": 1.0, "answer_position_ok": 0.6,
}


def failed(checks: dict[str, float] | None = None) -> Column:
    """The names of the checks that an item fails, in their order: below the score from which each passes, or null. A duplicate
    fails from a similarity of 0.85 on, which is a score of 0.15 or less."""
    bounds = checks or PASSES
    names = []
    for n, least in bounds.items():
        ok = F.coalesce(F.col(n) > least if n == "duplicate_check" else F.col(n) >= least, F.lit(False))
        names.append(F.when(~ok, F.lit(n)))
    return F.array_compact(F.array(*names))


def verify(items: DataFrame, facts: DataFrame, labels: DataFrame, predicted: DataFrame, order: str) -> DataFrame:
    """All checks of a bank in one pipeline: item_id, the eight scores, score, verdict, violations.

    items: item_id, context_id, question, options, answer_text, answer_key, bloom and the order column; facts: context_id, facts (array of
    names); labels: item_id, evidence, and whether each option is entailed: is_correct, label (one row an option); predicted: item_id, level.
    An item without labels has no evidence and no single answer (0); duplicates are measured against earlier items."""
    near = similar_questions(items.select("item_id", "question", order), order) if order != "item_id" else similar_questions(items.select("item_id", "question"), "item_id")
    evidence = labels.groupBy("item_id").agg(F.max("evidence").alias("evidence"))
    rows = (
        items.join(facts, "context_id", "left").join(evidence, "item_id", "left").join(single_correct(labels), "item_id", "left")
        .join(predicted.select("item_id", F.col("level").alias("said")), "item_id", "left").join(near.select(F.col("item").alias("item_id"), "similarity"), "item_id", "left")
    )
    checks = rows.select(
        "item_id", "answer_key", *([order] if order != "item_id" else []), F.when(F.col("evidence").isNull(), 0.0).otherwise(evidence_match(F.col("evidence"))).alias("evidence_match"),
        F.coalesce("single_correct", F.lit(0.0)).alias("single_correct"), distractor_type(F.col("options")).alias("distractor_type_match"),
        known_in(F.col("answer_text"), F.col("facts")).alias("historical_correctness"), clarity(F.col("question")).alias("question_clarity"),
        F.round(1 - F.coalesce("similarity", F.lit(0.0)), 6).alias("duplicate_check"), level_fidelity(F.col("said"), F.col("bloom")).alias("bloom_fidelity"),
    )
    done = verdict(position_balance(cut(checks), [order]))  # read three times
    return done.withColumn("violations", failed()).select("item_id", *WEIGHTS, "score", "verdict", "violations")


def method_summary(items: DataFrame) -> DataFrame:
    """method, n_items, vqr (share accepted), n_review, n_rejected, avg_score (NaN and null aside)."""
    score = F.when(~F.isnan("verifier_score"), F.col("verifier_score"))
    return items.groupBy("method").agg(
        F.count("*").alias("n_items"), F.round(F.avg((F.col("status") == "accepted").cast("double")), 6).alias("vqr"), F.count_if(F.col("status") == "needs_review").alias("n_review"),
        F.count_if(F.col("status") == "rejected").alias("n_rejected"), F.round(F.avg(score), 6).alias("avg_score"),
    )


def agreement(predictions: DataFrame) -> DataFrame:
    """predictions: item_id, a, b, wanted. Rates at which a is wanted, b is wanted, and a is b."""
    rate = lambda x, y: F.round(F.avg((F.col(x) == F.col(y)).cast("double")), 6)
    return predictions.agg(F.count("*").alias("n"), rate("a", "wanted").alias("a_match"), rate("b", "wanted").alias("b_match"), rate("a", "b").alias("agree"))
