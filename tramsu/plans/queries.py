"""Queries of the library over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramsu.functions import normalize as N
from tramsu.functions.splits import split_name
from tramsu.operators import corpus as C
from tramsu.operators import decide, eda, exam, items, models, retrieve, spans, survey, verify
from tramsu.session import cut, read

FLAGSHIP = "bank_scorecard"
#: An examination's size, shares of levels and most items of a context.
K, RATIO, PER_CONTEXT = 40, {"nhan_biet": 0.4, "thong_hieu": 0.35, "van_dung": 0.2, "van_dung_cao": 0.05}, 2


def _bank(spark: SparkSession, d: str) -> DataFrame:
    return C.keep_first(read(spark, d, "exam_dashboard"), "item_id", "created_at")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return C.keep_first(read(spark, d, "corpus"), "context_id", "loaded_at", "title")


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    """Passages that may be searched: those of test would leak into what is made from the results."""
    return _corpus(spark, d).where(split_name(F.col("split")).isin("train", "dev"))


def _qa(spark: SparkSession, d: str) -> DataFrame:
    return C.keep_first(read(spark, d, "qa_pairs"), "qa_id", "loaded_at")


def corpus_dedup_first(spark, d):
    return _corpus(spark, d).select("context_id", "title", F.md5("context").alias("text_md5"))


def text_stats(spark, d):
    return C.passage_statistics(_corpus(spark, d).select("context_id", "context")).select("context_id", "n_tokens", "n_years", "year_density", "primary_year")


def passage_ids(spark, d):
    t = _corpus(spark, d)
    return t.select("context_id", N.short_id("ctx_", F.col("context")).alias("own_id"), N.short_id("itm_", F.col("context_id"), F.col("title"), F.lit("x"), sep="|").alias("item_id"))


def title_inventory(spark, d):
    return C.title_inventory(_qa(spark, d))


def leak_check(spark, d):
    return C.leak_check(_corpus(spark, d), _qa(spark, d), split_name)


def split_report(spark, d):
    t = _corpus(spark, d).withColumn("split", split_name(F.col("split"))).where("split is not null")
    return C.split_report(t)


def balanced_split(spark, d):
    sizes = _corpus(spark, d).where("title is not null").groupBy("title").agg(F.bool_or("is_vietnam").alias("is_vietnam"), F.count("*").alias("size"))
    return C.balanced_split(sizes)


def qa_span_check(spark, d):
    qa = _qa(spark, d).join(_corpus(spark, d).select("context_id", "context"), "context_id")
    ok = N.span_ok(F.col("context"), F.col("answer_text"), F.col("answer_start"), F.col("is_impossible"))
    return qa.groupBy(ok.alias("span_ok"), F.col("answer_span_ok").alias("said_ok")).agg(F.count("*").alias("n"))


def wh_types(spark, d):
    return _qa(spark, d).select("qa_id", N.wh_type(F.col("question"), F.col("answer_text")).alias("wh_type"))


def keyword_levels(spark, d):
    return _bank(spark, d).groupBy(N.keyword_level(F.col("question")).alias("level"), "wh_type").agg(F.count("*").alias("n"))


def evidence_sentence(spark, d):
    qa = _qa(spark, d).where("answer_text <> ''").join(_corpus(spark, d).select("context_id", "context"), "context_id")
    e = N.find_evidence(F.col("context"), F.col("answer_text"))
    return qa.select("qa_id", e["sentence"].alias("sentence"), e["found"].alias("found"))


def training_pairs(spark, d):
    return items.training_pairs(_corpus(spark, d), _qa(spark, d)).select("qa_id", "wh_type", "qg_target", F.array_join("gold", "|").alias("gold"))


def value_counts(spark, d):
    return eda.value_counts(read(spark, d, "entities"), "type", "bucket")


def token_quantiles(spark, d):
    return eda.quantiles(C.passage_statistics(_corpus(spark, d).select("context_id", "is_vietnam", "context")), "n_tokens", "is_vietnam")


def token_histogram(spark, d):
    return eda.histogram(C.passage_statistics(_corpus(spark, d).select("context_id", "context")), "n_tokens", 20)


def question_rates(spark, d):
    return eda.rates(_qa(spark, d), "is_vietnam", impossible=F.col("is_impossible"), span_ok=F.col("answer_span_ok"), answered=F.col("answer_text") != "")


def temporal_extract(spark, d):
    return spans.extract_temporal(_corpus(spark, d))


def entity_clean(spark, d):
    rows = read(spark, d, "entities").select("surface", "type").where("surface is not null").groupBy("surface", "type").agg(F.count("*").alias("n"))
    return spans.clean(rows)


def distractor_pool(spark, d):
    p = items.distractor_pool(read(spark, d, "entities"))
    return p.groupBy("type", "bucket").agg(F.max("size").alias("size"), F.min("surface").alias("least"), F.max("surface").alias("greatest"))


def distractor_ladder(spark, d):
    e = read(spark, d, "entities").where("surface is not null and bucket is not null")
    answers = e.where("type in ('YEAR', 'DATE', 'PER', 'LOC', 'ORG')").select(F.col("surface").alias("key"), "type", "bucket", "surface").distinct()
    answers = answers.withColumn("key", F.concat_ws("|", "type", "bucket", "surface"))
    got = items.distractors(answers, items.distractor_pool(e))
    return got.select("key", F.array_join("distractors", "|").alias("distractors"))


def generated_items(spark, d):
    made = items.generate(_corpus(spark, d), read(spark, d, "entities"))
    return items.violations(made).select("item_id", "context_id", "wh_type", "question", "answer_key", "answer_text", F.size("broken").alias("n_broken"))


def item_violations(spark, d):
    return items.violations(_bank(spark, d)).select("item_id", F.array_join("broken", ",").alias("broken"))


def bm25_topk(spark, d):
    q = read(spark, d, "exam_items").select(F.col("id").alias("q"), N.stem(F.col("question")).alias("text"))
    return retrieve.bm25(_indexed(spark, d), q, "context_id", "context", 10)


def dense_topk(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieve.dense(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vec")), "vec_id", "embedding", 5).select("q", "doc", "rank")


def rrf_fusion(spark, d):
    q = read(spark, d, "exam_items").select(F.col("id").alias("q"), N.stem(F.col("question")).alias("text"))
    c = _indexed(spark, d)
    return retrieve.fuse(cut(retrieve.bm25(c, q, "context_id", "context", 15)), retrieve.bm25(c, q, "context_id", "title", 15), 5)


def near_questions(spark, d):
    return verify.similar_questions(_bank(spark, d).select("item_id", "question"), "item_id")


def question_clarity(spark, d):
    return _bank(spark, d).select("item_id", verify.clarity(F.col("question")).alias("question_clarity"))


def known_answers(spark, d):
    facts = read(spark, d, "entities").where("surface is not null").groupBy("context_id").agg(F.collect_set("surface").alias("facts"))
    return _bank(spark, d).join(facts, "context_id", "left").select("item_id", verify.known_in(F.col("answer_text"), F.col("facts")).alias("historical_correctness"))


def distractor_types(spark, d):
    return _bank(spark, d).select("item_id", verify.distractor_type(F.col("options")).alias("distractor_type_match"))


def position_balance(spark, d):
    return verify.position_balance(_bank(spark, d).select("item_id", "answer_key"), ["item_id"])


def level_fidelity(spark, d):
    b = _bank(spark, d)
    return b.select("item_id", verify.level_fidelity(N.keyword_level(F.col("question")), F.col("bloom")).alias("fidelity"))


def verify_verdict(spark, d):
    b = _bank(spark, d)
    facts = read(spark, d, "entities").where("surface is not null").groupBy("context_id").agg(F.collect_set("surface").alias("facts"))
    right = F.size(F.filter("options", lambda o: o["is_correct"]))
    checks = b.join(facts, "context_id", "left").select(
        "item_id", "answer_key", "evidence_match", "duplicate_check", "bloom_fidelity", F.when(right == 1, 1.0).otherwise(0.0).alias("single_correct"),
        verify.distractor_type(F.col("options")).alias("distractor_type_match"), verify.known_in(F.col("answer_text"), F.col("facts")).alias("historical_correctness"),
        verify.clarity(F.col("question")).alias("question_clarity"),
    )
    return verify.verdict(verify.position_balance(checks, ["item_id"])).select("item_id", "score", "verdict")


def bank_verification(spark, d):
    """All eight checks in one pipeline. Labels of inference come from the bank's evidence score: entailment from 0.9, neutral from
    0.4; the right option is entailed, the others are neutral. The level is the keyword level."""
    b = _bank(spark, d)
    facts = read(spark, d, "entities").where("surface is not null").groupBy("context_id").agg(F.collect_set("surface").alias("facts"))
    evidence = F.when(F.col("evidence_match") >= 0.9, "entailment").when(F.col("evidence_match") >= 0.4, "neutral").otherwise("contradiction")
    labels = b.select("item_id", evidence.alias("evidence"), F.explode("options.is_correct").alias("is_correct")).withColumn("label", F.when(F.col("is_correct"), "entailment").otherwise("neutral"))
    predicted = b.select("item_id", N.keyword_level(F.col("question")).alias("level"))
    done = verify.verify(b, facts, labels, predicted, "item_id")
    return done.select("item_id", "score", "verdict", F.array_join("violations", ",").alias("violations"))


def method_summary(spark, d):
    return verify.method_summary(_bank(spark, d))


def level_agreement(spark, d):
    b = _bank(spark, d)
    return verify.agreement(b.select("item_id", N.keyword_level(F.col("question")).alias("a"), F.when(F.col("bloom_fidelity") == 1, F.col("bloom")).alias("b"), F.col("bloom").alias("wanted")).where("b is not null"))


#: The criteria that the test tables hold.
CRITERIA_HELD = ("vqr", "evidence_match", "bloom_fidelity", "duplicate_check", "question_clarity")


def _criteria(spark, d, by: str = "method") -> DataFrame:
    b = _bank(spark, d).withColumn("clarity", verify.clarity(F.col("question")))
    per = b.groupBy(F.col(by).alias("alternative")).agg(
        F.avg((F.col("status") == "accepted").cast("double")).alias("vqr"), F.avg("evidence_match").alias("evidence_match"), F.avg("bloom_fidelity").alias("bloom_fidelity"),
        F.avg("duplicate_check").alias("duplicate_check"), F.avg("clarity").alias("question_clarity"),
    )
    long = per.unpivot(["alternative"], list(CRITERIA_HELD), "criterion", "value")
    return long.withColumn("value", F.round("value", 6))


def _weights(spark) -> DataFrame:
    return decide.ahp(decide.comparison_matrix(spark)).select("criterion", F.col("weight"), F.lit(True).alias("benefit"))


def ahp_weights(spark, d):
    return decide.ahp(decide.comparison_matrix(spark)).drop("exact")


def bank_scorecard(spark, d):
    return decide.topsis(_criteria(spark, d), _weights(spark))


def topsis_sensitivity(spark, d):
    return decide.sensitivity(cut(_criteria(spark, d)), _weights(spark), "vqr")


def sensitivity_crossover(spark, d):
    """Where two kinds of questions change places as the weight of one criterion grows, for every criterion."""
    values, weights, found = cut(_criteria(spark, d, "wh_type")), cut(_weights(spark)), None
    for c in CRITERIA_HELD:
        one = decide.crossovers(cut(decide.sensitivity(values, weights, c))).withColumn("varied", F.lit(c))
        found = one if found is None else found.unionByName(one)
    return found


def live_ranking(spark, d):
    """The alternatives under weights as a user sets them."""
    set_ = spark.createDataFrame([("vqr", 3.0), ("evidence_match", 2.0), ("bloom_fidelity", 1.0), ("duplicate_check", 0.5), ("question_clarity", 0.0)], "criterion string, weight double")
    return decide.live_topsis(_criteria(spark, d), set_)


def method_strengths(spark, d):
    return decide.strengths(_criteria(spark, d))


def bloom_targets(spark, d):
    return exam.targets(spark, RATIO, K)


def _target(spark) -> dict[str, int]:
    return {r["level"]: r["target"] for r in exam.targets(spark, RATIO, K).collect()}


def exam_random(spark, d):
    return exam.at_random(exam.usable(_bank(spark, d)), K).select("item_id", "bloom", "score")


def exam_greedy(spark, d):
    return exam.numbered(exam.greedy(exam.usable(_bank(spark, d)), K, _target(spark), PER_CONTEXT)).select("no", "item_id", "bloom", "context_id", "score")


def exam_optimal(spark, d):
    return exam.numbered(exam.best(exam.usable(_bank(spark, d)), K, _target(spark), PER_CONTEXT)).select("no", "item_id", "bloom", "context_id", "score")


def exam_statistics(spark, d):
    return exam.statistics(exam.greedy(exam.usable(_bank(spark, d)), K, _target(spark), PER_CONTEXT), exam.targets(spark, RATIO, K))


def strategy_comparison(spark, d):
    u, t = cut(exam.usable(_bank(spark, d))), _target(spark)
    return exam.compare({"optimal": exam.best(u, K, t, PER_CONTEXT), "greedy": exam.greedy(u, K, t, PER_CONTEXT), "random": exam.at_random(u, K)}, "random")


def exam_methods(spark, d):
    u = exam.usable(_bank(spark, d))
    return exam.method_counts(exam.at_random(u, K), _bank(spark, d))


def survey_decision(spark, d):
    return survey.survey(_corpus(spark, d))


def question_parts(spark, d):
    """What rule-based questions are made of: the subject of a passage and the verb of the sentence that holds the answer."""
    qa = _qa(spark, d).where("answer_text <> ''").join(_corpus(spark, d).select("context_id", F.col("title").alias("t"), "context"), "context_id")
    sentence = N.find_evidence(F.col("context"), F.col("answer_text"))["sentence"]
    return qa.select("qa_id", items.subject(F.col("t"), F.col("context")).alias("subject"), items.verb_of(sentence).alias("verb"))


def person_passages(spark, d):
    return items.about_persons(_corpus(spark, d), read(spark, d, "entities"))


def wh_levels(spark, d):
    wh = N.wh_type(F.col("question"), F.col("answer_text"))
    return _qa(spark, d).groupBy(wh.alias("wh_type"), items.level_of_wh(wh).alias("level")).agg(F.count("*").alias("n"))


def bank_kpis(spark, d):
    b = _bank(spark, d)
    score = F.when(~F.isnan("verifier_score"), F.col("verifier_score"))
    return b.agg(F.count("*").alias("total"), F.round(100 * F.avg((F.col("status") == "accepted").cast("double")), 2).alias("accepted_pct"), F.countDistinct("method").alias("methods"), F.round(F.avg(score), 4).alias("mean_score"))


def filtered_bank(spark, d):
    b = _bank(spark, d)
    return b.where(F.col("method").isin("vit5", "rag_llm") & (F.col("status") == "accepted") & F.col("bloom").isin("nhan_biet", "thong_hieu") & (F.col("verifier_score") >= 0.8) & ~F.isnan("verifier_score")).select("item_id", "method", "bloom", "verifier_score")


def level_report(spark, d):
    """How the keyword level stands to the bank's level, by class."""
    b = _bank(spark, d).where(F.col("bloom").isin(*N.LEVELS)).select("bloom", N.keyword_level(F.col("question")).alias("said"))
    return models.class_report(b, "bloom", "said")


def level_classifier(spark, d):
    """A classifier of keyword levels, trained on the stems of the questions of two methods
    and judged on the third's; accuracy by class."""
    rows = cut(_bank(spark, d).where("question is not null").select("method", N.stem(F.col("question")).alias("question"), N.keyword_level(F.col("question")).alias("level")))
    model = models.train_level_classifier(rows.where("method <> 'rag_llm'"), "question", "level")
    return models.class_report(models.predict_level(model, rows.where("method = 'rag_llm'"), "question"), "level", "predicted")


def queries() -> dict:
    names = """bank_scorecard corpus_dedup_first text_stats passage_ids title_inventory leak_check split_report balanced_split qa_span_check wh_types keyword_levels
    evidence_sentence training_pairs value_counts token_quantiles token_histogram question_rates temporal_extract entity_clean distractor_pool distractor_ladder
    generated_items item_violations bm25_topk dense_topk rrf_fusion near_questions question_clarity known_answers distractor_types position_balance level_fidelity
    verify_verdict method_summary level_agreement ahp_weights topsis_sensitivity sensitivity_crossover method_strengths bloom_targets exam_random exam_greedy
    exam_optimal exam_statistics exam_methods live_ranking bank_verification survey_decision question_parts person_passages wh_levels strategy_comparison bank_kpis filtered_bank level_report level_classifier"""
    return {n: globals()[n] for n in names.split()}


def oracle_sql() -> dict[str, str]:
    from tramsu.plans import oracle

    return oracle.sql()
