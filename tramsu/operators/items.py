"""Multiple-choice items: pools of alternatives, answers, evidence, options and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramsu.functions import normalize as N
from tramsu.operators.ordered import running_sums

#: Which entity types answer which kind of question.
WH_TYPES = {"thoi_gian": ["YEAR", "DATE"], "nhan_vat": ["PER"], "dia_diem": ["LOC"], "su_kien": ["ORG", "LOC", "PER"]}
LABELS = ("A", "B", "C", "D")
#: Question templates by what is asked for; times have their own where the passage is about a person.
TEMPLATES = {
    "thoi_gian": ["{subj} xảy ra vào năm nào?", "Sự kiện {subj} diễn ra vào năm nào?", "{subj} diễn ra vào thời gian nào?", "Năm nào {subj} diễn ra?"],
    "thoi_gian_person": ["{subj} sinh năm nào?", "{subj} qua đời năm nào?", "{subj} sống trong thế kỷ nào?", "Năm sinh của {subj} là năm nào?"],
    "nhan_vat": ["Ai {verb} {subj}?", "Người nào {verb} {subj}?", "{subj} do ai {verb}?", "Nhân vật nào liên quan đến {subj}?"],
    "dia_diem": ["{subj} diễn ra ở đâu?", "{subj} xảy ra tại địa điểm nào?", "Địa điểm nào liên quan đến {subj}?", "{subj} diễn ra tại đâu?"],
    "su_kien": ["Sự kiện nào xảy ra liên quan đến {subj}?", "{subj} có liên quan đến sự kiện nào?", "Điều gì đã xảy ra với {subj}?"],
    "nguyen_nhan": ["Nguyên nhân nào dẫn đến {subj}?", "Vì sao {subj} xảy ra?", "Điều gì dẫn đến {subj}?"],
    "y_nghia": ["{subj} có ý nghĩa gì?", "Tầm quan trọng của {subj} là gì?", "Kết quả của {subj} là gì?"],
}
OTHER_TEMPLATE = "{subj} là gì?"
VERBS = ["lãnh đạo", "chỉ huy", "sáng lập", "thành lập", "chinh phục", "cai trị", "kiểm soát", "đặt ra", "ban hành", "ký kết"]
OTHER_VERB = "thực hiện"
#: Years that may stand beside any year.
FAMOUS_YEARS = ["1066", "1453", "1776", "1789", "1914", "1918", "1939", "1945", "1954", "1975", "1986"]
#: The level of a question by what it asks for.
WH_LEVELS = {"thoi_gian": "nhan_biet", "nhan_vat": "nhan_biet", "dia_diem": "nhan_biet", "su_kien": "thong_hieu", "nguyen_nhan": "thong_hieu", "y_nghia": "van_dung"}
#: Words that are no alternative.
FILLERS = ["trong", "ngoài", "và", "khi", "để", "vì", "nhưng", "với", "từ", "tại", "của", "là", "có", "không", "letter", "năm", "tháng", "ngày"]


def drawn(seed: int, *parts: Column) -> Column:
    """A reproducible 32-bit number of seed and parts, the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 8), 16, 10).cast("long")


def distractor_pool(entities: DataFrame) -> DataFrame:
    """type, bucket, surface (years without the word for year), pos, size: each bucket's distinct
    surfaces in a reproducible random order. One row a surface, so no bucket is ever one value; places are counted by
    running sums over all partitions, so none is ever sorted in one task either. Rows without type or bucket are left out."""
    rows = entities.where("surface is not null and bucket is not null and type is not null").select("type", "bucket", N.answer_surface(F.col("surface"), F.col("type")).alias("surface")).distinct()
    size = rows.groupBy("type", "bucket").agg(F.count("*").alias("size"))
    placed = running_sums(rows.withColumns({"_h": F.md5("surface"), "_one": F.lit(1).cast("long")}), ["_h", "surface"], {"_n": "_one"}, by=("type", "bucket"))
    return placed.select("type", "bucket", "surface", (F.col("_n") - 1).cast("int").alias("pos")).join(size, ["type", "bucket"])


def ladder(answers: DataFrame, steps: int = 2) -> DataFrame:
    """answers: type, bucket. Adds step and alt_bucket: its own bucket first; for years and dates
    then the centuries next to it, nearest first; for the rest the other domain."""
    own = answers.select("type", "bucket").distinct()
    c = N.century_of(F.col("bucket"))
    near = F.array(*[F.struct(F.lit(2 * i + k).alias("step"), F.concat((c + (i if k else -i)).cast("string"), F.lit("C")).alias("alt_bucket")) for i in range(1, steps + 1) for k in (0, 1)])
    other = F.array(F.struct(F.lit(1).alias("step"), F.when(F.col("bucket") == "VN", "TG").otherwise("VN").alias("alt_bucket")))
    first = F.array(F.struct(F.lit(0).alias("step"), F.col("bucket").alias("alt_bucket")))
    rungs = F.concat(first, F.when(F.col("type").isin("YEAR", "DATE", "CENTURY"), near).otherwise(other))
    return own.select("type", "bucket", F.inline(rungs))


#: The step of the ladder's last rung.
FAMOUS = 99


def distractors(answers: DataFrame, pool: DataFrame, n: int = 3, seed: int = 7) -> DataFrame:
    """answers: key, type, bucket, surface. Adds distractors, up to n surfaces of the first rungs of
    the ladder that have any, none equal to the answer but for case; years and dates end with years that everyone knows.

    Every answer starts at a random place of each bucket's order and takes what follows there, so an
    answer meets n + 1 rows of a bucket, not the bucket."""
    rungs = answers.join(ladder(answers), ["type", "bucket"])
    sizes = pool.select("type", F.col("bucket").alias("alt_bucket"), "size").distinct()
    places = rungs.join(sizes, ["type", "alt_bucket"]).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n))))
    places = places.where("k < size").withColumn("pos", ((drawn(seed, F.col("key"), F.col("surface")) + F.col("k")) % F.col("size")).cast("int"))
    found = places.join(pool.select("type", F.col("bucket").alias("alt_bucket"), "pos", F.col("surface").alias("other")), ["type", "alt_bucket", "pos"])
    found = found.where(F.lower("other") != F.lower(N.answer_surface(F.col("surface"), F.col("type"))))
    # the last rung of years and dates: years that everyone knows, in an order of each answer's own
    known = answers.where(F.col("type").isin("YEAR", "DATE")).withColumn("other", F.explode(F.array(*map(F.lit, FAMOUS_YEARS))))
    known = known.where(F.lower("other") != F.lower(N.answer_surface(F.col("surface"), F.col("type"))))
    last = known.select("key", "surface", "other", F.lit(FAMOUS).alias("step"), drawn(seed, F.col("key"), F.col("other")).alias("k"))
    found = found.select("key", "surface", "other", "step", F.col("k").cast("long").alias("k")).unionByName(last)
    first = found.groupBy("key", "surface", F.lower("other").alias("low")).agg(F.min(F.struct("step", "k", "other")).alias("o"))
    rank = Window.partitionBy("key", "surface").orderBy("o.step", "o.k")
    best = first.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= n)
    lists = best.groupBy("key", "surface").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "o.other"))), lambda x: x["other"]).alias("distractors"))
    return answers.join(lists, ["key", "surface"], "left").withColumn("distractors", F.coalesce("distractors", F.array().cast("array<string>")))


def select_answers(passages: DataFrame, entities: DataFrame, seed: int = 7) -> DataFrame:
    """context_id, wh_type, surface, type, bucket: for every passage and kind of question an entity
    of a wanted type, one that begins in the first sentence if there is any, drawn at random."""
    kinds = F.explode(F.array(*[F.struct(F.lit(w).alias("wh_type"), F.array(*map(F.lit, t)).alias("types")) for w, t in WH_TYPES.items()])).alias("w")
    asked = passages.select("context_id", F.instr("context", ".").alias("first_stop"), kinds).select("context_id", "first_stop", "w.*")
    cand = asked.join(entities.select("context_id", "surface", "type", "bucket", "char_start").where("surface is not null"), "context_id").where("array_contains(types, type)")
    late = F.coalesce(F.col("char_start") >= F.col("first_stop"), F.lit(True)).cast("int")
    order = Window.partitionBy("context_id", "wh_type").orderBy(late, drawn(seed, F.col("context_id"), F.col("wh_type"), F.col("surface")), "surface", "char_start")
    return cand.withColumn("r", F.row_number().over(order)).where("r = 1").select("context_id", "wh_type", "surface", "type", "bucket")


def finalize_options(items: DataFrame, seed: int = 7) -> DataFrame:
    """items: key, answer, distractors. Adds options (label, text, is_correct) and answer_key, or
    null where fewer than three distractors differ from the answer and each other but for case."""
    trimmed = F.filter(F.transform("distractors", lambda d: F.trim(d)), lambda d: (d != "") & (F.lower(d) != F.lower(F.trim("answer"))))
    kept = F.filter(F.transform(trimmed, lambda d, i: F.struct(d.alias("d"), i.alias("i"))), lambda x: F.array_position(F.transform(trimmed, lambda d: F.lower(d)), F.lower(x["d"])) == x["i"] + 1)
    three = F.slice(F.transform(kept, lambda x: x["d"]), 1, 3)
    texts = F.concat(F.array(F.struct(F.trim("answer").alias("text"), F.lit(True).alias("is_correct"))), F.transform(three, lambda d: F.struct(d.alias("text"), F.lit(False).alias("is_correct"))))
    mixed = F.array_sort(F.transform(texts, lambda o: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), "key", o["text"])).alias("m"), o["text"].alias("text"), o["is_correct"].alias("is_correct"))))
    labelled = F.transform(mixed, lambda o, i: F.struct(F.element_at(F.array(*map(F.lit, LABELS)), i + 1).alias("label"), o["text"].alias("text"), o["is_correct"].alias("is_correct")))
    out = items.withColumn("options", F.when(F.size(three) == 3, labelled))
    return out.withColumn("answer_key", F.try_element_at(F.filter("options", lambda o: o["is_correct"]), F.lit(1))["label"])


def subject(title: Column, context: Column) -> Column:
    """What a question is about: the title, or what stands before the first comma in the first 40 characters."""
    front = F.trim(F.split(F.substring(F.coalesce(context, F.lit("")), 1, 40), ",")[0])
    return F.when(title != "", title).otherwise(front)


def verb_of(sentence: Column) -> Column:
    """The first of the verbs that stands in the sentence as words of its own, else the general one."""
    found = F.regexp_extract(F.coalesce(sentence, F.lit("")), r"(?:^|[^\p{L}\p{N}_])(" + "|".join(VERBS) + r")(?:[^\p{L}\p{N}_]|$)", 1)
    return F.when(found != "", found).otherwise(OTHER_VERB)


def build_question(wh: Column, subj: Column, verb: Column, about_person: Column, draw: Column) -> Column:
    """The question by the template that draw (a number) picks among those of what is asked for."""
    kind = F.when((wh == "thoi_gian") & about_person, "thoi_gian_person").otherwise(wh)
    pick = None
    for k, templates in TEMPLATES.items():
        one = F.element_at(F.array(*map(F.lit, templates)), (F.pmod(draw, F.lit(len(templates))) + 1).cast("int"))
        pick = F.when(kind == k, one) if pick is None else pick.when(kind == k, one)
    return F.replace(F.replace(pick.otherwise(OTHER_TEMPLATE), F.lit("{verb}"), verb), F.lit("{subj}"), subj)


def about_persons(passages: DataFrame, entities: DataFrame) -> DataFrame:
    """context_id, about_person: whether a person found in the passage stands in its title, without regard to case."""
    found = entities.where("type = 'PER' and surface is not null").select("context_id", "surface").join(passages.select("context_id", "title"), "context_id")
    return found.groupBy("context_id").agg(F.coalesce(F.bool_or(F.contains(F.lower("title"), F.lower("surface"))), F.lit(False)).alias("about_person"))


def split_alternatives(output: Column, answer: Column) -> Column:
    """Up to three alternatives in a model's output: parts between bars, or else after commas, semicolons and full stops. Dropped are repeated ones,
    the answer and what holds it, single words in small letters, fillers, and what is shorter than 4 or longer than 80 characters."""
    raw = F.coalesce(output, F.lit(""))
    parts = F.transform(F.when(F.contains(raw, F.lit("|")), F.split(raw, r"\|")).otherwise(F.split(raw, r"[,;.]\s+")), lambda p: F.trim(p))
    low = F.lower(F.coalesce(answer, F.lit("")))
    fit = F.filter(
        parts,
        lambda p: F.length(p).between(4, 80) & ~F.contains(F.lower(p), low) & ~F.lower(p).isin(FILLERS) & ~(~p.rlike(r"\s") & F.substring(p, 1, 1).rlike(r"\p{Ll}")),
    )
    return F.slice(F.filter(fit, lambda p, i: F.array_position(F.transform(fit, lambda q: F.lower(q)), F.lower(p)) == i + 1), 1, 3)


def context_alternatives(context: Column, answer: Column, taken: Column) -> Column:
    """Alternatives that a passage offers, in order: its capitalised phrases and its years, of 4 to 60 characters, no fillers, without the answer
    in them, and none that is taken (an array) but for case."""
    text = F.coalesce(context, F.lit(""))
    found = F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"(?U)\b(\p{Lu}\p{Ll}+(?:\s+\p{Lu}\p{Ll}+)*)\b"), 1), F.regexp_extract_all(text, F.lit(N.YEARS), 1)))
    low, known = F.lower(F.coalesce(answer, F.lit(""))), F.transform(F.coalesce(taken, F.array().cast("array<string>")), lambda d: F.lower(d))
    return F.filter(found, lambda c: F.length(c).between(4, 60) & ~F.lower(c).isin(FILLERS) & ~F.contains(F.lower(c), low) & ~F.array_contains(known, F.lower(c)))


def finish_alternatives(rows: DataFrame) -> DataFrame:
    """rows: key, question, answer, output (a model's), context. Adds distractors, from the output first and from the passage where
    there are fewer than three, and skipped: why no item comes of the row (empty_question, few_distractors), or null."""
    own = split_alternatives(F.col("output"), F.col("answer"))
    got = rows.withColumn("distractors", own)
    more = context_alternatives(F.col("context"), F.col("answer"), F.col("distractors"))
    got = got.withColumn("distractors", F.when(F.size("distractors") < 3, F.slice(F.concat("distractors", more), 1, 3)).otherwise(F.col("distractors")))
    blank = F.trim(F.coalesce("question", F.lit(""))) == ""
    return got.withColumn("skipped", F.when(blank, "empty_question").when(F.size("distractors") < 3, "few_distractors"))


def level_of_wh(wh: Column) -> Column:
    out = None
    for k, v in WH_LEVELS.items():
        out = F.when(wh == k, v) if out is None else out.when(wh == k, v)
    return out


def generate(passages: DataFrame, entities: DataFrame, seed: int = 7) -> DataFrame:
    """Items of the rule-based kind, one pipeline: answer, evidence, question, alternatives, options."""
    chosen = select_answers(passages, entities, seed).withColumn("key", F.concat_ws("|", "context_id", "wh_type"))
    with_d = distractors(chosen, distractor_pool(entities), seed=seed).withColumn("answer", N.answer_surface(F.col("surface"), F.col("type")))
    done = finalize_options(with_d, seed).where("options is not null").join(passages.select("context_id", "title", "context"), "context_id")
    done = done.join(about_persons(passages, entities), "context_id", "left").withColumn("evidence", N.find_evidence(F.col("context"), F.col("answer")))
    question = build_question(
        F.col("wh_type"), subject(F.col("title"), F.col("context")), verb_of(F.col("evidence.sentence")), F.coalesce("about_person", F.lit(False)),
        drawn(seed, F.lit("question"), F.col("context_id"), F.col("wh_type")),
    )
    done = done.withColumn("question", question)
    question = F.col("question")
    return done.select(
        N.short_id("itm_", F.col("context_id"), question, F.lit("rule_based"), sep="|").alias("item_id"), "context_id", "wh_type", "question", "options", "answer_key",
        F.col("answer").alias("answer_text"), F.col("type").alias("entity_type"), "evidence",
    )


def violations(items: DataFrame) -> DataFrame:
    """Adds broken: which invariants of an item fail (options_4, labels, texts_distinct, one_correct,
    key_text). Null options break options_4. Rows are never dropped."""
    o = F.col("options")
    right = F.filter(o, lambda x: x["is_correct"])
    texts = F.transform(o, lambda x: F.trim(x["text"]))
    checks = {
        "options_4": F.size(o) == 4,
        "labels": F.array_join(F.array_sort(F.transform(o, lambda x: x["label"])), "") == "ABCD",
        "texts_distinct": F.size(F.array_distinct(texts)) == F.size(texts),
        "one_correct": F.size(right) == 1,
        "key_text": (F.try_element_at(right, F.lit(1))["label"] == F.col("answer_key")) & (F.try_element_at(right, F.lit(1))["text"] == F.col("answer_text")),
    }
    names = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(None)).otherwise(F.lit(n)) for n, c in checks.items()])
    return items.withColumn("broken", F.filter(names, lambda x: x.isNotNull()))


def parse_model_output(raw: DataFrame) -> DataFrame:
    """raw: key, output (JSON, fenced or not), context. Adds parsed and ok: question, answer, at
    least three distractors; a question mark is appended; evidence is looked for in the context,
    whole or by its longest run of words from the front, at least half of it."""
    schema = "question string, correct_answer string, distractors array<string>, evidence_sentence string, bloom_level string"
    body = F.regexp_replace("output", r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    p = raw.withColumn("p", F.from_json(body, schema))
    q = F.trim("p.question")
    evidence = F.trim(F.coalesce("p.evidence_sentence", F.lit("")))
    words = F.split(evidence, r"(?U)\s+")
    n = F.size(words)
    least = F.greatest(F.lit(3), F.floor(n / 2).cast("int")) + 1
    fits = F.filter(F.when(n >= least, F.sequence(least, n)).otherwise(F.array().cast("array<int>")), lambda k: F.contains(F.col("context"), F.array_join(F.slice(words, 1, k), " ")))
    found = F.when((evidence != "") & F.contains("context", evidence), evidence).otherwise(F.array_join(F.slice(words, 1, F.coalesce(F.array_max(fits), F.lit(0))), " "))
    good = F.filter(F.transform("p.distractors", lambda d: F.trim(d)), lambda d: d != "")
    ok = F.coalesce((q != "") & (F.trim("p.correct_answer") != "") & (F.size(good) >= 3), F.lit(False))
    return p.select(
        *raw.columns, ok.alias("ok"), F.when(q.endswith("?"), q).otherwise(F.concat(q, F.lit("?"))).alias("question"), F.trim("p.correct_answer").alias("answer"),
        good.alias("distractors"), found.alias("evidence"), (found != "").alias("evidence_found"), F.col("p.bloom_level").alias("level"),
    )


def training_pairs(corpus: DataFrame, qa: DataFrame, limit: int = 500) -> DataFrame:
    """Clean question pairs with their passage: question-generation input and target, the kind of
    question, and the gold alternatives (other answers and plausible answers of the passage, sorted)."""
    ok = qa.where("answer_span_ok and not is_impossible")
    joined = ok.join(corpus.select("context_id", "context"), "context_id")
    others = qa.select("context_id", F.col("answer_text").alias("o")).union(qa.select("context_id", "plausible_answer")).where("o is not null and o <> ''")
    gold = others.groupBy("context_id").agg(F.sort_array(F.collect_set("o")).alias("all"))
    kind = N.wh_type(F.col("question"), F.col("answer_text"))
    return joined.join(gold, "context_id", "left").select(
        "qa_id", kind.alias("wh_type"),
        F.concat(F.lit("generate question: "), kind, F.lit(" | answer: "), "answer_text", F.lit(" | context: "), F.substring("context", 1, limit)).alias("qg_input"),
        F.col("question").alias("qg_target"), F.slice(F.filter("all", lambda x: x != F.col("answer_text")), 1, 3).alias("gold"),
    )
