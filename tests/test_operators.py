import random

import pytest
from pyspark.sql import functions as F

from tramsu.operators import corpus, decide, eda, exam, items, retrieve, spans, survey, verify
from tramsu.operators.graph import connected_components, forest
from tramsu.operators.ordered import running_sums


@pytest.mark.parametrize("per_task", [25, 10**6])
def test_components_equal_union_find(spark, per_task):
    random.seed(3)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5080)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "x long, y long"), per_task).collect()}
    assert got == forest(edges, lambda x: x)


def test_components_of_nothing_and_nulls(spark):
    assert connected_components(spark.createDataFrame([], "x string, y string")).count() == 0
    got = connected_components(spark.createDataFrame([("a", None), ("b", "b")], "x string, y string")).collect()
    assert [(r["node"], r["component"]) for r in got] == [("b", "b")]


def test_running_sums(spark):
    rows = [(g, i, i % 7) for g in ("a", "b") for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, v long").repartition(5)
    got = {(r["g"], r["i"]): r["s"] for r in running_sums(df, ["i"], {"s": "v"}, ("g",)).collect()}
    assert len(got) == 600
    for g in ("a", "b"):
        total = 0
        for i in range(300):
            total += i % 7
            assert got[g, i] == total


def test_build_corpus(spark):
    long = " ".join(["chữ"] * 45)
    kind = "title string, context string, question string, answers struct<text:array<string>,answer_start:array<int>>, is_impossible boolean, plausible string, pos int"
    rows = [
        ("A", long + " Huế 1945", "Ở đâu?", (["Huế"], [180]), False, None, 1),
        ("A", long + " Huế 1945", "Năm nào?", (["1945"], [3]), False, None, 2),
        ("A", long + " x 1010", "Ai?", (["Lý"], [0]), False, None, 3),
        ("A", long + " x 1010", "Gì?", ([], []), True, "đoán", 4),
        ("B", long, "?", (["x"], [0]), False, None, 5),
    ]
    inventory = spark.createDataFrame([("A", 1, 1), ("B", 0, 0)], "title string, is_history int, is_vietnam int")
    c, q, n = corpus.build(spark.createDataFrame(rows, kind), inventory)
    assert n.first().asDict() == {"rows_seen": 5, "skipped_title": 1, "skipped_short": 0}
    assert c.count() == 2 and q.count() == 4
    ok = {r["question"]: r["answer_span_ok"] for r in q.collect()}
    assert ok == {"Ở đâu?": True, "Năm nào?": True, "Ai?": False, "Gì?": False}
    assert {r["primary_year"] for r in c.collect()} == {1945, 1010}


def test_balanced_split(spark):
    titles = [(f"t{i}", i % 2 == 0, 10 + i) for i in range(40)]
    got = corpus.balanced_split(spark.createDataFrame(titles, "title string, is_vietnam boolean, size long")).collect()
    assert len(got) == 40
    for vn in (True, False):
        total = sum(r["size"] for r in got if r["is_vietnam"] == vn)
        for s, p in corpus.SHARES.items():
            assert abs(sum(r["size"] for r in got if r["is_vietnam"] == vn and r["split"] == s) - p * total) <= 50


@pytest.mark.parametrize(
    "text,want",
    [
        ("Vào năm 1954 có", [("năm 1954", "YEAR", "1954")]),
        ("năm 27 trước Công nguyên", [("năm 27", "YEAR", "-27")]),
        ("ngày 2 tháng 9 năm 1945", [("ngày 2 tháng 9 năm 1945", "DATE", "1945-09-02")]),
        ("13/3/1954", [("13/3/1954", "DATE", "1954-03-13")]),
        ("thế kỉ XIX", [("thế kỉ XIX", "CENTURY", "XIX")]),
        ("khoảng 1789 thì", [("1789", "YEAR", "1789")]),
        ("", []),
    ],
)
def test_temporal(text, want):
    got = spans.temporal_spans(text)
    assert [x[:3] for x in got] == want
    assert all(text[s:e] == x for x, _, _, s, e in got)


def test_temporal_bucket(spark):
    df = spark.createDataFrame([("c", "năm 27 trước Công nguyên và thế kỷ X, năm 938", True), ("d", None, False)], "context_id string, context string, is_vietnam boolean")
    got = {(r["surface"], r["bucket"]) for r in spans.extract_temporal(df).collect()}
    assert got == {("năm 27", "BC"), ("thế kỷ X", "VN"), ("năm 938", "10C")}


def test_iob(spark):
    tags = ["B-PER", "I-PER", "O", "I-LOC", "B-LOC", "B-LOC", "I-LOC", "I-PER"]
    df = spark.createDataFrame([(1, i, f"w{i}", t) for i, t in enumerate(tags)], "sentence_id int, pos int, token string, tag string")
    assert sorted((r["surface"], r["type"]) for r in spans.merge_iob(df).collect()) == [("w0 w1", "PER"), ("w4", "LOC"), ("w5 w6", "LOC")]


def test_clean(spark):
    cases = [
        ("năm 1945", "LOC", None, None), ("ông", "PER", None, None), (", Trần Hưng", "PER", "Trần Hưng", "PER"), ("Vua Lê Lợi", "LOC", "Lê Lợi", "PER"),
        ("sông Hồng Hà", "LOC", "Hồng Hà", "LOC"), ("Pháp chiếm Huế", "LOC", None, None), ("##abc", "PER", None, None), ("Hồi giáo Ả Rập", "ORG", None, None),
        ("1945", "YEAR", "1945", "YEAR"), ("Nguyễn Huệ", "PER", "Nguyễn Huệ", "PER"), ("", "PER", None, None), ("Mỹ", "LOC", "Mỹ", "LOC"), ("Lào", "LOC", "Lào", "LOC"), ("Xyz", "LOC", None, None),
    ]
    got = spans.clean(spark.createDataFrame([c[:2] for c in cases], "surface string, type string")).collect()
    for (s, t, want, kind), r in zip(cases, got, strict=True):
        assert (r["clean_surface"], r["clean_type"]) == (want, kind), s


def test_distractors_are_distinct_and_fall_back(spark):
    ents = [("YEAR", "20C", f"năm 19{i:02d}") for i in range(10, 40)] + [("YEAR", "3C", "năm 250"), ("LOC", "VN", "Huế"), ("LOC", "TG", "Paris"), ("LOC", "TG", "Roma"), ("LOC", "TG", "Bonn")]
    e = spark.createDataFrame(ents, "type string, bucket string, surface string")
    a = e.withColumn("key", F.concat_ws("|", "type", "surface"))
    got = {r["surface"]: r["distractors"] for r in items.distractors(a, items.distractor_pool(e)).collect()}
    assert len(got) == len(ents)
    for s, d in got.items():
        assert len(set(d)) == len(d) and s.removeprefix("năm ") not in d
    assert set(got["Huế"]) == {"Paris", "Roma", "Bonn"} and len(got["năm 1920"]) == 3


def test_options(spark):
    df = spark.createDataFrame([("k", "Huế", ["huế", "Hà Nội", "hà nội", " Vinh", "Lào", "Đà"]), ("m", "Huế", ["a", "A", "b"])], "key string, answer string, distractors array<string>")
    got = {r["key"]: r for r in items.finalize_options(df).collect()}
    o = got["k"]["options"]
    assert [x["label"] for x in o] == list("ABCD") and sum(x["is_correct"] for x in o) == 1 and {x["text"] for x in o} == {"Huế", "Hà Nội", "Vinh", "Lào"}
    assert [x["text"] for x in o if x["label"] == got["k"]["answer_key"]] == ["Huế"]
    assert got["m"]["options"] is None


def test_model_output(spark):
    ok = '```json\n{"question": "Ai xây", "correct_answer": "Lý", "distractors": ["a", "b", "c"], "evidence_sentence": "Vua Lý xây thành rồi đi xa", "bloom_level": "nhan_biet"}\n```'
    df = spark.createDataFrame([("1", ok, "Năm đó vua Lý. Vua Lý xây thành rồi về."), ("2", '{"question": ""}', "x"), ("3", "not json", "x")], "key string, output string, context string")
    got = {r["key"]: r for r in items.parse_model_output(df).collect()}
    assert got["1"]["ok"] and got["1"]["question"] == "Ai xây?" and got["1"]["evidence"] == "Vua Lý xây thành rồi"
    assert not got["2"]["ok"] and not got["3"]["ok"]


def test_retrieval(spark):
    docs = spark.createDataFrame([("a", "hai con mèo"), ("b", "một con chó và một con mèo"), ("c", "không liên quan"), ("d", None)], "k string, t string")
    q = spark.createDataFrame([("q", "mèo hai")], "q string, text string")
    ranked = retrieve.bm25(docs.where("t is not null"), q, "k", "t", 3).orderBy("rank").collect()
    assert ranked[0]["doc"] == "a"
    both = retrieve.fuse(spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "q string, doc string, rank int"), spark.createDataFrame([("q", "y", 1)], "q string, doc string, rank int")).orderBy("rank").collect()
    assert [r["doc"] for r in both] == ["y", "x"]


@pytest.mark.parametrize("q,want", [("Ai?", 0.3), ("Ai đã xây thành Huế?", 0.6), ("Ai đã xây nên thành Huế?", 1.0), ("Họ đã làm gì ở thành Huế?", 0.85), ("Không ai nói không có điều này ở Huế", 0.35), ("", 0.0)])
def test_clarity(spark, q, want):
    assert abs(spark.createDataFrame([(q,)], "q string").select(verify.clarity(F.col("q"))).first()[0] - want) < 1e-9


def test_verdict(spark):
    cols = ", ".join(f"{c} double" for c in verify.WEIGHTS)
    df = spark.createDataFrame([(1.0,) * 8, (0.6,) * 8, (0.2,) * 8], cols)
    assert abs(sum(verify.WEIGHTS.values()) - 1) < 1e-9
    assert [(r["score"], r["verdict"]) for r in verify.verdict(df).collect()] == [(1.0, "accepted"), (0.6, "needs_review"), (0.2, "rejected")]


def test_position_balance(spark):
    rows = [(i, k) for i, k in enumerate("ABCDAA")] + [(9, None)]
    got = {r["i"]: r["answer_position_ok"] for r in verify.position_balance(spark.createDataFrame(rows, "i int, answer_key string"), ["i"]).collect()}
    assert got[0] == 0.0 and got[3] == 1.0 and got[5] == 0.0 and got[4] == 0.4 and got[9] is None


def test_similar_questions_equal_brute_force(spark):
    random.seed(5)
    base = ["ai là người xây thành huế năm 1802", "vì sao nhà vua dời đô về phía nam", "chợ mới họp ở đâu sau trận lụt"]
    qs = []
    for i in range(60):
        s = list(random.choice(base))
        for _ in range(random.randrange(4)):
            s[random.randrange(len(s))] = random.choice("abcde ")
        qs.append((f"{i:03d}", "".join(s)))
    grams = {i: {q[k : k + 3] for k in range(len(q) - 2)} for i, q in qs}
    want = {}
    for i, _ in qs:
        best = max(((len(grams[i] & grams[j]) / len(grams[i] | grams[j]), j) for j, _ in qs if j < i), default=(0, None), key=lambda x: x[0])
        if best[0] >= 0.85:
            want[i] = round(best[0], 6)
    got = {r["item"]: r["similarity"] for r in verify.similar_questions(spark.createDataFrame(qs, "item_id string, question string"), "item_id").collect()}
    assert got == want


def test_grams_of_questions_are_not_broadcast(spark):
    """The planner takes them to be as large as the scan, which is under the bound of broadcasts; they are many times larger."""
    df = spark.createDataFrame([(f"i{n}", f"Vua nao len ngoi nam {n}?") for n in range(20)], "item_id string, question string")
    found = verify.similar_questions(df, "item_id")
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()


def test_ahp_and_topsis_goldens(spark):
    w = {r["criterion"]: (r["weight"], r["lambda_max"], r["cr"]) for r in decide.ahp(decide.comparison_matrix(spark)).collect()}
    assert w["vqr"] == (0.2566, 8.227, 0.023) and w["duplicate_check"][0] == 0.0451
    table = {  # fixed values: a published table of three methods
        "rule_based": [0.2789598108747045, 0.356, 0.278, 0.92, 0.977, 0.988, 0.926, 0.08],
        "rag_llm": [0.6222222222222222, 0.951, 0.594, 0.74, 0.838, 1.0, 0.862, 0.65],
        "vit5_ft": [0.4511784511784512, 0.799, 0.374, 0.74, 0.708, 0.992, 0.751, 0.733],
    }
    values = spark.createDataFrame([(m, c, v) for m, vs in table.items() for c, v in zip(decide.CRITERIA, vs, strict=True)], "alternative string, criterion string, value double")
    weights = decide.ahp(decide.comparison_matrix(spark)).select("criterion", F.col("exact").alias("weight"), F.lit(True).alias("benefit"))
    got = {r["alternative"]: (r["topsis_score"], r["rank"]) for r in decide.topsis(values, weights).collect()}
    assert got == {"rag_llm": (0.8894, 1), "vit5_ft": (0.5417, 2), "rule_based": (0.1584, 3)}
    s = decide.sensitivity(values, weights, "vqr")
    assert s.count() == 60 and decide.crossovers(s).count() == 0


def bank(spark, n=60, seed=1):
    random.seed(seed)
    rows = [(f"i{k:03d}", random.choice(exam.LEVELS), f"c{(c := random.randrange(14)):02d}", f"t{c % 5}", round(random.random(), 3)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "item_id string, bloom string, context_id string, title string, score double")


def test_exam(spark):
    t = {r["level"]: r["target"] for r in exam.targets(spark, {"nhan_biet": 0.4, "thong_hieu": 0.35, "van_dung": 0.25}, 10).collect()}
    assert t == {"nhan_biet": 4, "thong_hieu": 4, "van_dung": 2, "van_dung_cao": 0}
    _, df = bank(spark)
    g, b = exam.greedy(df, 12, t).collect(), exam.best(df, 12, t, slack=3).collect()
    for got in (g, b):
        assert len(got) == 12 and max(sum(x["context_id"] == y["context_id"] for x in got) for y in got) <= 2
    for level, want in t.items():
        if want:
            assert abs(sum(x["bloom"] == level for x in b) - want) <= 3
    assert {x["title"] for x in b} == {f"t{i}" for i in range(5)}


def test_best_is_optimal(spark):
    from itertools import combinations

    for seed in (2, 3):
        rows, df = bank(spark, 12, seed)
        t = {"nhan_biet": 1, "thong_hieu": 1, "van_dung": 1, "van_dung_cao": 1}

        def fine(s):
            if any(sum(x[2] == y[2] for x in s) > 2 for y in s):
                return False
            for level in exam.LEVELS:
                have = any(r[1] == level for r in rows)
                if have and abs(sum(x[1] == level for x in s) - 1) > 1:
                    return False
            many = {x[3] for x in rows if sum(y[3] == x[3] for y in rows) > 1}
            return len(many) > 4 or many <= {x[3] for x in s}

        totals = [sum(x[4] for x in s) for s in combinations(rows, 4) if fine(s)]
        got = exam.best(df, 4, t, slack=1).collect()
        assert abs(sum(x["score"] for x in got) - max(totals, default=0)) < 1e-9


def test_shortlist_keeps_what_titles_need(spark):
    cols = "item_id string, bloom string, context_id string, title string, score double"
    rows = [("x2", "thong_hieu", "cx", "X", 0.1), ("x1", "thong_hieu", "cy", "X", 0.05)]
    rows += [(f"r{i}", "thong_hieu", f"c{i}", f"T{i}", 0.95) for i in range(9)] + [("n", "nhan_biet", "cn", "N", 0.9)]
    t = {"nhan_biet": 1, "thong_hieu": 1}
    got = {r["item_id"] for r in exam.best(spark.createDataFrame(rows, cols), 2, t, slack=0).collect()}
    assert got == {"x2", "n"}
    # null is no title that has to be covered
    rows = [("a", "nhan_biet", "c1", None, 0.1), ("b", "nhan_biet", "c2", None, 0.2), ("c", "nhan_biet", "c3", "T", 0.9)]
    assert [r["item_id"] for r in exam.best(spark.createDataFrame(rows, cols), 1, {"nhan_biet": 1}, slack=0).collect()] == ["c"]


@pytest.mark.parametrize("per_context", [1, 2])
def test_best_over_banks_larger_than_the_shortlist(spark, per_context):
    from itertools import combinations

    rng = random.Random(17)
    for _ in range(3):
        rows = [(f"i{i:02d}", rng.choice(exam.LEVELS[:2]), f"c{rng.randrange(12)}", None, round(rng.random(), 3)) for i in range(40)]
        rows = [(a, b, c, rng.choice(["A", "B", "C"]) if int(c[1:]) > 1 else None, s) for a, b, c, _, s in rows]
        home = {}
        for _, _, c, title, _ in rows:
            home[c] = min(x for x in (home.get(c), title) if x) if home.get(c) or title else None
        titles = [home[r[2]] for r in rows]
        many = {x for x in titles if x and titles.count(x) > 1}
        df = spark.createDataFrame(rows, "item_id string, bloom string, context_id string, title string, score double")

        def fine(s):
            places = [r[2] for r in s]
            if max(map(places.count, places)) > per_context or abs(sum(r[1] == "nhan_biet" for r in s) - 2) > 1 or abs(sum(r[1] == "thong_hieu" for r in s) - 1) > 1:
                return False
            return len(many) > 3 or many <= {home[r[2]] for r in s}

        want = max((sum(r[4] for r in s) for s in combinations(rows, 3) if fine(s)), default=0)
        got = exam.best(df, 3, {"nhan_biet": 2, "thong_hieu": 1}, per_context=per_context, slack=1).collect()
        assert abs(sum(r["score"] for r in got) - want) < 1e-9
        assert exam.shortlist(df, 3, per_context).count() < 40


def test_overlapping_times():
    text = "Từ 12/5/1802 đến năm 1805 TCN? thế kỷ 19, ngày 1 tháng 2 năm 1930; 1931-1932"
    got = spans.temporal_spans(text)
    assert [(x, k, v) for x, k, v, _, _ in got] == [
        ("12/5/1802", "DATE", "1802-05-12"), ("năm 1805", "YEAR", "-1805"), ("thế kỷ 19", "CENTURY", "19"), ("ngày 1 tháng 2 năm 1930", "DATE", "1930-02-01"),
        ("1931", "YEAR", "1931"), ("1932", "YEAR", "1932"),
    ]
    assert all(text[s:e] == x for x, _, _, s, e in got)


def test_entities_of_a_tagger_with_offsets(spark):
    p = spark.createDataFrame([("c", "Năm 1802, Vua Lê Lợi đến Nga.", True)], "context_id string, context string, is_vietnam boolean")
    tagged = spark.createDataFrame(
        [("c", "PERSON", "Vua Lê Lợi", None, None), ("c", "LOCATION", "Nga", 25, 28), ("c", "MISC", "x", 1, 2), ("c", "PER", " ", 1, 2), ("c", "ORG", "Vắng Mặt", None, None)],
        "context_id string, label string, word string, start int, end int",
    )
    entities, pool = spans.extract_entities(p, tagged)
    got = {(r["surface"], r["type"], r["normalized"], r["char_start"], r["bucket"]) for r in entities.collect()}
    assert got == {("Năm 1802"[4:], "YEAR", "1802", 4, "19C"), ("Lê Lợi", "PER", "lê_lợi", 10, "VN"), ("Nga", "LOC", "nga", 25, "VN"), ("Vắng Mặt", "ORG", "vắng_mặt", None, "VN")}
    assert pool.count() == 4


def test_eda_edges(spark):
    df = spark.createDataFrame([(1,), (1,), (5,)], "x int")
    assert [(r["bin"], r["n"]) for r in eda.histogram(df, "x", 4).orderBy("bin").collect()] == [(0, 2), (3, 1)]
    assert eda.histogram(spark.createDataFrame([], "x int"), "x").count() == 0


def test_models(spark):
    from tramsu.operators import models

    df = spark.createDataFrame([("c", "Vua Lê Lợi về. Lê Lợi ở Huế."), ("d", None)], "context_id string, context string")
    tagger = lambda s: [(x, k) for x, k in (("Vua Lê Lợi", "PERSON"), ("Lê Lợi", "PER"), ("Huế", "LOCATION"), ("Bà", "PER")) if x in s]
    got = models.extract_named(df, tagger).collect()
    text = df.first()["context"]
    assert {(r["surface"], r["type"]) for r in got} == {("Lê Lợi", "PER"), ("Huế", "LOC")} and all(text[r["char_start"] : r["char_end"]] == r["surface"] for r in got)
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int")
    out = models.score_once(rows, ["k"], lambda k: k.withColumn("s", F.length(F.coalesce("k", F.lit("")))))
    assert sorted((r["v"], r["s"]) for r in out.collect()) == [(1, 1), (2, 1), (3, 0)]
    p = rows.select(models.prompt(F.col("k"), F.lit(None).cast("string"), F.lit("w"), F.lit("l"), {"w": "Ask who."}).alias("p")).first()["p"]
    assert "Ask who." in p
    train = spark.createDataFrame([("vì sao vua về", "b"), ("vì sao dân đi", "b"), ("ở đâu có chợ", "a"), ("ở đâu có đền", "a")] * 3, "t string, y0 string")
    m = models.train_level_classifier(train, "t", "y0", 500)
    rep = models.class_report(models.predict_level(m, train, "t"), "y0", "predicted").collect()
    assert all(r["f1"] == 1.0 for r in rep)


def test_questions_by_template(spark):
    df = spark.createDataFrame(
        [("thoi_gian", "Lê Lợi", True, 1), ("thoi_gian", "Trận Bến Cũ", False, 4), ("nhan_vat", "Thành Mới", False, 2), ("lạ", "Đèo Cao", None, 0)],
        "wh string, subj string, person boolean, draw long",
    )
    q = items.build_question(F.col("wh"), F.col("subj"), F.lit("chỉ huy"), F.coalesce("person", F.lit(False)), F.col("draw"))
    assert [r[0] for r in df.select(q).collect()] == ["Lê Lợi qua đời năm nào?", "Trận Bến Cũ xảy ra vào năm nào?", "Thành Mới do ai chỉ huy?", "Đèo Cao là gì?"]
    df = spark.createDataFrame([("T", "x", "Ông chỉ huy, rồi cai trị."), ("", "Vua Hùng, dựng nước", "Ông ký kếtx"), (None, None, None)], "title string, context string, sentence string")
    got = df.select(items.subject(F.col("title"), F.col("context")), items.verb_of(F.col("sentence"))).collect()
    assert [tuple(r) for r in got] == [("T", "chỉ huy"), ("Vua Hùng", "thực hiện"), ("", "thực hiện")]


def test_person_passages_and_famous_years(spark):
    p = spark.createDataFrame([("c", "Tiểu sử LÊ LỢI"), ("d", None), ("e", "Bến Cũ")], "context_id string, title string")
    e = spark.createDataFrame([("c", "PER", "Lê Lợi"), ("d", "PER", "Lê Lợi"), ("e", "LOC", "Bến Cũ"), ("e", "PER", None)], "context_id string, type string, surface string")
    assert {tuple(r) for r in items.about_persons(p, e).collect()} == {("c", True), ("d", False)}
    pool = items.distractor_pool(spark.createDataFrame([("YEAR", "3C", "năm 250"), ("YEAR", "20C", "1945")], "type string, bucket string, surface string"))
    a = spark.createDataFrame([("k", "YEAR", "3C", "năm 250"), ("m", "YEAR", "20C", "1945"), ("p", "PER", "VN", "Ai")], "key string, type string, bucket string, surface string")
    got = {r["key"]: r["distractors"] for r in items.distractors(a, pool).collect()}
    assert len(set(got["k"])) == 3 and set(got["k"]) <= set(items.FAMOUS_YEARS)
    assert len(set(got["m"])) == 3 and "1945" not in got["m"] and got["p"] == []


def test_alternatives_of_a_model_and_of_the_passage(spark):
    rows = [
        ("a", "Ai?", "Huế", "Hà Nội | huế cũ | Hà Nội | xa | sông | Sài Gòn | Đà Nẵng | Cần Thơ", ""), ("b", "Ai?", "Huế", "Hà Nội, và. Cần Thơ", "Ở Sài Gòn năm 1802 và Huế Xưa, Vua Minh Mạng đến Hà Nội."),
        ("c", " ", "Huế", None, None), ("d", "Ai?", "Huế", "", "không có gì"),
    ]
    df = spark.createDataFrame(rows, "key string, question string, answer string, output string, context string")
    got = {r["key"]: (r["distractors"], r["skipped"]) for r in items.finish_alternatives(df).collect()}
    assert got["a"] == (["Hà Nội", "Sài Gòn", "Đà Nẵng"], None)
    assert got["b"] == (["Hà Nội", "Cần Thơ", "Sài Gòn"], None)
    assert got["c"] == ([], "empty_question") and got["d"] == ([], "few_distractors")
    n = survey.skip_counters(items.finish_alternatives(df))
    assert {tuple(r) for r in n.collect()} == {("empty_question", 1), ("few_distractors", 1)}


def test_survey_and_totals(spark):
    titles = spark.createDataFrame([("Nhà Nguyễn",), ("Bóng đá",), (None,), ("Chiến tranh lạnh",)], "title string")
    assert [r[0] for r in titles.select(survey.guess_history(F.col("title"))).collect()] == [True, False, False, True]
    n = spark.createDataFrame([(1500,), (1499,), (800,), (799,), (None,)], "n int")
    assert [r[0] for r in n.select(survey.go_no_go(F.col("n"))).collect()] == ["go", "conditional", "conditional", "no_go", "no_go"]
    calls = spark.createDataFrame([("m", 1000, 500), ("m", None, 500), ("x", 1, 1)], "model string, prompt_tokens long, completion_tokens long")
    prices = spark.createDataFrame([("m", 0.15, 0.6)], "model string, prompt_price double, completion_price double")
    got = {r["model"]: (r["n_calls"], r["prompt_tokens"], r["cost"]) for r in survey.call_totals(calls, prices).collect()}
    assert got == {"m": (2, 1000, 0.00075), "x": (1, 1, None)}
    assert survey.survey(titles.withColumn("context_id", F.lit("c")).limit(0)).first()["decision"] == "no_go"


def test_weights_set_by_hand_are_divided_by_their_sum(spark):
    v = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 0.5), ("b", "x", 0.2), ("b", "y", 0.9)], "alternative string, criterion string, value double")
    w = spark.createDataFrame([("x", 3.0), ("y", 1.0)], "criterion string, weight double")
    half = spark.createDataFrame([("x", 0.75, True), ("y", 0.25, True)], "criterion string, weight double, benefit boolean")
    assert sorted(decide.live_topsis(v, w).collect()) == sorted(decide.topsis(v, half).collect())
    assert decide.live_topsis(v, w.withColumn("weight", F.lit(0.0))).count() == 2


def test_all_checks_in_one_pipeline(spark):
    opts = [("A", "Huế", True, "LOC"), ("B", "Hà Nội", False, "LOC"), ("C", "Vinh", False, "LOC"), ("D", "Đà Lạt", False, "LOC")]
    q = "Kinh đô của nhà Nguyễn thời ấy đặt ở đâu?"
    rows = [(i, "c", x, opts, "Huế", k, b) for i, x, k, b in (("a", q, "A", "nhan_biet"), ("b", q + "?", "B", "van_dung"), ("c", "Đâu", "C", None), ("d", None, None, "nhan_biet"))]
    df = spark.createDataFrame(rows, "item_id string, context_id string, question string, options array<struct<label string, text string, is_correct boolean, entity_type string>>, answer_text string, answer_key string, bloom string")
    facts = spark.createDataFrame([("c", ["huế"])], "context_id string, facts array<string>")
    labels = spark.createDataFrame([(i, "entailment", n == 0, "entailment" if n == 0 else "neutral") for i in "ab" for n in range(4)], "item_id string, evidence string, is_correct boolean, label string")
    said = spark.createDataFrame([(i, "nhan_biet") for i in "abcd"], "item_id string, level string")
    got = {r["item_id"]: r for r in verify.verify(df, facts, labels, said, "item_id").collect()}
    assert set(got) == set("abcd")
    assert got["a"]["violations"] == ["answer_position_ok"] and got["a"]["verdict"] == "accepted"
    assert got["b"]["violations"] == ["duplicate_check", "bloom_fidelity", "answer_position_ok"]
    assert {"evidence_match", "single_correct", "question_clarity", "bloom_fidelity"} <= set(got["c"]["violations"])
    assert "answer_position_ok" in got["d"]["violations"]


def test_checks_are_made_once_for_what_reads_them_thrice(spark):
    opts = [("A", "Huế", True, "LOC"), ("B", "Hà Nội", False, "LOC")]
    df = spark.createDataFrame([("a", "c", "Kinh đô ở đâu?", opts, "Huế", "A", "nhan_biet")], "item_id string, context_id string, question string, options array<struct<label string, text string, is_correct boolean, entity_type string>>, answer_text string, answer_key string, bloom string")
    facts = spark.createDataFrame([("c", ["huế"])], "context_id string, facts array<string>")
    labels = spark.createDataFrame([("a", "entailment", True, "entailment")], "item_id string, evidence string, is_correct boolean, label string")
    said = spark.createDataFrame([("a", "nhan_biet")], "item_id string, level string")
    plan = verify.verify(df, facts, labels, said, "item_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan  # the joins of the checks end at a checkpoint
