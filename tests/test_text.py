from pyspark.sql import functions as F

from tramsu.functions import normalize as N
from tramsu.functions.splits import split_name
from tramsu.functions.text import fold, fold_words, same_title


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_passage_form(spark):
    raw = "  a b “c” ‘d’  \te\n\n\n\nf́ "
    assert one(spark, raw, N.passage_form) == "a b \"c\" 'd' e\n\nf́".replace("f́", "f́")
    assert one(spark, "", N.passage_form) == ""
    assert one(spark, None, N.passage_form) is None


def test_tokens_and_years(spark):
    assert one(spark, "  một  hai ba ", N.count_tokens) == 3
    assert one(spark, "", N.count_tokens) == 0
    text = "1945 1954 1945 899 2031 938"
    years = spark.createDataFrame([(text,)], "x string").select(N.years_of(F.col("x")).alias("y"), N.primary_year(N.years_of(F.col("x"))).alias("p")).first()
    assert years["y"] == [1945, 1954, 1945, 938] and years["p"] == 1945
    assert one(spark, "không có năm", lambda c: N.primary_year(N.years_of(c))) is None
    tie = one(spark, "1954 1945", lambda c: N.primary_year(N.years_of(c)))
    assert tie == 1945


def test_buckets(spark):
    got = [one(spark, y, N.year_bucket, "int") for y in (1954, 938, -27, 1900)]
    assert got == ["20C", "10C", "BC", "20C"]
    assert [one(spark, b, N.century_of) for b in ("19C", "unk", "BC", None)] == [19, 20, 20, 20]


def test_evidence(spark):
    df = spark.createDataFrame([("Câu một. Ở Huế có thành. Hết.", "Huế"), ("Câu một. Hai.", "Huế")], "c string, a string")
    got = [r[0] for r in df.select(N.find_evidence(F.col("c"), F.col("a"))).collect()]
    assert (got[0]["sentence"], got[0]["found"]) == ("Ở Huế có thành.", True)
    assert (got[1]["sentence"], got[1]["found"]) == ("Câu một.", False)


def test_trigrams(spark):
    assert one(spark, "abcabc", N.trigrams) == ["abc", "bca", "cab"]
    assert one(spark, "ab", N.trigrams) == []


def test_splits_and_folding(spark):
    assert [one(spark, s, split_name) for s in ("TRAIN ", "training", "Val", " validation", "Test", None, " ", "khac")] == ["train", "train", "dev", "dev", "test", None, None, "khac"]
    assert fold_words("Đèo Cả, VƯƠNG​ quốc_7") == ["deo", "ca", "vuong", "quoc", "7"]
    assert one(spark, "Thông-Hiểu  ", fold) == "thong hieu"
    assert one(spark, " Lịch  SỬ ", same_title) == "lịch sử"
    assert one(spark, None, fold) is None
