"""Scalar functions over passages, questions and answers, as column expressions (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tramsu.functions.text import nfc

#: Years counted in a passage.
YEARS = r"\b(9\d\d|1\d{3}|20[0-2]\d)\b"
#: What a question asks for, by phrases looked for in this order.
WH_PHRASES = {
    "thoi_gian": ["khi nào", "năm nào", "bao giờ", "thời gian", "ngày nào"],
    "nhan_vat": ["ai ", "người nào", "nhân vật", "ông nào", "vua nào"],
    "dia_diem": ["ở đâu", "tại đâu", "địa điểm", "nơi nào"],
    "nguyen_nhan": ["vì sao", "tại sao", "nguyên nhân", "lý do"],
    "y_nghia": ["ý nghĩa", "kết quả", "hệ quả", "dẫn đến"],
}
#: Phrases of the higher levels, highest first; the lowest level is what is left.
LEVEL_PHRASES = {
    "van_dung_cao": ["bình luận", "phê phán", "đề xuất", "giải pháp", "kiến nghị", "sáng tạo", "thiết kế", "xây dựng phương án", "tổng hợp", "hệ thống hoá"],
    "van_dung": [
        "nhận xét", "đánh giá", "so sánh", "liên hệ", "rút ra", "bài học", "kinh nghiệm", "phân tích", "chứng minh", "giả sử", "nếu như", "trong bối cảnh",
        "hiện nay", "vận dụng", "áp dụng", "thực tiễn",
    ],
    "thong_hieu": [
        "vì sao", "tại sao", "do đâu", "nguyên nhân", "mục đích", "ý nghĩa", "tác động", "hệ quả", "dẫn đến", "ảnh hưởng", "giải thích", "chứng tỏ", "thể hiện",
        "phản ánh", "biểu hiện", "nội dung chính", "điểm khác biệt", "điểm giống nhau", "vai trò", "đặc điểm", "tính chất",
    ],
}
LEVELS = ("nhan_biet", "thong_hieu", "van_dung", "van_dung_cao")


def passage_form(c: Column) -> Column:
    """NFC, straight quotes, single blanks, at most one empty line, trimmed; null stays null."""
    s = F.translate(nfc(c), "\u00a0“”‘’", " \"\"''")
    s = F.regexp_replace(s, r"[ \t]+", " ")
    s = F.regexp_replace(s, r"\n{3,}", "\n\n")
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def span_form(c: Column) -> Column:
    """The shorter form used before span extraction: NFC, single blanks, trimmed."""
    return F.regexp_replace(F.regexp_replace(F.translate(nfc(c), "\u00a0", " "), r"[ \t]+", " "), r"(?U)^\s+|\s+$", "")


def count_tokens(c: Column) -> Column:
    """Blank-separated tokens; 0 for an empty text."""
    bare = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"(?U)\s+")))


def years_of(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(YEARS), 1), lambda y: y.cast("int"))


def primary_year(years: Column) -> Column:
    """The most frequent year, the least one among equals; null for none."""
    counted = F.transform(F.array_distinct(years), lambda y: F.struct((-F.size(F.filter(years, lambda z: z == y))).alias("n"), y.alias("y")))
    return F.try_element_at(F.array_sort(counted), F.lit(1))["y"]


def year_density(n_years: Column, n_tokens: Column) -> Column:
    """Years a hundred tokens, two decimals; 0 where there are no tokens."""
    return F.when(n_tokens > 0, F.round(100 * n_years / n_tokens, 2)).otherwise(F.lit(0.0))


def short_id(prefix: str, *parts: Column, sep: str = "") -> Column:
    """prefix and twelve hex digits of the md5 of the parts."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws(sep, *parts)), 1, 12))


def year_bucket(year: Column) -> Column:
    """BC before year 0, else the century as {n}C (1900 is of 20C)."""
    return F.when(year < 0, "BC").otherwise(F.concat((F.floor(year / 100) + 1).cast("string"), F.lit("C")))


def century_of(bucket: Column) -> Column:
    """The number in a century bucket; 20 where it names none."""
    return F.coalesce(F.regexp_replace(bucket, "C$", "").try_cast("int"), F.lit(20))


def answer_surface(surface: Column, kind: Column) -> Column:
    """Years and dates without the word for year before them."""
    return F.when(kind.isin("YEAR", "DATE"), F.regexp_replace(surface, r"(?i)^năm\s+", "")).otherwise(surface)


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])(?U)\s+")


def find_evidence(context: Column, answer: Column) -> Column:
    """struct(sentence, found): the first sentence that holds the answer, else the first one."""
    all_ = sentences(context)
    hit = F.try_element_at(F.filter(all_, lambda s: F.contains(s, answer)), F.lit(1))
    return F.struct(F.coalesce(hit, F.try_element_at(all_, F.lit(1))).alias("sentence"), hit.isNotNull().alias("found"))


def span_ok(context: Column, answer: Column, start: Column, impossible: Column) -> Column:
    """Whether the answer stands at start, or else anywhere, in the context; false for an
    impossible question or an empty or null answer."""
    at = F.substring(context, start + 1, F.length(answer)) == answer
    return F.coalesce(~impossible & (F.length(answer) > 0) & (F.coalesce(at, F.lit(False)) | F.contains(context, answer)), F.lit(False))


def _any(text: Column, phrases: list[str]) -> Column:
    out = F.contains(text, F.lit(phrases[0]))
    for p in phrases[1:]:
        out = out | F.contains(text, F.lit(p))
    return out


def wh_type(question: Column, answer: Column) -> Column:
    """What a question asks for: a time if the answer is 3 or 4 digits, else by phrases, else an event."""
    q = F.lower(F.coalesce(question, F.lit("")))
    out = F.when(F.coalesce(F.trim(answer).rlike(r"^\d{3,4}$"), F.lit(False)), "thoi_gian")
    for kind, phrases in WH_PHRASES.items():
        out = out.when(_any(q, phrases), kind)
    return out.otherwise("su_kien")


def keyword_level(question: Column) -> Column:
    q = F.lower(F.coalesce(question, F.lit("")))
    out = None
    for level, phrases in LEVEL_PHRASES.items():
        out = F.when(_any(q, phrases), level) if out is None else out.when(_any(q, phrases), level)
    return out.otherwise("nhan_biet")


def stem(question: Column) -> Column:
    """A stem without its number and its lettered options."""
    bare = F.regexp_replace(question, r"(?i)^\s*câu\s*\d+\s*[:.]\s*", "")
    return F.trim(F.split(bare, r"\n\s*[A-D][.: ]", 2)[0])


def trigrams(c: Column) -> Column:
    """The set of character trigrams; empty for fewer than three characters."""
    n = F.length(c)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(c, i, 3)))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))
