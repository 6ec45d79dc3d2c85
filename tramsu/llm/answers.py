"""Question-answer pairs whose answer is of no use, with the kind of defect."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramsu.functions.text import fold_words
from tramsu.session import cut, spread

DEFECTS = ("empty_answer", "refusal", "copies_question", "other_language", "truncated_answer")

#: Fixed, as folded words: what stands where an answer is missing.
PLACEHOLDERS = frozenset(
    (
        "n a", "na", "null", "none", "nan", "nil", "tbd", "tba", "todo", "undefined", "missing", "empty", "blank", "unknown", "no answer", "not available", "x", "xx", "xxx",
        "chua co dap an", "chua co", "khong co", "khong co dap an", "dap an", "trong", "de trong", "dang cap nhat", "cap nhat sau", "chua cap nhat", "khong ro", "sans reponse", "vide", "aucune",
    )
)
#: Fixed, as patterns over folded words: how answers are declined in Vietnamese, English and French.
REFUSALS = re.compile(
    r"\b(?:(?:toi|minh|em|chung toi|he thong|tro ly|mo hinh)(?: \w+){0,3} (?:khong the|khong duoc phep|khong co du|chua the|tu choi|xin phep khong|rat tiec)(?: \w+){0,3} "
    r"(?:tra loi|ho tro|cung cap|dua ra|ket luan|giup|thong tin|thuc hien|dap ung|sinh|noi)"
    r"|(?:khong|chua) (?:co )?du (?:du kien|thong tin|du lieu|can cu)|(?:minh|toi|em) chiu\b|khong tra loi duoc"
    r"|tu choi (?:sinh|tra loi|dua ra|cung cap|thuc hien)|(?:doan van|van ban|ngu canh|tai lieu)(?: \w+){0,4} khong (?:chua|co|de cap|neu|cho biet)(?: \w+){0,3} (?:cau tra loi|dap an|thong tin)"
    r"|ngoai (?:kha nang|pham vi)|la (?:mot )?(?:tro ly ao|mo hinh ngon ngu|tri tue nhan tao)|cung cap them ngu canh"
    r"|i (?:m sorry|am sorry|apologi[sz]e)|i (?:can ?not|can ?t|am unable|am not able|won t|don t know|do not know|m unable|m not able|could not|couldn t)\b"
    r"|as an? (?:ai|assistant|language model)|unable to (?:help|answer|assist|provide)|(?:not|isn t) enough (?:information|context)|cannot (?:answer|help|assist|provide)|(?:passage|text|context) does(?: not|n t) (?:contain|say|mention)"
    r"|je (?:suis )?desole|je ne (?:peux|puis|sais|suis)\b|je n ai pas|en tant qu (?:assistant|ia|intelligence)|desole|impossible de repondre|pas assez d informations?|(?:texte|passage) ne (?:contient|dit|mentionne))\b"
)
#: Fixed, folded: words that ask.
ASKING = frozenset("ai nao gi dau sao nhieu the what who whom which when where why how quel quelle quels quelles qui que quoi comment pourquoi combien ou".split())
#: Fixed: words that no answer ends with, in Vietnamese and in English and French.
LINKING_VI = frozenset(
    """và mà của là với cho tại từ vào bằng bởi vì do nên thì khi trong giữa để đến về qua theo nhờ sau trước rồi còn nhưng hoặc đã đang sẽ bị được các những một""".split()
)
LINKING = frozenset(
    """the a an of and or to in on at by for with from that which who because but as than into was were is are be been had has have its their his her
    et ou de du des la le les un une au aux dans par pour sur avec sans que qui dont car mais est sont fut etait son sa ses leur leurs""".split()
)
_VIETNAMESE = re.compile("[ăâđêôơưĂÂĐÊÔƠƯ\u1ea0-\u1ef9]")


def links(text: str) -> bool:
    """Whether the last word of text only links what follows, in the language of its letters."""
    words = typed_words(text)
    return bool(words) and words[-1] in (LINKING_VI if _VIETNAMESE.search(unicodedata.normalize("NFC", text)) else LINKING)


_DANGLING = re.compile(r"(?:\.\.+|…|[-–—,;:(/])\s*$")


def trim_prefix(words: list[str]) -> list[str]:
    """Without the words that announce an answer or a question."""
    for lead in (("tra", "loi"), ("cau", "hoi"), ("dap", "an"), ("answer",), ("question",), ("reponse",)):
        if tuple(words[: len(lead)]) == lead and len(words) > len(lead):
            return words[len(lead) :]
    return words


def is_empty(answer: str | None) -> bool:
    words = fold_words(answer)
    return not words or " ".join(words) in PLACEHOLDERS and (len(words) > 1 or answer.isascii() or len(words[0]) > 3)


def is_refusal(answer: str) -> bool:
    return bool(REFUSALS.search(" ".join(fold_words(answer))))


def is_copy(question: str, answer: str) -> bool:
    """Whether the answer says the question again, or a clause of it that asks; typos allowed."""
    q, a = fold_words(question), trim_prefix(fold_words(answer))
    if len(a) < 5 or not q:
        return False
    left = Counter(a) - Counter(q)
    missing = list(left.elements())
    if len(missing) > 0.45 * len(a):
        return False
    from tramsu.llm.same import typo_of

    spare = list((Counter(q) - Counter(a)).elements())
    missed = 0
    for w in missing:
        hit = next((x for x in spare if typo_of(w, x)), None)
        if hit is None:
            missed += 1
        else:
            spare.remove(hit)
    share = 1 - missed / len(a)
    asks = bool(ASKING & set(a)) or answer.rstrip().endswith("?")
    return share >= 0.72 and asks and len(a) >= 0.3 * len(q) or share >= 0.85 and len(a) >= 0.6 * len(q)


def other_script(question: str, answer: str) -> bool:
    """Whether one is mostly in Latin letters and the other mostly not."""

    def latin(text: str) -> float | None:
        letters = [c for c in text if c.isalpha()]
        return sum(c < "\u0250" or "\u1e00" <= c <= "\u1eff" for c in letters) / len(letters) if len(letters) > 1 else None

    q, a = latin(question), latin(answer)
    return q is not None and a is not None and (q > 0.5) != (a > 0.5)


class Languages:
    """Naive Bayes over character n-grams (1 to 3) of words that are no names."""

    def __init__(self, texts: list[tuple[str, str]]):
        self.counts: dict[str, Counter] = {}
        for lang, text in texts:
            c = self.counts.setdefault(lang, Counter())
            words = self.words(text)
            for w in words:
                c.update(self.grams(w))
        self.total = {k: sum(c.values()) for k, c in self.counts.items()}
        self.kinds = max(1, len(set().union(*self.counts.values()))) if self.counts else 1
        self.memo: dict[str, dict[str, float]] = {}

    @staticmethod
    def words(text: str) -> list[str]:
        """Words in small letters; a capital that opens a sentence before a small letter counts as
        one. In texts all in capitals every word counts."""
        chunks = [w for w in re.split(r"[\s\d.,;:!?…\"'“”‘’«»()\[\]–—-]+", text) if w]
        if sum(c[:1].isupper() for c in chunks) > 0.9 * len(chunks) and text.upper() == text:
            return [c.lower() for c in chunks]
        out = []
        for i, c in enumerate(chunks):
            if c[:1].islower() or i == 0 and len(chunks) > 1 and chunks[1][:1].islower():
                out.append(c.lower())
        return out

    @staticmethod
    def grams(word: str) -> list[str]:
        w = f"^{word}$"
        return [w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] not in "^$"]

    def scores(self, word: str) -> dict[str, float]:
        got = self.memo.get(word)
        if got is None:
            grams = self.grams(word)
            got = {k: sum(math.log((c[g] + 0.5) / (self.total[k] + 0.5 * self.kinds)) for g in grams) / 3 for k, c in self.counts.items()}
            if len(self.memo) < 200_000:
                self.memo[word] = got
        return got

    def of(self, text: str) -> tuple[str | None, float, int]:
        """(language, log odds against the next one, words judged); null where nothing can be judged."""
        words = self.words(text)
        if not words or len(self.counts) < 2:
            return None, 0.0, len(words)
        total = {k: sum(self.scores(w)[k] for w in words) for k in self.counts}
        first, second = sorted(total.values(), reverse=True)[:2]
        return max(total, key=total.get), first - second, len(words)


def fit_languages(texts: DataFrame, most: int = 300) -> Languages:
    """texts: text, lang. Fitted on the whole of at most `most` different texts of each of the languages vi, en and fr,
    the first by a hash, with and without accents (Vietnamese is typed without them too)."""
    from tramsu.functions.text import fold_text

    lang = F.substring(F.lower(F.trim("lang")), 1, 2)
    rows = texts.where("text is not null").select("text", lang.alias("lang"), F.xxhash64("text").alias("draw")).where("lang in ('vi', 'en', 'fr') and trim(text) <> ''")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    drawn = rows.select("lang", "draw").distinct().withColumn("k", rank).where(F.col("k") <= most).select("lang", "draw").collect()  # hashes, not texts
    chosen = rows.where(F.col("draw").isin([r["draw"] for r in drawn])).dropDuplicates(["lang", "draw"]).toPandas()
    wanted = {(r["lang"], r["draw"]) for r in drawn}
    held = sorted((k, t) for k, t, d in zip(chosen["lang"], chosen["text"], chosen["draw"], strict=True) if (k, d) in wanted)
    return Languages([*held, *[(k, ". ".join(fold_text(x) for x in t.split(". "))) for k, t in held if k == "vi"]])


_TYPED = re.compile(r"[^\W_]+")


def typed_words(text: str) -> list[str]:
    """Words in small letters with their accents (Unicode NFC); any number is #."""
    return ["#" if w.isdigit() else w for w in _TYPED.findall(unicodedata.normalize("NFC", text).lower())]


def ending(text: str) -> tuple[str, str]:
    """The last two words; a number counts as any number, the text's beginning as ^."""
    w = typed_words(text)[-2:]
    return ("^", *w)[-2:] if w else ("^", "")


def _contexts(batches):
    """Counts of ends and continuations: of words, of pairs of words, and of beginnings of words."""
    for pdf in batches:
        ends, goes, more = Counter(), Counter(), Counter()
        for text in pdf["text"]:
            w = ["^", *typed_words(text)]
            if _DANGLING.search(text) or len(w) < 2:
                continue
            for i in range(1, len(w)):
                last = i == len(w) - 1
                (ends if last else goes)["1 " + w[i]] += 1
                (ends if last else goes)["2 " + w[i - 1] + " " + w[i]] += 1
                for k in range(1, len(w[i])):
                    more["2 " + w[i - 1] + " " + w[i][:k]] += 1
                    if k < 4:
                        more["1 " + w[i][:k]] += 1
        keys = list(ends.keys() | goes.keys() | more.keys())
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pd.DataFrame({"context": part, "ends": [ends[k] for k in part], "goes": [goes[k] for k in part], "more": [more[k] for k in part]})


def truncated(end1: float, n1: float, end2: float, n2: float, more1: float, more2: float, last: str, base: float) -> bool:
    """Whether a text that stops after this word breaks off, from how often texts with the same
    last words end there or go on (its own end not counted)."""
    if n1 <= 0:  # no other text has the word: a word cut short, if others go on from it
        return last != "#" and (more2 > 0 or len(last) < 4 and more1 >= 5)
    p1 = (end1 + base) / (n1 + 1)
    p2 = (end2 + 2 * p1) / (n2 + 2)
    if last != "#" and more2 > 4 * max(1, n2) and n2 < 2 and len(last) < 4:
        return True
    return p2 < 0.025 and n2 + n1 >= 4


def _first_kinds(held):
    def run(batches):
        lang = held.value
        for pdf in batches:
            defect, last, before, judge = [], [], [], []
            for q, a in zip(pdf["question"], pdf["answer"], strict=True):
                found = None
                if is_empty(a):
                    found = "empty_answer"
                elif is_refusal(a):
                    found = "refusal"
                elif q and is_copy(q, a):
                    found = "copies_question"
                elif q and other_script(q, a):
                    found = "other_language"
                elif q:
                    la, odds, n = lang.of(a)
                    lq, sure, _ = lang.of(q)
                    if la and lq and la != lq and odds > 2.5 and sure > 2.5 and n > 1:
                        found = "other_language"
                if found is None and (_DANGLING.search(a) or links(a)):
                    found = "truncated_answer"
                e = ending(a or "")
                defect.append(found)
                before.append(e[0])
                last.append(e[1])
                judge.append(found is None)
            yield pdf[["item_id", "answer"]].assign(defect=defect, before=before, last=last, judge=judge)

    return run


def defects(items: DataFrame, language_texts: DataFrame, most: int = 300) -> DataFrame:
    """item_id, defect: every item whose answer_text is of no use, with one of DEFECTS; the first
    that holds, in the order of the tuple. language_texts: text, lang, to tell languages by.

    The languages of question and answer are compared by the posteriors of a naive Bayes over
    character n-grams, names left out. Truncation is told by the likelihood that a text ends after
    its last words: ends and continuations of all words and pairs of words are counted over all
    answers and option texts, once an item, a word cut short is one that only goes on elsewhere, and a
    text that ends in an ellipsis, a dash or a comma breaks off.

    A null or wordless answer is empty; a null question is copied by nothing and of no language.
    Needs item_id, question, answer_text, options (array of structs with text, or null); rows
    delivered again count once, several answers of one item the first defect by name; null item_id
    is left out; an empty table gives none.
    """
    rows = spread(items.where("item_id is not null").select("item_id", "question", F.col("answer_text").alias("answer"), "options"))
    said = rows.select("item_id", F.explode_outer("options.text").alias("text")).union(rows.select("item_id", "answer"))
    texts = said.where("text is not null").distinct()
    counts = texts.mapInPandas(_contexts, "context string, ends long, goes long, more long").groupBy("context").agg(
        F.sum("ends").alias("ends"), F.sum("goes").alias("goes"), F.sum("more").alias("more")
    )
    held = items.sparkSession.sparkContext.broadcast(fit_languages(language_texts, most))
    first = cut(
        rows.select("item_id", "question", "answer").distinct()
        .mapInPandas(_first_kinds(held), "item_id string, answer string, defect string, before string, last string, judge boolean")
    )
    sure = first.where("not judge").select("item_id", "defect")
    open_ = first.where("judge").withColumns({"c1": F.concat(F.lit("1 "), "last"), "c2": F.concat(F.lit("2 "), "before", F.lit(" "), "last")})
    one = counts.select(F.col("context").alias("c1"), F.col("ends").alias("e1"), F.col("goes").alias("g1"), F.col("more").alias("m1"))
    two = counts.select(F.col("context").alias("c2"), F.col("ends").alias("e2"), F.col("goes").alias("g2"), F.col("more").alias("m2"))
    asked = cut(open_.select("c1", "c2").distinct())
    known = asked.join(one, "c1", "left").join(two, "c2", "left").fillna(0)
    judged = cut(open_.join(known, ["c1", "c2"]))
    total = judged.agg(F.avg(F.col("e1") / F.greatest(F.col("e1") + F.col("g1"), F.lit(1)))).first()[0]

    def judge(batches, base=min(0.5, float(total or 0.1))):
        for pdf in batches:
            keep = [
                truncated(e1 - 1, e1 + g1 - 1, e2 - 1, e2 + g2 - 1, m1, m2, last, base)
                for e1, g1, e2, g2, m1, m2, last in zip(pdf["e1"], pdf["g1"], pdf["e2"], pdf["g2"], pdf["m1"], pdf["m2"], pdf["last"], strict=True)
            ]
            yield pdf.loc[keep, ["item_id"]].assign(defect="truncated_answer")

    cols = judged.select("item_id", "e1", "g1", "e2", "g2", "m1", "m2", "last")
    return sure.unionByName(cols.mapInPandas(judge, "item_id string, defect string")).groupBy("item_id").agg(F.min("defect").alias("defect"))
