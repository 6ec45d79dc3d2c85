"""Statistics of every document's text, and which documents are not prose, by gradient-boosted trees."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramsu.functions.text import fold_words
from tramsu.session import cut, spread

KINDS = ("prose", "list", "table", "junk")
#: Documents that the trees are fitted on: the first of the table by a hash of the text. The
#: statistics themselves and the kinds cover all documents.
SAMPLE = 6000

#: Fixed: frequent words of Vietnamese (without accents), English and French that carry grammar.
COMMON = frozenset(
    """va cua cho voi tai tu mot nhung cac trong khi de bi duoc la co khong da dang se nay ay do thi ma o ra vao ve len xuong
    den theo boi vi nen neu tuy sau truoc cung con lam nguoi nam ngay
    the of and to in a is was were that for with on at by from it as be or an which after before not their his
    le la les des du de et un une dans pour par sur que qui est sont au aux en ne pas il elle son sa ses apres avant""".split()
)
_VOWEL = re.compile(r"[aeiouy]")
_BULLET = re.compile(r"^\s*(?:[-*•·–—+▪◦‣»>]|\(?\d{1,4}\s?[.):–-]|\(?[A-Za-zĐđ][.)]|\[.?\]|[IVXLC]{1,6}[.)])\s+\S")
_MARKER = re.compile(r"(?m)^\s*\(?\w{1,4}[.)]\s+")
_COLUMNS = re.compile(r"\S(?: {2,}|\t| ?\| ?|;|,)(?=\S)")
_RULE = re.compile(r"^[\s|+:=-]{3,}$")
_SENTENCE_END = re.compile(r"[.!?…][\"'”’»)\]]*(?=\s|$)")
_TAG = re.compile(r"<[^<>\n]{1,200}>|&[a-z]{2,8};|\{[^{}\n]*\}|https?://\S+")
#: UTF-8 read as Latin-1 or cp1252: a lead byte's character followed by a continuation byte's.
_BROKEN = re.compile("[ÂÃÄÅÆÇÈÉÐÑáâãäå][\\u0080-\\u00bf‘’“”•–—˜™š›œžŸ€‚ƒ„…†‡ˆ‰Š‹ŒŽ]|�|[\\x00-\\x08\\x0e-\\x1f]")

STATISTICS = (
    "n_chars n_words n_lines mean_word_length mean_line_words letter_ratio digit_ratio symbol_ratio blank_ratio upper_ratio "
    "lines_ending_in_punctuation common_word_share distinct_word_ratio distinct_line_ratio sentences_per_100_words words_a_sentence "
    "bullet_share column_share short_line_share lower_start_share line_length_spread markup_ratio broken_ratio "
    "vowelless_share long_word_share top_word_share ornament_share"
).split()


def statistics(text: str) -> list[float]:
    """The STATISTICS of one text with at least one visible character. Shares of lines are by
    their characters, so that a heading weighs little."""
    n = len(text)
    lines = [x for x in re.split(r"[\n\r\x0b\x0c  ]+", text) if x.strip()]
    chunks = text.split()
    words = fold_words(text)
    k = max(1, len(words))
    letters = sum(map(str.isalpha, text))
    digits = sum(map(str.isdigit, text))
    blanks = sum(map(str.isspace, text))
    weights = [len(x) for x in lines]
    total = max(1, sum(weights))

    def share(test) -> float:
        return sum(w for x, w in zip(lines, weights, strict=True) if test(x)) / total

    def ends(x: str) -> bool:
        return bool(re.search(r"[.!?…:;][\"'”’»)\]]*\s*$", x))

    columns = [len(_COLUMNS.findall(x)) for x in lines]
    usual = Counter(c for c in columns if c > 1).most_common(1)
    usual_columns = usual[0][0] if usual else -1
    in_columns = sum(w for c, w, x in zip(columns, weights, lines, strict=True) if _RULE.match(x) and len(lines) > 2 or c == usual_columns and usual[0][1] > 2 and not ends(x))
    # rows framed with bars stand in columns even if there are only two
    framed = share(lambda x: x.count("|") > 2 or bool(_RULE.match(x)) and ("|" in x or "+" in x))
    sentences = len(_SENTENCE_END.findall(_MARKER.sub("", text)))
    lengths = np.array(weights[:-1] or weights, dtype=float)
    count = Counter(words)
    plain = Counter(chunks)
    return [
        n, len(words), len(lines), sum(map(len, words)) / k, len(chunks) / max(1, len(lines)),
        letters / n, digits / n, (n - letters - digits - blanks) / n, blanks / n,
        sum(map(str.isupper, text)) / max(1, letters),
        share(ends), sum(c for w, c in count.items() if w in COMMON) / k, len(count) / k, len(set(lines)) / max(1, len(lines)),
        100 * sentences / k, k / max(1, sentences),
        share(lambda x: bool(_BULLET.match(x)) and (len(x.split()) < 25 and not x.rstrip().endswith("."))), max(framed, in_columns / total),
        share(lambda x: len(x.split()) < 16 and not ends(x)) if len(lines) > 2 else 0.0,
        share(lambda x: x.lstrip()[:1].islower()), float(lengths.std() / max(1.0, lengths.mean())),
        sum(len(m) for m in _TAG.findall(text)) / n, 2 * len(_BROKEN.findall(text)) / n,
        sum(c for w, c in count.items() if not _VOWEL.search(w) and not w.isdigit()) / k,
        sum(len(c) for c in chunks if len(c) > 30) / max(1, n - blanks), max(plain.values(), default=0) / max(1, len(chunks)),
        sum(c for w, c in plain.items() if not any(map(str.isalnum, w))) / max(1, len(chunks)),
    ]


def weak_label(s: dict[str, float]) -> str | None:
    """A kind that the statistics leave little doubt of; null otherwise."""
    if s["broken_ratio"] > 0.04 or s["markup_ratio"] > 0.3 or s["long_word_share"] > 0.5:
        return "junk"
    if s["column_share"] > 0.75 and s["n_lines"] > 3 and s["n_words"] > 5:
        return "table"
    if s["vowelless_share"] > 0.35:
        return "junk"
    if s["letter_ratio"] < 0.4 or s["n_words"] < 3:
        return "junk"
    if s["n_words"] > 60 and s["distinct_word_ratio"] < 0.12 and (s["n_lines"] < 4 or s["distinct_line_ratio"] < 0.1):
        return "junk"
    if s["ornament_share"] > 0.12 and s["sentences_per_100_words"] < 1 and s["n_lines"] < 4:
        return "junk"
    if s["n_lines"] > 4 and max(s["bullet_share"], s["short_line_share"] if s["mean_line_words"] < 8 else 0) > 0.8 and s["column_share"] < 0.3 and s["sentences_per_100_words"] < 3:
        return "list"
    if 8 < s["words_a_sentence"] < 70 and s["common_word_share"] > 0.1 and s["lines_ending_in_punctuation"] > 0.9 and s["bullet_share"] < 0.1:
        return "prose"
    if 8 < s["words_a_sentence"] < 70 and s["common_word_share"] > 0.1 and s["n_lines"] > 3 and s["line_length_spread"] < 0.2 and s["mean_line_words"] > 4 and s["distinct_word_ratio"] > 0.2 and s["bullet_share"] < 0.1 and s["column_share"] < 0.1:
        return "prose"  # broken into lines of one length
    return None


class Trees:
    """Gradient-boosted regression trees for one kind against the rest: Newton steps of the
    logistic loss on histograms of at most 32 bins, split by gain."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.25, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.ridge = rounds, depth, rate, ridge
        self.trees: list = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(p / (1 - p)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
        bins = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            tree = self._grow(bins, edges, q - y, q * (1 - q), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            f += self.rate * self._apply(tree, x)
        return self

    def _grow(self, bins, edges, g, h, rows, depth):
        G, H = g[rows].sum(), h[rows].sum()
        leaf = -G / (H + self.ridge)
        if depth == 0 or len(rows) < 10:
            return leaf
        best = (1e-6, None, None)
        for j, e in enumerate(edges):
            if not len(e):
                continue
            hg = np.cumsum(np.bincount(bins[rows, j], weights=g[rows], minlength=len(e) + 1))[:-1]
            hh = np.cumsum(np.bincount(bins[rows, j], weights=h[rows], minlength=len(e) + 1))[:-1]
            gain = hg**2 / (hh + self.ridge) + (G - hg) ** 2 / (H - hh + self.ridge) - G**2 / (H + self.ridge)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
        _, j, k = best
        if j is None:
            return leaf
        low = bins[rows, j] <= k
        return (j, float(edges[j][k]), self._grow(bins, edges, g, h, rows[low], depth - 1), self._grow(bins, edges, g, h, rows[~low], depth - 1))

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, edge, low, high = tree
        left = x[:, j] < edge
        out = np.empty(len(x))
        out[left], out[~left] = self._apply(low, x[left]), self._apply(high, x[~left])
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((self._apply(t, x) for t in self.trees), np.zeros(len(x)))


class Model:
    """One Trees a kind, each calibrated by a slope and an intercept (Platt) on the holdout."""

    def __init__(self, x: np.ndarray, y: list[str], held: tuple[np.ndarray, list[str]]):
        self.trees = {k: Trees().fit(x, np.array([v == k for v in y], dtype=float)) for k in KINDS}
        self.scale = {k: self._platt(t.score(held[0]), np.array([v == k for v in held[1]], dtype=float)) for k, t in self.trees.items()}

    @staticmethod
    def _platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        n, m = y.sum(), len(y) - y.sum()
        t = np.where(y > 0, (n + 1) / (n + 2), 1 / (m + 2))  # Platt's targets
        a, b = 1.0, 0.0
        for _ in range(100):  # Newton steps of bounded length, held near slope 1 and intercept 0
            p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
            g = np.array([((p - t) * s).sum() + (a - 1.0), (p - t).sum() + b])
            w = p * (1 - p)
            hess = np.array([[(w * s * s).sum() + 1.0, (w * s).sum()], [(w * s).sum(), w.sum() + 1.0]])
            step = np.linalg.solve(hess, g)
            a, b = np.array([a, b]) - step * min(1.0, 0.5 / max(1e-9, float(np.abs(step).max())))
        return max(float(a), 0.05), float(b)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """A row a document, a column a kind; rows sum to 1."""
        p = np.stack([1 / (1 + np.exp(-np.clip(self.scale[k][0] * self.trees[k].score(x) + self.scale[k][1], -30, 30))) for k in KINDS], axis=1)
        return p / p.sum(axis=1, keepdims=True)


def _statistics(batches):
    for pdf in batches:
        pdf = pdf[[bool(t.strip(" \t\r\n​﻿ 　")) and not t.isspace() for t in pdf["text"]]]
        rows = np.array([statistics(t) for t in pdf["text"]], dtype=float).reshape(-1, len(STATISTICS))
        yield pd.concat([pdf[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=STATISTICS)], axis=1)


SCHEMA = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS of every document with visible text. Null, empty and blank texts have
    none; further columns are ignored; an empty table gives none."""
    rows = docs.where("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(_statistics, SCHEMA)


def sample_statistics(docs: DataFrame, most: int) -> pd.DataFrame:
    """doc_id and STATISTICS of at most `most` documents: those whose id's hash stands below a threshold that the number of
    documents sets. Texts are judged where they lie; only statistics, one row an id, leave their task."""
    rows = docs.where("text is not null and text <> '' and doc_id is not null").withColumn("draw", F.xxhash64(F.lit(7), "doc_id"))
    n = docs.where("doc_id is not null").count()
    if n > most:
        rows = rows.where(F.col("draw") < int(2**64 * 1.2 * most / n) - 2**63)
    got = document_statistics(spread(rows.select("doc_id", "text"))).dropDuplicates(["doc_id"]).withColumn("draw", F.xxhash64(F.lit(7), "doc_id"))
    return got.orderBy("draw", "doc_id").limit(most).toPandas()  # statistics only, at most `most` rows


def fit(docs: DataFrame, most: int = SAMPLE) -> Model:
    """Trees on the weak labels of at most `most` documents, calibrated on the hand-checked holdout, which
    none of the trees has seen; of a kind that the sample lacks half of the checked texts join the training."""
    from tramsu.llm.holdout import CHECKED

    got = sample_statistics(docs, most)
    x = got[list(STATISTICS)].to_numpy(dtype=float).reshape(-1, len(STATISTICS))
    label = [weak_label(dict(zip(STATISTICS, row, strict=True))) for row in x]
    held = np.array([statistics(t) for _, t in CHECKED], dtype=float), [k for k, _ in CHECKED]
    keep = [i for i, v in enumerate(label) if v]
    known = {label[i] for i in keep}
    lent = [i for i, k in enumerate(held[1]) if k not in known and i % 2 == 0]
    rest = [i for i in range(len(held[1])) if i not in set(lent)]
    x = np.concatenate([x[keep], held[0][lent]])
    return Model(x, [label[i] for i in keep] + [held[1][i] for i in lent], (held[0][rest], [held[1][i] for i in rest]))


def calibration(model: Model, texts: list[tuple[str, str]]) -> dict[str, float]:
    """Accuracy, Brier score and expected calibration error (five bins of the likeliest kind's
    probability) over texts of known kind."""
    p = model.probabilities(np.array([statistics(t) for _, t in texts], dtype=float))
    truth = np.array([KINDS.index(k) for k, _ in texts])
    said, sure = p.argmax(axis=1), p.max(axis=1)
    hit = (said == truth).astype(float)
    bins = np.minimum(4, (sure * 5).astype(int))
    error = sum(abs(hit[bins == b].mean() - sure[bins == b].mean()) * (bins == b).mean() for b in range(5) if (bins == b).any())
    return {"accuracy": float(hit.mean()), "brier": float(((p - np.eye(len(KINDS))[truth]) ** 2).sum(axis=1).mean()), "error": float(error)}


def kinds(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, kind, p_prose, p_list, p_table, p_junk and the STATISTICS of every document with
    visible text; kind is the likeliest one. Documents delivered again with one id count once."""
    from tramsu.llm.tokenize import once

    rows = once(spread(docs.select("doc_id", "text")), "doc_id")
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    names = [f"p_{k}" for k in KINDS]

    def run(batches):
        for pdf in _statistics(batches):
            p = held.value.probabilities(pdf[list(STATISTICS)].to_numpy(dtype=float)) if len(pdf) else np.empty((0, 4))
            pdf["kind"] = [KINDS[i] for i in p.argmax(axis=1)]
            pdf[names] = p
            yield pdf[["doc_id", "kind", *names, *STATISTICS]]

    schema = "doc_id long, kind string, " + ", ".join(f"{n} double" for n in names) + ", " + SCHEMA.split(", ", 1)[1]
    texts = rows.where("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInPandas(run, schema)
