"""Passages of held-out items inside documents: one Aho-Corasick automaton over all items, one scan of every text."""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramsu.functions.text import fold_words, fold_words_of
from tramsu.session import spread

#: Consecutive words of an item that count as a leak (a shorter part counts whole).
RUN = 30
#: Words of a pattern; items hold every run of so many words of their parts.
SEED = 4
#: Item parts that one pattern may stand in and still begin every comparison. Patterns of more parts are phrases of the
#: domain or stems that items share: they begin one only for stretches of an item that have too few others.
PARTS = 6
#: Patterns along one diagonal from which item and text are aligned. RUN words hold RUN - SEED + 1
#: patterns, of which a changed word costs SEED; fewer are a quoted phrase or a common turn. A part
#: of few patterns needs those that one changed word leaves, one at least.
LEAST_SEEDS = 6
#: Words of items that one automaton holds, about; more items make several, each of which scans all texts.
MOST_WORDS = 2_000_000

_NUMBER = re.compile(r"^\s*Câu\s*\d+\s*[:.]\s*", re.IGNORECASE)
_OPTIONS = re.compile(r"\n\s*[A-D]\s*[.:)]\s")


def stem_of(question: str | None) -> str:
    """The stem: without the number line before and the lettered options after it."""
    return _OPTIONS.split(_NUMBER.sub("", question or ""), maxsplit=1)[0].strip()


def explanation_of(text: str | None) -> str:
    """The explanation without its last line, which names the choice."""
    lines = (text or "").strip().split("\n")
    return "\n".join(lines[:-1] if len(lines) > 1 else lines).strip()


class Scanner:
    """parts: (item id, text) of everything that must not leak."""

    def __init__(self, parts: list[tuple[str, str]], run: int = RUN):
        import ahocorasick

        self.run = run
        self.parts = [(i, w) for i, t in parts if (w := fold_words(t))]
        at: dict[str, list[tuple[int, int]]] = {}
        for p, (_, words) in enumerate(self.parts):
            n = min(SEED, len(words))
            for k in range(len(words) - n + 1):
                at.setdefault(" " + " ".join(words[k : k + n]) + " ", []).append((p, k))
        rare = {pattern for pattern, places in at.items() if len({p for p, _ in places}) <= PARTS}
        poor = {p: self._poor(words, rare) for p, (_, words) in enumerate(self.parts)}
        self.automaton = ahocorasick.Automaton()
        for pattern, places in at.items():
            self.automaton.add_word(pattern, (len(pattern), places if pattern in rare else [(p, k) for p, k in places if k in poor[p]]))
        if at:
            self.automaton.make_automaton()
        self.empty = not at

    def _poor(self, words: list[str], rare: set[str]) -> set[int]:
        """Places of patterns in the stretches of so many words as a leak needs whose rare patterns would not do once two words are changed."""
        n = min(SEED, len(words))
        told = [" " + " ".join(words[k : k + n]) + " " in rare for k in range(len(words) - n + 1)]
        wide = max(1, min(self.run, len(words)) - n + 1)
        out: set[int] = set()
        held = sum(told[:wide])
        for k in range(len(told) - wide + 1):
            if held < LEAST_SEEDS + 2 * SEED:
                out.update(range(k, k + wide))
            held += (told[k + wide] if k + wide < len(told) else 0) - told[k]
        return out

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """(item id, start, end) of leaks, by offsets in text as it stands."""
        if self.empty or not text:
            return []
        words, starts, ends = [], [], []
        for m in re.finditer(r"\S+", text):
            for w in fold_words_of(m.group()):
                words.append(w)
                starts.append(m.start())
                ends.append(m.end())
        flat = " " + " ".join(words) + " "
        begins, pos = [], 0  # of each word, the blank before it
        for w in words:
            begins.append(pos)
            pos += len(w) + 1
        hits: dict[int, list[tuple[int, int]]] = {}
        for end, (size, places) in self.automaton.iter(flat):
            for p, k in places:
                hits.setdefault(p, []).append((end - size + 1, k))
        found = []
        for p, seeds in hits.items():
            item, target = self.parts[p]
            best = self._best(target, words, [(bisect_left(begins, a), k) for a, k in seeds])
            if best:
                found.append((item, starts[best[0]], ends[best[1] - 1]))
        return found

    def _best(self, target: list[str], words: list[str], seeds: list[tuple[int, int]]) -> tuple[int, int] | None:
        """Word span of a leak of target, compared where its seeds lie along one diagonal."""
        need = min(self.run, len(target))
        least = max(1, min(LEAST_SEEDS, len(target) - 2 * SEED + 1))
        seeds.sort()
        done = -1
        for d, k in seeds:
            if d < done:
                continue
            if len(seeds) < least or sum(abs((x - y) - (d - k)) <= need for x, y in seeds) < least:
                continue
            a, b = max(0, d - k - need), min(len(words), d - k + len(target) + need)
            done = b
            blocks = SequenceMatcher(None, target, words[a:b], autojunk=False).get_matching_blocks()
            blocks = [x for x in blocks if x.size]
            span = self._dense(blocks, need)
            if span:
                return a + span[0], a + span[1]
        return None

    def _dense(self, blocks, need: int) -> tuple[int, int] | None:
        """The first stretch of matched runs, in order, that covers need words of the item with
        few of them changed and only short interruptions of the text."""
        blocks = [x for i, x in enumerate(blocks) if x.size > 1 or any(0 <= y.a - x.a - 1 <= 2 and 0 <= y.b - x.b - 1 <= 2 for y in blocks[i + 1 : i + 2]) or any(0 <= x.a - y.a - y.size <= 2 and 0 <= x.b - y.b - y.size <= 2 for y in blocks[max(0, i - 1) : i])]
        i = 0
        for j in range(len(blocks)):
            while i < j and not self._joined(blocks[j - 1], blocks[j]):
                i = j
            for s in range(i, j + 1):
                covered = blocks[j].a + blocks[j].size - blocks[s].a
                same = sum(x.size for x in blocks[s : j + 1])
                if covered >= need - 2 and same >= 0.7 * covered and same >= 0.72 * need:
                    return blocks[s].b, blocks[j].b + blocks[j].size
        return None

    @staticmethod
    def _joined(x, y) -> bool:
        """Whether two matched runs belong to one passage: at most 7 words of the item changed
        between them, at most 20 foreign words put in."""
        return y.a - x.a - x.size <= 7 and y.b - x.b - x.size <= 20


_SCANNERS: dict[str, Scanner] = {}


def _scanner(name: str, parts: list[tuple[str, str]]) -> Scanner:
    """One automaton a worker, not one a task."""
    if name not in _SCANNERS:
        while len(_SCANNERS) > 1:
            _SCANNERS.pop(next(iter(_SCANNERS)))
        _SCANNERS[name] = Scanner(parts)
    return _SCANNERS[name]


def _scan(held, name: str):
    def run(batches):
        from tramsu.llm.contamination import _scanner  # the worker's own module, which keeps it

        scanner = _scanner(name, held.value)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                rows.extend((doc, item, a, b) for item, a, b in scanner.scan(text))
            yield pd.DataFrame(rows, columns=["doc_id", "id", "start", "end"]).astype({"start": "int64", "end": "int64"})

    return run


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, id, start, end: every document that carries the stem or the explanation of an item,
    or RUN consecutive words of one, and where (code points of the text as stored).

    All runs of SEED folded words of all items make one Aho-Corasick automaton, which every
    executor gets and every text passes once; words keep their place in the text. The words of the items are counted before
    they are collected: beyond MOST_WORDS items are dealt to several automata of about that size, one after the other. Where several patterns of an item lie along one diagonal, item and
    text are aligned there: words changed, left out or put in are allowed, as long as the stretch
    is in order, covers enough and is interrupted but shortly.

    Null and empty texts carry nothing; null or empty stems and explanations are sought nowhere;
    an item without id is left out; rows delivered again count once; further columns are ignored.
    """
    rows = items.where("id is not null").select("id", "question", "explanation").distinct()
    size = F.size(F.split(F.concat_ws(" ", "question", "explanation"), r"\s+"))
    shards = max(1, -(-int(rows.agg(F.sum(size)).first()[0] or 0) // MOST_WORDS))
    texts = spread(docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = None
    for shard in range(shards):
        got = rows.where(F.pmod(F.xxhash64("id"), F.lit(shards)) == shard).toPandas()  # about MOST_WORDS words
        parts = [(r.id, t) for r in got.itertuples() for t in (stem_of(r.question), explanation_of(r.explanation)) if t]
        held = docs.sparkSession.sparkContext.broadcast(parts)
        one = texts.mapInPandas(_scan(held, uuid.uuid4().hex), "doc_id long, id string, start long, end long")
        found = one if found is None else found.unionByName(one)
    return found.groupBy("doc_id", "id").agg(F.min(F.struct("start", "end")).alias("at")).select("doc_id", "id", "at.start", "at.end")
