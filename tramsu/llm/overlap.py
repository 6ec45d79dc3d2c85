"""T-occurrence search: records whose words overlap enough, by DivideSkip within groups that share rare words."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramsu.functions.text import fold_words_of
from tramsu.session import spread

#: Cells of the table of word counts. It is all that is broadcast: 5 bytes a cell, whatever the data's size.
CELLS = 1 << 20
#: What a word weighs, twice: one mostly written with a capital, or a number; any other. Weights
#: do not depend on how frequent a word is or how many records there are.
NAMED, PLAIN = 4, 1
#: Records expected to share a key from which the key is extended by a further word.
HOT = 1000
#: Most words of a key.
DEPTH = 8
#: Records that one group may compare with each other; a key that may have more is split into blocks of these.
BLOCK = 4000
#: With sampling, pairs of words kept of a longer text, about; and how much shorter than another a near copy may be.
SAMPLE, SHORTER = 28, 0.7
#: Lists of a group of so many records are all short: they are merged by counting, none is set aside. Longer ones go to DivideSkip.
SMALL = 1000
#: Chunks of text that a task keeps what it knows of, and pairs of records that it compares at once: they bound the memory of Python workers.
HELD, AT_ONCE = 200_000, 500_000
#: Letters of the texts that are read at once, about; and codes of pairs that are compared at once.
LETTERS, CODES_AT_ONCE = 2_000_000, 1_000_000


def _chunk(chunk: str) -> tuple[tuple[str, ...], bool | None, bool]:
    """Folded words of a blank-free chunk, whether its first letter is a capital (None: no letter), whether it ends a sentence.
    Not cached: Chunks holds it."""
    first = next((c for c in chunk if c.isalpha()), None)
    return fold_words_of.__wrapped__(chunk), None if first is None else first.isupper(), chunk[-1] in ".?!:…"


def hash_of(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _spans(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first, first + 1 and so on, so many each, one after the other."""
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + many, many)


def _distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order. np.unique hashes them first, which takes longer."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


class Chunks(dict):
    """Numbers of blank-free chunks of text, and by number what is known of them and of their words. When a slice of texts
    begins, it holds HELD at most."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.many, self.first, self.capital, self.ends = array("q"), array("q"), array("b"), array("b")
        self.words = array("q")  # numbers of the words of one chunk after the other
        self.numbers: dict[str, int] = {}
        self.hashes, self.digits = array("Q"), array("b")

    def __missing__(self, chunk: str) -> int:
        own, capital, ends = _chunk(chunk)
        self.many.append(len(own))
        self.first.append(len(self.words))
        self.capital.append(0 if capital is None else 1 + capital)
        self.ends.append(ends)
        for w in own:
            if w not in self.numbers:
                self.numbers[w] = len(self.hashes)
                self.hashes.append(hash_of(w))
                self.digits.append(w.isdigit())
            self.words.append(self.numbers[w])
        self[chunk] = len(self.many) - 1
        return self[chunk]

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all words of the texts in order: which text's, the word's number; of all chunks: which text's, the chunk's number."""
        if len(self) > HELD:
            self.forget()
        parts = [t.split() for t in texts]
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        ids = np.fromiter(map(self.__getitem__, chain.from_iterable(parts)), dtype=np.int64, count=int(sizes.sum()))
        of = np.repeat(np.arange(len(parts)), sizes)
        many = np.array(self.many, dtype=np.int64)[ids]
        return np.repeat(of, many), np.array(self.words, dtype=np.int64)[_spans(np.array(self.first, dtype=np.int64)[ids], many)], of, ids


_chunks = Chunks()


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that have LETTERS letters, or of one longer text."""
    begun = letters = 0
    for i, t in enumerate(texts):
        if i > begun and letters + len(t) > LETTERS:
            yield begun, i
            begun, letters = i, 0
        letters += len(t)
    if len(texts) > begun:
        yield begun, len(texts)


def halvings(n: int) -> list[int]:
    """How often the sample of a text of n words is halved: as for its own length, and for texts so much
    longer as may still be near copies. A pair meets in the sample of the longer one."""
    return sorted({math.floor(math.log2(max(1.0, m / SAMPLE))) for m in (n, n / SHORTER)})


def sampled(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all pairs of neighbouring words that stand in any of the samples of their text: which text's, the hash. Of each
    text, its fewest and its most halvings. A pair is in a sample that is halved k times if the 16 bits it draws are below 2^(16 - k)."""
    who, word, _, _ = _chunks.read(texts)
    h = np.array(_chunks.hashes, dtype=np.uint64)[word]
    sizes = np.bincount(who, minlength=len(texts))
    lengths, at = np.unique(sizes, return_inverse=True)
    classes = np.array([(k[0], k[-1]) for k in map(halvings, lengths.tolist())], dtype=np.int64).reshape(-1, 2)[at]
    inside, lone = who[1:] == who[:-1], sizes[who] == 1
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (h[1:] >> np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)
    own, pairs = np.concatenate([who[:-1][inside], who[lone]]), np.concatenate([pairs[inside], h[lone]])
    drawn = _draw(pairs) < 0x10000 >> classes[own, 0]
    return own[drawn], pairs[drawn], classes[:, 0], classes[:, 1]


def _draw(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.int64)


def _pair_cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the cells of each text's pairs: which text's, the cell, two columns that do not matter here."""
    own, pairs, _, _ = sampled(texts)
    both = _distinct(own * CELLS + (pairs % np.uint64(CELLS)).astype(np.int64))
    return both // CELLS, both % CELLS, np.ones(len(both), dtype=bool), np.zeros(len(both), dtype=bool)


def _word_cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's different words: which text's, the cell, whether the text's case tells names at all, and, if so, whether the
    word has a capital within a sentence."""
    who, word, of, ids = _chunks.read(texts)
    capital, ends = np.array(_chunks.capital)[ids], np.array(_chunks.ends)[ids]
    begins = np.ones(len(ids), dtype=bool)  # of a text, or after the end of a sentence
    begins[1:] = (of[1:] != of[:-1]) | (ends[:-1] == 1)
    before = np.cumsum(capital > 0) - (capital > 0)  # chunks with letters
    inside = before > before[np.maximum.accumulate(np.where(begins, np.arange(len(ids)), 0))]
    upper, lower = (np.bincount(of[capital == k], minlength=len(texts)) for k in (2, 1))
    tells = (upper > 0) & (upper <= 4 * np.maximum(lower, 1))
    name = np.repeat((capital == 2) & inside, np.array(_chunks.many, dtype=np.int64)[ids])
    all_ = np.sort(who << 33 | word << 1 | name)
    last = np.ones(len(all_), dtype=bool)  # of a word's places in a text: the one with a capital, if any has
    last[:-1] = all_[1:] >> 1 != all_[:-1] >> 1
    all_ = all_[last]
    who = all_ >> 33
    cells = (np.array(_chunks.hashes, dtype=np.uint64) % np.uint64(CELLS)).astype(np.int64)[all_ >> 1 & 0xFFFFFFFF]
    return who, cells, tells[who], tells[who] & (all_ & 1 == 1)


def _count(sample: bool):
    def run(batches):
        total, sides = np.zeros((3, CELLS), dtype=np.int64), np.zeros(CELLS, dtype=np.int32)
        for pdf in batches:
            texts, side = pdf["text"].tolist(), pdf["side"].to_numpy()
            for a, b in slices(texts):
                who, cell, told, named = (_pair_cells if sample else _word_cells)(texts[a:b])
                for k, which in enumerate((cell, cell[told], cell[named])):
                    total[k] += np.bincount(which, minlength=CELLS)
                for k in (1, 2):
                    sides[cell[side[a:b][who] & k > 0]] |= k
        some = np.flatnonzero(total[0])
        for i in range(0, len(some), 100_000):
            part = some[i : i + 100_000]
            yield pd.DataFrame({"cell": part.astype(np.int32), **{c: total[k, part] for k, c in enumerate(("n", "told", "named"))}, "sides": sides[part]})

    return run


def word_counts(records: DataFrame, sample: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """records: text, side (1 left, 2 right, 3 both). By cell, over all records: how many hold the word (with sample: the pair of
    words), one if none stands left or none right, as no pair of records has it in common then; and whether it is named, which is written with a
    capital within sentences in at least half of the texts whose case tells (or in none of those).
    Words that share a cell share both; that costs time and may move a weight, it loses no word."""
    cells = records.select("text", "side").mapInPandas(_count(sample), "cell int, n long, told long, named long, sides int")
    got = cells.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "told", "named")], F.bit_or("sides").alias("sides")).toPandas()  # at most CELLS rows
    at = got["cell"].to_numpy(dtype=np.int64)
    counts, named = np.zeros(CELLS, dtype=np.int32), np.ones(CELLS, dtype=np.bool_)
    counts[at] = np.where(got["sides"].to_numpy() == 3, np.minimum(got["n"].to_numpy(dtype=np.int64), 2**31 - 1), 1)
    named[at] = 2 * got["named"].to_numpy() >= got["told"].to_numpy()
    return counts, named


class Signs:
    """What records are found by: their words in the one order, those first that no other record has, then named and rare ones,
    and keys of one word or more."""

    def __init__(self, counts: np.ndarray, named: np.ndarray, n: int, share: float, sample: bool, hot: int | None = None):
        self.counts, self.named, self.n, self.share, self.sample, self.hot = counts, named, max(n, 1), share, sample, hot or HOT

    def _ordered(self, texts: list[str]):
        """Of all words (with sample: pairs of words) in order: row, hash, place, count, whether it is heavy. A text has row 2 i, and 2 i + 1 for its
        sample that is halved once more; the halvings of rows. place is 64 bits that order words."""
        if self.sample:
            own, pairs, few, many = sampled(texts)
            again = (many > few)[own] & (_draw(pairs) < 0x10000 >> many[own])
            hashes, item = np.unique(pairs, return_inverse=True)
            row, item = np.concatenate([2 * own, 2 * own[again] + 1]), np.concatenate([item, item[again]])
            classes = np.stack([few, many], axis=1).ravel()
            digits = np.zeros(len(hashes), dtype=bool)
        else:
            who, word, _, _ = _chunks.read(texts)
            held = np.zeros(len(_chunks.hashes), dtype=np.int64)
            held[word] = 1
            kinds = np.flatnonzero(held)
            held[kinds] = np.arange(len(kinds))
            hashes, digits = np.array(_chunks.hashes, dtype=np.uint64)[kinds], np.array(_chunks.digits)[kinds] == 1
            row, item, classes = 2 * who, held[word], np.zeros(2 * len(texts), dtype=np.int64)
        cell = (hashes % np.uint64(CELLS)).astype(np.int64)
        count = np.maximum(self.counts[cell], 1).astype(np.int64)
        heavy = np.zeros(len(cell), dtype=bool) if self.sample else digits | self.named[cell]
        place = np.where(heavy | (count == 1), np.uint64(0), np.uint64(1 << 63)) | count.astype(np.uint64) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)
        by = np.lexsort((hashes, place))
        rank = np.empty(len(by), dtype=np.int64)
        rank[by] = np.arange(len(by))
        both = _distinct(row << 32 | rank[item])
        at = by[both & 0xFFFFFFFF]
        return both >> 32, hashes[at], place[at], count[at], heavy[at], classes

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows: which text's; the codes of its words, in the one order: how many, all codes, 16 bits of which the first tells the weight;
        its keys: which row's, the key, the most records that may share it.

        Keys are made of all the beginnings that the common words of a pair may have, in order: words before and between them may be
        missing as long as these weigh no more than slack."""
        row, hashes, place, count, heavy, classes = self._ordered(texts)
        codes = (hashes >> np.uint64(48) & np.uint64(0x7FFF)).astype(np.uint16) | np.where(heavy, 0x8000, 0).astype(np.uint16)
        weight = np.where(heavy, NAMED, PLAIN)
        before = np.concatenate([[0], np.cumsum(weight)])  # the weight of all words before
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, dtype=np.int64)
        ends = np.append(first[1:], len(row))[: len(first)]
        row = row[first]
        total = before[ends] - before[first]
        slack = total - np.ceil(self.share * total - 1e-9).astype(np.int64)
        need = total - slack
        r, start, common = np.arange(len(first)), first, np.zeros(len(first), dtype=np.int64)
        key, expected, most = (classes[row] + 1).astype(np.uint64), np.full(len(first), 2.0 * self.n), np.full(len(first), self.n, dtype=np.int64)
        out = []
        for depth in range(1, DEPTH + 1):
            if not len(r):
                break
            upto = np.minimum(np.searchsorted(before, before[start] + slack, side="right"), ends[r])
            many = np.maximum(upto - start, 0)
            f, i = np.repeat(np.arange(len(r)), many), _spans(start, many)
            shared = count[i] > 1  # else no other record has it
            f, i = f[shared], i[shared]
            k = (key[f] * np.uint64(0x9E3779B97F4A7C15) ^ place[i]) * np.uint64(0xC2B2AE3D27D4EB4F)
            k ^= k >> np.uint64(29)
            e = np.minimum(count[i], expected[f] / 2)  # words that come together do so more often than by chance
            most, common = np.minimum(most[f], count[i]), common[f] + weight[i]
            grows = (e > self.hot) if depth < DEPTH else np.zeros(len(e), dtype=bool)
            done = ~grows | (common >= need[r[f]])
            out.append((r[f][done], k[done].view(np.int64), most[done]))
            slack = (slack[f] - (before[i] - before[start[f]]))[grows]
            r, start, key, expected, most, common = r[f][grows], i[grows] + 1, k[grows], e[grows], most[grows], common[grows]
        whose, keys, most = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, dtype=np.int64),) * 3
        by = np.argsort(whose, kind="stable")
        return row // 2, ends - first, codes, whose[by], keys[by], most[by]

    def rows(self, words: list[str]) -> Iterator[tuple[list[tuple[int, int]], bytes]]:
        """(keys, each with the most records that may share it; codes of the words in order) of one text."""
        _, sizes, codes, whose, keys, most = self.of([" ".join(words)])
        for k, part in enumerate(np.split(codes, np.cumsum(sizes)[:-1])):
            yield list(zip(keys[whose == k].tolist(), most[whose == k].tolist(), strict=True)), part.tobytes()


SIGNED = "rid long, side int, codes binary, keys array<long>"


def _in_blocks(rid: np.ndarray, keys: np.ndarray, most: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """How many groups each key of a record makes (blocks against blocks), and the groups."""
    blocks = -(-most // block)
    b = _spans(np.zeros(len(blocks), dtype=np.int64), blocks)
    of = np.repeat(blocks, blocks)
    own = np.repeat(rid % blocks, blocks)
    cell = (np.minimum(own, b) * of + np.maximum(own, b)).astype(np.uint64)
    return blocks, np.repeat(keys, blocks) ^ (cell * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _signed(held, n: int, share: float, sample: bool, hot: int, block: int):
    def run(batches):
        signs = Signs(*held.value, n, share, sample, hot)
        for batch in batches:
            rid, side, text = (batch.column(c) for c in ("rid", "side", "text"))
            rid, side, texts = rid.to_numpy(), side.to_numpy(), text.to_pylist()
            for a, b in slices(texts):
                which, sizes, codes, whose, keys, most = signs.of(texts[a:b])
                own = rid[a:b][which]
                blocks, keys = _in_blocks(own[whose], keys, most, block)
                many = np.bincount(whose, weights=blocks, minlength=len(which)).astype(np.int64)
                ends = [np.concatenate([[0], np.cumsum(k)]).astype(np.int32) for k in (2 * sizes, many)]
                binary = pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(ends[0]), pa.py_buffer(codes)])
                lists = pa.ListArray.from_arrays(pa.array(ends[1]), pa.array(keys))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(side[a:b][which]), binary, lists], ["rid", "side", "codes", "keys"])

    return run


def divide_skip(lists: list[np.ndarray], weights: np.ndarray, need: float) -> np.ndarray:
    """Ids that occur in lists with a total weight of at least need. lists are sorted ids, their
    weights positive. The longest lists whose weights together stay below need are set aside; the
    short ones are merged, and only ids that could still reach need are looked up, by binary search,
    in the long ones."""
    by = sorted(range(len(lists)), key=lambda i: -len(lists[i]))
    aside, spare = [], 0.0
    for i in by:
        if spare + weights[i] >= need:
            break
        aside.append(i)
        spare += float(weights[i])
    short = by[len(aside) :]
    if not short:
        return np.empty(0, dtype=np.int64)
    ids = np.concatenate([lists[i] for i in short])
    part = np.concatenate([np.full(len(lists[i]), weights[i]) for i in short])
    ids, at = np.unique(ids, return_inverse=True)
    got = np.bincount(at, weights=part, minlength=len(ids))
    alive = got >= need - spare - 1e-9
    ids, got = ids[alive], got[alive]
    for i in aside:  # the longest last, when fewest are left
        if not len(ids):
            break
        held = lists[i]
        pos = np.minimum(np.searchsorted(held, ids), len(held) - 1)
        got = got + np.where(held[pos] == ids, weights[i], 0.0)
        spare -= float(weights[i])
        alive = got >= need - spare - 1e-9
        ids, got = ids[alive], got[alive]
    return ids[got >= need - 1e-9]


def _bits(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of records, one after the other. A map of 256 bits for the named words and one of 192 for the others of each record; the
    weight of each; by how much the weight of common words may be more than their common bits say, as two words can share a bit."""
    flat = flat.astype(np.int64)
    who = np.repeat(np.arange(len(sizes)), sizes)
    heavy = flat >= 0x8000
    at = np.where(heavy, flat % 256, 256 + flat % 192)
    held = np.zeros((len(sizes), 448), dtype=np.uint8)
    held[who, at] = 1
    packed = np.packbits(held, axis=1).view(np.uint64)
    weight = np.bincount(who, weights=np.where(heavy, NAMED, PLAIN), minlength=len(sizes))
    shown = np.bitwise_count(packed).astype(np.int64) @ np.array([NAMED] * 4 + [PLAIN] * 3)
    return packed, weight, weight - shown


def _common(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The weight of the common codes of records i and j, pair by pair."""
    out = np.zeros(len(i), dtype=np.int64)
    ends = np.cumsum(sizes[i] + sizes[j])
    at = 0
    while at < len(i):  # so many codes at a time, and pairs whose number has 16 bits
        to = max(at + 1, min(at + 0x10000, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CODES_AT_ONCE, side="right"))))
        both = []
        for k in (i[at:to], j[at:to]):
            pair = np.repeat(np.arange(to - at, dtype=np.uint32), sizes[k])
            both.append(pair << np.uint32(16) | flat[_spans(first[k], sizes[k])])
        codes = np.sort(np.concatenate(both))
        codes = codes[1:][codes[1:] == codes[:-1]]
        out[at:to] = np.bincount(codes >> np.uint32(16), weights=np.where(codes & np.uint32(0x8000), NAMED, PLAIN), minlength=to - at)
        at = to
    return out


def _merged(bounds: np.ndarray, flat: np.ndarray, sizes: np.ndarray, side: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of records of small groups, one left and the other right, that reach the overlap. Records of a group are ordered by side.
    Every list is short and none is set aside: bits of the words are counted, and words themselves where the bits can reach it."""
    packed, totals, spare = _bits(flat, sizes)
    maps = np.ascontiguousarray(packed.T)
    named = [k for k in range(4) if maps[k].any()]
    plain = totals - NAMED * np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=flat >= 0x8000, minlength=len(sizes))
    starts = np.cumsum(sizes) - sizes
    many = np.diff(bounds)
    group = np.repeat(np.arange(len(many)), many)
    row = np.arange(len(group))
    # left records meet those not left alone, right ones those that stand on both sides, these all that come later
    others = [bounds[:-1] + np.bincount(group[side <= k], minlength=len(many)) for k in (1, 2)]
    begin = np.where(side == 1, others[0][group], np.where(side == 2, others[1][group], row + 1))
    later = bounds[1:][group] - begin
    xs, ys = [], []
    ends = np.cumsum(later)
    at = 0
    while at < len(row):  # so many pairs at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")))
        i, j = np.repeat(row[at:to], later[at:to]), _spans(begin[at:to], later[at:to])
        at = to
        need = share * np.maximum(totals[i], totals[j]) - 1e-9
        fits = np.minimum(totals[i], totals[j]) >= need
        i, j, need = i[fits], j[fits], need[fits]
        got = np.minimum(spare[i], spare[j])
        for k in named:
            got += NAMED * np.bitwise_count(maps[k][i] & maps[k][j]).astype(np.float64)
        if named:
            fits = got + np.minimum(plain[i], plain[j]) >= need
            i, j, need, got = i[fits], j[fits], need[fits], got[fits]
        for k in range(4, len(maps)):
            got += PLAIN * np.bitwise_count(maps[k][i] & maps[k][j]).astype(np.float64)
        fits = got >= need
        i, j, need = i[fits], j[fits], need[fits]
        fits = _common(flat, starts, sizes, i, j) >= need
        xs.append(i[fits])
        ys.append(j[fits])
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.empty(0, dtype=np.int64),) * 2


def _divided(codes: list[np.ndarray], side: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for a large group: inverted lists of the records that stand left, records that stand right are the queries."""
    totals = np.fromiter((np.where(c >= 0x8000, NAMED, PLAIN).sum() for c in codes), dtype=np.int64, count=len(codes))
    known = np.flatnonzero(side & 1)
    flat = np.concatenate([codes[i] for i in known])
    who = np.repeat(known, [len(codes[i]) for i in known])
    by = np.argsort(flat, kind="stable")
    flat, who = flat[by], who[by]
    kinds, first = np.unique(flat, return_index=True)
    bounds = np.append(first, len(flat))
    xs, ys = [], []
    for q in np.flatnonzero(side & 2).tolist():
        own = np.unique(codes[q])
        at = np.searchsorted(kinds, own)
        fits = at < len(kinds)
        at = at[fits][kinds[at[fits]] == own[fits]]
        lists = [who[bounds[k] : bounds[k + 1]] for k in at.tolist()]
        if not lists:
            continue
        weights = np.where(kinds[at] >= 0x8000, NAMED, PLAIN)
        r = divide_skip(lists, weights, share * totals[q])
        r = r[(r != q) & (totals[q] >= share * totals[r] - 1e-9)]
        xs.append(r)
        ys.append(np.full(len(r), q))
    if not xs:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(xs), np.concatenate(ys)


def _search(share: float, most: int):
    def done(batch, bounds):
        """Rows of whole groups, from bounds to bounds."""
        rid, side = batch.column("rid").to_numpy(), batch.column("side").to_numpy()
        codes = batch.column("codes")
        ends = np.frombuffer(codes.buffers()[1], dtype=np.int32)[codes.offset : codes.offset + len(codes) + 1].astype(np.int64) // 2
        held = codes.buffers()[2]
        flat = np.frombuffer(held, dtype=np.uint16, count=held.size // 2) if held is not None else np.empty(0, dtype=np.uint16)
        lengths = np.diff(ends)
        every = np.bitwise_or.reduceat(side, bounds[:-1])
        sizes = np.diff(bounds)
        found = []
        small = np.flatnonzero((sizes > 1) & (sizes <= most) & (every == 3))
        if len(small):
            group, rows = np.repeat(np.arange(len(small)), sizes[small]), _spans(bounds[small], sizes[small])
            rows = rows[np.lexsort((side[rows], group))]
            own = np.concatenate([[0], np.cumsum(sizes[small])])
            i, j = _merged(own, flat[_spans(ends[rows], lengths[rows])], lengths[rows], side[rows], share)
            found.append((rows[i], rows[j]))
        for k in np.flatnonzero((sizes > most) & (every == 3)).tolist():
            a, b = int(bounds[k]), int(bounds[k + 1])
            own = [flat[ends[r] : ends[r + 1]] for r in range(a, b)]
            i, j = _divided(own, side[a:b], share)
            found.append((a + i, a + j))
        for i, j in found:
            ok = ((side[i] & 1) & (side[j] >> 1) | (side[j] & 1) & (side[i] >> 1)).astype(bool) & (rid[i] != rid[j])
            x, y = rid[i[ok]], rid[j[ok]]
            if len(x):
                pairs = pd.DataFrame({"x": np.minimum(x, y), "y": np.maximum(x, y)}).drop_duplicates()
                yield pa.RecordBatch.from_arrays([pa.array(pairs["x"].to_numpy()), pa.array(pairs["y"].to_numpy())], ["x", "y"])

    def run(batches):
        rest = None
        for batch in batches:
            if rest is not None and rest.num_rows:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            key = batch.column("key").to_numpy()
            new = np.flatnonzero(key[1:] != key[:-1]) + 1
            upto = int(new[-1]) if len(new) else 0
            if upto:
                yield from done(batch.slice(0, upto), np.concatenate([[0], new]).astype(np.int64))
            rest = batch.slice(upto)
        if rest is not None and rest.num_rows:
            yield from done(rest, np.array([0, rest.num_rows]))

    return run


def sharing(records: DataFrame, share: float, sample: bool = False, hot: int | None = None) -> DataFrame:
    """records: rid (long, unique), text, left, right (booleans). Returns x < y: each unordered pair
    of records, one left and the other right, of which the common words weigh at least share of the heavier one's words.

    Weights are of two kinds: words that the whole table mostly writes with a capital, and numbers, count
    four times what other words do (what is said of whom makes a text, not the turn of phrase). They do not change with frequency
    or with the number of records: what a pair must have in common depends on the two texts alone.

    Words are ordered, named and rare ones first. The first common word of such a pair stands, in
    either text, where the words before it weigh no more than may be missing: these words are keys, and records
    meet by key (prefix filter). A key that many records share is extended by the next common word, for which
    what may still be missing leaves fewer places, and so on up to DEPTH words (from hot records on, HOT if not given: a matter of cost); no pair is lost by
    that. Within a group inverted lists are searched by DivideSkip for those that reach the overlap. A key of more than
    BLOCK records makes several groups (blocks against blocks). Codes of 16 bits stand for words
    within groups; two words with one code can only add candidates.

    With sample, pairs of neighbouring words stand for words, all of one weight, and of a text of more than SAMPLE words a
    share, a half, a quarter and so on, that hashing draws, the same pairs in all texts; a text near the
    bound of two shares is sought by both.
    """
    side = (F.col("left").cast("int") + 2 * F.col("right").cast("int")).alias("side")
    records = spread(records).select("rid", "text", side)
    n = records.count()
    held = records.sparkSession.sparkContext.broadcast(word_counts(records, sample))
    signed = records.mapInArrow(_signed(held, n, share, sample, hot or HOT, BLOCK), SIGNED)
    rows = signed.select(F.explode("keys").alias("key"), "rid", "side", "codes")
    near = rows.repartition("key").sortWithinPartitions("key")
    return near.mapInArrow(_search(share, SMALL), "x long, y long").distinct()
