"""Whether two texts are the same apart from small edits."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

from tramsu.functions.text import fold_words_of

_ROMAN = re.compile(r"[IVXLC]+|i{2,3}|iv|vi{2,3}|i?x")  # as written; a lone i or vi in small letters is a word
_ENDS = ".?!:…"


@lru_cache(maxsize=200_000)
def _typed(chunk: str) -> tuple[tuple[str, ...], bool | None, bool]:
    """Folded words of a blank-free chunk (numbers with # before them), whether its first letter is a capital (None:
    no letter), whether it ends a sentence."""
    own = fold_words_of(chunk)
    letters = [c for c in chunk if c.isalpha()]
    if not letters or len(own) == 1 and _ROMAN.fullmatch("".join(letters)):
        own = tuple("#" + w for w in own)
    return own, letters[0].isupper() if letters else None, chunk[-1] in _ENDS and len(letters) != 1


@lru_cache(maxsize=3000)  # a text is compared with several
def typed_words(text: str) -> tuple[list[str], set[str], bool]:
    """The folded words (numbers with # before them), those of them that are part of names, and
    whether case tells names at all.

    A word with a capital that does not begin a sentence is a name's; numbers are left to the
    caller. A text all in capitals or all in small letters tells nothing."""
    words, names = [], set()
    begins = True
    upper = lower = 0
    for chunk in text.split():
        own, capital, ends = _typed(chunk)
        if capital is not None:
            if capital:
                upper += 1
                if not begins:
                    names.update(own)
            else:
                lower += 1
            begins = False
        if ends:
            begins = True
        words.extend(own)
    shouted = upper > 4 * max(lower, 1)
    return words, set() if shouted else names, not shouted and upper > 0


def is_number(word: str) -> bool:
    return word[0] == "#" or word.isdigit()


def near(a: str, b: str, most: int) -> bool:
    """Whether at most `most` insertions, deletions, substitutions or swaps of neighbours turn a into b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        if min(row) > most and (not before or min(before) > most):
            return False
    return row[-1] <= most


def typo_of(a: str, b: str) -> bool:
    """Whether one word is likely the other with a slip of the pen; never for numbers."""
    if is_number(a) or is_number(b):
        return False
    short = min(len(a), len(b))
    return short > 3 and near(a, b, 1 if short < 8 else 2)


def compare(a: str, b: str, least: float = 0.0) -> tuple[float, int, int, int, float]:
    """(share, names_a, names_b, numbers, core): the words found in both, typos included, as a share of
    the longer text's words; how many words of names only a (only b) has; the least of how many
    numbers either has alone; the share that both have of the words outside names of the text with
    fewer of these. Texts of which fewer than two thirds of least are the very same
    words are not looked through for typos: their share is that of the same words."""
    wa, na, knows_a = typed_words(a)
    wb, nb, knows_b = typed_words(b)
    if not wa or not wb:
        return float(wa == wb), 0, 0, 0, float(wa == wb)
    ca, cb = Counter(wa), Counter(wb)
    only_a, only_b = list((ca - cb).elements()), list((cb - ca).elements())
    same = len(wa) - len(only_a)
    left_b, left_a, slips = Counter(only_b), [], max(2, len(wa) // 6)
    if same < least * 2 / 3 * max(len(wa), len(wb)):
        return same / max(len(wa), len(wb)), 0, 0, 0, 0.0
    ends: dict[str, list[str]] = {}  # a slip spares the first two letters or the last two, or the word is short
    for y in left_b:
        for end in {y[:2], y[-2:]} if len(y) > 4 else {y[:1], y[-1:]}:
            ends.setdefault(end, []).append(y)
    for x in only_a:
        tried = {y for end in {x[:2], x[-2:], x[:1], x[-1:]} for y in ends.get(end, ())}
        for y in sorted(tried):
            if slips and left_b[y] and typo_of(x, y):
                left_b[y] -= 1
                same += 1
                slips -= 1
                break
        else:
            left_a.append(x)
    left_b = list(left_b.elements())
    names = na | nb

    def named(words, knows):
        return sum(1 for x in words if x in names and not is_number(x)) if knows else -1

    numbers = min(sum(map(is_number, left_a)), sum(map(is_number, left_b)))
    plain_a, plain_b = sum(w not in names for w in wa), sum(w not in names for w in wb)
    lost = sum(w not in names for w in left_a), sum(w not in names for w in left_b)
    core = min(plain_a - lost[0], plain_b - lost[1]) / max(1, min(plain_a, plain_b))
    return same / max(len(wa), len(wb)), named(left_a, knows_a), named(left_b, knows_b), numbers, core


def least_same(longest: int, least: float) -> int:
    """How many of the very same words two texts, the longer one of so many words, have at least if compare
    gives them a share of least: of the common words at most max(2, a sixth) are slips. Never falls as longest grows."""
    return math.ceil(max(least * 2 / 3 * longest, least * longest - max(2, longest / 6)) - 1e-9)


#: The least share of common words of one question in two wordings.
LEAST_SAME = 0.66


def same_question(a: str, b: str, least: float = LEAST_SAME, least_core: float = 0.68) -> bool:
    """The same question apart from small edits: enough common words, outside names too, and not each with a person,
    place, number or year of its own. Where the case of one text tells no names, the other's
    does: words of its names that are missing must be balanced by none."""
    share, x, y, numbers, core = compare(a, b, least)
    if share < least or core < least_core or numbers:
        return False
    if x >= 0 and y >= 0:
        return not (x and y) and max(x, y) < 3
    known = max(x, y)
    return known < 2 or share >= 0.9 and known < 3
