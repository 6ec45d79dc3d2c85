"""Text normal forms that Spark has no builtin for (Unicode NFC, accent folding), as Arrow UDFs,
and JVM-side helpers around them. Nulls stay null everywhere."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARKS = re.compile("[̀-ͯ]+")
#: Fixed: format characters that no reader sees (zero-width blanks and joiners, soft hyphen, BOM, directions).
INVISIBLE = "­​‌‍‎‏⁠﻿"
_INVISIBLE = re.compile(f"[{INVISIBLE}]")


def fold_text(s: str) -> str:
    """Lower case without accents or invisible characters; d for the barred d."""
    s = _INVISIBLE.sub("", s).lower()
    if s.isascii():
        return s
    return _MARKS.sub("", unicodedata.normalize("NFKD", s)).replace("đ", "d")


_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=200_000)
def fold_words_of(chunk: str) -> tuple[str, ...]:
    """The folded words of one blank-free chunk; cached, as chunks recur."""
    return tuple(_WORD.findall(fold_text(chunk)))


def fold_words(s: str | None) -> list[str]:
    """Folded words (letters and digits) of a whole text, in order."""
    out: list[str] = []
    for chunk in (s or "").split():
        out.extend(fold_words_of(chunk))
    return out


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def fold(s: pd.Series) -> pd.Series:
    """Folded words joined by one blank: case, accents, punctuation and blanks ignored."""
    return s.map(lambda x: " ".join(fold_words(x)), na_action="ignore")


def squeeze(c: Column) -> Column:
    """Runs of any Unicode blank become one space; the ends are trimmed."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)[\s ​﻿]+", " "), r"^ | $", "")


def same_title(c: Column) -> Column:
    """A title without regard to case, Unicode form and blanks."""
    return F.lower(squeeze(nfc(c)))
