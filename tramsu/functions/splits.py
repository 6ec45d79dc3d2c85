"""Split names as people write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: other wordings of the three splits.
WORDINGS = {
    "train": ("train", "training", "tr", "trn", "huan luyen"),
    "dev": ("dev", "development", "val", "valid", "validation"),
    "test": ("test", "testing", "tst", "eval", "evaluation", "held out"),
}


def split_name(c: Column) -> Column:
    """train, dev or test without regard to case, blanks and wording; null for null and blank,
    the bare name in lower case for any other."""
    bare = F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"(?U)[\s _-]+", " "))), r"^ | $", "")
    out = F.when(bare == "", F.lit(None).cast("string"))
    for name, words in WORDINGS.items():
        out = out.when(bare.isin(*words), F.lit(name))
    return out.otherwise(bare)
