"""Cutting oversized texts into overlapping pieces at natural boundaries, range by range."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1500, 150
#: Characters (bytes, for files) of a range, and of the halo that its neighbours lend it.
RANGE, HALO = 65_536, 96

#: Kinds of boundaries, weakest first; a cut takes the strongest kind in reach.
KINDS = ("hard", "blank", "clause", "sentence", "line", "paragraph")
#: Fixed: abbreviations whose full stop ends no sentence (Vietnamese, English, French).
ABBREVIATIONS = "ts gs pgs ths tr tp v.v vv st mr mrs ms dr prof no vol pp p fig art etc av bd m mme mlle".split()
_STOP = re.compile(r"(?<![.!?…])[.!?…]+[\"'”’»)\]]*\s+(?=[\"'“‘«(\[\-–—]*[\w])")
_WORD = re.compile(r"[^\s.!?…]*\Z")  # before a stop; longer ones than WORD are no abbreviations
WORD = 12
_CLAUSE = re.compile(r"[,;:–—]\s+")
_BLANK = re.compile(r"(?<!\s)\s+(?=\S)")
#: What hard cuts do not part from the letter before: combining marks, joiners and variation selectors.
_JOINED = re.compile("[\u0300-\u036f\u0591-\u05c7\u0610-\u061a\u064b-\u065f\u093a-\u094f\u0e31\u0e34-\u0e3a\u1ab0-\u1aff\u1dc0-\u1dff\u200d\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f\U0001f3fb-\U0001f3ff]")


def boundaries(text: str) -> dict[int, int]:
    """Offsets in text at which a piece may end (the next one starts there), with their kind. Linear in the text:
    runs of blanks and stops are entered at their front only, and the word before a stop is looked up behind it."""
    found: dict[int, int] = {}
    for m in _BLANK.finditer(text):
        breaks = m.group().count("\n") + m.group().count("\r") - m.group().count("\r\n")
        found[m.end()] = 5 if breaks > 1 else 4 if breaks else 1
    for m in _CLAUSE.finditer(text):
        if found.get(m.end()) == 1:
            found[m.end()] = 2
    for m in _STOP.finditer(text):
        if found.get(m.end(), 9) < 3:
            word = _WORD.search(text, max(0, m.start() - WORD), m.start()).group().lower().lstrip("\"'“‘«([")
            short = len(word) == 1 and word.isalpha() or word in ABBREVIATIONS
            if not (short and "." in m.group()):
                found[m.end()] = 3
    return found


def _detect(batches):
    for pdf in batches:
        at, kind = [], []
        for before, core, after in zip(pdf["before"], pdf["core"], pdf["after"], strict=True):
            low, high = len(before), len(before) + len(core)
            text = before + core + after
            own = {m.start() - low: -1 for m in _JOINED.finditer(text, low + 1, high + 1)}
            own |= {o - low: k for o, k in boundaries(text).items() if low < o <= high}
            at.append(sorted(own))
            kind.append([own[o] for o in at[-1]])
        yield pdf[["id", "range_no", "from_char", "n_chars"]].assign(at=at, kind=kind)


def _plan(limit: int, overlap: int):
    """Folds the stitched boundary tables of each id, ranges in order, into pieces. Holds the
    boundaries of one piece's reach, however long the text is."""

    def cut(start: int, bounds: list[tuple[int, int]]) -> tuple[int, int]:
        end = start + limit
        for low in (start + max(limit // 2, overlap), start + overlap):
            reach = [(k, o) for o, k in bounds if low < o <= end and k > 0]
            if reach:
                k, o = max(reach)
                return o, k
        parted = {o for o, k in bounds if k < 0}
        whole = end
        while whole in parted and whole > start + overlap + 1:
            whole -= 1
        return end if whole in parted else whole, 0

    def run(batches):
        now, start, upto, no, bounds, rows = None, 0, 0, 1, [], []

        def close():
            nonlocal start, no, bounds
            while upto - start > limit:
                step()
            if now is not None:
                rows.append((now, no, start, upto, "end"))

        def step():
            nonlocal start, no, bounds
            end, kind = cut(start, bounds)
            rows.append((now, no, start, end, KINDS[kind]))
            start, no = end - overlap, no + 1
            bounds = [b for b in bounds if b[0] > start]

        for pdf in batches:
            for id_, from_char, n, at, kinds in zip(pdf["id"], pdf["from_char"], pdf["n_chars"], pdf["at"], pdf["kind"], strict=True):
                if id_ != now:
                    close()
                    now, start, upto, no, bounds = id_, 0, 0, 1, []
                bounds.extend((from_char + int(o), int(k)) for o, k in zip(at, kinds, strict=True))
                upto = from_char + n
                while upto - start > 2 * limit:
                    step()
            if rows:
                yield pd.DataFrame(rows, columns=["id", "piece_no", "start", "end", "cut"])
                rows = []
        close()
        if rows:
            yield pd.DataFrame(rows, columns=["id", "piece_no", "start", "end", "cut"])

    return run


def ranges_of_texts(texts: DataFrame) -> DataFrame:
    """id and text to id, range_no, from_char, n_chars, before, core, after: the ranges of every text with their halos."""
    n = F.length("text")

    def one(no):
        first = (no * RANGE).cast("int")
        core = F.col("text").substr(first + 1, F.lit(RANGE))
        return F.struct(
            no.alias("range_no"), first.cast("long").alias("from_char"), F.length(core).cast("long").alias("n_chars"),
            F.col("text").substr(F.greatest(first - HALO, F.lit(0)) + 1, F.least(first, F.lit(HALO))).alias("before"),
            core.alias("core"), F.col("text").substr(first + RANGE + 1, F.lit(HALO)).alias("after"),
        )

    numbers = F.sequence(F.lit(0), F.floor((n - 1) / RANGE).cast("int"))
    return texts.where(n > 0).select("id", F.inline(F.transform(numbers, one)))


def _read_ranges(batches):
    def decode(data: bytes) -> str:
        return data.decode("utf-8", "replace")

    def head(data: bytes) -> int:
        """Bytes at the front that belong to a character that began before."""
        k = 0
        while k < min(3, len(data)) and data[k] >> 6 == 2:
            k += 1
        return k

    for pdf in batches:
        rows = []
        for path, no, size in zip(pdf["path"], pdf["range_no"], pdf["size"], strict=True):
            a, b = int(no) * RANGE, min((int(no) + 1) * RANGE, int(size))
            low = max(0, a - HALO * 4)
            with open(path, "rb") as f:
                f.seek(low)
                data = f.read(b + HALO * 4 - low)
            x = a - low + (head(data[a - low :]) if a else 0)
            y = b - low + (head(data[b - low :]) if b < size else 0)
            before, core, after = data[:x], data[x:y], data[y:]
            before, after = before[head(before) :] if low else before, after
            rows.append((path, int(no), decode(before)[-HALO:], decode(core), decode(after)[:HALO]))
        out = pd.DataFrame(rows, columns=["id", "range_no", "before", "core", "after"])
        yield out.assign(n_chars=out["core"].str.len().astype("int64"))


def ranges_of_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The ranges of UTF-8 files on a file system that all workers share, by byte ranges: no worker
    reads more of a file than a range and its halo. Lengths in characters become offsets by a
    running sum over each file's ranges."""
    sizes = [(p, os.path.getsize(p)) for p in paths]
    plan = spark.createDataFrame([s for s in sizes if s[1]], "path string, size long")
    plan = plan.select("path", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / RANGE).cast("int"))).alias("range_no"))
    read = plan.repartition("path", "range_no").mapInPandas(
        _read_ranges, "id string, range_no int, before string, core string, after string, n_chars long"
    )
    before = Window.partitionBy("id").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    return read.withColumn("from_char", F.coalesce(F.sum("n_chars").over(before), F.lit(0)))


def plan_pieces(ranges: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """id, piece_no, start, end, cut of the pieces: boundaries are detected range by range, the
    tables stitched in order of the ranges, and pieces cut by offset."""
    if not 0 <= overlap < limit or limit > RANGE:
        raise ValueError("0 <= overlap < limit <= the length of a range is needed")
    kind = ranges.schema["id"].dataType.simpleString()
    cols = ranges.select("id", "range_no", "from_char", "n_chars", "before", "core", "after")
    tables = cols.mapInPandas(_detect, f"id {kind}, range_no int, from_char long, n_chars long, at array<int>, kind array<int>")
    stitched = tables.repartition("id").sortWithinPartitions("id", "range_no")
    return stitched.mapInPandas(_plan(limit, overlap), f"id {kind}, piece_no int, start long, end long, cut string")


def emit_pieces(ranges: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds the text of every planned piece, put together from the ranges it touches."""
    def cells(first, after):
        return F.explode(F.sequence(F.floor(first / RANGE), F.floor((after - 1) / RANGE))).alias("cell")

    to = F.col("from_char") + F.col("n_chars")
    spans = ranges.where("n_chars > 0").select("id", "range_no", "from_char", "n_chars", "core", cells(F.col("from_char"), to))
    marks = plan.select("id", "piece_no", "start", "end", "cut", cells(F.col("start"), F.col("end")))
    # pieces and ranges meet in cells of RANGE characters, by equality; those that share two cells in the first of these
    parts = marks.join(spans, ["id", "cell"]).where(f"start < from_char + n_chars and end > from_char and cell = floor(greatest(start, from_char) / {RANGE})")
    low = F.greatest(F.col("start") - F.col("from_char"), F.lit(0)).cast("int")
    high = F.least(F.col("end") - F.col("from_char"), F.col("n_chars")).cast("int")
    slices = parts.select("id", "piece_no", "start", "end", "cut", "range_no", F.col("core").substr(low + 1, high - low).alias("part"))
    return (
        slices.groupBy("id", "piece_no", "start", "end", "cut")
        .agg(F.sort_array(F.collect_list(F.struct("range_no", "part"))).alias("parts"))
        .select("id", "piece_no", "start", "end", "cut", F.array_join("parts.part", "").alias("piece"))
    )


def split_texts(table: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """Returns (pieces, plan) of all texts of table.

    pieces: id, piece_no, start, end, cut, piece; plan: the same without piece, for the texts over
    the limit only. A text of at most limit code points is one piece as it is ('end'). A longer one
    is cut at the strongest natural boundary in the second half of the piece (paragraph, line,
    sentence, clause, blank), failing that in the first half, failing that at the limit ('hard');
    each piece starts exactly overlap code points before the end of the one before it.

    Null keys and null texts give nothing, an empty text one empty piece; rows delivered again with
    the same key and text count once; two texts under one key are cut each for itself and share the
    key, so their id carries a number (key#2). Further columns are ignored.
    """
    rows = table.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    long = F.length("text") > limit
    short = rows.where(~long).distinct()
    over = rows.where(long).distinct()
    again = Window.partitionBy("id").orderBy(F.length("text").desc(), F.xxhash64("text"))
    over = over.withColumn("k", F.row_number().over(again)).select(
        F.when(F.col("k") > 1, F.concat("id", F.lit("#"), "k")).otherwise(F.col("id")).alias("id"), "text"
    )
    ranges = ranges_of_texts(over)
    plan = plan_pieces(ranges, limit, overlap)
    whole = short.select("id", F.lit(1).alias("piece_no"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"), F.lit("end").alias("cut"), F.col("text").alias("piece"))
    return whole.unionByName(emit_pieces(ranges, plan)), plan
