"""Encoding of texts by a public byte-level BPE vocabulary, with a transducer that is determinised as it is used."""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramsu.session import spread

#: Fixed value of the vocabulary: the pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a .tiktoken file of ranks or the .json of the same vocabulary; ids
    of byte-level tokens are their merge ranks. Special tokens are left out, so that their strings
    in a text are ordinary text."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    special = {t["content"] for t in held["added_tokens"] if t["special"]}
    # printable stand-ins of the bytes: printable Latin-1 for itself, the others from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in plain}
    char |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return {bytes(char[c] for c in t): i for t, i in held["model"]["vocab"].items() if t not in special}


class Transducer:
    """Reads bytes, emits token ids; right for any text that the pattern lets through as one piece.

    The merges are compiled into one fact a prefix: the last token of its encoding, the only token
    that ends there and may stand after the encoding's last token at its start. A state is what is
    still open: the last emitted token and the bytes after it. A token is emitted as soon as every
    encoding that can go on from here agrees on it; as no token is longer than the vocabulary's
    longest, that happens after bounded lookahead. States and transitions are made when first met
    and kept; at `most` of them they are dropped and made again, which costs time and nothing else.
    """

    def __init__(self, ranks: dict[bytes, int], most: int = 400_000):
        self.ranks, self.most = ranks, most
        self.bytes = {i: b for b, i in ranks.items()}
        self.starts = {t[:k] for t in ranks for k in range(1, len(t) + 1)}
        self.fits: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.state: list[tuple[int, bytes, tuple[int, ...]]] = [(-1, b"", ())]  # last emitted, open bytes, last token at each
        self.number: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self.step: dict[int, tuple[int, tuple[int, ...]]] = {}  # state * 256 + byte to state and emitted
        self.end: dict[int, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The merges as defined: the lowest rank first, leftmost among equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        if (a, b) not in self.fits:
            if len(self.fits) > 4 * self.most:
                self.fits.clear()
            self.fits[a, b] = self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return self.fits[a, b]

    def _chain(self, last: tuple[int, ...], upto: int) -> list[int]:
        """Positions at which the tokens of the encoding of the first upto open bytes end, descending."""
        out = []
        while upto > 0:
            out.append(upto)
            upto -= len(self.bytes[last[upto - 1]])
        return out

    def _next(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, open_, last = self.state[state]
        open_ += bytes((byte,))
        n = len(open_)
        for at in range(n):  # the longest token first
            token = self.ranks.get(open_[at:])
            if token is None:
                continue
            left = last[at - 1] if at else before
            if self.merge_ok(token) and (left < 0 or self.may_follow(left, token)):
                last += (token,)
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        # every later token starts where some vocabulary token may still be open, or here
        live = [n] + [at for at in range(n) if open_[at:] in self.starts]
        common = None
        for at in live:
            ends = set(self._chain(last, at)) if at else set()
            common = ends if common is None else common & ends
        emitted: tuple[int, ...] = ()
        if common:
            cut = max(common)
            emitted = tuple(last[e - 1] for e in reversed(self._chain(last, cut)))
            before, open_, last = emitted[-1], open_[cut:], last[cut:]
        key = (before, open_)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.state)
            self.state.append((before, open_, last))
        self.step[state * 256 + byte] = to, emitted
        return to, emitted

    def merge_ok(self, token: int) -> bool:
        """Whether the token's own bytes merge to it."""
        key = (-1, token)
        if key not in self.fits:
            self.fits[key] = self.merge(self.bytes[token]) == [token]
        return self.fits[key]

    def run(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        if len(self.state) > self.most:
            self._reset()
        state, out = 0, []
        for byte in piece:
            to = self.step.get(state * 256 + byte)
            if to is None:
                to = self._next(state, byte)
            state, emitted = to
            out.extend(emitted)
        if state not in self.end:
            _, _, last = self.state[state]
            self.end[state] = tuple(last[e - 1] for e in reversed(self._chain(last, len(last))))
        out.extend(self.end[state])
        return tuple(out)

    def encode(self, text: str, split) -> list[int]:
        out: list[int] = []
        words = self.words
        for word in split(text):
            ids = words.get(word)
            if ids is None:
                ids = self.run(word.encode())
                if len(words) >= self.most:
                    words.clear()
                if len(word) <= 64:  # recurring words; a long run of one character is read anew
                    words[word] = ids
            out.extend(ids)
        return out


class Utf8:
    """Incremental UTF-8 decoding of token bytes, byte by byte: what is certain comes out at once,
    an unfinished character waits for the next token. Bytes that cannot go on become U+FFFD each."""

    def __init__(self) -> None:
        self.held, self.missing = bytearray(), 0

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            if self.missing and byte >> 6 == 2:
                self.held.append(byte)
                self.missing -= 1
                if not self.missing:
                    out.append(self.held.decode("utf-8", "replace"))
                    self.held.clear()
                continue
            out.append("�" * len(self.held))
            self.held.clear()
            self.missing = 1 if 0xC2 <= byte < 0xE0 else 2 if 0xE0 <= byte < 0xF0 else 3 if 0xF0 <= byte < 0xF5 else 0
            if self.missing:
                self.held.append(byte)
            else:
                out.append(chr(byte) if byte < 0x80 else "�")
        return "".join(out)

    def close(self) -> str:
        out, self.missing = "�" * len(self.held), 0
        self.held.clear()
        return out


_ready: dict[str, Transducer] = {}  # one a Python worker and vocabulary


def transducer(path: str) -> Transducer:
    if path not in _ready:
        _ready[path] = Transducer(load_ranks(path))
    return _ready[path]


def _encoder(path: str):
    def run(batches):
        import regex

        t, split = transducer(path), regex.compile(PATTERN).findall
        for batch in batches:
            ids, ends = [], [0]
            for text in batch.column(1).to_pylist():
                if text:
                    ids.extend(t.encode(text, split))
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.array(ids, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    return run


def _decoder(path: str):
    def run(batches):
        t = transducer(path)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                u = Utf8()
                texts.append("".join([u.feed(t.bytes[i]) for i in ids or ()]) + u.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def once(df: DataFrame, key: str) -> DataFrame:
    """df without repeated rows; where no key repeats, which one cheap pass over the keys tells, as it is."""
    repeats = df.groupBy(key).count().where("count > 1").limit(1).count()
    return df.distinct() if repeats else df


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every document's whole text, without special tokens.

    A null text and an empty text have no ids; strings of special tokens are ordinary text. Each
    text is read once where it lies: no shuffle, except that rows delivered again (same key and
    text) are made one. Further columns are ignored; an empty table gives none.
    """
    rows = once(spread(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))), "doc_id")
    return rows.mapInArrow(_encoder(vocabulary), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text of doc_id and ids; no ids give the empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(vocabulary), "doc_id long, text string")
