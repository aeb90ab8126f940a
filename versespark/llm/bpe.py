"""Byte-level BPE: encoding with a priority queue over a linked symbol list, decoding by concatenation.

A text is cut at the vocabulary's added tokens and then by the byte-level pre-tokenizer pattern. Each piece becomes a
doubly linked list of byte symbols. A heap holds the mergeable neighbours by (rank, place); an entry whose symbols have
changed since it was pushed is stale and is skipped when it comes up. Ids leave as packed little-endian unsigned
32-bit integers, the layout of token files. Decoding joins the byte strings of the ids.

Between two other characters, a piece always starts at a single space or line feed, so texts are cut there first and the
ids of frequent words are looked up. A worker keeps at most two generations of words, some 150 MB: when the young one
is full it becomes the old one, and words that are met again move back.

Defined results: a null text encodes like an empty one (no ids, decoded ""); repeated rows are encoded each; other
columns pass through unchanged, but for columns of the names of the results, which are replaced; nothing is truncated or
padded. A tokenizer file of another kind (normalizers, prefix spaces, other models) is refused.
"""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh

# The published byte-level pre-tokenizer pattern.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words and pieces of one generation of a worker's memory, and the longest that it keeps; it only saves time.
WORDS_KEPT, PIECES_KEPT, KEPT_CHARS = 400_000, 50_000, 32


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, others come after U+00FF."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Known(dict):
    """Packed ids of short strings, in two generations of bounded size."""

    def __init__(self, ids: Callable[[str], bytes], size: int):
        super().__init__()
        self.ids, self.size, self.old = ids, size, {}

    def __missing__(self, s: str) -> bytes:
        out = self.old.get(s)
        if out is None:
            out = self.ids(s)
        if len(s) <= KEPT_CHARS:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[s] = out
        return out


def check_kind(spec: dict) -> None:
    """Refuse tokenizer files that ask for more than byte-level pieces and ranked merges."""
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec.get("normalizer")
    ranked = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    whole = not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip"))
    if not (plain and ranked and whole):
        raise ValueError("not a plain byte-level BPE tokenizer file")


class Vocabulary:
    """What encoding and decoding need of a tokenizer file: ids of bytes, merge ranks, strings of ids and added tokens."""

    def __init__(self, spec: dict):
        check_kind(spec)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = [b""] * (max([*ids.values(), *self.added.values()]) + 1)
        for token, i in ids.items():
            self.strings[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            self.strings[i] = token.encode()
        self.of_byte = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.ranks: dict[int, int] = {}  # of a pair of ids, as one number
        self.made: list[int] = []  # by a rank
        size = len(self.strings)
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[ids[a] * size + ids[b]] = rank
            self.made.append(ids[a + b])
        self.of_bytes = [self.ranks.get(a * size + b, -1) for a in self.of_byte for b in self.of_byte]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = regex.compile(PIECES)
        self.blanks = regex.compile(r"(\s{2,})")
        self.pieces_known = Known(self._piece, PIECES_KEPT)
        self.words_known = Known(self._word, WORDS_KEPT)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        rank_of, made, size, n = self.ranks.get, self.made, len(self.strings), len(piece)
        ids = [self.of_byte[b] for b in piece]
        # the rank of the pair that starts at each place, -1 if it isn't mergeable or gone
        of_bytes = self.of_bytes
        ranks = [of_bytes[a << 8 | b] for a, b in zip(piece, piece[1:])]
        shift = max(12, n.bit_length())
        queue = [r << shift | i for i, r in enumerate(ranks) if r >= 0]
        if not queue:
            return ids
        ranks.append(-1)
        after, before, places = [*range(1, n), -1], [*range(-1, n - 1)], (1 << shift) - 1
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i, rank = entry & places, entry >> shift
            if ranks[i] != rank:
                continue  # stale: one of the two has been merged since
            new, j = made[rank], after[i]
            ids[i], ids[j], ranks[j] = new, -1, -1
            k, h = after[j], before[i]
            after[i] = k
            if k >= 0:
                before[k] = i
                r = ranks[i] = rank_of(new * size + ids[k], -1)
                if r >= 0:
                    heappush(queue, r << shift | i)
            else:
                ranks[i] = -1
            if h >= 0:
                r = ranks[h] = rank_of(ids[h] * size + new, -1)
                if r >= 0:
                    heappush(queue, r << shift | h)
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> bytes:
        ids = array("I", self.merge(piece.encode()))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _pieces(self, text: str) -> bytes:
        pieces = self.pieces.findall(text)
        return self._piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self.pieces_known.__getitem__, pieces))

    def _word(self, word: str) -> bytes:
        """What stands behind a cut: a line feed begins a word of its own, else the word has its space."""
        return self._pieces(word if word[:1] == "\n" else f" {word}")

    def _plain(self, text: str) -> bytes:
        """Packed ids of a text without two blanks in a row."""
        head, *words = text.replace("\n", " \n").split(" ")
        return self._pieces(head) + b"".join(map(self.words_known.__getitem__, words))

    def _part(self, text: str) -> bytes:
        """Packed ids of a text without added tokens. The last of several blanks goes with what follows them."""
        if not self.blanks.search(text):
            return self._plain(text)
        out, lead = [], ""
        parts = self.blanks.split(text)
        for k in range(0, len(parts), 2):
            out.append(self._plain(lead + parts[k]))
            if k + 1 < len(parts):
                run = parts[k + 1]
                ends = not parts[k + 2]
                out.append(self.pieces_known[run if ends else run[:-1]])
                lead = "" if ends else run[-1]
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a text."""
        if not text:
            return b""
        if not any(t in text for t in self.added):
            return self._part(text)
        parts = self.cut.split(text)
        return b"".join(np.array([self.added[p]], "<u4").tobytes() if k % 2 else self._part(p) for k, p in enumerate(parts) if p)

    def decode(self, packed: bytes | None) -> str:
        """The text of packed ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(packed or b"", "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at `path`, read once in each process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary.load(path)
    return _LOADED[path]


def coder(path: str):
    """A column function text -> struct of packed ids and the text that they decode to, in one pass."""

    @F.pandas_udf("ids binary, decoded string")
    def code(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for batch in texts:
            ids = [v.encode(t) for t in batch]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([v.decode(p) for p in ids], dtype=object)})

    return code


def n_tokens(packed: Column) -> Column:
    return (F.length(packed) / 4).cast("long")


def encode_decode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`docs` with the packed ids of the text column and the text that they decode to. No shuffle; a row stays where it is read.

    `path` is the tokenizer file; it must be readable at that path on the executors (as an installed package is)."""
    bounded_batches(docs.sparkSession, 200)
    (both,) = fresh(docs, "bpe_both")
    return docs.withColumn(both, coder(path)(F.col(text))).withColumns({ids: F.col(both)["ids"], decoded: F.col(both)["decoded"]}).drop(both)
