"""Operator 4, byte-level BPE: encoding by longest matches and backtracking, and decoding.

A word piece's bytes are read as Latin-1, so that pyahocorasick, which takes strings, finds the longest
token at each place. Encoding walks left to right: take the longest token that can stand after the one
before, else the next shorter prefix of it, else step back over the last token. Two tokens can stand
side by side if merging their bytes would leave exactly them; that answer is remembered for each pair,
and each place of a piece is given up at most once, so the work is linear in the piece's length. The
result is that of merging the lowest-ranked pair again and again.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows get equal ids;
pieces and texts may have any length; extra columns are never read.
"""

from __future__ import annotations

import base64
import itertools
import re
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Most entries of each memo; a full one becomes the older half, from which what is met again moves, and a new one begins. Ids are held as the bytes of
#: their 32-bit numbers, the least that Python has for some numbers.
CACHED_PARTS, CACHED_PIECES, CACHED_PAIRS, CACHED_CHARS = 250_000, 60_000, 200_000, 40


class Codec:
    """Encodes and decodes by one rank file (lines of base64 token and rank)."""

    def __init__(self, ranks: str, pattern: str) -> None:
        with open(ranks, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
        self.ids = {token: rank for rank, token in self.tokens.items()}
        self.pieces = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.beside: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.newer_pieces: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}
        self.odd_space = re.compile(r" \s|\s ")

    def shorter_prefix(self, token: int) -> int:
        """The longest token that is a shorter prefix of token, or -1."""
        out = self.shorter.get(token)
        if out is None:
            data = self.tokens[token]
            out = next((self.ids[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ids), -1)
            self.shorter[token] = out
        return out

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes token; (token, token) for a single byte."""
        out = self.parts.get(token)
        if out is None:
            data = self.tokens[token]
            out = (token, token)
            left = self.shorter_prefix(token)
            while left >= 0:
                right = self.ids.get(data[len(self.tokens[left]) :], token)
                if left < token and right < token and self._can_stand(left, right, token):
                    out = (left, right)
                    break
                left = self.shorter_prefix(left)
            self.parts[token] = out
        return out

    def can_stand(self, left: int, right: int) -> bool:
        """Whether merging the bytes of left and right leaves just these two."""
        key = left << 32 | right
        out = self.beside.get(key)
        if out is None:
            if len(self.beside) >= CACHED_PAIRS:
                self.beside.clear()
            out = self.beside[key] = self._can_stand(left, right)
        return out

    def _can_stand(self, left: int, right: int, limit: int = 1 << 60) -> bool:
        # Undo the merges inside both tokens, the latest first, and see whether one across the border came earlier.
        while True:
            across = self.ids.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < limit:
                return False
            if left > right:
                limit = left
                left = self.halves(left)[1]
                if left == limit:
                    limit = right + 1
                    right = self.halves(right)[0]
                    if right + 1 == limit:
                        return True
            else:
                limit = right + 1
                right = self.halves(right)[0]
                if right + 1 == limit:
                    limit = left
                    left = self.halves(left)[1]
                    if left == limit:
                        return True

    def backtrack(self, data: bytes) -> list[int]:
        """The ids of a piece."""
        text = data.decode("latin-1")
        greedy = [token for _, token in self.automaton.iter_long(text)]
        beside = self.beside
        for left, right in itertools.pairwise(greedy):
            if not (beside.get(left << 32 | right) or self.can_stand(left, right)):
                break
        else:
            return greedy  # every longest match can stand: nothing to step back from
        tokens, n, longest = self.tokens, len(data), self.automaton.iter_long
        open_at = bytearray(b"\x01") * (n + 1)  # places not given up
        out: list[int] = []
        at, token = 0, greedy[0]
        while at < n:
            end = at + len(tokens[token])
            if open_at[end] and (not out or self.can_stand(out[-1], token)):
                out.append(token)
                at = end
                token = next(longest(text, at))[1] if at < n else -1
                continue
            shorter = self.shorter_prefix(token)
            if shorter < 0:  # nothing fits here: give the place up and shorten the token before
                open_at[at] = 0
                token = out.pop()
                at -= len(tokens[token])
            else:
                token = shorter
        return out

    def piece_ids(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ids.get(data)
        return array("i", [whole] if whole is not None else self.backtrack(data)).tobytes()

    def encode_piece(self, piece: str) -> bytes:
        out = self.older_pieces.pop(piece, None) or self.piece_ids(piece)
        if len(piece) <= CACHED_CHARS:
            if len(self.newer_pieces) >= CACHED_PIECES:
                self.older_pieces, self.newer_pieces = self.newer_pieces, {}
            self.newer_pieces[piece] = out
        return out

    def encode_part(self, part: str) -> bytes:
        """The ids of a part of a text that the pattern never matches across the ends of."""
        get, one = self.newer_pieces.get, self.encode_piece
        return b"".join([get(piece) or one(piece) for piece in self.pieces.findall(part)])

    def encode_word(self, word: str) -> bytes:
        """The ids of a word and the space before it; short words are remembered."""
        out = self.older.pop(word, None)
        if out is None:
            part = " " + word
            first = self.pieces.match(part)
            if len(word) < CACHED_CHARS and first and first.end() == len(part):
                # one piece, which is remembered as a word and not twice
                out = self.newer_pieces.get(part) or self.older_pieces.get(part) or self.piece_ids(part)
            else:
                out = self.encode_part(part)
        if len(word) <= CACHED_CHARS:
            if len(self.newer) >= CACHED_PARTS:
                self.older, self.newer = self.newer, {}
            self.newer[word] = out
        return out

    def encode(self, text: str | None) -> array:
        """The ids of a text.

        No match goes across the place before a single space between two other characters, so that a text
        whose spaces all stand so is taken word by word.
        """
        text = text or ""
        out = array("i")
        if self.odd_space.search(text):
            out.frombytes(self.encode_part(text))
            return out
        first, *rest = text.split(" ")
        one = self.encode_word
        words = [one(word) if ids is None else ids for word, ids in zip(rest, map(self.newer.get, rest), strict=True)]
        out.frombytes(self.encode_part(first) + b"".join(words))
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@cache
def codec(ranks: str, pattern: str) -> Codec:
    """One codec for each worker process, until that turns to another operator."""
    return Codec(ranks, pattern)


def own_codec(ranks: str, pattern: str) -> Codec:
    common.turn_to("bpe", codec.cache_clear)
    return codec(ranks, pattern)


def default_vocabulary() -> tuple[str, str]:
    """The rank file and the pattern of the contract's tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encoded(text: str | F.Column, ranks: str, pattern: str) -> F.Column:
    """A column of the ids of a text column; array<int>, empty for null."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = own_codec(ranks, pattern)
        for part in texts:
            yield pd.Series([np.frombuffer(one.encode(t), np.int32) for t in part], dtype=object)

    return F.pandas_udf(run, "array<int>")(text)


def decoded(ids: str | F.Column, ranks: str, pattern: str) -> F.Column:
    """A column of the bytes of an ids column; a text's bytes are UTF-8."""

    def run(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = own_codec(ranks, pattern)
        for part in lists:
            yield pd.Series([one.decode([] if x is None else x.tolist()) for x in part], dtype=object)

    return F.pandas_udf(run, "binary")(ids)


def round_trip(text: str | F.Column, ranks: str, pattern: str) -> F.Column:
    """A struct column: the ids of a text column, and the bytes that they decode to, by one worker."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = own_codec(ranks, pattern)
        for part in texts:
            ids = [one.encode(t) for t in part]
            yield pd.DataFrame({"ids": pd.Series([np.frombuffer(x, np.int32) for x in ids], dtype=object), "bytes": pd.Series(map(one.decode, ids), dtype=object)})

    return F.pandas_udf(run, "ids array<int>, bytes binary")(text)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of docs by the contract's tokenizer."""
    vocabulary = default_vocabulary()
    both = docs.select(docs["doc_id"], round_trip(docs["text"], *vocabulary).alias("x"))
    return both.select(
        "doc_id",
        F.size("x.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("x.ids", " "), 256).alias("ids_sha256"),
        F.sha2("x.bytes", 256).alias("decoded_sha256"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(common.documents(spark, sf_dir))
