"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default place of the vocabulary, a file of ranks: base64 of a token's bytes, a space, its rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pattern that goes with this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Cuts only where the pattern above cuts whatever stands on either side, so the tokens of
# a text are those of its parts: before a run of other characters and the one space in
# front of it, and before the last character of a run of white space.
_PARTS = re.compile(r" ?\S+|\s+(?!\S)|\s")
# The same for a part in ASCII.
_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")

_LOADED: dict[str, TokenCounter] = {}


class TokenCounter:
    """Exact number of tokens of a text, remembering the parts met before.

    At most about ``remember`` parts are kept; when they are exceeded all are dropped.
    """

    def __init__(self, vocabulary: str, remember: int = 400_000) -> None:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.remember = remember
        self.parts = _Memory(self._part)
        self.pieces = _Memory(self._piece)

    def _piece(self, piece: str) -> int:
        return len(self.encode(piece))

    def _part(self, part: str) -> int:
        if len(part) < 3 or not part.isascii():
            return len(self.encode(part))
        return sum(map(self.pieces.__getitem__, _PIECES.findall(part)))

    def count(self, text: str) -> int:
        if len(self.parts) > self.remember:
            self.parts.clear()
        if len(self.pieces) > self.remember:
            self.pieces.clear()
        return sum(map(self.parts.__getitem__, _PARTS.findall(text)))


class _Memory(dict):
    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, key: str) -> int:
        n = self.make(key)
        if len(key) <= 64:
            self[key] = n
        return n


def counter(vocabulary: str = VOCABULARY) -> TokenCounter:
    """The counter of a vocabulary, loaded once in a process."""
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = TokenCounter(vocabulary)
    return _LOADED[vocabulary]


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a string column: 0 for an empty text, null for a null one.

    Whole texts are counted, special tokens' strings as ordinary text. The vocabulary is
    a path that every executor can read.
    """

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(vocabulary)
        for texts in batches:
            yield pd.Series([None if t is None else own.count(t) for t in texts], dtype="Int64")

    return F.pandas_udf("long")(count)(text)
