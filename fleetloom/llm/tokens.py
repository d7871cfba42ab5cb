"""Token counts by byte-pair merging."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# How byte-level vocabularies cut a text into pieces and write bytes as letters.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
# End of the fixed values.


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if printable, else the next one from 256 on."""
    others = [b for b in range(256) if b not in PRINTABLE]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Merge ranks and added strings of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        letters = byte_letters()
        as_bytes = lru_cache(None)(lambda word: bytes(letters[c] for c in word))
        self.ranks = {(as_bytes(a), as_bytes(b)): rank for rank, (a, b) in enumerate(stored["model"]["merges"])}
        self.added = sorted((t["content"] for t in stored["added_tokens"]), key=len, reverse=True)


def merges(piece: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """How many merges the piece takes: the lowest-ranked adjacent pair, the leftmost of equals, goes first.

    The symbols are a linked list. The heap has every pair that ever became adjacent; a pair one of
    whose symbols has changed since is passed over when it comes up.
    """
    symbols: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    end = len(symbols)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    heap = [
        (rank, i, pair)
        for i, pair in enumerate(zip(symbols, symbols[1:], strict=False))
        if (rank := ranks.get(pair)) is not None
    ]
    heapq.heapify(heap)
    done = 0
    while heap:
        _, left, pair = heapq.heappop(heap)
        right = after[left]
        if right >= end or symbols[left] != pair[0] or symbols[right] != pair[1]:
            continue
        symbols[left], symbols[right] = pair[0] + pair[1], None
        after[left] = following = after[right]
        done += 1
        if following < end:
            before[following] = left
            if (rank := ranks.get(new := (symbols[left], symbols[following]))) is not None:
                heapq.heappush(heap, (rank, left, new))
        if (previous := before[left]) >= 0:
            if (rank := ranks.get(new := (symbols[previous], symbols[left]))) is not None:
                heapq.heappush(heap, (rank, previous, new))
    return done


def counter(path: str, remembered: int = 1 << 18) -> Callable[[str | None], int]:
    """A function from a text to its number of tokens.

    Added strings in the text are a token each, the rest is cut into pieces that merge on their own.
    The counts of the ``remembered`` pieces used last are kept; a piece counts the same either way.
    """
    vocabulary = Vocabulary(path)
    cut = regex.compile(PIECES).findall
    apart = regex.compile("|".join(map(regex.escape, vocabulary.added))).split if vocabulary.added else lambda t: [t]

    @lru_cache(remembered)
    def of_piece(piece: str) -> int:
        data = piece.encode("utf-8", "replace")
        return len(data) - merges(data, vocabulary.ranks)

    def count(text: str | None) -> int:
        if not text:
            return 0
        parts = apart(text)
        return len(parts) - 1 + sum(sum(map(of_piece, cut(part))) for part in parts)

    return count


def token_count(text: Column, path: str) -> Column:
    """Number of tokens of the whole text; NULL counts as empty, which has none.

    ``path`` is a vocabulary file at the same place on every executor.
    """

    @F.pandas_udf("long")
    def count_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path)
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    return count_tokens(text)
