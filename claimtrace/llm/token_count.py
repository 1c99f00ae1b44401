"""Token counts of a byte-level BPE vocabulary, by heap-and-linked-list merging.

Only the number of merges matters: a piece of ``n`` bytes that allows ``m`` merges has ``n - m`` tokens, so no
token identifier of the text is ever built.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimtrace.llm.common import whole

#: Fixed: how byte-level BPE cuts a text into pieces before merging (public pattern of that tokenizer family), with
#: the sets of letters, numbers and white space left open.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"

#: Counts of so many distinct pieces are kept by a Python worker, each piece of at most so many characters.
KEPT, KEPT_CHARS = 600_000, 64


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable letter: itself if printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Cutting:
    """Patterns that cut texts into pieces: ``usual`` holds for texts without any of the characters in ``odd`` (a set of
    them, from ``lowest`` on), ``exact`` for all. They differ where the library's Unicode version isn't that of ``regex``."""

    usual: str
    exact: str
    odd: str
    lowest: str


@cache
def cutting(path: str) -> Cutting:
    """How the library cuts texts, as its own pre-tokenizer shows for every code point.

    All letters that ``regex`` knows are cut as one text, and so are all numbers, white space and the rest. Pieces that
    aren't of that class are found by showing their first character between a mark and a letter, and between a mark and
    a digit: a letter stays with the letter, a number with the digit, white space with neither, all else with the mark.
    """
    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str

    def kind(c: str) -> str:
        (with_a, with_1) = ([a for _, (a, _) in cut(f"!{c}{after}")] for after in "a1")
        return "X" if 1 not in with_a else "L" if 2 not in with_a and c != " " else "N" if 2 not in with_1 and c != " " else "S"

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes = {"L": r"\p{L}", "N": r"\p{N}", "S": r"\s", "X": r"[^\s\p{L}\p{N}]"}
    sets: dict[str, list[str]] = {k: [] for k in classes}
    odd: list[str] = []
    for k, named in classes.items():
        known = "".join(regex.findall(named, every))
        for _, (a, b) in cut(known):
            found = kind(known[a])
            sets[found].extend(known[a:b])
            if found != k:
                odd.extend(known[a:b])
    exact = {k: _ranges(sorted(map(ord, v))) for k, v in sets.items()}
    usual = PIECES.format(**{k: v for k, v in classes.items() if k != "X"})
    return Cutting(usual, PIECES.format(**exact), f"[{_ranges(sorted(map(ord, odd)))}]" if odd else "(?!)", min(odd, default=chr(0x10FFFF)))


def _ranges(points: list[int]) -> str:
    """Sorted code points as ranges of a character set."""
    out: list[list[int]] = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class BpeCounter(dict):
    """Counts tokens. As a dict it maps pieces that were met before to their counts."""

    def __init__(self, path: str, cutting: Cutting):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        odd = spec["normalizer"], model.get("dropout"), model.get("ignore_merges"), pre.get("add_prefix_space")
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre["use_regex"] or any(odd):
            raise ValueError(f"{path}: only plain byte-level BPE is counted")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take in their surroundings aren't handled")
        letters, ids = _byte_letters(), model["vocab"]
        self.of_byte = [0] * 256
        for letter, b in letters.items():
            self.of_byte[b] = ids[letter]
        self.width = max(ids.values()) + 1
        #: left * width + right -> rank * width + merged
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left] * self.width + ids[right]] = rank * self.width + ids[left + right]
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.usual, self.exact, self.odd = (regex.compile(p) for p in (cutting.usual, cutting.exact, cutting.odd))
        self.lowest = cutting.lowest

    def __missing__(self, piece: str) -> int:
        n = self.merged(piece.encode("utf-8"))
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = n
        return n

    def merged(self, data: bytes) -> int:
        """Initial symbols minus merges: the lowest rank goes first, and of equal ranks the leftmost pair."""
        n = len(data)
        if n < 2:
            return n
        merges, width = self.merges, self.width
        symbols = [self.of_byte[b] for b in data]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []
        for i in range(n - 1):
            found = merges.get(symbols[i] * width + symbols[i + 1])
            if found is not None:
                heap.append((found, i))
        heapq.heapify(heap)
        left = n
        while heap:
            found, i = heapq.heappop(heap)
            j = after[i]
            # an entry is stale if its pair was merged into something else meanwhile
            if symbols[i] < 0 or j < 0 or merges.get(symbols[i] * width + symbols[j]) != found:
                continue
            symbols[i], symbols[j] = found % width, -1
            k = after[i] = after[j]
            left -= 1
            if k >= 0:
                before[k] = i
                new = merges.get(symbols[i] * width + symbols[k])
                if new is not None:
                    heapq.heappush(heap, (new, i))
            k = before[i]
            if k >= 0:
                new = merges.get(symbols[k] * width + symbols[i])
                if new is not None:
                    heapq.heappush(heap, (new, k))
        return left

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special string in it is one token, as by the library's default."""
        odd = text and max(text) >= self.lowest and self.odd.search(text)
        pieces = (self.exact if odd else self.usual).findall
        if self.special is None:
            return sum(map(self.__getitem__, pieces(text)))
        total = at = 0
        for m in self.special.finditer(text):
            total += 1 + sum(map(self.__getitem__, pieces(text, at, m.start()))) if m.start() > at else 1
            at = m.end()
        rest = text[at:] if at else text
        return total + sum(map(self.__getitem__, pieces(rest)))


@cache
def counter(path: str, cutting: Cutting) -> BpeCounter:
    """The vocabulary, read once by each Python worker; ``path`` must be readable on every machine."""
    return BpeCounter(path, cutting)


def n_tokens(text: Column, path: str) -> Column:
    """The number of tokens of each text."""
    cuts = cutting(path)  # found out once, on the driver

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path, cuts).count
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    return counted(text)


def with_token_counts(docs: DataFrame, path: str, limit: int, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    A null text counts as the empty text: no bytes, no tokens. Repeated rows and ties keep their rows; an input
    column that has the name of a result is replaced; other columns pass through; an empty table gives an empty one.
    """
    return (
        docs.withColumn("n_bytes", F.octet_length(whole(text)).cast("long"))
        .withColumn("n_tokens", n_tokens(whole(text), path))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
