"""Token counts of a byte-level BPE vocabulary, with a shortcut for whole tokens.

A text is split at added tokens, then into pre-tokens by the vocabulary's pattern; no
merge crosses a border. Most pre-tokens are vocabulary strings. That alone does not
make them one token: a string counts as one only when the merges, run on its bytes,
end in it. This is proved once for every vocabulary string, when the vocabulary is
loaded. In a text, proven pre-tokens are counted by looking them up, and only the rest
is merged: short ones by the lowest rank at each step, long ones with a heap, so a
run of a million letters takes n log n steps.

Each row is counted by itself, in one pass and without a shuffle. A task holds the
proven strings, the merge table and a bounded memo of merged pre-tokens; pre-tokens of
a long text are taken in pieces, so memory beyond the text does not grow with it; only
a single pre-token needs memory by its length (about 300 bytes a byte while it is merged).
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import islice

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm.common import narrow_batches, text_of

LIMIT = 512
MEMO_CHARS = 64
MEMO_ENTRIES = 150_000  # of each of two generations
# symbols up to which the lowest rank is searched again at every step
SHORT = 100
# characters of a text whose pre-tokens are listed at once
PIECE_CHARS = 1 << 18
OUTPUTS = ("n_bytes", "n_tokens", "over_limit")

# fixed value: the pattern of byte-level vocabularies, of letters, numbers and what is neither
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{}+| ?{}+| ?{}+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where printable, else one beyond 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    plain = set(shown)
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def unlike_letters(split) -> str:
    """Characters that the ``regex`` package takes for letters or numbers, and the library does not.

    ``split`` is the library's own splitter. The two follow different versions of
    Unicode; after "!", a character of neither kind stays in one pre-token with it.
    """
    known = regex.compile(r"[\p{L}\p{N}]")
    points = "".join(map(chr, [*range(128, 0xD800), *range(0xE000, 0x110000)]))
    asked = known.findall(points)
    found = []
    for low in range(0, len(asked), 4096):
        part = asked[low : low + 4096]
        spans = [span for _, span in split("".join("!" + c for c in part))]
        found += [part[a // 2] for a, b in spans if a % 2 == 0 and b > a + 1]
    return "".join(found)


def _ranges(characters: str) -> str:
    """A character class body for sorted characters."""
    runs: list[list[int]] = []
    for c in map(ord, characters):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in runs)


@dataclass(frozen=True)
class Vocabulary:
    """What a task needs: the merges, the strings proven to be one token, added tokens, rare characters."""

    ranks: dict[tuple[int, int], int]  # of pairs of ids
    becomes: list[int]  # the id of a pair, by its rank
    bytes_: list[int]  # the id of each byte
    whole: frozenset[str]
    added: tuple[str, ...]
    rare: str


class TokenCounter:
    """Counts tokens of texts; keeps a bounded memo of merged pre-tokens."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.ones = dict.fromkeys(vocabulary.whole, 1)
        self.memo = _Memo(self)
        self.plain = regex.compile(_PATTERN.format(r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]"))
        longest_first = sorted(vocabulary.added, key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, longest_first)))
        if vocabulary.rare:
            odd = f"[{_ranges(vocabulary.rare)}]"
            self.rare = regex.compile(odd)
            classes = (rf"[\p{{L}}--{odd}]", rf"[\p{{N}}--{odd}]", rf"(?:[^\s\p{{L}}\p{{N}}]|{odd})")
            self.strict = regex.compile(_PATTERN.format(*classes), regex.V1)

    def merged(self, data: bytes) -> int:
        """Tokens of one pre-token by its merges."""
        ids = [self.v.bytes_[b] for b in data]
        return len(self._lowest_first(ids)) if len(ids) <= SHORT else self._by_heap(ids)

    def _lowest_first(self, ids: list[int]) -> list[int]:
        rank, becomes = self.v.ranks.get, self.v.becomes
        none = len(becomes)
        pairs = [rank(p, none) for p in zip(ids, ids[1:])]
        while pairs and (lowest := min(pairs)) < none:
            i = pairs.index(lowest)
            ids[i] = becomes[lowest]
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i < len(pairs):
                pairs[i] = rank((ids[i], ids[i + 1]), none)
        return ids

    def _by_heap(self, ids: list[int]) -> int:
        """The same with a heap of pairs over a linked list."""
        ranks, becomes, n = self.v.ranks, self.v.becomes, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(ranks[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = becomes[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            left -= 1
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (pair := (ids[p], ids[q])) in ranks:
                    heapq.heappush(heap, (ranks[pair], p, *pair))
        return left

    def _span(self, text: str) -> int:
        """Tokens of a text without added tokens."""
        pattern = self.plain
        if self.v.rare and not text.isascii() and self.rare.search(text):
            pattern = self.strict
        if len(text) <= PIECE_CHARS:
            return sum(map(self.memo.__getitem__, pattern.findall(text)))
        total, found = 0, pattern.finditer(text)
        while piece := [m.group() for m in islice(found, PIECE_CHARS // 8)]:
            total += sum(map(self.memo.__getitem__, piece))
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.v.added:
            return self._span(text)
        total, at = 0, 0
        for m in self.added.finditer(text):
            total += self._span(text[at : m.start()]) + 1
            at = m.end()
        return total + self._span(text[at:] if at else text)


class _Memo(dict):
    """Tokens of a pre-token: one for proven strings, else merged, and remembered.

    What was merged since the memo was last full, or used again since, survives the next time.
    """

    def __init__(self, counter: TokenCounter) -> None:
        super().__init__(counter.ones)
        self.counter, self.older = counter, {}
        self.full = len(self) + MEMO_ENTRIES

    def __missing__(self, piece: str) -> int:
        n = self.older.get(piece) or self.counter.merged(piece.encode())
        if len(piece) <= MEMO_CHARS:
            if len(self) >= self.full:
                self.older = dict(islice(self.items(), len(self.counter.ones), None))
                self.clear()
                self.update(self.counter.ones)
            self[piece] = n
        return n


def load_vocabulary(path: str) -> Vocabulary:
    """Read a tokenizer file and prove which of its strings are one token.

    Only byte-level BPE without a normalizer is taken; anything else raises ValueError.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    flags = [k for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized") if t[k]]
    if model["type"] != "BPE" or spec["normalizer"] or odd or not plain or flags:
        raise ValueError(f"{path}: only plain byte-level BPE is supported")
    symbols, ids = byte_symbols(), model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ranks = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}
    becomes = [ids[a + b] for a, b in pairs]
    rare = unlike_letters(Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str)
    added = tuple(t["content"] for t in spec["added_tokens"])
    base = Vocabulary(ranks, becomes, [ids[s] for s in symbols], frozenset(), added, rare)
    counter, back = TokenCounter(base), {s: b for b, s in enumerate(symbols)}
    whole = set()
    for string in ids:
        if all(c in back for c in string):
            data = bytes(back[c] for c in string)
            try:
                text = data.decode()
            except UnicodeDecodeError:
                continue  # no pre-token is part of a character
            if counter.merged(data) == 1:
                whole.add(text)
    return replace(base, whole=frozenset(whole))


def token_count(docs: DataFrame, path: str, text: Column) -> Column:
    """Tokens of a text column of ``docs``, as an expression."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    narrow_batches(docs)

    @F.pandas_udf(T.LongType())
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = TokenCounter(shared.value)
        for texts in batches:
            yield pd.Series([counter.count(x) for x in texts], dtype="int64")

    return counts(text)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """All rows of ``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    The counts are those of the tokenizers library for the vocabulary file ``path``:
    without begin or end tokens, and a special string inside a text is one token.

    NULL and empty texts have no bytes and no tokens. Rows are independent: repeated rows
    and ids are kept as they are, an empty table stays empty, and a text of any length is
    counted whole. Columns that bear an output's name are replaced.
    """
    text = text_of(text_col)
    out = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in OUTPUTS],
        F.octet_length(text).cast("long").alias("n_bytes"),
        token_count(docs, path, text).alias("n_tokens"),
    )
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
