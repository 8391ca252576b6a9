"""SentencePiece BPE encoding by a table of last tokens, and decoding.

A prefix of a text has one BPE encoding, so it has one last token. The table of
these last tokens is filled from left to right: an automaton reports every piece
that ends at a position, and the piece is the last token there exactly if it is
compatible with the last token of the prefix before it, that is, if the merges give
just these two tokens for their joined text. Walking back from the end of the table
recovers the ids. The work is linear in the length of the text, whatever it holds.

The table never has to span a place that no piece spans. Where no piece has a
space mark after another character, words are encoded on their own and remembered
in a bounded cache.
"""

from __future__ import annotations

import codecs
import math
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from assetloom.llm.common import narrow_batches
from assetloom.llm.numtext import slices, text_slices, tidy

SPACE = "▁"
CACHE_ENTRIES = 200_000  # twice as many words are held, by a task while it runs
CACHED_CHARS = 64
PAIR_ENTRIES = 300_000
SLICE_BYTES = 2 << 20

NORMAL, UNKNOWN, CONTROL, BYTE = range(4)


def load_pieces(model_path: str) -> dict:
    """Pieces, scores and kinds of a SentencePiece BPE model, as plain lists for a broadcast.

    Only models that keep the text as it is (identity normaliser, dummy prefix, white
    space kept) are accepted; any other raises ValueError.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    if model.normalize(" a  b ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}b{SPACE}" or model.normalize("Ａﬁ\t") != (
        f"{SPACE}Ａﬁ\t"
    ):
        raise ValueError("the model changes texts before encoding")
    size = model.get_piece_size()
    kinds = [
        BYTE
        if model.is_byte(i)
        else CONTROL
        if model.is_control(i) or model.is_unused(i)
        else UNKNOWN
        if model.is_unknown(i)
        else NORMAL
        for i in range(size)
    ]
    found = {
        "pieces": [model.id_to_piece(i) for i in range(size)],
        "scores": [model.get_score(i) for i in range(size)],
        "kinds": kinds,
        "begin": model.bos_id(),
        "end": model.eos_id(),
        "made": [],
    }
    # a piece that merging never makes is never a token
    table = PieceTable(found)
    return found | {"made": [i for p, i in table.ids.items() if table._merge(p) == [p]]}


def _one_each(error: UnicodeError):
    """Undecodable bytes give one replacement character each."""
    return "�", error.start + 1


codecs.register_error("one_each", _one_each)


class PieceDecoder:
    """Surfaces of the pieces of one vocabulary."""

    def __init__(self, model: dict):
        codecs.register_error("one_each", _one_each)
        self.surface: list[bytes] = []
        self.control, self.marked = set(), set()
        for i, (piece, kind) in enumerate(zip(model["pieces"], model["kinds"], strict=True)):
            if kind == BYTE:
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif kind == NORMAL:
                self.surface.append(piece.replace(SPACE, " ").encode())
                if piece.startswith(SPACE):
                    self.marked.add(i)
            elif kind == CONTROL:
                self.surface.append(b"")
                self.control.add(i)
            else:
                self.surface.append(" ⁇ ".encode())

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control ids are silent, the first space mark of the text is dropped."""
        text = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if i not in self.control), None)
        return (text[1:] if first in self.marked else text).decode("utf-8", "one_each")


class PieceTable:
    """Encoder of one vocabulary."""

    def __init__(self, model: dict):
        import ahocorasick

        pieces, kinds = model["pieces"], model["kinds"]
        self.begin, self.end = model["begin"], model["end"]
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == NORMAL}
        self.letters = {p for p in self.ids if len(p) == 1}
        self.pieces = pieces
        self.scores = model["scores"]
        self.byte_ids = [0] * 256
        for i, (piece, kind) in enumerate(zip(pieces, kinds, strict=True)):
            if kind == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
        self.lengths = [len(p) for p in pieces]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i in model["made"]:
            self.automaton.add_word(pieces[i], i)
        self.automaton.make_automaton()
        longer = [p for p in self.ids if len(p) > 1]
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in longer))
        self.splits = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in longer)
        one = f"[{alone}]|" if alone else ""
        # words of the text before its spaces are marked: plain strings are smaller
        self.words = re.compile(f"{one}[ {SPACE}]*[^ {SPACE}{alone}]+|[ {SPACE}]+")
        # characters that no piece has right after a letter
        after = {b for p in longer for a, b in zip(p, p[1:]) if a.isalpha()}
        self.tails = "".join(c for c in self.letters - after if not c.isalpha() and c != SPACE and c != " ")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.edges: dict[int, dict[int, list[tuple[str, float]]]] = {0: {}, -1: {}}

    def _merge(self, text: str, told: Callable[[str, float], None] | None = None, side: int = 0) -> list[str]:
        """Plain BPE of a short text: best score first, the leftmost of equal ones.

        ``told`` hears of each part that stood at one end, and the score of the merge that ended it.
        """
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                merged = self.ids.get(parts[i] + parts[i + 1])
                if merged is not None and (best is None or self.scores[merged] > best):
                    best, at = self.scores[merged], i
            if at < 0:
                break
            if told and at == (0 if side == 0 else len(parts) - 2):
                told(parts[side], best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if told:
            told(parts[side], -math.inf)
        return parts

    def _compatible(self, left: int, right: int) -> bool:
        if left < 0:  # a character outside the vocabulary takes part in no merge
            return True
        key = left * len(self.pieces) + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            a, b = self.pieces[left], self.pieces[right]
            if a.endswith(SPACE * 2) or b.startswith(SPACE * 2):  # runs of marks share one score
                known = self._merge(a + b) == [a, b]
            else:
                known = not self._crossed(self._edge(left, -1), self._edge(right, 0))
            self.pairs[key] = known
        return known

    def _edge(self, token: int, side: int) -> list[tuple[str, float]]:
        """The parts a token has at one end while it is merged, each with the score that ends it."""
        edges = self.edges[side]
        if token not in edges:
            edge: list[tuple[str, float]] = []
            self._merge(self.pieces[token], lambda part, score: edge.append((part, score)), side)
            edges[token] = edge
        return edges[token]

    def _crossed(self, left: list[tuple[str, float]], right: list[tuple[str, float]]) -> bool:
        """Whether a merge over the border comes before the merges that end its two parts."""
        for a, ends_a in left:
            for b, ends_b in right:
                merged = self.ids.get(a + b)
                # of equal scores the left one goes first
                if merged is not None and self.scores[merged] > ends_a and self.scores[merged] >= ends_b:
                    return True
        return False

    def encode_span(self, text: str) -> list[int]:
        """Ids of a normalised text, by the table of last tokens."""
        n = len(text)
        last: list[int | None] = [None] * (n + 1)
        if not self.letters.issuperset(text):
            for i, c in enumerate(text):
                if c not in self.letters:
                    last[i + 1] = -1
        pairs, size, lengths = self.pairs, len(self.pieces), self.lengths
        for stop, token in self.automaton.iter(text):
            stop += 1
            if last[stop] is None:
                start = stop - lengths[token]
                if start:
                    before = last[start]
                    if before is None:
                        continue
                    fits = pairs.get(before * size + token)
                    if not (self._compatible(before, token) if fits is None else fits):
                        continue
                last[stop] = token
        ids: list[int] = []
        while n:
            token = last[n]
            if token is None:
                raise ValueError("the vocabulary has no merge order for this text")
            if token < 0:
                n -= 1
                ids.extend(self.byte_ids[b] for b in reversed(text[n].encode()))
            else:
                n -= len(self.pieces[token])
                ids.append(token)
        ids.reverse()
        return ids

    def _encode_word(self, word: str) -> bytes:
        """Ids of a word that the cache does not hold; words used lately survive when it is full."""
        ids = self.older.get(word)
        if ids is None:
            stem = word.rstrip(self.tails)
            if stem and stem != word and stem[-1].isalpha():
                # no piece spans this place either
                tail = word[len(stem) :]
                ids = (self.cache.get(stem) or self._encode_word(stem)) + (
                    self.cache.get(tail) or self._encode_word(tail)
                )
            else:
                ids = array("I", self.encode_span(word.replace(" ", SPACE))).tobytes()
        if len(word) <= CACHED_CHARS:
            if len(self.cache) >= CACHE_ENTRIES:
                self.older, self.cache = self.cache, {}
            self.cache[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a text with begin and end ids, as little-endian unsigned 32-bit integers."""
        out = [array("I", [self.begin]).tobytes()]
        if text:
            text = " " + text  # the dummy prefix
            for word in self.words.findall(text) if self.splits else [text]:
                out.append(self.cache.get(word) or self._encode_word(word))
        out.append(array("I", [self.end]).tobytes())
        return b"".join(out)


def encode_texts(
    docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None
) -> DataFrame:
    """All rows of ``docs`` with the ids of their text, an array of integers.

    With ``decoded_col`` the ids are decoded again in the same pass, as by ``decode_ids``.
    NULL and empty texts give the begin and end ids alone. Rows are independent:
    repeated rows and ids are kept as they are; an empty table stays empty. A column
    named ``out_col`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(model_path))
    new = [out_col, decoded_col] if decoded_col else [out_col]
    base = docs.drop(*[c for c in new if c != text_col])
    fields = [f for f in base.schema.fields if f.name not in new]
    schema = T.StructType([*fields, T.StructField(out_col, T.ArrayType(T.IntegerType(), False))])
    if decoded_col:
        schema = schema.add(decoded_col, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        table, decoder = PieceTable(shared.value), PieceDecoder(shared.value)
        for part in text_slices(batches, text_col, SLICE_BYTES):
            ids = [table.encode(x) for x in part.column(text_col).to_pylist()]
            ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            columns = [pa.ListArray.from_arrays(pa.array(ends), values)]
            if decoded_col:
                texts = [decoder.decode(array("I", x).tolist()) for x in ids]
                columns.append(pa.array(texts, pa.string()))
            kept = [(n, c) for n, c in zip(part.schema.names, part.columns, strict=True) if n not in new]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), *columns], [*(n for n, _ in kept), *new])
        # idle workers stay in the pool for a while: they should not hold the table and its caches
        del table
        tidy()

    return narrow_batches(base).mapInArrow(run, schema)


def decode_ids(docs: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All rows of ``docs`` with the text of their ids. NULL gives the empty text.

    Undecodable bytes give one replacement character each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(model_path))
    base = docs.drop(out_col)
    schema = T.StructType([*base.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        decoder = PieceDecoder(shared.value)
        for batch in batches:
            at = batch.schema.names.index(ids_col)
            sizes = batch.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for part in slices(batch, sizes.astype(np.int64) * 4, SLICE_BYTES):
                texts = [decoder.decode(x or []) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], [*part.schema.names, out_col]
                )

    return narrow_batches(base).mapInArrow(run, schema)
