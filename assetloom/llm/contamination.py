"""Benchmark decontamination by suffix arrays over the training text.

Every task turns its share of the documents into shards of bounded size and builds
a suffix array of each shard's words. All suffixes of the benchmark items are then
searched in each shard at once: the interval of the array that starts with a
suffix's first d words is narrowed by one binary search per further word, until it
is empty. The depth reached is the longest verbatim match, the interval holds its
places. Words are compared by two independent 64-bit hashes: the array is ordered
by the first, places found are confirmed with the second.

The benchmark reaches the tasks in blocks of a bounded size. A single block is one
broadcast, and documents are not shuffled at all. A larger benchmark means more blocks:
each is broadcast, its findings are written, without the texts, and the broadcast is
destroyed before the next one, so the driver and the tasks never hold more than one.
Findings of all blocks are then put together by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm.common import narrow_batches
from assetloom.llm.numtext import U64, text_slices, tidy, utf8, words
from assetloom.session import materialize

SHARD_BYTES = 1 << 20
BLOCK_BYTES = 16 << 20
OUTPUTS = ("n_words", "hits", "items", "longest", "contaminated")


def _blocks(benchmark: DataFrame, text_col: str, id_col: str, block_bytes: int) -> tuple[int, Iterator[list]]:
    """How many parts of about ``block_bytes`` the distinct items make, and the parts, one at a time."""
    items = benchmark.select(
        F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    items = items.where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    n = int(total // block_bytes) + 1

    def parts() -> Iterator[list]:
        for k in range(n):
            part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else items
            yield [(r["id"] if r["id"] is not None else "", r["text"]) for r in part.collect()]

    return n, parts()


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by the ``depth`` tokens that follow, by prefix doubling.

    Only suffixes that still tie are sorted again. Past the end a suffix is smallest.
    """
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = tokens[order[1:]] != tokens[order[:-1]]
    rank = np.empty(n, dtype=np.int64)
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))  # a group's rank is its first place
    rank[order] = first
    length = 1
    while length < depth:
        alone = fresh & np.append(fresh[1:], True)
        places = np.flatnonzero(~alone)
        if not len(places):
            break
        held = order[places]
        after = held + length
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        again = np.lexsort((second, rank[held]))
        held, second = held[again], second[again]
        group = rank[held]
        order[places] = held
        fresh_here = np.ones(len(held), dtype=bool)
        fresh_here[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        fresh[places] = fresh_here
        rank[held] = places[np.maximum.accumulate(np.where(fresh_here, np.arange(len(held)), 0))]
        length *= 2
    return order


def _bound(tokens: np.ndarray, order: np.ndarray, low, high, depth: int, wanted, after: bool) -> np.ndarray:
    """In each interval, the first place whose token at ``depth`` is not below (or is above) the wanted one."""
    low, high = low.copy(), high.copy()
    n = len(tokens)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) >> 1
        at = order[middle] + depth
        there = at < n
        token = tokens[np.minimum(at, n - 1)]
        right = ~there | ((token <= wanted[open_]) if after else (token < wanted[open_]))
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]


class Suffixes:
    """All suffixes of a block of benchmark items, with the windows that start at them."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        data, offsets = utf8(pa.array([t for _, t in items], pa.large_string()))
        (self.tokens, self.check), counts = words(data, offsets, 2)
        length = np.diff(counts)
        self.item = np.repeat(np.arange(len(items)), length)
        self.ids = [i for i, _ in items]
        self.end = np.repeat(counts[1:], length)
        start = np.arange(len(self.tokens))
        self.rest = self.end - start
        # words in the window that starts here; 0 where none does
        self.window = np.where(self.rest >= window, window, 0)
        short = start == np.repeat(counts[:-1], length)
        self.window[short & (self.rest < window)] = self.rest[short & (self.rest < window)]
        self.depth = int(length.max()) if len(length) else 0

    def search(self, tokens: np.ndarray, check: np.ndarray):
        """Longest match of every suffix, and the places of every window: (depth, place) and (suffix, place)."""
        longest = np.zeros(len(self.tokens), dtype=np.int64)
        place = np.full(len(self.tokens), -1, dtype=np.int64)
        found_q, found_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if not len(tokens) or not len(self.tokens):
            return longest, place, found_q[0], found_p[0]
        order = suffix_array(tokens, self.depth)
        alive = np.arange(len(self.tokens))
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), len(tokens), np.int64)
        depth = 0
        while len(alive):
            wanted = self.tokens[alive + depth]
            first = _bound(tokens, order, low, high, depth, wanted, after=False)
            last = _bound(tokens, order, first, high, depth, wanted, after=True)
            depth += 1
            ok = last > first
            alive, low, high = alive[ok], first[ok], last[ok]
            longest[alive], place[alive] = depth, order[low]
            done = np.flatnonzero(self.window[alive] == depth)
            if len(done):
                sizes = high[done] - low[done]
                which = np.repeat(alive[done], sizes)
                inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                where = order[np.repeat(low[done], sizes) + inner]
                same = np.ones(len(which), dtype=bool)
                for d in range(depth):
                    same &= check[where + d] == self.check[which + d]
                found_q.append(which[same])
                found_p.append(where[same])
            more = self.rest[alive] > depth
            alive, low, high = alive[more], low[more], high[more]
        return longest, place, np.concatenate(found_q), np.concatenate(found_p)


def _shard(batch: pa.RecordBatch, name: str, suffixes: Suffixes) -> dict[str, list]:
    """Words, hit spans, items and longest match of every document of a shard."""
    data, offsets = utf8(batch.column(batch.schema.names.index(name)).cast(pa.large_string()))
    (tokens, check), counts = words(data, offsets, 2)
    n_docs = batch.num_rows
    # a separator after every document; no word of an item equals it, as its check value differs
    gaps = np.arange(len(tokens)) + np.repeat(np.arange(n_docs), np.diff(counts))
    spaced = np.zeros(len(tokens) + n_docs, U64)
    spaced[gaps] = tokens
    spaced_check = np.zeros(len(tokens) + n_docs, U64)
    spaced_check[gaps] = check
    begins = counts[:-1] + np.arange(n_docs)
    longest, place, which, where = suffixes.search(spaced, spaced_check)
    reach = np.zeros(n_docs, np.int64)
    matched = np.flatnonzero(longest)
    np.maximum.at(reach, np.searchsorted(begins, place[matched], side="right") - 1, longest[matched])
    edge = np.zeros(len(spaced) + 1, np.int64)
    np.add.at(edge, where, 1)
    np.add.at(edge, where + suffixes.window[which], -1)
    covered = np.cumsum(edge)[:-1] > 0
    doc = np.searchsorted(begins, where, side="right") - 1
    pairs = np.unique(np.stack([doc, suffixes.item[which]], axis=1), axis=0) if len(doc) else np.zeros((0, 2), int)
    hits, items = [[] for _ in range(n_docs)], [[] for _ in range(n_docs)]
    for d, i in pairs:
        items[d].append(suffixes.ids[i])
    step = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
        d = int(np.searchsorted(begins, a, side="right")) - 1
        hits[d].append((int(a - begins[d]), int(b - begins[d])))
    return {"n_words": np.diff(counts).tolist(), "hits": hits, "items": items, "longest": reach.tolist()}


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(_SPAN)),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest", T.IntegerType()),
    ]
)
_KINDS = [
    pa.int64(),
    pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
    pa.list_(pa.string()),
    pa.int32(),
]


def _searched(docs: DataFrame, text_col: str, block: Broadcast, window: int, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with the findings of one block of items."""
    names = [f.name for f in _FOUND.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        suffixes = Suffixes(block.value, window)
        for part in text_slices(batches, text_col, SHARD_BYTES):
            found = _shard(part, text_col, suffixes)
            found["hits"] = [[{"start": s, "end": e} for s, e in x] for x in found["hits"]]
            found["items"] = [sorted(set(x)) for x in found["items"]]
            columns = [pa.array(found[n], kind) for n, kind in zip(names, _KINDS, strict=True)]
            kept = [part.column(part.schema.names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*keep, *names])

    schema = T.StructType([*[docs.schema[c] for c in keep], *_FOUND.fields])
    return narrow_batches(docs).mapInArrow(run, schema)


def _united(spans: Column) -> Column:
    """Spans of several blocks as maximal runs, in order."""

    def add(done: Column, span: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        joins = (F.size(done) > 0) & (span["start"] <= last["end"])
        rest = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(joins, F.concat(rest, F.array(longer))).otherwise(
            F.concat(done, F.array(span))
        )

    empty = F.array().cast(T.ArrayType(_SPAN))
    return F.aggregate(F.array_sort(spans), empty, add)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_text_col: str = "text",
    item_id_col: str = "item_id",
    window: int = 10,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All rows of ``docs`` with what they share with the benchmark.

    Adds ``n_words``; ``hits`` (array of start and end, in words, of the parts that
    windows of items cover); ``items`` (sorted distinct item ids, as strings, with a
    window in the document); ``longest`` (words of the longest verbatim match that
    starts at any word of an item; of equal places of a match the first in the array
    is taken); ``contaminated`` (there is a hit). A window is ``window`` consecutive
    words of an item, or all words of a shorter one.

    NULL and empty texts have no words and no hits. Items without words have no
    window; NULL item ids are reported as the empty string; rows that repeat an item are one
    item, and items that repeat an id count once. Rows are independent, so repeated documents are all returned; an
    empty benchmark hits nothing. Columns that bear an output's name are replaced.
    """
    sc = docs.sparkSession.sparkContext
    base = docs.drop(*[c for c in OUTPUTS if c != text_col])
    n, parts = _blocks(benchmark, item_text_col, item_id_col, block_bytes)
    if n == 1:
        out = _searched(base, text_col, sc.broadcast(next(parts)), window, base.columns)
        return out.withColumn("contaminated", F.size("hits") > 0)
    row = "row"
    while row in base.columns:
        row += "_"
    numbered = materialize(base.withColumn(row, F.monotonically_increasing_id()))
    found = None
    for part in parts:
        block = sc.broadcast(part)
        some = materialize(_searched(numbered.select(row, text_col), text_col, block, window, [row]))
        block.destroy()
        found = some if found is None else found.unionByName(some)
    whole = found.groupBy(row).agg(
        F.max("n_words").alias("n_words"),
        _united(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("longest").alias("longest"),
    )
    # in the order of the input, as with one block
    out = numbered.join(whole, row).orderBy(row)
    columns = [numbered[f"`{c}`"] for c in base.columns] + [whole[f.name] for f in _FOUND.fields]
    return out.select(*columns).withColumn("contaminated", F.size(whole["hits"]) > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows without a hit, with the columns they came with."""
    found = find_contamination(docs, benchmark, **options)
    return found.where(~F.col("contaminated")).select(*[found[f"`{c}`"] for c in docs.columns])
