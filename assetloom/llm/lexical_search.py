"""Ranked lexical search by range-maximum tables over posting lists.

``build_index`` writes one row per shard, some thousand documents in the order of their
ids: terms, posting lists, frequencies and lengths. Shards are made where the texts are
read, without a shuffle, and hold every document and term. A few shards make a row group
of the files, so neither writing nor reading them holds more, however much text a task reads.

A search first counts, in Spark, in how many documents each asked term occurs. Then
every shard is searched by itself. The impacts of its asked posting lists get a sparse
table, so the largest impact of any stretch of a list is two look-ups away. An item
starts with one interval, all documents of the shard, bounded by the sum of its lists'
largest impacts. Best intervals come first: the document with the largest impact in it
is scored, the interval is split there, and both sides get the sum of their own
maxima as bound. Intervals bounded below the tenth best score are dropped. Items of some
thousand terms advance together in numpy, each with its best intervals, more of them each round.

Scores found in a few shards first give every item a score that ten documents reach.
It only saves work: any ten documents' scores bound the tenth best from below. The same
holds for what a task has found in its earlier shards. Shards return what may still be
among the best; Spark ranks it, with a limit before the shuffle.

Items are taken in blocks of bounded size. The driver holds and broadcasts one block at
a time, writes its result and destroys it. A search reads the index once per block and
shuffles ten rows per item and task at most.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm.common import broadcast_if_small, narrow_batches
from assetloom.llm.numtext import text_slices, tidy
from assetloom.session import materialize, setting

BEST = 10
SHARD_BYTES = 4 << 20
GROUP_BYTES = 8 << 20  # of a row group of the index, about, or one shard: what its writer and its readers hold at once
BLOCK_BYTES = 2 << 20  # terms of the items of a block, about
PROBED_SHARDS = 48  # searched first for a bound on the tenth best score, about, and a quarter at most
PIECE_BYTES = 1 << 20
ITEM_TERMS = 1 << 13  # terms of the items that are searched together, about
OUTPUTS = ("rank", "score")

# upper case becomes lower, everything that belongs to no term a blank
_FOLD = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def term_counts(text: str | None) -> Counter[bytes]:
    """Occurrences of each term; a long text is split in pieces that end between terms."""
    found: Counter[bytes] = Counter()
    data = (text or "").encode("utf-8", "replace").translate(_FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE_BYTES)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


@dataclass(frozen=True)
class LexicalIndex:
    """Shards of documents, and the counts over all of them."""

    shards: DataFrame
    n_docs: int  # with at least one term
    n_terms: int  # with repeats
    id_type: T.DataType


def build_index(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> LexicalIndex:
    """Index all rows of ``docs``. Texts without a term (NULL, empty) are in no list and not counted.

    Rows are documents: repeated rows or ids are indexed each. A shard's documents are
    ordered by id, NULL last.
    """
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = plain.schema["id"].dataType
    ints = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType(
        [
            T.StructField("ids", T.ArrayType(kind)),
            T.StructField("lengths", T.ArrayType(T.LongType(), False)),
            T.StructField("terms", T.ArrayType(T.BinaryType(), False)),
            T.StructField("sizes", ints),
            T.StructField("docs", ints),
            T.StructField("counts", ints),
        ]
    )

    def shard(part: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, texts = part.column("id").to_pylist(), part.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        kept, lengths, distinct, terms, times = [], [], [], array("i"), array("i")
        for i in order:
            found = term_counts(texts[i])
            if found:
                kept.append(i)
                lengths.append(found.total())
                distinct.append(len(found))
                terms.extend(map(number.__getitem__, found))
                times.extend(found.values())
        if not kept:
            return None
        by = np.frombuffer(terms, dtype=np.int32)
        place = np.argsort(by, kind="stable")
        doc = np.repeat(np.arange(len(kept), dtype=np.int32), distinct)

        def one(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        return pa.RecordBatch.from_arrays(
            [
                one(part.column("id").take(pa.array(kept))),
                one(pa.array(lengths, pa.int64())),
                one(pa.array(list(number), pa.binary())),
                one(pa.array(np.bincount(by, minlength=len(number)).astype(np.int32))),
                one(pa.array(doc[place])),
                one(pa.array(np.frombuffer(times, dtype=np.int32)[place])),
            ],
            schema.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for part in text_slices(batches, "text", SHARD_BYTES):
            made = shard(part)
            if made is not None:
                yield made

    # a task may make any number of shards; left to itself, the writer looks at the size after a hundred rows
    bounded = {"parquet.block.size": str(GROUP_BYTES), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
    # vectored reads of a local file hold each column of a row group a second time
    with setting(docs.sparkSession, "parquet.hadoop.vectored.io.enabled", "false"):
        shards = materialize(narrow_batches(plain).mapInArrow(run, schema), bounded)
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)
    sums = shards.agg(F.sum(F.size("ids")).alias("n"), F.sum(total).alias("l")).first()
    return LexicalIndex(shards, sums["n"] or 0, sums["l"] or 0, kind)


class _Shard:
    """One shard's lists for the asked terms, with impacts and their range-maximum table."""

    def __init__(self, row: dict, weights: dict[bytes, tuple[int, int]], n_docs: int, n_terms: int) -> None:
        terms = row["terms"].to_pylist()
        sizes = row["sizes"].to_numpy()
        ends = np.cumsum(sizes)
        asked = [(i, *weights[t]) for i, t in enumerate(terms) if t in weights]
        self.first = {term: k for k, (_, term, _) in enumerate(asked)}  # asked term -> list
        which = np.array([i for i, _, _ in asked], dtype=np.int64)
        lens = sizes[which].astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(lens)])
        place = np.repeat((ends[which] - lens) - self.start[:-1], lens) + np.arange(self.start[-1])
        self.doc = row["docs"].to_numpy()[place].astype(np.int64)
        times = row["counts"].to_numpy()[place].astype(np.int64)
        m = np.array([10 + 90 * n * n_docs // n_terms for n in row["lengths"].to_pylist()], dtype=np.int64)
        weight = np.repeat(np.array([w for _, _, w in asked], dtype=np.int64), lens)
        self.impact = weight * (1_000_000_000 * times // (1000 * times + 8 * m[self.doc]))
        self.list_of = np.repeat(np.arange(len(asked)), lens)
        self.span = len(m)
        self.key = self.list_of * self.span + self.doc  # ascending: lists one after the other
        # impacts are below 2^36; with their place below them, a maximum also tells where it is
        n = len(self.doc)
        self.bits = max(1, n.bit_length())
        self.mask = (1 << self.bits) - 1
        level = (self.impact << self.bits) | (self.mask - np.arange(n))
        self.log = np.zeros(int(lens.max(initial=1)) + 1, dtype=np.int64)
        for length in range(2, len(self.log)):
            self.log[length] = self.log[length >> 1] + 1
        levels = [level]
        for j in range(int(self.log[-1])):
            half = 1 << j
            level = np.concatenate([np.maximum(level[:-half], level[half:]), level[-half:]])
            levels.append(level)
        self.table = np.concatenate(levels) if n else np.zeros(0, np.int64)
        self.n = n

    def largest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Largest impact of stretches [low, high) of lists, with its place."""
        level = self.log[high - low]
        base = level * self.n
        return np.maximum(self.table[base + low], self.table[base + high - (1 << level)])


def _heads(group: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best rows of each item, ordered by item, falling score and document."""
    order = np.lexsort((doc, -score, item))
    item, score, doc = item[order], score[order], doc[order]
    heads = _heads(item)
    nth = np.arange(len(item)) - np.repeat(heads, np.diff(np.append(heads, len(item))))
    return item[nth < k], score[nth < k], doc[nth < k]


def search_shard(shard: _Shard, items: list[list[int]], least: np.ndarray, k: int):
    """(item, score, document) of all documents that may be among the ``k`` best of an item.

    ``items`` holds the numbers of their terms. What scores below ``least`` is not looked for.
    """
    pairs = [(i, shard.first[t]) for i, terms in enumerate(items) for t in terms if t in shard.first]
    none = np.zeros(0, np.int64)
    best = (none, none, none)
    if not pairs:
        return best
    owner, lists = np.array(pairs, dtype=np.int64).T
    # intervals, and per interval the stretches of its lists: [low, high) and the largest impact
    low, high = shard.start[lists], shard.start[lists + 1]
    heads = _heads(owner)
    item = owner[heads]
    group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(owner))))
    largest = shard.largest(low, high)
    bound = np.add.reduceat(largest >> shard.bits, heads)
    floor = np.maximum(least, 1)
    nth_doc = np.full(len(floor), shard.span)
    width = 2
    while len(item):
        # the best intervals of each item
        order = np.lexsort((-bound, item))
        at = _heads(item[order])
        nth = np.arange(len(order)) - np.repeat(at, np.diff(np.append(at, len(order))))
        chosen = np.zeros(len(item), dtype=bool)
        chosen[order[nth < width]] = True
        width *= 2
        mine = chosen[group]
        a, b, top, g = low[mine], high[mine], largest[mine], group[mine]
        heads = _heads(g)
        within = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(g))))
        middle = shard.doc[shard.mask - (np.maximum.reduceat(top, heads) & shard.mask)]
        place = np.searchsorted(shard.key, shard.list_of[a] * shard.span + middle[within])
        hit = place < b
        hit[hit] = shard.doc[place[hit]] == middle[within[hit]]
        score = np.add.reduceat(np.where(hit, shard.impact[np.minimum(place, shard.n - 1)], 0), heads)
        who = item[g[heads]]
        seen = score >= floor[who]
        best = _best(*(np.concatenate(x) for x in zip(best, (who[seen], score[seen], middle[seen]), strict=True)), k)
        # the k-th best of an item, and its document
        at = _heads(best[0])
        full = np.diff(np.append(at, len(best[0]))) == k
        last = at[full] + k - 1
        floor[best[0][last]] = best[1][last]
        nth_doc[best[0][last]] = best[2][last]
        # both sides of every chosen interval
        sides = [(a, place, within), (place + hit, b, within + len(heads))]
        new_low, new_high, side = (np.concatenate(x) for x in zip(*sides, strict=True))
        there = new_high > new_low
        new_low, new_high, side = new_low[there], new_high[there], side[there]
        new_largest = shard.largest(new_low, new_high)
        heads = _heads(side)
        new_item = np.concatenate([who, who])[side[heads]]
        new_bound = np.add.reduceat(new_largest >> shard.bits, heads) if len(heads) else none
        # joined with the intervals that were not chosen
        rest = ~mine
        new_group = len(item) + np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(side))))
        group = np.concatenate([group[rest], new_group])
        low, high = np.concatenate([low[rest], new_low]), np.concatenate([high[rest], new_high])
        largest = np.concatenate([largest[rest], new_largest])
        heads = _heads(group)
        item, bound = np.concatenate([item[~chosen], new_item]), np.concatenate([bound[~chosen], new_bound])
        if not len(item):
            break
        # kept: bounded above the k-th best, or equal to it with an earlier document
        ahead = np.minimum.reduceat(shard.doc[low], heads) < nth_doc[item]
        keep = (bound > floor[item]) | ((bound == floor[item]) & ahead)
        stay = np.repeat(keep, np.diff(np.append(heads, len(group))))
        low, high, largest = low[stay], high[stay], largest[stay]
        heads = _heads(group[stay])
        group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(low))))
        item, bound = item[keep], bound[keep]
    return best


def _together(items: list[list[int]]) -> list[slice]:
    """Consecutive items of at most ``ITEM_TERMS`` terms or one item."""
    starts, held = [0], 0
    for i, terms in enumerate(items):
        if held and held + len(terms) > ITEM_TERMS:
            starts.append(i)
            held = 0
        held += len(terms)
    return [slice(a, b) for a, b in zip(starts, [*starts[1:], len(items)], strict=True)]


def _weights(index: LexicalIndex, asked: DataFrame) -> DataFrame:
    """(term, weight) of asked terms (term) that occur; without those that weigh nothing."""
    listed = index.shards.select(F.inline(F.arrays_zip("terms", "sizes")))
    found = listed.join(broadcast_if_small(asked, F.octet_length("term") + 16), F.col("terms") == F.col("term"))
    df = found.groupBy("term").agg(F.sum("sizes").alias("df"))
    share = (F.lit(2.0) * index.n_docs + 2) / (F.lit(2.0) * F.col("df") + 1)
    return df.select("term", F.floor(F.lit(1000.0) * F.log(share)).alias("weight")).where("weight > 0")


def _search(index: LexicalIndex, shards: DataFrame, block: list, least: list[int], k: int) -> DataFrame:
    """(row, id, score) of candidates for the items (row, terms, weights) of a block."""
    number = {t: i for i, t in enumerate(dict.fromkeys(t for r in block for t in r["terms"]))}
    weights = {t: (number[t], w) for r in block for t, w in zip(r["terms"], r["weights"], strict=True)}
    items = [[number[t] for t in r["terms"]] for r in block]
    shared = index.shards.sparkSession.sparkContext.broadcast((weights, items, least, [r["row"] for r in block]))
    n_docs, n_terms = index.n_docs, index.n_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        weights, items, least, names = shared.value
        floor = np.array(least, dtype=np.int64)
        tops = np.zeros((len(items), 0), dtype=np.int64)  # best scores of the task so far
        names = np.array(names, dtype=np.int64)
        together = _together(items)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: c[i].values for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                shard = _Shard(row, weights, n_docs, n_terms)
                parts = [(s.start, search_shard(shard, items[s], floor[s], k)) for s in together]
                item = np.concatenate([start + part[0] for start, part in parts])
                score, doc = (np.concatenate([part[n] for _, part in parts]) for n in (1, 2))
                found = np.zeros((len(items), k), dtype=np.int64)
                heads = _heads(item)
                nth = np.arange(len(item)) - np.repeat(heads, np.diff(np.append(heads, len(item))))
                found[item, nth] = score
                tops = -np.sort(-np.hstack([tops, found]), axis=1)[:, :k]
                floor = np.maximum(floor, tops[:, k - 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[item]), row["ids"].take(pa.array(doc)), pa.array(score)], ["row", "id", "score"]
                )
        tidy()

    fields = [("row", T.LongType()), ("id", index.id_type), ("score", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    found = _ranked(narrow_batches(shards).mapInArrow(run, schema), k)
    written = materialize(found)
    shared.destroy()
    return written


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each item, with their rank."""
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    index: LexicalIndex,
    items: DataFrame,
    text_col: str = "text",
    k: int = BEST,
    out_col: str = "doc_id",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` best documents of each row of ``items``, one row each: its columns, ``rank``, id and ``score``.

    Terms, weights and scores are those of the module's contract, in 64-bit integers:
    only documents with a score above 0 are returned, equal scores by ascending id with
    NULL last. Rows of ``items`` are items: repeated ones are answered each. Items
    without a term that occurs (NULL and empty texts too) have no rows, and an empty
    index or item table gives an empty result. Columns that bear an output's name are replaced.
    """
    numbered = materialize(items.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("item")))
    texts = numbered.select("row", F.col("item").getField(text_col).cast("string").alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [list(term_counts(x)) for x in batch.column("text").to_pylist()]
            columns = [batch.column("row"), pa.array(terms, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "terms"])

    listed = narrow_batches(texts).mapInArrow(split, "row bigint, terms array<binary>")
    asked = materialize(listed.select("row", F.explode("terms").alias("term")))
    weights = materialize(_weights(index, materialize(asked.select("term").distinct())))
    weighted = asked.join(weights, "term")
    size = weighted.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0
    blocks = 2 * size // block_bytes + 1
    per_item = materialize(
        weighted.groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("all"))
        .select(
            "row",
            F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"),
            F.col("all.term").alias("terms"),
            F.col("all.weight").alias("weights"),
        )
    )
    apart = max(4, index.shards.count() // PROBED_SHARDS)
    some = index.shards.where(F.pmod(F.xxhash64("ids"), F.lit(apart)) == 0)
    results = []
    for number in range(blocks):
        block = per_item.where(F.col("block") == number).drop("block").collect()
        if not block:
            continue
        probed = _search(index, some, block, [1] * len(block), k)
        bounds = {r["row"]: r["score"] for r in probed.where(F.col("rank") == k).collect()}
        results.append(_search(index, index.shards, block, [bounds.get(r["row"], 1) for r in block], k))
    if not results:
        kinds = [T.StructField("row", T.LongType()), T.StructField("id", index.id_type)]
        kinds += [T.StructField("score", T.LongType()), T.StructField("rank", T.IntegerType())]
        results.append(items.sparkSession.createDataFrame([], T.StructType(kinds)))
    found = reduce(DataFrame.unionByName, results)
    kept = [F.col("item").getField(c).alias(c) for c in items.columns if c not in (*OUTPUTS, out_col)]
    return numbered.join(found, "row").select(*kept, "rank", F.col("id").alias(out_col), "score")
