"""Removal of repeated byte strings with a logarithmic family of anchor indexes.

Every byte is removed that lies in a string of ``length`` bytes which starts
anywhere else, too. Suffixes are sampled: of each ``length`` bytes, the suffix whose
first ``ANCHOR`` bytes hash lowest is taken (an anchor). The choice depends on these
bytes alone, so two equal strings choose the same place and no repeat is missed,
while only about one suffix in a hundred is kept.

No suffix array is built. A batch's run is the table of its anchors in the order of a
64-bit hash of their bytes, not of the bytes themselves. It is joined with the levels
that exist for anchors that occur there (or twice in the batch), and becomes a level;
two levels of equal size are merged into one of twice the size before the next batch,
so a batch meets a logarithmic number of levels. Suffixes in the order of their bytes
would need their first hundred bytes in every run, about as much as the text itself.

Only matched anchors are looked at closer. Their surroundings, from ``length -
ANCHOR`` bytes before to ``length`` bytes after, decide all strings that hold the
anchor. Where the whole surroundings repeat (64-bit hashes of the anchor and of all
of it), all of these do. Surroundings that differ are compared string by string, per
anchor, by two 64-bit hashes, in numpy. Anchors with very many different surroundings
are split by the distances at which a string may start before them: strings of one half of
the distances all hold some further bytes before or after the anchor, so only surroundings
with equal such bytes need to meet. Of those that agree on all bytes of the half's strings
one goes on. This is repeated with halves of halves until groups are small.

Memory: texts longer than a shard are hashed in overlapping pieces. Every stage has at
most one Python step, because each such step has a worker of its own per core: texts
are tested against the Bloom filter in the step that reads or cuts them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm.bloom import build_filter, passes
from assetloom.llm.common import narrow_batches, same, text_of
from assetloom.llm.numtext import (
    BASES,
    U64,
    mix,
    powers,
    prefix_hash,
    range_hash,
    slices,
    sliding,
    text_slices,
    tidy,
    utf8,
)
from assetloom.session import materialize

LENGTH = 400
BATCHES = 4
SHARD_BYTES = 1 << 20
# different surroundings of one anchor that a task compares by itself
GROUP_ROWS = 8_000
# keys with more rows than that which go to every task of a join
HEAVY_KEYS = 1_000
# rows of surroundings that are compared at once, if their anchors allow
COMPARED_ROWS = 2_000
# rows of surroundings whose running hashes are held at once
GRID_ROWS = 500
# bytes of text that are cut at once
CUT_BYTES = 4 << 20
OUTPUTS = ("n_bytes", "spans", "kept_bytes")

_INT, _LONG = T.IntegerType(), T.LongType()


def _fields(**kinds: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, kind) for name, kind in kinds.items()]


_ANCHORS = T.ArrayType(T.StructType(_fields(pos=_INT, tail=_INT, h=_LONG, c=_LONG)))
_SPANS = T.ArrayType(T.StructType(_fields(lo=_INT, hi=_INT)))


def anchor_bytes(length: int) -> int:
    return max(1, length // 4)


def find_anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """Anchors of consecutive texts: text, place, bytes to the end of the surroundings, hash of the
    anchor, hash of its surroundings."""
    anchor = anchor_bytes(length)
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    first, second = prefix_hash(data, BASES[0]), prefix_hash(data, BASES[1])
    at = np.arange(n - anchor + 1)
    value = range_hash(first, at, at + anchor, BASES[0]) | U64(1)
    lowest = sliding(value, length - anchor + 1, np.minimum)  # for every start of a string
    starts, ends = offsets[:-1], offsets[1:]
    edge = np.zeros(n + 1, np.int64)
    sized = ends > starts
    np.add.at(edge, np.maximum(starts, ends - length + 1)[sized], 1)
    np.add.at(edge, ends[sized], -1)
    lowest[np.cumsum(edge)[: len(lowest)] > 0] = 0  # strings that would leave their text
    reach = length - anchor
    padded = np.concatenate([np.zeros(reach, U64), lowest, np.zeros(reach, U64)])
    places = np.flatnonzero(sliding(padded, reach + 1, np.maximum)[: len(value)] == value)
    doc = np.searchsorted(offsets, places, side="right") - 1
    low = np.maximum(starts[doc], places - reach)
    high = np.minimum(ends[doc], places + length)
    around = range_hash(second, low, high, BASES[1])
    around = mix(around + ((places - low) * 4096 + (high - low)).astype(U64))
    return doc, places - starts[doc], high - places, value[places].astype(np.int64), around.astype(np.int64)


def piece_anchors(data: np.ndarray, offsets: np.ndarray, length: int, piece: int):
    """``find_anchors`` of texts of which a long one is alone: it is taken in pieces that overlap.

    A piece's own places need ``length`` bytes on both sides, whatever lies further off.
    """
    if len(data) <= 2 * piece:
        return find_anchors(data, offsets, length)
    found = []
    for low in range(0, len(data), piece):
        start, stop = max(0, low - length), min(len(data), low + piece + length)
        doc, pos, *rest = find_anchors(data[start:stop], np.array([0, stop - start]), length)
        pos = pos + start
        own = (pos >= low) & (pos < low + piece)
        found.append([doc[own], pos[own], *(x[own] for x in rest)])
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """(id, digest, anchors) of documents (id, digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        kind = pa.struct([("pos", pa.int32()), ("tail", pa.int32()), ("h", pa.int64()), ("c", pa.int64())])
        for part in text_slices(batches, "text", SHARD_BYTES):
            data, offsets = utf8(part.column("text").cast(pa.large_string()))
            long = part.num_rows == 1
            doc, pos, tail, h, c = piece_anchors(data, offsets, length, SHARD_BYTES if long else len(data) + 1)
            values = pa.StructArray.from_arrays(
                [pa.array(pos.astype(np.int32)), pa.array(tail.astype(np.int32)), pa.array(h), pa.array(c)],
                fields=list(kind),
            )
            ends = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    part.column("digest"),
                    pa.ListArray.from_arrays(pa.array(ends), values),
                ],
                ["id", "digest", "anchors"],
            )
        tidy()

    kind = docs.schema["id"].dataType
    schema = T.StructType(_fields(id=kind, digest=_LONG, anchors=_ANCHORS))
    return narrow_batches(docs).mapInArrow(run, schema)


class SuffixIndex:
    """Levels of sorted anchors. ``add`` returns the anchors by which a batch repeats what is known."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []  # (batches held, table), largest first

    def add(self, anchors: DataFrame) -> DataFrame:
        """Anchors (column h) of the batch that occur in a level, or more than once in the batch."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            merged = a.unionByName(b).groupBy("h").agg(F.sum("n").alias("n"))
            self.levels.append((n + m, materialize(merged.sortWithinPartitions("h"))))
        run = materialize(
            anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("h")
        )
        found = run.where(F.col("n") > 1).select("h")
        for _, level in self.levels:
            found = found.unionByName(run.select("h").join(level.select("h"), "h", "left_semi"))
        self.levels.append((1, run))
        return materialize(found)


# an anchor's place with its surroundings, for strings that start ``lo`` up to ``hi`` bytes before it
_ENTRY = _fields(
    doc=_LONG, pos=_INT, left=_INT, h=_LONG, once=T.BooleanType(), around=T.BinaryType(), lo=_INT, hi=_INT
)


def _strings(left: np.ndarray, around: pa.Array, length: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all strings of surroundings, one column per distance from their start to the anchor.

    Only hashes of one column can be compared. The second array tells which exist.
    """
    reach = length - anchor_bytes(length)
    data, offsets = utf8(around.cast(pa.large_binary()))
    sizes = np.diff(offsets)
    hashes = np.empty((len(left), reach + 1), U64)
    weights = powers(base, reach + length)
    for low in range(0, len(left), GRID_ROWS):
        rows = slice(low, low + GRID_ROWS)
        n = sizes[rows]
        grid = np.zeros((len(n), reach + length + 1), U64)
        row = np.repeat(np.arange(len(n)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = inner + np.repeat(reach - left[rows], n)  # the anchor starts at column `reach`
        flat = data[offsets[low] : offsets[low] + n.sum()].astype(U64) + U64(1)
        grid[row, at + 1] = flat * weights[at]
        np.cumsum(grid, axis=1, out=grid)
        hashes[rows] = grid[:, length : length + reach + 1][:, ::-1] - grid[:, : reach + 1][:, ::-1]
    distance = np.arange(reach + 1)
    there = (distance <= left[:, None]) & (length - distance <= (sizes - left)[:, None])
    return hashes, there


def _resolve(entries: pa.Table, length: int) -> pa.RecordBatch:
    """Spans of the surroundings that occur once, from strings they share with others of their anchor."""
    left = entries.column("left").to_numpy().astype(np.int64)
    h = entries.column("h").to_numpy().astype(np.int64)
    around = pa.concat_arrays([x.cast(pa.large_binary()) for x in entries.column("around").chunks])
    hashes, there = _strings(left, around, length, BASES[1])
    second, _ = _strings(left, around, length, BASES[0])
    distances = np.arange(there.shape[1])
    there &= distances >= entries.column("lo").to_numpy()[:, None]
    there &= distances < entries.column("hi").to_numpy()[:, None]
    salt = mix(h.astype(U64))
    hit = np.zeros(there.shape, dtype=bool)
    for distance in range(hashes.shape[1]):
        rows = np.flatnonzero(there[:, distance])
        key = mix(hashes[rows, distance] ^ salt[rows])
        order = np.lexsort((second[rows, distance], key))
        rows, key = rows[order], key[order]
        equal = (key[1:] == key[:-1]) & (h[rows[1:]] == h[rows[:-1]])
        equal &= second[rows[1:], distance] == second[rows[:-1], distance]
        hit[rows[1:][equal], distance] = True
        hit[rows[:-1][equal], distance] = True
    hit[~entries.column("once").to_numpy(zero_copy_only=False)] = False
    # runs of strings, in the order of their starts
    hit = hit[:, ::-1]
    step = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(step == 1)
    _, past = np.nonzero(step == -1)
    base = entries.column("pos").to_numpy().astype(np.int64)[row] - (hit.shape[1] - 1)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(entries.column("doc").to_numpy()[row]),
            pa.array((base + first).astype(np.int32)),
            pa.array((base + past - 1 + length).astype(np.int32)),
        ],
        ["doc", "lo", "hi"],
    )


def _name(id_col: str, digest_col: str) -> Column:
    """A document's 64-bit name, for Bloom filters alone."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{digest_col}`"))


def _only(docs: DataFrame, name: Column, words: Broadcast, hit: bool) -> DataFrame:
    """Rows of ``docs`` whose name may be in a Bloom filter, or (``hit`` false) surely is not, in one Python step."""
    fields = docs.schema.fields
    own, bits = _unused(docs.columns, "name"), _unused(docs.columns, "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            digests, spread = (batch.column(batch.schema.names.index(c)).to_numpy() for c in (own, bits))
            kept = batch.filter(pa.array(passes(words.value, digests, spread) == hit))
            yield pa.RecordBatch.from_arrays(kept.columns[: len(fields)], kept.schema.names[: len(fields)])

    named = docs.withColumn(own, name)
    return narrow_batches(named.withColumn(bits, F.xxhash64(own))).mapInArrow(run, T.StructType(fields))


def _unused(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column bears it."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def _filter(names: DataFrame) -> Broadcast:
    """Bloom filter of a column ``name``; its size is bounded."""
    return names.sparkSession.sparkContext.broadcast(build_filter(names, "name"))


def _surroundings(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes around anchors. ``wanted`` holds, per document, codes: twice the place, plus one if it occurs once."""
    anchor, reach = anchor_bytes(length), length - anchor_bytes(length)
    # only texts that may be wanted are shuffled; the join is never a broadcast, so that no stage has two Python steps
    words = _filter(wanted.select(_name("wanted_id", "wanted_digest").alias("name")))
    maybe = _only(docs, _name("id", "digest"), words, True)
    joined = maybe.join(wanted.hint("merge"), same(maybe, wanted, {"id": "wanted_id", "digest": "wanted_digest"}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        weights = powers(BASES[0], anchor)[:anchor]
        for part in text_slices(batches, "text", SHARD_BYTES // 4):
            data, offsets = utf8(part.column("text").cast(pa.large_string()))
            codes = part.column("codes")
            docs_of = np.repeat(np.arange(part.num_rows), codes.value_lengths().to_numpy(zero_copy_only=False))
            all_codes = codes.flatten().to_numpy()
            for k in range(0, len(all_codes), COMPARED_ROWS):
                doc, code = docs_of[k : k + COMPARED_ROWS], all_codes[k : k + COMPARED_ROWS]
                at = offsets[doc] + (code >> 1)
                low, high = np.maximum(offsets[doc], at - reach), np.minimum(offsets[doc + 1], at + length)
                bytes_ = data[at[:, None] + np.arange(anchor)].astype(U64) + U64(1)
                h = mix((bytes_ * weights).sum(axis=1, dtype=U64)) | U64(1)
                around = pa.array([data[a:b].tobytes() for a, b in zip(low, high, strict=True)], pa.binary())
                columns = [
                    part.column("doc").take(pa.array(doc)),
                    pa.array((code >> 1).astype(np.int32)),
                    pa.array((at - low).astype(np.int32)),
                    pa.array(h.astype(np.int64)),
                    pa.array((code & 1).astype(bool)),
                    around,
                    pa.array(np.zeros(len(at), np.int32)),
                    pa.array(np.full(len(at), reach + 1, np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in _ENTRY])
        tidy()

    return narrow_batches(joined.select("doc", "text", "codes")).mapInArrow(run, T.StructType(_ENTRY))


def _compare(entries: DataFrame, length: int) -> DataFrame:
    """Spans (doc, lo, hi) found by comparing surroundings, all of an anchor in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for part in slices(batch, np.ones(batch.num_rows), COMPARED_ROWS):
                h = part.column("h").to_numpy()
                cut = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
                before = bool(held) and held[-1].column("h")[-1].as_py() != h[0]
                if before and rows + cut > COMPARED_ROWS:
                    yield _resolve(pa.Table.from_batches(held), length)
                    held, rows = [], 0
                if cut and rows + cut >= COMPARED_ROWS // 2:
                    yield _resolve(pa.Table.from_batches([*held, part.slice(0, cut)]), length)
                    held, rows, part = [], 0, part.slice(cut)
                held.append(part)
                rows += part.num_rows
        if held:
            yield _resolve(pa.Table.from_batches(held), length)
        held = []
        tidy()

    sorted_ = entries.repartition("h").sortWithinPartitions("h")
    return narrow_batches(sorted_).mapInArrow(run, T.StructType(_fields(doc=_LONG, lo=_INT, hi=_INT)))


def _dealt(rows: DataFrame, keys: DataFrame, on: list[str], weight: str) -> DataFrame:
    """``rows.join(keys, on)`` for distinct ``keys``, without gathering the rows of a heavy key.

    ``weight`` is a column of ``keys``: how many rows each has. The heaviest go to every task, so their
    rows stay where they are; of the others none has more than a part in ``HEAVY_KEYS`` of all rows, or
    ``GROUP_ROWS``.
    """
    heavy = keys.where(F.col(weight) > GROUP_ROWS).orderBy(F.desc(weight), *on).limit(HEAVY_KEYS)
    heavy = materialize(heavy)
    if heavy.isEmpty():
        return rows.join(keys, on)
    light = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(keys, on)
    return rows.join(F.broadcast(heavy), on).unionByName(light)


def _halved(entries: DataFrame, length: int) -> DataFrame:
    """Two entries for one, each for half of its distances; those without any such string are left out.

    ``h`` becomes the hash of the bytes that all strings of a half hold, ``cover`` that of the bytes
    that any of them holds.
    """
    anchor, reach = anchor_bytes(length), length - anchor_bytes(length)

    def digest(data: bytes, *numbers: int) -> int:
        name = struct.pack(f"<{len(numbers)}q", *numbers)
        whole = blake2b(data + name, digest_size=8).digest()
        return int.from_bytes(whole, "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in _ENTRY]
        for batch in batches:
            for part in slices(batch, np.ones(batch.num_rows), COMPARED_ROWS):
                out: list[list] = [[] for _ in range(5)]
                columns = [part.column(c).to_pylist() for c in ("left", "h", "around", "lo", "hi")]
                for k, (left, h, around, lo, hi) in enumerate(zip(*columns, strict=True)):
                    middle = (lo + hi) // 2
                    for a, b in ((lo, middle), (middle, hi)):
                        begin, end = left - a, left + anchor + reach - b + 1
                        if a >= b or begin < 0 or end > len(around):
                            continue
                        low, high = max(0, left - b + 1), min(len(around), left + anchor + reach - a)
                        cover = digest(around[low:high], a, b, left - low)
                        for column, x in zip(out, (k, digest(around[begin:end], h, a, b), a, b, cover), strict=True):
                            column.append(x)
                some = part.take(pa.array(out[0], pa.int64()))
                some = some.set_column(names.index("h"), "h", pa.array(out[1], pa.int64()))
                some = some.set_column(names.index("lo"), "lo", pa.array(out[2], pa.int32()))
                some = some.set_column(names.index("hi"), "hi", pa.array(out[3], pa.int32()))
                yield some.append_column("cover", pa.array(out[4], pa.int64()))

    schema = T.StructType([*_ENTRY, T.StructField("cover", _LONG)])
    return narrow_batches(entries.select(*[f.name for f in _ENTRY])).mapInArrow(run, schema)


def _split(entries: DataFrame, length: int) -> DataFrame:
    """Spans (doc, lo, hi) of entries whose anchors have too many different surroundings for one task."""
    found = []
    while True:
        halves = materialize(_halved(entries, length))
        kinds = materialize(
            halves.groupBy("h", "cover").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "pos")).alias("one"))
        )
        # the same bytes all over: every string of this half repeats
        several = kinds.where(F.col("n") > 1).select("h", "cover", "n")
        again = _dealt(halves, several, ["h", "cover"], "n")
        furthest = F.least(F.col("hi") - 1, F.col("left"))
        nearest = F.greatest(F.col("lo"), F.lit(length) - (F.octet_length("around") - F.col("left")))
        found.append(
            again.where("once").select(
                "doc", (F.col("pos") - furthest).alias("lo"), (F.col("pos") - nearest + length).alias("hi")
            )
        )
        # different ones: through one place each
        sizes = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
        met = _dealt(kinds, materialize(sizes), ["h"], "rows").select("h", "cover", "n", "rows", "one.doc", "one.pos")
        ones = halves.join(met, ["h", "cover", "doc", "pos"]).withColumn("once", F.col("once") & (F.col("n") == 1))
        ones = materialize(ones.select("rows", *[f.name for f in _ENTRY]))
        found.append(_compare(ones.where(F.col("rows") <= GROUP_ROWS).drop("rows"), length))
        entries = ones.where(F.col("rows") > GROUP_ROWS).drop("rows")
        if entries.isEmpty():
            return reduce(DataFrame.unionByName, found)


def _joined(spans: DataFrame) -> DataFrame:
    """(doc, spans): the spans (doc, lo, hi) of a document as maximal runs, in order."""
    by_start = Window.partitionBy("doc").orderBy("lo", "hi")
    reached = F.max("hi").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(reached.isNull() | (F.col("lo") > reached), 1).otherwise(0)
    runs = spans.withColumn("new", apart).withColumn(
        "run", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    )
    merged = runs.groupBy("doc", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    listed = merged.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    return listed.select("doc", F.col("spans").cast(_SPANS).alias("spans"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """Removed spans (id, digest, spans) of documents (id, digest, text); documents without any are left out."""
    anchors = materialize(
        _anchors(docs, length)
        .where(F.size("anchors") > 0)
        .withColumn("batch", F.pmod(F.xxhash64("id", "digest"), F.lit(batches)))
        .withColumn("doc", F.monotonically_increasing_id())
    )
    flat = anchors.select("doc", "batch", F.inline("anchors"))
    index, scans = SuffixIndex(), []
    for k in range(batches):
        scans.append(index.add(flat.where(F.col("batch") == k).select("h")))
    matched = materialize(reduce(DataFrame.unionByName, scans).distinct())
    places = materialize(flat.drop("batch").join(matched, "h", "left_semi"))

    # equal surroundings: every string that holds the anchor repeats
    kinds = materialize(
        places.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "pos")).alias("one"))
    )
    reach = length - anchor_bytes(length)
    whole = _dealt(places, kinds.where(F.col("n") > 1).select("h", "c", "n"), ["h", "c"], "n").select(
        "doc",
        F.greatest(F.col("pos") - reach, F.lit(0)).alias("lo"),
        (F.col("pos") + F.col("tail")).alias("hi"),
    )
    # different ones: compared through one place each
    several = (
        kinds.groupBy("h")
        .agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
        .where((F.col("kinds") > 1) & (F.col("least") == 1))
        .select("h", "kinds")
    )
    wanted = materialize(
        _dealt(kinds, materialize(several), ["h"], "kinds").select(
            "one.doc",
            (F.col("kinds") > GROUP_ROWS).alias("hot"),
            (F.col("one.pos").cast("long") * 2 + F.when(F.col("n") == 1, 1).otherwise(0)).alias("code"),
        )
    )
    names = anchors.select("doc", F.col("id").alias("wanted_id"), F.col("digest").alias("wanted_digest"))

    def surroundings(codes: DataFrame) -> DataFrame:
        by_doc = codes.groupBy("doc").agg(F.collect_list("code").alias("codes"))
        return _surroundings(docs, materialize(by_doc.join(names, "doc")), length)

    partly = _compare(surroundings(wanted.where(~F.col("hot"))), length)
    if not wanted.where("hot").isEmpty():
        partly = partly.unionByName(_split(surroundings(wanted.where("hot")), length))
    found = materialize(whole.unionByName(partly).distinct())
    spans = _joined(found).join(names, "doc").select(
        F.col("wanted_id").alias("id"), F.col("wanted_digest").alias("digest"), "spans"
    )
    # rows that repeat an id and a text have the same spans
    return materialize(spans.dropDuplicates(["id", "digest"]))


def remove_repeats(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    length: int = LENGTH,
    batches: int = BATCHES,
) -> DataFrame:
    """All rows of ``docs`` with ``n_bytes``, ``spans`` (removed, maximal) and ``kept_bytes`` added.

    Texts are UTF-8 bytes; strings never cross documents. A byte is removed when a
    string of ``length`` bytes around it starts anywhere else in the input, the same
    document included. What is left may begin or end within a character, so it is binary.

    NULL and empty texts, and texts shorter than ``length``, lose nothing. Rows are
    documents: rows that repeat a text, whatever their ids, remove each other's text
    whole if it is long enough. An empty table gives an empty result. Columns that
    bear an output's name are replaced.
    """
    digest = F.xxhash64(text_of(text_col))
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), digest.alias("digest"), text_of(text_col).alias("text"))
    spans = repeated_spans(plain, length, batches)
    base = docs.drop(*[c for c in OUTPUTS if c not in (text_col, id_col)])
    words = _filter(spans.select(_name("id", "digest").alias("name")))
    name = F.xxhash64(F.col(f"`{id_col}`"), digest)
    own = _unused([*base.columns, *OUTPUTS], "own")
    wanted_id, wanted_digest = (_unused([*base.columns, *OUTPUTS], f"wanted_{c}") for c in ("id", "digest"))
    wanted = spans.select(F.col("id").alias(wanted_id), F.col("digest").alias(wanted_digest), "spans")
    some = _only(base, name, words, True).withColumn(own, digest)
    # a document that surely has no span is not shuffled; the join is never a broadcast, for one Python step a stage
    some = some.join(wanted.hint("merge"), same(some, wanted, {id_col: wanted_id, own: wanted_digest}), "left")
    some = some.drop(own, wanted_id, wanted_digest)
    more = [T.StructField("n_bytes", T.LongType()), T.StructField("kept_bytes", T.BinaryType())]
    schema = T.StructType([*base.schema.fields, T.StructField("spans", _SPANS), *more])
    width = len(base.columns)
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def cut(part: pa.RecordBatch, found: list) -> pa.RecordBatch:
        data, offsets = utf8(part.column(part.schema.names.index(text_col)).cast(pa.large_string()))
        kept = []
        for k, spans in enumerate(found):
            text = data[offsets[k] : offsets[k + 1]].tobytes()
            at, pieces = 0, []
            for x in spans or ():
                pieces.append(text[at : x["lo"]])
                at = x["hi"]
            kept.append(b"".join([*pieces, text[at:]]))
        columns = [pa.array([x or [] for x in found], kind), pa.array(np.diff(offsets)), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays([*part.columns[:width], *columns], schema.names)

    def with_spans(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for part in text_slices(parts, text_col, CUT_BYTES):
            yield cut(part, part.column(width).to_pylist())
        tidy()

    def without(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for part in text_slices(parts, text_col, CUT_BYTES):
            digests, spread = (part.column(width + k).to_numpy() for k in (0, 1))
            rest = part.filter(pa.array(~passes(words.value, digests, spread)))
            if rest.num_rows:
                yield cut(rest, [None] * rest.num_rows)
        tidy()

    bits = _unused([*base.columns, own], "bits")
    plain = base.withColumn(own, name).withColumn(bits, F.xxhash64(own))
    return (
        narrow_batches(some)
        .mapInArrow(with_spans, schema)
        .unionByName(narrow_batches(plain).mapInArrow(without, schema))
    )
