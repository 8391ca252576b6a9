"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A document is its set of word shingles. Documents with the same set form a class
and are compared once. A class has a MinHash signature, dealt to ``TREES`` tries of
depth ``DEPTH``. Two classes are candidates when they share a path from the root of
a trie. How far prefixes have to be shortened is known beforehand: a pair at the
threshold must be found with the target recall, whatever the data. Longer prefixes lie
within shorter ones, so the rounds in between would find no other pair, and one grouping
by the final prefix does; no trie is sorted or walked. A threshold that no
prefix serves is refused.

Members of a trie node are compared in blocks, so a large node becomes many tasks of
bounded size. A pair is taken up in the first trie that joins it. Signatures first
drop pairs that are far from the threshold; what is left is verified on the shingle
sets themselves, in memory: tasks give link counts and spanning links only, never
the pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm.common import broadcast_if_small, id_order, narrow_batches, own_prefix, same, text_of
from assetloom.llm.components import components
from assetloom.llm.numtext import BASES, U64, mix, powers, text_slices, tidy, utf8, words
from assetloom.session import materialize

TREES, DEPTH = 24, 6
RECALL = 0.99999
SHARD_BYTES = 1 << 20
BLOCK = 512  # members of a trie node that meet another such block in one task
OUTPUTS = ("class_id", "n_links")

_INT, _LONG, _BINARY = T.IntegerType(), T.LongType(), T.BinaryType()


def _fields(**kinds: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, kind) for name, kind in kinds.items()]


def prefix_depth(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """Longest shared path at which a pair at the threshold is found with the target recall."""
    for d in range(depth, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    raise ValueError(f"{trees} trees do not find pairs at {threshold} with recall {recall}: ask for less recall")


def _family(size: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * size + 1, dtype=U64) * U64(BASES[0]))
    return seeds[:size] | U64(1), seeds[size:]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text; a shorter text is one n-gram."""
    (tokens,), counts = words(data, offsets)
    weights = powers(BASES[1], n)
    rolled = np.zeros(max(len(tokens) - n + 1, 0), U64)
    for j in range(n):
        rolled += tokens[j : j + len(rolled)] * weights[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(counts[:-1], counts[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            short = np.sum(tokens[a:b] * weights[: b - a], dtype=U64) + U64(b - a)
            out.append(mix(np.array([short], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def signature(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """MinHash values, 32 bits each."""
    a, b = family
    low = np.full(len(a), np.iinfo(np.uint64).max, U64)
    for k in range(0, len(shingles), 512):
        grid = np.multiply.outer(a, shingles[k : k + 512])
        grid += b[:, None]
        np.minimum(low, grid.min(axis=1), out=low)
    return (low >> U64(32)).astype("<u4")


def prefix_keys(signatures: np.ndarray, depth: int) -> np.ndarray:
    """One key per trie: its number and the first ``depth`` values of its path."""
    paths = signatures.reshape(len(signatures), TREES, DEPTH)[:, :, :depth].astype(U64)
    keys = np.broadcast_to(np.arange(TREES, dtype=U64) + U64(1), paths.shape[:2]).copy()
    for d in range(depth):
        keys = mix(keys * U64(BASES[0]) + paths[:, :, d])
    return keys.astype(np.int64)


def _digests(docs: DataFrame, n: int, depth: int) -> DataFrame:
    """Size, fingerprint, signature and trie keys of the set of every document (id, digest, text)."""
    more = _fields(size=_INT, f1=_LONG, f2=_LONG, sig=_BINARY, keys=T.ArrayType(_LONG))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        family = _family(TREES * DEPTH)
        for part in text_slices(batches, "text", SHARD_BYTES):
            data, offsets = utf8(part.column("text").cast(pa.large_string()))
            sets = shingle_sets(data, offsets, n)
            sigs = np.stack([signature(x, family) for x in sets])
            f1 = [int(x.sum(dtype=U64).astype(np.int64)) for x in sets]
            f2 = [int(mix(x * U64(BASES[0])).sum(dtype=U64).astype(np.int64)) for x in sets]
            keys = prefix_keys(sigs, depth)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    part.column("digest"),
                    pa.array([len(x) for x in sets], pa.int32()),
                    pa.array(f1, pa.int64()),
                    pa.array(f2, pa.int64()),
                    pa.array([x.tobytes() for x in sigs], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * TREES, keys.ravel()),
                ],
                ["id", "digest", *(f.name for f in more)],
            )

    return narrow_batches(docs).mapInArrow(run, T.StructType([docs.schema["id"], docs.schema["digest"], *more]))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
    """Runs of rows with equal (key, i, j), as dictionaries of arrays."""
    held: list[dict] = []

    def arrays(batch: pa.RecordBatch) -> dict:
        out = {}
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            if name == "sig":
                data, _ = utf8(column.cast(pa.large_binary()))
                out[name] = data.view("<u4").reshape(batch.num_rows, TREES * DEPTH)
            elif name == "shingles":
                ends = column.offsets.to_numpy()
                values = column.values.to_numpy()
                out[name] = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            else:
                out[name] = column.to_numpy()
        return out

    def joined(parts: list[dict]) -> dict:
        if len(parts) == 1:
            return parts[0]
        return {
            k: [x for p in parts for x in p[k]] if k == "shingles" else np.concatenate([p[k] for p in parts])
            for k in parts[0]
        }

    for batch in batches:
        if not batch.num_rows:
            continue
        all_ = arrays(batch)
        names = ("key", "i", "j")
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = np.any([all_[k][1:] != all_[k][:-1] for k in names], axis=0)
        starts = np.flatnonzero(new).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            part = {k: v[a:b] for k, v in all_.items()}
            if held and any(held[-1][k][0] != part[k][0] for k in names):
                yield joined(held)
                held = []
            held.append(part)
    if held:
        yield joined(held)


def _pairs(group: dict, depth: int, lowest: float) -> np.ndarray:
    """Matrix of the pairs that this node has to verify: not met in an earlier trie, signatures near enough."""
    sig, tree, block = group["sig"], int(group["tree"][0]), group["block"]
    m = len(sig)
    wanted = np.zeros((m, m), dtype=bool)
    crossing = group["i"][0] != group["j"][0]
    keys = prefix_keys(sig, depth)[:, :tree]
    need = int(math.ceil(lowest * sig.shape[1]))
    for a in range(m - 1):
        after = np.arange(a + 1, m)
        if crossing:
            after = after[block[after] != block[a]]
        after = after[~np.any(keys[after] == keys[a], axis=1)]
        after = after[np.count_nonzero(sig[after] == sig[a], axis=1) >= need]
        wanted[a, after] = True
    return wanted


def _prune(batches: Iterator[pa.RecordBatch], depth: int, lowest: float) -> Iterator[pa.RecordBatch]:
    tidy()
    for group in _groups(batches):
        wanted = _pairs(group, depth, lowest)
        rows = np.flatnonzero(wanted.any(axis=0) | wanted.any(axis=1))
        if len(rows):
            names = ["key", "tree", "i", "j", "block", "cls"]
            yield pa.RecordBatch.from_arrays([pa.array(group[k][rows]) for k in names], names)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of blocks of the membership matrix."""
    m = len(sets)
    sizes = [len(x) for x in sets]
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    ids = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
    out = np.zeros((m, m), np.float64)
    width = max(64, (4 << 20) // max(m, 1))
    for low in range(0, int(ids[-1]) + 1 if len(ids) else 0, width):
        a, b = np.searchsorted(ids, (low, low + width))
        grid = np.zeros((m, min(width, int(ids[-1]) + 1 - low)), np.float32)
        grid[row[a:b], ids[a:b] - low] = 1
        out += grid @ grid.T
    out[np.arange(m), np.arange(m)] = sizes
    return out


def _verify(batches: Iterator[pa.RecordBatch], depth: int, lowest: float, threshold: float):
    tidy()
    for group in _groups(batches):
        wanted = _pairs(group, depth, lowest)
        sizes = np.array([len(x) for x in group["shingles"]])
        common = intersections(group["shingles"])
        linked = wanted & (common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9)
        linked |= linked.T
        rows = np.flatnonzero(linked.any(axis=1))
        if not len(rows):
            continue
        weight = linked[rows] @ group["rows"]
        # spanning links: everything reached from a row points to it
        top = np.arange(len(sizes))
        while True:
            near = np.where(linked, top[None, :], len(sizes)).min(axis=1)
            new = np.minimum(top, near)
            new = new[new]
            if np.array_equal(new, top):
                break
            top = new
        cls = group["cls"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cls[rows]), pa.array(cls[top[rows]]), pa.array(weight.astype(np.int64))], ["a", "b", "links"]
        )


def near_duplicates(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    n: int = 5,
    threshold: float = 0.8,
    recall: float = RECALL,
) -> DataFrame:
    """All rows of ``docs`` with ``class_id`` and ``n_links`` added.

    Two rows are linked when the Jaccard similarity of their sets of word ``n``-grams
    is at least ``threshold``. Words are runs of digits, letters and characters
    beyond ASCII, A-Z as a-z; a text of fewer words is one n-gram. ``n_links`` is the
    number of other rows a row is linked with, ``class_id`` the smallest id among the
    rows reached over links (NULL ids come last).

    NULL and empty texts and texts without words have no links and are classes of
    their own. Rows that repeat a text are rows of their own and linked. An empty
    table gives an empty result. Columns that bear an output's name are replaced.
    """
    depth = prefix_depth(threshold, recall)
    size = TREES * DEPTH
    lowest = threshold - 5 * math.sqrt(threshold * (1 - threshold) / size)
    digest = F.xxhash64(text_of(text_col))
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), digest.alias("digest"), text_of(text_col).alias("text"))
    sets = materialize(_digests(plain, n, depth))
    classes = materialize(
        sets.where(F.col("size") > 0)
        .groupBy("f1", "f2")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(id_order("id")).alias("first"),
            F.min(F.struct("id", "digest")).alias("one"),
            F.any_value("sig").alias("sig"),
            F.any_value("keys").alias("keys"),
        )
        .withColumn("cls", F.monotonically_increasing_id())
    )
    # nodes of the tries with several members
    paths = classes.select("cls", F.posexplode("keys").alias("tree", "key"))
    nodes = materialize(
        paths.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    )
    nodes = broadcast_if_small(nodes, 24)
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = (
        paths.join(nodes, "key")
        .select("key", "tree", "cls", blocks.alias("blocks"))
        .withColumn("block", own)
        .withColumn("other", other)
        .select(
            "key",
            "tree",
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
            "block",
            "cls",
        )
    )
    node = ["key", "i", "j"]
    met = members.join(classes.select("cls", "sig"), "cls").select("key", "tree", "i", "j", "block", "cls", "sig")
    needed_schema = T.StructType(_fields(key=_LONG, tree=_INT, i=_INT, j=_INT, block=_INT, cls=_LONG))
    needed = materialize(
        narrow_batches(met.repartition(*node).sortWithinPartitions(*node, "sig")).mapInArrow(
            partial(_prune, depth=depth, lowest=lowest), needed_schema
        )
    )
    # the sets of these classes, from the text of one document each
    wanted = materialize(
        needed.select("cls").distinct().join(classes.select("cls", "rows", "sig", "one"), "cls")
    )
    place = wanted.select("cls", F.col("one.id").alias("one_id"), F.col("one.digest").alias("one_digest"))
    place = broadcast_if_small(place, 40)
    texts = (
        plain.join(place, same(plain, place, {"id": "one_id", "digest": "one_digest"}))
        .dropDuplicates(["cls"])
        .select("cls", "text")
    )

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SHARD_BYTES):
            data, offsets = utf8(part.column("text").cast(pa.large_string()))
            found = shingle_sets(data, offsets, n)
            ends = np.cumsum([0, *(len(x) for x in found)]).astype(np.int32)
            flat = np.concatenate(found).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("cls"), pa.ListArray.from_arrays(ends, flat)], ["cls", "shingles"]
            )

    held = narrow_batches(texts).mapInArrow(shingles, T.StructType(_fields(cls=_LONG, shingles=T.ArrayType(_LONG))))
    held = materialize(held).join(wanted.select("cls", "rows", "sig"), "cls")
    checked = needed.join(held, "cls").repartition(*node).sortWithinPartitions(*node, "sig")
    links = materialize(
        checked.mapInArrow(
            partial(_verify, depth=depth, lowest=lowest, threshold=threshold),
            T.StructType(_fields(a=_LONG, b=_LONG, links=_LONG)),
        )
    )
    labels = components(links.where(F.col("a") != F.col("b")).select("a", "b"))
    counts = links.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    grouped = (
        classes.select("cls", "f1", "f2", "rows", "first")
        .join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left")
        .join(counts, "cls", "left")
        .withColumn("label", F.coalesce("label", "cls"))
    )
    grouped = materialize(grouped)
    firsts = grouped.groupBy("label").agg(F.min("first").alias("least"))
    own = own_prefix(docs)
    result = (
        sets.where(F.col("size") > 0)
        .select("id", "digest", "f1", "f2")
        .distinct()
        .join(grouped.join(firsts, "label"), ["f1", "f2"])
        .select(
            F.col("id").alias(f"{own}_id"),
            F.col("digest").alias(f"{own}_digest"),
            F.col("least.id").alias("class_id"),
            (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.lit(True).alias(f"{own}_found"),
        )
    )
    result = broadcast_if_small(materialize(result), 48)
    base = docs.drop(*[c for c in OUTPUTS if c not in (text_col, id_col)])
    names = base.columns
    base = base.withColumn(f"{own}_own", digest)
    out = base.join(result, same(base, result, {id_col: f"{own}_id", f"{own}_own": f"{own}_digest"}), "left")
    return out.select(
        *[F.col(f"`{c}`") for c in names],
        F.when(F.col(f"{own}_found"), F.col("class_id")).otherwise(F.col(f"`{id_col}`")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )
