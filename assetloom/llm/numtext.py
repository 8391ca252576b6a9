"""Words and rolling hashes of UTF-8 texts, whole Arrow columns at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
# fixed values: odd multipliers of the polynomial hashes and of the finisher
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# word bytes after lower-casing: digits, a-z and every byte of a character beyond ASCII
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (in place where possible)."""
    x = x ^ (x >> U64(33))
    x *= U64(MIX[0])
    x ^= x >> U64(33)
    x *= U64(MIX[1])
    x ^= x >> U64(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(max(n, 1), base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=U64)


def tidy() -> None:
    """Give memory back at the start of a task: the pool reuses workers, and another operator may have filled this one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; NULL is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, weights: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch, each of at most ``limit`` weight or one row."""
    start, n = 0, batch.num_rows
    total = np.concatenate([[0], np.cumsum(weights)])
    while start < n:
        stop = max(start + 1, int(np.searchsorted(total, total[start] + limit, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def text_slices(batches: Iterator[pa.RecordBatch], name: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Pieces of at most ``limit`` bytes of text or one row."""
    for batch in batches:
        column = batch.column(batch.schema.names.index(name)).cast(pa.large_string())
        yield from slices(batch, np.diff(utf8(column)[1]), limit)


def words(data: np.ndarray, offsets: np.ndarray, hashes: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the words of consecutive texts, and the offsets of each text's words.

    A-Z count as a-z; words are runs of digits, letters a-z and characters beyond ASCII.
    """
    low = _LOWER[data]
    inside = _WORD[low]
    before = np.empty(len(inside), dtype=bool)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges] = False  # words end with their text
    starts = np.flatnonzero(inside & ~before)
    counts = np.searchsorted(starts, offsets).astype(np.int64)
    if not len(starts):
        return [np.zeros(0, U64) for _ in range(hashes)], counts
    spans = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    place = place[inside[starts[0] :]]
    value = low[inside].astype(U64) + U64(1)
    # starts among the word bytes alone
    dense = np.concatenate([[0], np.cumsum(inside)])[starts]
    out = []
    for base in BASES[:hashes]:
        table = powers(base, int(place.max()) + 1)
        out.append(mix(np.add.reduceat(value * table[place], dense)))
    return out, counts


def prefix_hash(data: np.ndarray, base: int) -> np.ndarray:
    """Running polynomial hash: entry i covers the first i bytes."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(base, len(data))[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int) -> np.ndarray:
    """Hash of the bytes from start to stop, wherever they lie."""
    inverse = powers(pow(base, -1, 1 << 64), len(prefix))
    return mix((prefix[stop] - prefix[start]) * inverse[start])


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of every run of ``width`` values."""
    span = 1
    while span * 2 <= width:
        values = best(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return best(values[:-rest], values[rest:]) if rest else values
