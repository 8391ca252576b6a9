"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors are turned into integers, ``floor(scale * c)``, and fitted on the list of
distinct ones. Their covariance V is never formed. A block Q of some directions more
than asked for is multiplied by it in passes over the list: every task sums
``Xc' (Xc Q)`` of its centred rows, Spark adds the sums up, and the driver receives one
row per dimension. Between passes it does the small work:

1. Rayleigh-Ritz on the block gives values, vectors and, from the images at hand, their
   residuals.
2. A Chebyshev polynomial of V, run as a three-term recurrence of passes, damps all
   directions whose values lie below the least one of the block and lifts those above.
   Its degree is limited so that the strongest direction cannot drown the others, and
   directions that have converged are kept aside and projected out.
3. QR makes the block orthonormal again.

This goes on until the components are certified: residuals at rounding level, or so
far below the distance to the neighbouring values that vectors are exact to ``TOLERANCE``,
and a block of fresh random directions, filtered and orthogonal to the components, has
no value above theirs. If the spectrum is too flat for that, the block grows; a block of
all dimensions is exact after one pass, so the iteration always ends.

The driver and every task hold matrices of dimension x block only; the list may be of
any length. The list is a written table, so a lost executor costs a part of one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm.common import narrow_batches
from assetloom.session import materialize

SCALE = 256
COMPONENTS = 4
GUARDS = 12  # directions of the block beyond the components
DEGREE = 12  # of the filter, at most
GAIN = 1e8  # by which a filter may lift the strongest direction over the weakest of the block
TOLERANCE = 1e-12
ROUNDS = 12  # before the block grows
ROUNDING = 64 * np.finfo(float).eps
OUTPUTS = ("deviation", "whitened")

Product = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening. ``components`` has one unit column per component."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int = 0

    @property
    def dim(self) -> int:
        return len(self.sums)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums], dtype=float)


def integers(vectors: DataFrame, vector_col: str, scale: int = SCALE) -> Column:
    """``floor(scale * c)`` of the entries as longs; NULL where the vector or an entry is missing or not finite."""
    entries = F.col(f"`{vector_col}`").cast("array<double>")
    odd = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    whole = F.transform(entries, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    return F.when(entries.isNotNull() & ~odd, whole)


def _matrix(batch: pa.RecordBatch, dim: int, name: str = "x") -> np.ndarray:
    column = batch.column(batch.schema.names.index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _summed(fit: DataFrame, dim: int, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over tasks of a matrix with ``width`` columns that ``part`` makes of the rows of a batch."""
    names = [f"c{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = part(_matrix(batch, dim))
                total = found if total is None else total + found
        if total is not None:
            columns = [pa.array(np.arange(len(total), dtype=np.int32))]
            columns += [pa.array(np.ascontiguousarray(total[:, k])) for k in range(width)]
            yield pa.RecordBatch.from_arrays(columns, ["i", *names])

    schema = T.StructType([T.StructField("i", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in names]])
    rows = fit.mapInArrow(run, schema).groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect()
    out = np.zeros((max(r["i"] for r in rows) + 1, width))
    for r in rows:
        out[r["i"]] = r[1:]
    return out


def _sums(fit: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """Rows and exact sums per dimension; the halves of a long are added apart, so nothing overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, dim)
            high = x >> 32
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(dim, dtype=np.int32)),
                    pa.array(np.full(dim, len(x))),
                    pa.array(high.sum(axis=0)),
                    pa.array((x - (high << 32)).sum(axis=0)),
                ],
                ["i", "n", "high", "low"],
            )

    parts = fit.mapInArrow(run, "i int, n bigint, high bigint, low bigint")
    wide = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("n", "high", "low")]
    rows = sorted(parts.groupBy("i").agg(*wide).collect())
    if not rows:
        return 0, (0,) * dim
    return int(rows[0]["n"]), tuple(int(r["high"]) * (1 << 32) + int(r["low"]) for r in rows)


def _filtered(
    product: Product, block: np.ndarray, image: np.ndarray, fixed: np.ndarray, cut: float, top: float, degree: int
) -> np.ndarray:
    """Chebyshev polynomial of V on a block whose image is known: small on [0, cut], one at ``top``."""
    centre = half = cut / 2
    sigma = first = half / (top - centre)
    apart = lambda y: y - fixed @ (fixed.T @ y)
    before, now = block, apart((image - centre * block) * (sigma / half))
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        step = (product(now) - centre * now) * (2 * after / half) - (sigma * after) * before
        before, now, sigma = now, apart(step), after
    return now


def _degree(cut: float, top: float) -> int:
    """Largest degree up to DEGREE whose polynomial at ``top`` is at most GAIN times that at ``cut``."""
    x = 2 * top / cut - 1
    return int(np.clip(np.arccosh(GAIN) / max(np.arccosh(max(x, 1.0)), 1e-9), 1, DEGREE))


def _orthonormal(block: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span the block outside of ``fixed``."""
    sizes = np.linalg.norm(block, axis=0)
    block = block / np.where(sizes > 0, sizes, 1)
    for _ in range(2):
        block = np.linalg.qr(block - fixed @ (fixed.T @ block))[0]
    return block


def top_components(product: Product, dim: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their vectors of a positive semidefinite matrix given by its product.

    Fewer come back when the matrix has fewer values above rounding level.
    """
    random = np.random.default_rng(seed)
    none = np.zeros((dim, 0))
    k = min(k, dim)
    width = min(dim, k + GUARDS)
    block = _orthonormal(random.standard_normal((dim, width)), none)
    image = product(block)
    kept, rounds = 0, 0
    while True:
        values, turn = np.linalg.eigh((block.T @ image + image.T @ block) / 2)
        turn = turn[:, ::-1]
        values, block, image = values[::-1], block @ turn, image @ turn
        top = values[0]
        floor = ROUNDING * max(top, 0)
        wanted = int(np.sum(values[:k] > np.sqrt(dim) * floor))
        if not wanted or width == dim:
            return values[:wanted], block[:, :wanted]
        residuals = np.linalg.norm(image - block * values, axis=0)
        near = np.full(width, np.inf)
        steps = values[:-1] - values[1:]
        near[:-1], near[1:] = steps, np.minimum(near[1:], steps)
        good = residuals <= np.maximum(floor, TOLERANCE * (near - residuals))
        kept = int(np.argmin(np.append(good[:wanted], False)))
        if kept == wanted and _nothing_above(product, block[:, :wanted], values[wanted - 1], values[-1], random):
            return values[:wanted], block[:, :wanted]
        rounds += 1
        if rounds % ROUNDS == 0:
            more = min(dim, 2 * width) - width
            fresh = _orthonormal(random.standard_normal((dim, more)), block)
            block, image = np.hstack([block, fresh]), np.hstack([image, product(fresh)])
            width += more
            continue
        kept = min(kept, wanted - 1)
        fixed, cut = block[:, :kept], max(values[-1], 1e-3 * values[wanted - 1])
        degree = _degree(cut, values[kept])
        found = _filtered(product, block[:, kept:], image[:, kept:], fixed, cut, max(values[kept], cut * 1.001), degree)
        found = _orthonormal(found, fixed)
        block, image = np.hstack([fixed, found]), np.hstack([image[:, :kept], product(found)])


def _nothing_above(product: Product, found: np.ndarray, least: float, cut: float, random: np.random.Generator) -> bool:
    """Whether fresh directions outside of ``found``, filtered for large values, stay below its least one."""
    probe = _orthonormal(random.standard_normal((len(found), min(4, len(found) - found.shape[1]))), found)
    cut = max(cut, 1e-3 * least)
    probe = _filtered(product, probe, product(probe), found, cut, max(least, 1.001 * cut), _degree(cut, least))
    probe = _orthonormal(probe, found)
    return bool(np.linalg.eigvalsh(probe.T @ product(probe)).max() <= least * (1 + 1e-9))


def usual_length(vectors: DataFrame, vector_col: str, scale: int = SCALE) -> int:
    """The most frequent length of usable vectors (the longer one of two); 0 if there are none."""
    sizes = vectors.select(F.size(integers(vectors, vector_col, scale)).alias("d")).where("d > 0")
    found = sizes.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def fit_whitening(
    vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE
) -> Whitening | None:
    """Fit on the distinct integer vectors of all usable rows. None if there is no usable row.

    A row is usable when its vector has the usual length and no NULL or non-finite entry.
    Repeated vectors count once. Without variance there are no components.
    """
    dim = usual_length(vectors, vector_col, scale)
    if not dim:
        return None
    x = integers(vectors, vector_col, scale)
    fit = narrow_batches(materialize(vectors.select(x.alias("x")).where(F.size("x") == dim).distinct()))
    n, sums = _sums(fit, dim)
    mean = np.array([s / n for s in sums], dtype=float)
    passes = 0

    def product(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ block)

        return _summed(fit, dim, block.shape[1], part) / n

    trace = _summed(fit, dim, 1, lambda x: np.square(x - mean).sum(axis=0)[:, None]).sum() / n
    values, found = top_components(product, dim, components)
    largest = found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])] if len(values) else np.ones(0)
    found = found * np.where(largest < 0, -1, 1)

    def check(x: np.ndarray) -> np.ndarray:
        white = (x - mean) @ found / np.sqrt(values)
        return np.vstack([white.T @ white, white.sum(axis=0)])

    error = 0.0
    if len(values):
        total = _summed(fit, dim, len(values), check) / n
        error = float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(len(values))).max())
    return Whitening(n, sums, found, values, float(trace), error, passes)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2, exact; None beyond a long."""
    reach = max(int(x.max(initial=0)), -int(x.min(initial=0))) * n + max(map(abs, sums))
    if reach * reach * len(sums) < 1 << 63:
        return np.square(x * n - np.array(sums, dtype=np.int64)).sum(axis=1).tolist()
    exact = (sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x)
    return [v if v < 1 << 63 else None for v in exact]


def whiten(
    vectors: DataFrame, model: Whitening | None, vector_col: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """Usable rows of ``vectors`` with ``deviation`` (long) and ``whitened`` (one double per component).

    Rows whose vector is NULL, of another length than the model's, or holds NULL or
    non-finite entries are dropped; without a model all are. Repeated rows are kept. A
    deviation beyond a long is NULL. Columns that bear an output's name are replaced.
    """
    base = vectors.select(*[F.col(f"`{c}`") for c in vectors.columns if c not in OUTPUTS or c == vector_col])
    schema = T.StructType(
        [f for f in base.schema.fields if f.name not in OUTPUTS]
        + [T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType(), False))]
    )
    dim = model.dim if model else -1
    whole = "x"
    while whole in base.columns:
        whole += "_"
    rows = base.withColumn(whole, integers(base, vector_col, scale)).where(F.size(whole) == F.lit(dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is None:
            return
        mean, k = model.mean, len(model.values)
        for batch in batches:
            x = _matrix(batch, dim, whole)
            white = (x - mean) @ model.components / np.sqrt(model.values)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
            kept = [n for n in batch.schema.names if n != whole and n not in OUTPUTS]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(batch.schema.names.index(c)) for c in kept],
                    pa.array(_deviations(x, model.n, model.sums), pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(white).ravel())),
                ],
                [*kept, "deviation", "whitened"],
            )

    return narrow_batches(rows).mapInArrow(run, schema)
