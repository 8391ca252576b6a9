"""Rolling and exponentially weighted statistics of ordered series.

All helpers work on windows partitioned by the series key and ordered by date,
so a chain of them needs one shuffle. A series holds at most one row per
calendar day (prices are deduplicated by asset and date first), which bounds a
window partition whatever the size of the raw data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..names import ITEM, TS

MAX_BLOCKS = 16


@dataclass(frozen=True)
class Rolling:
    """``kind`` (mean, std, min or max) of the last ``period`` rows; NULL until they all have a value."""

    kind: str
    column: str
    period: int
    out: str


def _direct(spec: Rolling, key: str, order: str) -> Column:
    frame = Window.partitionBy(key).orderBy(order).rowsBetween(1 - spec.period, 0)
    agg = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}[spec.kind]
    full = F.count(spec.column).over(frame) == spec.period
    return F.when(full, agg(spec.column).over(frame)).alias(spec.out)


def rolling(df: DataFrame, specs: Sequence[Rolling], key: str = ITEM, order: str = TS) -> DataFrame:
    """Add rolling columns.

    Long frames are assembled from short ones: when the periods share a divisor
    g (trading months of 21 rows), only g-row frames slide, and a longer period
    merges the g-row results found g, 2g, ... rows earlier. Work per row is g +
    longest/g steps instead of the sum of all periods, and merging counts, means
    and squared deviations loses no precision the way differences of running
    totals would.
    """
    base = math.gcd(*[s.period for s in specs])
    blocks = {s.period // base for s in specs}
    if base < 2 or max(blocks) == 1 or max(blocks) > MAX_BLOCKS:
        return df.select("*", *[_direct(s, key, order) for s in specs])

    ordered = Window.partitionBy(key).orderBy(order)
    frame = ordered.rowsBetween(1 - base, 0)
    wanted = {
        "mean": lambda c: [(f"_mean_{c}", F.avg(c))],
        "std": lambda c: [(f"_mean_{c}", F.avg(c)), (f"_dev_{c}", F.var_pop(c))],
        "min": lambda c: [(f"_min_{c}", F.min(c))],
        "max": lambda c: [(f"_max_{c}", F.max(c))],
    }
    parts: dict[Rolling, list[str]] = {}
    short: dict[str, tuple[str, Column]] = {}
    for s in specs:
        named = wanted[s.kind](s.column)
        parts[s] = [n for n, _ in named]
        short.update({n: (s.column, agg) for n, agg in named})
    kept = df.columns
    columns = sorted({s.column for s in specs})
    slid = df.select(
        "*",
        *[F.count(c).over(frame).alias(f"_n_{c}") for c in columns],
        *[agg.over(frame).alias(n) for n, (_, agg) in short.items()],
    )
    # a short frame counts only when all its rows have a value; NULL then spreads to every longer period
    with_short = slid.select(
        *kept,
        *[
            F.when(F.col(f"_n_{c}") == base, F.col(n)).alias(n)
            for n, (c, _) in short.items()
        ],
    )

    depth: dict[str, int] = {}
    for s, names in parts.items():
        for n in names:
            depth[n] = max(depth.get(n, 1), s.period // base)
    lagged = with_short.select(
        *kept,
        *[F.col(n).alias(f"{n}_0") for n in depth],
        *[F.lag(n, base * i).over(ordered).alias(f"{n}_{i}") for n, d in depth.items() for i in range(1, d)],
    )

    # the mean of every std period is its own column first: it is used once per block below
    means = [
        (reduce(Column.__add__, [F.col(f"_mean_{s.column}_{i}") for i in range(s.period // base)])
         / F.lit(float(s.period // base))).alias(f"_mu_{s.out}")
        for s in specs
        if s.kind == "std"
    ]
    centred = lagged.select("*", *means)

    def merged(s: Rolling) -> Column:
        m = s.period // base
        cols = [[F.col(f"{n}_{i}") for i in range(m)] for n in parts[s]]
        if s.kind == "mean":
            return reduce(Column.__add__, cols[0]) / F.lit(float(m))
        if s.kind == "std":
            mu = F.col(f"_mu_{s.out}")
            # population variance inside the short frames plus that of their means around the common mean
            spread = reduce(Column.__add__, cols[1]) + reduce(Column.__add__, [(c - mu) * (c - mu) for c in cols[0]])
            return F.sqrt(F.lit(float(base)) * spread / F.lit(float(s.period - 1)))
        pick = F.least if s.kind == "min" else F.greatest
        complete = reduce(Column.__and__, [c.isNotNull() for c in cols[0]])
        return F.when(complete, pick(*cols[0]) if m > 1 else cols[0][0])

    return centred.select(*kept, *[merged(s).alias(s.out) for s in specs])


@dataclass(frozen=True)
class Ewm:
    """Exponentially weighted mean of ``column``.

    ``adjust=False`` is the recursion y = (1-a) y' + a x started at the first
    value; ``adjust=True`` divides by the weights seen so far. a = 2/(span+1).
    """

    column: str
    span: int
    adjust: bool
    out: str

    @property
    def alpha(self) -> float:
        return 2.0 / (self.span + 1.0)


def _block_rows(span: int) -> int:
    """Rows of a block for a span; it depends on the span alone, so other spans of a call change nothing.

    Decay rates are put into classes a factor of 20 wide (12 to 189 is one class). A
    block's length is the longest for which the fastest rate of the class stays
    finite (e^500), so two blocks back the slowest one has decayed to e^-50, which
    is below the precision of a double.
    """
    rate = -math.log(1.0 - 2.0 / (span + 1.0))
    return int(500.0 / (0.2 * 20.0 ** math.ceil(math.log(rate / 0.2, 20.0))))


def ewm(df: DataFrame, specs: Sequence[Ewm], key: str = ITEM, order: str = TS) -> DataFrame:
    """Add exponentially weighted columns without walking the series row by row.

    With q = 1-a the recursion is q^j * sum(w x q^-i): a running sum. It is cut
    into blocks short enough for q^-i to stay finite, and a block starts from
    the end values of the two blocks before it, which hold all the weight that
    counts (see ``_block_rows``). Spans with the same block length share windows.
    """
    kept = df.columns
    if any(s.span < 2 for s in specs):
        raise ValueError("span must be at least 2")
    out = df
    for length in sorted({_block_rows(s.span) for s in specs}):
        out = _ewm_blocks(out, [s for s in specs if _block_rows(s.span) == length], length, key, order)
    return out.select(*kept, *[F.col(s.out) for s in specs])


def _ewm_blocks(df: DataFrame, specs: Sequence[Ewm], length: int, key: str, order: str) -> DataFrame:
    kept = df.columns
    numbered = df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
    blocked = numbered.withColumn("_blk", F.floor(F.col("_rn") / length).cast("int")).withColumn(
        "_j", F.col("_rn") - F.col("_blk") * length
    )
    inside = Window.partitionBy(key, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("_blk", order).rowsBetween(Window.unboundedPreceding, -1)

    def local(s: Ewm) -> Column:
        q = 1.0 - s.alpha
        weight = F.lit(1.0) if s.adjust else F.when(F.col("_rn") == 0, 1.0).otherwise(s.alpha)
        return F.pow(F.lit(q), F.col("_j")) * F.sum(weight * F.col(s.column) * F.pow(F.lit(q), -F.col("_j"))).over(
            inside
        )

    last_row = F.col("_j") == length - 1
    y = blocked.select("*", *[local(s).alias(f"_y{i}") for i, s in enumerate(specs)])
    ends = y.select(
        "*",
        *[
            (
                F.col(f"_y{i}")
                + F.coalesce(
                    F.last(F.when(last_row, F.col(f"_y{i}")), ignorenulls=True).over(earlier)
                    * math.pow(1.0 - s.alpha, length),
                    F.lit(0.0),
                )
            ).alias(f"_e{i}")
            for i, s in enumerate(specs)
        ],
    )

    def total(i: int, s: Ewm) -> Column:
        q = 1.0 - s.alpha
        carried = F.last(F.when(last_row, F.col(f"_e{i}")), ignorenulls=True).over(earlier)
        value = F.col(f"_y{i}") + F.coalesce(carried * F.pow(F.lit(q), F.col("_j") + 1), F.lit(0.0))
        if s.adjust:
            value = value * s.alpha / (1.0 - F.pow(F.lit(q), F.col("_rn") + 1))
        return value.alias(s.out)

    return ends.select(*kept, *[total(i, s) for i, s in enumerate(specs)])
