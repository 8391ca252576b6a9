"""Exact quantiles of large groups.

A wanted order statistic is searched by counted value ranges. It starts with the whole
group as its piece, from the least to the greatest value. A sketch of the piece proposes
a narrower range; the rows below and inside it are counted, and the counts tell in
which part the statistic lies, whatever the sketch said. That part is the next
piece, until every piece has at most ``PIECE`` rows or a single value. Only then the
values of a piece are ranked, by their frequencies. All counting combines on the map
side, so a group of any size or with any number of ties never meets in one task, and
a wrong sketch costs a round, never a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

QUARTILES = (0.25, 0.5, 0.75)
# rows up to which a piece's values are ranked
PIECE = 4096
# parts of a piece that a sketch marks off; a range is two of them wide
CUTS = 64
_ACCURACY = 2000


def _positions(n: Column, p: float, kind: int) -> tuple[Column, Column]:
    """1-based lower order statistic and the weight of its successor."""
    if kind == 7:
        at = (n - 1) * F.lit(p) + 1.0
        low = F.floor(at)
    elif kind == 6:
        at = (n + 1) * F.lit(p)
        low = F.greatest(F.lit(1), F.least(F.floor(at), n - 1))
    else:
        raise ValueError("kind is 6 (exclusive) or 7 (inclusive)")
    return low, at - low


def _by_group(df: DataFrame, few_groups: bool) -> DataFrame:
    return F.broadcast(df) if few_groups else df


def _narrowed(rows: DataFrame, pieces: DataFrame, groups: list[str], few_groups: bool) -> DataFrame:
    """Next pieces: one part of each, the one that is counted to hold the statistic."""
    done = (F.col("inside") <= PIECE) | (F.col("bottom") == F.col("top"))
    spread = Window.partitionBy(*groups, "bottom", "top")
    wide = pieces.where(~done).withColumn("first", F.min("i").over(spread))
    key = [*groups, "i"]
    held = (F.col("bottom") <= F.col("_v")) & (F.col("_v") <= F.col("top"))

    def within(asked: DataFrame, *columns: str) -> DataFrame:
        listed = asked.groupBy(*groups).agg(
            F.collect_list(F.struct("i", "bottom", "top", *columns)).alias("_asked")
        )
        joined = rows.join(_by_group(listed, few_groups), groups)
        return joined.select(*groups, "_v", F.inline("_asked")).where(held)

    # equal pieces share a sketch
    grid = [j / CUTS for j in range(CUTS + 1)]
    sketch = (
        within(wide.where(F.col("i") == F.col("first")))
        .groupBy(*key)
        .agg(F.percentile_approx("_v", grid, _ACCURACY).alias("_cuts"))
        .withColumnRenamed("i", "first")
    )
    at = F.least(F.floor(F.col("pos") * CUTS / F.col("inside")), F.lit(CUTS - 1)).cast("int")
    ranged = wide.join(sketch, [*groups, "first"]).select(
        *key,
        "bottom",
        "top",
        "pos",
        F.get("_cuts", F.greatest(at - 1, F.lit(0))).alias("_a"),
        F.get("_cuts", F.least(at + 2, F.lit(CUTS))).alias("_b"),
        F.get("_cuts", at).alias("_mid"),
    )
    # a range that is the whole piece would not narrow it: its middle value alone does
    same = (F.col("_a") <= F.col("bottom")) & (F.col("_b") >= F.col("top"))
    ranged = materialize(
        ranged.withColumns({c: F.when(same, F.col("_mid")).otherwise(F.col(c)) for c in ("_a", "_b")})
    )
    below, above = F.col("_v") < F.col("_a"), F.col("_v") > F.col("_b")
    counted = (
        within(ranged, "_a", "_b")
        .groupBy(*key)
        .agg(
            F.count(F.when(below, 1)).alias("n_below"),
            F.count(F.when(~below & ~above, 1)).alias("n_in"),
            F.count(F.when(above, 1)).alias("n_above"),
            F.max(F.when(below, F.col("_v"))).alias("_under"),
            F.min(F.when(above, F.col("_v"))).alias("_over"),
            F.min(F.when(~below & ~above, F.col("_v"))).alias("_least"),
            F.max(F.when(~below & ~above, F.col("_v"))).alias("_most"),
        )
    )
    joined = ranged.join(counted, key)
    low, middle = F.col("pos") <= F.col("n_below"), F.col("pos") <= F.col("n_below") + F.col("n_in")

    def part(under: Column, between: Column, over: Column) -> Column:
        return F.when(low, under).when(middle, between).otherwise(over)

    found = joined.select(
        *key,
        part(F.col("pos"), F.col("pos") - F.col("n_below"), F.col("pos") - F.col("n_below") - F.col("n_in")).alias("pos"),
        part(F.col("bottom"), F.col("_least"), F.col("_over")).alias("bottom"),
        part(F.col("_under"), F.col("_most"), F.col("top")).alias("top"),
        part(F.col("n_below"), F.col("n_in"), F.col("n_above")).alias("inside"),
    )
    return materialize(pieces.where(done).select(*found.columns).unionByName(found))


def exact_quantiles(
    df: DataFrame,
    groups: list[str],
    value: str,
    kind: int,
    probs: tuple[float, ...] = QUARTILES,
    few_groups: bool = False,
) -> DataFrame:
    """One row per group: the columns in ``groups``, ``n`` and the array ``quantiles``.

    ``kind`` follows the usual numbering of sample quantiles: 6 interpolates at
    p(n+1) and needs two values, 7 at p(n-1)+1. NULL values are ignored. The
    input is read once, and twice more for each round of narrowing. The driver runs the
    rounds; it learns whether a wide piece is left. ``few_groups`` promises a small fixed
    number of groups (splits x measures): the pieces, a few per group, are then
    broadcast, and the rows never move by group.
    """
    rows = materialize(df.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("_v")))
    sizes = materialize(
        rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    )
    wanted = []
    for i, p in enumerate(probs):
        low, weight = _positions(F.col("n"), p, kind)
        for side in (0, 1):
            position = F.greatest(F.lit(1), F.least(low + side, F.col("n"))).cast("long")
            wanted.append(
                F.struct(
                    F.lit(2 * i + side).alias("i"),
                    position.alias("pos"),
                    F.col("_min").alias("bottom"),
                    F.col("_max").alias("top"),
                    F.col("n").alias("inside"),
                )
            )
    pieces = sizes.select(*groups, F.inline(F.array(*wanted)))
    wide = (F.col("inside") > PIECE) & (F.col("bottom") < F.col("top"))
    while not pieces.where(wide).isEmpty():
        pieces = _narrowed(rows, pieces, groups, few_groups)

    listed = pieces.groupBy(*groups).agg(F.collect_list(F.struct("i", "pos", "bottom", "top")).alias("_asked"))
    joined = rows.join(_by_group(listed, few_groups), groups)
    placed = (
        joined.select(*groups, "_v", F.inline("_asked"))
        .where((F.col("bottom") <= F.col("_v")) & (F.col("_v") <= F.col("top")))
        .groupBy(*groups, "i", "pos", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    upto = Window.partitionBy(*groups, "i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hit = placed.withColumn("_upto", F.sum("_n").over(upto)).where(
        (F.col("_upto") >= F.col("pos")) & (F.col("_upto") - F.col("_n") < F.col("pos"))
    )
    by_number = hit.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("i", "_v"))).alias("_at"))
    found = sizes.join(by_number, groups)
    values = []
    for i, p in enumerate(probs):
        _, weight = _positions(F.col("n"), p, kind)
        a, b = (F.try_element_at(F.col("_at"), F.lit(2 * i + side)) for side in (0, 1))
        values.append(a + F.when(weight == 0.0, 0.0).otherwise(weight * (b - a)))
    enough = F.col("n") >= (2 if kind == 6 else 1)
    return found.select(*groups, "n", F.when(enough, F.array(*values)).alias("quantiles"))
