"""Popularity distributions, weighted sampling and negative sampling.

All draws are seeded and deterministic: the same input gives the same sample on
any cluster and partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import below, with_draws
from ..functions.numbering import prefix_sum
from ..names import RATING
from ..session import materialize
from .graph import I, U, unique_pairs


def popularity(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, share): how often each key occurs."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(key, "n", (F.col("n") / total).alias("share"))


def integer_weights(probabilities: DataFrame, key: str, p: str, resolution: int = 10**12) -> DataFrame:
    """Turn probabilities into whole-number weights, so interval bounds are exact."""
    weight = F.when(F.col(p) > 0, F.greatest(F.lit(1), F.round(F.col(p) * resolution).cast("long")))
    return probabilities.select(key, weight.alias("n")).where(F.col("n").isNotNull())


def excluding(weights: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Weights without the excluded keys."""
    return weights.join(excluded.select(key).distinct(), key, "left_anti")


# stretches of the line that a block of the coarse level covers
COARSE = 1024
# dependent draws of one plan
DRAWS_PER_PLAN = 4


class _Intervals:
    """Keys laid end to end on [0, total), each taking up its weight.

    Looking up a position is an equality join on short stretches of the line.
    A stretch is as long as the average weight, so positions meet two keys on
    average, whatever the distribution. A heavy key covers many stretches: blocks
    of ``COARSE`` stretches that lie wholly inside it are listed as blocks, only its
    ends as stretches. A position asks for its stretch and for its block, and
    exactly one key answers.
    """

    def __init__(self, weights: DataFrame, key: str, weight: str):
        self.key = key
        whole = weights.select(key, F.col(weight).cast("long").alias("_w"))
        sums = weights.agg(
            F.sum(F.col(weight).cast("long")).alias("total"),
            F.greatest(F.lit(1), F.floor(F.sum(F.col(weight).cast("long")) / F.count(F.lit(1)))).alias("width"),
        )
        self.total, self.width = sums.select("total").scalar(), sums.select("width").scalar()
        placed = (
            prefix_sum(whole, key, "_w", "_start")
            .withColumn("_low", self._stretch(F.col("_start")))
            .withColumn("_high", self._stretch(F.col("_start") + F.col("_w") - 1))
            # blocks [_from, _to) lie wholly inside the key
            .withColumn("_from", F.floor((F.col("_low") + COARSE - 1) / COARSE))
            .withColumn("_to", F.greatest(F.floor((F.col("_high") + 1) / COARSE), F.col("_from")))
        )
        some = F.col("_from") < F.col("_to")

        def slots(level: int, low: Column, high: Column, there: Column) -> Column:
            numbers = F.when(there & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
            return F.transform(numbers, lambda n: F.struct(F.lit(level).alias("_level"), n.alias("_slot")))

        listed = F.concat(
            slots(0, F.col("_low"), F.when(some, F.col("_from") * COARSE - 1).otherwise(F.col("_high")), F.lit(True)),
            slots(0, F.col("_to") * COARSE, F.col("_high"), some),
            slots(1, F.col("_from"), F.col("_to") - 1, some),
        )
        self.slots = placed.select(F.col(key).alias("_key"), "_start", "_w", F.inline(listed))

    def _stretch(self, position: Column) -> Column:
        return F.call_function("div", position.cast("long"), self.width.cast("long"))

    def find(self, points: DataFrame, position: str) -> DataFrame:
        """Add _key, _start and _w of the interval holding ``position``."""
        at = self._stretch(F.col(position))
        # what the join compares leaves the generator: a filter inferred from the join would
        # otherwise be pushed below it and evaluate the draws once per use of the position
        asked = points.select(
            "*",
            F.inline_outer(
                F.array(
                    F.struct(F.lit(0).alias("_level"), at.alias("_slot"), F.col(position).alias("_at")),
                    F.struct(
                        F.lit(1).alias("_level"), F.floor(at / COARSE).alias("_slot"), F.col(position).alias("_at")
                    ),
                )
            ),
        )
        return (
            asked.join(self.slots, ["_level", "_slot"])
            .where((F.col("_start") <= F.col("_at")) & (F.col("_at") < F.col("_start") + F.col("_w")))
            .drop("_level", "_slot", "_at")
        )


def weighted_sample(
    weights: DataFrame, requests: DataFrame, count: int, seed: int, key: str, request: str, weight: str = "n"
) -> DataFrame:
    """``count`` keys per request, with replacement, proportional to weight: (request, draw, key)."""
    line = _Intervals(weights, key, weight)
    asked = requests.select(request, F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("draw"))
    points = with_draws(asked, seed, {"_u": [F.col(request), F.col("draw")]}).withColumn(
        "_p", below(F.col("_u"), line.total)
    )
    return line.find(points, "_p").select(request, "draw", F.col("_key").alias(key))


def weighted_sample_distinct(
    weights: DataFrame, requests: DataFrame, count: int, seed: int, key: str, request: str, weight: str = "n"
) -> DataFrame:
    """``count`` different keys per request: each draw is proportional to the weights not drawn yet.

    A draw picks a position on the line with the drawn intervals cut out, so no
    draw is ever rejected. Every request carries at most ``count`` intervals. They are
    written after every ``DRAWS_PER_PLAN`` draws, so the plan does not grow with ``count``.
    """
    size = weights.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if count > size:
        raise ValueError(f"cannot draw {count} different keys from {size}")
    line = _Intervals(weights, key, weight)
    # every draw reads them
    line.slots = materialize(line.slots)
    taken_type = f"array<struct<_start:bigint,_w:bigint,_key:{dict(weights.dtypes)[key]}>>"
    state = requests.select(request, F.array().cast(taken_type).alias("_taken"))
    for j in range(count):
        used = F.aggregate(F.col("_taken"), F.lit(0).cast("long"), lambda a, t: a + t["_w"])
        free = below(F.col("_u"), line.total - used)
        position = F.aggregate(
            F.array_sort(F.col("_taken")),
            F.col("_free"),
            lambda p, t: F.when(p >= t["_start"], p + t["_w"]).otherwise(p),
        )
        drawn = with_draws(state, seed, {"_u": [F.col(request), F.lit(j)]})
        asked = drawn.withColumn("_free", free.cast("long")).withColumn("_p", position)
        state = line.find(asked, "_p").select(
            request, F.concat("_taken", F.array(F.struct("_start", "_w", "_key"))).cast(taken_type).alias("_taken")
        )
        if j % DRAWS_PER_PLAN == DRAWS_PER_PLAN - 1:
            state = materialize(state)
    return state.select(request, F.posexplode("_taken").alias("draw", "_t")).select(
        request, "draw", F.col("_t._key").alias(key)
    )


# ------------------------------------------------------------------- negatives


# asset numbers of a segment of a customer's seen assets
SEGMENT = 1024


def _with_positions(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """Add _t: ``min(n, _m)`` different positions in [0, _m), every subset equally likely.

    Floyd's sampling: step k draws from one more position than step k-1 could,
    and takes that last position when the draw repeats an earlier one. The steps
    are a fold over the draws, so the code does not grow with their number.
    """
    size = F.least(F.lit(n).cast("long"), F.col("_m"))
    drawn = with_draws(rows, seed, {f"_h{k}": [F.col(U), F.col(I), F.lit(k)] for k in range(n)})
    draws = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"_h{k}").alias("h")) for k in range(n)])

    def step(taken: Column, draw: Column) -> Column:
        last = F.col("_m") - size + draw["k"]
        pick = below(draw["h"], last + 1)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, pick), last).otherwise(pick)))

    steps = F.slice(draws, 1, F.greatest(size, F.lit(0)).cast("int"))
    taken = F.aggregate(steps, F.array().cast("array<bigint>"), step)
    return drawn.withColumn("_t", taken).drop(*[f"_h{k}" for k in range(n)])


def _unseen_pieces(pairs: DataFrame, n_items: Column) -> DataFrame:
    """Where the unseen assets of a customer lie, by pieces of the asset numbers.

    A piece ends with a segment of which the customer has seen assets and begins after
    the one before; the last one goes on to the end of the numbers. It holds the
    positions [_low, _high) among the customer's unseen assets, ``_before``, the seen
    ones before it, and ``_seen``, the seen ones inside: at most SEGMENT. A customer has
    at most one piece per segment however many pairs there are, and all counting before
    is by customer and segment.
    """
    segments = pairs.groupBy(U, F.floor(F.col(I) / SEGMENT).alias("_segment")).agg(
        F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(F.col(I).cast("long"))).alias("_seen")
    )
    whole = Window.partitionBy(U)
    ordered = whole.orderBy("_segment")
    ended = (
        segments.withColumn("_before", F.sum("_n").over(ordered) - F.col("_n"))
        .withColumn("_low", F.coalesce((F.lag("_segment").over(ordered) + 1) * SEGMENT, F.lit(0)) - F.col("_before"))
        .withColumn("_end", F.least((F.col("_segment") + 1) * SEGMENT, n_items) - F.col("_before") - F.col("_n"))
        .withColumn("_last", F.lead("_segment").over(ordered).isNull())
        .withColumn("_m", n_items - F.sum("_n").over(whole))
        .withColumn("_pieces", F.count(F.lit(1)).over(whole) + 1)
    )
    rest = F.struct(
        F.col("_end").alias("_low"),
        F.col("_m").alias("_high"),
        (F.col("_before") + F.col("_n")).alias("_before"),
        F.array().cast("array<bigint>").alias("_seen"),
    )
    own = F.struct("_low", F.col("_end").alias("_high"), "_before", "_seen")
    both = F.when(F.col("_last"), F.array(own, rest)).otherwise(F.array(own))
    # a customer's positions are cut into as many stretches as there are pieces
    width = F.greatest(F.lit(1), F.floor(F.col("_m") / F.col("_pieces")))
    return ended.select(U, "_m", width.alias("_width"), F.inline(both))


def unseen_items(edges: DataFrame, items: DataFrame, n: int, seed: int) -> DataFrame:
    """For every pair, ``n`` different assets the customer never had: (user_idx, item_idx, draw, neg_idx).

    The complement of a customer's assets is never built. Positions in the
    complement are drawn, and the asset at a position is the position plus the
    number of seen assets before it (rank and select): the seen assets are counted by
    segments of the asset numbers, a position is looked up among the counts, and the
    last step walks the seen assets of one segment. Positions and counts meet on
    (customer, stretch of positions), so a customer with very many assets spreads
    over many tasks. Customers with fewer than ``n`` unseen assets get all of them.
    """
    n_items = items.agg(F.count(F.lit(1))).scalar().cast("long")
    # read for the counts and for the questions
    pairs = materialize(unique_pairs(edges))
    pieces = materialize(_unseen_pieces(pairs, n_items))
    users = materialize(pieces.select(U, "_m", "_width").distinct())
    asking = _with_positions(pairs.join(users, U), n, seed)
    # the plain explode would filter by the size of the array first, and so draw twice
    listed = asking.select(U, I, "_width", F.posexplode_outer("_t").alias("draw", "_p"))
    asked = listed.where(F.col("_p").isNotNull()).withColumn("_stretch", F.floor(F.col("_p") / F.col("_width")))
    spread = pieces.where(F.col("_low") < F.col("_high")).select(
        U,
        "_low",
        "_high",
        "_before",
        "_seen",
        F.explode(
            F.sequence(F.floor(F.col("_low") / F.col("_width")), F.floor((F.col("_high") - 1) / F.col("_width")))
        ).alias("_stretch"),
    )
    found = asked.drop("_width").join(spread, [U, "_stretch"]).where(
        (F.col("_low") <= F.col("_p")) & (F.col("_p") < F.col("_high"))
    )
    item = F.aggregate(
        F.col("_seen"), F.col("_p") + F.col("_before"), lambda at, seen: at + F.when(seen <= at, 1).otherwise(0)
    )
    return found.select(U, I, "draw", item.cast("long").alias("neg_idx"))


def pointwise_pairs(edges: DataFrame, items: DataFrame, n: int, seed: int) -> DataFrame:
    """(user_idx, item_idx, label): every rated pair and ``n`` unseen assets with label 0."""
    positive = edges.select(U, I, F.col(RATING).alias("label"))
    negative = unseen_items(edges, items, n, seed).select(U, F.col("neg_idx").alias(I), F.lit(0.0).alias("label"))
    return positive.unionByName(negative)


def pairwise_triples(edges: DataFrame, items: DataFrame, seed: int) -> DataFrame:
    """(user_idx, pos_idx, neg_idx): one unseen asset per pair."""
    return unseen_items(edges, items, 1, seed).select(U, F.col(I).alias("pos_idx"), "neg_idx")


def multi_negative_rows(edges: DataFrame, items: DataFrame, n: int, seed: int) -> DataFrame:
    """(user_idx, pos_idx, neg_idxs): an array of ``n`` unseen assets per pair."""
    drawn = unseen_items(edges, items, n, seed)
    listed = drawn.groupBy(U, I).agg(F.sort_array(F.collect_list(F.struct("draw", "neg_idx"))).alias("_n"))
    return listed.select(U, F.col(I).alias("pos_idx"), F.col("_n.neg_idx").alias("neg_idxs"))
