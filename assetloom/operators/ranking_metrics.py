"""Evaluation of ranked lists at cutoffs.

Lists are (split_id, col_user, col_item, rank). Results are long tables
(split_id, metric, cutoff, col_user, value). All cutoffs are computed in one
aggregation per customer, as conditional sums; no row is repeated per cutoff.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import over_days
from ..functions.numbering import running_sums
from ..names import CUTOFF, ITEM, MONTH_DAYS, RANK, SPLIT, USER, YEAR_DAYS
from ..session import materialize
from .splits import Split, split_value

# The standard cutoffs.
CUTOFFS = (1, 5, 10, 20, 50, 100, 1000)


def top_k(recs: DataFrame, k: int) -> DataFrame:
    return recs.where(F.col(RANK) <= k)


def eligible_customers(customers: DataFrame, test: DataFrame | None = None, target: DataFrame | None = None) -> DataFrame:
    """Known customers, optionally only those with test rows and those targeted."""
    out = customers.select(SPLIT, USER).distinct()
    if test is not None:
        out = out.join(test.select(SPLIT, USER).distinct(), [SPLIT, USER], "left_semi")
    if target is not None:
        keys = [c for c in (SPLIT, USER) if c in target.columns]
        out = out.join(target.select(*keys).distinct(), keys, "left_semi")
    return out


def _long(wide: DataFrame, metrics: Sequence[str], cutoffs: Sequence[int]) -> DataFrame:
    """Turn columns ``v_<metric number>_<cutoff>`` into rows."""
    entries = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.lit(c).alias(CUTOFF), F.col(f"v_{i}_{c}").alias("value"))
            for i, m in enumerate(metrics)
            for c in cutoffs
        ]
    )
    return wide.select(SPLIT, USER, F.inline(entries)).select(SPLIT, "metric", CUTOFF, USER, "value")


def _only(wide: DataFrame, eligible: DataFrame | None) -> DataFrame:
    """Keep eligible customers; asked of a customer's one row, not of all rows of the list.

    An inner join stays above the aggregation; a semi join would be pushed below it.
    """
    return wide if eligible is None else wide.join(eligible.select(SPLIT, USER).distinct(), [SPLIT, USER])


def _with_values(recs: DataFrame, values: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Attach asset values: 0 for assets without a row, NULL (skipped by means) for rows without a value.

    The values are written, so that their real size decides how the list rows meet them.
    """
    known = materialize(
        values.select(
            SPLIT,
            ITEM,
            F.struct(*[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(metrics)]).alias("_known"),
        )
    )
    return recs.join(known, [SPLIT, ITEM], "left").withColumns(
        {
            f"_v{i}": F.when(F.col("_known").isNull(), 0.0).otherwise(F.col(f"_known.m{i}"))
            for i in range(len(metrics))
        }
    )


def kpi_at_k(
    recs: DataFrame,
    values: DataFrame,
    cutoffs: Sequence[int] = CUTOFFS,
    eligible: DataFrame | None = None,
    metrics: Sequence[str] = ("value",),
) -> DataFrame:
    """Mean asset value over the first k entries of each list.

    ``values`` is (split_id, col_item) with one column per metric.
    """
    kept = _with_values(top_k(recs, max(cutoffs)), values, metrics)
    wide = kept.groupBy(SPLIT, USER).agg(
        *[
            F.avg(F.when(F.col(RANK) <= c, F.col(f"_v{i}"))).alias(f"v_{i}_{c}")
            for i in range(len(metrics))
            for c in cutoffs
        ]
    )
    return _long(_only(wide, eligible), metrics, cutoffs)


def kpi_at_k_fixed(
    recs: DataFrame,
    values: DataFrame,
    cutoffs: Sequence[int] = CUTOFFS,
    eligible: DataFrame | None = None,
    metrics: Sequence[str] = ("value",),
) -> DataFrame:
    """Sum over the first k entries divided by k, however short the list; a negative k takes whole lists."""
    kept = _with_values(recs, values, metrics)

    def at(v: str, c: int) -> Column:
        if c < 0:
            return F.try_divide(F.sum(v), F.count(F.lit(1)))
        return F.try_divide(F.coalesce(F.sum(F.when(F.col(RANK) <= c, F.col(v))), F.lit(0.0)), F.lit(float(c)))

    wide = kept.groupBy(SPLIT, USER).agg(
        *[at(f"_v{i}", c).alias(f"v_{i}_{c}") for i in range(len(metrics)) for c in cutoffs]
    )
    return _long(_only(wide, eligible), metrics, cutoffs)


def compounded(value: Column, splits: Sequence[Split], days: int) -> Column:
    """A return over a row's split as a return over ``days``."""
    return over_days(value, days, split_value(splits, [float(s.days) for s in splits], "double"))


def _scaled(values: DataFrame, splits: Sequence[Split], days: int) -> DataFrame:
    return values.withColumn("value", compounded(F.col("value"), splits, days))


def annual_values(values: DataFrame, splits: Sequence[Split]) -> DataFrame:
    """Asset values compounded to a year; feed them to ``kpi_at_k``."""
    return _scaled(values, splits, YEAR_DAYS)


def monthly_values(values: DataFrame, splits: Sequence[Split]) -> DataFrame:
    """Asset values compounded to a month; feed them to ``kpi_at_k``."""
    return _scaled(values, splits, MONTH_DAYS)


def _ideal(longest: int) -> Column:
    """Ideal gains of 1..longest hits as a constant array."""
    total, ideal = 0.0, []
    for r in range(1, longest + 1):
        total += 1.0 / math.log(r + 1.0)
        ideal.append(total)
    return F.array(*[F.lit(v) for v in ideal])


def without_history(positives: DataFrame, history: DataFrame) -> DataFrame:
    """Positive assets a customer did not hold before."""
    keys = [c for c in (SPLIT, USER, ITEM) if c in history.columns]
    return positives.join(history.select(*keys).distinct(), keys, "left_anti")


def ndcg_from_hits(
    hits: DataFrame, positives: DataFrame, eligible: DataFrame, cutoffs: Sequence[int], metric: str = "ndcg"
) -> DataFrame:
    """nDCG from (split_id, col_user, rank) of the listed positive assets.

    A customer without positives or without a list scores 0. The ideal list has
    min(k, positives) hits.
    """
    gain = F.try_divide(F.lit(1.0), F.ln(F.col(RANK) + 1.0))
    dcg = hits.groupBy(SPLIT, USER).agg(
        *[F.sum(F.when(F.col(RANK) <= c, gain).otherwise(0.0)).alias(f"d_{c}") for c in cutoffs]
    )
    relevant = positives.groupBy(SPLIT, USER).agg(F.count(F.lit(1)).alias("_n"))
    ideal = _ideal(max(cutoffs))
    joined = eligible.join(relevant, [SPLIT, USER], "left").join(dcg, [SPLIT, USER], "left")
    wide = joined.select(
        SPLIT,
        USER,
        *[
            F.coalesce(
                F.try_divide(
                    F.col(f"d_{c}"), F.element_at(ideal, F.least(F.lit(c), F.col("_n")).cast("int"))
                ),
                F.lit(0.0),
            ).alias(f"v_0_{c}")
            for c in cutoffs
        ],
    )
    return _long(wide, [metric], cutoffs)


def ndcg_at_k(
    recs: DataFrame,
    positives: DataFrame,
    eligible: DataFrame,
    cutoffs: Sequence[int] = CUTOFFS,
    history: DataFrame | None = None,
) -> DataFrame:
    """nDCG with binary gains; ``positives`` are distinct (split_id, col_user, col_item).

    Positives are collected per customer and hashed, so lists dealt by customer neither move nor are sorted.
    """
    if history is not None:
        positives = without_history(positives, history)
    wanted = positives.join(eligible, [SPLIT, USER], "left_semi")
    # a customer's own positives of a split, at most the assets first traded in its test period
    mine = wanted.groupBy(SPLIT, USER).agg(F.collect_set(ITEM).alias("_wanted")).hint("shuffle_hash")
    hits = (
        top_k(recs, max(cutoffs))
        .join(mine, [SPLIT, USER])
        .where(F.array_contains("_wanted", F.col(ITEM)))
        .select(SPLIT, USER, RANK)
    )
    return ndcg_from_hits(hits, wanted, eligible, cutoffs)


def mean_over_customers(per_user: DataFrame, eligible: DataFrame) -> DataFrame:
    """Sum of customer values over the number of eligible customers; those without a list count as 0."""
    # one row per split
    sizes = F.broadcast(eligible.groupBy(SPLIT).agg(F.count(F.lit(1)).alias("_n")))
    sums = per_user.groupBy(SPLIT, "metric", CUTOFF).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("_sum"))
    return sums.join(sizes, SPLIT).select(
        SPLIT, "metric", CUTOFF, F.try_divide(F.col("_sum"), F.col("_n")).alias("value")
    )


def metrics_wide(per_user: DataFrame, metrics: Sequence[str], cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """One row per customer that has every metric, one column ``metric@k`` each."""
    names = [f"{m}@{c}" for m in metrics for c in cutoffs]
    keyed = per_user.withColumn("_name", F.concat_ws("@", F.col("metric"), F.col(CUTOFF).cast("string")))
    wide = keyed.groupBy(SPLIT, USER).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("value"))).alias(n) for n in names],
        *[F.max(F.when(F.col("_name") == n, 1)).alias(f"_has_{i}") for i, n in enumerate(names)],
    )
    complete = F.lit(True)
    for i in range(len(names)):
        complete = complete & F.col(f"_has_{i}").isNotNull()
    return wide.where(complete).select(SPLIT, USER, *[F.col(f"`{n}`") for n in names])


# ------------------------------------------------- evaluation without the lists


def kpi_from_ranking(
    ranking: DataFrame,
    gaps: DataFrame,
    values: DataFrame,
    customers: DataFrame,
    cutoffs: Sequence[int] = CUTOFFS,
    metrics: Sequence[str] = ("value",),
) -> DataFrame:
    """``kpi_at_k`` of the lists that ``ranking`` and the customers' seen assets imply.

    A list is the ranking without the seen assets. The k-th entry stands at
    asset rank k + (seen assets before it), so a customer's sum over k entries
    is a running total of the ranking minus the seen values: one row per seen
    asset instead of one per list entry.
    """
    ms = range(len(metrics))
    valued = _with_values(ranking, values, metrics).select(SPLIT, "asset_rank", *[f"_v{i}" for i in ms])
    amounts = {f"_sum{i}": F.col(f"_v{i}") for i in ms}
    amounts |= {f"_cnt{i}": F.col(f"_v{i}").isNotNull().cast("long") for i in ms}
    totals = running_sums(valued, [SPLIT], "asset_rank", amounts)
    mine = gaps.join(totals.select(SPLIT, "asset_rank", *[f"_v{i}" for i in ms]), [SPLIT, "asset_rank"])
    # seen assets standing before the k-th unseen one: those with fewer than k unseen ahead of them
    ahead = {c: F.col("unseen") < c for c in cutoffs}
    per_user = mine.groupBy(SPLIT, USER).agg(
        F.count(F.lit(1)).alias("_seen"),
        *[F.count(F.when(ahead[c], 1)).alias(f"_g_{c}") for c in cutoffs],
        *[F.sum(F.when(ahead[c], F.col(f"_v{i}"))).alias(f"_s{i}_{c}") for i in ms for c in cutoffs],
        *[F.count(F.when(ahead[c], F.col(f"_v{i}"))).alias(f"_n{i}_{c}") for i in ms for c in cutoffs],
    )
    # one row per split
    sizes = F.broadcast(ranking.groupBy(SPLIT).agg(F.max("n_assets").alias("n_assets")))
    wide = customers.select(SPLIT, USER).join(sizes, SPLIT).join(per_user, [SPLIT, USER], "left")
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias(CUTOFF),
                F.least(F.col("n_assets"), F.lit(c) + F.coalesce(F.col(f"_g_{c}"), F.lit(0)))
                .cast("int")
                .alias("asset_rank"),
                *[F.coalesce(F.col(f"_s{i}_{c}"), F.lit(0.0)).alias(f"_s{i}") for i in ms],
                *[F.coalesce(F.col(f"_n{i}_{c}"), F.lit(0)).alias(f"_n{i}") for i in ms],
            )
            for c in cutoffs
        ]
    )
    asked = wide.where(F.col("n_assets") > F.coalesce(F.col("_seen"), F.lit(0))).select(SPLIT, USER, F.inline(entries))
    at = asked.join(
        totals.select(SPLIT, "asset_rank", *[f"_sum{i}" for i in ms], *[f"_cnt{i}" for i in ms]), [SPLIT, "asset_rank"]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.try_divide(F.col(f"_sum{i}") - F.col(f"_s{i}"), F.col(f"_cnt{i}") - F.col(f"_n{i}")).alias("value"),
            )
            for i, m in enumerate(metrics)
        ]
    )
    return at.select(SPLIT, CUTOFF, USER, F.inline(rows)).select(SPLIT, "metric", CUTOFF, USER, "value")


def hits_from_ranking(ranking: DataFrame, gaps: DataFrame, positives: DataFrame) -> DataFrame:
    """List positions of positive assets: their asset rank minus the seen assets before them."""
    found = positives.join(ranking.select(SPLIT, ITEM, "asset_rank"), [SPLIT, ITEM]).select(
        SPLIT, USER, "asset_rank", F.lit(1).alias("_hit")
    )
    marks = found.unionByName(gaps.select(SPLIT, USER, "asset_rank", F.lit(0).alias("_hit")))
    upto = Window.partitionBy(SPLIT, USER).orderBy("asset_rank", "_hit").rowsBetween(Window.unboundedPreceding, -1)
    seen_before = F.coalesce(F.sum(1 - F.col("_hit")).over(upto), F.lit(0))
    at_rank = F.sum(1 - F.col("_hit")).over(Window.partitionBy(SPLIT, USER, "asset_rank"))
    return (
        marks.withColumn(RANK, F.col("asset_rank") - seen_before)
        .withColumn("_blocked", at_rank)
        # a positive asset the customer already has is not in the list
        .where((F.col("_hit") == 1) & (F.col("_blocked") == 0))
        .select(SPLIT, USER, F.col(RANK).cast("int").alias(RANK))
    )
