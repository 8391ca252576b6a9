"""Asset-side statistics between recommendation and future dates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import growth, over_days
from ..functions.quantiles import exact_quantiles
from ..names import FUT, ITEM, MONTH_DAYS, PRICE, RATING, REC, SPLIT, TRADING_DAYS, TS, USER, YEAR_DAYS
from .filters import SplitTables, assets_with_full_test
from .splits import Split, constants, not_over, per_split, split_array

# Summary names of the measured columns.
MEASURES = ("ROI", "AnnROI", "MonthROI", "Volatility")


def _days() -> Column:
    return F.datediff(F.col(FUT), F.col(REC)).cast("double")


def end_prices(prices: DataFrame, splits: Sequence[Split]) -> DataFrame:
    """Price of every asset on the recommendation and on the future date of every split.

    The wanted dates are literals, so the scan reads only those days, and both
    ends meet in one aggregation instead of a join.
    """
    days = sorted({d for s in splits for d in (s.rec_date, s.future_date)})
    on_days = prices.where(F.col(TS).isin(days))
    return (
        per_split(on_days, splits, (F.col(TS) == F.col(REC)) | (F.col(TS) == F.col(FUT)), until=F.col(TS))
        .groupBy(SPLIT, REC, FUT, ITEM)
        .agg(
            F.max(F.when(F.col(TS) == F.col(REC), F.col(PRICE))).alias("price_current"),
            F.max(F.when(F.col(TS) == F.col(FUT), F.col(PRICE))).alias("price_future"),
        )
    )


def asset_returns(prices: DataFrame, splits: Sequence[Split]) -> DataFrame:
    """Return of assets priced on both dates: as is, annualized and monthly."""
    both = end_prices(prices, splits).where(F.col("price_current").isNotNull() & F.col("price_future").isNotNull())
    roi = both.withColumn("ROI", growth(F.col("price_future"), F.col("price_current")))
    return roi.select(
        SPLIT,
        REC,
        FUT,
        ITEM,
        "price_current",
        "price_future",
        "ROI",
        over_days(F.col("ROI"), YEAR_DAYS, _days()).alias("AnnROI"),
        over_days(F.col("ROI"), MONTH_DAYS, _days()).alias("MonthROI"),
    )


def _daily_returns(prices: DataFrame, *groups: str) -> DataFrame:
    series = Window.partitionBy(*groups, ITEM).orderBy(TS)
    return prices.withColumn("_r", growth(F.col(PRICE), F.lag(PRICE).over(series)))


def asset_volatility(prices: DataFrame) -> DataFrame:
    """Annualized volatility over the whole history."""
    return (
        _daily_returns(prices)
        .groupBy(ITEM)
        .agg((F.stddev_samp("_r") * math.sqrt(TRADING_DAYS)).alias("Volatility"))
    )


def asset_stats(prices: DataFrame, splits: Sequence[Split]) -> DataFrame:
    """Returns with the whole-history volatility attached; one row per split and asset."""
    return asset_returns(prices, splits).join(asset_volatility(prices), ITEM)


def asset_summary(stats: DataFrame) -> DataFrame:
    """Mean, quartiles and non-positive share of every measure, and the index returns, per split."""
    long = stats.select(
        SPLIT, REC, FUT, F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES]))
    ).where(F.col("v").isNotNull())
    keys = [SPLIT, REC, FUT]
    moments = long.groupBy(*keys, "measure").agg(
        F.avg("v").alias("mean"), F.avg(F.when(F.col("v") > 0, 0.0).otherwise(1.0)).alias("share")
    )
    quartiles = exact_quantiles(long, [*keys, "measure"], "v", kind=6, few_groups=True)
    joined = moments.join(quartiles, [*keys, "measure"], "left")

    def of(measure: str, value: Column) -> Column:
        return F.max(F.when(F.col("measure") == measure, value))

    wide = joined.groupBy(*keys).agg(
        *[
            of(m, value).alias(f"overall_{name}_{m}")
            for m in MEASURES
            for name, value in (
                ("mean", F.col("mean")),
                ("q1", F.col("quantiles")[0]),
                ("median", F.col("quantiles")[1]),
                ("q3", F.col("quantiles")[2]),
                ("perc_non_profitable", F.col("share")),
            )
        ]
    )
    return wide.select("*", *_index_returns(F.col("overall_mean_ROI")))


def _index_returns(mean_roi: Column) -> list[Column]:
    return [
        over_days(mean_roi, MONTH_DAYS, _days()).alias("index_month_roi"),
        over_days(mean_roi, YEAR_DAYS, _days()).alias("index_annual_roi"),
    ]


def index_returns(returns: DataFrame) -> DataFrame:
    """Mean return of all assets, scaled to a month and to a year."""
    mean = returns.groupBy(SPLIT, REC, FUT).agg(F.avg("ROI").alias("mean_roi"))
    return mean.select(SPLIT, "mean_roi", *_index_returns(F.col("mean_roi")))


def profitability(prices: DataFrame, splits: Sequence[Split], max_prices: DataFrame | None = None) -> DataFrame:
    """(split_id, col_item, value): return from recommendation to future date.

    With ``max_prices`` (col_item, max_price), assets priced only on the
    recommendation date fall back to the return up to their maximum price.
    """
    ends = end_prices(prices, splits).where(F.col("price_current").isNotNull())
    direct = growth(F.col("price_future"), F.col("price_current"))
    if max_prices is None:
        return ends.where(F.col("price_future").isNotNull()).select(SPLIT, ITEM, direct.alias("value"))
    known = ends.join(max_prices.select(ITEM, "max_price"), ITEM, "left").where(
        F.col("price_future").isNotNull() | F.col("max_price").isNotNull()
    )
    fallback = growth(F.col("max_price"), F.col("price_current"))
    return known.select(
        SPLIT, ITEM, F.when(F.col("price_future").isNotNull(), direct).otherwise(fallback).alias("value")
    )


def window_volatility(prices: DataFrame, splits: Sequence[Split]) -> DataFrame:
    """(split_id, col_item, value): annualized volatility of the returns inside [rec, future].

    The return of a row does not depend on the split, except that the first row
    of a period has none: it is computed once per series and only then repeated
    for the periods whose start it does not cross.
    """
    series = Window.partitionBy(ITEM).orderBy(TS)
    first, last = min(s.rec_date for s in splits), max(s.future_date for s in splits)
    moves = (
        prices.where(F.col(TS).between(F.lit(first), F.lit(last)))
        .withColumn("_before", F.lag(TS).over(series))
        .withColumn("_r", growth(F.col(PRICE), F.lag(PRICE).over(series)))
    )
    inside = per_split(
        moves, splits, F.col(TS) <= F.col(FUT), after=not_over(splits, F.col(TS)), until=F.col(TS)
    )
    own = F.when(F.col("_before") >= F.col(REC), F.col("_r"))
    return inside.groupBy(SPLIT, ITEM).agg((F.stddev_samp(own) * math.sqrt(TRADING_DAYS)).alias("value"))


def split_census(interactions: DataFrame, prices: DataFrame, tables: SplitTables) -> DataFrame:
    """Counts of assets, users, ratings and transactions per split.

    Users are ``tables.customers``, or all customers with a trade when that is None.
    Transactions are folded to (user, asset, date) counts on the map side first, and
    meet the splits of their user; rows are summed per split and asset where they
    arise, so nothing is shuffled once per split.
    """
    splits = tables.splits
    buys = F.sum(F.when(F.col(RATING) > 0, 1).otherwise(0))
    by_day = interactions.groupBy(USER, ITEM, TS).agg(F.count(F.lit(1)).alias("tx"), buys.alias("buys"))

    def per_id(df: DataFrame, **values: Column) -> DataFrame:
        return df.groupBy(SPLIT).agg(*[v.cast("long").alias(n) for n, v in values.items()])

    rows = F.count(F.lit(1))
    positive = F.count(F.when(F.col(RATING) > 0, 1))
    if tables.customers is None:
        everyone = interactions.select(USER).distinct()
        users = per_split(everyone, splits)
        mine = by_day.withColumn("_in", constants([s.split_id for s in splits], "int"))
    else:
        users = tables.customers
        in_splits = users.groupBy(USER).agg(F.collect_set(SPLIT).alias("_in"))
        mine = by_day.join(in_splits, USER)

    eligible = tables.assets if tables.assets is not None else assets_with_full_test(tables)
    wanted = F.filter(
        split_array(splits), lambda s: F.array_contains(F.col("_in"), s[SPLIT]) & (F.col(TS) < s[FUT])
    )
    early = F.col(TS) < F.col(REC)
    counted = (
        mine.select(ITEM, TS, "tx", "buys", F.inline(wanted))
        .groupBy(SPLIT, ITEM)
        .agg(
            F.sum(F.when(early, F.col("tx"))).alias("tx_before"),
            F.sum(F.when(early, F.col("buys"))).alias("buys_before"),
            F.sum(F.when(~early, F.col("tx"))).alias("tx_during"),
            F.sum(F.when(~early, F.col("buys"))).alias("buys_during"),
        )
        .join(eligible.select(SPLIT, ITEM, F.lit(True).alias("_eligible")), [SPLIT, ITEM], "left")
    )

    def during(name: str) -> Column:
        return F.sum(F.when(F.col("_eligible"), F.col(name)))

    parts = [
        per_id(asset_returns(prices, splits), num_assets=rows),
        per_id(users, num_users=rows),
        per_id(eligible, num_assets_rec=rows),
        per_id(tables.train, train_ratings=rows, positive_train_ratings=positive),
        per_id(tables.test, test_ratings=rows, positive_test_ratings=positive),
        per_id(
            counted,
            train_transactions=F.sum("tx_before"),
            training_buys=F.sum("buys_before"),
            test_transactions=during("tx_during"),
            test_buys=during("buys_during"),
        ),
    ]
    # one row per split in every part: stack them and take the one value of each column
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    names = [c for c in stacked.columns if c != SPLIT]
    return stacked.groupBy(SPLIT).agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in names])
