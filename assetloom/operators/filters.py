"""Filters applied to a set of splits, and their composition.

Tables are keyed by ``split_id``; a filter returns the eligible keys per split
and the composition applies them with semi joins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..names import FUT, ITEM, PRICE, REC, SPLIT, TS, USER
from .splits import Split, not_over, per_split


@dataclass(frozen=True)
class SplitTables:
    """The tables of a set of splits. ``prices`` covers all splits; see ``split_prices``."""

    splits: tuple[Split, ...]
    prices: DataFrame
    train: DataFrame
    test: DataFrame
    valid: DataFrame | None = None
    customers: DataFrame | None = None
    assets: DataFrame | None = None
    kpis: DataFrame | None = None
    assets_limit_prices: bool = False
    # test rows are already new pairs of users known from train
    test_is_new: bool = False
    # validation rows are already new pairs of users known from train
    valid_is_new: bool = False
    # when known: the history of pairs with the dates their users and assets were first seen
    warm_pairs: DataFrame | None = None

    def split_prices(self, columns: tuple[str, ...] = (PRICE,)) -> DataFrame:
        """Price rows per split: up to the future date, only eligible assets if so filtered."""
        sliced = per_split(
            self.prices, self.splits, F.col(TS) <= F.col(FUT), after=not_over(self.splits, F.col(TS))
        ).select(SPLIT, ITEM, TS, *columns)
        if self.assets_limit_prices and self.assets is not None:
            sliced = sliced.join(self.assets, [SPLIT, ITEM], "left_semi")
        return sliced


def last_price_dates(prices: DataFrame, splits: Sequence[Split]) -> DataFrame:
    """Last date with any price up to each future date. One row per split."""
    days = prices.select(TS).distinct()
    ended = not_over(splits, F.col(TS))
    return per_split(days, splits, F.col(TS) <= F.col(FUT), after=ended).groupBy(SPLIT).agg(F.max(TS).alias("last_date"))


def _priced_at_end(prices: DataFrame, splits: Sequence[Split]) -> DataFrame:
    # one row per split, so broadcasting is bounded by the number of splits
    ends = F.broadcast(last_price_dates(prices, splits))
    return prices.join(ends, prices[TS] == ends["last_date"]).select(SPLIT, ITEM).distinct()


def customers_in_train(tables: SplitTables) -> DataFrame:
    if tables.warm_pairs is None:
        return tables.train.select(SPLIT, USER).distinct()
    users = tables.warm_pairs.groupBy(USER).agg(F.min("first_ts").alias("_first"))
    return per_split(users, tables.splits, after=F.col("_first")).select(SPLIT, USER)


def all_customers(tables: SplitTables) -> DataFrame | None:
    """Keeps the customers the tables came with."""
    return tables.customers


def assets_with_full_test(tables: SplitTables) -> DataFrame:
    """Assets of the test set that have a price at the end of the test period."""
    return _priced_at_end(tables.prices, tables.splits).join(
        tables.test.select(SPLIT, ITEM).distinct(), [SPLIT, ITEM], "left_semi"
    )


def assets_with_test_price(tables: SplitTables) -> DataFrame:
    """Assets priced on the split date and at the end of the test period."""
    dates = [s.rec_date for s in tables.splits]
    at_start = per_split(
        tables.prices.where(F.col(TS).isin(dates)),
        tables.splits,
        after=F.date_sub(F.col(TS), 1),
        until=F.col(TS),
    ).select(SPLIT, ITEM)
    return _priced_at_end(tables.prices, tables.splits).join(at_start, [SPLIT, ITEM], "left_semi")


def new_ratings(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Later ratings of users known earlier, without the pairs known earlier.

    In a split whose earlier set is empty the later ratings stay as they are.
    """
    pairs = earlier.select(SPLIT, USER, ITEM)
    users = earlier.select(SPLIT, USER).distinct()
    filled = F.broadcast(earlier.select(SPLIT).distinct())
    fresh = later.join(pairs, [SPLIT, USER, ITEM], "left_anti")
    kept = fresh.join(users, [SPLIT, USER], "left_semi")
    return kept.unionByName(later.join(filled, SPLIT, "left_anti"))


def ratings_not_in_train(tables: SplitTables) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Test without train pairs (and without validation pairs), validation without train pairs."""
    test = tables.test if tables.test_is_new else new_ratings(tables.train, tables.test)
    if tables.valid is None:
        return tables.train, None, test
    valid = tables.valid if tables.valid_is_new else new_ratings(tables.train, tables.valid)
    return tables.train, valid, new_ratings(valid, test)


def all_prices(tables: SplitTables) -> DataFrame:
    return tables.prices


@dataclass(frozen=True)
class DataFilter:
    """Four filters and three switches saying where their results apply."""

    customers: Callable[[SplitTables], DataFrame | None] = customers_in_train
    assets: Callable[[SplitTables], DataFrame] = assets_with_full_test
    ratings: Callable[[SplitTables], tuple] = ratings_not_in_train
    prices: Callable[[SplitTables], DataFrame] = all_prices
    customers_limit_ratings: bool = False
    assets_limit_prices: bool = True
    assets_limit_ratings: bool = False

    def apply(self, tables: SplitTables) -> SplitTables:
        customers, assets = self.customers(tables), self.assets(tables)
        sets = list(self.ratings(tables))
        if self.customers_limit_ratings and customers is not None:
            sets = [s if s is None else s.join(customers, [SPLIT, USER], "left_semi") for s in sets]
        if self.assets_limit_ratings:
            sets = [s if s is None else s.join(assets, [SPLIT, ITEM], "left_semi") for s in sets]
        train, valid, test = sets
        return SplitTables(
            splits=tables.splits,
            prices=self.prices(tables),
            train=train,
            valid=valid,
            test=test,
            customers=customers,
            assets=assets,
            kpis=tables.kpis,
            assets_limit_prices=self.assets_limit_prices,
            test_is_new=tables.test_is_new,
            valid_is_new=tables.valid_is_new,
            warm_pairs=tables.warm_pairs,
        )
