"""Cleaning, deduplication and rating preparation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import growth
from ..functions.numbering import dense_index
from ..names import ITEM, PRICE, RATING, SEQ, TS, USER
from ..session import materialize


def drop_zero_price_assets(prices: DataFrame) -> DataFrame:
    """Remove every asset that has a zero price on any date."""
    broken = prices.where(F.col(PRICE) == 0.0).select(ITEM).distinct()
    return prices.join(broken, ITEM, "left_anti")


def keep_last_quote(quotes: DataFrame) -> DataFrame:
    """One price per asset and date: the one latest in order. Combines before the shuffle."""
    return quotes.groupBy(ITEM, TS).agg(F.max_by(PRICE, SEQ).alias(PRICE))


def clean_prices(quotes: DataFrame) -> DataFrame:
    return keep_last_quote(drop_zero_price_assets(quotes))


def price_slice(prices: DataFrame, first: date, last: date) -> DataFrame:
    """Rows between two dates, both included."""
    return prices.where(F.col(TS).between(F.lit(first), F.lit(last)))


def limit_prices(prices: DataFrame) -> DataFrame:
    """First and last quote of every asset and the return between them."""
    ends = prices.groupBy(ITEM).agg(
        F.min(TS).alias("min_date"),
        F.max(TS).alias("max_date"),
        F.min_by(PRICE, TS).alias("price_min_date"),
        F.max_by(PRICE, TS).alias("price_max_date"),
    )
    return ends.withColumn("roi", growth(F.col("price_max_date"), F.col("price_min_date")))


def collapse_pairs(interactions: DataFrame, keys: tuple[str, ...] = (USER, ITEM)) -> DataFrame:
    """One row per pair: rating 1 if any rating is positive, timestamp of the first row."""
    return interactions.groupBy(*keys).agg(
        F.max(F.when(F.col(RATING) > 0, 1.0).otherwise(0.0)).alias(RATING), F.min(TS).alias(TS)
    )


def warm_only(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test rows whose user and whose asset both occur in train."""
    users = train.select(USER).distinct()
    items = train.select(ITEM).distinct()
    return test.join(users, USER, "left_semi").join(items, ITEM, "left_semi")


def novel_only(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test rows whose pair does not occur in train."""
    return test.join(train.select(USER, ITEM).distinct(), [USER, ITEM], "left_anti")


def binarize(ratings: DataFrame, threshold: float = 0.0) -> DataFrame:
    return ratings.withColumn(RATING, F.when(F.col(RATING) > threshold, 1.0).otherwise(F.col(RATING)))


def normalize_ratings(train: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """Divide all ratings by the largest train rating, which must be positive."""
    peak = train.agg(F.max(RATING)).first()[0]
    if peak is None or not peak > 0:
        raise ValueError("the largest train rating must be positive")
    return [df.withColumn(RATING, F.col(RATING) / F.lit(float(peak))) for df in (train, *others)]


def column_counts(df: DataFrame) -> DataFrame:
    """Rows with a value and distinct values of every column, one row per column.

    One pass: (column, value) pairs are counted on the map side first.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in df.columns])
    frequencies = df.select(F.inline(cells)).groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    return frequencies.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).cast("long").alias("count"),
        F.count("v").alias("nunique"),
    )


def reindex(train: DataFrame, *others: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Replace users and assets by dense numbers taken from train.

    Returns the mapped tables and the two dimension tables, which also serve as
    the inverse map. Rows unknown to train are dropped. ``train`` is read
    several times, so hand over a written table.
    """
    users = materialize(dense_index(train, USER, "user_idx"))
    items = materialize(dense_index(train, ITEM, "item_idx"))
    mapped = [df.join(users, USER).join(items, ITEM) for df in (train, *others)]
    return mapped, users, items


def positive_assets(test: DataFrame, assets: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (user, asset) with a positive test rating on an eligible asset."""
    return (
        test.where(F.col(RATING) > 0.0)
        .join(assets.select(*keys, ITEM).distinct(), [*keys, ITEM], "left_semi")
        .select(*keys, USER, ITEM)
        .distinct()
    )
