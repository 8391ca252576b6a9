"""Customer analysis over a grid of dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..names import REC, SPLIT, UNITS
from ..operators.portfolio import asset_valuation, customer_summary, customer_totals, positions
from ..operators.splits import Split, split_value
from ..session import materialize
from ..sources.sinks import write_by_date, write_summary


def _rec_dates(splits: Sequence[Split]) -> Column:
    return split_value(splits, [s.rec_date for s in splits], "date")


def customer_report(
    trades: DataFrame, prices: DataFrame, limits: DataFrame, splits: Sequence[Split], flow_col: str = UNITS
) -> DataFrame:
    """Cost, proceeds and returns of every customer and split (NULL returns without a cost)."""
    held = positions(trades, asset_valuation(prices, limits, splits), splits, flow_col)
    return customer_totals(held, splits)


def write_customer_report(
    trades: DataFrame,
    prices: DataFrame,
    limits: DataFrame,
    splits: Sequence[Split],
    folder: str,
    flow_col: str = UNITS,
) -> None:
    """The replay runs once; its per-customer totals are written and then summarised."""
    totals = materialize(customer_report(trades, prices, limits, splits, flow_col))
    write_by_date(
        totals.where(F.col("buy_price") > 0).withColumn(REC, _rec_dates(splits)), f"{folder}/customers_stats"
    )
    write_summary(
        customer_summary(totals, splits).withColumn(REC, _rec_dates(splits)), f"{folder}/customers_summary"
    )
