"""The data of a set of splits: prices, interactions and indicators, split and filtered."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..names import FUT, ITEM, RATING, SPLIT, TS, USER
from ..operators.filters import DataFilter, SplitTables
from ..operators.splits import (
    Split,
    Window3,
    lookback,
    not_over,
    pair_history,
    per_split,
    novel_test_pairs,
    train_pairs,
    windowed_split,
    with_warm_dates,
)
from ..session import materialize

LOOKBACK_DAYS = 36525


def split_dataset(
    interactions: DataFrame,
    prices: DataFrame,
    splits: Sequence[Split],
    data_filter: DataFilter | None = None,
    kpis: DataFrame | None = None,
) -> SplitTables:
    """Train and test of all splits with the filter applied.

    The interactions are read once: the history of pairs is written, and every
    split is a filter over it. ``prices`` is read several times, so hand over a
    written table.
    """
    pairs = materialize(pair_history(interactions))
    dated = materialize(with_warm_dates(pairs))
    tables = SplitTables(
        splits=tuple(splits),
        prices=prices,
        train=train_pairs(dated, splits),
        test=novel_test_pairs(dated, splits),
        kpis=kpis,
        test_is_new=True,
        warm_pairs=dated,
    )
    return _with_written_assets((data_filter or DataFilter()).apply(tables))


def _with_written_assets(tables: SplitTables) -> SplitTables:
    """The eligible assets (a row per split and asset) take part in many joins."""
    return replace(tables, assets=materialize(tables.assets))


def split_dataset_with_valid(
    interactions: DataFrame,
    prices: DataFrame,
    splits: Sequence[Split],
    valid_dates: Sequence[date],
    data_filter: DataFilter | None = None,
    kpis: DataFrame | None = None,
) -> SplitTables:
    """Train before the validation date, validation up to the split date, test after it.

    Test pairs are new and warm relative to the validation period; the rating
    filter then also removes train and validation pairs.
    """
    early = [
        Window3(s.split_id, lookback(s, LOOKBACK_DAYS), v, s.rec_date)
        for s, v in zip(splits, valid_dates, strict=True)
    ]
    late = [Window3(s.split_id, v, s.rec_date, s.future_date) for s, v in zip(splits, valid_dates, strict=True)]
    columns = (SPLIT, USER, ITEM, RATING, TS)

    def part(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col("part") == name).select(*columns)

    first = materialize(windowed_split(interactions, early))
    second = materialize(windowed_split(interactions, late))
    tables = SplitTables(
        splits=tuple(splits),
        prices=prices,
        train=part(first, "train"),
        valid=part(first, "test"),
        test=part(second, "test"),
        kpis=kpis,
        # the windows leave only new pairs
        valid_is_new=True,
    )
    return _with_written_assets((data_filter or DataFilter()).apply(tables))


def split_kpis(tables: SplitTables) -> DataFrame:
    """Indicator rows per split, up to the future date."""
    ended = not_over(tables.splits, F.col(TS))
    return per_split(tables.kpis, tables.splits, F.col(TS) <= F.col(FUT), after=ended)


def with_kpis(tables: SplitTables, kpis: DataFrame) -> SplitTables:
    return replace(tables, kpis=kpis)
