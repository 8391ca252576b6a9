"""Asset analysis over a grid of dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..names import SPLIT
from ..operators.assets import asset_stats, asset_summary, split_census
from ..operators.filters import DataFilter
from ..operators.splits import Split
from ..session import materialize
from ..sources.sinks import write_by_date, write_summary
from .dataset import split_dataset


def asset_report(interactions: DataFrame, prices: DataFrame, splits: Sequence[Split]) -> tuple[DataFrame, DataFrame]:
    """Per-asset statistics and the per-date summary with counts of the split."""
    prices = materialize(prices)
    stats = materialize(asset_stats(prices, splits))
    census = split_census(interactions, prices, split_dataset(interactions, prices, splits, DataFilter()))
    return stats, asset_summary(stats).join(census, SPLIT)


def write_asset_report(interactions: DataFrame, prices: DataFrame, splits: Sequence[Split], folder: str) -> None:
    stats, summary = asset_report(interactions, prices, splits)
    write_by_date(stats, f"{folder}/assets_stats")
    write_summary(summary, f"{folder}/assets_summary")
