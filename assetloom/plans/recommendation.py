"""Train, recommend and evaluate over a grid of dates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..names import ITEM, MONTH_DAYS, PRICE, RATING, SPLIT, TS, USER, YEAR_DAYS
from ..operators.assets import profitability, window_volatility
from ..operators.cleaning import positive_assets
from ..operators.filters import DataFilter, SplitTables, assets_with_test_price
from ..operators.indicators import features, indicator_periods, technical_indicators
from ..operators.ranking_metrics import (
    CUTOFFS,
    compounded,
    eligible_customers,
    hits_from_ranking,
    kpi_at_k,
    kpi_from_ranking,
    mean_over_customers,
    metrics_wide,
    ndcg_at_k,
    ndcg_from_hits,
)
from ..operators.recommend import ForestScorer, learn_scores, rank_assets, recommend, run_name, seen_ranks
from ..operators.splits import Split
from ..session import materialize
from ..sources.runs import RunStore, fingerprint
from ..sources.sinks import path_exists, read_kpis, write_kpis, write_metrics
from .dataset import split_dataset

# The evaluated metrics.
METRICS = ("profitability", "annualized_prof", "monthly_prof", "volatility", "ndcg")


@dataclass(frozen=True)
class Evaluation:
    per_user: DataFrame
    overall: DataFrame
    eligible: DataFrame

    def wide(self, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
        return metrics_wide(self.per_user, METRICS, cutoffs)


def priced_at_both_ends() -> DataFilter:
    """Assets priced at both ends of the test period, customers known from train."""
    return DataFilter(assets=assets_with_test_price)


def asset_values(prices: DataFrame, tables: SplitTables) -> DataFrame:
    """Every eligible asset of every split with a column per metric; 0 where an asset has no value.

    Annual and monthly returns follow from the return, so they are columns of its row.
    """
    roi = profitability(prices, tables.splits).withColumn("_has_roi", F.lit(True))
    vol = window_volatility(prices, tables.splits).select(SPLIT, ITEM, F.col("value").alias("_vol"), F.lit(True).alias("_has_vol"))
    both = roi.join(vol, [SPLIT, ITEM], "full").join(tables.assets, [SPLIT, ITEM], "left_semi")

    def known(value: Column, there: str) -> Column:
        # a row without a value stays NULL, no row means 0
        return F.when(F.col(there), value).otherwise(0.0)

    return both.select(
        SPLIT,
        ITEM,
        known(F.col("value"), "_has_roi").alias("profitability"),
        known(compounded(F.col("value"), tables.splits, YEAR_DAYS), "_has_roi").alias("annualized_prof"),
        known(compounded(F.col("value"), tables.splits, MONTH_DAYS), "_has_roi").alias("monthly_prof"),
        known(F.col("_vol"), "_has_vol").alias("volatility"),
    )


def evaluate_lists(
    recs: DataFrame, prices: DataFrame, tables: SplitTables, cutoffs: Sequence[int] = CUTOFFS
) -> Evaluation:
    """All metrics of given ranked lists."""
    eligible = materialize(eligible_customers(tables.customers, tables.test))
    positives = materialize(positive_assets(tables.test, tables.assets, (SPLIT,)))
    kpis = kpi_at_k(recs, asset_values(prices, tables), cutoffs, eligible, METRICS[:-1])
    return _evaluation(kpis.unionByName(ndcg_at_k(recs, positives, eligible, cutoffs)), eligible)


def evaluate_scores(
    scores: DataFrame, prices: DataFrame, tables: SplitTables, cutoffs: Sequence[int] = CUTOFFS
) -> Evaluation:
    """The same metrics straight from asset scores; lists are implied, never built.

    The work grows with the customers' seen assets and positives instead of
    with customers x longest cutoff. Tables read more than once (the ranking,
    the eligible customers, the seen assets' ranks, the positives) are written.
    """
    eligible = materialize(eligible_customers(tables.customers, tables.test))
    ranking = materialize(rank_assets(scores))
    gaps = materialize(seen_ranks(ranking, tables.train, eligible))
    kpis = kpi_from_ranking(ranking, gaps, asset_values(prices, tables), eligible, cutoffs, METRICS[:-1])
    wanted = materialize(
        positive_assets(tables.test, tables.assets, (SPLIT,)).join(eligible, [SPLIT, USER], "left_semi")
    )
    hits = hits_from_ranking(ranking, gaps, wanted)
    return _evaluation(kpis.unionByName(ndcg_from_hits(hits, wanted, eligible, cutoffs)), eligible)


def _evaluation(per_user: DataFrame, eligible: DataFrame) -> Evaluation:
    return Evaluation(per_user, mean_over_customers(per_user, eligible), eligible)


def run_recommendation(
    spark: SparkSession,
    interactions: DataFrame,
    prices: DataFrame,
    splits: Sequence[Split],
    folder: str,
    months: int = 6,
    trees: int = 20,
    feature_set: str = "full_short",
    kpi_kind: str = "long",
    list_length: int | None = None,
    cutoffs: Sequence[int] = CUTOFFS,
    max_depth: int = 12,
    seed: int = 0,
) -> str | None:
    """Fit, recommend, evaluate and write everything under ``folder/<run>``.

    A run is named by all its parameters and by the contents of both input tables, so
    other trades or prices are another run. Dates, with their horizon, that the run has
    committed are skipped and only the others are computed; see ``RunStore`` for how results
    are kept. Its tables are ``recs``, ``customer_metrics``, ``metrics`` and, as text,
    ``metrics_text``. Indicators are kept by kind and by the prices they come from.
    Returns the run's folder, or None when all its dates were there already.
    """
    name = run_name(
        trees,
        feature_set,
        months=months,
        kpi_kind=kpi_kind,
        list_length=list_length,
        cutoffs=tuple(cutoffs),
        max_depth=max_depth,
        seed=seed,
    )
    prices, interactions = materialize(prices), materialize(interactions)
    source = fingerprint(prices.select(ITEM, TS, PRICE))
    traded = fingerprint(interactions.select(USER, ITEM, RATING, TS))
    out = f"{folder}/{name}_{source}_{traded}"
    store = RunStore(spark, out)
    finished = store.finished()
    todo = [s for s in splits if (s.rec_date, s.future_date) not in finished]
    if not todo:
        return None
    kpi_path = f"{folder}/kpis_{kpi_kind}_{source}"
    if not path_exists(spark, kpi_path):
        write_kpis(technical_indicators(prices, indicator_periods(kpi_kind)), kpi_path)
    kpis = read_kpis(spark, kpi_path)

    tables = split_dataset(interactions, prices, todo, priced_at_both_ends(), kpis)
    columns = features(feature_set)
    scores = materialize(
        learn_scores(
            kpis,
            tables.assets,
            todo,
            months,
            columns,
            lambda: ForestScorer(columns, trees=trees, max_depth=max_depth, seed=seed),
        )
    )
    evaluation = evaluate_scores(scores, prices, tables, cutoffs)
    per_user = materialize(evaluation.per_user)
    results = {
        "recs": recommend(scores, evaluation.eligible, tables.train, list_length).hint("rebalance", SPLIT),
        "customer_metrics": metrics_wide(per_user, METRICS, cutoffs),
        "metrics": mean_over_customers(per_user, evaluation.eligible),
    }
    part = store.write(results, todo)
    mine = spark.read.parquet(f"{out}/metrics/part={part}")
    write_metrics(mine, f"{out}/metrics_text/part={part}")
    return out
