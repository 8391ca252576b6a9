"""Learning targets, asset scoring and recommendation lists."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import as_uniform, with_draws
from ..functions.numbering import rank_in_groups
from ..names import ITEM, MONTH_DAYS, PRICE, RANK, REC, SCORE, SPLIT, TS, USER
from ..session import materialize
from .splits import Split, per_split

ROWS_PER_MONTH = 21


# ------------------------------------------------------------------- learning


def forward_target(kpis: DataFrame, months: int) -> DataFrame:
    """Add ``final_price`` (``21 * months`` rows ahead) and ``target``, the return up to it."""
    series = Window.partitionBy(ITEM).orderBy(TS)
    ahead = kpis.withColumn("final_price", F.lead(PRICE, ROWS_PER_MONTH * months).over(series)).withColumn(
        "final_ts", F.lead(TS, ROWS_PER_MONTH * months).over(series)
    )
    return ahead.where(F.col(PRICE) > 0.0).withColumn(
        "target", F.try_divide(F.col("final_price") - F.col(PRICE), F.col(PRICE))
    )


def training_set(
    kpis: DataFrame,
    assets: DataFrame,
    splits: Sequence[Split],
    months: int,
    features: Sequence[str],
    strict: bool = False,
) -> DataFrame:
    """Complete (features, target) rows of eligible assets that end before each split.

    Rows must lie ``30 * months`` days before the split date. ``strict`` also
    requires the target's price to be from before that date.
    """
    labelled = forward_target(kpis, months)
    usable = F.col("final_ts") < F.col(REC) if strict else None
    rows = labelled.select(ITEM, TS, "final_ts", *features, "target")
    return (
        per_split(rows, splits, usable, after=F.date_add(F.col(TS), MONTH_DAYS * months))
        .join(assets.select(SPLIT, ITEM), [SPLIT, ITEM], "left_semi")
        .select(SPLIT, ITEM, TS, *features, "target")
        .na.drop()
    )


class Scorer(Protocol):
    """A recommender: learn from labelled rows, then score candidate rows.

    ``score`` returns (col_item, score) for rows carrying the feature columns.
    """

    def fit(self, rows: DataFrame) -> None: ...

    def score(self, candidates: DataFrame) -> DataFrame: ...


class HashScorer:
    """Seeded random scores."""

    def __init__(self, seed: int = 0):
        self.seed = seed

    def fit(self, rows: DataFrame) -> None:
        pass

    def score(self, candidates: DataFrame) -> DataFrame:
        number = F.conv(F.substring(F.md5(F.col(ITEM).cast("string")), 1, 8), 16, 10).cast("long")
        drawn = with_draws(candidates.select(ITEM), self.seed, {"_draw": [number]})
        return drawn.select(ITEM, as_uniform(F.col("_draw")).alias(SCORE))


class ColumnScorer:
    """Scores assets by one of their indicators."""

    def __init__(self, column: str):
        self.column = column

    def fit(self, rows: DataFrame) -> None:
        pass

    def score(self, candidates: DataFrame) -> DataFrame:
        return candidates.select(ITEM, F.col(self.column).alias(SCORE))


class ForestScorer:
    """Random forest regression of the forward return; seeded random scores when there is nothing to learn from.

    Trees consider all features at every split. Depth and bins bound the model
    size; the forest is distributed over the rows, so the training set is never
    gathered.
    """

    def __init__(
        self, features: Sequence[str], trees: int = 20, max_depth: int = 12, max_bins: int = 64, seed: int = 0
    ):
        self.features, self.trees, self.seed = list(features), trees, seed
        self.max_depth, self.max_bins = max_depth, max_bins
        self.model = None

    def _vectors(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=self.features, outputCol="_features").transform(rows)

    def fit(self, rows: DataFrame) -> None:
        from pyspark.ml.regression import RandomForestRegressor

        if rows.isEmpty():
            self.model = None
            return
        forest = RandomForestRegressor(
            featuresCol="_features",
            labelCol="target",
            predictionCol=SCORE,
            numTrees=self.trees,
            featureSubsetStrategy="all",
            maxDepth=self.max_depth,
            maxBins=self.max_bins,
            seed=self.seed,
        )
        self.model = forest.fit(self._vectors(rows).select("_features", "target"))

    def score(self, candidates: DataFrame) -> DataFrame:
        if self.model is None:
            return HashScorer(self.seed).score(candidates)
        return self.model.transform(self._vectors(candidates)).select(ITEM, SCORE)


# models fitted at the same time; each fit is a distributed job of its own
PARALLEL_FITS = 4


def learn_scores(
    kpis: DataFrame,
    assets: DataFrame,
    splits: Sequence[Split],
    months: int,
    features: Sequence[str],
    make_scorer,
    strict: bool = False,
) -> DataFrame:
    """(split_id, col_item, score): fit one model per split and score the assets of its date.

    ``kpis`` is read once per split, so hand over a written table. The labelled rows are
    written once for all splits; the fits are independent jobs and run side by side.
    """
    labelled = materialize(forward_target(kpis, months).select(ITEM, TS, "final_ts", *features, "target").na.drop())

    def one(s: Split) -> DataFrame:
        own = assets.where(F.col(SPLIT) == s.split_id).select(ITEM)
        rows = labelled.where(F.col(TS) < F.lit(s.rec_date - timedelta(days=MONTH_DAYS * months)))
        if strict:
            rows = rows.where(F.col("final_ts") < F.lit(s.rec_date))
        scorer = make_scorer()
        scorer.fit(rows.join(own, ITEM, "left_semi").select(*features, "target"))
        # an asset whose indicators are not complete yet cannot be scored
        today = kpis.where(F.col(TS) == F.lit(s.rec_date)).na.drop(subset=list(features)).join(own, ITEM, "left_semi")
        return scorer.score(today).select(F.lit(s.split_id).alias(SPLIT), ITEM, SCORE)

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, splits))


def indicator_scores(kpis: DataFrame, assets: DataFrame, splits: Sequence[Split], column: str) -> DataFrame:
    """(split_id, col_item, score) by an indicator on the split date, all splits in one plan."""
    days = [s.rec_date for s in splits]
    on_days = kpis.where(F.col(TS).isin(days))
    today = per_split(on_days, splits, after=F.date_sub(F.col(TS), 1), until=F.col(TS))
    return (
        today.select(SPLIT, ITEM, F.col(column).alias(SCORE))
        .where(F.col(SCORE).isNotNull())
        .join(assets.select(SPLIT, ITEM), [SPLIT, ITEM], "left_semi")
    )


# ------------------------------------------------------------ recommendations


def rank_assets(scores: DataFrame) -> DataFrame:
    """(split_id, col_item, score, asset_rank, n_assets): best score first, ties by asset.

    One row per asset and split, numbered range by range: a catalogue of any length
    is sorted by many tasks, ties included.
    """
    order = [F.col(SCORE).desc(), F.col(ITEM)]
    ranked = rank_in_groups(scores.select(SPLIT, ITEM, SCORE), [SPLIT], order, "asset_rank", "n_assets")
    return ranked.select(SPLIT, ITEM, SCORE, "asset_rank", "n_assets")


def seen_ranks(ranking: DataFrame, seen: DataFrame, customers: DataFrame) -> DataFrame:
    """Where in the ranking the assets a customer already has stand.

    One row per customer, split and already seen ranked asset: ``asset_rank``
    and ``skipped``, the number of seen assets up to it. ``unseen`` is how many
    recommendable assets stand before it, so the list position of any other
    asset follows from its rank without building the list.
    """
    mine = (
        seen.select(SPLIT, USER, ITEM)
        .join(customers.select(SPLIT, USER), [SPLIT, USER], "left_semi")
        .join(ranking.select(SPLIT, ITEM, "asset_rank"), [SPLIT, ITEM])
    )
    per_user = Window.partitionBy(SPLIT, USER).orderBy("asset_rank")
    return mine.withColumn("skipped", F.row_number().over(per_user)).withColumn(
        "unseen", F.col("asset_rank") - F.col("skipped")
    )


def recommend(
    scores: DataFrame,
    customers: DataFrame,
    seen: DataFrame | None = None,
    k: int | None = None,
) -> DataFrame:
    """Ranked lists (split_id, col_user, col_item, score, rank) without assets in ``seen``.

    Scores do not depend on the customer, so a list is the ranking with a few
    gaps. The gaps cut it into runs of consecutive ranks; runs are expanded
    straight to list rows (never more than the answer holds) and looked up in
    the ranking. ``k`` limits the lists to their first k entries; without it the
    lists are complete. Customers and their seen assets are never paired with
    the whole ranking, which is written so that its real size decides how the list rows
    meet it: they do not move when it is small.
    """
    ranking = materialize(rank_assets(scores))
    sizes = ranking.select(SPLIT, "n_assets").distinct()
    # one row per split
    people = customers.select(SPLIT, USER).distinct().join(F.broadcast(sizes), SPLIT)
    starts = people.select(
        SPLIT, USER, F.lit(0).alias("skipped"), F.lit(0).alias("unseen"), F.col("n_assets").cast("int").alias("n_assets")
    )
    if seen is not None:
        gaps = seen_ranks(ranking, seen, customers).select(
            SPLIT, USER, "skipped", "unseen", F.lit(None).cast("int").alias("n_assets")
        )
        starts = starts.unionByName(gaps)
    run = Window.partitionBy(SPLIT, USER).orderBy("skipped")
    whole = Window.partitionBy(SPLIT, USER)
    # list length: ranked assets minus the seen ones
    length = F.max("n_assets").over(whole) - F.max("skipped").over(whole)
    runs = starts.select(
        SPLIT, USER, "skipped", "unseen", F.coalesce(F.lead("unseen").over(run), length).alias("_until")
    )
    if k is not None:
        runs = runs.withColumn("_until", F.least(F.col("_until"), F.lit(k)))
    listed = runs.where(F.col("_until") > F.col("unseen")).select(
        SPLIT,
        USER,
        "skipped",
        F.explode(F.sequence(F.col("unseen") + 1, F.col("_until"))).alias(RANK),
    )
    return (
        listed.withColumn("asset_rank", F.col(RANK) + F.col("skipped"))
        .join(ranking.select(SPLIT, "asset_rank", ITEM, SCORE), [SPLIT, "asset_rank"])
        .select(SPLIT, USER, ITEM, SCORE, F.col(RANK).cast("int").alias(RANK))
    )


def recommend_by_pairs(scores: DataFrame, customers: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Complete lists, unordered: every eligible (customer, asset) of a split that is not in ``seen``."""
    return recommend(scores, customers, seen).drop(RANK)


def run_name(trees: int, feature_set: str, **parameters: object) -> str:
    """``rfr_<trees>_<features>_<key>``; the key stands for all other parameters."""
    text = repr(sorted(parameters.items())).encode()
    return f"rfr_{trees}_{feature_set}_{hashlib.sha256(text).hexdigest()[:10]}"
