"""One query per operator, over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.functions.series import Ewm, ewm
from assetloom.names import FUT, ITEM, PRICE, RANK, RATING, REC, SPLIT, TS, UNITS, USER, VALUE
from assetloom.operators import assets as A
from assetloom.operators import cleaning as C
from assetloom.operators import filters as FL
from assetloom.operators import graph as G
from assetloom.operators import indicators as D
from assetloom.operators import portfolio as P
from assetloom.operators import ranking_metrics as M
from assetloom.operators import recommend as R
from assetloom.operators import sampling as N
from assetloom.operators import splits as S
from assetloom.plans import dataset as DS
from assetloom.plans import recommendation as RUN
from assetloom.plans.customer_report import customer_report
from assetloom.session import materialize
from assetloom.sources import retail

FIRST, LAST, NUM_SPLIT, NUM_FUTURE = date(1998, 1, 1), date(2001, 6, 30), 6, 2
EARLY, MIDDLE, LATER, LATEST = date(1995, 3, 1), date(1999, 1, 4), date(2000, 1, 3), date(2001, 1, 1)
CUTOFFS = (1, 5, 10, 20, 50, 100, 1000)
SEED = 7
NEGATIVES = 3
DROP = 0.2
LOOKBACK = 200

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


class Tables:
    """The driver tables seen as trades and prices (weekly, asset = brand and type)."""

    def __init__(self, spark: SparkSession, sf_dir: str, profile: str = "brandtype_weekly"):
        self.spark, self.sf_dir, self.profile = spark, sf_dir, profile

    @cached_property
    def prices(self) -> DataFrame:
        """Written once: the grid, the filters and the statistics all read it."""
        return materialize(retail.prices(self.spark, self.sf_dir, self.profile))

    @cached_property
    def daily(self) -> DataFrame:
        return retail.prices(self.spark, self.sf_dir, "brand_daily")

    @cached_property
    def trades(self) -> DataFrame:
        return retail.trades(self.spark, self.sf_dir, self.profile)

    def moves(self, *flows: str) -> DataFrame:
        """The trades for the portfolio, with the columns that add up."""
        return retail.ordered_trades(self.spark, self.sf_dir, self.profile, *flows)

    @cached_property
    def ratings(self) -> DataFrame:
        return self.trades.select(USER, ITEM, RATING, TS)

    @cached_property
    def quotes(self) -> DataFrame:
        return retail.price_quotes(self.spark, self.sf_dir, self.profile)

    @cached_property
    def splits(self) -> list[S.Split]:
        return S.collect_splits(S.date_grid(self.prices, FIRST, LAST, NUM_SPLIT, NUM_FUTURE))

    @cached_property
    def split_tables(self) -> FL.SplitTables:
        return DS.split_dataset(self.ratings, self.prices, self.splits, RUN.priced_at_both_ends())

    @cached_property
    def scores(self) -> DataFrame:
        past = D.past_return(self.prices, [21])
        return materialize(
            R.indicator_scores(past, self.split_tables.assets, self.splits, "past_profitability_21d")
        )

    @cached_property
    def eligible(self) -> DataFrame:
        return materialize(M.eligible_customers(self.split_tables.customers, self.split_tables.test))

    def lists(self, k: int | None = None) -> DataFrame:
        return R.recommend(self.scores, self.eligible, self.split_tables.train, k)

    @cached_property
    def positives(self) -> DataFrame:
        return C.positive_assets(self.split_tables.test, self.split_tables.assets, (SPLIT,))

    @cached_property
    def roi(self) -> DataFrame:
        return A.profitability(self.prices, self.splits)

    @cached_property
    def valuation(self) -> DataFrame:
        return P.asset_valuation(self.prices, C.limit_prices(self.prices), self.splits)

    @cached_property
    def indexed(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        (mapped,), users, items = C.reindex(materialize(C.collapse_pairs(self.ratings)))
        return materialize(mapped), users, items


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    _QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# Added before rounding down: prices are cents over whole units, so exact halves
# are common, and a plain 0.5 would leave them to the last bit of a sum.
HALF_UP = 0.503


def rnd(df: DataFrame, **digits: int) -> DataFrame:
    """Round named columns; ``_`` gives the digits of every other double column."""
    rest = digits.pop("_", None)
    out: list[Column] = []
    for name, kind in df.dtypes:
        n = digits.get(name, rest if kind == "double" else None)
        column = F.col(f"`{name}`")
        out.append(column if n is None else (F.floor(column * 10.0**n + HALF_UP) / 10.0**n).alias(name))
    return df.select(*out)


# ------------------------------------------------------------------ A sources


@query
def src_interactions(t: Tables) -> DataFrame:
    return t.ratings


@query
def src_prices(t: Tables) -> DataFrame:
    return rnd(t.daily, price=4)


@query
def limit_prices(t: Tables) -> DataFrame:
    return rnd(C.limit_prices(t.prices), price_min_date=4, price_max_date=4, roi=6)


# ------------------------------------------------------------- B cleaning, keys


@query
def clean_zero_assets(t: Tables) -> DataFrame:
    return rnd(C.drop_zero_price_assets(t.quotes).select(ITEM, TS, PRICE), price=4)


@query
def clean_dedup_last(t: Tables) -> DataFrame:
    return rnd(C.keep_last_quote(t.quotes), price=4)


@query
def price_slice(t: Tables) -> DataFrame:
    return rnd(C.price_slice(t.daily, FIRST, LATER), price=4)


@query
def collapse_pairs(t: Tables) -> DataFrame:
    return C.collapse_pairs(t.ratings)


def _before_after(t: Tables, day: date = LATER) -> tuple[DataFrame, DataFrame]:
    return t.ratings.where(F.col(TS) < F.lit(day)), t.ratings.where(F.col(TS) >= F.lit(day))


@query
def warm_test(t: Tables) -> DataFrame:
    train, test = _before_after(t, EARLY)
    return C.warm_only(test, train).select(USER, ITEM, RATING, TS)


@query
def novel_test(t: Tables) -> DataFrame:
    train, test = _before_after(t)
    return C.novel_only(test, train).select(USER, ITEM, RATING, TS)


def _windows(t: Tables, days: int) -> list[S.Window3]:
    return [S.Window3(s.split_id, S.lookback(s, days), s.rec_date, s.future_date) for s in t.splits]


def _lookback_sets(t: Tables, repeated: bool) -> FL.SplitTables:
    both = materialize(S.windowed_split(t.ratings, _windows(t, DS.LOOKBACK_DAYS), repeated))
    return FL.SplitTables(
        tuple(t.splits),
        t.prices,
        train=both.where(F.col("part") == "train").drop("part"),
        test=both.where(F.col("part") == "test").drop("part"),
    )


@query
def flt_customer_in_train(t: Tables) -> DataFrame:
    return FL.customers_in_train(t.split_tables)


@query
def flt_asset_full_test(t: Tables) -> DataFrame:
    return FL.assets_with_full_test(t.split_tables)


@query
def flt_asset_test_price(t: Tables) -> DataFrame:
    return FL.assets_with_test_price(t.split_tables)


@query
def flt_ratings_not_in_train(t: Tables) -> DataFrame:
    _, _, test = FL.ratings_not_in_train(_lookback_sets(t, repeated=True))
    return test.select(SPLIT, USER, ITEM, RATING, TS)


@query
def data_filter(t: Tables) -> DataFrame:
    chosen = FL.DataFilter(
        assets=FL.assets_with_test_price,
        customers_limit_ratings=True,
        assets_limit_prices=True,
        assets_limit_ratings=True,
    ).apply(_lookback_sets(t, repeated=True))
    columns = (SPLIT, USER, ITEM, RATING, TS)
    return (
        chosen.train.select(F.lit("train").alias("part"), *columns)
        .unionByName(chosen.test.select(F.lit("test").alias("part"), *columns))
    )


@query
def binarize(t: Tables) -> DataFrame:
    rated = t.trades.select(USER, ITEM, F.col(UNITS).alias(RATING), TS)
    return C.binarize(rated, 10.0)


@query
def normalize_ratings(t: Tables) -> DataFrame:
    rated = t.trades.select(USER, ITEM, F.col(UNITS).alias(RATING), TS)
    train, test = C.normalize_ratings(rated.where(F.col(TS) < F.lit(LATER)), rated.where(F.col(TS) >= F.lit(LATER)))
    return rnd(
        train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))), col_rating=6
    )


@query
def intersect_stats(t: Tables) -> DataFrame:
    train, test = _before_after(t)
    return C.column_counts(C.warm_only(test, train).select(USER, ITEM, RATING, TS))


@query
def reindex(t: Tables) -> DataFrame:
    return t.indexed[0].select(USER, ITEM, "user_idx", "item_idx")


@query
def positive_assets(t: Tables) -> DataFrame:
    return t.positives


# -------------------------------------------------------------------- C splits


@query
def date_grid(t: Tables) -> DataFrame:
    return S.date_grid(t.prices, FIRST, LAST, NUM_SPLIT, NUM_FUTURE)


@query
def date_grid_frac(t: Tables) -> DataFrame:
    return S.date_grid(t.prices, FIRST, LAST, NUM_SPLIT, 1.5)


@query
def split_two_way(t: Tables) -> DataFrame:
    return S.two_way_split(t.ratings, t.splits)


@query
def split_valid(t: Tables) -> DataFrame:
    return S.chain_split(t.ratings, [MIDDLE, LATER], ["train", "valid"])


@query
def split_three_way(t: Tables) -> DataFrame:
    return S.chain_split(t.ratings, [MIDDLE, LATER, LATEST], ["train", "valid", "test"])


@query
def split_dataset(t: Tables) -> DataFrame:
    tables = DS.split_dataset(t.ratings, t.prices, t.splits)
    columns = (SPLIT, ITEM)
    sets = [
        tables.split_prices().select(F.lit("prices").alias("part"), *columns, F.lit(None).cast("long").alias(USER), TS),
        tables.train.select(F.lit("train").alias("part"), *columns, USER, TS),
        tables.test.select(F.lit("test").alias("part"), *columns, USER, TS),
    ]
    return sets[0].unionByName(sets[1]).unionByName(sets[2])


@query
def split_lookback(t: Tables) -> DataFrame:
    """A look-back that binds: trades from before it count for nothing."""
    columns = ("part", SPLIT, USER, ITEM, RATING, TS)
    return S.windowed_split(t.ratings, _windows(t, LOOKBACK)).select(*columns)


@query
def split_with_valid(t: Tables) -> DataFrame:
    later = t.splits[1:]
    tables = DS.split_dataset_with_valid(t.ratings, t.prices, later, [s.rec_date for s in t.splits[:-1]])
    columns = (SPLIT, USER, ITEM, RATING, TS)
    return (
        tables.train.select(F.lit("train").alias("part"), *columns)
        .unionByName(tables.valid.select(F.lit("valid").alias("part"), *columns))
        .unionByName(tables.test.select(F.lit("test").alias("part"), *columns))
    )


# ---------------------------------------------------------------- D indicators


@query
def ind_avg_price(t: Tables) -> DataFrame:
    return rnd(D.average_price(t.daily), _=4)


@query
def ind_roi(t: Tables) -> DataFrame:
    return rnd(D.past_return(t.daily), price=4, _=6)


@query
def ind_volatility(t: Tables) -> DataFrame:
    return rnd(D.volatility(t.daily), price=4, _=6)


@query
def ind_volatility_expanding(t: Tables) -> DataFrame:
    return rnd(D.volatility(t.daily, [0]), price=4, _=6)


@query
def ind_sharpe(t: Tables) -> DataFrame:
    return rnd(D.sharpe(t.daily), price=4, _=6)


@query
def ind_ema(t: Tables) -> DataFrame:
    return rnd(D.exponential_mean(t.daily, [12, 26], False, "ema_{}"), _=4)


@query
def ind_ema_spans(t: Tables) -> DataFrame:
    """Spans far apart, both forms, in one call."""
    specs = [Ewm(PRICE, s, a, f"{'adj' if a else 'ema'}_{s}") for a in (False, True) for s in (2, 12, 189, 500)]
    return rnd(ewm(t.daily, specs), _=4)


@query
def ind_macd(t: Tables) -> DataFrame:
    return rnd(D.macd(t.daily), _=4)


@query
def ind_momentum(t: Tables) -> DataFrame:
    return rnd(D.momentum(t.daily), _=4)


@query
def ind_roc(t: Tables) -> DataFrame:
    return rnd(D.rate_of_change(t.daily), price=4, _=6)


@query
def ind_rsi(t: Tables) -> DataFrame:
    return rnd(D.relative_strength(t.daily), price=4, _=6)


@query
def ind_dco(t: Tables) -> DataFrame:
    return rnd(D.detrended_oscillator(t.daily), _=4)


@query
def ind_min_max(t: Tables) -> DataFrame:
    return rnd(D.rolling_extremes(t.daily), _=4)


@query
def ind_exp_mean(t: Tables) -> DataFrame:
    return rnd(D.exponential_mean(t.daily, D.LONG, True, "exp_mean_{}d"), _=4)


@query
def ind_smoothing(t: Tables) -> DataFrame:
    return rnd(D.smooth(D.average_price(t.daily, [21])), _=4)


@query
def kpi_full(t: Tables) -> DataFrame:
    return rnd(D.technical_indicators(t.daily), _=4)


@query
def kpi_short(t: Tables) -> DataFrame:
    return rnd(D.technical_indicators(t.daily, D.SHORT), _=4)


@query
def kpi_basic(t: Tables) -> DataFrame:
    return rnd(D.return_and_volatility(t.daily), price=4, _=6)


# -------------------------------------------------------------------- E assets


@query
def asset_roi(t: Tables) -> DataFrame:
    return rnd(
        A.asset_returns(t.prices, t.splits).select(SPLIT, REC, FUT, ITEM, "price_current", "price_future", "ROI"),
        price_current=4,
        price_future=4,
        ROI=6,
    )


@query
def asset_roi_scaled(t: Tables) -> DataFrame:
    return rnd(A.asset_returns(t.prices, t.splits).select(SPLIT, ITEM, "AnnROI", "MonthROI"), _=6)


@query
def asset_volatility(t: Tables) -> DataFrame:
    return rnd(A.asset_volatility(t.prices), _=6)


@query
def profitability(t: Tables) -> DataFrame:
    return rnd(t.roi, _=6)


@query
def profitability_fallback(t: Tables) -> DataFrame:
    top = t.prices.groupBy(ITEM).agg(F.max(PRICE).alias("max_price"))
    return rnd(A.profitability(t.prices, t.splits, top), _=6)


@query
def volatility_window(t: Tables) -> DataFrame:
    return rnd(A.window_volatility(t.prices, t.splits), _=6)


@query
def asset_summary(t: Tables) -> DataFrame:
    return rnd(A.asset_summary(materialize(A.asset_stats(t.prices, t.splits))), _=6)


@query
def asset_index_roi(t: Tables) -> DataFrame:
    return rnd(A.index_returns(A.asset_returns(t.prices, t.splits)), _=6)


@query
def split_census(t: Tables) -> DataFrame:
    return A.split_census(t.ratings, t.prices, DS.split_dataset(t.ratings, t.prices, t.splits))


@query
def split_census_all(t: Tables) -> DataFrame:
    """The census without a customer filter."""
    tables = DS.split_dataset(t.ratings, t.prices, t.splits, FL.DataFilter(customers=FL.all_customers))
    return A.split_census(t.ratings, t.prices, tables)


@query
def weighted_choice_excluding(t: Tables) -> DataFrame:
    """Draws by popularity per customer, the most traded asset left out."""
    edges, users, _ = t.indexed
    weights = edges.groupBy("item_idx").agg(F.count(F.lit(1)).alias("n"))
    top = weights.agg(F.max_by("item_idx", F.struct("n", -F.col("item_idx"))).alias("item_idx"))
    return N.weighted_sample(N.excluding(weights, top, "item_idx"), users.select("user_idx"), 4, SEED, "item_idx", "user_idx")


@query
def asset_stats(t: Tables) -> DataFrame:
    return rnd(A.asset_stats(t.prices, t.splits), price_current=4, price_future=4, _=6)


# ----------------------------------------------------------------- F customers


@query
def holdings_replay(t: Tables) -> DataFrame:
    return P.holdings_replay(t.moves(UNITS)).select(
        USER, ITEM, TS, F.col("seq.l_orderkey").alias("l_orderkey"), RATING, UNITS, "holdings"
    )


@query
def holdings_at_split(t: Tables) -> DataFrame:
    return P.holdings_at_splits(t.moves(UNITS), t.splits).drop("written_off")


@query
def holdings_writeoff(t: Tables) -> DataFrame:
    return P.holdings_at_splits(t.moves(UNITS), t.splits, t.valuation)


@query
def portfolio_open_value(t: Tables) -> DataFrame:
    held = P.positions(t.moves(UNITS), t.valuation, t.splits)
    return rnd(held.groupBy(SPLIT, USER).agg(F.sum("open_value").alias("open_value")), _=2)


@query
def portfolio_flows(t: Tables) -> DataFrame:
    held = P.positions(t.moves(UNITS, VALUE), t.valuation, t.splits, VALUE)
    return rnd(held.groupBy(SPLIT, USER).agg(F.sum("bought").alias("bought"), F.sum("sold").alias("sold")), _=2)


@query
def portfolio_close_value(t: Tables) -> DataFrame:
    held = P.positions(t.moves(UNITS), t.valuation, t.splits)
    return rnd(
        held.groupBy(SPLIT, USER).agg(
            F.sum("close_units").alias("close_units"), F.sum("close_value").alias("close_value")
        ),
        _=2,
    )


@query
def customer_returns(t: Tables) -> DataFrame:
    held = P.positions(t.moves(UNITS), t.valuation, t.splits)
    return rnd(P.customer_returns(held, t.splits), buy_price=2, sell_price=2, _=6)


@query
def customer_summary(t: Tables) -> DataFrame:
    totals = materialize(customer_report(t.moves(UNITS), t.prices, C.limit_prices(t.prices), t.splits))
    return rnd(P.customer_summary(totals, t.splits), _=5)


@query
def customer_stats(t: Tables) -> DataFrame:
    totals = customer_report(t.moves(UNITS, VALUE), t.prices, C.limit_prices(t.prices), t.splits, VALUE)
    return rnd(
        totals.where(F.col("buy_price") > 0).groupBy(SPLIT).agg(
            F.count(F.lit(1)).alias("customers"),
            F.sum("buy_price").alias("buy_price"),
            F.sum("sell_price").alias("sell_price"),
            F.avg("profitability").alias("mean_profitability"),
        ),
        buy_price=0,
        sell_price=0,
        mean_profitability=5,
    )


# ------------------------------------------------------------ G recommendations


@query
def forward_target(t: Tables) -> DataFrame:
    return rnd(R.forward_target(t.daily, 6).drop("final_ts"), price=4, final_price=4, target=6)


def _indicators(t: Tables) -> DataFrame:
    return materialize(D.technical_indicators(t.prices, D.indicator_periods("short")))


@query
def training_set(t: Tables) -> DataFrame:
    rows = R.training_set(_indicators(t), t.split_tables.assets, t.splits, 6, D.features("full_short"))
    return rnd(rows, _=4)


def _forest_scores(t: Tables, kpis: DataFrame) -> DataFrame:
    names = D.features("full_short")
    return R.learn_scores(kpis, t.split_tables.assets, t.splits, 6, names, lambda: R.ForestScorer(names))


@query
def rf_scores(t: Tables) -> DataFrame:
    return _forest_scores(t, _indicators(t))


@query
def rf_scored_assets(t: Tables) -> DataFrame:
    """What holds for the forest's scores whatever its trees: who is scored, and within which bounds.

    A forest's score is a mean of targets it has learnt from. Splits without any to learn from
    get random scores and are left out.
    """
    kpis = _indicators(t)
    scores = materialize(_forest_scores(t, kpis))
    learnt = R.training_set(kpis, t.split_tables.assets, t.splits, 6, D.features("full_short"))
    bounds = learnt.groupBy(SPLIT).agg(F.min("target").alias("low"), F.max("target").alias("high"))
    # one row per split
    judged = scores.join(F.broadcast(bounds), SPLIT)
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    within = F.col("score").between(F.col("low") - 1e-9, F.col("high") + 1e-9)
    return judged.select(SPLIT, ITEM, finite.alias("finite"), within.alias("within_targets"))


@query
def recommend_cross(t: Tables) -> DataFrame:
    pairs = R.recommend_by_pairs(t.scores, t.eligible, t.split_tables.train)
    return rnd(pairs, score=6)


@query
def recommend_ranked(t: Tables) -> DataFrame:
    return rnd(t.lists(), score=6)


@query
def recommendation_run(t: Tables) -> DataFrame:
    return rnd(RUN.evaluate_scores(t.scores, t.prices, t.split_tables, CUTOFFS).overall, value=6)


# --------------------------------------------------------------- H evaluation


@query
def topk(t: Tables) -> DataFrame:
    return M.top_k(t.lists(10), 5).select(SPLIT, USER, ITEM, RANK)


def _kpi(t: Tables, values: DataFrame, metric: str) -> DataFrame:
    named = values.withColumnRenamed("value", metric)
    return M.kpi_at_k(t.lists(max(CUTOFFS)), named, CUTOFFS, t.eligible, [metric])


@query
def kpi_at_k(t: Tables) -> DataFrame:
    return rnd(_kpi(t, t.roi, "profitability"), value=6)


@query
def kpi_at_k_mean(t: Tables) -> DataFrame:
    per_user = _kpi(t, t.roi, "profitability")
    return rnd(M.mean_over_customers(per_user, t.eligible), value=6)


@query
def kpi_annual_at_k(t: Tables) -> DataFrame:
    values = M.annual_values(t.roi, t.splits)
    return rnd(_kpi(t, values, "annualized_prof"), value=6)


@query
def kpi_monthly_at_k(t: Tables) -> DataFrame:
    values = M.monthly_values(t.roi, t.splits)
    return rnd(_kpi(t, values, "monthly_prof"), value=6)


@query
def volatility_at_k(t: Tables) -> DataFrame:
    values = A.window_volatility(t.prices, t.splits)
    return rnd(_kpi(t, values, "volatility"), value=6)


@query
def kpi_at_k_fixed_denominator(t: Tables) -> DataFrame:
    values = t.roi.withColumnRenamed("value", "profitability_fixed")
    return rnd(M.kpi_at_k_fixed(t.lists(), values, (-1, *CUTOFFS), t.eligible, ["profitability_fixed"]), value=6)


@query
def ndcg_at_k(t: Tables) -> DataFrame:
    return rnd(M.ndcg_at_k(t.lists(max(CUTOFFS)), t.positives, t.eligible, CUTOFFS), value=6)


@query
def ndcg_history(t: Tables) -> DataFrame:
    # history: assets the customer already had before the next split, so some positives drop out
    history = t.ratings.where(F.col(TS) < F.lit(LATER)).select(USER, ITEM)
    return rnd(M.ndcg_at_k(t.lists(max(CUTOFFS)), t.positives, t.eligible, CUTOFFS, history), value=6)


@query
def metrics_wide(t: Tables) -> DataFrame:
    run = RUN.evaluate_lists(t.lists(max(CUTOFFS)), t.prices, t.split_tables, CUTOFFS)
    return rnd(run.wide(CUTOFFS), _=6)


# ---------------------------------------------------------- I graph and sampling


@query
def popularity(t: Tables) -> DataFrame:
    return rnd(N.popularity(t.ratings, ITEM), share=6)


def _weights(t: Tables) -> DataFrame:
    return N.popularity(t.indexed[0], "item_idx")


@query
def weighted_sample(t: Tables) -> DataFrame:
    return N.weighted_sample(_weights(t), t.indexed[1], 4, SEED, "item_idx", "user_idx")


@query
def weighted_sample_distinct(t: Tables) -> DataFrame:
    return N.weighted_sample_distinct(_weights(t), t.indexed[1], 3, SEED, "item_idx", "user_idx")


@query
def neg_pointwise(t: Tables) -> DataFrame:
    edges, _, items = t.indexed
    return N.pointwise_pairs(edges, items, NEGATIVES, SEED)


@query
def neg_pairwise(t: Tables) -> DataFrame:
    edges, _, items = t.indexed
    return N.pairwise_triples(edges, items, SEED)


@query
def neg_multi(t: Tables) -> DataFrame:
    edges, _, items = t.indexed
    rows = N.multi_negative_rows(edges, items, NEGATIVES, SEED)
    return rows.select("user_idx", "pos_idx", *[F.get("neg_idxs", F.lit(i)).alias(f"neg_{i}") for i in range(NEGATIVES)])


def _edges(df: DataFrame) -> DataFrame:
    return rnd(df, weight=6)


@query
def graph_adjacency(t: Tables) -> DataFrame:
    edges, users, _ = t.indexed
    return G.adjacency(edges, users)


@query
def graph_mean_adj(t: Tables) -> DataFrame:
    edges, users, _ = t.indexed
    return _edges(G.row_normalized(edges, users))


@query
def graph_norm_adj(t: Tables) -> DataFrame:
    edges, users, _ = t.indexed
    return _edges(G.row_normalized_with_loops(edges, users))


@query
def graph_constraint(t: Tables) -> DataFrame:
    return rnd(G.degree_constraints(t.indexed[0]), beta=6)


@query
def graph_sym_norm(t: Tables) -> DataFrame:
    _, users, items = t.indexed
    repeated = t.ratings.join(users, USER).join(items, ITEM)
    return _edges(G.symmetric_normalized(repeated, users))


@query
def graph_node_dropout(t: Tables) -> DataFrame:
    edges, users, items = t.indexed
    return _edges(G.symmetric_normalized(G.drop_nodes(edges, users, items, DROP, SEED), users))


@query
def graph_edge_dropout(t: Tables) -> DataFrame:
    edges, users, _ = t.indexed
    return _edges(G.symmetric_normalized(G.drop_edges(edges, DROP, SEED), users))


@query
def user_vectors(t: Tables) -> DataFrame:
    _, users, items = t.indexed
    return G.user_vectors(t.ratings.join(users, USER).join(items, ITEM))


@query
def random_features(t: Tables) -> DataFrame:
    drawn = G.random_features(t.indexed[1], "user_idx", 4, SEED)
    return rnd(drawn.select("user_idx", F.posexplode("features").alias("dim", "value")), value=6)
