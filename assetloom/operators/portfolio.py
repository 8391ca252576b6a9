"""Customer portfolios: holdings replay, valuation and returns.

Holdings never go below zero: a sale of more than is held leaves zero. Walking
trades one by one is avoided by an identity on running sums: with S the running
sum of signed units, holdings are S - min(0, min of S so far). A stretch of
trades is therefore summarised by two numbers, its net units and the lowest
running sum inside it, and summaries of consecutive stretches compose.

The summaries of a pair form a tree: blocks of trades of a day, stretches of
``TREE_DAYS`` days, the pair. A level is composed by its parent's key, so up to the
last one a single very active (customer, asset) pair is spread over many tasks; the
last one sees a row per stretch, which the calendar bounds. Holdings after every trade
come back down the tree: what stands before a trade is what stands before its
stretch, its block, and inside the block.

Every level moves its rows, and most customers have few trades. So the tree is only for
customers whose trades are many for a task: trades are counted by the customer's hash, and
those of the other buckets are dealt once, by customer, and replayed where they lie.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import over_days
from ..functions.quantiles import exact_quantiles
from ..names import BLOCK, FUT, ITEM, MONTH_DAYS, PRICE, RATING, REC, SEQ, SPLIT, TS, UNITS, USER, YEAR_DAYS
from ..session import PACKED, materialize
from .splits import Split, constants, reached, split_array, split_value

# Fixed value: holdings smaller than this count as zero.
DUST = 1e-8
ROWS_PER_BLOCK = 1 << 20
# days of a stretch in the tree of summaries
TREE_DAYS = 32
# customers are counted together by their hash; the tree serves buckets with more rows than this, and than
# so many times the average
CUSTOMER_BUCKETS = 1 << 14
ACTIVE_ROWS = 1 << 17
ACTIVE_TIMES = 4
_EPOCH = date(1970, 1, 1)
_PAIR = (USER, ITEM)
_SUMMARY = ("k", "net", "low", "bought", "sold")


def _with_blocks(trades: DataFrame) -> DataFrame:
    """Make sure trades carry a coarse order key that bounds the rows of a block."""
    if BLOCK in trades.columns:
        return trades
    return trades.withColumn(BLOCK, F.floor(F.col(SEQ) / ROWS_PER_BLOCK))


def _by_activity(trades: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Written trades in two: those of most customers, dealt by customer, and those of very active ones, if any."""
    bucket = F.pmod(F.xxhash64(USER), F.lit(CUSTOMER_BUCKETS))
    most = max(ACTIVE_ROWS, ACTIVE_TIMES * trades.count() // CUSTOMER_BUCKETS)
    counts = trades.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    # fewer than CUSTOMER_BUCKETS / ACTIVE_TIMES, as each holds that many times the average
    active = [r["bucket"] for r in counts.where(F.col("n") > most).collect()]
    if not active:
        return trades.repartition(USER), None
    return trades.where(~bucket.isin(active)).repartition(USER), trades.where(bucket.isin(active))


def signed_units(units: Column, rating: Column) -> Column:
    return F.when(rating > 0, F.abs(units)).otherwise(-F.abs(units))


def _held(total: Column, lowest: Column) -> Column:
    """Holdings from a running sum and the lowest running sum so far, both started at zero."""
    level = total - F.least(F.lit(0.0), lowest)
    return F.when(level < DUST, 0.0).otherwise(level)


def _steps(trades: DataFrame) -> DataFrame:
    """Running sum of signed units inside (customer, asset, date, block): at most a block of rows each."""
    inside = (
        Window.partitionBy(*_PAIR, TS, BLOCK).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)
    )
    moves = _with_blocks(trades).withColumn("_d", signed_units(F.col(UNITS), F.col(RATING)))
    return moves.withColumn("_s", F.sum("_d").over(inside))


def _sums(flow: str) -> list[Column]:
    """The summary of a stretch of trades, from their signed units and running sums."""
    buys = F.col(RATING) > 0
    return [
        F.sum("_d").alias("net"),
        F.min("_s").alias("low"),
        F.sum(F.when(buys, F.abs(F.col(flow))).otherwise(0.0)).alias("bought"),
        F.sum(F.when(~buys, F.abs(F.col(flow))).otherwise(0.0)).alias("sold"),
    ]


def _blocks(steps: DataFrame, flow: str = UNITS) -> DataFrame:
    return steps.groupBy(*_PAIR, TS, BLOCK).agg(*_sums(flow))


def _stretched(blocks: DataFrame) -> DataFrame:
    """Add the stretch of days a block belongs to, its parent in the tree."""
    return blocks.withColumn("_stretch", F.floor(F.datediff(F.col(TS), F.lit(_EPOCH)) / TREE_DAYS))


def _standing_before(rows: DataFrame, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_start``, the sum of the summaries before a row of its group, and ``_floor``, the lowest sum in them."""
    before = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_start", F.coalesce(F.sum("net").over(before), F.lit(0.0))).withColumn(
        "_floor", F.coalesce(F.min(F.col("_start") + F.col("low")).over(before), F.lit(0.0))
    )


def _composed(rows: DataFrame, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One level up the tree: consecutive summaries of a group as one."""
    before = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.sum(c).alias(c) for c in ("net", "bought", "sold") if c in rows.columns]
    return (
        rows.withColumn("_start", F.coalesce(F.sum("net").over(before), F.lit(0.0)))
        .groupBy(*groups)
        .agg(F.min(F.col("_start") + F.col("low")).alias("low"), *sums)
    )


def holdings_replay(trades: DataFrame) -> DataFrame:
    """Trades with the customer's holdings of the asset after each of them."""
    usual, active = _by_activity(materialize(_with_blocks(trades), PACKED))
    replayed = _replay_in_place(usual)
    return replayed if active is None else replayed.unionByName(_replay_by_tree(active))


def _replay_in_place(trades: DataFrame) -> DataFrame:
    """Holdings as running sums over the whole pair, for trades that are dealt by customer."""
    keys = (*_PAIR, TS, BLOCK)
    block = Window.partitionBy(*keys).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)
    pair = Window.partitionBy(*_PAIR).orderBy(TS, BLOCK, SEQ).rowsBetween(Window.unboundedPreceding, 0)
    known = reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in keys))
    held = _held(F.col("_s"), F.col("_l"))
    return (
        trades.withColumn("_d", signed_units(F.col(UNITS), F.col(RATING)))
        # nothing is said of a trade before the first units of its block
        .withColumn("_any", F.count("_d").over(block) > 0)
        .withColumn("_s", F.sum("_d").over(pair))
        .withColumn("_l", F.min("_s").over(pair))
        .withColumn("holdings", F.when(F.col("_any"), held))
        # trades without a key, date or block count for those after them, and get no holdings of their own
        .where(known)
        .drop("_d", "_any", "_s", "_l")
    )


def _replay_by_tree(trades: DataFrame) -> DataFrame:
    steps = _steps(trades)
    # summaries of the blocks, read for the way up and the way down
    blocks = materialize(_stretched(_blocks(steps)).select(*_PAIR, "_stretch", TS, BLOCK, "net", "low"))
    stretch = [*_PAIR, "_stretch"]
    above = _standing_before(_composed(blocks, stretch, (TS, BLOCK)), _PAIR, ("_stretch",)).select(
        *stretch, F.col("_start").alias("_above"), F.col("_floor").alias("_above_floor")
    )
    before = (
        _standing_before(blocks, stretch, (TS, BLOCK))
        .join(above, stretch)
        .select(
            *_PAIR,
            TS,
            BLOCK,
            (F.col("_above") + F.col("_start")).alias("_start"),
            F.least(F.col("_above_floor"), F.col("_above") + F.col("_floor")).alias("_floor"),
        )
    )
    inside = Window.partitionBy(*_PAIR, TS, BLOCK).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)
    lowest = F.min("_s").over(inside)
    return (
        steps.withColumn("_l", lowest)
        .join(before, [*_PAIR, TS, BLOCK])
        .withColumn(
            "holdings", _held(F.col("_start") + F.col("_s"), F.least(F.col("_floor"), F.col("_start") + F.col("_l")))
        )
        .drop("_d", "_s", "_l", "_start", "_floor")
    )


# ------------------------------------------------------------- asset valuation


def asset_valuation(prices: DataFrame, limits: DataFrame, splits: Sequence[Split]) -> DataFrame:
    """Opening and closing price of every asset in every split, and whether it is written off.

    An asset without a price on the recommendation date opens at its first
    price if it is not listed yet; otherwise it is written off. On the future
    date it closes at its first price if not listed yet, at its last price if
    delisted, else at nothing.
    """
    days = sorted({d for s in splits for d in (s.rec_date, s.future_date)})
    quotes = (
        prices.where(F.col(TS).isin(days))
        .groupBy(ITEM)
        # at most two dates per split, the dates being the literals above
        .agg(F.map_from_entries(F.collect_set(F.struct(TS, F.abs(F.col(PRICE)).alias("p")))).alias("_q"))
    )
    per_item = limits.join(quotes, ITEM, "left")
    at = per_item.select("*", F.inline(split_array(splits)))
    on_rec, on_future = (F.try_element_at(F.col("_q"), F.col(d)) for d in (REC, FUT))
    opening = F.coalesce(on_rec, F.when(F.col(REC) < F.col("min_date"), F.abs(F.col("price_min_date"))))
    closing = F.coalesce(
        on_future,
        F.when(F.col(FUT) < F.col("min_date"), F.abs(F.col("price_min_date"))).when(
            F.col(FUT) > F.col("max_date"), F.abs(F.col("price_max_date"))
        ),
    )
    return at.select(
        SPLIT, ITEM, opening.alias("open_price"), closing.alias("close_price"), opening.isNull().alias("written_off")
    )


def _writeoff_dates(valuation: DataFrame, splits: Sequence[Split]) -> DataFrame:
    """Per asset, the positions of its write-offs among the splits (at most one entry per split)."""
    order = split_value(splits, range(len(splits)), "int")
    return (
        valuation.where("written_off")
        .groupBy(ITEM)
        .agg(F.sort_array(F.collect_set(order)).alias("writeoffs"))
    )


# --------------------------------------------------------------- split replay


class _Timeline:
    """Elementary date intervals between all recommendation dates and the days after future dates."""

    def __init__(self, splits: Sequence[Split]):
        self.splits = sorted(splits, key=lambda s: s.rec_date)
        self.points = sorted({d for s in splits for d in (s.rec_date, s.future_date + timedelta(days=1))})
        index = {d: i + 1 for i, d in enumerate(self.points)}
        self.start = [index[s.rec_date] for s in self.splits]
        self.stop = [index[s.future_date + timedelta(days=1)] for s in self.splits]

    def interval(self, ts: Column) -> Column:
        return reached(self.points, ts)

    def periods(self) -> Column:
        fields = {SPLIT: [s.split_id for s in self.splits], "_a": self.start, "_b": self.stop}
        return F.arrays_zip(*[constants(v, "int").alias(n) for n, v in fields.items()])

    def starts(self) -> Column:
        return constants(self.start, "int")


def _interval_sums(trades: DataFrame, line: _Timeline, flow: str) -> DataFrame:
    """Summaries per pair and elementary interval, for trades that are dealt by customer."""
    keys = (*_PAIR, "k")
    inside = Window.partitionBy(*keys).orderBy(TS, BLOCK, SEQ).rowsBetween(Window.unboundedPreceding, 0)
    moves = (
        trades.withColumn("k", line.interval(F.col(TS)))
        .where(F.col("k").isNotNull())
        .withColumn("_d", signed_units(F.col(UNITS), F.col(RATING)))
    )
    return moves.withColumn("_s", F.sum("_d").over(inside)).groupBy(*keys).agg(*_sums(flow))


def _stretch_sums(trades: DataFrame, line: _Timeline, flow: str) -> DataFrame:
    """Summaries per pair, elementary interval and stretch of days, by the tree."""
    blocks = _stretched(_blocks(_steps(trades), flow)).withColumn("k", line.interval(F.col(TS)))
    return _composed(blocks, [*_PAIR, "k", "_stretch"], (TS, BLOCK)).where(F.col("k").isNotNull())


def _in_order(sums: DataFrame, *order: str) -> DataFrame:
    """One row per pair: its summaries in order."""
    # a summary without any units adds nothing
    values = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("net", "low", "bought", "sold")]
    rows = F.sort_array(F.collect_list(F.struct(*order, *values)))
    return sums.groupBy(*_PAIR).agg(F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in _SUMMARY])).alias("_rows"))


def _replays(trades: DataFrame, line: _Timeline, writeoffs: DataFrame | None, flow: str) -> DataFrame:
    """One row per (customer, asset): its summaries in order and the starts at which it is written off.

    A pair has a summary per elementary interval, of a very active customer one per 32 days of it, so
    the calendar bounds them. The splits are replayed inside this row, so what a task holds does not
    grow with their number.
    """
    used = dict.fromkeys((*_PAIR, RATING, TS, SEQ, BLOCK, UNITS, flow))
    usual, active = _by_activity(materialize(_with_blocks(trades).select(*used), PACKED))
    pairs = _in_order(_interval_sums(usual, line, flow), "k")
    if active is not None:
        pairs = pairs.unionByName(_in_order(_stretch_sums(active, line, flow), "k", "_stretch"))

    def periods(gone: Column) -> Column:
        """The splits, each with the last write-off before it and whether it is one itself."""
        return F.transform(
            line.periods(),
            lambda p: F.struct(
                p[SPLIT].alias(SPLIT),
                p["_a"].alias("_a"),
                p["_b"].alias("_b"),
                F.coalesce(F.array_max(F.filter(gone, lambda g: g < p["_a"])), F.lit(0)).alias("_since"),
                F.array_contains(gone, p["_a"]).alias("_gone"),
            ),
        )

    never = periods(F.array().cast("array<int>"))
    if writeoffs is None:
        return pairs.withColumn("_periods", never)
    starts = line.starts()
    gone = F.transform("writeoffs", lambda i: F.element_at(starts, i + 1))
    own = materialize(writeoffs.select(ITEM, periods(gone).alias("_periods")))
    return pairs.join(own, ITEM, "left").withColumn("_periods", F.coalesce("_periods", never))


def _one_after_another(rows: Column) -> Column:
    """Consecutive summaries as one: net, lowest running sum, flows, and whether there are any."""
    zero = F.struct(F.lit(False).alias("any"), *[F.lit(0.0).alias(n) for n in ("net", "low", "bought", "sold")])
    return F.aggregate(
        rows,
        zero,
        lambda s, r: F.struct(
            F.lit(True).alias("any"),
            (s["net"] + r["net"]).alias("net"),
            F.least(s["low"], s["net"] + r["low"]).alias("low"),
            (s["bought"] + r["bought"]).alias("bought"),
            (s["sold"] + r["sold"]).alias("sold"),
        ),
    )


def _before(p: Column) -> Column:
    """A pair's trades before a split as one.

    A write-off empties the position: only trades since the last one before the split count.
    """
    return _one_after_another(F.filter("_rows", lambda r: (r["k"] >= p["_since"]) & (r["k"] < p["_a"])))


def holdings_at_splits(
    trades: DataFrame, splits: Sequence[Split], valuation: DataFrame | None = None
) -> DataFrame:
    """Units held at every recommendation date (trades strictly before it).

    With a valuation, write-offs are applied: ``written_off`` marks positions
    that are emptied on that very date.
    """
    line = _Timeline(splits)
    writeoffs = None if valuation is None else _writeoff_dates(valuation, line.splits)
    rows = _replays(trades, line, writeoffs, UNITS)
    first = F.col("_rows")[0]["k"]
    entries = F.transform(
        F.filter("_periods", lambda p: p["_a"] > first),
        lambda p: F.struct(p[SPLIT].alias(SPLIT), _before(p).alias("_sum"), p["_gone"].alias("written_off")),
    )
    at = rows.select(*_PAIR, F.inline(entries)).where("_sum.any")
    return at.select(SPLIT, *_PAIR, _held(F.col("_sum.net"), F.col("_sum.low")).alias("units"), "written_off")


def positions(
    trades: DataFrame, valuation: DataFrame, splits: Sequence[Split], flow_col: str = UNITS
) -> DataFrame:
    """Per split, customer and asset: opening and closing units and value, and the flows between.

    The replay of a period starts from the holdings at its recommendation date, and composes
    with the summary of the period's trades.
    """
    line = _Timeline(splits)
    # a row per split and asset: written, so that its real size decides how the pairs meet it
    valuation = materialize(valuation)
    rows = _replays(trades, line, _writeoff_dates(valuation, line.splits), flow_col)
    first = F.col("_rows")[0]["k"]
    entries = F.transform(
        F.filter("_periods", lambda p: p["_b"] > first),
        lambda p: F.struct(
            p[SPLIT].alias(SPLIT),
            _before(p).alias("_open"),
            _one_after_another(F.filter("_rows", lambda r: (r["k"] >= p["_a"]) & (r["k"] < p["_b"]))).alias("_period"),
        ),
    )
    open_units = _held(F.col("_open.net"), F.col("_open.low"))
    summed = (
        rows.select(*_PAIR, F.inline(entries))
        .where(F.col("_open.any") | F.col("_period.any"))
        .select(SPLIT, *_PAIR, F.col("_open.any").alias("held_before"), open_units.alias("open_units"), "_period")
        .select(
            SPLIT,
            *_PAIR,
            "held_before",
            "open_units",
            F.col("_period.bought").alias("bought"),
            F.col("_period.sold").alias("sold"),
            _held(F.col("open_units") + F.col("_period.net"), F.col("open_units") + F.col("_period.low")).alias(
                "close_units"
            ),
        )
    )
    valued = summed.join(valuation, [SPLIT, ITEM], "left")
    # an asset held but written off leaves the portfolio together with its trades of the period
    gone = F.col("held_before") & F.coalesce(F.col("written_off"), F.lit(True))

    def alive(value: Column) -> Column:
        return F.when(gone, 0.0).otherwise(value)

    return valued.select(
        SPLIT,
        *_PAIR,
        "held_before",
        gone.alias("written_off"),
        alive(F.col("open_units")).alias("open_units"),
        alive(F.col("open_units") * F.coalesce(F.col("open_price"), F.lit(0.0))).alias("open_value"),
        alive(F.col("bought")).alias("bought"),
        alive(F.col("sold")).alias("sold"),
        alive(F.col("close_units")).alias("close_units"),
        alive(F.col("close_units") * F.coalesce(F.col("close_price"), F.lit(0.0))).alias("close_value"),
    )


# ------------------------------------------------------------ customer returns


def _split_days(splits: Sequence[Split]) -> Column:
    return split_value(splits, [float(s.days) for s in splits], "double")


def customer_totals(held: DataFrame, splits: Sequence[Split]) -> DataFrame:
    """Cost, proceeds and returns per split and customer; returns are NULL without a positive cost."""
    totals = held.groupBy(SPLIT, USER).agg(
        F.sum(F.col("open_value") + F.col("bought")).alias("buy_price"),
        F.sum(F.col("close_value") + F.col("sold")).alias("sell_price"),
    )
    days = _split_days(splits)
    gain = F.when(F.col("buy_price") > 0, F.try_divide(F.col("sell_price"), F.col("buy_price")) - 1.0)
    return totals.select(
        SPLIT,
        USER,
        "buy_price",
        "sell_price",
        gain.alias("profitability"),
        over_days(gain, YEAR_DAYS, days).alias("ann_profit"),
        over_days(gain, MONTH_DAYS, days).alias("month_profit"),
    )


def customer_returns(held: DataFrame, splits: Sequence[Split]) -> DataFrame:
    """The totals of customers with a positive cost."""
    return customer_totals(held, splits).where(F.col("buy_price") > 0)


# Names of the summarised returns.
RETURNS = ("profitability", "month_profit", "ann_profit")


def customer_summary(totals: DataFrame, splits: Sequence[Split]) -> DataFrame:
    """Mean, total-portfolio return, quartiles, extremes and profitable share of the returns per split.

    The total-portfolio return covers all customers, also those without a cost.
    """
    long = totals.select(
        SPLIT, F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in RETURNS]))
    ).where(F.col("v").isNotNull())
    moments = long.groupBy(SPLIT, "measure").agg(
        F.avg("v").alias("mean"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.avg(F.when(F.col("v") > 0, 1.0).otherwise(0.0)).alias("perc_profit"),
    )
    overall = totals.groupBy(SPLIT).agg(
        (F.try_divide(F.sum("sell_price"), F.sum("buy_price")) - 1.0).alias("total")
    )
    quartiles = exact_quantiles(long, [SPLIT, "measure"], "v", kind=7, few_groups=True)
    joined = moments.join(quartiles, [SPLIT, "measure"]).join(overall, SPLIT)
    days = _split_days(splits)
    total = (
        F.when(F.col("measure") == "month_profit", over_days(F.col("total"), MONTH_DAYS, days))
        .when(F.col("measure") == "ann_profit", over_days(F.col("total"), YEAR_DAYS, days))
        .otherwise(F.col("total"))
    )
    fields = (
        ("mean", F.col("mean")),
        ("total_prof", total),
        ("q1", F.col("quantiles")[0]),
        ("median", F.col("quantiles")[1]),
        ("q3", F.col("quantiles")[2]),
        ("min", F.col("min")),
        ("max", F.col("max")),
        ("perc_profit", F.col("perc_profit")),
    )
    return joined.groupBy(SPLIT).agg(
        *[F.max(F.when(F.col("measure") == m, value)).alias(f"{m}{name}") for m in RETURNS for name, value in fields]
    )
