"""Split dates and temporal train / validation / test sets.

All splits are computed together: ``split_id`` is a column. The splits are a small
table in the order of their recommendation dates, and an index by day tells how many
of them have begun. A row is given to a range of that table, found by looking up
its dates, so it is repeated only for splits it may belong to; nothing depends on the
number of splits but the size of the table itself. Both are constants in the plan, made
from one string each, so a few thousand splits neither slow planning down nor need a join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..names import FUT, ITEM, RATING, REC, SPLIT, TS, USER
from ..session import materialize

@dataclass(frozen=True)
class Split:
    split_id: int
    rec_date: date
    future_date: date

    @property
    def days(self) -> int:
        return (self.future_date - self.rec_date).days


# ---------------------------------------------------------------- split dates


def date_grid(prices: DataFrame, first: date, last: date, num_split: int, num_future: float) -> DataFrame:
    """``num_split + 1`` equally spaced recommendation dates with their future dates.

    The distinct price dates in [first, last] are cut into ``num_split +
    ceil(num_future)`` equal steps; a recommendation date is paired with the
    grid point ``num_future`` steps later. A fractional horizon is placed by
    date position between the two neighbouring points.
    """
    if num_split < 1 or num_future <= 0:
        raise ValueError("num_split and num_future must be positive")
    whole, part = int(math.floor(num_future)), num_future - math.floor(num_future)
    steps = num_split + math.ceil(num_future)

    # at most one row per calendar day of the range
    days = prices.where(F.col(TS).between(F.lit(first), F.lit(last))).select(TS).distinct()
    in_order = Window.partitionBy(F.lit(0)).orderBy(TS)
    ranked = days.select(
        TS,
        (F.row_number().over(in_order) - 1).alias("r"),
        F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("n"),
    ).withColumn("step", F.floor(F.col("n") / steps).cast("int"))
    number = F.try_divide(F.col("r"), F.col("step"))
    on_grid = (
        F.when((F.col("step") == 0) & (F.col("r") == 0), F.sequence(F.lit(0), F.lit(steps - 1)))
        .when((number == F.floor(number)) & (number < steps), F.array(number.cast("int")))
        .otherwise(F.array().cast("array<int>"))
    )
    at_end = F.when(F.col("r") == F.col("n") - 1, F.array(F.lit(steps))).otherwise(F.array().cast("array<int>"))
    points = ranked.select(TS, "r", "n", F.explode(F.concat(on_grid, at_end)).alias("i"))

    by_point = Window.partitionBy(F.lit(0)).orderBy("i")
    if part == 0:
        grid = points.select(F.col("i"), F.col(TS).alias(REC), F.lead(TS, whole).over(by_point).alias(FUT))
    else:
        spans = points.select(
            "i",
            F.col(TS).alias(REC),
            F.lead("r", whole).over(by_point).alias("lo"),
            F.lead("r", whole + 1).over(by_point).alias("hi"),
        )
        offset = F.greatest(F.lit(1), F.floor(F.lit(part) * (F.col("hi") - F.col("lo") + 1)))
        target = spans.where(F.col("hi").isNotNull()).withColumn(
            "r", F.least(F.col("lo") + offset, F.col("hi")).cast("int")
        )
        grid = target.join(ranked.select("r", F.col(TS).alias(FUT)), "r").select("i", REC, FUT)
    return grid.where(F.col("i") <= num_split).select(F.col("i").alias(SPLIT), REC, FUT)


def collect_splits(grid: DataFrame) -> list[Split]:
    """Bring a grid to the driver: one row per split that was asked for."""
    rows = grid.select(SPLIT, REC, FUT).orderBy(SPLIT).collect()
    return [Split(r[SPLIT], r[REC], r[FUT]) for r in rows]


def fixed_splits(rec_dates: str, future_dates: str) -> list[Split]:
    """Splits from two comma-separated date lists."""
    recs = [date.fromisoformat(d.strip()) for d in rec_dates.split(",")]
    futures = [date.fromisoformat(d.strip()) for d in future_dates.split(",")]
    if len(recs) != len(futures):
        raise ValueError("both lists need the same number of dates")
    return [Split(i, r, f) for i, (r, f) in enumerate(zip(recs, futures, strict=True))]


def lookback(split: Split, days: int) -> date:
    return split.rec_date - timedelta(days=days)


def constants(values: Sequence[object], kind: str) -> Column:
    """A constant array, written as one string however long it is."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def split_array(splits: Sequence[Split]) -> Column:
    """The splits as a constant array of (split_id, rec_date, future_date), by recommendation date."""
    if not splits:
        raise ValueError("at least one split is needed")
    ordered = sorted(splits, key=lambda s: s.rec_date)
    fields = {
        SPLIT: constants([s.split_id for s in ordered], "int"),
        REC: constants([s.rec_date for s in ordered], "date"),
        FUT: constants([s.future_date for s in ordered], "date"),
    }
    return F.arrays_zip(*[c.alias(n) for n, c in fields.items()])


def split_value(splits: Sequence[Split], values: Sequence[object], kind: str) -> Column:
    """A constant of a row's split, one per split in the order of ``splits``."""
    return F.try_element_at(
        F.map_from_arrays(constants([s.split_id for s in splits], "int"), constants(values, kind)), F.col(SPLIT)
    )


def reached(days: Sequence[date], value: Column) -> Column:
    """How many of ``days`` are at or before ``value``, looked up by day; NULL for no value."""
    if not days:
        return F.when(value.isNotNull(), F.lit(0))
    points = sorted(days)
    first, counts, at = points[0], [], 0
    for k in range((points[-1] - first).days + 1):
        while at < len(points) and points[at] <= first + timedelta(days=k):
            at += 1
        counts.append(at)
    offset = F.datediff(value, F.lit(first))
    return (
        F.when(offset < 0, F.lit(0))
        .when(offset >= len(counts), F.lit(len(points)))
        .when(offset.isNotNull(), F.get(constants(counts, "int"), offset))
    )


def not_over(splits: Sequence[Split], ts: Column) -> Column:
    """For ``per_split(after=...)``: splits that begin by then have ended before ``ts``."""
    return F.date_sub(ts, max(s.days for s in splits) + 1)


def per_split(
    df: DataFrame,
    splits: Sequence[Split],
    keep: Column | None = None,
    after: Column | None = None,
    until: Column | None = None,
) -> DataFrame:
    """Repeat rows for the splits for which ``keep`` holds; adds split_id, rec_date, future_date.

    ``after`` and ``until`` are dates of the row: only splits with after < rec_date <=
    until are looked at. A NULL date gives no split.
    """
    table = split_array(splits)
    if after is not None or until is not None:
        days = [s.rec_date for s in splits]
        low = F.lit(0) if after is None else reached(days, after)
        high = F.lit(len(splits)) if until is None else reached(days, until)
        table = F.slice(table, low + 1, F.greatest(high - low, F.lit(0)))
    repeated = df.select("*", F.inline(table))
    return repeated if keep is None else repeated.where(keep)


# ------------------------------------------------- pairs, and splits from pairs


def pair_history(interactions: DataFrame) -> DataFrame:
    """When each (user, asset) pair was first seen and first bought.

    With an unbounded look-back this small table decides every split: a pair is
    in train at ``rec`` iff it was seen before ``rec``, a new test pair iff it
    was first seen in the test period. One partial aggregation, no row per
    split and trade.
    """
    return interactions.groupBy(USER, ITEM).agg(
        F.min(TS).alias("first_ts"), F.min(F.when(F.col(RATING) > 0, F.col(TS))).alias("first_buy_ts")
    )


def with_warm_dates(pairs: DataFrame) -> DataFrame:
    """Add when the pair's user and asset were first seen in any pair."""
    users = pairs.groupBy(USER).agg(F.min("first_ts").alias("user_first_ts"))
    items = pairs.groupBy(ITEM).agg(F.min("first_ts").alias("item_first_ts"))
    return pairs.join(users, USER).join(items, ITEM)


def _bought(before: Column) -> Column:
    return F.when(before, 1.0).otherwise(0.0)


def train_pairs(pairs: DataFrame, splits: Sequence[Split]) -> DataFrame:
    seen = per_split(pairs, splits, after=F.col("first_ts"))
    return seen.select(
        SPLIT, USER, ITEM, _bought(F.col("first_buy_ts") < F.col(REC)).alias(RATING), F.col("first_ts").alias(TS)
    )


def novel_test_pairs(warm_pairs: DataFrame, splits: Sequence[Split]) -> DataFrame:
    """New pairs of the test period whose user and asset are both known from train."""
    known = F.greatest("user_first_ts", "item_first_ts")
    new = per_split(warm_pairs, splits, F.col("first_ts") <= F.col(FUT), after=known, until=F.col("first_ts"))
    return new.select(
        SPLIT, USER, ITEM, _bought(F.col("first_buy_ts") <= F.col(FUT)).alias(RATING), F.col("first_ts").alias(TS)
    )


def two_way_split(interactions: DataFrame, splits: Sequence[Split]) -> DataFrame:
    """Train [.., rec) and novel warm test [rec, future] of all splits, one row per pair."""
    pairs = pair_history(interactions)
    train = train_pairs(pairs, splits).withColumn("part", F.lit("train"))
    test = novel_test_pairs(with_warm_dates(pairs), splits).withColumn("part", F.lit("test"))
    return train.unionByName(test)


def chain_split(interactions: DataFrame, bounds: Sequence[date], names: Sequence[str]) -> DataFrame:
    """Consecutive half-open periods, each holding only pairs new since the previous ones.

    ``bounds`` are the exclusive ends of the periods; rows after the last one
    are ignored. Two periods give train/valid, three give train/valid/test.
    """
    if len(bounds) != len(names) or list(bounds) != sorted(bounds):
        raise ValueError("one ascending end date per period")
    pairs = pair_history(interactions.where(F.col(TS) < F.lit(bounds[-1])))
    part, rating = F.lit(None).cast("string"), F.lit(None).cast("double")
    for end, name in reversed(list(zip(bounds, names, strict=True))):
        inside = F.col("first_ts") < F.lit(end)
        part = F.when(inside, F.lit(name)).otherwise(part)
        rating = F.when(inside, _bought(F.col("first_buy_ts") < F.lit(end))).otherwise(rating)
    return pairs.select(USER, ITEM, rating.alias(RATING), F.col("first_ts").alias(TS), part.alias("part"))


# --------------------------------------------- splits with a bounded look-back


@dataclass(frozen=True)
class Window3:
    """Train is [start, middle), test is [middle, end] with the end included."""

    split_id: int
    start: date
    middle: date
    end: date


def windowed_split(interactions: DataFrame, windows: Sequence[Window3], repeated: bool = False) -> DataFrame:
    """Train/test sets of arbitrary windows.

    Trades are folded to one row per pair with an array of its elementary intervals between
    window bounds, at most one entry per interval. Windows are answered inside that row, and
    so are the windows in which the user and the asset are known; what is repeated per
    window is neither shuffled nor sorted.
    """
    if not windows:
        raise ValueError("at least one window is needed")
    points = sorted({d for w in windows for d in (w.start, w.middle, w.end + timedelta(days=1))})
    index = {d: i + 1 for i, d in enumerate(points)}
    # by their ends, so that an interval looks only at the windows that end after it
    ordered = sorted(windows, key=lambda w: w.end)
    bounds = {
        SPLIT: [w.split_id for w in ordered],
        "_from": [index[w.start] for w in ordered],
        "_mid": [index[w.middle] for w in ordered],
        "_to": [index[w.end + timedelta(days=1)] for w in ordered],
    }
    table = F.arrays_zip(*[constants(v, "int").alias(n) for n, v in bounds.items()])
    folded = (
        interactions.where(F.col(TS).between(F.lit(points[0]), F.lit(points[-1])))
        .groupBy(USER, ITEM, reached(points, F.col(TS)).alias("_k"))
        .agg(F.min(TS).alias("_ts"), F.max(F.when(F.col(RATING) > 0, 1.0).otherwise(0.0)).alias("_buy"))
    )
    # read by train, test and both warm checks
    pairs = materialize(
        folded.groupBy(USER, ITEM).agg(F.collect_list(F.struct("_k", "_ts", "_buy")).alias("_rows"))
    )

    def early(w: Column, k: Column) -> Column:
        return (k >= w["_from"]) & (k < w["_mid"])

    def late(w: Column, k: Column) -> Column:
        return (k >= w["_mid"]) & (k < w["_to"])

    def placed(w: Column, side: Callable[[Column, Column], Column]) -> Column:
        mine = F.filter("_rows", lambda r: side(w, r["_k"]))
        return F.struct(
            w[SPLIT].alias(SPLIT),
            F.array_max(F.transform(mine, lambda r: r["_buy"])).alias(RATING),
            F.array_min(F.transform(mine, lambda r: r["_ts"])).alias(TS),
        )

    def known(key: str, out: str) -> DataFrame:
        """Windows in whose train a user or an asset occurs."""
        seen = pairs.select(key, F.explode("_rows._k").alias("_k")).distinct()
        listed = seen.groupBy(key).agg(F.collect_list("_k").alias("_ks"))
        there = F.filter(table, lambda w: F.exists("_ks", lambda k: early(w, k)))
        return materialize(listed.select(key, F.transform(there, lambda w: w[SPLIT]).alias(out)))

    # only windows that end after the pair's first trade
    ended = reached([w.end + timedelta(days=1) for w in ordered], F.array_min(F.col("_rows._ts")))
    rest = F.slice(table, ended + 1, F.greatest(F.lit(len(ordered)) - ended, F.lit(0)))

    def in_train(w: Column) -> Column:
        return F.exists("_rows", lambda r: early(w, r["_k"]))

    def in_test(w: Column) -> Column:
        there = F.exists("_rows", lambda r: late(w, r["_k"]))
        return there if repeated else there & ~in_train(w)

    train = pairs.select(
        USER, ITEM, F.inline(F.transform(F.filter(rest, in_train), lambda w: placed(w, early))), F.lit("train").alias("part")
    )
    asked = pairs.where(F.exists("_rows", lambda r: r["_k"] >= min(index[w.middle] for w in windows)))
    warm = asked.join(known(USER, "_user_in"), USER).join(known(ITEM, "_item_in"), ITEM)

    def fresh(w: Column) -> Column:
        return in_test(w) & F.array_contains("_user_in", w[SPLIT]) & F.array_contains("_item_in", w[SPLIT])

    test = warm.select(
        USER, ITEM, F.inline(F.transform(F.filter(rest, fresh), lambda w: placed(w, late))), F.lit("test").alias("part")
    )
    columns = (SPLIT, USER, ITEM, RATING, TS, "part")
    return train.select(*columns).unionByName(test.select(*columns))
