"""Technical indicators per asset: tables of (col_item, col_timestamp, price, indicators)."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.exprs import growth
from ..functions.series import Ewm, Rolling, ewm, rolling
from ..names import ITEM, PRICE, TRADING_DAYS, TS

# Periods, indicator names and feature sets.
LONG = (21, 63, 126, 189)
SHORT = (21, 63, 126)
RSI_SPAN = 14
DCO_ROWS = 22
MACD_SPANS = (12, 26)
SMOOTHING = 5

FEATURE_SETS = {
    "basic": [f"{kind}_{t}d" for kind in ("past_profitability", "volatility", "avg_price") for t in (63, 126, 189)],
    "basic_short": [f"{kind}_{t}d" for kind in ("past_profitability", "volatility", "avg_price") for t in SHORT],
}


def _full(periods: Sequence[int]) -> list[str]:
    def each(*kinds: str) -> list[str]:
        return [f"{kind}_{t}d" for kind in kinds for t in periods]

    return [
        *each("past_profitability", "volatility", "avg_price", "sharpe", "m", "roc"),
        "MACD",
        f"rsi_{RSI_SPAN}",
        f"dco_{DCO_ROWS}",
        *each("min", "max", "exp_mean"),
    ]


FEATURE_SETS["full"] = _full((63, 126, 189))
FEATURE_SETS["full_short"] = _full(SHORT)


def features(name: str) -> list[str]:
    """A named feature set; unknown names mean ``full_short``."""
    return list(FEATURE_SETS.get(name, FEATURE_SETS["full_short"]))


def _series() -> WindowSpec:
    return Window.partitionBy(ITEM).orderBy(TS)


_DAILY = "past_profitability_1d"
_ANNUAL = math.sqrt(TRADING_DAYS)


def _back(rows: int) -> Column:
    return F.lag(PRICE, rows).over(_series())


def average_price(prices: DataFrame, periods: Iterable[int] = LONG) -> DataFrame:
    return rolling(prices, [Rolling("mean", PRICE, t, f"avg_price_{t}d") for t in periods])


def past_return(prices: DataFrame, periods: Iterable[int] = (1, *LONG)) -> DataFrame:
    return prices.select("*", *[growth(F.col(PRICE), _back(t)).alias(f"past_profitability_{t}d") for t in periods])


def _with_daily(prices: DataFrame) -> DataFrame:
    return prices if _DAILY in prices.columns else past_return(prices, [1])


def _annualized(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.withColumns({n: F.col(n) * _ANNUAL for n in names})


def volatility(prices: DataFrame, periods: Iterable[int] = LONG) -> DataFrame:
    """Annualized sample deviation of daily returns; period 0 means all rows so far."""
    periods = list(periods)
    sliding = [t for t in periods if t]
    had_daily = _DAILY in prices.columns
    out = _with_daily(prices)
    if 0 in periods:
        sofar = _series().rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(
            "volatility",
            F.when(F.count(_DAILY).over(sofar) >= 2, F.stddev_samp(_DAILY).over(sofar)) * _ANNUAL,
        )
    if sliding:
        names = [f"volatility_{t}d" for t in sliding]
        out = _annualized(
            rolling(out, [Rolling("std", _DAILY, t, n) for t, n in zip(sliding, names, strict=True)]), names
        )
    return out if had_daily else out.drop(_DAILY)


def _sharpe(t: int) -> Column:
    ratio = F.try_divide(F.col(f"past_profitability_{t}d"), F.col(f"volatility_{t}d"))
    return F.coalesce(ratio, F.lit(0.0)).alias(f"sharpe_{t}d")


def sharpe(prices: DataFrame, periods: Iterable[int] = LONG) -> DataFrame:
    """Return per unit of volatility; 0 where either is missing or volatility is 0."""
    periods = list(periods)
    kept = prices.columns
    out = prices
    missing = [t for t in periods if f"past_profitability_{t}d" not in kept]
    if missing:
        out = past_return(out, missing)
    missing = [t for t in periods if f"volatility_{t}d" not in kept]
    if missing:
        out = volatility(out, missing)
    return out.select(*kept, *[_sharpe(t) for t in periods])


def exponential_mean(prices: DataFrame, spans: Iterable[int], adjust: bool, name: str) -> DataFrame:
    return ewm(prices, [Ewm(PRICE, s, adjust, name.format(s)) for s in spans])


def macd(prices: DataFrame) -> DataFrame:
    kept = prices.columns
    fast, slow = MACD_SPANS
    out = ewm(prices, [Ewm(PRICE, fast, False, "_fast"), Ewm(PRICE, slow, False, "_slow")])
    return out.select(*kept, (F.col("_fast") - F.col("_slow")).alias("MACD"))


def momentum(prices: DataFrame, periods: Iterable[int] = LONG) -> DataFrame:
    return prices.select("*", *[(F.col(PRICE) - _back(t)).alias(f"m_{t}d") for t in periods])


def rate_of_change(prices: DataFrame, periods: Iterable[int] = LONG) -> DataFrame:
    return prices.select("*", *[growth(F.col(PRICE), _back(t)).alias(f"roc_{t}d") for t in periods])


def _gains_and_losses(prices: DataFrame) -> DataFrame:
    change = F.coalesce(F.col(PRICE) - _back(1), F.lit(0.0))
    return prices.select(
        "*", F.greatest(change, F.lit(0.0)).alias("_gain"), F.greatest(-change, F.lit(0.0)).alias("_loss")
    )


def _rsi(up: Column, down: Column) -> Column:
    only_gains = F.when(up > 0, 100.0).otherwise(0.0)
    return F.when(down == 0, only_gains).otherwise(100.0 - F.try_divide(F.lit(100.0), 1.0 + F.try_divide(up, down)))


def relative_strength(prices: DataFrame, span: int = RSI_SPAN) -> DataFrame:
    kept = prices.columns
    out = ewm(_gains_and_losses(prices), [Ewm("_gain", span, False, "_up"), Ewm("_loss", span, False, "_down")])
    return out.select(*kept, _rsi(F.col("_up"), F.col("_down")).alias(f"rsi_{span}"))


def _dco(mean: Column, rows: int) -> Column:
    return _back(int(rows / 2 + 1)) - mean


def detrended_oscillator(prices: DataFrame, rows: int = DCO_ROWS) -> DataFrame:
    kept = prices.columns
    out = rolling(prices, [Rolling("mean", PRICE, rows, "_mean")])
    return out.select(*kept, _dco(F.col("_mean"), rows).alias(f"dco_{rows}"))


def rolling_extremes(prices: DataFrame, periods: Iterable[int] = LONG) -> DataFrame:
    return rolling(prices, [Rolling(kind, PRICE, t, f"{kind}_{t}d") for t in periods for kind in ("min", "max")])


def smooth(table: DataFrame, rows: int = SMOOTHING, smooth_price: bool = True) -> DataFrame:
    """Replace every value column by its mean over the last ``rows`` rows."""
    still = {ITEM, TS} | (set() if smooth_price else {PRICE})
    frame = _series().rowsBetween(1 - rows, 0)
    return table.select(
        *[
            F.col(c)
            if c in still
            else F.when(F.count(c).over(frame) == rows, F.avg(c).over(frame)).alias(c)
            for c in table.columns
        ]
    )


def smooth_complete(table: DataFrame, rows: int = SMOOTHING, smooth_price: bool = True) -> DataFrame:
    """``smooth`` without its incomplete rows.

    A smoothed row is complete iff the last ``rows`` rows all were, so one
    counter guards every column.
    """
    still = {ITEM, TS} | (set() if smooth_price else {PRICE})
    frame = _series().rowsBetween(1 - rows, 0)
    complete = reduce(Column.__and__, [F.col(c).isNotNull() for c in table.columns])
    flagged = table.withColumn("_complete", F.when(complete, 1))
    averaged = flagged.select(
        *[F.col(c) if c in still else F.avg(c).over(frame).alias(c) for c in table.columns],
        F.count("_complete").over(frame).alias("_rows"),
    )
    return averaged.where(F.col("_rows") == rows).drop("_rows")


def framed_indicators(base: DataFrame, periods: Sequence[int]) -> DataFrame:
    """Lags and rolling frames of (asset, date, price), and gains and losses, before exponential means."""
    lags = base.select(
        "*",
        *[growth(F.col(PRICE), _back(t)).alias(f"past_profitability_{t}d") for t in (1, *periods)],
        *[(F.col(PRICE) - _back(t)).alias(f"m_{t}d") for t in periods],
        *[growth(F.col(PRICE), _back(t)).alias(f"roc_{t}d") for t in periods],
        _back(int(DCO_ROWS / 2 + 1)).alias("_mid"),
        F.when(
            F.count(PRICE).over(_series().rowsBetween(1 - DCO_ROWS, 0)) == DCO_ROWS,
            F.avg(PRICE).over(_series().rowsBetween(1 - DCO_ROWS, 0)),
        ).alias("_sma"),
        F.greatest(F.coalesce(F.col(PRICE) - _back(1), F.lit(0.0)), F.lit(0.0)).alias("_gain"),
        F.greatest(F.coalesce(_back(1) - F.col(PRICE), F.lit(0.0)), F.lit(0.0)).alias("_loss"),
    )
    rolled = rolling(
        lags,
        [
            *[Rolling("mean", PRICE, t, f"avg_price_{t}d") for t in periods],
            *[Rolling("std", _DAILY, t, f"volatility_{t}d") for t in periods],
            *[Rolling(kind, PRICE, t, f"{kind}_{t}d") for t in periods for kind in ("min", "max")],
        ],
    )
    return _annualized(rolled, [f"volatility_{t}d" for t in periods])


def exponential_specs(periods: Sequence[int]) -> list[Ewm]:
    """The exponential means that all indicators together need."""
    fast, slow = MACD_SPANS
    return [
        Ewm(PRICE, fast, False, "_fast"),
        Ewm(PRICE, slow, False, "_slow"),
        Ewm("_gain", RSI_SPAN, False, "_up"),
        Ewm("_loss", RSI_SPAN, False, "_down"),
        *[Ewm(PRICE, t, True, f"exp_mean_{t}d") for t in periods],
    ]


def assembled_indicators(weighted: DataFrame, periods: Sequence[int], *more: str) -> DataFrame:
    """All indicators from frames and exponential means; columns in ``more`` come along."""
    return weighted.select(
        ITEM,
        TS,
        PRICE,
        *[f"avg_price_{t}d" for t in periods],
        *[f"past_profitability_{t}d" for t in (1, *periods)],
        *[f"volatility_{t}d" for t in periods],
        (F.col("_fast") - F.col("_slow")).alias("MACD"),
        *[f"m_{t}d" for t in periods],
        *[f"roc_{t}d" for t in periods],
        _rsi(F.col("_up"), F.col("_down")).alias(f"rsi_{RSI_SPAN}"),
        (F.col("_mid") - F.col("_sma")).alias(f"dco_{DCO_ROWS}"),
        *[_sharpe(t) for t in periods],
        *[f"{kind}_{t}d" for t in periods for kind in ("min", "max", "exp_mean")],
        *more,
    )


def technical_indicators(
    prices: DataFrame, periods: Sequence[int] = LONG, smoothing: int = SMOOTHING, smooth_price: bool = True
) -> DataFrame:
    """All indicators, smoothed, complete rows only.

    Same-shaped work is done together: one pass of lags, one of short frames,
    one of exponential sums. The plan has a single shuffle, by asset.
    """
    framed = framed_indicators(prices.select(ITEM, TS, PRICE), periods)
    everything = assembled_indicators(ewm(framed, exponential_specs(periods)), periods)
    return smooth_complete(everything, smoothing, smooth_price)


def indicator_periods(kind: str) -> Sequence[int]:
    return SHORT if kind == "short" else LONG


def return_and_volatility(
    prices: DataFrame, periods: Sequence[int] = LONG, smoothing: int = SMOOTHING
) -> DataFrame:
    """Past returns and volatilities, smoothed; incomplete rows stay."""
    base = prices.select(ITEM, TS, PRICE)
    return smooth(volatility(past_return(base, (1, *periods)), periods), smoothing)
