"""Rolling, exponential and quantile helpers against pandas, numpy and statistics."""

import random
import statistics
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assetloom.functions.quantiles import exact_quantiles
from assetloom.functions.series import Ewm, Rolling, ewm, rolling
from assetloom.operators import indicators as D

DAY = date(2000, 1, 1)


def series(spark, **values):
    rows = [(k, DAY + timedelta(days=i), float(v)) for k, vs in values.items() for i, v in enumerate(vs)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "col_item string, col_timestamp date, price double")


def by_item(df, item):
    return df.where(F.col("col_item") == item).orderBy("col_timestamp").toPandas()


def walk(n, seed):
    rng = np.random.default_rng(seed)
    return np.exp(np.cumsum(rng.normal(0, 0.02, n))) * 50


@pytest.mark.parametrize("periods", [(21, 63, 126, 189), (5, 7), (6, 4), (10,)])
def test_rolling_matches_pandas(spark, periods):
    x = walk(260, 1)
    specs = [Rolling(k, "price", t, f"{k}_{t}") for t in periods for k in ("mean", "std", "min", "max")]
    out = by_item(rolling(series(spark, a=x, b=walk(30, 2)), specs), "a")
    exact = {"mean": np.mean, "std": lambda w, axis: np.std(w, axis=axis, ddof=1), "min": np.min, "max": np.max}
    for t in periods:
        # every window on its own: the running update of pandas is off by 1e-10 for deviations
        windows = np.lib.stride_tricks.sliding_window_view(x, t)
        for k, fn in exact.items():
            got = out[f"{k}_{t}"]
            assert (got.isna() == pd.Series(x).rolling(t).mean().isna()).all()
            np.testing.assert_allclose(got.dropna(), fn(windows, axis=1), rtol=1e-11)


def test_rolling_std_of_a_flat_series_is_zero(spark):
    out = by_item(rolling(series(spark, a=[7.1] * 80), [Rolling("std", "price", t, f"s{t}") for t in (21, 63)]), "a")
    assert (out["s21"].dropna() == 0).all() and (out["s63"].dropna() == 0).all()


@pytest.mark.parametrize("adjust", [True, False])
def test_ewm_matches_pandas_over_many_blocks(spark, adjust):
    # 9000 rows are three blocks of the shortest span, with a long stretch of zeros in between
    x = np.concatenate([walk(1500, 4), np.zeros(3000), walk(4500, 5)])
    specs = [Ewm("price", s, adjust, f"e{s}") for s in (12, 26, 189)]
    out = by_item(ewm(series(spark, a=x, b=[1.0, 2.0]), specs), "a")
    for s in (12, 26, 189):
        want = pd.Series(x).ewm(span=s, adjust=adjust).mean()
        np.testing.assert_allclose(out[f"e{s}"], want, rtol=1e-9, atol=1e-200)


@pytest.mark.parametrize("adjust", [True, False])
def test_ewm_does_not_depend_on_other_spans(spark, adjust):
    x = walk(10_000, 8)
    spans = (2, 12, 189, 500, 3000)
    together = by_item(ewm(series(spark, a=x), [Ewm("price", s, adjust, f"e{s}") for s in spans]), "a")
    for s in spans:
        alone = by_item(ewm(series(spark, a=x), [Ewm("price", s, adjust, f"e{s}")]), "a")
        np.testing.assert_array_equal(together[f"e{s}"], alone[f"e{s}"])
        np.testing.assert_allclose(alone[f"e{s}"], pd.Series(x).ewm(span=s, adjust=adjust).mean(), rtol=1e-9)


def test_rsi_edges(spark):
    rising = D.relative_strength(series(spark, up=range(1, 31), flat=[3] * 30, down=range(60, 30, -1)))
    assert by_item(rising, "up")["rsi_14"].iloc[1:].eq(100.0).all()
    assert by_item(rising, "flat")["rsi_14"].eq(0.0).all()
    assert by_item(rising, "down")["rsi_14"].iloc[1:].eq(0.0).all()


def test_rsi_keeps_its_level_while_trading_is_suspended(spark):
    x = np.concatenate([walk(100, 6), np.full(900, 42.0)])
    out = by_item(D.relative_strength(series(spark, a=x)), "a")["rsi_14"]
    assert out.iloc[-1] == pytest.approx(out.iloc[101], rel=1e-9)


def test_sharpe_of_a_flat_series_is_zero(spark):
    out = by_item(D.sharpe(series(spark, a=[5.0] * 70), [21]), "a")
    assert out["sharpe_21d"].eq(0.0).all()


def test_pipeline_needs_194_rows(spark):
    kpis = D.technical_indicators(series(spark, a=walk(194, 7), b=walk(193, 8)))
    assert [r["col_item"] for r in kpis.collect()] == ["a"]
    short = D.technical_indicators(series(spark, a=walk(131, 7), b=walk(130, 8)), D.SHORT)
    assert [r["col_item"] for r in short.collect()] == ["a"]
    assert set(D.features("full")) <= set(kpis.columns)
    assert set(D.features("anything else")) <= set(short.columns)
    assert [len(D.features(n)) for n in ("basic", "full", "basic_short", "full_short")] == [9, 30, 9, 30]


def test_smoothing_can_leave_the_price(spark):
    x = walk(30, 9)
    out = by_item(D.smooth(D.average_price(series(spark, a=x), [5]), 5, smooth_price=False), "a")
    np.testing.assert_allclose(out["price"], x)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 999, 1000, 5003])
def test_exact_quantiles(spark, n):
    rng = random.Random(n)
    # heavy ties: a third of the values are the same
    values = [0.5 if rng.random() < 0.34 else rng.gauss(0, 1) for _ in range(n)]
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None), ("h", 1.0)], "k string, v double")
    six = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", 6).collect()}
    seven = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", 7).collect()}
    assert six["g"]["n"] == n and six["h"]["quantiles"] is None and seven["h"]["quantiles"] == [1.0] * 3
    if n > 1:
        assert six["g"]["quantiles"] == pytest.approx(statistics.quantiles(values), abs=1e-12)
    assert seven["g"]["quantiles"] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])), abs=1e-12)
