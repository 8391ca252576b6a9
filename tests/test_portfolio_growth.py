"""What the portfolio replay moves and leaves on disk, and that its two ways agree."""

import random
import re
import time
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assetloom.operators import portfolio as P
from assetloom.operators.cleaning import limit_prices
from assetloom.operators.splits import Split
from assetloom.session import materialize
from assetloom.sources import retail

TRADES = "col_user string, col_item string, col_rating double, col_timestamp date, seq long, seq_block long, units double, value double"
SPLITS = [Split(0, date(2020, 1, 21), date(2020, 2, 15)), Split(1, date(2020, 2, 5), date(2020, 3, 1)), Split(2, date(2020, 3, 1), date(2020, 4, 5))]


def d(n):
    return date(2020, 1, 1) + timedelta(days=n)


def odd_trades(spark, n=900):
    """Trades with missing keys, dates, ratings and units, and sales of more than is held."""
    rng = random.Random(8)

    def maybe(value):
        return None if rng.random() < 0.06 else value

    rows = [
        (
            maybe(f"u{rng.randrange(7)}"),
            maybe(f"i{rng.randrange(4)}"),
            maybe(float(rng.random() < 0.5)),
            maybe(d(rng.randrange(100))),
            seq,
            maybe(seq // 150),
            maybe(float(rng.randrange(1, 9))),
            maybe(rng.randrange(1, 400) / 4),
        )
        for seq in range(n)
    ]
    return spark.createDataFrame(rows, TRADES)


def prices(spark):
    rows = [(f"i{i}", d(t), 1.0 + (7 * i + t) % 5) for i in range(4) for t in range(0, 60 + 15 * i, 3)]
    return spark.createDataFrame(rows, "col_item string, col_timestamp date, price double")


def replayed(trades, pdf):
    valuation = P.asset_valuation(pdf, limit_prices(pdf), SPLITS)
    frames = (
        P.holdings_replay(trades),
        P.holdings_at_splits(trades, SPLITS),
        P.holdings_at_splits(trades, SPLITS, valuation),
        P.positions(trades, valuation, SPLITS, "value"),
    )
    return [sorted((tuple(r) for r in f.select(*sorted(f.columns)).collect()), key=repr) for f in frames]


def test_replay_in_place_agrees_with_the_tree(spark, monkeypatch):
    trades, pdf = materialize(odd_trades(spark)), prices(spark)
    assert P._by_activity(trades)[1] is None
    in_place = replayed(trades, pdf)
    monkeypatch.setattr(P, "ACTIVE_ROWS", 0)
    monkeypatch.setattr(P, "ACTIVE_TIMES", 0)
    assert P._by_activity(trades)[1].count() == 900
    by_tree = replayed(trades, pdf)
    assert [len(x) for x in in_place] == [len(x) for x in by_tree]
    assert in_place == by_tree
    # some customers each way
    monkeypatch.setattr(P, "ACTIVE_ROWS", 120)
    monkeypatch.setattr(P, "CUSTOMER_BUCKETS", 64)
    usual, active = P._by_activity(trades)
    assert usual.count() and active.count() and usual.count() + active.count() == 900
    assert replayed(trades, pdf) == in_place


def test_a_very_active_customer_goes_by_the_tree(spark, monkeypatch):
    monkeypatch.setattr(P, "ACTIVE_ROWS", 400)
    rows = [("u0" if i % 2 else f"u{i % 90}", "i0", 1.0, d(i % 100), i, 0, 1.0, 1.0) for i in range(1000)]
    usual, active = P._by_activity(materialize(spark.createDataFrame(rows, TRADES)))
    assert {r[0] for r in active.select("col_user").distinct().collect()} == {"u0"}
    assert usual.where("col_user = 'u0'").count() == 0


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^\]]*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_trades_are_dealt_once(spark):
    trades, pdf = materialize(odd_trades(spark)), prices(spark)
    held = P.positions(trades, P.asset_valuation(pdf, limit_prices(pdf), SPLITS), SPLITS)
    for df in (P.customer_totals(held, SPLITS), P.holdings_replay(trades)):
        assert [re.sub(r"#\d+", "", x) for x in exchanges(df)] == ["col_user"]


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(name, None), shuffle_files(spark)
    df = spark.range(20_000).repartition(F.col("id") % 7).groupBy((F.col("id") % 11).alias("k")).agg(F.sum("id").alias("s"))
    written = materialize(df)
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(name, None) == setting
    assert written.agg(F.sum("s")).first()[0] == 20_000 * 19_999 // 2


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Orders and lines whose keys repeat or are missing."""
    folder, rng = str(tmp_path_factory.mktemp("odd")), random.Random(4)

    def maybe(value):
        return None if rng.random() < 0.05 else value

    parts = [(maybe(i), f"Brand#{i % 3}", maybe(f"TYPE {i % 2}")) for i in range(12)] + [(3, "Brand#9", "TYPE 9")]
    orders = [(maybe(40_000 * (i % 50)), maybe(i % 9)) for i in range(60)]
    lines = [
        (
            maybe(40_000 * rng.randrange(50)), maybe(rng.randrange(12)), maybe(rng.randrange(3)), maybe(rng.randrange(2)),
            maybe(float(rng.randrange(1, 5))), maybe(rng.randrange(100, 130) / 4), maybe(rng.randrange(3) / 100),
            maybe(rng.randrange(3) / 100), maybe(rng.choice("ARN")), maybe(datetime(1998, 3, 1 + rng.randrange(9))),
        )
        for _ in range(1500)
    ]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(
        lines + lines[:40],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp",
    ).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_the_short_order_key_orders_the_same_rows_alike(spark, odd_tables):
    def in_order(df):
        columns = ("units", "value", "col_rating", F.col("seq.l_orderkey").alias("k"))
        rows = df.select("col_user", "col_item", "col_timestamp", "seq_block", "seq", *columns)
        listed = rows.groupBy("col_user", "col_item", "col_timestamp", "seq_block").agg(
            F.sort_array(F.collect_list(F.struct("seq", "units", "value", "k"))).alias("l"), F.sum("col_rating").alias("r")
        )
        kept = listed.select(
            "col_user", "col_item", "col_timestamp", "seq_block", "r", F.transform("l", lambda x: F.struct(x["k"], x["units"], x["value"]))
        )
        return sorted((tuple(r) for r in kept.collect()), key=repr)

    want = in_order(retail.trades(spark, odd_tables, "brandtype_weekly"))
    got = in_order(retail.ordered_trades(spark, odd_tables, "brandtype_weekly", "units", "value"))
    assert max(len(r[-1]) for r in want) > 3
    assert got == want
