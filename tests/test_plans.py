"""Sources, sinks, complete runs and the shape of physical plans."""

import random
from datetime import date, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from assetloom.names import ITEM, SPLIT, TS
from assetloom.operators import indicators as D
from assetloom.operators import recommend as R
from assetloom.operators import splits as S
from assetloom.operators.cleaning import clean_prices
from assetloom.plans import dataset as DS
from assetloom.plans import recommendation as RUN
from assetloom.plans.asset_report import write_asset_report
from assetloom.plans.customer_report import write_customer_report
from assetloom.sources import csvfiles, runs, sinks

DAY = date(2019, 1, 1)


def d(n):
    return DAY + timedelta(days=n)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """A small data set in the documented CSV layout."""
    rng = random.Random(8)
    out = tmp_path_factory.mktemp("csv")
    items = [f"A{i}" for i in range(12)]
    with open(out / "close_prices.csv", "w") as f:
        f.write("ISIN,timestamp,closePrice\n")
        for i in items:
            level = rng.uniform(10, 100)
            for t in range(330):
                level *= 1 + rng.gauss(0, 0.02)
                f.write(f"{i},{d(t)},{level:.4f}\n")
        f.write(f"{items[0]},{d(5)},77.5\nBAD,{d(3)},0.0\nBAD,{d(4)},3.0\n")
    with open(out / "transactions.csv", "w") as f:
        f.write("customerID,ISIN,transactionID,transactionType,timestamp,totalValue,units,channel,marketID\n")
        for n in range(900):
            f.write(
                f"C{rng.randrange(40)},{rng.choice(items)},T{n},{rng.choice(['Buy', 'Sell'])},{d(rng.randrange(330))},"
                f"{rng.uniform(10, 999):.2f},{rng.randrange(1, 20)},Branch,XATH\n"
            )
    with open(out / "limit_prices.csv", "w") as f:
        f.write("ISIN,minDate,maxDate,priceMinDate,priceMaxDate,profitability\n")
        for i in items:
            f.write(f"{i},{d(0)},{d(329)},10.0,20.0,1.0\n")
    with open(out / "markets.csv", "w") as f:
        f.write("exchangeID,marketID,name,description,country,tradingDays,tradingHours,marketClass\n")
        f.write('1,XATH,Athens,"Says ""hello"", twice",Greece,"Mon,Tue,Wed",,Main\n')
    return str(out)


def test_csv_sources(spark, folder):
    quotes = csvfiles.read_close_prices(spark, f"{folder}/close_prices.csv")
    prices = clean_prices(quotes)
    assert prices.where("col_item = 'BAD'").count() == 0
    assert prices.where((F.col("col_item") == "A0") & (F.col("col_timestamp") == F.lit(d(5)))).collect()[0]["price"] == 77.5
    trades = csvfiles.read_transactions(spark, f"{folder}/transactions.csv")
    assert dict(trades.dtypes)["col_timestamp"] == "date" and trades.count() == 900
    assert {r[0] for r in trades.select("col_rating").distinct().collect()} == {0.0, 1.0}
    market = csvfiles.read_markets(spark, f"{folder}/markets.csv").first()
    assert market["tradingDays"] == "Mon,Tue,Wed" and market["tradingHours"] is None
    assert market["description"] == 'Says "hello", twice'
    assert csvfiles.read_limit_prices(spark, f"{folder}/limit_prices.csv").first()["roi"] == 1.0


def test_reports_from_csv(spark, folder, tmp_path):
    prices = clean_prices(csvfiles.read_close_prices(spark, f"{folder}/close_prices.csv"))
    trades = csvfiles.read_transactions(spark, f"{folder}/transactions.csv")
    splits = S.collect_splits(S.date_grid(prices, d(60), d(320), 3, 1))
    limits = csvfiles.read_limit_prices(spark, f"{folder}/limit_prices.csv")
    write_asset_report(trades, prices, splits, str(tmp_path))
    write_customer_report(trades, prices, limits, splits, str(tmp_path))
    summary = spark.read.option("header", True).csv(f"{tmp_path}/assets_summary")
    assert summary.count() == 4 and "overall_q1_ROI" in summary.columns and "test_buys" in summary.columns
    stats = spark.read.option("header", True).csv(f"{tmp_path}/customers_stats")
    assert stats.select("rec_date").distinct().count() == 4
    assert spark.read.option("header", True).csv(f"{tmp_path}/customers_summary").count() == 4


def test_recommendation_run(spark, folder, tmp_path):
    prices = clean_prices(csvfiles.read_close_prices(spark, f"{folder}/close_prices.csv"))
    trades = csvfiles.read_transactions(spark, f"{folder}/transactions.csv")
    splits = S.collect_splits(S.date_grid(prices, d(250), d(325), 1, 1))
    args = dict(months=1, trees=3, feature_set="basic_short", kpi_kind="short", cutoffs=(1, 5), max_depth=3)
    out = RUN.run_recommendation(spark, trades, prices, splits, str(tmp_path), **args)
    assert "/rfr_3_basic_short_" in out
    recs = spark.read.parquet(f"{out}/recs")
    assert recs.where("rank = 1").count() == recs.select("split_id", "col_user").distinct().count() > 0
    metrics = spark.read.parquet(f"{out}/metrics")
    assert metrics.count() == 2 * 5 * 2 and metrics.where("metric = 'ndcg' and cutoff = 5").count() == 2
    lines = [r[0] for r in spark.read.text(f"{out}/metrics_text").collect()]
    assert len(lines) == 2 * 5 * 2 and any(line.startswith("ndcg@5\t") for line in lines)
    wide = spark.read.parquet(f"{out}/customer_metrics")
    assert "annualized_prof@1" in wide.columns and wide.count() > 0
    # a finished run is skipped
    assert RUN.run_recommendation(spark, trades, prices, splits, str(tmp_path), **args) is None


def test_runs_resume_by_date_and_differ_by_parameters(spark, folder, tmp_path):
    prices = clean_prices(csvfiles.read_close_prices(spark, f"{folder}/close_prices.csv"))
    trades = csvfiles.read_transactions(spark, f"{folder}/transactions.csv")
    splits = S.collect_splits(S.date_grid(prices, d(250), d(325), 1, 1))
    args = dict(months=1, trees=2, feature_set="basic_short", kpi_kind="short", cutoffs=(1,), max_depth=2)
    first = RUN.run_recommendation(spark, trades, prices, splits[:1], str(tmp_path), **args)
    # the other date is added to the same run, and the first one stays
    assert RUN.run_recommendation(spark, trades, prices, splits, str(tmp_path), **args) == first
    assert spark.read.parquet(f"{first}/metrics").select("split_id").distinct().count() == 2
    assert runs.RunStore(spark, first).commits().count() == 2
    # other parameters or indicators never reuse its results
    other = RUN.run_recommendation(spark, trades, prices, splits[:1], str(tmp_path), **(args | {"seed": 5}))
    kind = RUN.run_recommendation(spark, trades, prices, splits[:1], str(tmp_path), **(args | {"kpi_kind": "long"}))
    assert len({first, other, kind}) == 3


def test_runs_keep_every_horizon_and_every_input(spark, folder, tmp_path):
    prices = clean_prices(csvfiles.read_close_prices(spark, f"{folder}/close_prices.csv"))
    trades = csvfiles.read_transactions(spark, f"{folder}/transactions.csv")
    near, far = [S.Split(0, d(270), d(290))], [S.Split(0, d(270), d(320))]
    args = dict(months=1, trees=2, feature_set="basic_short", kpi_kind="short", cutoffs=(1, 5), max_depth=2)

    def run(which, table=trades):
        return RUN.run_recommendation(spark, table, prices, which, str(tmp_path), **args)

    def rows(out, name, which):
        kept = runs.RunStore(spark, out).read(name, F.col("future_date") == F.lit(which[0].future_date))
        return sorted(map(str, kept.collect()))

    out = run(near)
    before = {n: rows(out, n, near) for n in ("recs", "metrics", "customer_metrics")}
    assert all(before.values())
    # the same date and number with another horizon: added, and nothing of the first is touched
    assert run(far) == out
    assert {n: rows(out, n, near) for n in before} == before
    assert rows(out, "metrics", far) and rows(out, "metrics", far) != before["metrics"]
    assert run(near) is None and run(far) is None
    text = spark.read.csv(f"{out}/metrics_text", sep="\t")
    assert text.select("rec_date", "future_date").distinct().count() == 2 and text.count() == 2 * 5 * 2
    # other trades, even one repeated row, are another run; the first stays
    more = trades.unionByName(trades.limit(1))
    other = run(near, more)
    assert other not in (None, out) and rows(other, "metrics", near)
    assert {n: rows(out, n, near) for n in before} == before
    # rows in another order are the same input
    assert run(near, trades.repartition(7)) is None


def test_a_part_without_commit_is_not_read(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path / "run"))
    assert store.finished() == set()
    one, two = S.Split(0, d(0), d(10)), S.Split(1, d(5), d(15))
    table = spark.createDataFrame([(0, 1.0), (1, 2.0)], "split_id int, value double")
    store.write({"t": table}, [one, two])
    # broken off before its commit
    table.withColumns({"rec_date": F.lit(d(0)), "future_date": F.lit(d(10))}).write.partitionBy(
        "rec_date", "future_date", "split_id"
    ).parquet(f"{store.folder}/t/part=broken")
    assert sorted(r["value"] for r in store.read("t").collect()) == [1.0, 2.0]
    # computed twice at the same time: one of the two counts
    store.write({"t": table.where("split_id = 0")}, [one])
    assert sorted(r["value"] for r in store.read("t").collect()) == [1.0, 2.0]
    assert store.finished() == {(d(0), d(10)), (d(5), d(15))}


def test_evaluation_with_and_without_lists_agrees(spark, folder):
    prices = clean_prices(csvfiles.read_close_prices(spark, f"{folder}/close_prices.csv"))
    trades = csvfiles.read_transactions(spark, f"{folder}/transactions.csv")
    splits = S.collect_splits(S.date_grid(prices, d(60), d(320), 3, 1))
    tables = DS.split_dataset(trades, prices, splits, RUN.priced_at_both_ends())
    scores = R.indicator_scores(D.past_return(prices, [21]), tables.assets, splits, "past_profitability_21d")
    fast = RUN.evaluate_scores(scores, prices, tables, (1, 5, 20))
    recs = R.recommend(scores, fast.eligible, tables.train)
    slow = RUN.evaluate_lists(recs, prices, tables, (1, 5, 20))
    key = ("split_id", "metric", "cutoff", "col_user")

    def rows(e):
        return {tuple(r[k] for k in key): r["value"] for r in e.per_user.collect()}

    a, b = rows(fast), rows(slow)
    assert a.keys() == b.keys() and len(a) > 100
    for k, v in b.items():
        assert a[k] == (None if v is None else pytest.approx(v, abs=1e-12))


def test_scorers(spark):
    rows = [(f"i{i}", float(i % 7), float((i * 3) % 5), float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "col_item string, f1 double, f2 double, target double")
    forest = R.ForestScorer(["f1", "f2"], trees=5, max_depth=4)
    forest.fit(df)
    scored = forest.score(df).join(df, "col_item")
    assert scored.stat.corr("score", "target") > 0.8
    forest.fit(df.where("f1 < 0"))
    random_scores = [r["score"] for r in forest.score(df).collect()]
    assert len(set(random_scores)) == 60 and all(0 < s < 1 for s in random_scores)


def test_registered_forest_does_the_whole_job(spark, monkeypatch):
    """rf_scores hands over the run's own parameters; with them every complete asset gets a score within its targets."""
    from checks import queries as Q

    rng, seen = random.Random(3), {}
    rows = [(f"i{i}", d(t), 50.0 + 10 * i + rng.random()) for i in range(3) for t in range(450)]
    prices_ = spark.createDataFrame(rows, "col_item string, col_timestamp date, price double")

    def record(kpis, assets, splits, months, names, make_scorer, strict=False):
        seen.update(months=months, names=names, make_scorer=make_scorer)
        return kpis

    class Tables:
        splits, split_tables, prices = [], SimpleNamespace(assets=None), prices_

    with monkeypatch.context() as m:
        m.setattr(Q.R, "learn_scores", record)
        kpis = Q.rf_scores(Tables())
    forest = seen["make_scorer"]()
    assert (seen["months"], forest.trees, forest.max_depth) == (6, 20, 12)
    assert seen["names"] == forest.features == D.features("full_short") and len(seen["names"]) == 30

    rec = kpis.agg(F.max(TS)).first()[0]
    splits = [S.Split(0, rec, rec)]
    assets = kpis.select(F.lit(0).alias(SPLIT), ITEM).distinct()
    rows = R.training_set(kpis, assets, splits, seen["months"], seen["names"])
    low, high, n = rows.agg(F.min("target"), F.max("target"), F.count("*")).first()
    assert n > 100
    scored = R.learn_scores(kpis, assets, splits, seen["months"], seen["names"], seen["make_scorer"]).collect()
    want = [r[0] for r in kpis.where(F.col(TS) == F.lit(rec)).select(ITEM).collect()]
    assert sorted(r[ITEM] for r in scored) == sorted(want) and want
    assert all(low - 1e-9 <= r["score"] <= high + 1e-9 for r in scored)


def test_sinks(spark, tmp_path):
    kpis = spark.createDataFrame([("a", d(0), 1.0), ("b", d(1), 2.0)], "col_item string, col_timestamp date, price double")
    sinks.write_kpis(kpis, str(tmp_path / "k"), 4)
    assert sorted(map(tuple, sinks.read_kpis(spark, str(tmp_path / "k")).select(*kpis.columns).collect())) == sorted(map(tuple, kpis.collect()))
    calls = []

    def build():
        calls.append(1)
        return kpis

    for _ in range(2):
        sinks.compute_if_absent(spark, str(tmp_path / "c"), build)
    assert len(calls) == 1
    for _ in range(2):
        sinks.append_results(kpis, str(tmp_path / "a"))
    assert spark.read.option("header", True).csv(str(tmp_path / "a")).count() == 4


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def price_table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("prices") / "p")
    rows = [(f"i{i}", d(t), 1.0 + i + t) for i in range(4) for t in range(250)]
    spark.createDataFrame(rows, "col_item string, col_timestamp date, price double").write.parquet(path)
    return spark.read.parquet(path)


def test_indicators_shuffle_once(price_table):
    plan = plan_of(D.technical_indicators(price_table))
    assert plan.count("Exchange") == 1 and "hashpartitioning(col_item" in plan
    assert "Python" not in plan


def test_split_dates_reach_the_scan(price_table):
    from assetloom.operators.assets import asset_returns

    plan = plan_of(asset_returns(price_table, [S.Split(0, d(10), d(40))]))
    assert "PushedFilters: [In(col_timestamp" in plan and plan.count("Exchange") == 1


def test_train_pairs_do_not_shuffle_per_split(spark):
    pairs = spark.createDataFrame([("u", "a", d(1), d(2))], "col_user string, col_item string, first_ts date, first_buy_ts date")
    plan = plan_of(S.train_pairs(pairs, [S.Split(i, d(5 + i), d(9 + i)) for i in range(50)]))
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("partitions", [1, 7])
def test_results_do_not_depend_on_partitions(spark, folder, partitions):
    trades = csvfiles.read_transactions(spark, f"{folder}/transactions.csv")
    splits = [S.Split(0, d(100), d(200)), S.Split(1, d(150), d(250))]

    def rows():
        return sorted(map(tuple, S.two_way_split(trades, splits).collect()))

    want, before = rows(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        assert rows() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
