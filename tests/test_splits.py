"""Cleaning, split dates, splits and filters on hand fixtures."""

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from assetloom.operators import cleaning as C
from assetloom.operators import filters as FL
from assetloom.operators import splits as S
from assetloom.plans import dataset as DS

DAY = date(2020, 1, 1)


def d(n):
    return DAY + timedelta(days=n)


def quotes(spark, rows):
    return spark.createDataFrame(
        [(i, d(t), float(p), n) for n, (i, t, p) in enumerate(rows)],
        "col_item string, col_timestamp date, price double, seq long",
    )


def ratings(spark, rows):
    return spark.createDataFrame(
        [(u, i, float(r), d(t)) for u, i, r, t in rows],
        "col_user string, col_item string, col_rating double, col_timestamp date",
    )


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_zero_price_assets_and_duplicates(spark):
    q = quotes(spark, [("a", 0, 1), ("a", 0, 2), ("a", 1, 3), ("b", 0, 5), ("b", 1, 0), ("c", 2, 4)])
    assert got(C.clean_prices(q), "col_item", "price") == [("a", 2.0), ("a", 3.0), ("c", 4.0)]


def test_limit_prices(spark):
    row = C.limit_prices(quotes(spark, [("a", 3, 20), ("a", 1, 10), ("a", 2, 99)])).first()
    assert (row["min_date"], row["max_date"], row["price_min_date"], row["price_max_date"], row["roi"]) == (
        d(1),
        d(3),
        10.0,
        20.0,
        1.0,
    )


def grid_reference(days, num_split, num_future):
    steps = num_split + math.ceil(num_future)
    step = len(days) // steps
    points = [days[i * step] for i in range(steps)] + [days[-1]]
    out = []
    for i in range(num_split + 1):
        whole = math.floor(num_future)
        if num_future == whole:
            out.append((i, points[i], points[i + whole]))
        else:
            inside = [x for x in days if points[i + whole] <= x <= points[i + whole + 1]]
            at = max(1, math.floor((num_future - whole) * len(inside)))
            out.append((i, points[i], inside[min(at, len(inside) - 1)]))
    return out


@pytest.mark.parametrize("n,num_split,num_future", [(10, 3, 2), (11, 3, 2), (61, 4, 1), (61, 4, 1.5), (40, 3, 0.5), (3, 4, 2)])
def test_date_grid(spark, n, num_split, num_future):
    days = [d(3 * i) for i in range(n)]
    prices = quotes(spark, [("a", 3 * i, 1) for i in range(n)] + [("b", 0, 1), ("b", 3000, 1)])
    grid = S.date_grid(prices, days[0], days[-1], num_split, num_future)
    want = [S.Split(*row) for row in grid_reference(days, num_split, num_future)]
    assert S.collect_splits(grid) == want


def test_fixed_splits():
    assert S.fixed_splits("2020-01-01, 2020-02-01", "2020-03-01,2020-04-01")[1] == S.Split(
        1, date(2020, 2, 1), date(2020, 4, 1)
    )
    with pytest.raises(ValueError):
        S.fixed_splits("2020-01-01", "2020-03-01,2020-04-01")


SPLIT = [S.Split(0, d(10), d(20))]


def test_two_way_boundaries(spark):
    rows = [
        ("u", "a", 0, 1),  # sold, then bought: positive
        ("u", "a", 1, 2),
        ("u", "b", 0, 3),  # only sold
        ("v", "c", 1, 9),
        ("v", "a", 1, 10),  # on the split date: test
        ("u", "c", 0, 20),  # on the future date: test, sold
        ("u", "c", 1, 21),  # after it: ignored
        ("u", "a", 1, 12),  # pair already in train
        ("w", "a", 1, 12),  # unknown user
        ("u", "z", 1, 12),  # unknown asset
    ]
    out = got(S.two_way_split(ratings(spark, rows), SPLIT), "part", "col_user", "col_item", "col_rating")
    assert out == [
        ("test", "u", "c", 0.0),
        ("test", "v", "a", 1.0),
        ("train", "u", "a", 1.0),
        ("train", "u", "b", 0.0),
        ("train", "v", "c", 1.0),
    ]


def test_bounded_and_unbounded_look_back_agree(spark):
    import random

    rng = random.Random(5)
    rows = [(f"u{rng.randrange(9)}", f"i{rng.randrange(8)}", rng.randrange(2), rng.randrange(60)) for _ in range(300)]
    splits = [S.Split(0, d(10), d(30)), S.Split(1, d(20), d(40)), S.Split(2, d(35), d(59))]
    windows = [S.Window3(s.split_id, d(-5), s.rec_date, s.future_date) for s in splits]
    columns = ("split_id", "part", "col_user", "col_item", "col_rating", "col_timestamp")
    df = ratings(spark, rows)
    assert got(S.windowed_split(df, windows), *columns) == got(S.two_way_split(df, splits), *columns)


def test_chain_split(spark):
    rows = [("u", "a", 0, 1), ("u", "a", 1, 6), ("u", "b", 1, 6), ("u", "b", 1, 12), ("u", "c", 0, 12), ("u", "c", 1, 30)]
    out = got(S.chain_split(ratings(spark, rows), [d(5), d(10), d(20)], ["train", "valid", "test"]), "part", "col_item", "col_rating")
    assert out == [("test", "c", 0.0), ("train", "a", 0.0), ("valid", "b", 1.0)]


def tables(spark, train, test, valid=None):
    def keyed(rows):
        return ratings(spark, rows).withColumn("split_id", F.lit(0))

    prices = quotes(spark, [("a", 10, 1), ("a", 20, 1), ("b", 10, 1), ("c", 20, 1)]).drop("seq")
    return FL.SplitTables(tuple(SPLIT), prices, keyed(train), keyed(test), None if valid is None else keyed(valid))


def test_rating_filter(spark):
    train = [("u", "a", 1, 1)]
    test = [("u", "a", 1, 11), ("u", "b", 1, 11), ("v", "b", 1, 11)]
    _, _, kept = FL.ratings_not_in_train(tables(spark, train, test))
    assert got(kept, "col_user", "col_item") == [("u", "b")]
    # nobody of the earlier set is left: nothing remains; an empty earlier set removes nothing
    _, _, kept = FL.ratings_not_in_train(tables(spark, [("z", "a", 1, 1)], test))
    assert got(kept, "col_user") == []
    _, _, kept = FL.ratings_not_in_train(tables(spark, [], test))
    assert len(got(kept, "col_user")) == 3
    _, valid, kept = FL.ratings_not_in_train(tables(spark, train, test, [("u", "b", 1, 9), ("u", "c", 1, 9)]))
    assert got(valid, "col_item") == [("b",), ("c",)] and got(kept, "col_user") == []


def test_asset_filters_and_composition(spark):
    t = tables(spark, [("u", "a", 1, 1)], [("u", "c", 1, 11), ("u", "b", 1, 11)])
    assert got(FL.assets_with_full_test(t), "col_item") == [("c",)]
    assert got(FL.assets_with_test_price(t), "col_item") == [("a",)]
    out = FL.DataFilter(customers_limit_ratings=True, assets_limit_ratings=True).apply(t)
    assert got(out.test, "col_item") == [("c",)] and got(out.train, "col_item") == []
    assert got(out.split_prices(), "col_item", "col_timestamp") == [("c", d(20))]
    everyone = FL.DataFilter(customers=FL.all_customers).apply(t)
    assert everyone.customers is None and len(got(everyone.test, "col_item")) == 2


def test_split_with_valid(spark):
    rows = [("u", "a", 1, 1), ("v", "b", 1, 2), ("v", "c", 1, 1), ("u", "b", 1, 6), ("v", "a", 1, 7), ("u", "a", 1, 8),
            ("v", "b", 1, 15), ("u", "c", 1, 9), ("v", "c", 0, 16)]
    t = DS.split_dataset_with_valid(ratings(spark, rows), tables(spark, [], []).prices, SPLIT, [d(5)])
    assert got(t.valid, "col_user", "col_item") == [("u", "b"), ("u", "c"), ("v", "a")]
    # v bought b and c before the validation date, so neither is new
    assert got(t.test, "col_user", "col_item") == []


def test_ratings_preparation(spark):
    df = ratings(spark, [("u", "a", 4, 1), ("u", "b", 0, 1), ("v", "b", 2, 1)])
    assert got(C.binarize(df, 1.0), "col_rating") == [(0.0,), (1.0,), (1.0,)]
    train, test = C.normalize_ratings(df, ratings(spark, [("u", "c", 8, 1)]))
    assert got(train, "col_rating") == [(0.0,), (0.5,), (1.0,)] and got(test, "col_rating") == [(2.0,)]
    with pytest.raises(ValueError):
        C.normalize_ratings(df.where("col_rating = 0"))


def test_reindex_is_dense_and_invertible(spark):
    df = ratings(spark, [(f"u{i % 7}", f"i{i % 5}", 1, 1) for i in range(70)])
    (train, test), users, items = C.reindex(df, ratings(spark, [("u1", "i1", 1, 2), ("new", "i1", 1, 2)]))
    assert sorted(r["user_idx"] for r in users.collect()) == list(range(7))
    assert sorted(r["item_idx"] for r in items.collect()) == list(range(5))
    assert train.count() == 70 and test.count() == 1


def test_column_counts(spark):
    out = C.column_counts(ratings(spark, [("u", "a", 1, 1), ("u", "b", 1, 2), (None, "b", 0, 2)]))
    assert got(out, "column", "count", "nunique") == [
        ("col_item", 3, 2),
        ("col_rating", 3, 2),
        ("col_timestamp", 3, 2),
        ("col_user", 2, 1),
    ]


def test_windows_are_answered_inside_pairs(spark):
    """Rows repeated per window are not shuffled."""
    df = ratings(spark, [("u", "a", 1, 1), ("v", "a", 1, 2), ("u", "b", 1, 12)])
    sets = S.windowed_split(df, [S.Window3(0, d(0), d(10), d(20)), S.Window3(1, d(0), d(12), d(20))])
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(split_id" not in plan and "hashpartitioning(col_user" not in plan.split("Generate")[0]
    assert got(sets.where("part = 'test'"), "split_id", "col_user", "col_item") == []
