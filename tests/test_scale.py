"""One hot key, many splits, many values: results and how the work is spread."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetloom.functions import numbering as NU
from assetloom.functions import quantiles as Q
from assetloom.functions.hashing import PRIME, SPACE, below
from assetloom.operators import graph as G
from assetloom.operators import indicators as D
from assetloom.operators import portfolio as P
from assetloom.operators import recommend as R
from assetloom.operators import sampling as N
from assetloom.operators import splits as S
from assetloom.plans.graph_tables import graph_table
from assetloom.plans.indicator_store import IndicatorStore
from assetloom.session import materialize

DAY = date(2019, 1, 1)
TRADES = "col_user string, col_item string, col_timestamp date, seq long, units double, col_rating double"


def d(n):
    return DAY + timedelta(days=n)


@pytest.fixture
def spread(spark):
    """Shuffles into 16 partitions that are not joined again."""
    names = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def share_of_largest_task(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


# ------------------------------------------------------------------- portfolio


def hot_pair_trades(n=6000):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.9
        user, item = ("u0", "a0") if hot else (f"u{rng.randrange(50)}", f"a{rng.randrange(20)}")
        rows.append((user, item, d(rng.randrange(1500)), i, float(rng.randrange(1, 9)), float(rng.random() < 0.5)))
    return rows


def test_hot_pair_replays_in_many_tasks(spark, spread):
    trades = spark.createDataFrame(hot_pair_trades(), TRADES)
    blocks = materialize(P._stretched(P._blocks(P._steps(trades))))
    pair = blocks.where("col_user = 'u0' and col_item = 'a0'").count() / blocks.count()
    assert pair > 0.6
    # each level before the last one is dealt by (pair, stretch)
    level = P._standing_before(blocks, ["col_user", "col_item", "_stretch"], ("col_timestamp", "seq_block"))
    assert share_of_largest_task(level) < 0.35
    last = P._composed(blocks, ["col_user", "col_item", "_stretch"], ("col_timestamp", "seq_block"))
    per_pair = last.groupBy("col_user", "col_item").count().agg(F.max("count")).first()[0]
    assert per_pair <= 1500 / P.TREE_DAYS + 2


def test_hot_pair_is_right(spark):
    rows = hot_pair_trades(3000)
    trades = spark.createDataFrame(rows, TRADES)
    got = {r["seq"]: r["holdings"] for r in P.holdings_replay(trades).collect()}
    held, want = {}, {}
    for user, item, _, seq, units, rating in sorted(rows, key=lambda r: (r[2], r[3])):
        now = max(0.0, held.get((user, item), 0.0) + (units if rating > 0 else -units))
        held[user, item] = want[seq] = now
    assert got == want
    splits = [S.Split(i, d(200 + 150 * i), d(300 + 150 * i)) for i in range(6)]
    at = {(r["split_id"], r["col_user"], r["col_item"]): r["units"] for r in P.holdings_at_splits(trades, splits).collect()}
    for s in splits:
        level = {}
        for user, item, ts, _, units, rating in sorted(rows, key=lambda r: (r[2], r[3])):
            if ts < s.rec_date:
                level[user, item] = max(0.0, level.get((user, item), 0.0) + (units if rating > 0 else -units))
        assert {k[1:]: v for k, v in at.items() if k[0] == s.split_id} == level


# ---------------------------------------------------------------------- splits


def test_three_thousand_splits(spark):
    rng = random.Random(2)
    rows = [(f"u{rng.randrange(6)}", f"a{rng.randrange(6)}", float(rng.random() < 0.6), d(rng.randrange(3300))) for _ in range(60)]
    trades = spark.createDataFrame(rows, "col_user string, col_item string, col_rating double, col_timestamp date")
    splits = [S.Split(i, d(100 + i), d(100 + i + 20 + i % 7)) for i in range(3000)]
    random.Random(3).shuffle(splits)
    got = {(r["part"], r["split_id"], r["col_user"], r["col_item"], r["col_rating"], r["col_timestamp"])
           for r in S.two_way_split(trades, splits).collect()}
    first, bought, user, item = {}, {}, {}, {}
    for u, a, rating, ts in rows:
        first[u, a] = min(first.get((u, a), ts), ts)
        user[u], item[a] = min(user.get(u, ts), ts), min(item.get(a, ts), ts)
        if rating > 0:
            bought[u, a] = min(bought.get((u, a), ts), ts)
    want = set()
    for s in splits:
        for (u, a), ts in first.items():
            if ts < s.rec_date:
                want.add(("train", s.split_id, u, a, float(bought.get((u, a), date.max) < s.rec_date), ts))
            elif ts <= s.future_date and user[u] < s.rec_date and item[a] < s.rec_date:
                want.add(("test", s.split_id, u, a, float(bought.get((u, a), date.max) <= s.future_date), ts))
    assert got == want
    # rows are repeated for their own splits only, before any filter
    pairs = materialize(S.with_warm_dates(S.pair_history(trades)))
    whole = S.per_split(pairs, splits, after=F.greatest("user_first_ts", "item_first_ts"), until=F.col("first_ts"))
    assert whole.count() <= 3300 * len(first) and S.train_pairs(pairs, splits).count() == sum(r[0] == "train" for r in want)
    plan = S.train_pairs(pairs, splits)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_reached(spark):
    days = [d(3), d(3), d(10), d(4)]
    asked = [d(n) for n in range(14)] + [None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(asked)], "i int, x date").select(
        "i", S.reached(days, F.col("x")).alias("k"), S.reached([], F.col("x")).alias("none")
    )
    for r in got.collect():
        x = asked[r["i"]]
        assert r["k"] == (None if x is None else sum(p <= x for p in days))
        assert r["none"] == (None if x is None else 0)


def test_windows_with_binding_lookback(spark):
    rng = random.Random(4)
    rows = [(f"u{rng.randrange(8)}", f"a{rng.randrange(8)}", 1.0, d(rng.randrange(400))) for _ in range(200)]
    trades = spark.createDataFrame(rows, "col_user string, col_item string, col_rating double, col_timestamp date")
    windows = [S.Window3(i, d(10 * i), d(10 * i + 40), d(10 * i + 70)) for i in range(30)]
    random.Random(1).shuffle(windows)
    got = {(r["part"], r["split_id"], r["col_user"], r["col_item"], r["col_timestamp"])
           for r in S.windowed_split(trades, windows).collect()}
    want = set()
    for w in windows:
        train, test = {}, {}
        for u, a, _, ts in rows:
            side = train if w.start <= ts < w.middle else test if w.middle <= ts <= w.end else None
            if side is not None:
                side[u, a] = min(side.get((u, a), ts), ts)
        users, items = {u for u, _ in train}, {a for _, a in train}
        want |= {("train", w.split_id, u, a, ts) for (u, a), ts in train.items()}
        want |= {("test", w.split_id, u, a, ts) for (u, a), ts in test.items()
                 if u in users and a in items and (u, a) not in train}
    assert got == want


# ------------------------------------------------------------------- quantiles


@pytest.fixture
def narrowings(monkeypatch):
    """Pieces after each round: the most rows of one that is not a single value yet."""
    seen, plain = [], Q._narrowed

    def watched(*args):
        out = plain(*args)
        seen.append(out.where("bottom < top").agg(F.max("inside")).first()[0] or 0)
        return out

    monkeypatch.setattr(Q, "_narrowed", watched)
    return seen


def test_two_million_distinct_values(spark, narrowings):
    n = 2_000_003
    df = spark.range(n).select(F.lit("g").alias("k"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    got = Q.exact_quantiles(df, ["k"], "v", 7, few_groups=True).first()
    assert got["n"] == n and got["quantiles"] == pytest.approx([p * (n - 1) for p in (0.25, 0.5, 0.75)], abs=1e-6)
    assert narrowings and narrowings[-1] <= Q.PIECE and len(narrowings) <= 4


@pytest.mark.parametrize("kind", ["skewed", "two values", "spike", "integers"])
def test_quantiles_of_odd_distributions(spark, narrowings, monkeypatch, kind):
    monkeypatch.setattr(Q, "PIECE", 50)
    rng = np.random.default_rng(7)
    values = {
        "skewed": 10.0 ** rng.uniform(-300, 300, 3000),
        "two values": rng.choice([1.0, 2.0], 3000),
        "spike": np.where(rng.random(3000) < 0.9, 5.0, rng.normal(5, 1e-9, 3000)),
        "integers": rng.integers(0, 40, 3000).astype(float),
    }[kind]
    rows = [("g", float(v)) for v in values] + [("h", float(v)) for v in values[:7]]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["quantiles"] for r in Q.exact_quantiles(df, ["k"], "v", 7).collect()}
    assert got["g"] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])), rel=1e-12)
    assert got["h"] == pytest.approx(list(np.quantile(values[:7], [0.25, 0.5, 0.75])), rel=1e-12)
    assert narrowings[-1] <= 50


# --------------------------------------------------------------------- ranking


def test_a_catalogue_of_a_million_assets(spark, spread):
    n = 1_000_000
    scores = spark.range(n).select(
        F.lit(0).alias("split_id"), F.col("id").alias("col_item"), ((F.col("id") * 7919) % 1000).cast("double").alias("score")
    )
    parts = NU.range_parts(scores, [F.col("split_id"), F.col("score").desc(), F.col("col_item")], "_part")
    assert parts.groupBy("_part").count().agg(F.max("count")).first()[0] < 0.2 * n
    ranked = R.rank_assets(scores)
    assert ranked.agg(F.min("asset_rank"), F.max("asset_rank"), F.countDistinct("asset_rank"), F.min("n_assets")).first()[:] == (1, n, n, n)
    # a thousand assets share a score; the best one is 999, and its assets follow by number
    top = [r["col_item"] for r in ranked.where("asset_rank <= 1000").orderBy("asset_rank").collect()]
    want = [i for i in range(n) if i * 7919 % 1000 == 999]
    assert top == want
    assert share_of_largest_task(ranked) < 0.4


def test_running_sums_over_blocks(spark):
    rng = random.Random(1)
    rows = [(s, r + 1, None if rng.random() < 0.1 else rng.random()) for s in range(3) for r in range(100)]
    df = spark.createDataFrame(rows, "split_id int, asset_rank int, v double")
    amounts = {"total": F.col("v"), "known": F.col("v").isNotNull().cast("long")}
    for block in (7, 1000):
        got = {(r["split_id"], r["asset_rank"]): r for r in NU.running_sums(df, ["split_id"], "asset_rank", amounts, block).collect()}
        for s in range(3):
            total, known = 0.0, 0
            for _, rank, v in rows[100 * s : 100 * s + 100]:
                total, known = total + (v or 0.0), known + (v is not None)
                assert got[s, rank]["total"] == pytest.approx(total) and got[s, rank]["known"] == known


# --------------------------------------------------------------- draws, samples


def test_draws_are_scaled_exactly(spark):
    rng = random.Random(9)
    draws = [0, 1, PRIME - 1, PRIME, SPACE - 1] + [rng.randrange(SPACE) for _ in range(60)]
    limits = [1, 2, 1000, PRIME - 1, PRIME, PRIME + 1, 10**12, 2**61, 2**62 - 1]
    rows = [(x, n) for x in draws for n in limits]
    got = spark.createDataFrame(rows, "x long, n long").select("x", "n", below(F.col("x"), F.col("n")).alias("y"))
    for r in got.collect():
        assert r["y"] == r["x"] * r["n"] // SPACE


def test_smallest_keeps_exactly(spark):
    rows = [(i, (i * 48271 * 7919) % 1000003 * 5) for i in range(5000)] + [(9000 + i, 77) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, draw long")
    for keep in (0, 1, 7, 1234, len(rows)):
        got = {r["id"] for r in NU.smallest(df, "draw", 5 * 1000003, lambda n: F.lit(keep), ["id"]).collect()}
        assert got == {i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))[:keep]}


def test_dropout_reads_written_draws(spark):
    rows = spark.range(3000).select((F.col("id") % 60).alias("user_idx"), F.floor(F.col("id") / 60).alias("item_idx"))
    kept = G.drop_edges(rows, 0.2, 7)
    # the modulus of a draw is in no filter of the result
    assert str(PRIME) not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert kept.count() == 2400


def test_negatives_of_a_heavy_customer(spark, spread):
    rng = random.Random(6)
    n_items = 5000
    heavy = rng.sample(range(n_items), 4900)
    rows = [(0, i, 1.0) for i in heavy] + [(u, rng.randrange(n_items), 1.0) for u in range(1, 40) for _ in range(5)]
    rows += [(50, i, 1.0) for i in range(n_items)]
    edges = spark.createDataFrame(rows, "user_idx long, item_idx long, col_rating double")
    items = spark.range(n_items).withColumnRenamed("id", "item_idx")
    got = N.unseen_items(edges, items, 3, 7).collect()
    seen = {}
    for u, i, _ in rows:
        seen.setdefault(u, set()).add(i)
    per_pair = {}
    for r in got:
        assert r["neg_idx"] not in seen[r["user_idx"]] and 0 <= r["neg_idx"] < n_items
        per_pair.setdefault((r["user_idx"], r["item_idx"]), []).append(r["neg_idx"])
    assert all(len(set(v)) == 3 for v in per_pair.values())
    assert len(per_pair) == sum(len(v) for u, v in seen.items() if u != 50)
    # every unseen asset of the heavy customer is drawn somewhere: positions reach all of them
    drawn = {x for (u, _), v in per_pair.items() if u == 0 for x in v}
    assert drawn == set(range(n_items)) - seen[0]
    pairs = materialize(G.unique_pairs(edges))
    pieces = N._unseen_pieces(pairs, F.lit(n_items).cast("long"))
    assert pieces.groupBy("user_idx").count().agg(F.max("count")).first()[0] <= n_items / N.SEGMENT + 2


def test_a_key_with_almost_all_weight(spark):
    weights = spark.createDataFrame([(i, 1) for i in range(20_000)] + [(77_777, 10**7)], "k long, n long")
    requests = spark.range(200).withColumnRenamed("id", "r")
    line = N._Intervals(weights, "k", "n")
    listed = line.slots.where("_key = 77777").groupBy("_level").count().collect()
    levels = {r["_level"]: r["count"] for r in listed}
    assert levels[0] <= 2 * N.COARSE and levels[1] <= 20_001 / N.COARSE + 1
    total = 20_000 + 10**7
    points = spark.range(0, total, 4999).withColumnRenamed("id", "p")
    placed = line.find(points, "p")
    assert placed.count() == points.count()
    assert placed.where("p < _start or p >= _start + _w").count() == 0
    sample = N.weighted_sample(weights, requests, 20, 3, "k", "r")
    share = sample.where("k = 77777").count() / sample.count()
    assert sample.count() == 4000 and share > 0.99


# ------------------------------------------------------- stored, grown by dates


def test_graph_tables_are_kept_by_content(spark, tmp_path, monkeypatch):
    from assetloom.plans import graph_tables as T

    calls = []
    build = T.BUILDERS["symmetric"]
    monkeypatch.setitem(T.BUILDERS, "symmetric", lambda e, u: calls.append(1) or build(e, u))
    rows = [(0, 0, 1.0), (0, 1, 1.0), (1, 1, 1.0), (2, 0, 1.0), (2, 2, 1.0)]
    schema = "user_idx long, item_idx long, col_rating double"
    users = spark.range(3).withColumnRenamed("id", "user_idx")

    def table(edges=rows, **options):
        df = spark.createDataFrame(edges, schema)
        return sorted(map(tuple, graph_table(df, users, str(tmp_path), "symmetric", **options).collect()))

    first = table()
    assert first == sorted(map(tuple, build(spark.createDataFrame(rows, schema), users).collect())) and len(calls) == 1
    assert table(rows[::-1]) == first and len(calls) == 1
    assert table([*rows, (1, 2, 1.0)]) != first and len(calls) == 2
    assert table([*rows, rows[0]]) != first and len(calls) == 3
    dropped = table(drop_edges=0.4, drop_seed=1)
    assert len(dropped) == 6 and len(calls) == 4
    assert table(drop_edges=0.4, drop_seed=1) == dropped and len(calls) == 4
    table(drop_edges=0.4, drop_seed=2)
    assert len(calls) == 5
    with pytest.raises(ValueError):
        table_of = graph_table(spark.createDataFrame(rows, schema), users, str(tmp_path), "unknown")
        table_of.collect()


def test_appended_indicators_equal_recomputed_ones(spark, tmp_path):
    rng = random.Random(11)
    periods, rows = (21, 63), []
    for item, start, stop in (("a", 0, 260), ("b", 100, 260), ("c", 0, 150), ("e", 200, 260)):
        level = 50.0
        for t in range(start, stop):
            level *= 1 + rng.gauss(0, 0.02)
            if t % 13:
                rows.append((item, d(t), level))
    prices = spark.createDataFrame(rows, "col_item string, col_timestamp date, price double")
    want = {(r["col_item"], r["col_timestamp"]): r for r in D.technical_indicators(prices, periods).collect()}
    store = IndicatorStore(spark, str(tmp_path / "store"), periods)
    with pytest.raises(ValueError):
        store.read()
    added = 0
    for upto in (120, 121, 180, 260):
        added += store.append(prices.where(F.col("col_timestamp") < F.lit(d(upto))))
    assert added == len(rows) and store.append(prices) == 0
    got = {(r["col_item"], r["col_timestamp"]): r for r in store.read().collect()}
    assert got.keys() == want.keys() and len(want) > 200
    assert set(store.read().columns) == set(D.technical_indicators(prices, periods).columns)
    for key, w in want.items():
        for name in w.asDict():
            if name not in ("col_item", "col_timestamp"):
                assert got[key][name] == pytest.approx(w[name], rel=1e-9, abs=1e-9), (key, name)
