"""Lists, metrics, sampling and graphs against brute force."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from assetloom.operators import graph as G
from assetloom.operators import ranking_metrics as M
from assetloom.operators import recommend as R
from assetloom.operators import sampling as N

USERS, ITEMS = 12, 30


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(11)
    scores = {(s, f"i{i:02d}"): rng.random() for s in (0, 1) for i in range(ITEMS) if rng.random() < 0.8}
    seen = {(s, f"u{u}", f"i{rng.randrange(ITEMS):02d}") for s in (0, 1) for u in range(USERS) for _ in range(u)}
    # u11 has seen everything, u0 nothing
    seen |= {(0, "u11", f"i{i:02d}") for i in range(ITEMS)}
    values = {k: (None if rng.random() < 0.1 else rng.uniform(-1, 1)) for k in scores if rng.random() < 0.8}
    wanted = {(s, f"u{u}", f"i{rng.randrange(ITEMS):02d}") for s in (0, 1) for u in range(1, USERS) for _ in range(4)} - seen
    frame = spark.createDataFrame
    return {
        "scores": scores,
        "seen": seen,
        "values": values,
        "wanted": wanted,
        "scores_df": frame([(*k, v) for k, v in scores.items()], "split_id int, col_item string, score double"),
        "seen_df": frame(sorted(seen), "split_id int, col_user string, col_item string"),
        "values_df": frame([(*k, v) for k, v in values.items()], "split_id int, col_item string, value double"),
        "wanted_df": frame(sorted(wanted), "split_id int, col_user string, col_item string"),
        "users_df": frame([(s, f"u{u}") for s in (0, 1) for u in range(USERS)], "split_id int, col_user string"),
    }


def lists(world, repeated=False):
    out = {}
    for s in (0, 1):
        order = sorted(((-v, i) for (t, i), v in world["scores"].items() if t == s))
        for u in range(USERS):
            out[s, f"u{u}"] = [i for _, i in order if repeated or (s, f"u{u}", i) not in world["seen"]]
    return out


def collected(df):
    out = defaultdict(list)
    for r in df.orderBy("split_id", "col_user", "rank").collect():
        assert r["rank"] == len(out[r["split_id"], r["col_user"]]) + 1
        out[r["split_id"], r["col_user"]].append(r["col_item"])
    return out


@pytest.mark.parametrize("k", [None, 1, 7])
def test_lists(world, k):
    got = collected(R.recommend(world["scores_df"], world["users_df"], world["seen_df"], k))
    want = {key: v[:k] for key, v in lists(world).items() if v}
    assert got == want


def test_lists_with_repetition(world):
    assert collected(R.recommend(world["scores_df"], world["users_df"])) == lists(world, True)


def test_pairs_are_the_cross_product_minus_seen(world):
    got = {tuple(r) for r in R.recommend_by_pairs(world["scores_df"], world["users_df"], world["seen_df"]).select("split_id", "col_user", "col_item").collect()}
    assert got == {(s, u, i) for (s, u), v in lists(world).items() for i in v}


CUTS = (1, 3, 10, 100)


def kpi_reference(world, k):
    out = {}
    for (s, u), items in lists(world).items():
        top = [world["values"].get((s, i), 0.0) for i in items[:k]]
        top = [v for v in top if v is not None]
        if items:
            out[s, u, k] = sum(top) / len(top) if top else None
    return out


def values_of(df):
    return {(r["split_id"], r["col_user"], r["cutoff"]): r["value"] for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == (None if value is None else pytest.approx(value, abs=1e-12)), key


def test_kpi_from_lists_and_from_ranking(world):
    want = {}
    for k in CUTS:
        want |= kpi_reference(world, k)
    recs = R.recommend(world["scores_df"], world["users_df"], world["seen_df"])
    same(values_of(M.kpi_at_k(recs, world["values_df"], CUTS, world["users_df"])), want)
    ranking = R.rank_assets(world["scores_df"])
    gaps = R.seen_ranks(ranking, world["seen_df"], world["users_df"])
    same(values_of(M.kpi_from_ranking(ranking, gaps, world["values_df"], world["users_df"], CUTS)), want)


def test_fixed_denominator(world):
    recs = R.recommend(world["scores_df"], world["users_df"], world["seen_df"])
    got = values_of(M.kpi_at_k_fixed(recs, world["values_df"], (100, -1)))
    for (s, u), items in lists(world).items():
        total = sum(world["values"].get((s, i), 0.0) or 0.0 for i in items)
        if items:
            assert got[s, u, 100] == pytest.approx(total / 100)
            assert got[s, u, -1] == pytest.approx(total / len(items))


def ndcg_reference(world, k, drop=frozenset()):
    out = {}
    for (s, u), items in lists(world).items():
        good = {i for (t, v, i) in world["wanted"] if (t, v) == (s, u)} - {i for (v, i) in drop if v == u}
        dcg = sum(1 / math.log(r + 2) for r, i in enumerate(items[:k]) if i in good)
        ideal = sum(1 / math.log(r + 2) for r in range(min(k, len(good))))
        out[s, u, k] = dcg / ideal if good and items else 0.0
    return out


def test_ndcg_from_lists_and_from_ranking(world, spark):
    want = {}
    for k in CUTS:
        want |= ndcg_reference(world, k)
    recs = R.recommend(world["scores_df"], world["users_df"], world["seen_df"])
    same(values_of(M.ndcg_at_k(recs, world["wanted_df"], world["users_df"], CUTS)), want)
    ranking = R.rank_assets(world["scores_df"])
    gaps = R.seen_ranks(ranking, world["seen_df"], world["users_df"])
    hits = M.hits_from_ranking(ranking, gaps, world["wanted_df"])
    same(values_of(M.ndcg_from_hits(hits, world["wanted_df"], world["users_df"], CUTS)), want)
    assert all(0 <= v <= 1 + 1e-12 for v in want.values())
    drop = {(u, i) for (_, u, i) in list(world["wanted"])[::3]}
    history = spark.createDataFrame(sorted(drop), "col_user string, col_item string")
    want = {}
    for k in CUTS:
        want |= ndcg_reference(world, k, drop)
    same(values_of(M.ndcg_at_k(recs, world["wanted_df"], world["users_df"], CUTS, history)), want)


def test_means_count_customers_without_lists(world):
    recs = R.recommend(world["scores_df"], world["users_df"], world["seen_df"])
    per_user = M.kpi_at_k(recs, world["values_df"], (3,))
    got = {r["split_id"]: r["value"] for r in M.mean_over_customers(per_user, world["users_df"]).collect()}
    want = kpi_reference(world, 3)
    for s in (0, 1):
        assert got[s] == pytest.approx(sum(v or 0 for (t, _, _), v in want.items() if t == s) / USERS)


def test_wide_keeps_customers_with_every_metric(world):
    recs = R.recommend(world["scores_df"], world["users_df"], world["seen_df"])
    both = M.kpi_at_k(recs, world["values_df"], (3,)).unionByName(M.ndcg_at_k(recs, world["wanted_df"], world["users_df"], (3,)))
    wide = M.metrics_wide(both, ["value", "ndcg"], (3,))
    assert wide.columns == ["split_id", "col_user", "value@3", "ndcg@3"]
    assert wide.count() == sum(1 for v in lists(world).values() if v)


# ------------------------------------------------------------------- sampling


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(2)
    pairs = {(u, i) for u in range(20) for i in range(15) if rng.random() < 0.4}
    pairs |= {(20, i) for i in range(14)} | {(21, i) for i in range(15)}
    df = spark.createDataFrame([(u, i, 1.0) for u, i in sorted(pairs)], "user_idx long, item_idx long, col_rating double")
    return pairs, df


def test_negatives_are_unseen_distinct_and_complete(spark, edges):
    pairs, df = edges
    items = df.select("item_idx").distinct()
    got = defaultdict(list)
    for r in N.unseen_items(df, items, 3, 1).collect():
        got[r["user_idx"], r["item_idx"]].append(r["neg_idx"])
    free = {u: 15 - sum(1 for v, _ in pairs if v == u) for u, _ in pairs}
    for u, i in pairs:
        mine = got.get((u, i), [])
        assert len(mine) == len(set(mine)) == min(3, free[u])
        assert all((u, n) not in pairs and 0 <= n < 15 for n in mine)


def test_negatives_are_uniform(spark):
    rows = [(u, u % 10, 1.0) for u in range(6000)]
    df = spark.createDataFrame(rows, "user_idx long, item_idx long, col_rating double")
    counts = Counter(r["neg_idx"] for r in N.unseen_items(df, df.select("item_idx").distinct(), 3, 5).collect())
    # 18000 draws over 10 assets
    assert all(abs(c - 1800) < 200 for c in counts.values()) and len(counts) == 10


def test_pair_tables(spark, edges):
    pairs, df = edges
    items = df.select("item_idx").distinct()
    assert N.pointwise_pairs(df, items, 2, 1).where("label = 1").count() == len(pairs)
    assert set(N.pairwise_triples(df, items, 1).columns) == {"user_idx", "pos_idx", "neg_idx"}
    assert all(len(r["neg_idxs"]) in (1, 2) for r in N.multi_negative_rows(df, items, 2, 1).collect())


def test_weighted_sampling(spark):
    weights = spark.createDataFrame([("a", 60), ("b", 30), ("c", 10)], "k string, n long")
    requests = spark.range(4000).withColumnRenamed("id", "req")
    drawn = Counter(r["k"] for r in N.weighted_sample(weights, requests, 2, 3, "k", "req").collect())
    assert sum(drawn.values()) == 8000
    assert drawn["a"] / 8000 == pytest.approx(0.6, abs=0.03) and drawn["c"] / 8000 == pytest.approx(0.1, abs=0.02)
    rows = defaultdict(dict)
    for r in N.weighted_sample_distinct(weights, requests, 2, 3, "k", "req").collect():
        rows[r["req"]][r["draw"]] = r["k"]
    assert len(rows) == 4000 and all(len(set(v.values())) == 2 for v in rows.values())
    first = Counter(v[0] for v in rows.values())
    assert first["a"] / 4000 == pytest.approx(0.6, abs=0.04)
    # after a, b is three times as likely as c
    second = Counter(v[1] for v in rows.values() if v[0] == "a")
    assert second["b"] / (second["b"] + second["c"]) == pytest.approx(0.75, abs=0.05)
    with pytest.raises(ValueError):
        N.weighted_sample_distinct(weights, requests, 4, 3, "k", "req")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_draws_are_not_evaluated_in_filters(spark):
    weights = spark.createDataFrame([("a", 60), ("b", 30), ("c", 10)], "k string, n long")
    requests = spark.range(10).withColumnRenamed("id", "req")
    plan = _plan(N.weighted_sample(weights, requests, 2, 3, "k", "req"))
    filters = [line for line in plan.splitlines() if "Filter " in line]
    assert filters and not any("2147483647" in line for line in filters)


def test_plan_of_distinct_draws_does_not_grow(spark):
    weights = spark.createDataFrame([(k, 1 + k * k) for k in range(12)], "k int, n long")
    requests = spark.range(50).withColumnRenamed("id", "req")
    few, all_ = (N.weighted_sample_distinct(weights, requests, n, 3, "k", "req") for n in (4, 12))
    assert len(_plan(all_).splitlines()) == len(_plan(few).splitlines())
    rows = defaultdict(dict)
    for r in all_.collect():
        rows[r["req"]][r["draw"]] = r["k"]
    assert len(rows) == 50
    assert all(sorted(v) == list(range(12)) and sorted(v.values()) == list(range(12)) for v in rows.values())
    # draws do not depend on how many follow
    assert {(r["req"], r["draw"], r["k"]) for r in few.collect()} == {
        (req, d, k) for req, v in rows.items() for d, k in v.items() if d < 4
    }


def test_exclusion_and_probabilities(spark):
    p = spark.createDataFrame([(0, 0.5), (1, 0.25), (2, 0.25), (3, 0.0)], "k int, p double")
    weights = N.excluding(N.integer_weights(p, "k", "p"), spark.createDataFrame([(0,)], "k int"), "k")
    drawn = {r["k"] for r in N.weighted_sample(weights, spark.range(200).withColumnRenamed("id", "r"), 2, 1, "k", "r").collect()}
    assert drawn == {1, 2}


# ---------------------------------------------------------------------- graph


def test_graph_rows_sum_to_one(spark, edges):
    _, df = edges
    users = df.select("user_idx").distinct()
    for table in (G.row_normalized(df, users), G.row_normalized_with_loops(df, users)):
        sums = table.groupBy("src").agg(F.sum("weight").alias("s")).collect()
        assert len(sums) == 37 and all(r["s"] == pytest.approx(1.0) for r in sums)


def test_symmetric_weights_count_repeats(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (2, 1)], "user_idx long, item_idx long")
    users = df.select("user_idx").distinct()
    got = {(r["src"], r["dst"]): r["weight"] for r in G.symmetric_normalized(df, users).collect()}
    assert got[0, 3] == pytest.approx(2 / (math.sqrt(3) * math.sqrt(2))) == got[3, 0]
    assert got[2, 4] == pytest.approx(1 / math.sqrt(3))


def test_dropout_sizes_are_exact(spark, edges):
    pairs, df = edges
    assert G.drop_edges(df, 0.3, 4).count() == math.floor(len(pairs) * 0.7)
    users, items = df.select("user_idx").distinct(), df.select("item_idx").distinct()
    kept = G.drop_nodes(df, users, items, 0.2, 4)
    assert kept.select("user_idx").distinct().count() <= 22 - 4
    assert kept.select("item_idx").distinct().count() <= 15 - 3


def test_vector_chunks_are_bounded(spark, edges):
    pairs, df = edges
    rows = G.user_vector_chunks(df, 4).collect()
    assert all(len(r["items"]) <= 4 for r in rows)
    assert {(r["user_idx"], i) for r in rows for i in r["items"]} == pairs


def test_random_features_look_normal(spark):
    rows = G.random_features(spark.range(3000).withColumnRenamed("id", "n"), "n", 3, 9).collect()
    flat = [v for r in rows for v in r["features"]]
    mean = sum(flat) / len(flat)
    var = sum((v - mean) ** 2 for v in flat) / len(flat)
    assert abs(mean) < 0.04 and abs(var - 1) < 0.05


def test_list_rows_do_not_move_for_metrics(spark):
    """Lists dealt by customer are neither sorted for the eligible customers nor shuffled for the positives."""
    recs = spark.range(60).selectExpr(
        "cast(id % 2 as int) split_id", "id % 6 col_user", "concat('a', id % 10) col_item", "cast(id % 10 + 1 as int) rank"
    )
    values = spark.createDataFrame([(0, "a1", 0.5), (1, "a2", 0.1)], "split_id int, col_item string, value double")
    eligible = recs.where("col_user < 4").select("split_id", "col_user").distinct()
    positives = spark.createDataFrame([(0, 0, "a1")], "split_id int, col_user long, col_item string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kpis = M.kpi_at_k(recs, values, (1, 5), eligible)
        assert "LeftSemi" not in kpis._jdf.queryExecution().optimizedPlan().toString()
        assert {r["col_user"] for r in kpis.select("col_user").collect()} == {0, 1, 2, 3}
        ndcg = M.ndcg_at_k(recs, positives, eligible, (1, 5))
        plan = ndcg._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "hashpartitioning" in line and "col_item" in line]
        assert moved == [] and "ShuffledHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
