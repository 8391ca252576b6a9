"""Ranked search against scores added up in plain loops."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetloom.llm import lexical_search
from assetloom.llm.lexical_search import build_index, search, term_counts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, items, k=10):
    """(item, rank, id, score) for rows (id, text) and (item, text)."""
    counted = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    counted = [x for x in counted if x[2]]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in counted:
            m = 10 + (90 * n * n_docs) // total
            score = 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d if d is not None else 0, d))
        scores.sort()
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(scores[:k])]
    return sorted(out, key=str)


def answer(found):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=str)


def corpus(seed, n, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["été", "日本", "x9"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    pick = lambda k: " ".join(rng.choices(vocabulary, weights, k=k))
    docs = [(i, pick(rng.choice([1, 3, 20, 200]))) for i in range(n)]
    items = [(i, pick(rng.choice([1, 5, 30]))) for i in range(12)]
    return docs, items


@pytest.fixture(autouse=True)
def small_shards(monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", 3000)
    monkeypatch.setattr(lexical_search, "PROBED_SHARDS", 2)


@pytest.mark.parametrize(("seed", "n", "k", "block"), [(1, 300, 10, 1 << 20), (2, 120, 3, 400), (3, 5, 10, 400)])
def test_random(spark, seed, n, k, block):
    docs, items = corpus(seed, n)
    index = build_index(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3))
    found = search(index, spark.createDataFrame(items, "item_id bigint, text string"), k=k, block_bytes=block)
    assert answer(found) == brute(docs, items, k)


def test_ties_nulls_and_odd_rows(spark):
    copy = "Equal texts HAVE equal-scores, été 12"
    docs = [(i, copy) for i in range(200, 150, -1)] + [(None, copy), (7, copy), (7, copy)]
    docs += [(1, None), (2, ""), (3, " .,;\n"), (4, "other words only"), (5, "equal " * 40_000 + "end"), (6, "z" * 9000)]
    items = [(1, copy), (2, None), (3, "."), (4, "unknown"), (5, "OTHER other"), (6, "z" * 9000), (None, "equal"), (1, "texts")]
    rows = [(i, t, "mine", "mine", "mine", "mine") for i, t in items]
    names = "item_id bigint, text string, rank string, id string, row string, _llm_row string"
    index = build_index(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4))
    found = search(index, spark.createDataFrame(rows, names))
    assert found.columns == ["item_id", "text", "id", "row", "_llm_row", "rank", "doc_id", "score"]
    assert answer(found) == brute(docs, items)
    top = found.where((F.col("item_id") == 1) & (F.col("text") == copy)).orderBy("rank").collect()
    assert [r["doc_id"] for r in top] == [7, 7, *range(151, 159)]
    assert {r["id"] for r in top} == {"mine"}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "some")], "item_id bigint, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0)), (docs, items)):
        found = search(build_index(d), i)
        # the only document holds its term: its weight rounds down to floor(1000 ln(4/3))
        assert found.columns == ["item_id", "text", "rank", "doc_id", "score"]
        assert answer(found) == brute([tuple(r) for r in d.collect()], [tuple(r) for r in i.collect()])


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(lexical_search, "PIECE_BYTES", 7)
    text = "Some longer text, with été and " * 50 + "x" * 100
    assert term_counts(text) == Counter(t.encode() for t in terms(text))


def test_splits_fewer_than_documents(monkeypatch):
    """Most documents are never scored: intervals are dropped by their bounds."""
    rng = np.random.default_rng(5)
    lists = [np.sort(rng.choice(4000, 1500, replace=False)) for _ in range(6)]
    sizes = np.array([len(x) for x in lists])
    import pyarrow as pa

    row = {
        "terms": pa.array([b"a", b"b", b"c", b"d", b"e", b"f"]),
        "sizes": pa.array(sizes.astype(np.int32)),
        "docs": pa.array(np.concatenate(lists).astype(np.int32)),
        "counts": pa.array(rng.geometric(0.5, sizes.sum()).astype(np.int32)),
        "lengths": pa.array(rng.integers(10, 400, 4000)),
    }
    weights = {t: (i, 1000 + 500 * i) for i, t in enumerate([b"a", b"b", b"c", b"d", b"e", b"f"])}
    shard = lexical_search._Shard(row, weights, 4000, int(np.sum(row["lengths"].to_numpy())))
    scored = 0
    plain = np.searchsorted

    def counting(key, value, *more):
        nonlocal scored
        scored += len(value) / 6
        return plain(key, value, *more)

    monkeypatch.setattr(np, "searchsorted", counting)
    item, score, doc = lexical_search.search_shard(shard, [list(range(6))], np.zeros(1, np.int64), 10)
    total = np.zeros(4000, np.int64)
    np.add.at(total, shard.doc, shard.impact)
    want = sorted(((-s, d) for d, s in enumerate(total.tolist())))[:10]
    assert [(-s, d) for s, d in zip(score.tolist(), doc.tolist(), strict=True)] == want
    assert scored < 2000


def test_the_index_is_bounded_however_much_a_task_reads(spark, monkeypatch):
    """Writers and readers hold a row group: a few shards of it, not all that a task has made."""
    from urllib.parse import unquote, urlparse

    import pyarrow.parquet as pq

    monkeypatch.setattr(lexical_search, "SHARD_BYTES", 8 << 10)
    monkeypatch.setattr(lexical_search, "GROUP_BYTES", 32 << 10, raising=False)
    texts = [(i, " ".join(f"w{i * 31 + j}" for j in range(60))) for i in range(900)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    index = build_index(docs)
    files = [pq.ParquetFile(unquote(urlparse(f).path)).metadata for f in index.shards.inputFiles()]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) > 30
    assert max(g.num_rows for g in groups) <= 8
    found = search(index, spark.createDataFrame([(1, "w310 w340 w27899")], "item_id long, text string")).collect()
    want = {i for i, t in texts if set(t.split()) & {"w310", "w340", "w27899"}}
    assert {r["doc_id"] for r in found} == want


def test_items_are_searched_some_at_a_time(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(3, 25)))) for i in range(200)]
    items = [(i, " ".join(f"w{rng.randrange(45)}" for _ in range(rng.randrange(0, 9)))) for i in range(30)]

    def found():
        index = build_index(spark.createDataFrame(docs, "doc_id long, text string"))
        rows = search(index, spark.createDataFrame(items, "item_id long, text string"))
        return sorted(tuple(r) for r in rows.select("item_id", "rank", "doc_id", "score").collect())

    assert lexical_search._together([[1] * 5, [], [1] * 3, [1] * 9]) == [slice(0, 4)]
    want = found()
    monkeypatch.setattr(lexical_search, "ITEM_TERMS", 7)
    assert lexical_search._together([[1] * 5, [], [1] * 3, [1] * 9]) == [slice(0, 2), slice(2, 3), slice(3, 4)]
    assert found() == want == sorted(brute(docs, items))
