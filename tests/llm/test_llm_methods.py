"""Parts of the methods on their own."""

import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute
from pyspark.sql import functions as F

from assetloom.llm import suffix_dedup
from assetloom.llm.bloom import build_filter, may_hold, passes
from assetloom.llm.components import components
from assetloom.llm.contamination import suffix_array
from assetloom.llm.lsh_forest import intersections, near_duplicates, prefix_depth
from assetloom.llm.numtext import utf8, words
from assetloom.llm.pii import bootstrap
from assetloom.llm.quality import LABELLERS, Settings, fit_votes, score_quality, train_quality
from assetloom.llm.queries import tokenizer_path
from assetloom.llm.sentencepiece_table import PieceDecoder, PieceTable, load_pieces
from assetloom.llm.suffix_dedup import find_anchors, remove_repeats

SCHEMA = "doc_id bigint, text string"


def test_words_agree_with_the_expression():
    texts = ["", "A-b c", "é É ßx9_", "日本 ab", "  ", "x" * 300, "end"]
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    (hashes,), counts = words(data, offsets)
    flat = [w for t in texts for w in brute.words(t)]
    assert np.diff(counts).tolist() == [len(brute.words(t)) for t in texts]
    seen = {}
    for w, h in zip(flat, hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 4, 400).astype(np.uint64)
    order = suffix_array(tokens, 400)
    assert order.tolist() == sorted(range(400), key=lambda i: tokens[i:].tolist())
    short = suffix_array(tokens, 3)
    assert [tokens[i : i + 3].tolist() for i in short] == sorted(tokens[i : i + 3].tolist() for i in range(400))


def test_every_string_holds_an_anchor():
    """Equal strings choose the same place, so a repeat is never missed."""
    rng = random.Random(2)
    length = 40
    text = "".join(rng.choice("ab c") for _ in range(3000)) + "a" * 200
    data = np.frombuffer(text.encode(), np.uint8)
    _, pos, _, _, _ = find_anchors(data, np.array([0, len(data)]), length)
    places = set(pos.tolist())
    chosen = {}
    for i in range(len(text) - length + 1):
        inside = sorted(p - i for p in places if i <= p <= i + length - 10)
        assert inside
        assert chosen.setdefault(text[i : i + length], inside[0]) in inside


@pytest.mark.parametrize(("rows_at_once", "length"), [(2, 40), (7, 60)])
def test_hot_anchors_are_split_by_distances(spark, monkeypatch, rows_at_once, length):
    """Nested passages: shared by all texts, by many and by few, some at the ends of texts, some repeated inside one."""
    from assetloom.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", rows_at_once)
    rng = random.Random(12)
    some = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    core, before, after = some(30), [some(25) for _ in range(4)], [some(25) for _ in range(4)]
    far = [some(20) for _ in range(3)]
    rows = []
    for i in range(70):
        inner = rng.choice(before)[rng.randrange(20) :] + core + rng.choice(after)[: rng.randrange(5, 26)]
        outer = (rng.choice(far) if i % 3 else "") + inner + (rng.choice(far) if i % 4 else "")
        rows.append((i, (some(rng.randrange(9)) + outer) * (2 if i % 10 == 0 else 1) + some(rng.randrange(9))))
    rows += [(100, core), (101, core + after[0]), (102, rows[3][1]), (103, None)]
    out = remove_repeats(spark.createDataFrame(rows, SCHEMA), length=length).collect()
    got = sorted(
        (r["doc_id"], r["n_bytes"], sum(s["hi"] - s["lo"] for s in r["spans"]), len(r["spans"]), bytes(r["kept_bytes"]))
        for r in out
    )
    assert got == sorted(brute.repeated_bytes(rows, length))


def test_many_surroundings_are_counted_alike(spark, monkeypatch):
    """A passage in many documents with different neighbours: both ways of comparing agree."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(30))
    rows = [(i, " ".join(word() for _ in range(20)) + passage + " ".join(word() for _ in range(20))) for i in range(40)]
    want = sorted(brute.repeated_bytes(rows, 60))
    docs = spark.createDataFrame(rows, SCHEMA)

    def got():
        out = remove_repeats(docs, length=60).collect()
        return sorted(
            (r["doc_id"], r["n_bytes"], sum(s["hi"] - s["lo"] for s in r["spans"]), len(r["spans"]), bytes(r["kept_bytes"]))
            for r in out
        )

    assert got() == want
    monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", 5)
    assert got() == want


def test_rows_of_a_heavy_key_are_not_gathered(spark, monkeypatch):
    """One key has nearly all rows: it is joined where its rows lie, with the same result."""
    monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", 50)
    monkeypatch.setattr(suffix_dedup, "HEAVY_KEYS", 2)
    # 1 is heavy, 2 to 4 have 60 rows of which one goes beyond the limit of keys, the others are light or without a key
    key = F.when(F.col("id") < 3_800, 1).when(F.col("id") < 3_980, 2 + F.col("id") % 3).otherwise(F.col("id"))
    rows = spark.range(0, 4_000, 1, 8).withColumn("h", key.cast("long"))
    keys = suffix_dedup.materialize(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("h != 3990"))
    plain = rows.join(keys.hint("merge"), ["h"])
    dealt = suffix_dedup._dealt(rows, keys, ["h"], "n")
    assert dealt.columns == plain.columns
    assert sorted(dealt.collect()) == sorted(plain.collect())

    def most(joined):
        return joined.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]

    assert most(plain) >= 3_800
    assert most(dealt) <= 500


def test_a_copied_periodic_text_is_dealt_out(spark, monkeypatch):
    """One anchor in many places, most with equal surroundings: the same bytes as by plain loops."""
    monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", 50)
    joins = []
    dealt = suffix_dedup._dealt

    def watched(rows, keys, on, weight):
        joins.append((on, keys.where(F.col(weight) > 50).count()))
        return dealt(rows, keys, on, weight)

    monkeypatch.setattr(suffix_dedup, "_dealt", watched)
    rows = [(i, "abcdefg" * 60) for i in range(30)] + [(100 + i, f"{i} " + "xyz" * 40) for i in range(3)]
    out = remove_repeats(spark.createDataFrame(rows, SCHEMA), length=60).collect()
    got = sorted(
        (r["doc_id"], r["n_bytes"], sum(s["hi"] - s["lo"] for s in r["spans"]), len(r["spans"]), bytes(r["kept_bytes"]))
        for r in out
    )
    assert got == sorted(brute.repeated_bytes(rows, 60))
    assert any(on == ["h", "c"] and heavy for on, heavy in joins)


def test_levels_grow_geometrically(spark):
    index = suffix_dedup.SuffixIndex()
    found = []
    for k in range(5):
        batch = spark.createDataFrame([(h,) for h in range(k * 10, k * 10 + 12)], "h bigint")
        found.append(sorted(r["h"] for r in index.add(batch).collect()))
    assert [n for n, _ in index.levels] == [4, 1]
    assert found == [[], [10, 11], [20, 21], [30, 31], [40, 41]]


def test_bloom_has_no_misses_and_few_false_positives(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("digest"))
    filter_ = build_filter(keys)
    probe = spark.range(20_000).select("id", may_hold(keys, "digest", F.xxhash64("id")).alias("may")).collect()
    assert all(r["may"] for r in probe if r["id"] < 2000)
    assert sum(r["may"] for r in probe if r["id"] >= 2000) < 0.01 * 18_000
    assert passes(filter_, np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (10, 11), (12, 11), (20, 21)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(1, 8), 1), **dict.fromkeys((10, 11, 12), 10), 20: 20, 21: 20}


def test_intersections():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 50, rng.integers(0, 40)).astype(np.uint64)) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert intersections(sets).astype(int).tolist() == want


def test_prefixes_are_shortened_until_the_recall_is_reached():
    assert prefix_depth(0.8, 0.0) == 6 and prefix_depth(0.8, 0.99999) == 4 and prefix_depth(0.4, 0.999) == 1
    # a target that no prefix reaches is refused, not missed silently
    with pytest.raises(ValueError):
        prefix_depth(0.3, 0.999999)


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8])
def test_recall_at_the_threshold(spark, threshold):
    """Pairs that are exactly as similar as asked for, or just not."""
    n, rows = 400, []
    for pair in range(n):
        # sets of 60 words with k in common: similarity k / (120 - k)
        k = int(np.ceil(120 * threshold / (1 + threshold) - 1e-9)) - (pair % 4 == 3)
        first = [f"p{pair}w{i}" for i in range(60)]
        second = first[:k] + [f"p{pair}x{i}" for i in range(60 - k)]
        rows += [(2 * pair, " ".join(first)), (2 * pair + 1, " ".join(second))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates(docs, n=1, threshold=threshold).collect()}
    for pair in range(n):
        linked = pair % 4 != 3
        assert got[2 * pair] == (2 * pair, int(linked))
        assert got[2 * pair + 1] == (2 * pair + (not linked), int(linked))


def test_forest_finds_all_links_of_a_large_group(spark):
    """More near copies than fit a block, all with different texts, and their exact copies."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(620):
        text = list(base)
        text[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, rows[i][1]) for i in range(50)]
    rows += [(5000 + i, " ".join(f"y{i}_{j}" for j in range(30))) for i in range(20)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute.near_classes(rows)


@pytest.fixture(scope="module")
def model():
    return load_pieces(tokenizer_path())


def test_encoder_and_decoder_match_the_library(model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    table, decoder = PieceTable(model), PieceDecoder(model)
    rng = random.Random(7)
    parts = ["a", "th", " ", "  ", "▁", "\n", "\t", "é", "日", "\U0001f600", "1", "==", "    ", "<s>", "<0x41>", "\x00", "the", "​"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(4000)]
    for text in [*texts, *(" " * n + "x" for n in range(70)), "z" * 500]:
        ids = np.frombuffer(table.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_bos=True, add_eos=True)
        assert decoder.decode(ids) == library.decode(ids)
    for _ in range(3000):
        ids = [rng.randrange(32000) if rng.random() < 0.4 else rng.randrange(3, 259) for _ in range(rng.randrange(8))]
        assert decoder.decode(ids) == library.decode(ids)


def test_patterns_are_scored_in_rounds(spark):
    """What one pattern discovers makes another one confident in the next round."""
    rows = [(f"seed{i}", 0, ["1 mail"]) for i in range(9)]
    rows += [(f"new{i}", None, ["1 mail", "1 write"]) for i in range(2)]
    rows += [("seed0", 0, ["1 write"]), ("seed1", 0, ["1 write"]), ("seed2", 0, ["1 write"]), ("far", None, ["1 write"])]
    rows += [("other", None, ["1 page"]), ("seed3", 0, ["1 page"])]
    table = spark.createDataFrame(rows, "surface string, kind int, patterns array<string>")
    found = {r["surface"]: r["kind"] for r in bootstrap(table).collect()}
    assert found == {"new0": 0, "new1": 0, "far": 0}


def test_em_recovers_accuracies():
    rng = np.random.default_rng(8)
    accuracy = np.array([0.95, 0.9, 0.85, 0.8, 0.75])
    truth = rng.random(20_000) < 0.7
    votes = np.where(rng.random((20_000, 5)) < accuracy, truth[:, None], ~truth[:, None])
    silent = rng.random(votes.shape) < 0.3
    patterns = {}
    for v, s in zip(votes, silent, strict=True):
        key = "".join("-" if q else "1" if x else "0" for x, q in zip(v, s, strict=True))
        patterns[key] = patterns.get(key, 0) + 1
    posterior, rates, share = fit_votes(patterns, 200)
    assert abs(share - 0.7) < 0.03
    assert np.abs(rates[:, 1, 0] - accuracy).max() < 0.03 and np.abs(rates[:, 0, 1] - accuracy).max() < 0.04
    assert posterior["11111"] > 0.98 and posterior["00000"] < 0.02
    assert fit_votes({}, 5)[0] == {}


def test_quality(spark):
    rng = random.Random(9)
    syllables = ["ta", "lo", "mi", "ren", "sa", "ko", "ven"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def good():
        return " ".join(" ".join(word() for _ in range(rng.randint(8, 14))) + "." for _ in range(rng.randint(4, 8)))

    def junk(i):
        w = [word() for _ in range(40)]
        return [" ".join(x + "***" for x in w), " ".join(x.upper() + "!!" for x in w), " ".join([w[0]] * 40), " | ".join(w)][i % 4]

    rows = [(i, junk(i // 6) if i % 6 == 0 else good()) for i in range(900)] + [(9001, None), (9002, ""), (9003, "x " * 50_000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("mine"))
    out = {r["doc_id"]: r for r in score_quality(docs, train_quality(docs, settings=Settings(sample=600))).collect()}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out.values())
    wrong = sum(out[i]["predicted"] != (i % 6 != 0) for i in range(900))
    assert wrong < 20
    assert out[9003]["predicted"] == 0 and len(LABELLERS) == 12
    none = docs.limit(0)
    assert score_quality(none, train_quality(none)).count() == 0
