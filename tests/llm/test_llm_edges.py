"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import os
import random
import sys
import zlib
from dataclasses import replace

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute
from pyspark.sql import functions as F

from assetloom.llm.contamination import decontaminate, find_contamination
from assetloom.llm.line_dedup import dedup_lines
from assetloom.llm.lsh_forest import near_duplicates
from assetloom.llm.pii import KINDS, find_personal_data
from assetloom.llm.queries import tokenizer_path
from assetloom.llm.radix_dedup import drop_exact_copies, exact_groups
from assetloom.llm.sentencepiece_table import decode_ids, encode_texts
from assetloom.llm.suffix_dedup import find_anchors, piece_anchors, remove_repeats
from assetloom.llm.toxicity import (
    Model,
    Settings,
    _border,
    _Featurizer,
    _margins,
    score_toxicity,
    train_toxicity,
    word_features,
)
from assetloom.llm.url_filter import judge_urls

SCHEMA = "doc_id bigint, text string"
LONG = " ".join(f"word{i * i % 7919}" for i in range(30_000))
NOISE = " ".join(f"noise{i * i % 6007}" for i in range(300))
ROWS = [
    (1, None),
    (2, ""),
    (3, " \n\t"),
    (4, "one line that is long\nshort"),
    (5, "One Line that is long \nother words here"),
    (6, LONG),
    (7, LONG + " tail"),
    (8, NOISE),
    (8, NOISE),
    (None, NOISE),
    (None, None),
    (9, "x" * 3000),
    (10, "ß日本\U0001f600 été\n" * 40),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def clashing(docs, *names):
    """The rows with further columns that bear names of outputs and internals."""
    out = docs.withColumn("lang", F.lit("xx"))
    for name in (*names, "id", "digest", "n", "row", "gid", "h", "key", "bits", "own", "wanted_id"):
        out = out.withColumn(name, F.lit("mine"))
    return out


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "lines": (dedup_lines, ("kept_text", "n_lines", "n_dropped")),
    "exact": (exact_groups, ("keep_id", "group_size", "kept")),
    "near": (near_duplicates, ("class_id", "n_links")),
    "bytes": (remove_repeats, ("n_bytes", "spans", "kept_bytes")),
    "personal": (find_personal_data, ("spans", "base_spans")),
    "encode": (lambda d: encode_texts(d, tokenizer_path()), ("ids",)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    operator, outputs = OPERATORS[name]
    out = operator(empty(spark))
    assert out.columns == ["doc_id", "text", *[c for c in out.columns if c in outputs]]
    assert set(outputs) <= set(out.columns) and out.count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_names_and_every_row(spark, docs, name):
    operator, outputs = OPERATORS[name]
    plain, clash = operator(docs), operator(clashing(docs, *outputs))
    assert plain.count() == clash.count() == len(ROWS)
    seen = clash.select("lang", "digest", "gid").distinct().collect()
    assert [tuple(r) for r in seen] == [("xx", "mine", "mine")]
    key = lambda r: str(r)
    columns = ["doc_id", "text", *outputs]
    assert sorted(map(key, plain.select(*columns).collect())) == sorted(map(key, clash.select(*columns).collect()))


@pytest.mark.parametrize("name", ["bytes", "lines", "near"])
def test_names_of_internal_columns_may_occur(spark, docs, name):
    operator, outputs = OPERATORS[name]
    internal = [f"_llm_{x}" for x in ("own", "id", "digest", "drop", "lines", "stays", "found")]
    out = operator(docs.withColumns({c: F.lit("mine") for c in internal}))
    assert out.columns == ["doc_id", "text", *internal, *[c for c in out.columns if c in outputs]]
    assert [tuple(r) for r in out.select(*internal).distinct().collect()] == [("mine",) * len(internal)]
    assert out.count() == len(ROWS)


def test_lines(docs):
    got = [(r["doc_id"], r["kept_text"]) for r in dedup_lines(docs).collect()]
    order = [(d if d is not None else 10**9, t) for d, t in ROWS]
    want = [(None if d == 10**9 else d, t) for d, t in brute.drop_lines(order)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_lines_threshold(spark):
    rows = [(i, "a line of some length") for i in range(3)] + [(9, "another line of length"), (10, "another line of length")]
    got = {r["doc_id"]: r["kept_text"] for r in dedup_lines(spark.createDataFrame(rows, SCHEMA), min_docs=3).collect()}
    assert [got[i] for i in (0, 1, 2, 9, 10)] == [rows[0][1], "", "", rows[3][1], rows[4][1]]


def test_exact(spark, docs):
    got = {}
    for r in exact_groups(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["keep_id"], r["group_size"], r["kept"]))
    # white space alone equals the empty text; the longest original stays
    assert got[1] == got[2] == [(3, 4, False)] and got[3] == [(3, 4, True)]
    # of rows equal in text and id one stays; NULL ids come last
    assert sorted(got[8]) == [(8, 3, False), (8, 3, True)]
    assert sorted(got[None], key=str) == [(3, 4, False), (8, 3, False)]
    assert got[6] == [(6, 1, True)] and got[7] == [(7, 1, True)]
    assert drop_exact_copies(docs).count() == len(ROWS) - 5


def test_exact_prefers_more_code_points(spark):
    rows = [(1, "a b c"), (2, "a  b  c"), (3, "abc"), (4, "a  b c "), (5, "abcd"), (6, "ab")]
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (2, False), 2: (2, True), 3: (2, False), 4: (2, False), 5: (5, True), 6: (6, True)}


def test_exact_common_prefixes(spark):
    """Texts that part after the first digit, end within one, or at its border."""
    base = "".join(f"{i:04d}" for i in range(400))
    texts = [base[:n] for n in (63, 64, 65, 319, 320, 321, 1343, 1344, 1345)] + [base[:700] + "x", base[:700] + "y"]
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (i % len(texts), 2) for i in range(len(rows))}


def test_near(docs):
    got = {}
    for r in near_duplicates(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["class_id"], r["n_links"]))
    assert got[1] == [(1, 0)] and got[2] == [(2, 0)] and got[3] == [(3, 0)]
    assert got[6] == [(6, 1)] and got[7] == [(6, 1)]
    assert got[8] == [(8, 2), (8, 2)] and sorted(got[None], key=str) == [(8, 2), (None, 0)]
    assert got[4] == [(4, 0)]


def test_near_threshold_is_inclusive(spark):
    """Short texts are one n-gram; a similarity of exactly 0.8 is a link."""
    words = [f"w{i}" for i in range(13)]  # 9 n-grams; with one word appended or dropped 8 of 10 are shared
    a, b = " ".join(words), " ".join([*words[1:], "z"])
    rows = [(1, a), (2, b), (3, "just three words"), (4, "Just three, words"), (5, "just four other words")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (3, 1), 5: (5, 0)}


@pytest.mark.parametrize("length", [40, 400])
def test_bytes(docs, length):
    got = [
        (r["doc_id"], r["n_bytes"], sum(s["hi"] - s["lo"] for s in r["spans"]), len(r["spans"]), bytes(r["kept_bytes"]))
        for r in remove_repeats(docs.where(F.length("text") < 50_000), length=length).collect()
    ]
    rows = [(d, t) for d, t in ROWS if t is not None and len(t) < 50_000]
    assert sorted(got, key=str) == sorted(brute.repeated_bytes(rows, length), key=str)


def test_pieces_of_a_long_text_have_the_anchors_of_the_whole():
    rng = np.random.default_rng(8)
    data = rng.integers(97, 101, 40_000).astype(np.uint8)
    data[30_000:31_000] = data[5_000:6_000]
    offsets = np.array([0, len(data)])
    for length in (40, 400):
        whole = find_anchors(data, offsets, length)
        for piece in (1_000, 7_777, 19_999):
            parts = piece_anchors(data, offsets, length, piece)
            for a, b in zip(whole, parts, strict=True):
                assert np.array_equal(a, b)


def test_bytes_of_one_text_far_beyond_a_shard(spark):
    """30 MB in one row: only what was planted repeats."""
    rng = np.random.default_rng(9)
    text = bytearray(rng.integers(33, 127, 30_000_000).astype(np.uint8).tobytes())
    text[20_000_000:20_001_000] = text[1_000_000:1_001_000]
    text[29_999_000:30_000_000] = text[500:1_500]
    rows = [(1, text.decode()), (2, "short"), (3, text[9_000_000:9_000_700].decode())]
    got = {r["doc_id"]: r for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).drop("text").collect()}
    spans = [(s["lo"], s["hi"]) for s in got[1]["spans"]]
    want = [(500, 1_500), (1_000_000, 1_001_000), (9_000_000, 9_000_700), (20_000_000, 20_001_000)]
    assert spans == [*want, (29_999_000, 30_000_000)]
    assert len(got[1]["kept_bytes"]) == 30_000_000 - sum(b - a for a, b in spans)
    assert got[3]["kept_bytes"] == b"" and got[2]["kept_bytes"] == b"short"


def test_bytes_of_long_texts(docs):
    got = {r["doc_id"]: (r["n_bytes"], len(r["kept_bytes"])) for r in remove_repeats(docs.where("doc_id in (6, 7)")).collect()}
    assert got[6][0] == len(LONG) and got[6][1] == 0
    # the words of LONG come round again, so the space after them is not new either
    assert got[7] == (len(LONG) + 5, 4)


def test_personal(docs, spark):
    text = "mail a.b@c.d@e.f, 1.2.3.4.5 and 300.1.1.1 card 4111 1111 1111 1111 é +1 (555) 555-1234; " + "9" * 5000
    rows = [*ROWS, (20, text), (21, "a@b.c_d@e.f 00000255.1.1.01 +++1 234 567 89-")]
    for r in find_personal_data(spark.createDataFrame(rows, SCHEMA)).collect():
        want = brute.personal(r["text"])
        assert [(s["start"], s["kind"], s["end"]) for s in r["base_spans"]] == want
        assert {tuple(s) for s in r["base_spans"]} <= {tuple(s) for s in r["spans"]}


def test_personal_discovers_identifiers_in_context(spark):
    rows = [(i, f"please write to user{i}@mail{i}.org about it") for i in range(12)]
    rows += [(20, "please write to user20@localhost about it"), (21, "chapter 7 of the book"), (22, "see 12@home there")]
    out = {r["doc_id"]: r for r in find_personal_data(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [tuple(s) for s in out[20]["spans"]] == [(16, KINDS.index("email"), 32)]
    assert not out[20]["base_spans"] and not out[21]["spans"] and not out[22]["spans"]


def test_encoding(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    rows = decode_ids(encode_texts(docs, tokenizer_path()), tokenizer_path()).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        ids = model.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["decoded"] == model.decode(ids) == (r["text"] or "")


BENCH = "item_id bigint, text string"


def test_contamination(spark, docs):
    items = [(1, " ".join(LONG.split()[100:140])), (2, "one line THAT"), (3, None), (4, ""), (None, NOISE[:200]), (1, "other words here")]
    bench = spark.createDataFrame(items, BENCH)
    kept_ids = [d for d, _ in ROWS]
    found = find_contamination(docs, bench).collect()
    assert [r["doc_id"] for r in found] == kept_ids
    for r in found:
        want = brute.contaminated([(0, r["text"])], [("" if i is None else str(i), t) for i, t in items])[0]
        assert r["n_words"] == want[0] and sum(h["end"] - h["start"] for h in r["hits"]) == want[1]
        assert r["items"] == sorted(want[2]) and r["contaminated"] == (want[1] > 0)
    assert [r["longest"] for r in found if r["doc_id"] in (1, 6)] == [0, 40]
    clean = decontaminate(clashing(docs, "hits", "n_words"), bench)
    assert clean.columns == clashing(docs, "hits", "n_words").columns
    assert clean.count() == sum(not r["contaminated"] for r in found)


def test_contamination_in_blocks(spark, docs):
    items = [(i, " ".join(LONG.split()[i * 50 : i * 50 + 15])) for i in range(40)] + [(99, "words here")]
    bench = spark.createDataFrame(items, BENCH)
    whole = find_contamination(docs, bench).collect()
    parts = find_contamination(docs, bench, block_bytes=1500).collect()
    assert whole == parts


def test_contamination_counts_repeated_items_once(spark, docs):
    items = [(1, " ".join(LONG.split()[100:140]))] * 50 + [(2, "other words here")]
    whole = find_contamination(docs, spark.createDataFrame(items[-2:], BENCH)).collect()
    again = find_contamination(docs, spark.createDataFrame(items, BENCH), block_bytes=2000).collect()
    assert sorted(map(str, again)) == sorted(map(str, whole))


def test_contamination_empty(spark, docs):
    none = find_contamination(docs, spark.createDataFrame([], BENCH)).collect()
    assert len(none) == len(ROWS) and not any(r["contaminated"] for r in none)
    assert find_contamination(empty(spark), spark.createDataFrame([(1, "a b")], BENCH)).count() == 0


RULES = "host string, path string, verdict string"


def test_urls(spark):
    urls = [None, "", "no scheme/", "http://", "http:///en/", "HTTP://WWW.Example.COM/en/x?y#z", "http://a.example.com/en/",
            "http://badexample.com/en/", "http://example.com", "http://example.com?/en/", "http://example.com/EN/", "x://net/es/1",
            "http://a." * 3 + "net/fr/", "http://" + "a." * 3000 + "com/" + "p" * 5000]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls * 2)], "page_id int, url string, host string")
    rules = spark.createDataFrame(
        [("com", "/", "allow"), ("Example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("net", "/es/", "allow"), (None, "/", "block"), ("", "/", "block")], RULES)
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in judge_urls(pages, rules).collect()}
    assert len(got) == 2 * len(urls) and all(got[i] == got[i + len(urls)] for i in range(len(urls)))
    assert [got[i] for i in range(5)] == [("", None, "allow")] * 5
    assert got[5] == ("www.example.com", "www.example.com/en/", "allow")
    assert got[6][1:] == ("example.com/en/", "block") and got[7][1:] == ("com/", "allow")
    assert got[8][1:] == (None, "allow") and got[9][1:] == (None, "allow") and got[10][1:] == ("com/", "allow")
    assert got[11][1:] == ("net/es/", "block") and got[12][1:] == (None, "allow") and got[13][1:] == ("com/", "allow")
    none = judge_urls(pages, spark.createDataFrame([], RULES), default="block").collect()
    assert len(none) == 2 * len(urls) and {r["verdict"] for r in none} == {"block"}
    assert judge_urls(pages.limit(0), rules).count() == 0


LABELS = "doc_id bigint, toxic int"


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(1, None), (4, 0), (None, 1)], LABELS)
    model = train_toxicity(docs, labels)  # no confirmed document
    scored = score_toxicity(clashing(docs, "score"), model).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 for r in scored)
    assert score_toxicity(empty(spark), train_toxicity(empty(spark), spark.createDataFrame([], LABELS))).count() == 0


def test_toxicity_learns(spark):
    import random
    import zlib

    rng = random.Random(5)
    common = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("ara", "elo", "iminu", "ot")]
    bad = ["vilest", "scumbag", "wretch", "vermin"]
    rows, labels = [], []
    for i in range(3000):
        toxic = i % 8 == 0
        text = rng.choices(common, k=rng.randint(10, 60))
        for _ in range(rng.randint(1, 3) if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append((i, " ".join(text)))
        if rng.random() < 0.5:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, SCHEMA)
    scored = score_toxicity(docs, train_toxicity(docs, spark.createDataFrame(labels, LABELS))).collect()
    held = [r for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = sum(r["predicted"] == (r["doc_id"] % 8 == 0) for r in held) / len(held)
    assert right > 0.97


def test_toxicity_counts_all_documents(spark):
    """A word too rare for the sample of the fit is learnt, and the border leaves the prior's share of all rows."""
    rng = random.Random(11)
    common = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("ara", "elo", "iminu", "ot")]
    rows, labels = [], []
    for i in range(4000):
        toxic = i % 8 == 0
        text = rng.choices(common, k=rng.randint(10, 60))
        if toxic:
            text[0] = "qqq" if i % 160 == 0 else rng.choice(["vilest", "scumbag", "wretch"])
            labels.append((i, 1))
        elif i % 8 < 4:
            labels.extend([(i, 0)])
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = train_toxicity(docs, spark.createDataFrame(labels, LABELS), settings=Settings(positives=60, unlabelled=300))
    scored = {r["doc_id"]: r for r in score_toxicity(docs, model).collect()}
    rare = [scored[i]["predicted"] for i in range(0, 4000, 160)]
    assert len(rare) == 25 and all(rare)
    assert not any(r["predicted"] for i, r in scored.items() if i % 8)
    # frequencies of all open rows, not of the sample
    open_rows = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    for word in ("qqq", "vilest", "scumbag"):
        f = word_features(word, model.bits)[-1]
        held = sum(word in t.split() for t in open_rows)
        assert np.isclose(model.rarity[model.features == f], np.log((len(open_rows) + 1) / (held + 1)) + 0.1).all()
        assert f in model.features


def test_toxicity_border_is_a_quantile_of_all_rows(spark):
    rows = [(i, "cold " * (i % 3 > 0) + f"w{i % 7} " + "vile" * (i % 4 == 0)) for i in range(1000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    features = sorted(((word_features(w, 18)[-1], x) for w, x in (("cold", 0.3), ("vile", 2.0), ("w3", -1.0), ("w5", 0.7))))
    model = Model(np.array([f for f, _ in features]), np.ones(4), np.array([x for _, x in features]), 0.0, 18, 0.1)
    weights, of = model.weights.tolist(), _Featurizer(18, model.features)
    margins = np.sort(_margins([t for _, t in rows], of, weights, [1.0] * 4))
    for prior in (0.0, 0.02, 0.1, 0.25, 0.5, 1.0):
        want = margins[int(np.floor((1 - prior) * 999))]
        for parts in (1, 5):
            got = _border(docs.select("text").repartition(parts), replace(model, prior=prior))
            assert want - 1e-5 < got <= want
