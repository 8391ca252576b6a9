"""Token counts against the library: every character, special strings, long runs, odd tables."""

import random

import pytest
from pyspark.sql import functions as F

from assetloom.llm.queries import all_queries, tokenizer_path
from assetloom.llm.token_counts import SHORT, TokenCounter, count_tokens, load_vocabulary

PATH = tokenizer_path("byte_bpe_50k.json")
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(load_vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_every_character(counter, library):
    rng = random.Random(1)
    points = [chr(x) for x in range(0x110000) if not 0xD800 <= x < 0xE000]
    for low in range(0, len(points), 500):
        text = "".join(c + rng.choice(["", "a", " ", "1", "!", "  "]) for c in points[low : low + 500])
        assert counter.count(text) == library(text)


@pytest.mark.parametrize(
    "text",
    [
        "",
        " ",
        "\n\n  \n x",
        "a<|endoftext|>  b<|endoftext|><|endoftext|> x <|endoftext|",
        "'s 't I'll we'VE they'd'll",
        " " * 1000 + "x",
        "x" * (SHORT - 1),
        "x" * SHORT + " " + "ab" * SHORT,
        "abcdefghij" * 3000,
        "日本語" * 300,
        "word  and 12 " * 60_000,
    ],
)
def test_odd_texts(counter, library, text):
    assert counter.count(text) == library(text)


def test_random_runs_by_both_ways(counter, library):
    rng = random.Random(2)
    for n in (5, 40, SHORT, SHORT + 1, 400):
        for alphabet in ("ab", "ethe rin", "aeiouérst", "=-_*"):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert counter.count(text) == library(text)
            ids = [counter.v.bytes_[b] for b in text.encode()]
            assert len(counter._lowest_first(list(ids))) == counter._by_heap(list(ids))


def test_only_proven_strings_are_looked_up(counter, library):
    vocabulary = counter.v
    assert len(vocabulary.whole) > 40_000
    for text in random.Random(3).sample(sorted(vocabulary.whole), 500):
        assert counter.merged(text.encode()) == 1
        if counter.plain.findall(text) == [text]:
            assert library(text) == 1


def test_memo_may_overflow(counter, library, monkeypatch):
    monkeypatch.setattr(counter.memo, "full", len(counter.ones) + 3)
    text = " ".join(f"qz{i}vx" for i in range(50)) * 2
    assert counter.count(text) == library(text)


def test_odd_rows(spark, library):
    texts = [None, "", "plain words", "plain words", "<|endoftext|>", "y" * 2000, "long text " * 150_000]
    rows = [(i if i != 3 else 2, t, "mine", "mine", "mine") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, over_limit string, extra string")
    out = count_tokens(docs, PATH, limit=2)
    assert out.columns == ["doc_id", "text", "extra", "n_bytes", "n_tokens", "over_limit"]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out.collect())
    counts = [library(t or "") for t in texts]
    assert got == sorted(
        (r[0], len((t or "").encode()), n, n > 2) for r, t, n in zip(rows, texts, counts, strict=True)
    )
    assert count_tokens(docs.limit(0), PATH).count() == 0
    renamed = docs.select("doc_id", F.col("text").alias("n_tokens"))
    assert sorted(r["n_tokens"] for r in count_tokens(renamed, PATH, text_col="n_tokens").collect()) == sorted(counts)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        load_vocabulary(tokenizer_path("word_bpe_49k.json"))


def test_query(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = all_queries()["op12_token_counts"](spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]]
        n = library(text)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)
