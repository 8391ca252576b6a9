"""The registered queries on the small driver tables: against SQL, or against plain loops."""

import os
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute

from assetloom.llm.queries import all_queries, tokenizer_path
from assetloom.llm.sql import all_sql
from checks.compare import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()


def result(spark, name):
    return {r["doc_id"]: r for r in all_queries()[name](spark, SF_DIR).collect()}


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_matches_sql(spark, duck, name):
    assert compare(all_queries()[name](spark, SF_DIR), duck, all_sql()[name]) is None


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in all_queries())
    assert numbers == sorted(set(numbers)) and set(range(1, 11)) <= set(numbers)
    assert set(all_sql()) <= set(all_queries())


def test_toxicity(spark, duck, docs):
    got = result(spark, "op1_toxicity")
    assert set(got) == {d for d, _ in docs}
    for doc_id, row in got.items():
        assert row["held_out"] == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
        assert 0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.5)


def test_personal_data(spark, docs):
    got = result(spark, "op6_personal_data")
    kinds = list(brute.KINDS)
    for doc_id, text in docs:
        want = brute.personal(text)
        row = got[doc_id]
        joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in want)
        assert row["base_sha256"] == brute.sha(joined)
        assert [row[f"n_{k}"] for k in kinds] == [sum(x[1] == i for x in want) for i in range(4)]
        assert set(joined.split(",")) - {""} <= set(row["spans"].split(","))


def test_near_duplicates(spark, docs):
    got = {d: (r["class_id"], r["n_links"]) for d, r in result(spark, "op8_ngram_jaccard_join").items()}
    assert got == brute.near_classes(docs)


def test_repeated_bytes(spark, docs):
    got = result(spark, "op9_suffix_dedup")
    for doc_id, n, removed, runs, kept in brute.repeated_bytes(docs, 400):
        row = got[doc_id]
        assert (row["n_bytes"], row["n_removed"], row["n_spans"]) == (n, removed, runs)
        assert row["kept_sha256"] == brute.sha(kept)


def test_sentencepiece(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    got = result(spark, "op10_sentencepiece")
    for doc_id, text in docs:
        ids = model.encode(text or "", add_bos=True, add_eos=True)
        row = got[doc_id]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == brute.sha(np.array(ids, dtype="<u4").tobytes())
        assert row["decoded_sha256"] == brute.sha(model.decode(ids))
