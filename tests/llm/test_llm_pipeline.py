"""The pipeline's stages, each judged on its own input, against plain loops."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute

import corpus_pipeline
from assetloom.llm.queries import tokenizer_path
from assetloom.llm.toxicity import score_toxicity, train_toxicity
from assetloom.session import materialize

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("driver tables are not here")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, materialize(stage(spark, out[-1][1], SF_DIR))))
    return {name: (df.columns, df.collect()) for name, df in out}


def texts(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "sentencepiece"]
    for name, (columns, _) in stages.items():
        assert columns == (COLUMNS if name != "sentencepiece" else [*COLUMNS, "ids", "decoded"])


def test_toxicity_keeps_rows_as_they_are(stages):
    before, after = stages["documents"][1], stages["toxicity"][1]
    # the smallest tables confirm too few documents for any feature to stand out
    assert set(after) <= set(before) and len(before) * 0.8 < len(after)


def test_line_dedup(stages):
    before, after = stages["toxicity"][1], stages["line_dedup"][1]
    assert sorted(texts(after)) == sorted(brute.drop_lines(texts(before)))
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_ngram_jaccard(stages):
    before, after = stages["line_dedup"][1], stages["ngram_jaccard"][1]
    classes = brute.near_classes(texts(before))
    assert sorted(r["doc_id"] for r in after) == sorted(d for d, (c, _) in classes.items() if c == d)


def test_decontamination(spark, stages):
    before, after = stages["ngram_jaccard"][1], stages["decontamination"][1]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    hit = brute.contaminated(texts(before), items)
    assert sorted(r["doc_id"] for r in after) == sorted(d for d, (_, n, _) in hit.items() if not n)


def test_sentencepiece(stages):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    before, after = stages["decontamination"][1], stages["sentencepiece"][1]
    assert sorted(texts(before)) == sorted(texts(after))
    for r in after:
        assert r["ids"] == model.encode(r["text"], add_bos=True, add_eos=True)
        assert r["decoded"] == model.decode(r["ids"])


def test_run_returns_the_last_stage(spark, stages):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(texts(rows)) == sorted(texts(stages["sentencepiece"][1]))


def test_stages_take_nulls_repeats_further_columns_and_no_rows(spark, tmp_path):
    """NULL and empty texts stay; of rows that repeat id and text with links one stays."""
    long = " ".join(f"unique{i}" for i in range(200))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", 1), (3, long, "en", "s", 1), (None, None, None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    folder = str(tmp_path)
    spark.createDataFrame([(1, 0, None), (2, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame([(*r, "mine", 1.5) for r in rows], f"{schema}, ids_ string, score double")
    for table, left in ((docs, [(1, ""), (2, ""), (3, long), (None, "")]), (docs.limit(0), [])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = materialize(stage(spark, table, folder))
            assert table.columns == docs.columns
        last = corpus_pipeline.STAGES[-1][1](spark, table, folder).collect()
        assert sorted(texts(last), key=str) == sorted(left, key=str)


def test_toxicity_rejects_planted_documents(spark, tmp_path):
    """Planted toxic documents leave, clean ones stay, and what stays is what the operator does not predict."""
    rng = random.Random(5)
    common = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("ara", "elo", "iminu", "ot")]
    rows, labels = [], []
    for i in range(2000):
        text = rng.choices(common, k=rng.randint(10, 60))
        if i % 8 == 0:
            text[rng.randrange(len(text))] = rng.choice(["vilest", "scumbag", "wretch", "vermin"])
        rows.append((i, " ".join(text), "en", "s", 1))
        if i % 16 < 8 or rng.random() < 0.5:
            labels.append((i, 0, int(i % 8 == 0)))
    folder = str(tmp_path)
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.toxicity(spark, docs, folder)
    assert kept.columns == COLUMNS
    kept = sorted(tuple(r) for r in kept.collect())
    model = train_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = score_toxicity(docs, model).where("predicted = 0").select(*COLUMNS).collect()
    assert kept == sorted(tuple(r) for r in scored)
    toxic = sum(r[0] % 8 == 0 for r in kept)
    clean = len(kept) - toxic
    assert toxic <= 0.03 * 250 and clean >= 0.97 * 1750
