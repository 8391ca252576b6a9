"""One query per operator, over its whole table, with production parameters.

A query only derives the digest columns that its contract asks for from what the
operator returns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

# fixed values: the list of the URL query
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetloom.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256(F.col("kept_text")).alias("kept_sha256"))


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetloom.llm.url_filter import judge_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """A public vocabulary that a contract names."""
    import public_tokenizers

    return public_tokenizers.path(name)


@F.pandas_udf(T.StringType())
def _ids_sha256(ids: pd.Series) -> pd.Series:
    return ids.map(lambda x: hashlib.sha256(np.asarray(x, dtype="<u4").tobytes()).hexdigest())


@query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetloom.llm.sentencepiece_table import encode_texts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_texts(docs, tokenizer_path(), decoded_col="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        _ids_sha256("ids").alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
    )


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetloom.llm.contamination import find_contamination

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        sha256(F.array_join("items", ",")).alias("items_sha256"),
        "contaminated",
    )


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetloom.llm.radix_dedup import exact_groups, normal_text

    out = exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "keep_id", "group_size", "kept", sha256(normal_text("text")).alias("text_sha256")
    )


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetloom.llm.suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return out.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


@query
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetloom.llm.lsh_forest import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "class_id", "n_links")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetloom.llm.toxicity import held_out, score_toxicity, train_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    out = score_toxicity(docs, model).withColumn("held_out", held_out("doc_id"))
    return out.select("doc_id", "held_out", "score", "predicted")


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetloom.llm.pii import KINDS, find_personal_data, spans_text

    out = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long")

    return out.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        sha256(spans_text(F.col("base_spans"))).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetloom.llm.quality import score_quality, train_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_quality(docs, train_quality(docs))
    return out.select("doc_id", "score", "weak_label", "predicted", (F.col("predicted") == 1).alias("kept"))


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetloom.llm.lexical_search import build_index, search

    index = build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("item_id", "rank", F.col("doc_id").cast("long").alias("doc_id"), "score")


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetloom.llm.token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_tokens(docs, tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetloom.llm.whitening import fit_whitening, whiten

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit_whitening(vectors)
    shares = [float(v) / model.trace for v in model.values] if model else []
    return whiten(vectors, model).select(
        "vec_id",
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        F.posexplode("whitened").alias("at", "whitened"),
    ).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("at")).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
