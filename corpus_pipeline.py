"""The corpus pipeline: stages applied to the documents one after another.

Every stage takes all rows that the stage before it kept and returns the columns of
``documents``; the last one adds the ids of the text and the text decoded from them.
NULL and empty texts pass every stage (they have no toxic word, no line to drop, no
link and no benchmark passage); an empty table stays empty; further columns of the
input are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.llm.contamination import decontaminate
from assetloom.llm.line_dedup import dedup_lines
from assetloom.llm.lsh_forest import near_duplicates
from assetloom.llm.queries import tokenizer_path
from assetloom.llm.sentencepiece_table import encode_texts
from assetloom.llm.toxicity import score_toxicity, train_toxicity
from assetloom.session import materialize

# no SQL expresses the toxicity classifier or the encoding
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = docs.columns
    return score_toxicity(docs, model).where(F.col("predicted") == 0).select(*[F.col(f"`{c}`") for c in names])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document with a smaller id holds; ``n_chars`` follows the text."""
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return dedup_lines(docs).select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Rows that repeat both the id and the text of a kept one are dropped with the group.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    found = near_duplicates(docs)
    alone = found.where(F.col("n_links") == 0)
    first = found.where((F.col("n_links") > 0) & F.col("doc_id").eqNullSafe(F.col("class_id")))
    return alone.select(*names).unionByName(first.select(*names).dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``ids`` and the text ``decoded`` from them."""
    return encode_texts(docs, tokenizer_path(), decoded_col="decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
