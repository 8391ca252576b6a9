"""URL filter: a blocked Bloom filter of listed URLs in front of an exact join.

A list entry is a host and a path prefix. A URL can only be hit by keys made of
one of its host's label suffixes and one of its path's prefixes whose length
occurs in the list. All these keys are tested against a blocked Bloom filter (one
512-bit block per key, so one cache line per test); the few that pass are joined
with the list on the full key, which removes false positives.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.llm.bloom import build_filter, passes
from assetloom.llm.common import LOWER, UPPER

OUTPUTS = ("host", "path", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(
    pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """All rows of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` added.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block). A rule fits
    its host and all subdomains when the path starts with the rule's path. The
    longest rule (host plus path) wins, then the one with the longer host; the same
    rule listed with both verdicts blocks. URLs without a rule get ``default``.

    NULL URLs and URLs without ``://`` have an empty host and path and no rule.
    Repeated rows are judged alike and all kept; an empty list judges everything by
    default. Columns of ``pages`` that bear an output's name are replaced.
    """
    spark = pages.sparkSession
    listed = (
        rules.where(F.col("host").isNotNull() & (F.col("host") != ""))
        .select(
            F.translate("host", UPPER, LOWER).alias("host"),
            F.coalesce("path", F.lit("")).alias("path"),
            F.col("verdict"),
        )
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("_llm_verdict"))
        .select(F.concat("host", "path").alias("key"), "host", "path", "_llm_verdict")
    )
    shape = listed.agg(
        F.max(F.size(F.split("host", r"\."))).alias("labels"),
        F.sort_array(F.collect_set(F.length("path"))).alias("lengths"),
    ).first()
    words = spark.sparkContext.broadcast(build_filter(listed.select(F.xxhash64("key").alias("digest"))))

    @F.pandas_udf("array<int>")
    def possible(digests: pd.Series, bits: pd.Series) -> pd.Series:
        sizes = digests.map(len).to_numpy()
        total = int(sizes.sum())
        flat = np.concatenate(digests.to_list()).astype(np.int64) if total else np.zeros(0, np.int64)
        more = np.concatenate(bits.to_list()).astype(np.int64) if total else flat
        hit = passes(words.value, flat, more)
        ends = np.cumsum(sizes)
        return pd.Series(
            [np.flatnonzero(hit[e - s : e]).astype(np.int32) for s, e in zip(sizes, ends, strict=True)]
        )

    lengths = F.array(*[F.lit(x) for x in shape["lengths"] or []]).cast("array<int>")
    host, path = host_and_path(F.col("_llm_url"))
    labels = F.split("_llm_host", r"\.")
    last = F.slice(
        labels, F.greatest(F.size(labels) - F.lit((shape["labels"] or 1) - 1), F.lit(1)), F.size(labels)
    )
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size("_llm_last")),
        lambda i: F.array_join(F.slice(F.col("_llm_last"), i, F.size("_llm_last")), "."),
    )
    keys = F.flatten(
        F.transform(
            F.col("_llm_suffixes"),
            lambda h: F.transform(
                F.filter(lengths, lambda n: n <= F.length("_llm_path")),
                lambda n: F.concat(h, F.substring(F.col("_llm_path"), F.lit(1), n)),
            ),
        )
    )
    # a URL is judged once, however many rows hold it
    urls = (
        pages.select(F.col(f"`{url_col}`").alias("_llm_url"))
        .where(F.col("_llm_url").contains("://"))
        .distinct()
        .select("_llm_url", host.alias("_llm_host"), path.alias("_llm_path"))
        .where(F.col("_llm_host") != "")
        .withColumn("_llm_last", last)
        .withColumn("_llm_suffixes", suffixes)
        .withColumn("_llm_keys", keys)
        .withColumn("_llm_digests", F.transform("_llm_keys", lambda k: F.xxhash64(k)))
        .withColumn("_llm_bits", F.transform("_llm_digests", lambda d: F.xxhash64(d)))
    )
    hits = urls.withColumn("_llm_at", possible("_llm_digests", "_llm_bits")).select(
        "_llm_url",
        F.explode(F.transform("_llm_at", lambda i: F.element_at("_llm_keys", i + 1))).alias("_llm_key"),
    )
    best = (
        hits.join(listed, F.col("_llm_key") == listed["key"])
        .groupBy("_llm_url")
        .agg(
            F.max(F.struct(F.length("key"), F.length("host"), "key", "_llm_verdict")).alias("_llm_best")
        )
        .select("_llm_url", "_llm_best.key", "_llm_best._llm_verdict")
        .withColumnRenamed("key", "_llm_rule")
    )
    kept = pages.withColumn("_llm_page_url", F.col(f"`{url_col}`"))
    host, path = host_and_path(F.col("_llm_page_url"))
    return (
        kept.join(best, F.col("_llm_page_url") == F.col("_llm_url"), "left")
        .withColumn("host", host)
        .withColumn("path", path)
        .withColumn("rule", F.col("_llm_rule"))
        .withColumn("verdict", F.coalesce("_llm_verdict", F.lit(default)))
        .drop("_llm_url", "_llm_page_url", "_llm_rule", "_llm_verdict")
    )


def allowed_pages(pages: DataFrame, rules: DataFrame, **options) -> DataFrame:
    """The rows that are not blocked."""
    return judge_urls(pages, rules, **options).where(F.col("verdict") == "allow")
