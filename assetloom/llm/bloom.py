"""Blocked Bloom filters: built by Spark, tested in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = 8  # 64-bit words of a block: one cache line
BITS_PER_KEY = 16
MAX_FILTER_BYTES = 32 << 20  # more keys get fewer bits each: more passes, never a miss


def build_filter(digests: DataFrame, column: str = "digest") -> np.ndarray:
    """Filter of a column of 64-bit digests, as an array (blocks, WORDS).

    Blocks are OR-ed together by Spark; the driver receives at most
    ``MAX_FILTER_BYTES``, however many keys there are.
    """
    n = digests.count()
    blocks = int(min(max(1, n * BITS_PER_KEY // (64 * WORDS) + 1), MAX_FILTER_BYTES // (8 * WORDS)))
    masks = [
        F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(bits, {6 * i}) & 63 as int)))").alias(f"w{i}")
        for i in range(WORDS)
    ]
    digest = F.col(column)
    table = (
        digests.select(F.pmod(digest, F.lit(blocks)).alias("block"), F.xxhash64(digest).alias("bits"))
        .groupBy("block")
        .agg(*masks)
        .toPandas()
    )
    words = np.zeros((blocks, WORDS), dtype=np.int64)
    words[table["block"].to_numpy(dtype=np.int64)] = table[[f"w{i}" for i in range(WORDS)]].to_numpy(np.int64)
    return words


def passes(words: np.ndarray, digest: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether digests (with their bit hashes) may be in the filter."""
    block = words[digest % len(words)]  # the sign of % is the divisor's, as pmod
    at = bits.astype(np.uint64)
    hit = np.ones(len(digest), dtype=bool)
    for i in range(WORDS):
        bit = (at >> np.uint64(6 * i)) & np.uint64(63)
        hit &= ((block[:, i].astype(np.uint64) >> bit) & np.uint64(1)).astype(bool)
    return hit


def may_hold(keys: DataFrame, column: str, digest: Column) -> Column:
    """A test for other rows: false only where ``digest`` is surely not in ``keys``."""
    words = keys.sparkSession.sparkContext.broadcast(build_filter(keys, column))

    @F.pandas_udf(T.BooleanType())
    def test(digests: pd.Series, bits: pd.Series) -> pd.Series:
        return pd.Series(passes(words.value, digests.to_numpy(np.int64), bits.to_numpy(np.int64)))

    return test(digest, F.xxhash64(digest))
