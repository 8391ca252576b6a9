"""Dense numbering and prefix sums without a global sort.

Keys are spread over 4096 hash buckets. One small aggregate (4096 rows at most,
whatever the table size) gives every bucket its offset; the rest happens inside
buckets, in parallel. The resulting order is (bucket, key): stable and
independent of partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .hashing import key_bucket


def _bucket_offsets(df: DataFrame, groups: list[str], amount: str) -> DataFrame:
    totals = df.groupBy(*groups, "_bucket").agg(F.sum(amount).alias("_total"))
    before = (
        Window.partitionBy(*groups).orderBy("_bucket")
        if groups
        else Window.partitionBy(F.lit(0)).orderBy("_bucket")
    ).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *groups, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")
    )


def dense_index(keys: DataFrame, key: str, out: str) -> DataFrame:
    """Number the distinct values of ``key`` 0..n-1. The distinct keys are written once and read twice."""
    distinct = materialize(
        keys.select(key).distinct().select(key, key_bucket(F.col(key)).alias("_bucket"))
    ).withColumn("_one", F.lit(1))
    offsets = _bucket_offsets(distinct, [], "_one")
    inside = Window.partitionBy("_bucket").orderBy(key)
    return distinct.join(F.broadcast(offsets), "_bucket").select(
        key, (F.row_number().over(inside) - 1 + F.col("_offset")).cast("long").alias(out)
    )


def prefix_sum(df: DataFrame, key: str, amount: str, out: str) -> DataFrame:
    """Add the sum of ``amount`` over all rows before this one in (bucket, key) order."""
    spread = df.withColumn("_bucket", key_bucket(F.col(key)))
    offsets = _bucket_offsets(spread, [], amount)
    inside = Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        spread.join(F.broadcast(offsets), "_bucket")
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .drop("_bucket", "_offset")
    )


# levels of the threshold search, each of 4096 ranges
LEVELS = 3


def smallest(
    df: DataFrame, draw_col: str, bound: int, n_keep: Callable[[Column], Column], tie: list[str]
) -> DataFrame:
    """Keep exactly ``n_keep(total rows)`` rows: those with the smallest draws in [0, bound).

    The threshold is searched digit by digit: rows are counted in 4096 ranges of the
    draw, then in 4096 parts of the range that holds the threshold, and so on. After
    the last level that range holds one row in 2^36, and only these are ranked. Each
    level is one count, of which the driver receives one row. The rows are written with
    their draws first: every level filters by them, and a filter on a computed draw is
    pushed below it and evaluates it once per use.
    """
    width = bound // 4096**LEVELS + 1
    coded = materialize(df.withColumn("_code", F.call_function("div", F.col(draw_col), F.lit(width).cast("long"))))
    prefix = room = None
    for level in range(LEVELS):
        step = 4096 ** (LEVELS - 1 - level)
        digits = coded.withColumn("_digit", F.floor(F.col("_code") / step))
        if prefix is not None:
            digits = digits.where(F.floor(F.col("_digit") / 4096) == prefix)
        counts = digits.groupBy("_digit").agg(F.count(F.lit(1)).alias("_n"))
        everything = Window.partitionBy(F.lit(0))
        upto = F.sum("_n").over(everything.orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0))
        wanted = n_keep(F.sum("_n").over(everything)) if prefix is None else F.lit(room)
        placed = counts.select("_digit", (upto - F.col("_n")).alias("_before"), upto.alias("_upto"), wanted.alias("_k"))
        edge = placed.where((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_upto"))).first()
        if edge is None:
            return df.limit(0)
        prefix, room = int(edge["_digit"]), int(edge["_k"] - edge["_before"])
    rank = F.row_number().over(Window.partitionBy("_code").orderBy(draw_col, *tie))
    last = coded.where(F.col("_code") == prefix).withColumn("_pos", rank).where(F.col("_pos") <= room).drop("_pos")
    return coded.where(F.col("_code") < prefix).unionByName(last).drop("_code")


def range_parts(df: DataFrame, by: list[Column], out: str) -> DataFrame:
    """Rows dealt out by ranges of ``by``, with the number of their range: lower ranges have lower numbers.

    Written, because the ranges are sampled and must not change when rows are read again.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *by).withColumn(out, F.spark_partition_id()))


def rank_in_groups(df: DataFrame, groups: list[str], by: list[Column], out: str, total: str) -> DataFrame:
    """Number the rows of each group 1..n in the order of ``by`` and add the size of the group.

    Rows are sorted inside ranges, which may split a group, and a small table of counts per
    group and range gives the offsets: no task sorts a whole group.
    """
    parts = range_parts(df, [F.col(g) for g in groups] + by, "_part")
    counts = parts.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *groups,
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(whole).alias(total),
    )
    inside = Window.partitionBy(*groups, "_part").orderBy(*by)
    return (
        parts.withColumn("_nth", F.row_number().over(inside))
        # a group has one row of offsets per range
        .join(offsets, [*groups, "_part"])
        .withColumn(out, (F.col("_offset") + F.col("_nth")).cast("int"))
        .drop("_part", "_nth", "_offset")
    )


def running_sums(df: DataFrame, groups: list[str], rank: str, amounts: dict[str, Column], block: int = 1 << 16) -> DataFrame:
    """Add running sums, in the order of a dense rank, of ``amounts`` (name: amount; NULL counts as 0).

    Sums run inside blocks of ranks; one row per block carries the sum of those before.
    """
    placed = df.withColumn("_block", F.floor((F.col(rank) - 1) / block))
    zero = {n: F.coalesce(a, F.lit(0)) for n, a in amounts.items()}
    totals = placed.groupBy(*groups, "_block").agg(*[F.sum(a).alias(f"_t_{n}") for n, a in zero.items()])
    before = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups, "_block", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_t_{n}") for n in amounts]
    )
    inside = Window.partitionBy(*groups, "_block").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("*", *[F.sum(a).over(inside).alias(f"_s_{n}") for n, a in zero.items()])
    joined = summed.join(offsets, [*groups, "_block"])
    return joined.select(*df.columns, *[(F.col(f"_s_{n}") + F.col(f"_t_{n}")).alias(n) for n in amounts])
