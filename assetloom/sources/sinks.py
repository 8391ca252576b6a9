"""Sinks. Every writer is a plain distributed write; readers of the output prune by partition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..names import CUTOFF, FUT, ITEM, REC, SCORE, SPLIT, TS, USER


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished output is there (works for any file system Spark can reach)."""
    try:
        spark.read.text(f"{path}/_SUCCESS").schema
    except AnalysisException:
        return False
    return True


def compute_if_absent(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Reuse a table written earlier, else build and write it."""
    if not path_exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_kpis(kpis: DataFrame, path: str, buckets: int = 64) -> None:
    """Indicators partitioned by asset bucket and sorted, so one asset is one contiguous run."""
    (
        kpis.withColumn("item_bucket", F.pmod(F.xxhash64(ITEM), F.lit(buckets)).cast("int"))
        .repartition("item_bucket", ITEM)
        .sortWithinPartitions("item_bucket", ITEM, TS)
        .write.mode("overwrite")
        .partitionBy("item_bucket")
        .parquet(path)
    )


def read_kpis(spark: SparkSession, path: str) -> DataFrame:
    kpis = spark.read.parquet(path)
    return kpis.drop("item_bucket").withColumn(TS, F.col(TS).cast("date"))


def write_recommendations(recs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Lists partitioned by split, users descending, best score first."""
    (
        # one file and more per split: rows meet their split, large splits are cut by AQE
        recs.hint("rebalance", SPLIT)
        .sortWithinPartitions(SPLIT, F.col(USER).desc(), F.col(SCORE).desc(), ITEM)
        .write.mode(mode)
        .partitionBy(SPLIT)
        .parquet(path)
    )


def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tab-separated ``metric@k`` and value, one folder per split, under its dates where the table has them."""
    folders = [c for c in (REC, FUT, SPLIT) if c in metrics.columns]
    (
        metrics.select(
            *folders,
            F.concat(F.col("metric"), F.lit("@"), F.col(CUTOFF).cast("string")).alias("metric"),
            F.col("value").cast("string").alias("value"),
        )
        .write.mode(mode)
        .partitionBy(*folders)
        .option("sep", "\t")
        .csv(path)
    )


def write_by_date(df: DataFrame, path: str) -> None:
    """Per-date statistics, one folder per recommendation date."""
    df.write.mode("overwrite").partitionBy(REC).option("header", True).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Summary with one row per recommendation date."""
    df.orderBy(REC).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)
