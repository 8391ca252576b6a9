"""Adapters that view the retail star schema as customer trades and asset prices.

A line item is a trade: the ordering customer buys (or, for returned lines,
sells) units of an asset on the ship date. The asset's price on a date is the
volume-weighted unit price of its lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..names import BLOCK, ITEM, PRICE, RATING, SEQ, TS, UNITS, USER, VALUE
from ..session import PACKED, materialize

# Order keys per block of the trade order key; bounds the rows of one block.
ORDERS_PER_BLOCK = 65536


@dataclass(frozen=True)
class Profile:
    """What counts as an asset, and at which grain dates are taken."""

    item: tuple[str, ...]
    grain: str

    def item_column(self) -> Column:
        return F.concat_ws("/", *[F.col(c) for c in self.item])

    def date_column(self) -> Column:
        day = F.col("l_shipdate").cast("date")
        return day if self.grain == "day" else F.trunc(day, self.grain)


PROFILES = {
    "type_weekly": Profile(("p_type",), "week"),
    "brand_daily": Profile(("p_brand",), "day"),
    "brandtype_weekly": Profile(("p_brand", "p_type"), "week"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str, profile: str) -> DataFrame:
    """(col_item, col_timestamp, price), one row per asset and date."""
    view = PROFILES[profile]
    part = table(spark, sf_dir, "part").select("p_partkey", view.item_column().alias(ITEM))
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_partkey", "l_extendedprice", "l_quantity", view.date_column().alias(TS))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(ITEM, TS)
        .agg(F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")).alias(PRICE))
    )


def trades(spark: SparkSession, sf_dir: str, profile: str) -> DataFrame:
    """Interactions with units, value and an order key that is unique per line."""
    view = PROFILES[profile]
    part = table(spark, sf_dir, "part").select("p_partkey", view.item_column().alias(ITEM))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias(USER),
            ITEM,
            F.when(F.col("l_returnflag") == "R", 0.0).otherwise(1.0).alias(RATING),
            view.date_column().alias(TS),
            F.struct(
                "l_orderkey",
                "l_linenumber",
                "l_partkey",
                "l_suppkey",
                "l_shipdate",
                "l_quantity",
                "l_extendedprice",
                "l_discount",
                "l_tax",
            ).alias(SEQ),
            F.floor(F.col("l_orderkey") / ORDERS_PER_BLOCK).alias(BLOCK),
            F.col("l_quantity").alias(UNITS),
            F.col("l_extendedprice").alias(VALUE),
        )
    )


def ordered_trades(spark: SparkSession, sf_dir: str, profile: str, *flows: str) -> DataFrame:
    """The rows of ``trades`` in the same order, with a short order key and the columns ``flows`` only.

    The columns that order the lines of an order are wide. They are shuffled once, to the order, and
    leave their line's number in it; that join is written, so its shuffle leaves the disk before the next.
    """
    view = PROFILES[profile]
    part = table(spark, sf_dir, "part").select("p_partkey", view.item_column().alias(ITEM))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    of_flow = {UNITS: "l_quantity", VALUE: "l_extendedprice"}
    lines = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    placed = materialize(
        table(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias(USER),
            "l_partkey",
            F.when(F.col("l_returnflag") == "R", 0.0).otherwise(1.0).alias(RATING),
            view.date_column().alias(TS),
            F.struct("l_orderkey", F.row_number().over(lines).alias("line")).alias(SEQ),
            *[F.col(of_flow[flow]).alias(flow) for flow in flows],
        ),
        PACKED,
    )
    return (
        placed.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .withColumn(BLOCK, F.floor(F.col(SEQ)["l_orderkey"] / ORDERS_PER_BLOCK))
        .select(USER, ITEM, RATING, TS, SEQ, BLOCK, *flows)
    )


def price_quotes(spark: SparkSession, sf_dir: str, profile: str) -> DataFrame:
    """Raw quotes, one per line: repeated dates, and a zero where the line carries no discount."""
    view = PROFILES[profile]
    part = table(spark, sf_dir, "part").select("p_partkey", view.item_column().alias(ITEM))
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            ITEM,
            view.date_column().alias(TS),
            F.when((F.col("l_discount") == 0.0) & (F.col("l_quantity") == 1.0), 0.0)
            .otherwise(F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")))
            .alias(PRICE),
            F.struct(
                "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
            ).alias(SEQ),
        )
    )
