"""CSV sources with declared schemas. Nothing is inferred, only needed columns are parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..names import BLOCK, ITEM, PRICE, RATING, SEQ, TS, UNITS, USER, VALUE


def _schema(fields: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _D, _DAY = T.StringType(), T.DoubleType(), T.DateType()

# The documented file layouts.
TRANSACTIONS = _schema(
    {
        "customerID": _S,
        "ISIN": _S,
        "transactionID": _S,
        "transactionType": _S,
        "timestamp": _DAY,
        "totalValue": _D,
        "units": _D,
        "channel": _S,
        "marketID": _S,
    }
)
CLOSE_PRICES = _schema({"ISIN": _S, "timestamp": _DAY, "closePrice": _D})
LIMIT_PRICES = _schema(
    {
        "ISIN": _S,
        "minDate": _DAY,
        "maxDate": _DAY,
        "priceMinDate": _D,
        "priceMaxDate": _D,
        "profitability": _D,
    }
)
CUSTOMERS = _schema(
    {
        "customerID": _S,
        "customerType": _S,
        "riskLevel": _S,
        "investmentCapacity": _S,
        "lastQuestionnaireDate": _DAY,
        "timestamp": _DAY,
    }
)
ASSETS = _schema(
    {
        "ISIN": _S,
        "assetName": _S,
        "assetShortName": _S,
        "assetCategory": _S,
        "assetSubCategory": _S,
        "marketID": _S,
        "sector": _S,
        "industry": _S,
        "timestamp": _DAY,
    }
)
MARKETS = _schema(
    {
        "exchangeID": _S,
        "marketID": _S,
        "name": _S,
        "description": _S,
        "country": _S,
        "tradingDays": _S,
        "tradingHours": _S,
        "marketClass": _S,
    }
)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("dateFormat", "yyyy-MM-dd")
        .csv(path)
    )


def file_order() -> tuple[Column, Column]:
    """An order key that follows file order, and a coarser key that follows it too.

    The coarse key is one input chunk, so its rows are bounded by
    ``spark.sql.files.maxPartitionBytes``.
    """
    chunk = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    line = F.monotonically_increasing_id()
    return F.struct(chunk.alias("chunk"), line.alias("line")), chunk


def buy_rating(kind: Column) -> Column:
    """1.0 for a purchase, 0.0 for anything else."""
    return F.when(kind == "Buy", 1.0).otherwise(0.0)


def read_transactions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Customer transactions with units, value and an order key."""
    seq, chunk = file_order()
    return read_csv(spark, path, TRANSACTIONS).select(
        F.col("customerID").alias(USER),
        F.col("ISIN").alias(ITEM),
        buy_rating(F.col("transactionType")).alias(RATING),
        F.col("timestamp").alias(TS),
        seq.alias(SEQ),
        chunk.alias(BLOCK),
        F.col("units").alias(UNITS),
        F.col("totalValue").alias(VALUE),
    )


def read_close_prices(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Price rows as they are in the file; columns are taken by position, the header is skipped."""
    seq, _ = file_order()
    return read_csv(spark, path, CLOSE_PRICES).select(
        F.col("ISIN").alias(ITEM), F.col("closePrice").alias(PRICE), F.col("timestamp").alias(TS), seq.alias(SEQ)
    )


def read_limit_prices(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_csv(spark, path, LIMIT_PRICES).select(
        F.col("ISIN").alias(ITEM),
        F.col("minDate").alias("min_date"),
        F.col("maxDate").alias("max_date"),
        F.col("priceMinDate").alias("price_min_date"),
        F.col("priceMaxDate").alias("price_max_date"),
        F.col("profitability").alias("roi"),
    )


def read_customers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_csv(spark, path, CUSTOMERS)


def read_assets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_csv(spark, path, ASSETS)


def read_markets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_csv(spark, path, MARKETS)
