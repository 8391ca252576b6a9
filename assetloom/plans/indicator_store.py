"""Indicators that grow by dates: new prices are appended from a carried state.

The state of an asset is its last rows, as many as the longest frame and the smoothing
look back on, with the exponential means they had and the number of rows before. New
rows are computed behind these: frames and lags slide over them, and an exponential mean
goes on as if its last value were the first one of the series. Work and reading grow with the
new rows and the number of assets, not with the history.

Every append writes a part of indicators and a whole state, both immutable, and then one
record that names them; readers see parts of complete appends only.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.series import Ewm, ewm
from ..names import ITEM, PRICE, TS
from ..operators.indicators import (
    DCO_ROWS,
    LONG,
    SMOOTHING,
    assembled_indicators,
    exponential_specs,
    framed_indicators,
    smooth_complete,
)
from ..session import materialize
from ..sources.sinks import path_exists

_RECORD = "number int, part string"


def tail_rows(periods: Sequence[int], smoothing: int) -> int:
    """Rows of an asset that later rows look back on."""
    return max(*periods, DCO_ROWS) + 1 + smoothing


class IndicatorStore:
    """Indicators of one kind under ``folder``. One writer at a time; any number of readers."""

    def __init__(
        self, spark: SparkSession, folder: str, periods: Sequence[int] = LONG, smoothing: int = SMOOTHING
    ):
        self.spark, self.folder, self.periods, self.smoothing = spark, folder, tuple(periods), smoothing
        self.specs = exponential_specs(self.periods)

    def _parts(self) -> list[str]:
        """Parts in the order of their appends: one row per append."""
        path = f"{self.folder}/record"
        if not path_exists(self.spark, path):
            return []
        rows = self.spark.read.schema(_RECORD).parquet(path).orderBy("number").collect()
        return [r["part"] for r in rows]

    def read(self) -> DataFrame:
        """All indicators, as ``technical_indicators`` of all prices ever appended would give them."""
        parts = self._parts()
        if not parts:
            raise ValueError(f"nothing was appended to {self.folder}")
        return self.spark.read.parquet(*[f"{self.folder}/kpis/{p}" for p in parts])

    def append(self, prices: DataFrame) -> int:
        """Add the rows of ``prices`` that lie after the last date of their asset; returns how many there were.

        Rows at or before that date are left out, so an append may be repeated. A missing
        asset or date needs nothing: series are rows, not days.
        """
        parts = self._parts()
        new = prices.select(ITEM, TS, PRICE)
        if parts:
            state = self.spark.read.parquet(f"{self.folder}/state/{parts[-1]}")
            last = state.groupBy(ITEM).agg(F.max(TS).alias("_last"))
            joined = new.join(last, ITEM, "left")
            new = joined.where(F.col("_last").isNull() | (F.col(TS) > F.col("_last"))).drop("_last")
            rows = state.unionByName(new, allowMissingColumns=True)
        else:
            rows = new.withColumns({"n": F.lit(None).cast("long")} | self._unknown())
        new = materialize(new)
        count = new.count()
        if not count and parts:
            return 0
        raw = materialize(self._raw(rows))
        fresh = smooth_complete(raw.drop("n", "_new", *self._own()), self.smoothing)
        part = uuid.uuid4().hex
        kept = fresh.join(new.select(ITEM, TS), [ITEM, TS], "left_semi")
        kept.write.parquet(f"{self.folder}/kpis/{part}")
        back = F.row_number().over(Window.partitionBy(ITEM).orderBy(F.col(TS).desc()))
        tail = raw.withColumn("_back", back).where(F.col("_back") <= tail_rows(self.periods, self.smoothing))
        exponential = [s.out for s in self.specs if s.out not in self._own()]
        tail.select(ITEM, TS, PRICE, "n", *exponential, *self._own()).write.parquet(f"{self.folder}/state/{part}")
        record = self.spark.createDataFrame([(len(parts), part)], _RECORD)
        record.coalesce(1).write.mode("append").parquet(f"{self.folder}/record")
        return count

    def _own(self) -> list[str]:
        """Exponential means that are no indicators themselves."""
        return [s.out for s in self.specs if s.out.startswith("_")]

    def _unknown(self) -> dict[str, Column]:
        return {s.out: F.lit(None).cast("double") for s in self.specs}

    def _raw(self, rows: DataFrame) -> DataFrame:
        """Indicators before smoothing, of the state's rows (n known) and the new ones behind them."""
        whole = Window.partitionBy(ITEM)
        at = F.row_number().over(whole.orderBy(TS))
        known = F.count("n").over(whole)
        numbered = (
            rows.withColumn("_at", at)
            .withColumn("_known", known)
            .withColumn("_new", F.col("n").isNull())
            .withColumn("n", F.coalesce(F.max("n").over(whole), F.lit(0)) - F.col("_known") + F.col("_at"))
        )
        framed = framed_indicators(numbered, self.periods)
        # a chain starts with the last known row, or with the first row of a new asset
        chain = framed.where(F.col("_new") | (F.col("_at") == F.col("_known")))
        starts, steps = {}, []
        for i, s in enumerate(self.specs):
            grown = 1.0 - F.pow(F.lit(1.0 - s.alpha), F.col("n"))
            # an adjusted mean times the weight it has seen follows the plain recursion
            carried = F.col(s.out) * grown if s.adjust else F.col(s.out)
            first = F.col(s.column) * s.alpha if s.adjust else F.col(s.column)
            value = F.when(~F.col("_new"), carried).when(F.col("n") == 1, first).otherwise(F.col(s.column))
            starts[f"_x{i}"] = value
            steps.append(Ewm(f"_x{i}", s.span, False, f"_y{i}"))
        walked = ewm(chain.withColumns(starts), steps)
        ends = {
            s.out: F.col(f"_y{i}") / (1.0 - F.pow(F.lit(1.0 - s.alpha), F.col("n"))) if s.adjust else F.col(f"_y{i}")
            for i, s in enumerate(self.specs)
        }
        computed = walked.withColumns(ends).select(*framed.columns)
        before = framed.where(~F.col("_new") & (F.col("_at") < F.col("_known")))
        return assembled_indicators(before.unionByName(computed), self.periods, "n", "_new", *self._own())
