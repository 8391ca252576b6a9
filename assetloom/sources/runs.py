"""Results of a run: immutable parts, and a record of what each part holds.

Every call writes its tables under a new part name. Only when all of them are there, one
commit per (recommendation date, future date) is appended to the run's record, naming the
part. A part is never written again and no commit is ever changed: two grids that
share a date but not its horizon stand side by side, a part that was broken off is never
read, and of two calls that computed the same dates at the same time the first name counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..names import FUT, REC, SPLIT
from ..operators.splits import Split, split_value
from .sinks import path_exists

PART = "part"
KEY = (REC, FUT)


def fingerprint(df: DataFrame) -> str:
    """A table's rows as a short name: equal for equal rows in any order, repeated rows counted."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    row = F.xxhash64(*columns)
    # two independent sums; a pair of equal rows does not cancel out
    more = F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)")
    n, a, b = df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.sum(more)).first()
    return f"{n:x}-{int(a or 0) % 2**64:x}-{int(b or 0) % 2**64:x}"


class RunStore:
    """Tables of one run under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @property
    def _record(self) -> str:
        return f"{self.folder}/commits"

    def commits(self) -> DataFrame:
        """(rec_date, future_date, part): the part that counts for each pair of dates."""
        if not path_exists(self.spark, self._record):
            return self.spark.createDataFrame([], f"{REC} date, {FUT} date, {PART} string")
        record = self.spark.read.schema(f"{REC} date, {FUT} date, {PART} string").parquet(self._record)
        return record.groupBy(*KEY).agg(F.min(PART).alias(PART))

    def finished(self) -> set[tuple]:
        """The committed pairs of dates: one per split that was ever asked for."""
        return {(r[REC], r[FUT]) for r in self.commits().collect()}

    def write(self, tables: dict[str, DataFrame], splits: Sequence[Split]) -> str:
        """Write the tables (with split_id) of ``splits`` as a new part and commit it; returns the part's name."""
        part = uuid.uuid4().hex
        rec = split_value(splits, [s.rec_date for s in splits], "date")
        fut = split_value(splits, [s.future_date for s in splits], "date")
        for name, df in tables.items():
            dated = df.withColumns({REC: rec, FUT: fut})
            dated.write.partitionBy(*KEY, SPLIT).parquet(f"{self.folder}/{name}/{PART}={part}")
        rows = [(s.rec_date, s.future_date, part) for s in splits]
        record = self.spark.createDataFrame(rows, f"{REC} date, {FUT} date, {PART} string")
        record.coalesce(1).write.mode("append").parquet(self._record)
        return part

    def read(self, name: str, where: Column | None = None) -> DataFrame:
        """Committed rows of a table, with their dates and the split number they had in their call."""
        rows = self.spark.read.parquet(f"{self.folder}/{name}")
        typed = rows.withColumns({c: F.col(c).cast("date") for c in KEY}).withColumn(PART, F.col(PART).cast("string"))
        # one row per pair of dates; the join prunes folders of other parts
        counted = typed.join(F.broadcast(self.commits()), [*KEY, PART], "left_semi").drop(PART)
        return counted if where is None else counted.where(where)
