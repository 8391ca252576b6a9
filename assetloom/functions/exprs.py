"""Column expressions used across operators. Missing is always NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def growth(now: Column, before: Column) -> Column:
    """Relative change; NULL when ``before`` is zero or either side is missing."""
    return F.try_divide(now - before, before)


def over_days(value: Column, target_days: int, days: Column) -> Column:
    """Compound a return observed over ``days`` to a period of ``target_days``."""
    return F.pow(1.0 + value, F.try_divide(F.lit(float(target_days)), days)) - 1.0
