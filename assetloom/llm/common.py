"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the white space that contracts name
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# a joined side up to this many measured bytes may be broadcast; beyond it the join shuffles
BROADCAST_BYTES = 12 << 20


# bytes of an Arrow batch that goes to a Python worker; whole texts make rows wide
ARROW_BYTES = 8 << 20


def narrow_batches(df: DataFrame) -> DataFrame:
    """Bound the Arrow batches of the session, so that a worker's memory does not depend on row width."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    df.sparkSession.conf.set(name, str(ARROW_BYTES))
    return df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the body uses it for every element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(name: str) -> Column:
    """A text column where NULL counts as the empty text."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that on ASCII and is much faster there."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def own_prefix(df: DataFrame) -> str:
    """Begins the names of an operator's own columns: no column of ``df`` begins like it."""
    prefix = "_llm"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def id_order(name: str) -> Column:
    """Orders rows by id with NULL last; two NULL ids are equal."""
    return F.struct(F.col(f"`{name}`").isNull().alias("none"), F.col(f"`{name}`").alias("id"))


def same(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> Column:
    """Join condition over column pairs in which NULL equals NULL."""
    return reduce(
        lambda a, b: a & b, (left[f"`{a}`"].eqNullSafe(right[f"`{b}`"]) for a, b in pairs.items())
    )


def broadcast_if_small(df: DataFrame, row_bytes: Column | int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the measured size of a written table is within the limit, else leave it."""
    width = row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)
    size = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df
