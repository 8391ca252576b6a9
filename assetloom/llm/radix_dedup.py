"""Exact dedup by distributed MSD radix partitioning; equality needs no digest.

Documents are split by successive bytes of their normalised text, most significant
bytes first. A level reads the next ``width`` bytes of every document that still
shares a group with another one; the documents of a group that agree in them form a
group of the next level. A group is finished when it has one member, or when its
texts ended (its digit is shorter than the width). Later digits are wider, so a text
of n bytes takes about log(n) levels.

Counting a level is a grouped sum with map-side combination, so a group of copies of
any size meets no single task. A new group gets a number when the (small) table of
groups with several members is written. Only members of such groups go on, with the
rest of their text; single documents leave at the first level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import broadcast_if_small, id_order, text_of
from assetloom.session import materialize

FIRST_WIDTH = 64
GROWTH = 4
OUTPUTS = ("keep_id", "group_size", "kept")
WHITE_RUNS = r"[ \t-\r]+"
_ALL = 2**31 - 1


def normal_text(name: str = "text"):
    """The text without the characters x20 and x09-x0D; NULL is empty."""
    return F.regexp_replace(text_of(name), WHITE_RUNS, "")


def exact_groups(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    first_width: int = FIRST_WIDTH,
    growth: int = GROWTH,
) -> DataFrame:
    """All rows of ``docs`` with ``keep_id``, ``group_size`` and ``kept`` added.

    Rows are equal when their texts are, white space left out. Of equal rows the one
    with the most code points in its original text stays, then the one with the
    smallest id (NULL last).

    NULL and empty texts are equal to each other and to texts of white space alone.
    Rows that repeat an id are rows of their own: of rows equal in text, length and
    id, one is kept. An empty table gives an empty result. Columns that bear an
    output's name are replaced.
    """
    base = docs.drop(*[c for c in OUTPUTS if c not in (text_col, id_col)])
    names = base.columns
    # order within a group: most code points, then smallest id
    rank = F.struct((-F.char_length(text_of(text_col))).alias("chars"), id_order(id_col).alias("at"))
    whole = normal_text(text_col).cast("binary")
    level = base.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.lit(0).cast("long").alias("gid"),
        F.substring(whole, 1, first_width).alias("digit"),
        rank.alias("rank"),
    )
    alone: DataFrame | None = None
    members: DataFrame | None = None  # rows that share a group, with a number each; levels carry the number
    decided: list[DataFrame] = []
    width, done = first_width, 0
    while True:
        groups = _groups(level, width)
        small = broadcast_if_small(groups, F.octet_length("value") + 64)
        joined = level.join(small, (F.col("gid") == F.col("old")) & (F.col("digit") == F.col("value")), "left")
        done += width
        outcome = ("rank", "ended", "n", "best", F.col("new").alias("gid"))
        if members is None:
            alone = joined.where(F.col("new").isNull()).select("row")
            rest = F.regexp_replace(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")), WHITE_RUNS, "")
            members = step = materialize(
                joined.where(F.col("new").isNotNull()).select(
                    "row",
                    F.monotonically_increasing_id().alias("member"),
                    F.when(~F.col("ended"), F.substring(rest.cast("binary"), done + 1, _ALL)).alias("rest"),
                    *outcome,
                )
            )
        else:
            step = materialize(
                joined.select(
                    "member",
                    F.when(~F.col("ended"), F.substring("rest", width + 1, _ALL)).alias("rest"),
                    *outcome,
                )
            )
            # a text that differs from all others of its group leaves as a group of one
            decided.append(
                step.where(F.col("gid").isNull()).select(
                    "member", "gid", F.lit(1).cast("long").alias("n"), F.col("rank").alias("best"), "rank"
                )
            )
        decided.append(step.where(F.col("ended")).select("member", "gid", "n", "best", "rank"))
        width *= growth
        level = step.where(~F.col("ended")).select(
            "member", "gid", "rest", F.substring("rest", 1, width).alias("digit"), "rank"
        )
        if level.isEmpty():
            break
    result = [
        alone.select(
            *[F.col(f"row.`{c}`") for c in names],
            F.col(f"row.`{id_col}`").alias("keep_id"),
            F.lit(1).cast("long").alias("group_size"),
            F.lit(True).alias("kept"),
        )
    ]
    ended = reduce(
        DataFrame.unionByName, [d.withColumn("level", F.lit(i)) for i, d in enumerate(decided)]
    ).withColumn("single", F.when(F.col("gid").isNull(), F.col("member")))
    # rows equal in everything: the smallest number is kept
    kept = (
        ended.where(F.col("rank") == F.col("best"))
        .groupBy("level", "gid", "single")
        .agg(F.min("member").alias("winner"))
        .select("winner")
    )
    verdict = materialize(
        ended.join(kept, F.col("member") == F.col("winner"), "left").select(
            F.col("member").alias("number"), "n", F.col("best.at.id").alias("id"), "winner"
        )
    )
    verdict = broadcast_if_small(verdict, 40)
    result.append(
        members.join(verdict, F.col("member") == F.col("number")).select(
            *[F.col(f"row.`{c}`") for c in names],
            F.col("id").alias("keep_id"),
            verdict["n"].alias("group_size"),
            F.col("winner").isNotNull().alias("kept"),
        )
    )
    return result[0].unionByName(result[1])


def _groups(level: DataFrame, width: int) -> DataFrame:
    """The groups with several members that the next digit makes, numbered."""
    return materialize(
        level.groupBy("gid", "digit")
        .agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("best"))
        .where(F.col("n") > 1)
        .select(
            F.col("gid").alias("old"),
            F.col("digit").alias("value"),
            "n",
            "best",
            F.monotonically_increasing_id().alias("new"),
            (F.octet_length("digit") < width).alias("ended"),
        )
    )


def drop_exact_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of every group of equal texts, with the columns they came with."""
    found = exact_groups(docs, **options)
    return found.where("kept").select(*[found[f"`{c}`"] for c in docs.columns])
