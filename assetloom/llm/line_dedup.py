"""Line dedup: drop lines whose normalised text occurs in several documents.

Lines are exploded, normalised and reduced to 128 bits of hash. Documents are
counted per hash (distinct ids first, so a line that a third of all documents hold
is spread over all tasks), and only the positions of dropped lines travel back to
the documents, where the text is put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import WHITE, ascii_lower, broadcast_if_small, id_order, own_prefix, same, text_of
from assetloom.session import materialize

OUTPUTS = ("kept_text", "n_lines", "n_dropped")


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def dedup_lines(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = 10, min_docs: int = 2
) -> DataFrame:
    """All rows of ``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` added.

    Lines are the pieces between ``\\n``. A key of at least ``min_chars`` code points
    found in at least ``min_docs`` documents loses all its lines except those in the
    document with the smallest id.

    NULL and empty texts have one empty line, which stays. A document is an id: rows
    that repeat an id count once and are treated alike; rows with a NULL id are one
    document that comes after all others. Every row is returned, repeated ones as
    often as they came. Columns that bear an output's name are replaced.
    """
    own = own_prefix(docs)
    digest = F.xxhash64(text_of(text_col))
    lines = (
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            digest.alias("digest"),
            F.posexplode(F.split(text_of(text_col), "\n")).alias("pos", "line"),
        )
        .select("id", "digest", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "digest", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    lines = materialize(lines)
    document = id_order("id")
    repeated = (
        lines.groupBy("h1", "h2")
        .agg(F.count_distinct(document).alias("n"), F.min(document).alias("first"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "first")
    )
    drops = materialize(
        lines.join(repeated, ["h1", "h2"])
        .where(document != F.col("first"))
        .groupBy(F.col("id").alias(f"{own}_id"), F.col("digest").alias(f"{own}_digest"))
        .agg(F.collect_set("pos").alias(f"{own}_drop"))
    )
    base = docs.drop(*[c for c in OUTPUTS if c != text_col and c != id_col]).withColumn(f"{own}_own", digest)
    small = broadcast_if_small(drops, F.size(f"{own}_drop") * 4 + 48)
    joined = base.join(
        small, same(base, small, {id_col: f"{own}_id", f"{own}_own": f"{own}_digest"}), "left"
    ).withColumn(f"{own}_lines", F.split(text_of(text_col), "\n"))
    # positions are integers, so array_except is a hash lookup: linear in the number of lines
    stays = F.array_except(
        F.sequence(F.lit(0), F.size(f"{own}_lines") - 1), F.coalesce(f"{own}_drop", F.array().cast("array<int>"))
    )
    return (
        joined.withColumn(f"{own}_stays", stays)
        .withColumn(
            "kept_text",
            F.when(F.col(f"{own}_drop").isNull(), text_of(text_col)).otherwise(
                F.array_join(
                    F.transform(f"{own}_stays", lambda i: F.element_at(F.col(f"{own}_lines"), i + 1)), "\n"
                )
            ),
        )
        .withColumn("n_lines", F.size(f"{own}_lines").cast("long"))
        .withColumn("n_dropped", (F.size(f"{own}_lines") - F.size(f"{own}_stays")).cast("long"))
        .drop(f"{own}_id", f"{own}_digest", f"{own}_own", f"{own}_drop", f"{own}_lines", f"{own}_stays")
    )
