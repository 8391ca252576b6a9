"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of ``links`` (a, b), the label being the component's smallest node.

    Every round a node takes the smallest label around it and then the label of that
    label, so long chains shrink fast. Rounds are written tables; grouping combines
    before the shuffle, so a node with very many links is no burden.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")))
    labels = labels.select("node", F.least("node", "near").alias("label"))
    while True:
        around = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        step = materialize(
            labels.join(around, "node").select(
                "node", F.col("label").alias("was"), F.least("label", "near").alias("label")
            )
        )
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = materialize(
            step.join(jump, "label", "left").select("node", "was", F.least("label", "further").alias("label"))
        )
        labels = new.select("node", "label")
        if new.where(F.col("was") != F.col("label")).isEmpty():
            return labels
