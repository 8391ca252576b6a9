"""Interaction graph: edge lists of the bipartite customer-asset graph.

Input rows carry dense numbers (``user_idx``, ``item_idx``). In node space
customers keep their number and assets follow after all customers. Matrices are
edge tables (src, dst, weight); a symmetric matrix lists both directions, built
from one joined row per pair.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import SPACE, as_uniform, with_draws
from ..functions.numbering import smallest
from ..names import RATING

U, I = "user_idx", "item_idx"


def unique_pairs(edges: DataFrame) -> DataFrame:
    return edges.select(U, I).distinct()


def _first_item(users: DataFrame) -> Column:
    return users.agg(F.count(F.lit(1))).scalar()


def _both_ways(pairs: DataFrame, users: DataFrame, there: Column, back: Column) -> DataFrame:
    item = (F.col(I) + _first_item(users)).cast("long")
    user = F.col(U).cast("long")
    return pairs.select(
        F.inline(
            F.array(
                F.struct(user.alias("src"), item.alias("dst"), there.cast("double").alias("weight")),
                F.struct(item.alias("src"), user.alias("dst"), back.cast("double").alias("weight")),
            )
        )
    )


def _with_degrees(pairs: DataFrame, amount: Column) -> DataFrame:
    """Attach the weighted degree of both ends. Degrees combine before the shuffle; skewed joins are left to AQE."""
    users = pairs.groupBy(U).agg(F.sum(amount).cast("double").alias("du"))
    items = pairs.groupBy(I).agg(F.sum(amount).cast("double").alias("di"))
    return pairs.join(users, U).join(items, I)


def adjacency(edges: DataFrame, users: DataFrame) -> DataFrame:
    """Binary adjacency."""
    return _both_ways(unique_pairs(edges), users, F.lit(1.0), F.lit(1.0))


def row_normalized(edges: DataFrame, users: DataFrame) -> DataFrame:
    """Adjacency with every row divided by its degree."""
    pairs = _with_degrees(unique_pairs(edges), F.lit(1))
    return _both_ways(pairs, users, 1.0 / F.col("du"), 1.0 / F.col("di"))


def row_normalized_with_loops(edges: DataFrame, users: DataFrame) -> DataFrame:
    """Adjacency plus the identity, every row divided by its sum."""
    unique = unique_pairs(edges)
    pairs = _with_degrees(unique, F.lit(1))
    between = _both_ways(pairs, users, 1.0 / (F.col("du") + 1.0), 1.0 / (F.col("di") + 1.0))

    def loops(node: Column) -> DataFrame:
        own = unique.groupBy(node.cast("long").alias("src")).agg(
            (1.0 / (F.count(F.lit(1)) + 1.0)).alias("weight")
        )
        return own.select("src", F.col("src").alias("dst"), "weight")

    return between.unionByName(loops(F.col(U))).unionByName(loops(F.col(I) + _first_item(users)))


def degree_constraints(edges: DataFrame) -> DataFrame:
    """(side, idx, beta): sqrt(d+1)/d for customers, 1/sqrt(d+1) for assets."""
    pairs = unique_pairs(edges)
    d = F.count(F.lit(1))
    users = pairs.groupBy(F.col(U).alias("idx")).agg((F.sqrt(d + 1.0) / d).alias("beta"))
    items = pairs.groupBy(F.col(I).alias("idx")).agg((1.0 / F.sqrt(d + 1.0)).alias("beta"))
    return users.select(F.lit("user").alias("side"), "idx", "beta").unionByName(
        items.select(F.lit("item").alias("side"), "idx", "beta")
    )


def symmetric_normalized(edges: DataFrame, users: DataFrame) -> DataFrame:
    """D^-1/2 A D^-1/2, where repeated pairs add up."""
    counted = edges.groupBy(U, I).agg(F.count(F.lit(1)).alias("c"))
    pairs = _with_degrees(counted, F.col("c"))
    weight = F.col("c") / (F.sqrt("du") * F.sqrt("di"))
    return _both_ways(pairs, users, weight, weight)


def _keep_nodes(nodes: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    drawn = with_draws(nodes.select(key), seed, {"_draw": [F.col(key)]})
    return smallest(drawn, "_draw", SPACE, lambda n: n - F.floor(n * F.lit(ratio)), [key]).select(key)


def drop_nodes(
    edges: DataFrame, users: DataFrame, items: DataFrame, ratio: float, seed: int
) -> DataFrame:
    """Edges left after dropping exactly ``floor(ratio * n)`` customers and assets each."""
    return edges.join(_keep_nodes(users, U, ratio, seed), U, "left_semi").join(
        _keep_nodes(items, I, ratio, seed + 1), I, "left_semi"
    )


def drop_edges(edges: DataFrame, ratio: float, seed: int, row_key: tuple[str, ...] = (U, I)) -> DataFrame:
    """Exactly ``floor((1 - ratio) * rows)`` rows, chosen by a seeded draw on ``row_key``."""
    drawn = with_draws(edges, seed, {"_draw": [F.col(c) for c in row_key]})
    return smallest(
        drawn, "_draw", SPACE, lambda n: F.floor(n * F.lit(1.0 - ratio)), list(row_key)
    ).drop("_draw")


def user_vectors(edges: DataFrame) -> DataFrame:
    """Sparse customer x asset matrix as entries (user_idx, item_idx, value); repeated pairs add up."""
    return edges.groupBy(U, I).agg(F.sum(RATING).alias("value"))


def user_vector_chunks(edges: DataFrame, chunk: int = 4096) -> DataFrame:
    """The same matrix as sorted arrays, one per customer and range of ``chunk`` asset numbers.

    An array never holds more than ``chunk`` entries.
    """
    entries = user_vectors(edges).withColumn("chunk", F.floor(F.col(I) / chunk))
    return (
        entries.groupBy(U, "chunk")
        .agg(F.sort_array(F.collect_list(F.struct(I, "value"))).alias("_e"))
        .select(U, "chunk", F.col(f"_e.{I}").alias("items"), F.col("_e.value").alias("values"))
    )


def random_features(nodes: DataFrame, key: str, dim: int, seed: int) -> DataFrame:
    """A seeded standard normal vector per node."""

    drawn = with_draws(nodes.select(key), seed, {f"_a{j}": [F.col(key), F.lit(j)] for j in range(dim)})
    drawn = with_draws(drawn, seed + 1, {f"_b{j}": [F.col(key), F.lit(j)] for j in range(dim)})

    def normal(j: int) -> Column:
        radius = F.sqrt(-2.0 * F.ln(as_uniform(F.col(f"_a{j}"))))
        return radius * F.cos(2.0 * math.pi * as_uniform(F.col(f"_b{j}")))

    return drawn.select(key, F.array(*[normal(j) for j in range(dim)]).alias("features"))
