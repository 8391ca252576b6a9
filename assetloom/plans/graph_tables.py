"""Graph tables kept by what they are made of.

A table's place is named by its kind, its options and the contents of its inputs, so a
changed edge, node or option is another table, and equal inputs in any order and
partitioning find the one that is there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import graph as G
from ..sources.runs import fingerprint
from ..sources.sinks import compute_if_absent

Builder = Callable[..., DataFrame]

# kinds of tables over (edges, users)
BUILDERS: dict[str, Builder] = {
    "adjacency": G.adjacency,
    "mean": G.row_normalized,
    "mean_with_loops": G.row_normalized_with_loops,
    "symmetric": G.symmetric_normalized,
    "constraints": lambda edges, users: G.degree_constraints(edges),
    "user_vectors": lambda edges, users: G.user_vectors(edges),
}


def graph_table(
    edges: DataFrame,
    users: DataFrame,
    folder: str,
    kind: str,
    drop_edges: float = 0.0,
    drop_seed: int = 0,
) -> DataFrame:
    """The graph table ``kind``, built once under ``folder`` and read from there afterwards.

    ``drop_edges`` drops that share of the edges first, chosen by ``drop_seed``.
    """
    if kind not in BUILDERS:
        raise ValueError(f"no graph table {kind!r}; there are {sorted(BUILDERS)}")
    options = (kind, drop_edges, drop_seed if drop_edges else 0)
    name = hashlib.sha256(repr((options, fingerprint(edges), fingerprint(users))).encode()).hexdigest()[:24]

    def build() -> DataFrame:
        kept = G.drop_edges(edges, drop_edges, drop_seed) if drop_edges else edges
        return BUILDERS[kind](kept, users)

    return compute_if_absent(edges.sparkSession, f"{folder}/{kind}_{name}", build)
