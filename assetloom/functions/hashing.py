"""Seeded arithmetic hashing that any SQL engine can reproduce.

A word is made modulo the prime 2^31 - 1: a linear mix of the keys is raised to the
fifth power (a bijection, since 5 does not divide p - 1), scaled and mixed once
more. Every intermediate stays below 2^62, so ANSI mode never sees an overflow. A
draw is two such words with different multipliers, about 62 bits; keys enter with
their remainder and their quotient by the prime, so that far keys differ too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The modulus and the multipliers of the two words and of the quotients.
PRIME = 2147483647
MULTIPLIERS = ((73856093, 19349663, 83492791, 15485863), (49979687, 32452843, 67867967, 86028121))
FAR = ((15485867, 22801763, 32452867, 41161739), (53982895, 61169369, 71838043, 79190629))
STEP = 48271
# draws lie in [0, SPACE)
SPACE = PRIME * PRIME


def _fifth(x: Column) -> Column:
    square = (x * x) % PRIME
    return (((square * square) % PRIME) * x) % PRIME


def with_draws(df: DataFrame, seed: int, draws: dict[str, Sequence[Column]]) -> DataFrame:
    """Add columns of deterministic integers in [0, SPACE), one per tuple of integer keys.

    Each round of the mix is its own projection: its input is used several times
    and is computed once that way, all inside one generated stage.
    """
    prime = F.lit(PRIME).cast("long")

    def mixed(keys: Sequence[Column], word: int) -> Column:
        total = F.lit(seed % PRIME).cast("long")
        for key, a, b in zip(keys, MULTIPLIERS[word], FAR[word], strict=False):
            near = F.pmod(key.cast("long"), prime)
            far = F.pmod(F.call_function("div", key.cast("long") - near, prime), prime)
            total = total + near * F.lit(a).cast("long") + far * F.lit(b).cast("long")
        return total % PRIME

    kept = df.columns
    words = [(name, word, f"{name}_{word}") for name in draws for word in (0, 1)]
    first = df.select("*", *[mixed(draws[name], word).alias(out) for name, word, out in words])
    second = first.select(*kept, *[((_fifth(F.col(out)) * STEP + 1) % PRIME).alias(out) for _, _, out in words])
    third = second.select(*kept, *[_fifth(F.col(out)).alias(out) for _, _, out in words])
    return third.select(*kept, *[(F.col(f"{n}_0") * prime + F.col(f"{n}_1")).alias(n) for n in draws])


def as_uniform(drawn: Column) -> Column:
    """A draw as a double strictly inside (0, 1)."""
    return (drawn.cast("double") + 0.5) / float(SPACE)


def below(drawn: Column, n: Column) -> Column:
    """A draw as an integer in [0, n), scaled exactly: floor(draw * n / SPACE), for n up to 2^62.

    With draw = a P + b and n = h P + l this is a h + floor((a l + b h + floor(b l / P)) / P):
    every term stays within a long.
    """
    p, n = F.lit(PRIME).cast("long"), n.cast("long")

    def div(x: Column) -> Column:
        return F.call_function("div", x, p)

    a, b, h, low = div(drawn), drawn % p, div(n), n % p
    return a * h + div(a * low + b * h + div(b * low))


def key_bucket(key: Column) -> Column:
    """Spread arbitrary keys evenly over 4096 ordered buckets."""
    return F.substring(F.md5(key.cast("string")), 1, 3)
