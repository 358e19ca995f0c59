"""A seeded permutation of the numbers 0 to n - 1, computed for each number on its own."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from toolcorpus.functions.rand import stable_hash

ROUNDS = 3
# Steps of a cycle that are walked. Numbers beyond n are fewer than the square root of n, so up to 1,000
# numbers every cycle ends within them; above that, one that does not is rarer than 1e-45.
STEPS = 33


def sides(n: int) -> tuple[int, int]:
    """Two sides whose product is ``n`` or little more."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-n // a)


def permuted(i: Column, n: int, seed: int = 42) -> Column:
    """The place of ``i`` in a permutation of ``0 .. n - 1`` that ``seed`` chooses.

    A Feistel network on ``i = right * a + left``: a round adds a hash of one
    half to the other, modulo its side, which can be undone and so is one to
    one on the whole rectangle. A number that lands beyond ``n`` goes round
    again until it lands inside.
    """
    a, b = sides(n)
    if n < 1:
        return i

    def once(x: Column) -> Column:
        half = F.struct((x % a).alias("left"), F.floor(x / a).cast("bigint").alias("right"))

        def step(acc, r):
            left = (acc["left"] + stable_hash(seed, "permute", r, "right", acc["right"])) % a
            return F.struct(left.alias("left"), ((acc["right"] + stable_hash(seed, "permute", r, "left", left)) % b).alias("right"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), half, step, lambda h: h["right"] * F.lit(a).cast("bigint") + h["left"])

    return F.aggregate(F.sequence(F.lit(2), F.lit(STEPS)), once(i.cast("bigint")), lambda acc, _: F.when(acc < n, acc).otherwise(once(acc)))
