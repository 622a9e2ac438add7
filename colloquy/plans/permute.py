"""Keyed permutations of ``0 .. n-1``, one value at a time.

A draw without repetition for every row of a large table needs an order of the whole domain per
row, but only a few of its places.  ``permuted`` gives place ``i`` of the order that a key stands for,
in the row, without building the order: a Feistel network over the domain, with cycle walking.

The domain is a rectangle of ``a x b`` cells, ``a * b >= n``; a round adds a hash of one coordinate to
the other, modulo its side, which is a one-to-one map of the cells.  A result that is not under ``n``
is mapped again until it is.  It meets every cell outside at most once, so ``a * b - n`` more steps are
always enough; the sides are chosen so that this is a small number (0 where ``n`` has a divisor
near its root), and near the root, so that a round moves every place.  Hashes are md5, so any SQL engine gives the same values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: With sides of a few cells, two places meet in a side often; each further round parts them.
ROUNDS = 10
#: Sides tried from the root of n downwards, an eighth of it at most: both sides stay near it.
TRIES = 1_000


def sides(n: int) -> tuple[int, int]:
    """``(a, b)`` with ``a * b >= n``: of some values of ``a`` from the root of n (rounded up) downwards the one
    that leaves the fewest cells over, the largest of equal ones."""
    root = math.isqrt(n - 1) + 1
    return min(((a, -(-n // a)) for a in range(root, root - min(TRIES, root // 8 + 1), -1)), key=lambda s: s[0] * s[1] - n)


def permuted(place: Column, n: int, key: Column, rounds: int = ROUNDS) -> Column:
    """The value at ``place`` (0 .. n-1) of the permutation of ``0 .. n-1`` that ``key`` (a string) stands for."""
    a, b = sides(n)

    def hashed(i: Column, x: Column, side: int) -> Column:
        h = F.substring(F.md5(F.concat_ws(":", key, i.cast("string"), x.cast("string"))), 1, 12)
        return F.pmod(F.conv(h, 16, 10).cast("bigint"), F.lit(side).cast("bigint"))

    def once(x: Column) -> Column:
        cell = F.struct(F.floor(x / F.lit(b)).cast("bigint").alias("l"), F.pmod(x, F.lit(b).cast("bigint")).alias("r"))
        if n >= 1 << 52:
            raise ValueError("domains of 2^52 places and more are not supported")

        def turn(acc: Column, i: Column) -> Column:
            left, right = acc["l"], acc["r"]
            return F.when(i % 2 == 1, F.struct(F.pmod(left + hashed(i, right, a), F.lit(a).cast("bigint")).alias("l"), right.alias("r"))) \
                .otherwise(F.struct(left.alias("l"), F.pmod(right + hashed(i, left, b), F.lit(b).cast("bigint")).alias("r")))

        return F.aggregate(F.array(*[F.lit(i) for i in range(1, rounds + 1)]), cell, turn, lambda acc: acc["l"] * b + acc["r"])

    walk = F.sequence(F.lit(0), F.lit(a * b - n))
    return F.aggregate(walk, place.cast("bigint"), lambda x, step: F.when((step == 0) | (x >= n), once(x)).otherwise(x))
