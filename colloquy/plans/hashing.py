"""Seeded, engine-independent orderings.

numpy / ``random`` shuffles cannot be reproduced on Spark.  Every seeded order
in the package is ``md5(concat_ws(':', seed, key...))``: deterministic per
seed, uniform, identical in any SQL engine with ``md5``, and computed per row
(no shuffle, no driver state).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed: int | str, *keys: Column | str) -> Column:
    parts = [F.lit(str(seed))] + [F.col(k).cast("string") if isinstance(k, str) else k.cast("string")
                                   for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def hash_fraction(seed: int | str, *keys: Column | str) -> Column:
    """A number in [0, 1) from the first 8 hex digits of the seeded md5."""
    h = seeded_key(seed, *keys)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
