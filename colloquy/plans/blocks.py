"""Bounded and running windows that stay parallel inside a hot group.

``with_halo``: for windows whose frame reaches at most ``halo`` rows back over
a dense integer order (turn index, position), rows are assigned to blocks of
``block_size`` order values and the last ``halo`` rows of every block are
copied into the next block.  A window partitioned by ``keys + block`` then sees
every row it needs, no task holds more than ``block_size + halo`` rows of one
group, and the copies are dropped after the window (``__own``).  Cost: one
shuffle and ``halo / block_size`` duplicated rows.

``running_agg``: ``sum`` / ``max`` / ``min`` over ``unbounded preceding ..
current row`` (or ``.. 1 preceding``) computed in two levels: block totals, a
prefix over blocks (``#rows / block_size`` per group), and a bounded window
inside each block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "__blk"
OWN = "__own"
DEFAULT_BLOCK = 4096


def with_halo(df: DataFrame, order_col: str, halo: int,
              block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """Add ``__blk`` and ``__own``; rows near a block end also go to the next block."""
    if halo >= block_size:
        raise ValueError("halo must be smaller than block_size")
    blk = F.floor(F.col(order_col) / F.lit(block_size)).cast("bigint")
    offset = F.col(order_col) - blk * F.lit(block_size)
    targets = F.when(offset >= block_size - halo, F.array(blk, blk + 1)).otherwise(F.array(blk))
    return (df.withColumn("__home", blk)
            .withColumn(BLOCK, F.explode(targets))
            .withColumn(OWN, F.col(BLOCK) == F.col("__home"))
            .drop("__home"))


def halo_window(keys: Sequence[str], order: Sequence[Column | str]) -> Window:
    return Window.partitionBy(*keys, BLOCK).orderBy(*order)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(F.col(OWN)).drop(BLOCK, OWN)


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def running_aggs(df: DataFrame, keys: Sequence[str], block_of: Column, order: Sequence[Column | str],
                 specs: Sequence[tuple[Column | str, str, str, bool]]) -> DataFrame:
    """Several running aggregates in one pass.  ``specs`` holds
    ``(value, out, how, exclusive)`` with ``how`` in sum / max / min: ``how(value)``
    over rows before (and, unless ``exclusive``, including) each row.

    ``block_of`` maps a row to an integer block that is monotone in ``order``
    (e.g. ``floor(pos / 4096)``).  Level 1: totals per ``(keys, block)``.
    Level 2: prefix of those totals over earlier blocks (``#rows / block`` rows
    per group).  Level 3: prefix inside the block, plus the carried value.  No
    group is windowed as a whole.
    """
    data = df.withColumn(BLOCK, block_of)
    for i, (value, _, _, _) in enumerate(specs):
        data = data.withColumn(f"__v{i}", F.col(value) if isinstance(value, str) else value)
    totals = data.groupBy(*keys, BLOCK).agg(*[_AGG[how](f"__v{i}").alias(f"__bt{i}")
                                             for i, (_, _, how, _) in enumerate(specs)])
    wb = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, BLOCK, *[_AGG[how](f"__bt{i}").over(wb).alias(f"__carry{i}")
                                          for i, (_, _, how, _) in enumerate(specs)])
    inner_cols = []
    for i, (_, _, how, exclusive) in enumerate(specs):
        wi = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding,
                                                                         -1 if exclusive else 0)
        inner_cols.append(_AGG[how](f"__v{i}").over(wi).alias(f"__in{i}"))
    carry = carry.select(*[F.col(k).alias("__c_" + k) for k in keys], F.col(BLOCK).alias("__c_blk"),
                         *[f"__carry{i}" for i in range(len(specs))])
    cond = [F.col(BLOCK) == F.col("__c_blk")] + [F.col(k).eqNullSafe(F.col("__c_" + k)) for k in keys]
    joined = data.select("*", *inner_cols).join(carry, cond, "left") \
        .drop("__c_blk", *["__c_" + k for k in keys])
    for i, (_, out, how, exclusive) in enumerate(specs):
        c, n = F.col(f"__carry{i}"), F.col(f"__in{i}")
        if how == "sum":
            combined = F.coalesce(c, F.lit(0)) + F.coalesce(n, F.lit(0))
            if exclusive:
                combined = F.when(c.isNull() & n.isNull(), None).otherwise(combined)
        elif how == "max":
            combined = F.greatest(c, n)
        else:
            combined = F.least(c, n)
        joined = joined.withColumn(out, combined)
    drop = [BLOCK] + [f"__{x}{i}" for i in range(len(specs)) for x in ("v", "carry", "in")]
    return joined.drop(*drop)


def running_agg(df: DataFrame, keys: Sequence[str], block_of: Column,
                order: Sequence[Column | str], value: Column | str, out: str,
                how: str = "sum", exclusive: bool = False) -> DataFrame:
    """One running aggregate (see ``running_aggs``)."""
    return running_aggs(df, keys, block_of, order, [(value, out, how, exclusive)])
