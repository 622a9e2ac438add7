"""Positions and neighbours inside (possibly huge) groups without one-task windows.

A plain ``row_number() over (partition by conv_id order by ...)`` sends a whole
group to one task.  One conversation, source or user may hold a third of all
rows, so the helpers here range-partition on ``keys + order`` (a hot key is cut
into many tasks), number rows inside each range partition, and add an offset per
``(partition, key)`` taken from a small statistics table.  That table has at
most ``#keys + #partitions`` rows; each key appears in at most ``#partitions`` of
its rows, so the offset window over it is bounded.  The join back lets AQE pick
broadcast only after it has measured the statistics side.

All results are exact: the order columns must make rows unique (callers add a
tiebreak column).  The numbered rows are checkpointed (reliable checkpoint in
``spark.checkpoint.dir``) so the statistics and the final join read one frozen
copy: the range shuffle runs once and survives executor loss.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PID = "__pid"
_MID = "__mid"


def _num_partitions(df: DataFrame, requested: int | None) -> int:
    if requested:
        return int(requested)
    conf = df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")
    return max(1, int(conf))


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                out: str = "pos", num_partitions: int | None = None, row_key: str | None = None) -> DataFrame:
    """Add ``out`` = 0-based row number inside ``keys`` ordered by ``order``.

    ``keys=[]`` gives a dense global index.  The order must be total.  With a
    unique ``row_key`` (and string ``order`` columns) only the narrow
    ``keys + order + row_key`` projection is range-shuffled and checkpointed;
    the wide rows get their position back through one hash join on the key.
    """
    keys = list(keys)
    if row_key is not None and all(isinstance(c, str) for c in order):
        narrow_cols = list(dict.fromkeys([*keys, *order, row_key]))
        narrow = rank_within(df.select(*narrow_cols), keys, order, out, num_partitions)
        return df.join(narrow.select(row_key, out), row_key, "inner")
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    n = _num_partitions(df, num_partitions)
    key_cols = [F.col(k) for k in keys]
    ordered = (
        df.repartitionByRange(n, *key_cols, *order_cols)
        .sortWithinPartitions(*key_cols, *order_cols)
        .withColumn(_PID, F.spark_partition_id())
        .withColumn(_MID, F.monotonically_increasing_id())
    )
    # Freeze the numbered rows once: both the statistics and the join read this
    # copy (no second range shuffle; lineage cut in spark.checkpoint.dir).
    ordered = ordered.checkpoint(eager=True)
    stats = ordered.groupBy(_PID, *keys).agg(
        F.min(_MID).alias("__first"), F.count(F.lit(1)).alias("__cnt"))
    w = Window.partitionBy(*key_cols).orderBy(_PID) if keys else Window.orderBy(_PID)
    stats = stats.withColumn(
        "__off", F.sum("__cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    stats = stats.select(F.col(_PID).alias("__s_pid"), *[F.col(k).alias("__s_" + k) for k in keys],
                         F.coalesce("__off", F.lit(0)).alias("__off"), "__first")
    # NULL is a key like any other: null-safe equality on the group columns
    cond = [F.col(_PID) == F.col("__s_pid")] + [F.col(k).eqNullSafe(F.col("__s_" + k)) for k in keys]
    joined = ordered.join(stats, cond, "inner")
    return joined.withColumn(
        out, (F.col("__off") + F.col(_MID) - F.col("__first")).cast("bigint")
    ).drop(_PID, _MID, "__off", "__first", "__s_pid", *["__s_" + k for k in keys])


def lag_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
               cols: Sequence[str], pos: str = "pos", prefix: str = "prev_",
               num_partitions: int | None = None, row_key: str | None = None) -> DataFrame:
    """Previous row's ``cols`` inside ``keys`` (NULL on the first row).

    Implemented as ``rank_within`` + an equi-join on ``(keys, pos - 1)``: the
    join key is unique per row, so no group lands on one task.
    """
    ranked = rank_within(df, keys, order, out=pos, num_partitions=num_partitions, row_key=row_key)
    prev = ranked.select(
        *[F.col(k).alias("__k_" + k) for k in keys], (F.col(pos) + 1).alias("__next_pos"),
        *[F.col(c).alias(prefix + c) for c in cols])
    cond = [F.col(k).eqNullSafe(F.col("__k_" + k)) for k in keys]
    cond.append(F.col(pos) == F.col("__next_pos"))
    return ranked.join(prev, cond, "left").drop(*["__k_" + k for k in keys], "__next_pos")
