"""Exact top-k per group that stays parallel inside a hot group.

Stage 1 ranks inside ``(group, salt)`` where ``salt`` is a hash of the row's
order key spread over ``buckets`` values, keeping ``k`` rows per bucket; stage 2
ranks the at most ``k * buckets`` survivors per group.  The result equals
``row_number() over (partition by group order by ...) <= k``.  Because the
stage-1 filter compares ``row_number`` with a literal, Spark plans a partial
``WindowGroupLimit`` before the shuffle: every map task forwards at most ``k``
rows per ``(group, salt)``, so a hot group never reaches one task whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                    k: int | Column, out: str = "rank", buckets: int = 32) -> DataFrame:
    """Rows with 0-based rank ``< k`` inside ``keys`` (``k`` may be a column)."""
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    if isinstance(k, int):
        kcol, kmax = F.lit(int(k)), int(k)
    else:
        # a per-group k: also filter on its maximum (a literal), which lets Spark
        # keep only that many rows per group in every map task before the shuffle
        kcol = k
        kmax = int(df.select(k.alias("__k")).agg(F.max("__k")).first()[0] or 0)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order_cols), F.lit(int(buckets))))
    w1 = Window.partitionBy(*keys, "__salt").orderBy(*order_cols)
    stage1 = salted.withColumn("__r1", F.row_number().over(w1)) \
        .where(F.col("__r1") <= F.lit(kmax)).where(F.col("__r1") <= kcol)
    w2 = Window.partitionBy(*keys).orderBy(*order_cols) if keys else Window.orderBy(*order_cols)
    stage2 = stage1.withColumn(out, (F.row_number().over(w2) - 1).cast("bigint"))
    return stage2.where(F.col(out) < kcol).drop("__salt", "__r1")
