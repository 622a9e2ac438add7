"""Which sides of a join are sent to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and bytes that a side may have to be sent to every task; beyond either the same join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def if_small(small: DataFrame, rows: int, size: int = 0) -> DataFrame:
    """``small`` marked for broadcast when its counted ``rows``, and the bytes ``size`` of what is of any
    length in them, are within the limits; otherwise as it is, so that the join shuffles (AQE splits a hot key)."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else small
