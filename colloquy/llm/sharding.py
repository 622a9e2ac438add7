"""Contiguous shards of equal bytes from global prefix sums.

``shard_by_bytes`` orders the documents by id, takes the byte total of every range partition,
turns those totals (one row per partition) into global offsets, and lets each partition add its
own running sum.  The byte axis is then cut at ``n_shards`` equal targets; a document belongs to
the shard that holds its middle byte, so every cut is at most half a document off its target.

Only ``(id, size, crc)`` is shuffled, sorted and checkpointed; the text never moves.

Defined results: a null or empty text has size 1 (and the crc of empty text); null ids come
first; rows with equal id are ordered by crc and size, and equal rows by their place in the
input, so a hot id is spread over tasks; an empty table gives no rows; a document longer than a
target leaves the shards it spans to that one document (they may stay empty).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import shuffle_partitions
from colloquy.session import ensure_checkpoint_dir

_PLACED = "id {id}, size long, text_crc32 long, shard int, place long"


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for every document."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))
    order = ["id", "text_crc32", "size", "row"]
    # one frozen copy: totals and running sums must see the same cut into partitions
    ranged = (narrow.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
              .select(F.spark_partition_id().alias("part"), "id", "size", "text_crc32").checkpoint())
    # one row per partition
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")) \
        .orderBy("part").collect()
    first_byte, first_row, total, rows = {}, {}, 0, 0
    for t in totals:
        first_byte[t["part"]], first_row[t["part"]] = total, rows
        total, rows = total + t["bytes"], rows + t["rows"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, list[int]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(0)[0].as_py()
            byte, row = at.setdefault(part, [first_byte[part], first_row[part]])
            size = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            start = byte + np.cumsum(size) - size
            # twice the middle byte, so that halves stay whole numbers
            shard = np.minimum((2 * start + size) // -(-2 * total // n_shards), n_shards - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), b.column(3), pa.array(shard), pa.array(row + np.arange(b.num_rows))],
                names=["id", "size", "text_crc32", "shard", "place"])
            at[part] = [int(start[-1] + size[-1]), row + b.num_rows]

    kind = narrow.schema["id"].dataType.simpleString()
    placed = ranged.mapInArrow(place, _PLACED.format(id=kind))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # n_shards rows at most
    return (placed.join(F.broadcast(first), "shard")
            .select(F.col("id").alias(id_col), "size", "text_crc32", "shard",
                    (F.col("place") - F.col("first")).alias("slot")))
