"""Connected components by smallest label with pointer jumping, one frozen table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import ensure_checkpoint_dir


def connected(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges (a, b)``: the smallest node of its component.

    A round takes the smallest label among the neighbours (combined before the shuffle) and then the
    label of that label, so rounds grow with the log of the diameter on chains and are few on stars;
    a hub's rows are only ever joined and combined, never gathered."""
    ensure_checkpoint_dir(edges.sparkSession)
    pairs = edges.select("a", "b").where("a <> b").distinct().checkpoint()
    both = pairs.union(pairs.select("b", "a"))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")) \
        .select("node", F.least("node", "b").alias("label")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b") \
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = low.join(up, "label", "left").select("node", "old", F.least("label", "up").alias("label")).checkpoint()
        if new.where("old <> label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
