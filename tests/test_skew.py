"""Hot keys are split: no stage gives one task a whole hot group."""

from pyspark.sql import functions as F

from colloquy.plans.blocks import BLOCK, with_halo
from colloquy.plans.rank import rank_within
from colloquy.plans.topk import top_k_per_group


def _hot(spark, n=6000):
    # conversation "hot" holds a third of all rows
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), (F.col("id") % 97).cast("string")))
        .alias("conv"), F.col("id").alias("t"))


def test_halo_blocks_bound_group_size(spark):
    df = rank_within(_hot(spark), ["conv"], ["t"], out="turn")
    blocked = with_halo(df, "turn", halo=5, block_size=256)
    biggest = blocked.groupBy("conv", BLOCK).count().agg(F.max("count")).first()[0]
    assert biggest <= 256 + 5


def test_range_rank_spreads_hot_key(spark):
    df = _hot(spark)
    parts = df.repartitionByRange(8, "conv", "t").where("conv = 'hot'") \
        .select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 2
    ranked = rank_within(df, ["conv"], ["t"], out="pos", num_partitions=8)
    hot = ranked.where("conv = 'hot'").agg(F.min("pos"), F.max("pos"), F.count("*")).first()
    assert (hot[0], hot[1], hot[2]) == (0, 1999, 2000)


def test_topk_forwards_at_most_k_per_map_task(spark):
    df = _hot(spark).withColumn("h", F.md5(F.col("t").cast("string")))
    plan = top_k_per_group(df, ["conv"], ["h", "t"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert top_k_per_group(df, ["conv"], ["h", "t"], 3).where("conv = 'hot'").count() == 3
