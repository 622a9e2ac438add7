"""Skew-safe helpers against plain window functions (invariants from SURVEY §5)."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.plans.blocks import drop_halo, halo_window, running_agg, with_halo
from colloquy.plans.rank import lag_within, rank_within
from colloquy.plans.topk import top_k_per_group


def _skewed(spark, n=3000, seed=1):
    rnd = random.Random(seed)
    # one key holds a third of all rows
    rows = [("hot" if i % 3 == 0 else f"k{rnd.randint(0, 50)}", rnd.random(), i) for i in range(n)]
    return spark.createDataFrame(rows, "key string, v double, id long")


def test_rank_within_matches_row_number(spark):
    df = _skewed(spark)
    got = rank_within(df, ["key"], ["v", "id"], out="pos")
    w = Window.partitionBy("key").orderBy("v", "id")
    exp = df.withColumn("pos", (F.row_number().over(w) - 1).cast("bigint"))
    assert sorted(got.select("id", "pos").collect()) == sorted(exp.select("id", "pos").collect())


def test_global_rank_is_dense(spark):
    df = _skewed(spark)
    got = rank_within(df, [], ["v", "id"], out="pos").select("pos").collect()
    assert sorted(r.pos for r in got) == list(range(3000))


def test_lag_within(spark):
    df = _skewed(spark, 800)
    got = lag_within(df, ["key"], ["v", "id"], ["id"], pos="p")
    w = Window.partitionBy("key").orderBy("v", "id")
    exp = df.withColumn("prev_id", F.lag("id").over(w))
    assert sorted(got.select("id", "prev_id").collect()) == sorted(exp.select("id", "prev_id").collect())


def test_halo_window_equals_plain_window(spark):
    rows = [(c, t, float(t * 10 + c)) for c in range(3) for t in range(0, 50)]
    df = spark.createDataFrame(rows, "c int, t long, x double")
    h = with_halo(df, "t", halo=3, block_size=8)
    got = drop_halo(h.withColumn("s", F.sum("x").over(halo_window(["c"], ["t"]).rowsBetween(-3, 0))))
    exp = df.withColumn("s", F.sum("x").over(Window.partitionBy("c").orderBy("t").rowsBetween(-3, 0)))
    assert sorted(got.select("c", "t", "s").collect()) == sorted(exp.select("c", "t", "s").collect())


def test_running_agg_sum_and_max(spark):
    rnd = random.Random(3)
    rows = [(k, i, rnd.randint(-5, 5)) for k in range(2) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, i long, v long")
    for how, fn in (("sum", F.sum), ("max", F.max)):
        for excl in (False, True):
            got = running_agg(df, ["k"], F.floor(F.col("i") / 16), ["i"], "v", "r", how=how, exclusive=excl)
            end = -1 if excl else 0
            exp = df.withColumn("r", fn("v").over(Window.partitionBy("k").orderBy("i")
                                                  .rowsBetween(Window.unboundedPreceding, end)))
            assert sorted(got.select("k", "i", "r").collect()) == sorted(exp.select("k", "i", "r").collect())


def test_top_k_per_group(spark):
    df = _skewed(spark)
    got = top_k_per_group(df, ["key"], ["v", "id"], 5, out="r")
    w = Window.partitionBy("key").orderBy("v", "id")
    exp = df.withColumn("r", (F.row_number().over(w) - 1).cast("bigint")).where("r < 5")
    assert sorted(got.select("id", "r").collect()) == sorted(exp.select("id", "r").collect())


def test_rank_within_narrow_row_key(spark):
    df = _skewed(spark).withColumn("payload", F.repeat(F.lit("x"), 50))
    wide = rank_within(df, ["key"], ["v", "id"], out="pos")
    narrow = rank_within(df, ["key"], ["v", "id"], out="pos", row_key="id")
    assert sorted(wide.select("id", "pos").collect()) == sorted(narrow.select("id", "pos").collect())
    assert "payload" in narrow.columns


def test_rank_within_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (None, 0.5, 2), ("a", 2.0, 3)], "key string, v double, id long")
    got = sorted((r.id, r.pos) for r in rank_within(df, ["key"], ["v", "id"], out="pos").collect())
    assert got == [(1, 1), (2, 0), (3, 0)]


def test_running_agg_null_key_across_blocks(spark):
    df = spark.createDataFrame([(None, i, 1) for i in range(40)], "k string, i long, v long")
    got = running_agg(df, ["k"], F.floor(F.col("i") / 8), ["i"], "v", "r")
    assert sorted(r.r for r in got.collect()) == list(range(1, 41))
