"""Splits, profiling and run analysis on small fixtures (FIXTURES.md A8-A10)."""

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from colloquy.operators import profile as pf
from colloquy.operators import runs as rn
from colloquy.operators import splits as sp


def _ids(spark, n):
    return spark.createDataFrame([(i,) for i in range(n)], "conv_id long")


def test_train_val_and_leaks(spark):
    tv = sp.train_val_split(_ids(spark, 103), "conv_id", 0.1, 42)
    rows = tv.collect()
    assert sum(r.split == "train" for r in rows) == int(103 * 0.9)
    assert tv.select("conv_id").distinct().count() == 103
    assert sp.leak_check(tv.where("split = 'train'"), tv.where("split = 'val'")).first().n_overlap == 0
    sp.assert_no_leak(tv.where("split = 'train'"), tv.where("split = 'val'"))
    try:
        sp.assert_no_leak(tv, tv)
        raise RuntimeError("expected a leak")
    except AssertionError:
        pass
    again = sp.train_val_split(_ids(spark, 103), "conv_id", 0.1, 42).collect()
    assert sorted(rows) == sorted(again)      # reproducible from the seed


def test_kfold_sizes(spark):
    for n, k in ((103, 5), (7, 3), (4, 5)):
        f = sp.k_folds(_ids(spark, n), "conv_id", k, 1).groupBy("fold").count().collect()
        sizes = sorted((r["fold"], r["count"]) for r in f)
        exp = [len(c) for c in np.array_split(np.arange(n), k) if len(c)]
        assert [s for _, s in sizes] == exp
    one = sp.k_folds(_ids(spark, 10), "conv_id", 1, 1).collect()
    assert sum(r.fold == -1 for r in one) == 8


def test_holdout_at_least_one(spark):
    h = sp.holdout(_ids(spark, 5), "conv_id", 0.1, 3).collect()
    assert sum(r.split == "test" for r in h) == 1


def test_proportional_allocation(spark):
    counts = spark.createDataFrame([("a", 10), ("b", 25), ("c", 1)], "source string, n long")
    got = {r.source: r.alloc for r in sp.proportional_allocation(counts, 8).collect()}
    total = 36
    a, b = round(8 * 10 / total), round(8 * 25 / total)
    assert got == {"a": a, "b": b, "c": min(max(0, 8 - a - b), 1)}


def test_few_shot_pairs_distinct(spark):
    q = spark.createDataFrame([(f"q{i}",) for i in range(6)], "qkey string")
    p = spark.createDataFrame([(f"p{i}", i) for i in range(4)], "pkey string, x long")
    got = sp.few_shot_pairs(q, p, query_key="qkey", pool_key="pkey", k=3, seed=1).collect()
    by_q = {}
    for r in got:
        by_q.setdefault(r.qkey, []).append(r.pkey)
    assert len(by_q) == 6 and all(len(v) == 3 and len(set(v)) == 3 for v in by_q.values())


def test_balance_and_sample(spark):
    df = spark.createDataFrame([(i, "en" if i % 4 else "de") for i in range(40)], "doc_id long, lang string")
    out = sp.balance_majority(df, {"lang": "en"}, 5, "doc_id", 1)
    assert out.count() == 35 and out.where("lang = 'de'").count() == 10
    rows = spark.createDataFrame([(c, t, "s", f"{c}/{t}", f"{c}/{t - 1}" if t else None)
                                  for c in range(6) for t in range(c + 1)],
                                 "part_id long, turn_index long, source string, relative_audio_path string,"
                                 " prev_filename string")
    assert sp.capped_rows(7, 3) == 6 and sp.capped_rows(-1, 3) == -1
    s = sp.sample_conversations(rows, max_rows=7, max_turns=3, shares={"s": 1.0}).collect()
    parts = {r.part_id for r in s}
    assert len(parts) == 2 and len(s) == 6 and all(r.turn_index <= 2 for r in s)


def test_exact_percentiles_match_numpy(spark):
    rnd = np.random.default_rng(1)
    vals = rnd.normal(size=501).round(3)
    df = spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(vals)], "x double, g int")
    got = {r.pct: r.value for r in pf.exact_percentiles(df, "x", [50, 75, 90, 99, 100]).collect()}
    for p, v in zip([50, 75, 90, 99, 100], np.percentile(vals, [50, 75, 90, 99, 100])):
        assert math.isclose(got[p], v, abs_tol=1e-12)
    few = {r.pct: r.value for r in pf.exact_percentiles(df, "x", [50, 99]).collect()}
    assert math.isclose(few[50], np.percentile(vals, 50)) and math.isclose(few[99], np.percentile(vals, 99))
    grp = pf.exact_percentiles(df, "x", [30], by=["g"]).collect()
    for r in grp:
        assert math.isclose(r.value, np.percentile(vals[r.g::3], 30), abs_tol=1e-12)


def test_order_statistics_of_any_values(spark, monkeypatch):
    from colloquy.plans import select
    rng = np.random.default_rng(4)
    odd = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf,
           1.0, np.nextafter(1, 0), np.nextafter(1, 2), 8.0, np.nextafter(8, 0), 1e-310, 2.0 ** -1030]
    vals = [*map(float, odd), *(float(x) for x in rng.normal(size=300) * 10.0 ** rng.integers(-30, 30, 300))]
    df = spark.createDataFrame([(v, None if i % 5 == 0 else "g%d" % (i % 3)) for i, v in enumerate(vals)] + [(None, "g1"), (None, "alone")],
                               "x double, g string")
    back = df.where("x is not null").select("x", select.double_of(select.double_key(F.col("x"))).alias("y")).collect()
    assert all(r.x == r.y for r in back)
    ranks = [100.0 * k / (len(vals) - 1) for k in (0, 1, 7, 150, len(vals) - 2, len(vals) - 1)]
    ordered = sorted(vals)
    for bins in (4096, 3):
        monkeypatch.setattr(select, "BINS", bins)
        for r in select.order_statistics(df, "x", ranks if bins > 3 else ranks[:2]).collect():
            assert (r.below, r.above) == (ordered[math.floor(r["at"])], ordered[math.ceil(r["at"])])
        got = {(r.g, r.pct): r.below for r in select.order_statistics(df, "x", [0, 100], ["g"]).collect()}
        for g in (None, "g0", "g1", "g2"):
            own = [v for i, v in enumerate(vals) if (None if i % 5 == 0 else "g%d" % (i % 3)) == g]
            assert got[g, 0.0] == min(own) and got[g, 100.0] == max(own)
        assert len(got) == 8
    big = spark.createDataFrame([(2 ** 63 - 1,), (-2 ** 63,), (5,), (None,)], "x long")
    assert [r.below for r in select.order_statistics(big, "x", [0, 50, 100]).orderBy("pct").collect()] == [-2.0 ** 63, 5.0, 2.0 ** 63]
    assert select.order_statistics(big.where("x > 6").where("x < 7"), "x", [50]).count() == 0


def test_percentiles_plan_has_no_range_exchange_and_no_values_on_the_driver(spark):
    df = spark.range(5000).select((F.col("id") % 977).alias("x"))
    plan = pf.describe(df, "x")._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    r = pf.describe(df, "x").first()
    assert (r["count"], r.p25, r.p50, r.p75) == (5000, *np.percentile(np.arange(5000) % 977, [25, 50, 75]))
    assert pf.describe(df.where("x < 0"), "x").first().p50 is None


def test_histograms_and_cumulative(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 1, 2, 9, 10]], "x double")
    h = {r.bin: r["count"] for r in pf.histogram_fixed(df, "x", 5).collect()}
    assert h == {0: 3, 1: 1, 2: 0, 3: 0, 4: 2}           # last bin closed
    e = {r.bin: r["count"] for r in pf.histogram_edges(df, "x", [0, 1, 5, 10]).collect()}
    assert e == {0: 1, 1: 3, 2: 2}
    c = pf.cumulative_share(pf.histogram_fixed(df, "x", 5), ["bin"], "count").orderBy("bin").collect()
    assert [r.cum_sum for r in c] == [3, 4, 4, 4, 6]
    first = {r.threshold: r["first"] for r in pf.first_crossing(
        pf.cumulative_share(pf.histogram_fixed(df, "x", 5), ["bin"], "count"), "cum_pct", "bin", [20, 60, 100]).collect()}
    assert first == {20.0: 0, 60.0: 1, 100.0: 4}


def test_tag_cooccurrence_canonical(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"]), (["b"], ["a"]), (["c"], None)], "i array<string>, s array<string>")
    got = {(r.tag_a, r.tag_b): (r["count"], r.self_pair) for r in pf.tag_cooccurrence(df, "i", "s").collect()}
    assert got == {("a", "b"): (3, False), ("b", "b"): (1, True)}
    tot = {r.tag: r.total for r in pf.tag_totals(pf.tag_cooccurrence(df, "i", "s")).collect()}
    assert tot == {"a": 3, "b": 4}


def test_label_consistency(spark):
    df = spark.createDataFrame([("s", 1, "m"), ("s", 1, "m"), ("s", 1, "f"), ("s", 2, None), ("s", 2, None),
                                ("s", 3, "m")], "spk string, conv int, g string")
    got = {r.conv: (r.consistency, r.unanimous) for r in pf.label_consistency(df, ["spk", "conv"], "g").collect()}
    assert got == {1: (2 / 3, False), 2: (None, None)}


def test_vocabulary_json(spark):
    df = spark.createDataFrame([("x", ["b", "a"], "k"), ("x", None, "k"), ("y", ["c"], None)],
                               "source string, tags array<string>, acc string")
    v = pf.vocabulary(df, "source", ["tags", "acc"])
    got = {(r.source, r.category): r.tags for r in v.collect()}
    assert got == {("x", "tags"): ["a", "b"], ("x", "acc"): ["k"], ("y", "tags"): ["c"]}
    assert pf.vocabulary_json(v).first().value.startswith('{"x":{"acc":["k"]')


def test_ewm_matches_pandas(spark):
    rnd = np.random.default_rng(2)
    rows, exp = [], {}
    for run, n in (("a", 40), ("b", 7), ("c", 1)):
        x = rnd.normal(size=n)
        exp[run] = pd.Series(x).ewm(span=10).mean().to_numpy()
        rows += [(run, i, float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "run string, step long, value double")
    got = rn.ewm_mean(df, ["run"], "step", "value").collect()
    for r in got:
        assert math.isclose(r.ewm, exp[r.run][r.step], rel_tol=1e-9, abs_tol=1e-12)


def test_ewm_long_series_uses_blocks(spark):
    x = np.sin(np.arange(6000) / 37.0)
    df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(x)], "run string, step long, value double")
    exp = pd.Series(x).ewm(span=10).mean().to_numpy()
    got = sorted((r.step, r.ewm) for r in rn.ewm_mean(df, ["run"], "step", "value").collect())
    assert max(abs(e - g) for (_, g), e in zip(got, exp)) < 1e-9


def test_aligned_and_step_mean(spark):
    rows = [("a", 0, 1.0), ("a", 1, 3.0), ("a", 2, 5.0), ("b", 0, 2.0)]
    df = spark.createDataFrame(rows, "run string, step long, v double")
    got = {r.step: r.mean for r in rn.aligned_mean(df, ["run"], "step", "v").collect()}
    assert got == {0: 1.5, 1: 2.5, 2: 3.5}
    plain = {r.step: r.mean for r in rn.step_mean(df, "step", "v").collect()}
    assert plain == {0: 1.5, 1: 3.0, 2: 5.0}


def test_fold_best_min_delta_and_cv(spark):
    rows = [(0, 0, 1.0), (0, 1, 0.99995), (0, 2, 0.5), (1, 0, 2.0), (1, 1, 1.0), (1, 2, 0.99)]
    df = spark.createDataFrame(rows, "fold int, epoch int, val_loss double")
    got = {r.fold: (r.best_val_loss, r.best_epoch) for r in rn.fold_best(df, ["fold"], min_delta=1e-4).collect()}
    assert got == {0: (0.5, 2), 1: (0.99, 2)}
    cv = rn.cv_summary(rn.fold_best(df, ["fold"]).withColumn("g", F.lit(1)), ["g"]).first()
    assert cv.rounded_best_epoch == 2 and math.isclose(cv.std_val_loss, np.std([0.5, 0.99]))


def _min_delta(rows, delta):
    best, epoch = math.inf, None
    for e, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        if x is not None and not math.isnan(x) and x < best - delta:
            best, epoch = x, e
    return best, epoch


def test_steps_compose_to_the_sequential_rule():
    rng = np.random.default_rng(2)
    for _ in range(300):
        losses = [float(x) for x in np.round(rng.normal(size=rng.integers(1, 60)).cumsum() * 0.1, 2)]
        delta = float(rng.choice([0.0, 0.05, 0.3, 5.0]))
        best, epoch, lo = math.inf, None, 0
        while lo < len(losses):
            hi = lo + int(rng.integers(1, 20))
            below, loss, at = rn._steps_of(losses[lo:hi], list(range(lo, min(hi, len(losses)))), delta)
            i = sum(x >= best - delta for x in below)
            if i < len(below):
                best, epoch = loss[i], at[i]
            lo = hi
        assert (best, epoch) == _min_delta(list(enumerate(losses)), delta)


def test_fold_best_long_and_odd_histories(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = {("a", 1): [(i, float(x)) for i, x in enumerate(np.round(5 - np.linspace(0, 4, 3000) + rng.normal(size=3000), 3))],
            ("b", None): [(5, None), (1, math.nan), (None, 3.0), (2, 3.0), (2, 2.5)], (None, 2): [(1, None)],
            ("c", 3): [(i, 1.0 - i * 1e-5) for i in range(2000)]}
    df = spark.createDataFrame([(*f, e, x) for f, h in rows.items() for e, x in h], "g string, k long, epoch int, val_loss double")
    want = {f: _min_delta(h, 1e-4) for f, h in rows.items()}
    for piece in (65536, 7):
        monkeypatch.setattr(rn, "PIECE_ROWS", piece)
        got = rn.fold_best(df, ["g", "k"])
        assert got.columns == ["g", "k", "best_val_loss", "best_epoch"]
        assert {(r.g, r.k): (r.best_val_loss, r.best_epoch) for r in got.collect()} == want
    long = spark.range(1_000_000).select(F.lit("f").alias("g"), F.col("id").alias("epoch"), (F.lit(10.0) - F.col("id") * 1e-6).alias("val_loss"))
    monkeypatch.undo()
    r = rn.fold_best(long, ["g"], min_delta=0.5).first()
    assert (round(r.best_val_loss, 9), r.best_epoch) == (9.499999, 500001) and rn.fold_best(long.limit(0), ["g"]).count() == 0


def test_run_tables(spark):
    runs = spark.createDataFrame([
        ("test_trial1", "finished", {"test/a/f1": 0.5, "test/a/f1_std": 0.1, "_internal": 1.0}, {"lr": "0.1"}),
        ("test_trial2", "finished", {"test/a/f1": 0.7}, {"lr": "x"}),
        ("test_trialX", "finished", {"test/a/f1": 0.9}, {"lr": "0.3"}),
        ("test_trial3", "running", {"test/a/f1": 0.1}, {"lr": "0.4"})],
        "run_name string, state string, summary map<string,double>, config map<string,string>")
    fin = rn.finished_runs(runs, r"^test_trial\d+$")
    assert {r.run_name for r in fin.collect()} == {"test_trial1", "test_trial2"}
    tidy = rn.tidy_summary(fin, prefix="test")
    assert {(r.datasource, r.metric) for r in tidy.collect()} == {("a", "f1"), ("a", "f1_std")}
    s = rn.metric_summary(tidy, ["datasource"]).collect()
    assert len(s) == 1 and s[0].mean == 0.6 and s[0].std == round(float(np.std([0.5, 0.7], ddof=1)), 4)
    cfg = rn.flatten_config(fin).collect()
    assert {r.raw: r.value for r in cfg} == {"0.1": 0.1, "x": None}
    b = rn.best_per_metric(spark.createDataFrame([("d", "m", 0.12345, None), ("d", "m", 0.1234504, 0.2)],
                                                 "ds string, metric string, mean double, std double"), "ds").collect()
    assert all(r.is_best for r in b) and b[0].cell == "0.123 ± 0.000"


def test_fold_pairs_and_cross_source(spark):
    folds = sp.k_folds(_ids(spark, 10), "conv_id", 3, 2)
    fp = sp.fold_pairs(folds).collect()
    assert len(fp) == 30
    for f in range(3):
        val = {r.conv_id for r in fp if r.fold_idx == f and r.role == "val"}
        train = {r.conv_id for r in fp if r.fold_idx == f and r.role == "train"}
        assert not (val & train) and len(val | train) == 10
    df = spark.createDataFrame([("Expresso",), ("styletalk",)], "source string")
    assert [r.split for r in sp.cross_source_holdout(df, "source", "expresso").collect()] == ["pool", "test"]


def test_first_rows_sample_and_semi_anti(spark):
    df = spark.createDataFrame([(i, 10 - i) for i in range(10)], "id long, v long")
    assert [r.id for r in sp.first_rows(df, 3, ["v"]).collect()] == [9, 8, 7]
    s1 = {r.id for r in sp.seeded_sample(df, 4, "id", 5).collect()}
    s2 = {r.id for r in sp.seeded_sample(df, 4, "id", 5).collect()}
    assert s1 == s2 and len(s1) == 4
    keep = spark.createDataFrame([(1,), (2,)], "id long")
    assert {r.id for r in sp.keep_allowed(df, keep, "id").collect()} == {1, 2}
    assert sp.remove_ids(df, keep, "id").count() == 8


def test_sinks_roundtrip(spark):
    import tempfile
    from colloquy.sources import tables
    d = tempfile.mkdtemp(prefix="colloquy-sink-")
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, s string, part string")
    tables.write_parquet(df, d + "/p", partition_by=["part"])
    assert tables.read_parquet(spark, d + "/p", ["id"]).count() == 2
    tables.write_json_records(df, d + "/j")
    assert sorted(r.id for r in spark.read.json(d + "/j").collect()) == [1, 2]


def test_consistency_summaries(spark):
    g = spark.createDataFrame([("s1", 1, 1.0, True, 1.0), ("s1", 2, 0.5, False, 0.2), ("s2", 3, None, None, None)],
                              "spk string, conv int, consistency double, unanimous boolean, mean_f1 double")
    per = {r.spk: (r.n_convs, r.mean_consistency, r.mean_f1) for r in pf.per_speaker_summary(g, "spk", "conv").collect()}
    assert per == {"s1": (2, 0.75, 0.6), "s2": (1, None, None)}
    s = pf.consistency_summary(g).first()
    assert (s.n_perfect, s.n_valid) == (1, 2) and math.isclose(s.mean, 0.6)
    assert [r.conv for r in pf.flagged_groups(g).collect()] == [2]


def test_ewm_long_span(spark):
    x = np.cos(np.arange(3000) / 11.0)
    df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(x)], "run string, step long, value double")
    exp = pd.Series(x).ewm(span=100).mean().to_numpy()
    got = sorted((r.step, r.ewm) for r in rn.ewm_mean(df, ["run"], "step", "value", span=100).collect())
    assert max(abs(e - g) for (_, g), e in zip(got, exp)) < 1e-9


def test_few_shot_pairs_are_drawn_for_each_query_by_itself(spark):
    q = spark.createDataFrame([(f"q{i}",) for i in range(4500)], "qkey string")
    p = spark.createDataFrame([(i,) for i in range(10)], "pkey long")
    got = {}
    for r in sp.few_shot_pairs(q, p, query_key="qkey", pool_key="pkey", k=2, seed=5).collect():
        got.setdefault(r.qkey, {})[r.shot] = r.pkey
    pairs = Counter((v[0], v[1]) for v in got.values())
    # all 90 ordered pairs come up, each about 50 times (of neighbours only, there would be 10)
    assert len(got) == 4500 and len(pairs) == 90 and 20 < min(pairs.values()) and max(pairs.values()) < 90


def test_permuted_is_a_permutation(spark):
    from colloquy.plans.permute import permuted, sides
    seen = set()
    for n in (1, 2, 3, 5, 7, 12, 97, 1009):
        a, b = sides(n)
        assert n <= a * b < n + a and abs(a - math.sqrt(n)) <= 1 + math.sqrt(n) / 8
        df = spark.range(n).select("id", F.explode(F.array(*[F.lit(f"k{i}") for i in range(6)])).alias("key"))
        rows = df.select("key", "id", permuted(F.col("id"), n, F.col("key")).alias("x")).collect()
        for k in {r.key for r in rows}:
            order = tuple(r.x for r in sorted((r for r in rows if r.key == k), key=lambda r: r.id))
            assert sorted(order) == list(range(n))
            seen.add((n, order))
    assert sum(n == 1009 for n, _ in seen) == 6 and sum(n == 97 for n, _ in seen) == 6


def test_few_shot_pairs_query_sample(spark):
    q = spark.createDataFrame([(f"q{i}",) for i in range(20)], "qkey string")
    p = spark.createDataFrame([(f"p{i}", i) for i in range(5)], "pkey string, x long")
    got = sp.few_shot_pairs(q, p, query_key="qkey", pool_key="pkey", k=2, seed=3, max_queries=4).collect()
    assert len({r.qkey for r in got}) == 4 and len(got) == 8


def test_skip_existing(spark):
    import tempfile
    from colloquy.sources import tables
    d = tempfile.mkdtemp(prefix="colloquy-skip-") + "/out"
    df = spark.createDataFrame([(i,) for i in range(5)], "k long")
    assert tables.read_existing(spark, d) is None
    assert tables.skip_existing(df, tables.read_existing(spark, d), "k").count() == 5
    tables.write_parquet(df.where("k < 3"), d)
    assert sorted(r.k for r in tables.skip_existing(df, tables.read_existing(spark, d), "k").collect()) == [3, 4]


def test_vocabulary_json_key_order(spark):
    import json
    df = spark.createDataFrame([("a b", ["x"]), ("a", ["y"])], "source string, tags array<string>")
    doc = pf.vocabulary_json(pf.vocabulary(df, "source", ["tags"])).first().value
    assert list(json.loads(doc)) == ["a", "a b"] and json.loads(doc)["a"] == {"tags": ["y"]}


def test_ewm_keeps_early_values(spark):
    x = [1e30] + [1.0] * 4999
    exp = pd.Series(x).ewm(span=10).mean().to_numpy()
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(x)], "run string, step long, value double")
    for r in rn.ewm_mean(df, ["run"], "step", "value").collect():
        assert math.isclose(r.ewm, exp[r.step], rel_tol=1e-9), r.step


def test_ewm_any_span(spark):
    x = [float(i % 7) for i in range(3000)]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(x)], "run string, step long, value double")
    for span in (1.5, 5000, 1e7):
        exp = pd.Series(x).ewm(span=span).mean().to_numpy()
        got = sorted((r.step, r.ewm) for r in rn.ewm_mean(df, ["run"], "step", "value", span=span).collect())
        assert np.allclose([v for _, v in got], exp, rtol=1e-7)


def test_histogram_of_no_values(spark):
    df = spark.createDataFrame([(None, "a")], "v double, g string")
    assert [(r["bin"], r["count"]) for r in pf.histogram_fixed(df, "v", 3).orderBy("bin").collect()] == [(0, 0), (1, 0), (2, 0)]
    assert pf.histogram_fixed(df.where("false"), "v", 3, by=["g"]).count() == 0


def test_wide_results_one_row_per_run_and_datasource(spark):
    runs = spark.createDataFrame([
        ("r1", "lr", {"test/x/f1": 1.0, "test/y/f1": 2.0, "test/y/loss": 3.0, "trial/loss": 9.0, "trial/n": 4.0, "_step": 7.0, "epoch": 1.0}),
        ("r2", "wd", {"baseline/x/f1": 5.0, "trial/n": 6.0, "test/short": 1.0}), ("r3", None, None), (None, "k", {"test/x/f1": 8.0})],
        "run_name string, experiment_param string, summary map<string,double>")
    w = rn.wide_results(runs, keep=["experiment_param"])
    assert w.columns == ["run_name", "test_datasource", "experiment_param", "f1", "loss", "n"]
    assert {tuple(r) for r in w.collect()} == {("r1", "x", "lr", 1.0, 9.0, 4.0), ("r1", "y", "lr", 2.0, 3.0, 4.0), (None, "x", "k", 8.0, None, None)}
    b = rn.wide_results(runs, kind="baseline", trial=None)
    assert b.columns == ["run_name", "test_datasource", "f1"] and [tuple(r) for r in b.collect()] == [("r2", "x", 5.0)]
    assert rn.wide_results(runs.limit(0)).count() == 0


def _document(path):
    import glob
    import json
    return json.loads("".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(path + "/part-*"))))


def test_vocabulary_file_of_a_million_tags(spark, tmp_path):
    df = spark.range(1_000_000).select(F.lit("s").alias("source"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("tag"),
                                       F.lit("k").alias("other"))
    pf.write_vocabulary_json(pf.vocabulary_rows(df, "source", ["tag", "other"]), str(tmp_path / "v"))
    doc = _document(str(tmp_path / "v"))
    assert list(doc["s"]) == ["other", "tag"] and doc["s"]["other"] == ["k"]
    assert doc["s"]["tag"] == sorted(f"t{i}" for i in range(1_000_000))


def test_vocabulary_lines_edges(spark, tmp_path):
    df = spark.createDataFrame([("b", ["x", 'q"\n', None], "k"), ("a b", [], "k"), (None, ["z"], None), ("c", None, None), ("b", ["x"], "k")],
                               "source string, tags array<string>, acc string")
    rows = pf.vocabulary_rows(df, "source", ["tags", "acc"])
    pf.write_vocabulary_json(rows, str(tmp_path / "v"))
    assert _document(str(tmp_path / "v")) == {"a b": {"acc": ["k"]}, "b": {"acc": ["k"], "tags": ['q"\n', "x"]}, "null": {"tags": ["z"]}}
    pf.write_vocabulary_json(rows.where("false"), str(tmp_path / "e"))
    assert _document(str(tmp_path / "e")) == {}
