"""Signals, audio files, text sources and the driver contract (FIXTURES.md A5, A11, A12)."""

import json
import math
import os
import struct
import tempfile
import wave

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions import nulls, signal as sg, text as tx
from colloquy.sources import audio, tables


def _frames(*levels):
    """A signal whose frames of four samples (hop 4) have these RMS values."""
    return [float(x) * (-1) ** i for x in levels for i in range(4)] + [0.0]


def test_frame_snr_closed_form(spark):
    sigs = {
        0: [], 1: [1.0] * 4, 2: _frames(1.0),                 # no frame, no frame, one frame
        3: _frames(*[0.0] * 8), 4: _frames(*[1.0] * 8),       # silence; no frame above the noise
        5: _frames(*[0.5] * 4, *[5.0] * 6),                   # two levels: a power ratio of 100
        6: _frames(*range(1, 11)),                            # threshold 3.7: 1, 2, 3 are noise
        7: _frames(0.5, *[1.0] * 9),                          # the threshold is the upper level
        8: None,
    }
    df = spark.createDataFrame([(k, v) for k, v in sigs.items()], "id int, w array<double>")
    got = {r.id: r.snr for r in sg.frame_snr(df, "id", "w", frame=4, hop=4).collect()}
    assert set(got) == set(sigs) and all(got[k] is None for k in (0, 1, 2, 3, 4, 7, 8))
    assert math.isclose(got[5], 20.0, rel_tol=1e-9)
    assert math.isclose(got[6], 10 * math.log10((sum(x * x for x in range(4, 11)) / 7) / (14 / 3)), rel_tol=1e-9)


def test_frame_snr_of_long_clips_stays_in_the_row(spark):
    # eight clips of 480,000 samples; half quiet, half ten times as loud
    quiet = F.array_repeat(F.lit(0.1), 240_000)
    clips = spark.range(8).repartition(4).select("id", F.concat(quiet, F.transform(quiet, lambda x: x * 10)).alias("w"))
    out = sg.frame_snr(clips, "id", "w")
    assert "Exchange" not in sg.frame_snr(clips.select("id", "w"), "id", "w")._jdf.queryExecution().optimizedPlan().toString()
    got = [r.snr for r in out.collect()]
    assert len(got) == 8 and all(19 < x < 20.1 for x in got)


def test_peak_pad_slice(spark):
    df = spark.createDataFrame([([0.5, -2.0, 1.0], 4), ([0.0, 0.0], 4)], "w array<double>, sr int")
    r = df.select(sg.peak_normalize("w").alias("p"), sg.pad_or_trim("w", 4).alias("q"),
                  sg.pad_or_trim("w", 1).alias("t"), sg.duration_seconds("w", "sr").alias("d"),
                  sg.slice_seconds("w", "sr", F.lit(0.25), F.lit(0.75)).alias("s"),
                  sg.slice_seconds("w", "sr", F.lit(5.0), F.lit(6.0)).alias("late")).collect()
    assert math.isclose(max(abs(x) for x in r[0].p), 10 ** (-0.1 / 20))
    assert r[1].p == [0.0, 0.0] and len(r[0].q) == 4 and r[0].q[3] == 0.0 and len(r[0].t) == 1
    assert r[0].d == 0.75 and r[0].s == [-2.0, 1.0] and r[0].late is None


def _write_wav(path, rate, channels, samples):
    with wave.open(path, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(struct.pack("<" + "h" * len(samples), *samples))


def test_audio_files(spark):
    root = tempfile.mkdtemp(prefix="colloquy-wav-")
    os.makedirs(os.path.join(root, "a", "b"))
    _write_wav(os.path.join(root, "a", "one.wav"), 16000, 1, [0, 16384, -16384, 0])
    _write_wav(os.path.join(root, "a", "b", "two.wav"), 8000, 2, [100, 300, -100, -300])
    with open(os.path.join(root, "a", "bad.wav"), "wb") as f:
        f.write(b"not a wav")
    listing = {r.rel_path for r in audio.list_files(spark, root).collect()}
    assert listing == {"a/one.wav", "a/b/two.wav", "a/bad.wav"}
    man = {os.path.basename(r.path): r for r in audio.audio_manifest(spark, root).collect()}
    assert man["one.wav"].sample_rate == 16000 and man["one.wav"].n_frames == 4
    assert man["two.wav"].channels == 2 and man["bad.wav"].error.startswith("unreadable")
    rep = audio.sample_rate_report(audio.audio_manifest(spark, root)).collect()
    assert {r.sample_rate: r.n_files for r in rep} == {16000: 1, 8000: 1} and rep[0].n_unreadable == 1
    dec = {os.path.basename(r.path): r for r in audio.decode_audio(spark, root).collect()}
    assert dec["one.wav"].waveform == [0.0, 0.5, -0.5, 0.0]
    assert np.allclose(dec["two.wav"].waveform, [200 / 32768, -200 / 32768])      # channels averaged
    small = {os.path.basename(r.path): r.error for r in audio.audio_manifest(spark, root, max_bytes=20).collect()}
    assert set(small) == set(man) and small["one.wav"] == small["two.wav"] == "too_large"
    assert {r.error for r in audio.decode_audio(spark, root, max_bytes=1).collect()} == {"too_large"}
    none = audio.sample_rate_report(audio.audio_manifest(spark, root, max_bytes=1)).collect()
    assert [(r.sample_rate, r.n_files, r.n_unreadable) for r in none] == [(None, 0, 3)]
    store = os.path.join(tempfile.mkdtemp(prefix="colloquy-store-"), "wave")
    rows = audio.decode_audio(spark, root).where("error IS NULL").withColumn("source", F.lit("x"))
    tot = audio.write_waveform_store(rows, store).first()
    assert tot.n_rows == 2 and math.isclose(tot.seconds, 4 / 16000 + 2 / 8000)
    # failures and text-only rows are counted by the same write, and not stored
    every = audio.decode_audio(spark, root).withColumn("source", F.lit("y"))
    text_only = every.limit(1).withColumn("waveform", F.lit(None).cast("array<float>")).withColumn("error", F.lit(None).cast("string"))
    tot = audio.write_waveform_store(every.unionByName(text_only), store).first()
    assert (tot.n_rows, tot.n_failed, tot.n_text_only) == (2, 1, 1) and math.isclose(tot.seconds, 4 / 16000 + 2 / 8000)
    assert spark.read.parquet(store).count() == 2
    none = audio.write_waveform_store(every.where("1 = 0").drop("error"), store).first()
    assert (none.n_rows, none.seconds, none.n_failed, none.n_text_only) == (0, None, 0, 0)


def test_segment_lines_and_matching(spark):
    lines = ["# comment", "", "f1/channel1\t(0.5, 1.25) (2.0, 3.5)", "f1/channel1\t(9.0, 9.5)",
             "f1/longform\t(0.0, 1.0)", "f2/channel2\t(1.0, 2.0)"]
    df = spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)
    seg = audio.parse_segment_lines(df).collect()
    got = sorted((r.file, r.channel, r.seg, r.start, r.end) for r in seg)
    assert got == [("f1", "channel1", 0, 0.5, 1.25), ("f1", "channel1", 1, 2.0, 3.5), ("f2", "channel2", 0, 1.0, 2.0)]
    files = spark.createDataFrame([("f1", "channel1"), ("f3", "channel1")], "file string, channel string")
    ok, rej = audio.match_segments(files, audio.parse_segment_lines(df))
    assert ok.count() == 2 and [r.file for r in rej.collect()] == ["f3"]
    name = spark.range(1).select(sg.segment_name(F.lit("f1"), F.lit("channel1"), F.lit(0.5), F.lit(1.25)).alias("n"))
    assert name.first().n == "f1_channel1_segment_0.5_1.25.wav"


def test_first_segment_line_follows_the_files(spark):
    root = tempfile.mkdtemp(prefix="colloquy-seg-")
    with open(os.path.join(root, "a.txt"), "w") as f:      # the small file comes first, Spark packs the large one first
        f.write("f1/channel1\t(0.0, 1.0)\nf2/channel1\t(4.0, 5.0)\n")
    with open(os.path.join(root, "b.txt"), "w") as f:
        f.write("f1/channel1\t(7.0, 8.0)\n" + "# filler\n" * 20000 + "f3/channel1\t(1.0, 2.0)\nf3/channel1\t(3.0, 4.0)\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        got = audio.parse_segment_lines(audio.read_segment_lines(spark, root), line_col="line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r.file, r.start) for r in got} == {("f1", 0.0), ("f2", 4.0), ("f3", 1.0)}


def test_csv_json_sources(spark):
    d = tempfile.mkdtemp(prefix="colloquy-src-")
    with open(os.path.join(d, "pairs.csv"), "w", encoding="utf-8") as f:
        f.write("diag_id,curr_text\n1,NA\n2,\n3,hello\n")
    csv = {r.diag_id: r.curr_text for r in tables.read_table(spark, os.path.join(d, "pairs.csv")).collect()}
    assert csv == {"1": None, "2": None, "3": "hello"}
    with open(os.path.join(d, "spk.json"), "w") as f:
        json.dump({"p001": {"ethnicity": "x", "native language": "y"}, "p002": {"ethnicity": "z"}}, f)
    schema = T.StructType([T.StructField("ethnicity", T.StringType()), T.StructField("native language", T.StringType())])
    js = {r.speaker: r.ethnicity for r in tables.read_keyed_json(spark, os.path.join(d, "spk.json"), schema, "speaker").collect()}
    assert js == {"p001": "x", "p002": "z"}
    a = spark.createDataFrame([(1, "x")], "a long, b string")
    b = spark.createDataFrame([(2, 3.0)], "a long, c double")
    st = tables.stack_splits([a, b])
    assert sorted(st.columns) == ["a", "b", "c"] and st.count() == 2


def test_null_and_text_helpers(spark):
    df = spark.createDataFrame([(" None", ["a"], float("nan"), " x \t\n"), ("None", [], 1.0, " y "),
                                (None, None, None, None)], "s string, a array<string>, d double, t string")
    r = df.select(nulls.is_populated(df, "s").alias("ps"), nulls.is_populated(df, "a").alias("pa"),
                  nulls.is_populated(df, "d").alias("pd"), tx.strip_ws("t").alias("st"),
                  nulls.safe_attr("d").alias("sa"), nulls.to_number(F.lit("1e3x")).alias("bad"),
                  tx.strip_quotes(F.lit("'\"q\"'")).alias("q"), tx.format_duration(F.lit(3723.456)).alias("fd"),
                  tx.format_duration(F.lit(65.0)).alias("fm")).collect()
    assert [x.ps for x in r] == [True, False, False] and [x.pa for x in r] == [True, False, False]
    assert [x.pd for x in r] == [False, True, False]
    assert [x.st for x in r] == [" x \t\n".strip(), " y ".strip(), None]
    assert r[0].sa == r[2].sa == "" and r[1].sa == "1.0" and r[0].bad is None and r[0].q == "q"
    assert r[0].fd == "1h 2m 3.46s" and r[0].fm == "1m 5.00s"


def test_style_sentence_and_tags(spark):
    df = spark.createDataFrame([("k1", "happy", "fast", None), ("k2", " ", None, None)],
                               "k string, e string, s string, v string")
    r = df.select(tx.build_style_desc("e", "s", "v", 1, "k").alias("d"), tx.build_tags("e", "s", "v").alias("t")).collect()
    assert r[0].d.startswith("The speaker speaks ") and "volume" not in r[0].d and r[0].d.endswith(".")
    assert sorted(r[0].d[len("The speaker speaks "):-1].split(", ")) == ["at a fast speed", "in a happy tone"]
    assert r[0].t == ["happy", "fast"] and r[1].t is None


def test_driver_contract(spark):
    import __spark_entry__ as E
    assert E.entry(spark).count() >= 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)


def test_failure_reasons_and_routing(spark):
    roots = {"expresso": "/data/psc", "styletalk": "/data/st"}
    df = spark.createDataFrame([("expresso", True, True, 2, 10, 48000), ("vox", True, True, 2, 10, 48000),
                                ("styletalk", False, True, 2, 10, 48000), ("styletalk", True, True, 1, 10, 48000),
                                ("expresso", True, True, 2, 10, 8000), ("expresso", True, False, 2, 0, 48000)],
                               "source string, present boolean, readable boolean, ch int, n int, sr int")
    root = audio.route_source_root("source", roots)
    reason = sg.failure_reason(present=F.col("present"), readable=F.col("readable"), channels=F.col("ch"),
                               n_samples=F.col("n"), sample_rate=F.col("sr"), target_rate=16000,
                               known_source=root.isNotNull())
    got = [(r.root, r.reason) for r in df.select(root.alias("root"), reason.alias("reason")).collect()]
    assert got == [("/data/psc", None), (None, "unknown_source"), ("/data/st", "missing"), ("/data/st", "mono"),
                   ("/data/psc", "rate_below_target"), ("/data/psc", "unreadable")]
    w = spark.createDataFrame([([1.0, -3.0],)], "w array<double>")
    assert w.select(sg.apply_transform("w", lambda c: F.transform(c, lambda x: x * 2)).alias("y")).first().y == [2.0, -6.0]
    assert w.select(sg.apply_transform("w", None).alias("y")).first().y == [1.0, -3.0]


def test_large_csv_is_split_over_tasks(spark, tmp_path):
    path = str(tmp_path / "rows.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("k,text\n" + "".join(f"{i},row {i}\n" for i in range(20_000)))
    whole = tables.read_csv_table(spark, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        lines = tables.read_table(spark, path, multi_line=False)
        assert lines.rdd.getNumPartitions() > 1
        assert lines.exceptAll(whole).isEmpty() and lines.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
