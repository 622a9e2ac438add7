"""W8 chains on conversations worked by hand, one rule each (Q2, Q3)."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators import chains as ch

SCHEMA = ("source string, part_id string, turn_index long, relative_audio_path string, prev_filename string,"
          " audio_idx int, speakerid string, transcription string, text_description string")


def _part(turns, source="expresso", links=None, states=None, part="p"):
    """A linked part of ``turns`` turns; ``links`` / ``states`` change the link or state of single turns."""
    links, states = links or {}, states or {}
    return [(source, part, t, f"{part}/{t}", links.get(t, f"{part}/{t - 1}" if t else None), states.get(t, 0), "AB"[t % 2],
             f"text {t}", f"style {t}") for t in range(turns)]


def _got(spark, rows, n):
    out = ch.build_chains(spark.createDataFrame(rows, SCHEMA), n, block_size=4)
    return {tuple(u["turn_index"] for u in r.chain) for r in out.select("chain").collect()}


@pytest.mark.parametrize("rule, rows, n, want", [
    ("every full window", _part(5), 3, {(0, 1, 2), (1, 2, 3), (2, 3, 4)}),
    ("single turns", _part(3), 1, {(0,), (1,), (2,)}),
    ("too short a part", _part(2), 3, set()),
    ("a missing link may only be at the head", _part(5, links={2: None}), 3, {(2, 3, 4)}),
    ("a dangling link spoils its head too", _part(6, links={2: "gone"}), 3, {(3, 4, 5)}),
    ("a failed turn leaves a dangling link", _part(7, states={2: -2}), 3, {(4, 5, 6)}),
    ("no text-only slot in the first corpus", _part(6, states={1: -1}), 3, {(2, 3, 4), (3, 4, 5)}),
    ("the second corpus is anchored at turn 4", _part(7, "styletalk"), 3, {(2, 3, 4)}),
    ("its context may be text-only", _part(5, "styletalk", states={0: -1, 1: -1, 2: -1}), 5, {(0, 1, 2, 3, 4)}),
    ("but not turns 3 and 4", _part(5, "styletalk", states={3: -1}), 3, set()),
])
def test_chain_rules(spark, rule, rows, n, want):
    assert _got(spark, rows, n) == want, rule


def test_chains_cross_block_edges_and_hold_links(spark):
    rows = _part(23) + _part(9, part="q", links={4: None})
    out = ch.build_chains(spark.createDataFrame(rows, SCHEMA), 4, block_size=4).collect()
    assert len(out) == 20 + 3
    prev = {r[3]: r[4] for r in rows}
    for r in out:
        paths = [u["relative_audio_path"] for u in r.chain]
        assert len(paths) == 4 and all(prev[b] == a for a, b in zip(paths, paths[1:]))


def test_rows_without_part_or_turn_are_in_no_chain(spark):
    rejects = [("expresso", None, None, f"r{i}", None, 0, "A", "t", "s") for i in range(50)]
    assert _got(spark, _part(3) + rejects, 3) == {(0, 1, 2)}


def test_chain_helpers(spark):
    df = spark.createDataFrame([([{"turn_index": i, "speakerid": s, "text_description": d}
                                  for i, (s, d) in enumerate([("A", "x"), ("B", "y"), ("A", "")])],)],
                               "chain array<struct<turn_index:int,speakerid:string,text_description:string>>")
    r = df.select(ch.has_valid_target("chain").alias("ok"),
                  F.size(ch.last_turns("chain", 2)).alias("k2"), F.size(ch.last_turns("chain", 9)).alias("k9")).first()
    assert (r.ok, r.k2, r.k9) == (False, 2, 3)
    e = ch.speaker_edges(df.withColumn("cid", F.lit(1)), ["cid"]).collect()
    intra = {(x.a_pos, x.b_pos) for x in e if x.edge == "intra"}
    inter = {(x.a_pos, x.b_pos) for x in e if x.edge == "inter"}
    assert intra == {(0, 0), (1, 1), (2, 2), (2, 0)}
    assert inter == {(0, 0), (1, 1), (2, 2), (1, 0), (2, 1)}


def test_pad_batch_and_mask(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0, 3.0, 4.0]), (1, None), (2, [5.0])],
                               "b int, w array<float>")
    out = ch.pad_batch(df, "b", "w").collect()
    for r in out:
        n = 4 if r.b == 1 else 1
        assert len(r.w) == n and len(r.mask) == n
        assert all(v == 0.0 for v, m in zip(r.w, r.mask) if not m)  # padded tail is zero
        assert r.text_only == (r.length == 0)
    m = df.groupBy("b").agg(F.collect_list(F.struct(F.col("w").alias("waveform"), F.lit(3).alias("length"),
                                                    F.lit(False).alias("text_only"))).alias("c"))
    last = m.select(F.element_at(ch.mask_target("c"), -1).alias("x")).collect()
    assert all(r.x.length == 0 and r.x.text_only for r in last)


def test_walk_links(spark):
    rows = [("a0", None), ("a1", "a0"), ("a2", "a1"), ("b1", "gone"), ("b2", "b1")]
    utt = spark.createDataFrame(rows, "relative_audio_path string, prev_filename string")
    anchors = spark.createDataFrame([("a2",), ("b2",)], "relative_audio_path string")
    got = ch.walk_links(utt, anchors, 3).collect()
    assert sorted((r.anchor_path, r.hop) for r in got) == [("a2", 0), ("a2", 1), ("a2", 2)]
    loose = ch.walk_links(utt, anchors, 3, strict=False).collect()
    assert ("b2", 1) in {(r.anchor_path, r.hop) for r in loose}
