"""Conversation rebuild on literal fixtures (FIXTURES.md A1-A4)."""

from pyspark.sql import functions as F

from colloquy.operators import conversations as cv

BASE = "audio_48khz/conversational_vad_segmented/ex01-ex02/{style}/ex01-ex02_{style}_001_channel{ch}_segment_{a}_{b}.wav"


def _p(style, a, b, ch=1):
    return BASE.format(style=style, a=f"{a:.2f}", b=f"{b:.2f}", ch=ch)


def test_path_parts(spark):
    df = spark.createDataFrame([(_p("happy", 3.5, 5.25),), ("noise/other.wav",)], "relative_audio_path string")
    r = cv.path_parts(df).collect()
    assert r[0].conv_id == "ex01-ex02_happy_001" and r[0].start_time == 3.5 and r[0].end_time == 5.25
    assert r[1].conv_id is None and r[1].start_time == float("inf")


def test_add_conversation_index_gaps(spark):
    # rows at 1, 2, 5, 6; files also at 3 and 4 (one split at 5) and at 9 (after the end: no split);
    # a file at 0.5 in a second conversation flags its first row (part numbers start at 1 there)
    ann_rows = [_p("happy", s, s + 0.5) for s in (1.0, 2.0, 5.0, 6.0)] + [_p("sad", s, s + 0.5) for s in (1.0, 2.0)]
    files = ann_rows + [_p("happy", 3.0, 3.5), _p("happy", 4.0, 4.5), _p("happy", 9.0, 9.5), _p("sad", 0.5, 0.8),
                        _p("angry", 1.0, 1.5)]
    ann = spark.createDataFrame([(p,) for p in ann_rows], "relative_audio_path string")
    fl = spark.createDataFrame([(p, 1) for p in files], "path string, length long")
    out = {r.relative_audio_path: r for r in cv.add_conversation_index(ann, fl).collect()}
    happy = [out[_p("happy", s, s + 0.5)] for s in (1.0, 2.0, 5.0, 6.0)]
    assert [h.conv_id_split for h in happy] == ["ex01-ex02_happy_001_part0"] * 2 + ["ex01-ex02_happy_001_part1"] * 2
    assert [h.turn_index for h in happy] == [0, 1, 0, 1]
    assert [h._is_split_point for h in happy] == [False, False, True, False]
    assert happy[2].prev_filename is None and happy[3].prev_filename == _p("happy", 5.0, 5.5)
    assert happy[0].conv_id == "ex01-ex02_happy_001"       # the final id stays unsplit
    sad = [out[_p("sad", s, s + 0.5)] for s in (1.0, 2.0)]
    assert [s.conv_id_split for s in sad] == ["ex01-ex02_sad_001_part1"] * 2


def test_find_missing_respects_styles(spark):
    ann = spark.createDataFrame([(_p("happy", 1.0, 1.5), "happy")], "relative_audio_path string, high_lvl_style string")
    files = spark.createDataFrame([(_p("happy", 2.0, 2.5),), (_p("angry", 1.0, 1.5),), ("loose.wav",)], "path string")
    got = {r.path for r in cv.find_missing(files, ann).collect()}
    assert got == {_p("happy", 2.0, 2.5), "loose.wav"}


def test_parse_context_literal_cases(spark):
    want = {
        # a speaker without text is skipped and takes no index
        "A : hi B: yo A:  B: bye": [("A", "hi", 0), ("B", "yo", 1), ("B", "bye", 2)],
        # what stands before the first speaker belongs to none
        "intro A: one B:two": [("A", "one", 0), ("B", "two", 1)],
        # a letter inside a word is no speaker
        "ZA: no B: yes": [("B", "yes", 0)],
        "A:x": [("A", "x", 0)],
        "  A :  spaced  B : end ": [("A", "spaced", 0), ("B", "end", 1)],
        "no speaker": [],
    }
    df = spark.createDataFrame([(c, c) for c in want] + [("n", None)], "diag_id string, context string")
    got = {}
    for r in cv.parse_context(df).collect():
        got.setdefault(r.diag_id, []).append((r.speaker_label, r.transcription, r.turn_index))
    assert {c: sorted(got.get(c, []), key=lambda x: x[2]) for c in want} == want
    assert "n" not in got


def test_turns_that_skip_numbers_keep_their_links(spark):
    turns = [0, 3, 4090, 4100, 9000, 9001]       # block edges at 4096 and 8192
    conv = spark.createDataFrame([("c", t, "user", f"t{t}") for t in turns] + [("d", 5, "user", "x"), ("d", None, "user", "y")],
                                 "conv_id string, turn long, role string, text string")
    got = {r.relative_audio_path: (r.turn_index, r.prev_filename) for r in cv.utterances_from_turns(conv).collect()}
    want = {f"c/{t}": (i, f"c/{turns[i - 1]}" if i else None) for i, t in enumerate(turns)}
    assert got == want | {"d/5": (0, None)}


def test_second_corpus_rows(spark):
    schema = ("diag_id string, context string, curr_audio_id string, curr_text string, curr_emotion string,"
              " curr_speed string, curr_volume string, res_audio_id string, res_text string, res_emotion string,"
              " res_speed string, res_volume string, curr_duration double, curr_utterance_pitch_mean double,"
              " curr_snr double, res_duration double, res_utterance_pitch_mean double, res_snr double")
    rows = [("d1", "A: hi B: yo", "c1", "A: hello", "happy", "fast", None, "r1", "B: A: sure", "sad", "slow", "loud",
             1.0, 2.0, 3.0, 4.0, 5.0, 6.0),
            ("d2", None, None, None, None, None, None, "r2", "plain", None, None, None, None, None, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, schema)
    out = {r.relative_audio_path: r for r in cv.second_corpus_rows(df, seed=3).collect()}
    assert out["c1_turn_0"].turn_index == 0 and out["c1_turn_1"].prev_filename == "c1_turn_0"
    c1 = out["c1"]
    assert (c1.turn_index, c1.speakerid, c1.transcription, c1.prev_filename) == (2, "A", "hello", "c1_turn_1")
    assert c1.basic_tags == ["happy", "fast"]
    assert "in a happy tone" in c1.text_description and "volume" not in c1.text_description
    r1 = out["r1"]
    assert (r1.turn_index, r1.speakerid, r1.prev_filename) == (3, "A", "c1")   # contains "A:" -> A, all removed
    assert r1.transcription == "B:  sure"
    r2 = out["r2"]
    assert (r2.turn_index, r2.speakerid, r2.prev_filename, r2.basic_tags) == (0, None, None, None)


def test_failure_propagation_scopes(spark):
    rows = [("c", 0, False, False), ("c", 1, True, False), ("c", 2, False, True), ("c", 3, False, False),
            ("c", 4, False, True), (None, 5, False, True), (None, 6, False, False)]
    df = spark.createDataFrame(rows, "conv_id string, ord long, text_only boolean, fails boolean")
    later = {r.ord: (r.state, r.first_failure) for r in cv.propagate_failures(
        df, text_only=F.col("text_only"), fails=F.col("fails")).collect()}
    assert later == {0: (0, False), 1: (-1, False), 2: (-2, True), 3: (-2, False), 4: (-2, False),
                     5: (-2, True), 6: (0, False)}
    alls = {r.ord: r.state for r in cv.propagate_failures(
        df, text_only=F.col("text_only"), fails=F.col("fails"), scope="all").collect()}
    assert alls[0] == -2 and alls[1] == -1 and alls[6] == 0
    dense = cv.dense_audio_index(cv.propagate_failures(df, text_only=F.col("text_only"), fails=F.col("fails")),
                                 ["ord"]).collect()
    assert sorted((r.ord, r.audio_idx) for r in dense if r.state == 0) == [(0, 0), (6, 1)]


def test_dedup_longest_first_wins(spark):
    rows = [(0, "p", 1), (1, "p", 3), (2, "p", 3), (3, "q", 1)]
    df = spark.createDataFrame(rows, "ord long, path string, n long")
    got = sorted((r.path, r.ord) for r in cv.dedup_longest(df, "path", F.col("n"), "ord").collect())
    assert got == [("p", 1), ("q", 3)]
    rep = cv.duplicate_report(df, "path").first()
    assert (rep.dup_rows, rep.dup_keys) == (3, 1)


def test_initialize_first_corpus(spark):
    schema = "source string, relative_audio_path string, text_description array<string>, ord long"
    a = spark.createDataFrame([("expresso", _p("happy", 1.0, 1.5), ["x"], 0),
                               ("expresso", _p("happy", 1.0, 1.5), ["y", "z", "w"], 1),
                               ("voxceleb", _p("happy", 2.0, 2.5), ["q"], 2)], schema)
    b = spark.createDataFrame([("expresso", "audio/other/file.wav", ["k"], 3),
                               ("expresso", _p("sad", 1.0, 1.5), [], 4),
                               ("expresso", _p("sad", 2.0, 2.5), ["a", "b"], 5),
                               ("expresso", _p("sad", 2.0, 2.5), ["c", "d"], 6)], schema)
    got = {r.relative_audio_path: r.text_description for r in cv.initialize_first_corpus([a, b]).collect()}
    assert got == {_p("happy", 1.0, 1.5): "y", _p("sad", 1.0, 1.5): None, _p("sad", 2.0, 2.5): "a"}


def test_merge_corpora_column_order(spark):
    first = spark.createDataFrame([("p", 1.0)], "relative_audio_path string, snr double")
    second = spark.createDataFrame([("q", "text_only", "sad")], "relative_audio_path string, record_type string, emotion string")
    m = cv.merge_corpora(first, second)
    assert m.columns == ["relative_audio_path", "snr", "record_type", "emotion"]
    assert {r.relative_audio_path: r.record_type for r in m.collect()} == {"p": "audio", "q": "text_only"}


def test_split_at_gaps_matches_two_step(spark):
    import random
    rnd = random.Random(9)
    rows, miss = [], []
    for c in range(12):
        for t in range(rnd.randint(1, 15)):
            (miss if rnd.random() < 0.25 else rows).append((f"c{c}", float(t), f"c{c}/{t}"))
    r = spark.createDataFrame(rows, "conv_id string, start_time double, relative_audio_path string")
    m = spark.createDataFrame([(c, s) for c, s, _ in miss], "conv_id string, start_time double")
    cols = ["relative_audio_path", "_is_split_point", "conv_id_split", "turn_index", "prev_filename"]
    one = sorted(tuple(x[c] for c in cols) for x in cv.split_at_gaps(r, m).collect())
    two = sorted(tuple(x[c] for c in cols) for x in cv.split_parts(cv.mark_split_points(r, m)).collect())
    assert one == two


def test_dense_index_narrow(spark):
    df = spark.createDataFrame([(i, 0 if i % 3 else -1, "x" * 20) for i in range(30)], "ord long, state int, p string")
    a = sorted((r.ord, r.audio_idx) for r in cv.dense_audio_index(df, ["ord"]).collect())
    b = sorted((r.ord, r.audio_idx) for r in cv.dense_audio_index(df, ["ord"], row_key="ord").collect())
    assert a == b and [x for _, x in a if x >= 0] == list(range(20))
