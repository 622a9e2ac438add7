"""End to end: both corpora -> merged utterances -> states -> chains -> prompts."""

from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators import chains as ch
from colloquy.operators import conversations as cv

BASE = "audio_48khz/conversational_vad_segmented/ex01-ex02/{style}/ex01-ex02_{style}_001_channel1_segment_{a}_{b}.wav"


def test_corpus_to_prompts(spark):
    paths = [BASE.format(style="calm", a=f"{s:.2f}", b=f"{s + 0.5:.2f}") for s in (1.0, 2.0, 3.0, 4.0)]
    ann = spark.createDataFrame([(p, "expresso", f"utt {i}", f"calm style {i}") for i, p in enumerate(paths)],
                                "relative_audio_path string, source string, transcription string, text_description string")
    files = spark.createDataFrame([(p, 1) for p in paths], "path string, length long")
    first = cv.add_conversation_index(ann, files)
    schema = ("diag_id string, context string, curr_audio_id string, curr_text string, curr_emotion string,"
              " curr_speed string, curr_volume string, res_audio_id string, res_text string, res_emotion string,"
              " res_speed string, res_volume string")
    pairs = spark.createDataFrame([("d1", "A: one B: two A: three", "c1", "B: four", "calm", "slow", "quiet",
                                    "r1", "A: five", "happy", "fast", "loud")], schema)
    second = cv.second_corpus_rows(pairs, seed=1)
    merged = cv.merge_corpora(first, second)
    ordered = merged.withColumn("ord", F.monotonically_increasing_id())
    states = cv.propagate_failures(ordered, text_only=F.col("record_type") == "text_only", fails=F.lit(False))
    meta = cv.dense_audio_index(states, ["ord"]).withColumn("part_id", F.coalesce("conv_id_split", "conv_id"))
    assert meta.where("audio_idx >= 0").count() == 6 and meta.where("audio_idx = -1").count() == 3
    chains = ch.build_chains(meta, 3).where(ch.has_valid_target("chain"))
    got = sorted((r.source, r.anchor_turn) for r in chains.collect())
    # first corpus: anchors at turns 2 and 3; second corpus: only turn 4 (text-only turn 2 is allowed)
    assert got == [("expresso", 2), ("expresso", 3), ("styletalk", 4)]
    st = chains.where("source = 'styletalk'").select(tx.user_prompt("chain").alias("p")).first().p
    assert st.startswith(tx.USER_QUESTION) and '[Turn 3]\n  Transcription: "five"\n  Speaking style:\n' in st
