"""More registered queries: path parsing, second-corpus ingest, scalar and signal helpers, split variants.

Imported by ``suite`` for its side effect on ``QUERIES`` / ``ORACLE_SQL``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import nulls
from colloquy.functions import signal as sg
from colloquy.functions import text as tx
from colloquy.operators import chains as ch
from colloquy.operators import conversations as cv
from colloquy.operators import profile as pf
from colloquy.operators import runs as rn
from colloquy.operators import splits as sp
from colloquy.plans import suite
from colloquy.plans.suite import r6, register
from colloquy.sources import audio
from colloquy.sources.tables import read_driver_table


def _conv(spark, sf_dir, columns=("conv_id", "turn", "role", "text")):
    return read_driver_table(spark, sf_dir, "conversations", list(columns))


# ---------------------------------------------------------------------------
# first corpus: paths (every third turn has a path that does not parse)

_PATHS_SQL = """
pt AS (SELECT conv_id AS cid, turn, role,
  CASE WHEN turn % 3 = 2 THEN 'noise/' || conv_id || '/' || turn || '.wav'
       ELSE 'audio/conversational_vad_segmented/ex' || turn || '-ex' || (turn + 1) || '/' || role || '/ex' || turn || '-ex' || (turn + 1)
            || '_' || role || '_' || conv_id || '_channel1_segment_' || turn || '.50_' || (turn + 1) || '.25.wav' END AS path
  FROM conversations)"""


def _paths(spark, sf_dir):
    turn, nxt = F.col("turn").cast("string"), (F.col("turn") + 1).cast("string")
    pair = F.concat(F.lit("ex"), turn, F.lit("-ex"), nxt)
    good = F.concat(F.lit("audio/conversational_vad_segmented/"), pair, F.lit("/"), "role", F.lit("/"), pair, F.lit("_"), "role", F.lit("_"),
                    F.col("conv_id").cast("string"), F.lit("_channel1_segment_"), turn, F.lit(".50_"), nxt, F.lit(".25.wav"))
    bad = F.concat(F.lit("noise/"), F.col("conv_id").cast("string"), F.lit("/"), turn, F.lit(".wav"))
    return _conv(spark, sf_dir, ("conv_id", "turn", "role")).select(
        F.col("conv_id").alias("cid"), "turn", "role", F.when(F.col("turn") % 3 == 2, bad).otherwise(good).alias("relative_audio_path"))


@register("path_parts", "WITH " + _PATHS_SQL + r""",
x AS (SELECT path, nullif(regexp_extract(path, '(ex\d+-ex\d+)', 1), '') AS speakers,
             nullif(regexp_extract(path, 'ex\d+-ex\d+/([\pL\pN_-]+)/', 1), '') AS style,
             nullif(regexp_extract(path, '_(\d+)_channel', 1), '') AS num,
             nullif(regexp_extract(path, '_segment_(\d+\.\d+)_', 1), '') AS a,
             nullif(regexp_extract(path, '_segment_\d+\.\d+_(\d+\.\d+)\.wav', 1), '') AS b FROM pt)
SELECT path, speakers, style AS high_lvl_style, num AS conv_num, coalesce(CAST(a AS DOUBLE), -1.0) AS start_time,
       coalesce(CAST(b AS DOUBLE), -1.0) AS end_time, speakers || '_' || style || '_' || num AS conv_id FROM x
""")
def q_path_parts(spark, sf_dir):
    """Fields of every path; a path that does not parse has NULL fields and infinite times (shown as -1)."""
    finite = lambda c: F.when(F.col(c) == float("inf"), F.lit(-1.0)).otherwise(F.col(c)).alias(c)
    p = cv.path_parts(_paths(spark, sf_dir))
    return p.select(F.col("relative_audio_path").alias("path"), "speakers", "high_lvl_style", "conv_num", finite("start_time"),
                    finite("end_time"), "conv_id")


@register("missing_files", "WITH " + _PATHS_SQL + r""",
ann AS (SELECT path, nullif(regexp_extract(path, 'ex\d+-ex\d+/([\pL\pN_-]+)/', 1), '') AS style FROM pt WHERE turn % 2 = 0)
SELECT path FROM pt WHERE path NOT IN (SELECT path FROM ann)
  AND (nullif(regexp_extract(path, 'conversational_vad_segmented/[^/]+/([\pL\pN_-]+)', 1), '') IS NULL
       OR regexp_extract(path, 'conversational_vad_segmented/[^/]+/([\pL\pN_-]+)', 1) IN (SELECT style FROM ann WHERE style IS NOT NULL))
""")
def q_missing_files(spark, sf_dir):
    """J1 (path form): files without an annotated row, of annotated styles or without one."""
    paths = _paths(spark, sf_dir)
    ann = cv.path_parts(paths.where(F.col("turn") % 2 == 0).select("relative_audio_path"))
    return cv.find_missing(paths.select(F.col("relative_audio_path").alias("path")), ann).select("path")


@register("first_corpus", "WITH " + _PATHS_SQL + r""",
two AS (SELECT path, role, 0 AS k FROM pt UNION ALL SELECT path, role || '+', 1 FROM pt WHERE turn % 2 = 0)
SELECT path, max(CASE WHEN k = 1 THEN 'second' ELSE 'first' END) AS kept FROM two
WHERE path LIKE '%conversational_vad_segmented%' GROUP BY path
""")
def q_first_corpus(spark, sf_dir):
    """P4 + P5 + W5: two splits of one corpus, one row per segmented path, the longest description list wins."""
    paths = _paths(spark, sf_dir).withColumn("source", F.lit("expresso"))
    a = paths.select("source", "relative_audio_path", F.array(F.lit("first")).alias("text_description"),
                     (F.xxhash64("relative_audio_path").cast("decimal(20,0)") * 2).alias("ord"))
    b = paths.where(F.col("turn") % 2 == 0).select("source", "relative_audio_path", F.array(F.lit("second"), F.lit("x")).alias("text_description"),
                                                   (F.xxhash64("relative_audio_path").cast("decimal(20,0)") * 2 + 1).alias("ord"))
    out = cv.initialize_first_corpus([a, b])
    return out.select(F.col("relative_audio_path").alias("path"), F.col("text_description").alias("kept"))


# ---------------------------------------------------------------------------
# second corpus: wide dialogue pairs made of four turns in a row

_WIDE_SQL = r"""
w AS (SELECT c.conv_id || '-' || c.turn AS diag_id, lower(a.text) AS ta, lower(b.text) AS tb, lower(c.text) AS tc, lower(d.text) AS td,
             c.conv_id || '/' || c.turn AS cid, d.conv_id || '/' || d.turn AS rid, c.role AS crole, d.role AS rrole,
             CASE WHEN c.turn % 2 = 0 THEN 'fast' END AS cspeed, CASE WHEN d.turn % 2 = 0 THEN 'slow' END AS rspeed
      FROM conversations c JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn - 2
      JOIN conversations b ON b.conv_id = c.conv_id AND b.turn = c.turn - 1
      LEFT JOIN conversations d ON d.conv_id = c.conv_id AND d.turn = c.turn + 1),
s AS (SELECT *, regexp_replace(ta, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS sa, regexp_replace(tb, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS sb FROM w),
n AS (SELECT *, CAST((sa <> '')::INT + (sb <> '')::INT AS BIGINT) AS nc FROM s),
ctx AS (SELECT diag_id, cid, CAST(0 AS BIGINT) AS i, 'A' AS sp, sa AS t FROM n WHERE sa <> ''
        UNION ALL SELECT diag_id, cid, CAST((sa <> '')::INT AS BIGINT), 'B', sb FROM n WHERE sb <> ''),
r AS (
SELECT diag_id AS conv_id, i AS turn_index, cid || '_turn_' || i AS relative_audio_path, sp AS speakerid, t AS transcription,
       CASE WHEN i > 0 THEN cid || '_turn_' || (i - 1) END AS prev_filename, 'text_only' AS record_type,
       CAST(NULL AS VARCHAR) AS emotion, CAST(NULL AS VARCHAR) AS speaking_rate FROM ctx
UNION ALL SELECT diag_id, nc, cid, 'B', tc, CASE WHEN nc > 0 THEN cid || '_turn_' || (nc - 1) END, 'audio', crole, cspeed FROM n
UNION ALL SELECT diag_id, nc + 1, rid, 'A', ' ' || td, cid, 'audio', rrole, rspeed FROM n WHERE rid IS NOT NULL),
rows2 AS (SELECT *, CASE WHEN record_type = 'audio' THEN array_to_string(list_filter([emotion, speaking_rate], lambda x: x IS NOT NULL), ',') END AS tags,
  CASE WHEN record_type = 'audio' THEN 'The speaker speaks ' || CASE WHEN speaking_rate IS NULL THEN 'in a ' || emotion || ' tone'
    WHEN CAST('0x' || substr(md5('3:' || relative_audio_path), 1, 4) AS INT) % 6 IN (0, 1, 2) THEN 'in a ' || emotion || ' tone, at a ' || speaking_rate || ' speed'
    ELSE 'at a ' || speaking_rate || ' speed, in a ' || emotion || ' tone' END || '.' END AS text_description FROM r)
"""


def _wide(spark, sf_dir):
    conv = _conv(spark, sf_dir).withColumn("id", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))

    def at(shift, name):
        return conv.select("conv_id", (F.col("turn") + shift).alias("turn"), F.lower("text").alias(name), F.col("role").alias(name + "_role"),
                           F.col("id").alias(name + "_id"), F.col("turn").alias(name + "_turn"))

    j = at(0, "c").join(at(2, "a"), ["conv_id", "turn"]).join(at(1, "b"), ["conv_id", "turn"]).join(at(-1, "d"), ["conv_id", "turn"], "left")
    return j.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("diag_id"),
        F.concat(F.lit("A: "), "a", F.lit(" B: "), "b").alias("context"), F.col("c_id").alias("curr_audio_id"),
        F.concat(F.lit("B: "), "c").alias("curr_text"), F.col("c_role").alias("curr_emotion"),
        F.when(F.col("c_turn") % 2 == 0, "fast").alias("curr_speed"), F.lit(None).cast("string").alias("curr_volume"),
        F.col("d_id").alias("res_audio_id"), F.concat(F.lit("A: "), "d").alias("res_text"), F.col("d_role").alias("res_emotion"),
        F.when(F.col("d_turn") % 2 == 0, "slow").alias("res_speed"), F.lit(None).cast("string").alias("res_volume"))


@register("second_corpus", "WITH " + _WIDE_SQL + """
SELECT conv_id, turn_index, relative_audio_path, speakerid, transcription, prev_filename, record_type, tags, text_description FROM rows2
""")
def q_second_corpus(spark, sf_dir):
    """Dialogue pairs unfolded into context, current and response rows."""
    rows = cv.second_corpus_rows(_wide(spark, sf_dir), seed=3)
    return rows.select("conv_id", "turn_index", "relative_audio_path", "speakerid", "transcription", "prev_filename", "record_type",
                       F.array_join("basic_tags", ",").alias("tags"), "text_description")


@register("merged_corpora", "WITH " + _WIDE_SQL + """,
u AS (SELECT 'dialogue' AS source, 'audio' AS record_type, CAST(NULL AS VARCHAR) AS emotion FROM conversations
      UNION ALL SELECT 'styletalk', record_type, emotion FROM rows2)
SELECT source, record_type, count(*) AS n_rows, count(emotion) AS n_emotion FROM u GROUP BY source, record_type
""")
def q_merged_corpora(spark, sf_dir):
    """G1 + P9: both corpora under one schema, missing columns NULL."""
    first = cv.utterances_from_turns(_conv(spark, sf_dir))
    merged = cv.merge_corpora(first, cv.second_corpus_rows(_wide(spark, sf_dir), seed=3))
    return merged.groupBy("source", "record_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count("emotion").alias("n_emotion"))


# ---------------------------------------------------------------------------
# scalar helpers over documents


@register("text_helpers", r"""
SELECT doc_id, trim('''"' || source || '"', '''"') AS unquoted, CASE WHEN n_chars % 7 = 0 THEN '' ELSE CAST(n_chars AS VARCHAR) || '.0' END AS attr,
       lang <> 'None' AND lang <> '' AND doc_id % 5 <> 0 AS populated,
       CASE WHEN n_chars >= 3600 THEN (n_chars // 3600) || 'h ' || (n_chars % 3600 // 60) || 'm ' || printf('%.2fs', CAST(n_chars % 60 AS DOUBLE))
            WHEN n_chars >= 60 THEN (n_chars // 60) || 'm ' || printf('%.2fs', CAST(n_chars % 60 AS DOUBLE))
            ELSE printf('%.2fs', CAST(n_chars AS DOUBLE)) END AS lasts
FROM documents
""")
def q_text_helpers(spark, sf_dir):
    """Quotes, missing values, populated test and durations."""
    d = read_driver_table(spark, sf_dir, "documents", ["doc_id", "source", "lang", "n_chars"])
    d = d.withColumn("x", F.when(F.col("n_chars") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("n_chars").cast("double"))) \
        .withColumn("blank", F.when(F.col("doc_id") % 5 == 0, F.lit("\t \n")).otherwise(F.col("lang")))
    return d.select("doc_id", tx.strip_quotes(F.concat(F.lit("'\""), "source", F.lit('"'))).alias("unquoted"),
                    F.when(F.col("n_chars") < 10_000_000, nulls.safe_attr("x")).alias("attr"),
                    nulls.is_populated(d, "blank").alias("populated"), tx.format_duration("n_chars").alias("lasts"))


@register("audio_routing", """
WITH r AS (SELECT doc_id, CASE source WHEN 'src0' THEN '/a' WHEN 'src1' THEN '/b' END AS root, n_chars FROM documents)
SELECT doc_id, root, CASE WHEN root IS NULL THEN 'unknown_source' WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'unreadable'
       WHEN n_chars % 3 = 0 THEN 'empty' WHEN doc_id % 11 = 0 THEN 'mono' WHEN n_chars < 1000 THEN 'rate_below_target' END AS reason FROM r
""")
def q_audio_routing(spark, sf_dir):
    """P21 + H19: source roots and the first failing check of every file."""
    d = read_driver_table(spark, sf_dir, "documents", ["doc_id", "source", "n_chars"])
    root = audio.route_source_root("source", {"src0": "/a", "src1": "/b"})
    reason = sg.failure_reason(present=F.col("doc_id") % 5 != 0, readable=F.col("doc_id") % 7 != 0, n_samples=F.col("n_chars") % 3,
                               channels=F.when(F.col("doc_id") % 11 == 0, 1).otherwise(2), sample_rate=F.col("n_chars"), target_rate=1000,
                               known_source=root.isNotNull())
    return d.select("doc_id", root.alias("root"), reason.alias("reason"))


@register("finished_runs", r"""
SELECT CAST(o_orderkey AS VARCHAR) AS run_name FROM orders WHERE o_orderstatus = 'F' AND regexp_matches(CAST(o_orderkey AS VARCHAR), '^1\d+$')
""")
def q_finished_runs(spark, sf_dir):
    """Finished runs whose name matches a pattern."""
    runs = read_driver_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus"]).select(
        F.col("o_orderkey").cast("string").alias("run_name"), F.when(F.col("o_orderstatus") == "F", "finished").otherwise("running").alias("state"))
    return rn.finished_runs(runs, r"^1\d+$").select("run_name")


# ---------------------------------------------------------------------------
# signals: embeddings cut to 1 .. all of their samples


@register("padded_batches", """
WITH e AS (SELECT conv_id, turn, list_transform(list_filter(string_split_regex(text, '[ \\n\\t]+'), lambda w: w <> ''), lambda w: length(w)) AS w
           FROM conversations),
m AS (SELECT conv_id, max(coalesce(len(w), 0)) AS top FROM e GROUP BY conv_id)
SELECT e.conv_id, turn, CAST(coalesce(len(w), 0) AS INT) AS length, CAST(top AS INT) AS padded, CAST(coalesce(len(w), 0) AS INT) AS kept,
       round(CAST(coalesce(list_sum(w), 0) AS DOUBLE), 6) AS total
FROM e JOIN m ON e.conv_id IS NOT DISTINCT FROM m.conv_id
""")
def q_padded_batches(spark, sf_dir):
    """The word lengths of every turn as a signal, padded to the longest of its conversation, with its mask."""
    e = read_driver_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.transform(F.filter(F.split("text", r"[ \n\t]+"), lambda w: w != ""), lambda w: F.length(w).cast("float")).alias("w"))
    p = ch.pad_batch(e, "conv_id", "w")
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return p.select("conv_id", "turn", F.col("length").cast("int").alias("length"), F.size("w").alias("padded"),
                    F.size(F.filter("mask", lambda x: x)).alias("kept"), r6(total).alias("total"))


@register("signal_slices", """
WITH e AS (SELECT vec_id, len(embedding) AS n, CAST((vec_id % 9) * 500 * 16 // 1000 AS INT) AS a,
                  CAST(least(((vec_id % 9) * 500 + 1250) * 16 // 1000, len(embedding)) AS INT) AS b FROM embeddings)
SELECT vec_id, round(n / 16.0, 6) AS seconds, CASE WHEN a < n THEN CAST(greatest(b - a, 0) AS INT) END AS n_slice,
       'f' || vec_id || '_channel1_segment_' || (vec_id % 9) || '_' || (vec_id % 9 + 1) || '.wav' AS name FROM e
""")
def q_signal_slices(spark, sf_dir):
    """1.25 s slices at 16 samples a second, durations and segment names."""
    e = read_driver_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    start = (F.col("vec_id") % 9) * 0.5
    cut = sg.slice_seconds("embedding", F.lit(16), start, start + 1.25)
    return e.select("vec_id", r6(sg.duration_seconds("embedding", F.lit(16))).alias("seconds"),
                    F.when(cut.isNotNull(), F.size(cut)).alias("n_slice"),
                    sg.segment_name(F.concat(F.lit("f"), F.col("vec_id").cast("string")), F.lit("channel1"), F.col("vec_id") % 9,
                                    F.col("vec_id") % 9 + 1).alias("name"))


@register("segment_lists", """
SELECT CAST(conv_id AS VARCHAR) AS file, 'channel' || turn AS channel, k AS seg, turn + k / 2.0 AS start, turn + k / 2.0 + 0.25 AS "end"
FROM conversations, (VALUES (0), (1)) t(k) WHERE role <> 'system' AND turn % 2 = 0
""")
def q_segment_lists(spark, sf_dir):
    """S7 + J9: segment lines of every other turn (system lines are comments), joined to all files."""
    c = _conv(spark, sf_dir, ("conv_id", "turn", "role"))
    file, channel = F.col("conv_id").cast("string"), F.concat(F.lit("channel"), F.col("turn").cast("string"))
    num = lambda x: (F.col("turn") + x).cast("double").cast("string")
    line = F.concat(F.when(F.col("role") == "system", F.lit("# ")).otherwise(F.lit("")), file, F.lit("/"), channel, F.lit("\t("), num(0.0),
                    F.lit(", "), num(0.25), F.lit(") ("), num(0.5), F.lit(", "), num(0.75), F.lit(")"))
    segments = audio.parse_segment_lines(c.where(F.col("turn") % 2 == 0).select(line.alias("value")))
    matched, _ = audio.match_segments(c.select(file.alias("file"), channel.alias("channel")), segments)
    return matched.select("file", "channel", "seg", "start", "end")


# ---------------------------------------------------------------------------
# split, failure and walk variants


@register("failure_all", "WITH " + suite._FAIL_SQL + """
SELECT t.conv_id, t.turn, CASE WHEN text_only THEN -1 WHEN ff.first_fail IS NOT NULL THEN -2 ELSE 0 END AS state
FROM t LEFT JOIN ff ON t.conv_id = ff.conv_id
""")
def q_failure_all(spark, sf_dir):
    """W6 with ``scope='all'``: one failure takes every audio row of its conversation."""
    conv = _conv(spark, sf_dir, ("conv_id", "turn", "role"))
    out = cv.propagate_failures(conv, conv_col="conv_id", ord_col="turn", text_only=F.col("role") == "system",
                                fails=suite._md5_flag("fail", "conv_id", "turn"), scope="all")
    return out.select("conv_id", "turn", F.col("state").cast("int").alias("state"))


@register("chains_after_failures", "WITH " + suite._FAIL_SQL + """,
utt AS (SELECT c.conv_id, c.conv_id AS part_id, c.turn AS turn_index, c.role AS speakerid, c.text AS transcription, c.text AS text_description,
               CAST(c.conv_id AS VARCHAR) || '/' || CAST(c.turn AS VARCHAR) AS relative_audio_path, st.state AS audio_idx
        FROM conversations c JOIN st ON st.conv_id = c.conv_id AND st.turn = c.turn),
utt2 AS (SELECT *, lag(relative_audio_path) OVER (PARTITION BY part_id ORDER BY turn_index) AS prev_filename FROM utt),
""" + suite.chains_sql(3) + "SELECT conv_id, anchor_turn, chain_chars FROM chains")
def q_chains_after_failures(spark, sf_dir):
    """P16 + W8: chains once failed turns (-2) have left."""
    state = suite._failure_states(spark, sf_dir).select("conv_id", F.col("turn").alias("turn_index"), F.col("state").alias("audio_idx"))
    utt = cv.utterances_from_turns(_conv(spark, sf_dir)).drop("audio_idx").join(state, ["conv_id", "turn_index"])
    chains = ch.build_chains(utt, 3, keep_cols=["speakerid"])
    size = F.aggregate("chain", F.lit(0).cast("bigint"), lambda a, u: a + F.length(u["transcription"]))
    return chains.where(ch.has_valid_target("chain")).select(F.col("part_id").alias("conv_id"), "anchor_turn", size.alias("chain_chars"))


@register("kfold_single", "WITH " + suite._IDS_SQL.format(seed=42) + """
SELECT conv_id, pos, CASE WHEN pos < CAST(floor(n * 0.8) AS BIGINT) THEN -1 ELSE 0 END AS fold FROM sh, n
""")
def q_kfold_single(spark, sf_dir):
    """X3 with one fold: the first 80 % train (-1), the rest is the fold."""
    return sp.k_folds(_conv(spark, sf_dir, ("conv_id",)), "conv_id", 1, 42)


@register("cross_source_holdout", "SELECT doc_id, CASE WHEN source = 'src0' THEN 'pool' ELSE 'test' END AS split FROM documents")
def q_cross_source_holdout(spark, sf_dir):
    """X5 (cross-source form): one source is the pool, the others the test set."""
    return sp.cross_source_holdout(read_driver_table(spark, sf_dir, "documents", ["doc_id", "source"]), "source", "SRC0").select("doc_id", "split")


@register("leak_overlap", """
WITH b AS (SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1),
e AS (SELECT CAST(doc_id AS VARCHAR) AS x FROM b ORDER BY doc_id LIMIT 5)
SELECT (SELECT count(*) FROM b) AS n_overlap, (SELECT string_agg(x, ',' ORDER BY x) FROM e) AS examples
""")
def q_leak_overlap(spark, sf_dir):
    """J7 / G4 on two sets that overlap, with up to five examples."""
    a = read_driver_table(spark, sf_dir, "documents", ["doc_id", "lang"]).where("lang = 'en'")
    b = read_driver_table(spark, sf_dir, "labels", ["doc_id", "quality"]).where("quality = 1")
    return sp.leak_check(a, b, "doc_id").select("n_overlap", F.array_join("examples", ",").alias("examples"))


@register("strict_walk", """
WITH RECURSIVE c AS (SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || '/' || turn AS path FROM conversations)
SELECT a.path AS anchor_path, b.path AS path, CAST(a.turn - b.turn AS INT) AS hop FROM c a JOIN c b ON a.conv_id = b.conv_id
WHERE a.turn >= 2 AND b.turn BETWEEN a.turn - 2 AND a.turn
""")
def q_strict_walk(spark, sf_dir):
    """J3 (strict form): every turn's walk over three linked turns; shorter walks are dropped."""
    utt = cv.utterances_from_turns(_conv(spark, sf_dir))
    out = ch.walk_links(utt, utt.select("relative_audio_path"), 3)
    return out.select("anchor_path", F.col("relative_audio_path").alias("path"), "hop")


@register("tag_order", "WITH " + suite._PART_TAGS_SQL + """,
r AS (SELECT attribute || object AS t FROM tg WHERE len(attribute || object) >= 2),
pr AS (SELECT least(t[i], t[j]) AS a, greatest(t[i], t[j]) AS b
       FROM (SELECT t, i, unnest(generate_series(1, len(t))) AS j FROM (SELECT t, unnest(generate_series(1, len(t))) AS i FROM r)) WHERE i < j)
SELECT tag, CAST(count(*) AS BIGINT) AS total FROM (SELECT a AS tag FROM pr UNION ALL SELECT b FROM pr WHERE a <> b) GROUP BY tag
""")
def q_tag_order(spark, sf_dir):
    """The total that orders the tags of the co-occurrence matrix."""
    return pf.tag_totals(pf.tag_cooccurrence(suite._part_tags(spark, sf_dir), "attribute", "object"))


@register("first_rows_by_length", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def q_first_rows_by_length(spark, sf_dir):
    """a report of the twenty longest documents."""
    d = read_driver_table(spark, sf_dir, "documents", ["doc_id", "n_chars"]).withColumn("shorter", -F.col("n_chars"))
    return sp.first_rows(d, 20, ["shorter", "doc_id"]).select("doc_id", "n_chars")


@register("length_crossings", """
WITH l AS (SELECT n_chars AS v, count(*) AS c FROM documents GROUP BY n_chars),
k AS (SELECT v, sum(c) OVER (ORDER BY v) * 100.0 / (SELECT sum(c) FROM l) AS pct FROM l)
SELECT CAST(t AS DOUBLE) AS threshold, (SELECT min(v) FROM k WHERE pct >= t - 1e-9) AS first FROM (VALUES (50), (80), (95), (100)) x(t)
""")
def q_length_crossings(spark, sf_dir):
    """The first document length at which the cumulative share reaches each threshold."""
    counts = read_driver_table(spark, sf_dir, "documents", ["n_chars"]).groupBy("n_chars").agg(F.count(F.lit(1)).alias("c"))
    cum = pf.cumulative_share(counts, ["n_chars"], "c")
    return pf.first_crossing(cum, "cum_pct", "n_chars", [50, 80, 95, 100])


@register("vocab_json", "WITH " + suite._PART_TAGS_SQL + """,
v AS (SELECT DISTINCT source, category, tag FROM (
        SELECT p_brand AS source, 'attribute' AS category, unnest(attribute) AS tag FROM tg
        UNION ALL SELECT p_brand, 'object', unnest(object) FROM tg) WHERE tag IS NOT NULL),
k AS (SELECT *, row_number() OVER (ORDER BY source, category, tag) - 1 AS pos,
             row_number() OVER (PARTITION BY source ORDER BY category, tag) AS s0, row_number() OVER (PARTITION BY source ORDER BY category DESC, tag DESC) AS s1,
             row_number() OVER (PARTITION BY source, category ORDER BY tag) AS c0, row_number() OVER (PARTITION BY source, category ORDER BY tag DESC) AS c1,
             max(source) OVER () AS top FROM v)
SELECT pos, CASE WHEN pos = 0 THEN '{' ELSE '' END || CASE WHEN s0 = 1 THEN CAST(to_json(source) AS VARCHAR) || ':{' ELSE '' END
       || CASE WHEN c0 = 1 THEN CAST(to_json(category) AS VARCHAR) || ':[' ELSE '' END || CAST(to_json(tag) AS VARCHAR)
       || CASE WHEN s1 = 1 AND source = top THEN ']}}' WHEN s1 = 1 THEN ']},' WHEN c1 = 1 THEN '],' ELSE ',' END AS value FROM k
""")
def q_vocab_json(spark, sf_dir):
    """S6 (+ A19): the vocabulary file of the brands, a line per tag in file order."""
    return pf.vocabulary_lines(pf.vocabulary_rows(suite._part_tags(spark, sf_dir), "p_brand", ["attribute", "object"]))


@register("speaker_summary", suite._PAIR_F1_SQL + """,
lc AS (SELECT conv_id, role, label, count(*) AS c FROM cr WHERE label IS NOT NULL GROUP BY conv_id, role, label),
m AS (SELECT conv_id, role, max(c) AS top, sum(c) AS tot FROM lc GROUP BY conv_id, role)
SELECT res.role, count(res.conv_id) AS n_convs, round(avg(m.top / m.tot), 6) AS mean_consistency, round(avg(res.mean_f1), 6) AS mean_f1
FROM res LEFT JOIN m ON res.conv_id = m.conv_id AND res.role = m.role GROUP BY res.role
""")
def q_speaker_summary(spark, sf_dir):
    """A26 (+ A24, A25): per role, its conversations and their mean label consistency and mean pairwise F1."""
    rows = suite._cons_rows(spark, sf_dir)
    lc = pf.label_consistency(rows, ["conv_id", "role"], "label")
    f1 = pf.pairwise_set_f1(rows, ["conv_id", "role"], "toks").drop("n_rows")
    out = pf.per_speaker_summary(lc.join(f1, ["conv_id", "role"]), "role", "conv_id")
    return out.select("role", "n_convs", r6(F.col("mean_consistency")).alias("mean_consistency"), r6(F.col("mean_f1")).alias("mean_f1"))


_WAVE = "list_transform(list_filter(string_split_regex({}, '[ \\n\\t]+'), lambda w: w <> ''), lambda w: length(w))"


def _wave(text):
    return F.transform(F.filter(F.split(text, r"[ \n\t]+"), lambda w: w != ""), lambda w: F.length(w).cast("float"))


@register("masked_targets", "WITH " + suite._UTT_SQL + "," + suite.chains_sql(3) + f"""
SELECT conv_id, anchor_turn, CAST(len({_WAVE.format('texts[1]')}) AS INT) AS first_length,
       CAST(len({_WAVE.format('texts[2]')}) AS INT) AS second_length,
       round(CAST(coalesce(list_sum({_WAVE.format('texts[1]')}), 0) + coalesce(list_sum({_WAVE.format('texts[2]')}), 0) AS DOUBLE), 6) AS heard,
       0 AS target_length, true AS target_text_only, CAST(length(texts[3]) AS INT) AS target_chars FROM chains
""")
def q_masked_targets(spark, sf_dir):
    """H21 (+ W8): every 3-turn chain with its turns' word lengths as signals, the target's signal masked, its text kept."""
    utt = suite._utterances(spark, sf_dir).withColumn("waveform", _wave(F.col("transcription")))
    utt = utt.withColumn("length", F.coalesce(F.size("waveform"), F.lit(0))).withColumn("text_only", F.col("length") == 0)
    chains = ch.build_chains(utt, 3, item_cols=("transcription", "text_description", "waveform", "length", "text_only"))
    c = chains.where(ch.has_valid_target("chain")).select("part_id", "anchor_turn", ch.mask_target("chain").alias("chain"))
    heard = F.aggregate("chain", F.lit(0.0), lambda a, u: a + F.aggregate(u["waveform"], F.lit(0.0), lambda b, x: b + x.cast("double")))
    last = F.element_at("chain", -1)
    return c.select(F.col("part_id").alias("conv_id"), "anchor_turn", F.col("chain")[0]["length"].alias("first_length"),
                    F.col("chain")[1]["length"].alias("second_length"), r6(heard).alias("heard"), last["length"].alias("target_length"),
                    last["text_only"].alias("target_text_only"), F.length(last["transcription"]).alias("target_chars"))


@register("hooked_signals", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, len(embedding) AS n FROM embeddings),
m AS (SELECT vec_id, n, list_transform(e, lambda x: CAST(CAST(x - list_avg(e) AS FLOAT) AS DOUBLE)) AS s FROM e)
SELECT vec_id, CAST(n AS INT) AS length, 128 AS padded, round(list_sum(s[1:128]), 4) + 0.0 AS total,
       round(CASE WHEN n < 128 THEN greatest(list_max(s), 0.0) ELSE list_max(s[1:128]) END, 6) AS top FROM m
""")
def q_hooked_signals(spark, sf_dir):
    """U2 (+ H13): a user's transform (the mean of the whole signal taken off) before signals are cut or padded to one length."""
    e = read_driver_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    mean = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size("embedding")
    e = e.withColumn("mean", mean)
    centred = sg.apply_transform(F.col("embedding"), lambda s: F.transform(s, lambda x: (x.cast("double") - F.col("mean")).cast("float")))
    p = e.select("vec_id", F.size("embedding").alias("length"), sg.pad_or_trim(centred, 128).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return p.select("vec_id", "length", F.size("s").alias("padded"), (F.round(total, 4) + 0.0).alias("total"), r6(F.array_max("s")).alias("top"))
