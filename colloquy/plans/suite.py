"""The registered query suite: library operators applied to the driver tables.

Each ``q_<name>(spark, sf_dir)`` returns a DataFrame; ``ORACLE_SQL[name]`` is
the same result written as plain SQL over the driver tables (DuckDB dialect).
Doubles are rounded to 6 places on both sides; every column is aliased.
Seeded choices use ``md5(concat_ws(':', seed, key...))`` on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import signal as sg
from colloquy.functions import text as tx
from colloquy.functions.tags import WORD
from colloquy.operators import chains as ch
from colloquy.operators import conversations as cv
from colloquy.operators import profile as pf
from colloquy.operators import runs as rn
from colloquy.operators import scoring as sc
from colloquy.operators import splits as sp
from colloquy.plans.topk import top_k_per_group
from colloquy.sources.audio import attach_features
from colloquy.sources.tables import read_driver_table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


def r6(c):
    return F.round(c.cast("double"), 6)


def _utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_driver_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return cv.utterances_from_turns(conv)


# SQL fragment: the same utterance view in DuckDB.
_UTT_SQL = """
utt AS (
  SELECT conv_id, conv_id AS part_id, turn AS turn_index, role AS speakerid, text AS transcription,
         text AS text_description,
         CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS relative_audio_path,
         CASE WHEN role = 'system' THEN -1 ELSE 0 END AS audio_idx
  FROM conversations),
utt2 AS (
  SELECT *, lag(relative_audio_path) OVER (PARTITION BY part_id ORDER BY turn_index) AS prev_filename FROM utt)
"""

_CHAINS_SQL = """
lk AS (
  SELECT *, coalesce(prev_filename = lag(relative_audio_path) OVER (PARTITION BY part_id ORDER BY turn_index), false)
         AS linked FROM utt2 WHERE audio_idx >= -1),
fr AS (
  SELECT *,
    count(*) OVER f AS n_in,
    min(CAST(linked AS INT)) OVER (PARTITION BY part_id ORDER BY turn_index ROWS BETWEEN {n2} PRECEDING AND CURRENT ROW) AS links_ok,
    first_value(prev_filename IS NULL OR linked) OVER f AS head_ok,
    max(CASE WHEN audio_idx = -1 THEN 1 ELSE 0 END) OVER f AS any_bad,
    list(speakerid) OVER f AS speakers,
    list(transcription) OVER f AS texts,
    CAST(sum(length(transcription)) OVER f AS BIGINT) AS chain_chars
  FROM lk WINDOW f AS (PARTITION BY part_id ORDER BY turn_index ROWS BETWEEN {n1} PRECEDING AND CURRENT ROW)),
chains AS (
  SELECT part_id AS conv_id, turn_index AS anchor_turn, speakerid AS anchor_role, speakers, texts, chain_chars,
         length(text_description) AS target_chars
  FROM fr
  WHERE audio_idx >= 0 AND turn_index >= {n1} AND n_in = {n} AND links_ok = 1 AND head_ok AND any_bad = 0
    AND text_description IS NOT NULL AND text_description <> '')
"""


def chains_sql(n: int) -> str:
    return _CHAINS_SQL.format(n=n, n1=n - 1, n2=max(n - 2, 0))


def conversation_chains(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    utt = _utterances(spark, sf_dir)
    chains = ch.build_chains(utt, n, keep_cols=["speakerid"])
    return chains.where(ch.has_valid_target("chain"))


# ---------------------------------------------------------------------------
# W8 + P14: the flagship chain query


@register("chains_n3", "WITH " + _UTT_SQL + "," + chains_sql(3) + """
SELECT conv_id, anchor_turn, anchor_role, array_to_string(speakers, '>') AS roles,
       chain_chars, target_chars FROM chains
""")
def q_chains_n3(spark, sf_dir):
    """W8 + P14: every valid 3-turn chain of the conversations, with roles and text lengths."""
    c = conversation_chains(spark, sf_dir, 3)
    return c.select(
        F.col("part_id").alias("conv_id"), "anchor_turn", F.col("speakerid").alias("anchor_role"),
        F.array_join(F.transform("chain", lambda u: u["speakerid"]), ">").alias("roles"),
        F.aggregate("chain", F.lit(0).cast("bigint"),
                    lambda acc, u: acc + F.length(u["transcription"])).alias("chain_chars"),
        F.length(F.element_at("chain", -1)["text_description"]).cast("bigint").alias("target_chars"))


@register("chain_summary", "WITH " + _UTT_SQL + "," + chains_sql(3) + """
SELECT anchor_role, CAST(count(*) AS BIGINT) AS n_chains, round(avg(chain_chars), 6) AS avg_chain_chars,
       CAST(max(target_chars) AS BIGINT) AS max_target_chars
FROM chains GROUP BY anchor_role
""")
def q_chain_summary(spark, sf_dir):
    """Flagship: 3-turn chains counted per anchor role with mean chain length."""
    return q_chains_n3(spark, sf_dir).groupBy("anchor_role").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_chains"),
        r6(F.avg("chain_chars")).alias("avg_chain_chars"),
        F.max("target_chars").cast("bigint").alias("max_target_chars"))


@register("chain_last2", "WITH " + _UTT_SQL + "," + chains_sql(5) + """
SELECT conv_id, anchor_turn, array_to_string(speakers[4:5], '>') AS last2_roles FROM chains
""")
def q_chain_last2(spark, sf_dir):
    """Last two turns of every 5-turn chain."""
    c = conversation_chains(spark, sf_dir, 5)
    return c.select(F.col("part_id").alias("conv_id"), "anchor_turn",
                    F.array_join(F.transform(ch.last_turns("chain", 2), lambda u: u["speakerid"]), ">")
                    .alias("last2_roles"))


@register("speaker_edges", "WITH " + _UTT_SQL + "," + chains_sql(3) + """,
pos AS (SELECT conv_id, anchor_turn, speakers, a_pos FROM chains, range(0, 3) t(a_pos)),
pairs AS (SELECT p.conv_id, p.anchor_turn, p.a_pos, b_pos,
                 CASE WHEN p.speakers[p.a_pos + 1] = p.speakers[b_pos + 1] THEN 'intra' ELSE 'inter' END AS edge
          FROM pos p, range(0, 3) t(b_pos) WHERE b_pos <= p.a_pos)
SELECT conv_id, anchor_turn, CAST(a_pos AS INT) AS a_pos, CAST(b_pos AS INT) AS b_pos, edge FROM pairs
UNION ALL
SELECT conv_id, anchor_turn, CAST(a_pos AS INT), CAST(a_pos AS INT), 'inter' FROM pos
""")
def q_speaker_edges(spark, sf_dir):
    """J11 over 3-turn chains."""
    c = conversation_chains(spark, sf_dir, 3).withColumnRenamed("part_id", "conv_id")
    return ch.speaker_edges(c, ["conv_id", "anchor_turn"]).select(
        "conv_id", "anchor_turn", F.col("a_pos").cast("int"), F.col("b_pos").cast("int"), "edge")


# ---------------------------------------------------------------------------
# Turn index and previous path


@register("conv_turn_links", """
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS turn_index,
       lag(CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR)) OVER (PARTITION BY conv_id ORDER BY turn)
         AS prev_filename
FROM conversations
""")
def q_conv_turn_links(spark, sf_dir):
    """W1 + W2: turn index and previous path per conversation, from a range-partitioned rank."""
    conv = read_driver_table(spark, sf_dir, "conversations", ["conv_id", "turn"])
    rows = conv.withColumn("relative_audio_path",
                           F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")))
    out = cv.assign_turns(rows, "conv_id", ["turn"])
    return out.select("conv_id", "turn", F.col("turn_index").cast("bigint"), "prev_filename")


# ---------------------------------------------------------------------------
# J1 + J2 + W3 + W4: gaps split conversations (a hash-chosen set of turns plays
# the "listed file without annotation" role)

_GAP = "substr(md5(concat_ws(':', 'gap', conv_id, turn)), 1, 1) = '0'"
_FAIL = "substr(md5(concat_ws(':', 'fail', conv_id, turn)), 1, 1) = '0'"


def _md5_flag(tag: str, *cols) -> F.Column:
    return F.substring(F.md5(F.concat_ws(":", F.lit(tag), *[F.col(c).cast("string") for c in cols])), 1, 1) == "0"


@register("conv_gap_split", """
WITH files AS (SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS path,
                      """ + _GAP + """ AS gone FROM conversations),
ann AS (SELECT * FROM files WHERE NOT gone),
missing AS (SELECT * FROM files WHERE gone AND conv_id IN (SELECT conv_id FROM ann)),
u AS (SELECT conv_id, CAST(turn AS DOUBLE) AS s, 1 AS kind, path FROM ann
      UNION ALL SELECT conv_id, CAST(turn AS DOUBLE), 0, '' FROM missing),
l AS (SELECT *, lag(kind) OVER (PARTITION BY conv_id ORDER BY s, kind, path) AS pk FROM u),
fl AS (SELECT conv_id, s, path, coalesce(pk = 0, false) AS is_split FROM l WHERE kind = 1),
k AS (SELECT *, sum(CAST(is_split AS INT)) OVER (PARTITION BY conv_id ORDER BY s, path
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM fl),
p AS (SELECT *, CAST(conv_id AS VARCHAR) || '_part' || CAST(part AS VARCHAR) AS conv_id_split FROM k)
SELECT conv_id, CAST(s AS BIGINT) AS turn, is_split, conv_id_split,
       CAST(row_number() OVER (PARTITION BY conv_id_split ORDER BY s, path) - 1 AS BIGINT) AS turn_index,
       lag(path) OVER (PARTITION BY conv_id_split ORDER BY s, path) AS prev_filename
FROM p
""")
def q_conv_gap_split(spark, sf_dir):
    """J1 + J2 + W3 + W4: hash-chosen turns act as unannotated files; conversations split at them."""
    conv = read_driver_table(spark, sf_dir, "conversations", ["conv_id", "turn"])
    files = conv.select("conv_id", "turn",
                        F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("path"),
                        _md5_flag("gap", "conv_id", "turn").alias("__gone"))
    ann = files.where(~F.col("__gone")).select(
        "conv_id", F.col("turn").cast("double").alias("start_time"), F.col("path").alias("relative_audio_path"),
        F.col("conv_id").alias("high_lvl_style"))
    missing = cv.find_missing(files.drop("__gone"), ann, file_path="path", file_style=F.col("conv_id"))
    mparts = missing.select("conv_id", F.col("turn").cast("double").alias("start_time"))
    split = cv.split_at_gaps(ann, mparts)
    return split.select("conv_id", F.col("start_time").cast("bigint").alias("turn"),
                        F.col("_is_split_point").alias("is_split"), "conv_id_split",
                        F.col("turn_index").cast("bigint"), "prev_filename")


# ---------------------------------------------------------------------------
# Failure propagation and the dense audio index

_FAIL_SQL = """
t AS (SELECT conv_id, turn, role = 'system' AS text_only,
             (""" + _FAIL + """) AND role <> 'system' AS fails FROM conversations),
ff AS (SELECT conv_id, min(turn) AS first_fail FROM t WHERE fails GROUP BY conv_id),
st AS (SELECT t.conv_id, t.turn,
              CASE WHEN text_only THEN -1 WHEN ff.first_fail IS NOT NULL AND t.turn >= ff.first_fail THEN -2
                   ELSE 0 END AS state,
              coalesce(fails AND t.turn = ff.first_fail, false) AS first_failure
       FROM t LEFT JOIN ff ON t.conv_id = ff.conv_id)
"""


def _failure_states(spark, sf_dir):
    conv = read_driver_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role"])
    out = cv.propagate_failures(conv, conv_col="conv_id", ord_col="turn",
                                text_only=F.col("role") == "system", fails=_md5_flag("fail", "conv_id", "turn"))
    return out.select("conv_id", "turn", F.col("state").cast("int"),
                      F.coalesce("first_failure", F.lit(False)).alias("first_failure"))


@register("failure_propagation", "WITH " + _FAIL_SQL + "SELECT conv_id, turn, state, first_failure FROM st")
def q_failure_propagation(spark, sf_dir):
    """System turns are text-only, hash-chosen turns fail; later audio turns are abandoned."""
    return _failure_states(spark, sf_dir)


@register("dense_index", "WITH " + _FAIL_SQL + """
SELECT conv_id, turn, CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT) AS audio_idx
FROM st WHERE state = 0
UNION ALL SELECT conv_id, turn, CAST(state AS BIGINT) FROM st WHERE state <> 0
""")
def q_dense_index(spark, sf_dir):
    """Dense global index over the successful rows in table order."""
    st = _failure_states(spark, sf_dir)
    return cv.dense_audio_index(st, ["conv_id", "turn"]).select("conv_id", "turn", "audio_idx")


@register("state_breakdown", "WITH " + _FAIL_SQL + """
SELECT CAST(count_if(state >= 0) AS BIGINT) AS n_audio, CAST(count_if(state = -1) AS BIGINT) AS n_text_only, CAST(count_if(state = -2) AS BIGINT) AS n_failed,
       count(*) AS n_rows FROM st
""")
def q_state_breakdown(spark, sf_dir):
    """A23."""
    return pf.state_breakdown(_failure_states(spark, sf_dir), "state")


# ---------------------------------------------------------------------------
# Conversation lengths

_LEN_SQL = """
l AS (SELECT conv_id, CAST(max(turn) + 1 AS BIGINT) AS conv_len,
             CAST(max(CASE WHEN role <> 'system' THEN turn END) + 1 AS BIGINT) AS audio_len
      FROM conversations GROUP BY conv_id)
"""


def _lengths(spark, sf_dir):
    conv = read_driver_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role"])
    return pf.conversation_lengths(conv, "conv_id", "turn", F.col("role") != "system")


@register("conv_lengths", "WITH " + _LEN_SQL + "SELECT conv_id, conv_len, audio_len FROM l")
def q_conv_lengths(spark, sf_dir):
    """Conversation length over all turns and over audio turns."""
    return _lengths(spark, sf_dir)


@register("conv_length_summary", "WITH " + _LEN_SQL + """
SELECT round(avg(conv_len), 6) AS mean, round(median(conv_len), 6) AS median, min(conv_len) AS min,
       max(conv_len) AS max, count(conv_len) AS count FROM l
""")
def q_conv_length_summary(spark, sf_dir):
    """Mean / exact median / min / max / count of conversation lengths."""
    s = pf.summary(_lengths(spark, sf_dir), "conv_len")
    return s.select(r6(F.col("mean")).alias("mean"), r6(F.col("median")).alias("median"),
                    F.col("min").cast("bigint").alias("min"), F.col("max").cast("bigint").alias("max"), "count")


@register("conv_length_hist", "WITH " + _LEN_SQL + """,
mm AS (SELECT min(conv_len) AS lo, max(conv_len) AS hi FROM l),
w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 10.0 ELSE 1.0 END AS width FROM mm),
b AS (SELECT CAST(least(floor((conv_len - lo) / width), 9) AS INT) AS bin FROM l, w),
c AS (SELECT bin, count(*) AS count FROM b GROUP BY bin),
d AS (SELECT CAST(r.range AS INT) AS bin, coalesce(c.count, 0) AS count FROM range(10) r LEFT JOIN c ON c.bin = r.range)
SELECT d.bin, CAST(d.count AS BIGINT) AS count, round(w.lo + d.bin * w.width, 6) AS lo,
       round(w.lo + (d.bin + 1) * w.width, 6) AS hi,
       CAST(sum(d.count) OVER (ORDER BY d.bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_count,
       round(sum(d.count) OVER (ORDER BY d.bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 100.0
             / (SELECT count(*) FROM l), 6) AS cum_pct
FROM d, w
""")
def q_conv_length_hist(spark, sf_dir):
    """A16 + W9: 10-bin length histogram with cumulative counts and percent."""
    h = pf.histogram_fixed(_lengths(spark, sf_dir), "conv_len", 10)
    c = pf.cumulative_share(h, ["bin"], "count", "cum")
    return c.select(F.col("bin").cast("int"), F.col("count").cast("bigint"), r6(F.col("lo")).alias("lo"),
                    r6(F.col("hi")).alias("hi"), F.col("cum_sum").cast("bigint").alias("cum_count"),
                    r6(F.col("cum_pct")).alias("cum_pct"))


LENGTH_EDGES = [0, 50, 100, 200, 400, 800, 1600, 100_000_000]


@register("length_edges", f"""
WITH e AS (SELECT unnest(range(7)) AS bin, unnest({LENGTH_EDGES[:-1]}) AS lo, unnest({LENGTH_EDGES[1:]}) AS hi)
SELECT CAST(e.bin AS INT) AS bin, CAST(e.lo AS DOUBLE) AS lo, CAST(e.hi AS DOUBLE) AS hi, count(d.n_chars) AS count
FROM e LEFT JOIN documents d ON d.n_chars >= e.lo AND (d.n_chars < e.hi OR (e.bin = 6 AND d.n_chars = e.hi))
GROUP BY ALL
""")
def q_length_edges(spark, sf_dir):
    """A16 with explicit edges: document lengths in doubling bins."""
    h = pf.histogram_edges(read_driver_table(spark, sf_dir, "documents", ["n_chars"]), "n_chars", LENGTH_EDGES)
    return h.select(F.col("bin").cast("int"), "lo", "hi", F.col("count").cast("bigint"))


# ---------------------------------------------------------------------------
# Dedup documents by text keeping the longest, duplicate report


@register("dedup_longest", """
SELECT doc_id, source, n_chars FROM (
  SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) AS rn
  FROM documents) WHERE rn = 1
""")
def q_dedup_longest(spark, sf_dir):
    """One document per text, the longest wins, the smallest id breaks ties."""
    docs = read_driver_table(spark, sf_dir, "documents", ["doc_id", "text", "source", "n_chars"])
    return cv.dedup_longest(docs, "text", F.col("n_chars"), "doc_id").select("doc_id", "source", "n_chars")


@register("dup_report", """
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS dup_rows, count(*) AS dup_keys
FROM (SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)
""")
def q_dup_report(spark, sf_dir):
    """Rows in duplicated texts and the number of such texts."""
    docs = read_driver_table(spark, sf_dir, "documents", ["text"])
    return cv.duplicate_report(docs, "text")


# ---------------------------------------------------------------------------
# Splits and sampling


_IDS_SQL = """
ids AS (SELECT DISTINCT conv_id FROM conversations),
sh AS (SELECT conv_id, CAST(row_number() OVER (ORDER BY md5(concat_ws(':', '{seed}', conv_id)), conv_id) - 1 AS BIGINT)
              AS pos FROM ids),
n AS (SELECT count(*) AS n FROM ids)
"""


def _conv_ids(spark, sf_dir):
    return read_driver_table(spark, sf_dir, "conversations", ["conv_id"])


@register("train_val", "WITH " + _IDS_SQL.format(seed=42) + """
SELECT conv_id, pos, CASE WHEN pos < CAST(floor(n * 0.9) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM sh, n
""")
def q_train_val(spark, sf_dir):
    """X1 + X2."""
    return sp.train_val_split(_conv_ids(spark, sf_dir), "conv_id", 0.1, 42)


@register("allowed_turns", "WITH " + _IDS_SQL.format(seed=42) + """
SELECT c.conv_id, c.turn, c.role FROM conversations c
WHERE c.conv_id IN (SELECT conv_id FROM sh, n WHERE pos < CAST(floor(n * 0.9) AS BIGINT))
""")
def q_allowed_turns(spark, sf_dir):
    """P10: the turns of the conversations that the training part allows."""
    train = sp.train_val_split(_conv_ids(spark, sf_dir), "conv_id", 0.1, 42).where("split = 'train'")
    return sp.keep_allowed(read_driver_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role"]), train, "conv_id")


@register("kfold", "WITH " + _IDS_SQL.format(seed=42) + """,
p AS (SELECT n // 5 AS q, n % 5 AS rem FROM n)
SELECT conv_id, pos, CAST(CASE WHEN pos < rem * (q + 1) THEN pos // (q + 1)
                             ELSE rem + (pos - rem * (q + 1)) // q END AS INT) AS fold FROM sh, p
""")
def q_kfold(spark, sf_dir):
    """X3 (5 folds, np.array_split sizes)."""
    return sp.k_folds(_conv_ids(spark, sf_dir), "conv_id", 5, 42)


@register("holdout", "WITH " + _IDS_SQL.format(seed=7) + """
SELECT conv_id, pos, CASE WHEN pos < greatest(1, CAST(floor(n * 0.1) AS BIGINT)) THEN 'test' ELSE 'pool' END AS split
FROM sh, n
""")
def q_holdout(spark, sf_dir):
    """10 % of conversations (at least one) held out."""
    return sp.holdout(_conv_ids(spark, sf_dir), "conv_id", 0.1, 7)


@register("leak_check", "WITH " + _IDS_SQL.format(seed=42) + """,
s AS (SELECT conv_id, CASE WHEN pos < CAST(floor(n * 0.9) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM sh, n)
SELECT count(*) AS n_overlap FROM (SELECT conv_id FROM s WHERE split = 'train'
                                   INTERSECT SELECT conv_id FROM s WHERE split = 'val')
""")
def q_leak_check(spark, sf_dir):
    """J7 / G4 on the train/val split."""
    tv = sp.train_val_split(_conv_ids(spark, sf_dir), "conv_id", 0.1, 42)
    return sp.leak_check(tv.where(F.col("split") == "train"), tv.where(F.col("split") == "val")).select("n_overlap")


_FIXED_SQL = "WITH " + _UTT_SQL + "," + chains_sql(5) + """,
ft AS (SELECT conv_id, anchor_turn,
              CAST(row_number() OVER (ORDER BY md5(concat_ws(':', '999', 'dialogue', conv_id, anchor_turn)),
                                      conv_id, anchor_turn) - 1 AS BIGINT) AS test_rank FROM chains)
"""


def _fixed_test(spark, sf_dir):
    c = conversation_chains(spark, sf_dir, sp.TEST_NUM_TURNS).withColumnRenamed("part_id", "conv_id")
    return sp.fixed_test_chains(c, key_cols=["conv_id", "anchor_turn"], num_turns=3)


@register("fixed_test", _FIXED_SQL + "SELECT conv_id, anchor_turn, test_rank, 3 AS n_turns FROM ft WHERE test_rank < 200")
def q_fixed_test(spark, sf_dir):
    """X4 + W13: up to 200 five-turn chains per source (seed 999), sliced to 3 turns."""
    return _fixed_test(spark, sf_dir).select("conv_id", "anchor_turn", "test_rank",
                                             F.size("chain").alias("n_turns"))


@register("train_pool", _FIXED_SQL + """
SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM ft WHERE test_rank < 200)
""")
def q_train_pool(spark, sf_dir):
    """X10 + J6: every conversation not used by the fixed test set."""
    test_ids = _fixed_test(spark, sf_dir).select("conv_id").distinct()
    return sp.train_pool(_conv_ids(spark, sf_dir), test_ids, "conv_id")


@register("fewshot_alloc", """
WITH d AS (SELECT doc_id, lower(coalesce(source, 'unknown')) AS src FROM documents),
c AS (SELECT src, count(*) AS n FROM d GROUP BY src),
t AS (SELECT src, n, sum(n) OVER () AS total, row_number() OVER (ORDER BY src DESC) = 1 AS is_last FROM c),
b AS (SELECT *, least(CAST(round_even(50.0 * n / total, 0) AS BIGINT), n) AS base FROM t),
a AS (SELECT src, CASE WHEN is_last THEN least(greatest(50 - coalesce(sum(base) OVER
          (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), n) ELSE base END AS alloc FROM b),
r AS (SELECT d.doc_id, d.src, a.alloc, row_number() OVER (PARTITION BY d.src ORDER BY
          md5(concat_ws(':', '42', d.src, d.doc_id)), d.doc_id) - 1 AS shot_rank FROM d JOIN a ON d.src = a.src)
SELECT doc_id, src AS source, CAST(shot_rank AS BIGINT) AS shot_rank FROM r WHERE shot_rank < alloc
""")
def q_fewshot_alloc(spark, sf_dir):
    """50 few-shot documents, proportional to sources."""
    docs = read_driver_table(spark, sf_dir, "documents", ["doc_id", "source"])
    out = sp.proportional_few_shot(docs, 50, source_col="source", key_cols=["doc_id"], seed=42)
    return out.select("doc_id", F.lower(F.coalesce(F.col("source"), F.lit("unknown"))).alias("source"), "shot_rank")


@register("balance_majority", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws(':', '42', doc_id)), doc_id) AS rn
           FROM documents WHERE lang = 'en')
SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM r WHERE rn <= 100)
""")
def q_balance_majority(spark, sf_dir):
    """X9 + P13: remove 100 seeded English documents."""
    docs = read_driver_table(spark, sf_dir, "documents", ["doc_id", "lang", "source"])
    return sp.balance_majority(docs, {"lang": "en"}, 100, "doc_id", 42).select("doc_id", "lang", "source")


@register("sample_conversations", """
WITH p AS (SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS path FROM conversations
           WHERE turn <= 3),
a AS (SELECT conv_id FROM (SELECT conv_id, row_number() OVER (ORDER BY md5('42:' || path), path) AS rn
                           FROM p WHERE turn = 3) WHERE rn <= 7)
SELECT conv_id, turn FROM p WHERE conv_id IN (SELECT conv_id FROM a)
""")
def q_sample_conversations(spark, sf_dir):
    """X8 + F5: at most 30 rows of 4-turn conversations (rounded down to 28 = 7
    conversations), anchored at turn 3 and walked back through the links."""
    utt = _utterances(spark, sf_dir).where(F.col("turn_index") <= 3)
    s = sp.sample_conversations(utt, max_rows=30, max_turns=4, shares={"dialogue": 1.0})
    return s.select("conv_id", F.col("turn_index").alias("turn"))


# ---------------------------------------------------------------------------
# profiling aggregates over documents / labels / conversations



def _docs(spark, sf_dir, cols=("doc_id", "text", "lang", "source", "n_chars")):
    return read_driver_table(spark, sf_dir, "documents", list(cols))


@register("total_hours", "SELECT round(sum(n_chars) / 3600.0, 6) AS hours FROM documents")
def q_total_hours(spark, sf_dir):
    """A1 (``n_chars`` plays the duration in seconds)."""
    return pf.total_hours(_docs(spark, sf_dir, ["n_chars"]), "n_chars").select(r6(F.col("hours")).alias("hours"))


@register("hours_by_source", "SELECT source, round(sum(n_chars) / 3600.0, 6) AS hours FROM documents GROUP BY source")
def q_hours_by_source(spark, sf_dir):
    """A2."""
    return pf.total_hours(_docs(spark, sf_dir, ["source", "n_chars"]), "n_chars", ["source"]) \
        .select("source", r6(F.col("hours")).alias("hours"))


@register("lang_counts", "SELECT lang, count(*) AS count FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def q_lang_counts(spark, sf_dir):
    """A3 (NULLs dropped)."""
    return pf.value_counts(_docs(spark, sf_dir, ["lang"]), "lang")


_LABEL_CAT_SQL = """
j AS (SELECT d.source, CASE WHEN l.quality = 1 AND l.toxic = 1 THEN 'both' WHEN l.quality = 1 THEN 'quality_only'
                            WHEN l.toxic = 1 THEN 'toxic_only' ELSE 'neither' END AS cat
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""


@register("label_pivot", "WITH " + _LABEL_CAT_SQL + """
SELECT source, CAST(count_if(cat = 'both') AS BIGINT) AS both, CAST(count_if(cat = 'quality_only') AS BIGINT) AS quality_only,
       CAST(count_if(cat = 'toxic_only') AS BIGINT) AS toxic_only, CAST(count_if(cat = 'neither') AS BIGINT) AS neither
FROM j GROUP BY source
""")
def q_label_pivot(spark, sf_dir):
    """A4 + P12: documents x labels, category counts pivoted by source."""
    docs = _docs(spark, sf_dir, ["doc_id", "source"])
    labels = read_driver_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    cats = ("both", "quality_only", "toxic_only", "neither")
    j = docs.join(labels, "doc_id").withColumn(
        "cat", pf.tag_category(F.col("quality") == 1, F.col("toxic") == 1, cats))
    p = pf.pivot_counts(j, "source", "cat", ["both", "quality_only", "toxic_only", "neither"])
    return p.select("source", *[F.col(c).cast("bigint").alias(c) for c in ["both", "quality_only", "toxic_only", "neither"]])


@register("hours_pivot", """
SELECT source, round(coalesce(sum(n_chars) FILTER (WHERE lang = 'de'), 0) / 3600.0, 6) AS de,
       round(coalesce(sum(n_chars) FILTER (WHERE lang = 'en'), 0) / 3600.0, 6) AS en,
       round(coalesce(sum(n_chars) FILTER (WHERE lang = 'es'), 0) / 3600.0, 6) AS es,
       round(coalesce(sum(n_chars) FILTER (WHERE lang = 'fr'), 0) / 3600.0, 6) AS fr,
       round(coalesce(sum(n_chars) FILTER (WHERE coalesce(lang, '') NOT IN ('de', 'en', 'es', 'fr')), 0) / 3600.0, 6) AS other
FROM documents GROUP BY source
""")
def q_hours_pivot(spark, sf_dir):
    """A5: hours pivoted source x language; languages without a column, and NULL, are ``other``."""
    langs = ["de", "en", "es", "fr"]
    docs = _docs(spark, sf_dir, ["source", "lang", "n_chars"]) \
        .withColumn("lang", F.when(F.col("lang").isin(langs), F.col("lang")).otherwise("other"))
    p = pf.pivot_hours(docs, "source", "lang", "n_chars", [*langs, "other"])
    return p.select("source", *[r6(F.col(c)).alias(c) for c in [*langs, "other"]])


@register("length_lang_crosstab", """
WITH b AS (SELECT CAST(floor(log10(greatest(n_chars, 1))) AS INT) AS len_bin, lang FROM documents),
dom AS (SELECT unnest(range(0, (SELECT max(len_bin) + 1 FROM b)))::INT AS len_bin),
c AS (SELECT len_bin, CAST(count_if(lang = 'en') AS BIGINT) AS en, CAST(count_if(lang = 'de') AS BIGINT) AS de,
             CAST(count_if(coalesce(lang, '') NOT IN ('en', 'de')) AS BIGINT) AS other FROM b GROUP BY len_bin)
SELECT dom.len_bin, coalesce(c.en, 0) AS en, coalesce(c.de, 0) AS de, coalesce(c.other, 0) AS other FROM dom LEFT JOIN c ON dom.len_bin = c.len_bin
""")
def q_length_lang_crosstab(spark, sf_dir):
    """A6 + J12: every length bin up to the longest x two forced languages and the rest."""
    d = _docs(spark, sf_dir, ["n_chars", "lang"]).select(
        F.floor(F.log10(F.greatest("n_chars", F.lit(1)))).cast("int").alias("len_bin"),
        F.when(F.col("lang").isin("en", "de"), F.col("lang")).otherwise("other").alias("lang"))
    dom = d.agg(F.max("len_bin").alias("top")).where("top is not null") \
        .select(F.explode(F.sequence(F.lit(0), F.col("top"))).alias("len_bin"))
    x = pf.crosstab_forced(d, "len_bin", "lang", dom, ["en", "de", "other"])
    return x.select("len_bin", *[F.col(c).cast("bigint").alias(c) for c in ["en", "de", "other"]])


def _turn_pairs(spark, sf_dir):
    """Consecutive turns ``(curr, res)`` by an equi-join on ``(conv_id, turn + 1)``."""
    conv = read_driver_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    a = conv.select("conv_id", "turn", F.col("role").alias("curr_role"), F.col("text").alias("pred"))
    b = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("res_role"),
                    F.col("text").alias("ref"))
    # as many tasks as shuffle partitions: scoring a pair costs far more than moving it
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return a.join(b, ["conv_id", "turn"], "inner").repartition(n, "conv_id", "turn")


_PAIRS_SQL = """
pr AS (SELECT a.conv_id, a.turn, a.role AS curr_role, b.role AS res_role, a.text AS pred, b.text AS ref
       FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
"""


@register("role_transitions", "WITH " + _PAIRS_SQL + """
SELECT curr_role, res_role, count(*) AS count FROM pr GROUP BY curr_role, res_role
""")
def q_role_transitions(spark, sf_dir):
    """Response role given the current role."""
    return pf.crosstab(_turn_pairs(spark, sf_dir), "curr_role", "res_role")


@register("role_dist", "WITH " + _PAIRS_SQL + """,
s AS (SELECT curr_role AS label, 'curr' AS side FROM pr UNION ALL SELECT res_role, 'res' FROM pr)
SELECT label, CAST(count_if(side = 'curr') AS BIGINT) AS curr, CAST(count_if(side = 'res') AS BIGINT) AS res FROM s GROUP BY label
""")
def q_role_dist(spark, sf_dir):
    """Current and response role distributions on the label union."""
    x = pf.side_by_side(_turn_pairs(spark, sf_dir), "curr_role", "res_role")
    return x.select("label", F.col("curr").cast("bigint").alias("curr"), F.col("res").cast("bigint").alias("res"))


_TOK_SQL = r"""
tk AS (SELECT doc_id, lang, len(list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda t: t <> '')) AS n_tokens
       FROM documents)
"""


def _doc_tokens(spark, sf_dir):
    d = _docs(spark, sf_dir, ["doc_id", "lang", "text"])
    return d.select("doc_id", "lang", sc.ws_token_count("text").cast("bigint").alias("n_tokens"))


@register("length_percentiles", "WITH " + _TOK_SQL + """,
q AS (SELECT quantile_cont(n_tokens, [0.5, 0.75, 0.9, 0.95, 0.99, 1.0]) AS v FROM tk)
SELECT CAST(p AS DOUBLE) AS pct, round(v[i], 6) AS value
FROM q, (VALUES (1, 50), (2, 75), (3, 90), (4, 95), (5, 99), (6, 100)) t(i, p)
""")
def q_length_percentiles(spark, sf_dir):
    """A9 + A34: exact percentiles of whitespace token counts (whole texts)."""
    p = pf.exact_percentiles(_doc_tokens(spark, sf_dir), "n_tokens", [50, 75, 90, 95, 99, 100])
    return p.select("pct", r6(F.col("value")).alias("value"))


@register("cutoff_share", "WITH " + _TOK_SQL + """
SELECT CAST(c AS DOUBLE) AS cutoff, CAST(count_if(n_tokens > c) AS BIGINT) AS n_above,
       round(CAST(count_if(n_tokens > c) AS BIGINT) * 100.0 / count(*), 6) AS pct_above
FROM tk, (VALUES (100), (500), (1000), (5000)) v(c) GROUP BY c
""")
def q_cutoff_share(spark, sf_dir):
    """Documents above each token cutoff."""
    c = pf.cutoff_shares(_doc_tokens(spark, sf_dir), "n_tokens", [100, 500, 1000, 5000])
    return c.select("cutoff", "n_above", r6(F.col("pct_above")).alias("pct_above"))


@register("token_hist_by_lang", "WITH " + _TOK_SQL + """,
b AS (SELECT lang, CAST(CASE WHEN n_tokens < 100 THEN 0 WHEN n_tokens < 1000 THEN 1 ELSE 2 END AS INT) AS bin FROM tk),
c AS (SELECT lang, bin, count(*) AS count FROM b GROUP BY lang, bin)
SELECT lang, bin, count, round(count * 100.0 / sum(count) OVER (PARTITION BY lang), 6) AS pct FROM c
""")
def q_token_hist_by_lang(spark, sf_dir):
    """A16 (explicit edges) + A17: token-count histogram as percent within language."""
    t = _doc_tokens(spark, sf_dir)
    b = t.select("lang", F.when(F.col("n_tokens") < 100, 0).when(F.col("n_tokens") < 1000, 1).otherwise(2)
                 .cast("int").alias("bin"))
    c = b.groupBy("lang", "bin").agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    return pf.percent_within(c, ["lang"]).select("lang", "bin", "count", r6(F.col("pct")).alias("pct"))


@register("describe_lengths", """
SELECT count(n_chars) AS count, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std,
       min(n_chars) AS min, round(quantile_cont(n_chars, 0.25), 6) AS p25, round(quantile_cont(n_chars, 0.5), 6) AS p50,
       round(quantile_cont(n_chars, 0.75), 6) AS p75, max(n_chars) AS max FROM documents
""")
def q_describe_lengths(spark, sf_dir):
    """A15."""
    d = pf.describe(_docs(spark, sf_dir, ["n_chars"]), "n_chars")
    return d.select("count", *[r6(F.col(c)).alias(c) for c in ["mean", "std", "p25", "p50", "p75"]],
                    F.col("min").cast("bigint").alias("min"), F.col("max").cast("bigint").alias("max"))


@register("distinct_counts", """
SELECT count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs, count(DISTINCT text) AS n_texts
FROM documents
""")
def q_distinct_counts(spark, sf_dir):
    """A13."""
    d = _docs(spark, sf_dir, ["source", "lang", "text"])
    return d.agg(F.countDistinct("source").alias("n_sources"), F.countDistinct("lang").alias("n_langs"),
                 F.countDistinct(F.sha2("text", 256)).alias("n_texts"))     # digests, not texts, are shuffled


@register("label_domain", "SELECT lang AS label FROM documents UNION SELECT role FROM conversations")
def q_label_domain(spark, sf_dir):
    """A36 + G5: union of two label domains, distinct."""
    a = _docs(spark, sf_dir, ["lang"]).select(F.col("lang").alias("label"))
    b = read_driver_table(spark, sf_dir, "conversations", ["role"]).select(F.col("role").alias("label"))
    return a.union(b).distinct()


@register("null_label_report", """
SELECT d.source, count(*) AS n_null FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS NULL GROUP BY d.source
""")
def q_null_label_report(spark, sf_dir):
    """Documents without a quality label, per source."""
    docs = _docs(spark, sf_dir, ["doc_id", "source"])
    labels = read_driver_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    return pf.null_target_report(docs.join(labels, "doc_id", "left"), "quality", "source")


# tags from part names: first word = attribute, last word = object

_PART_TAGS_SQL = r"""
pt AS (SELECT p_partkey, p_brand, regexp_extract_all(lower(p_name), '[\pL\pN_]+') AS w FROM part),
tg AS (SELECT p_partkey, p_brand, w[1:len(w) - 1] AS attribute, w[len(w):len(w)] AS object FROM pt)
"""


def _part_tags(spark, sf_dir):
    part = read_driver_table(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_name"])
    w = F.regexp_extract_all(F.lower("p_name"), F.lit(WORD), 0)
    return part.select("p_partkey", "p_brand", w.alias("__w")).select(
        "p_partkey", "p_brand", F.slice("__w", 1, F.size("__w") - 1).alias("attribute"),
        F.slice("__w", -1, 1).alias("object"))


@register("vocab", "WITH " + _PART_TAGS_SQL + """,
u AS (SELECT p_brand AS source, 'attribute' AS category, unnest(attribute) AS tag FROM tg
      UNION ALL SELECT p_brand, 'object', unnest(object) FROM tg)
SELECT source, category, array_to_string(list_sort(list_distinct(list(tag))), ',') AS tags
FROM u WHERE tag IS NOT NULL GROUP BY source, category
""")
def q_vocab(spark, sf_dir):
    """Sorted distinct tags per source (brand) and category."""
    v = pf.vocabulary(_part_tags(spark, sf_dir), "p_brand", ["attribute", "object"])
    return v.select("source", "category", F.array_join("tags", ",").alias("tags"))


@register("tag_freq", "WITH " + _PART_TAGS_SQL + """,
u AS (SELECT unnest(attribute || object) AS tag FROM tg),
c AS (SELECT tag, count(*) AS count FROM u WHERE tag IS NOT NULL GROUP BY tag)
SELECT tag, count, round(count * 100.0 / sum(count) OVER (), 6) AS pct FROM c
""")
def q_tag_freq(spark, sf_dir):
    """Tag frequency and percent of all tags."""
    t = _part_tags(spark, sf_dir).select(F.concat("attribute", "object").alias("tags"))
    return pf.tag_frequency(t, "tags").select("tag", "count", r6(F.col("pct")).alias("pct"))


@register("tag_cooc", "WITH " + _PART_TAGS_SQL + """,
r AS (SELECT attribute || object AS t FROM tg WHERE len(attribute || object) >= 2),
pr AS (SELECT least(t[i], t[j]) AS tag_a, greatest(t[i], t[j]) AS tag_b
       FROM (SELECT t, i, unnest(generate_series(1, len(t))) AS j FROM (SELECT t, unnest(generate_series(1, len(t))) AS i FROM r)) WHERE i < j)
SELECT tag_a, tag_b, count(*) AS count, tag_a = tag_b AS self_pair FROM pr GROUP BY tag_a, tag_b
""")
def q_tag_cooc(spark, sf_dir):
    """Canonical tag co-occurrence counts."""
    return pf.tag_cooccurrence(_part_tags(spark, sf_dir), "attribute", "object")


# consistency inside (speaker, conversation) groups: role = speaker

_CONS_SQL = r"""
cr AS (SELECT conv_id, role, turn, CASE WHEN length(text) < 200 THEN 'short' WHEN length(text) < 800 THEN 'medium'
                                       ELSE 'long' END AS label,
              list_distinct(regexp_extract_all(lower(text), '[\pL\pN_]+')) AS toks FROM conversations)
"""


def _cons_rows(spark, sf_dir):
    conv = read_driver_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return conv.select("conv_id", "role", "turn",
                       F.when(F.length("text") < 200, "short").when(F.length("text") < 800, "medium")
                       .otherwise("long").alias("label"),
                       F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0).alias("toks"))


@register("label_consistency", "WITH " + _CONS_SQL + """,
g AS (SELECT conv_id, role, count(*) AS n_rows FROM cr GROUP BY conv_id, role HAVING count(*) >= 2),
lc AS (SELECT conv_id, role, label, count(*) AS c FROM cr WHERE label IS NOT NULL GROUP BY conv_id, role, label),
m AS (SELECT conv_id, role, max(c) AS top, sum(c) AS tot FROM lc GROUP BY conv_id, role)
SELECT g.conv_id, g.role, g.n_rows, round(m.top / m.tot, 6) AS consistency, m.top = m.tot AS unanimous
FROM g LEFT JOIN m ON g.conv_id = m.conv_id AND g.role = m.role
""")
def q_label_consistency(spark, sf_dir):
    """Majority-label share per (conversation, role)."""
    lc = pf.label_consistency(_cons_rows(spark, sf_dir), ["conv_id", "role"], "label")
    return lc.select("conv_id", "role", "n_rows", r6(F.col("consistency")).alias("consistency"), "unanimous")


_PAIR_F1_SQL = "WITH " + _CONS_SQL + """,
g AS (SELECT conv_id, role, count(*) AS n_rows FROM cr GROUP BY conv_id, role HAVING count(*) >= 2),
pf AS (SELECT a.conv_id, a.role,
              CASE WHEN len(a.toks) = 0 AND len(b.toks) = 0 THEN NULL
                   WHEN len(a.toks) = 0 OR len(b.toks) = 0 THEN 0.0
                   ELSE 2.0 * len(list_intersect(a.toks, b.toks)) / (len(a.toks) + len(b.toks)) END AS f1
       FROM cr a JOIN cr b ON a.conv_id = b.conv_id AND a.role = b.role AND a.turn < b.turn),
res AS (SELECT g.conv_id, g.role, g.n_rows, avg(pf.f1) AS mean_f1 FROM g LEFT JOIN pf
        ON g.conv_id = pf.conv_id AND g.role = pf.role GROUP BY g.conv_id, g.role, g.n_rows)
"""


def _pair_f1(spark, sf_dir):
    return pf.pairwise_set_f1(_cons_rows(spark, sf_dir), ["conv_id", "role"], "toks")


@register("pairwise_f1", _PAIR_F1_SQL + "SELECT conv_id, role, n_rows, round(mean_f1, 6) AS mean_f1 FROM res")
def q_pairwise_f1(spark, sf_dir):
    """A25 (+ J10, H6) without forming row pairs (token / set-size algebra)."""
    return _pair_f1(spark, sf_dir).select("conv_id", "role", "n_rows", r6(F.col("mean_f1")).alias("mean_f1"))


@register("consistency_summary", _PAIR_F1_SQL + """
SELECT round(avg(mean_f1), 6) AS mean, round(median(mean_f1), 6) AS median, round(stddev_samp(mean_f1), 6) AS std,
       CAST(count_if(mean_f1 = 1.0) AS BIGINT) AS n_perfect, count(mean_f1) AS n_valid FROM res
""")
def q_consistency_summary(spark, sf_dir):
    """A26."""
    s = pf.consistency_summary(_pair_f1(spark, sf_dir))
    return s.select(*[r6(F.col(c)).alias(c) for c in ["mean", "median", "std"]], "n_perfect", "n_valid")


@register("url_hosts", """
SELECT split_part(url, '/', 3) AS host, count(*) AS count FROM pages
WHERE len(string_split(url, '/')) >= 3 GROUP BY host
""")
def q_url_hosts(spark, sf_dir):
    """Third path component (host) of page URLs, counted."""
    pages = read_driver_table(spark, sf_dir, "pages", ["url"])
    h = pages.select(pf.nth_path_component("url", 2).alias("host")).where(F.col("host").isNotNull())
    return pf.value_counts(h, "host")


@register("page_dedup", "SELECT count(*) AS n_pages, count(DISTINCT url) AS n_unique FROM pages")
def q_page_dedup(spark, sf_dir):
    """Drop exact repeats of a key list (url)."""
    pages = read_driver_table(spark, sf_dir, "pages", ["page_id", "url"])
    uniq = pages.dropDuplicates(["url"])
    rows = pages.select(F.lit(False).alias("__u")).unionByName(uniq.select(F.lit(True).alias("__u")))
    return rows.agg(F.count_if(~F.col("__u")).cast("bigint").alias("n_pages"),
                    F.count_if(F.col("__u")).cast("bigint").alias("n_unique"))


# ---------------------------------------------------------------------------
# scoring


_SQL_PUNCT = sc.PUNCTUATION.replace("'", "''")


def _part_pairs(spark, sf_dir):
    """(pred, ref) = names of consecutive parts (equi-join on ``partkey + 1``)."""
    part = read_driver_table(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_name"])
    a = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("source"), F.col("p_name").alias("pred"))
    b = part.select((F.col("p_partkey") - 1).alias("id"), F.col("p_name").alias("ref"))
    return a.join(b, "id", "inner")


@register("tag_f1", "WITH " + _PART_TAGS_SQL + r""",
voc AS (SELECT 'attribute' AS category, unnest(attribute) AS tag FROM tg UNION SELECT 'object', unnest(object) FROM tg),
vl AS (SELECT category, list(DISTINCT tag) AS tags FROM voc GROUP BY category
       UNION ALL SELECT 'overall', list(DISTINCT tag) FROM voc),
pr AS (SELECT a.p_brand AS source, regexp_extract_all(lower(a.p_name), '[\pL\pN_]+') AS pw,
              regexp_extract_all(lower(b.p_name), '[\pL\pN_]+') AS rw
       FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
s AS (SELECT pr.source, vl.category, list_distinct(list_intersect(pw, vl.tags)) AS P,
             list_distinct(list_intersect(rw, vl.tags)) AS R FROM pr, vl),
t AS (SELECT source, category, len(P) AS np, len(R) AS nr, len(list_intersect(P, R)) AS tp FROM s),
f AS (SELECT source, category, CASE WHEN np = 0 AND nr = 0 THEN 1.0 WHEN np = 0 OR nr = 0 THEN 0.0 WHEN tp = 0 THEN 0.0
             ELSE 2.0 * (tp / np) * (tp / nr) / ((tp / np) + (tp / nr)) END AS f1 FROM t)
SELECT source, category, round(avg(f1), 6) AS tag_f1_mean, round(stddev_pop(f1), 6) AS tag_f1_std
FROM f GROUP BY source, category
""")
def q_tag_f1(spark, sf_dir):
    """T1 (+ H7, H8): tag-F1 per category and overall, vocabulary built by A19."""
    voc = pf.vocabulary_rows(_part_tags(spark, sf_dir), "p_brand", ["attribute", "object"]).select("category", "tag").distinct()
    out = sc.tag_f1(_part_pairs(spark, sf_dir), voc, id_col="id", group_col="source")
    return out.select("source", "category", r6(F.col("tag_f1_mean")).alias("tag_f1_mean"),
                      r6(F.col("tag_f1_std")).alias("tag_f1_std"))


_DIST_SQL = r"""
tt AS (SELECT role, list_filter(regexp_split_to_array(lower(text), '[\s\p{Z}]+'), lambda x: x <> '') AS t
       FROM conversations),
uni AS (SELECT role, unnest(t) AS g FROM tt),
bi AS (SELECT role, unnest(list_transform(range(1, len(t)), lambda i: t[i] || chr(1) || t[i + 1])) AS g FROM tt),
dn AS (SELECT r.role, coalesce((SELECT count(DISTINCT g) * 1.0 / count(g) FROM uni WHERE uni.role = r.role), 0.0) AS dist1,
              coalesce((SELECT count(DISTINCT g) * 1.0 / nullif(count(g), 0) FROM bi WHERE bi.role = r.role), 0.0) AS dist2
       FROM (SELECT DISTINCT role FROM conversations) r)
"""


@register("dist_n", "WITH " + _DIST_SQL + "SELECT role, round(dist1, 6) AS dist1, round(dist2, 6) AS dist2 FROM dn")
def q_dist_n(spark, sf_dir):
    """T5: Dist-1 / Dist-2 of turn texts per role."""
    conv = read_driver_table(spark, sf_dir, "conversations", ["role", "text"])
    d = sc.dist_n(conv, "role", "text")
    return d.select("role", r6(F.col("dist1")).alias("dist1"), r6(F.col("dist2")).alias("dist2"))


_CHRF_SQL = "WITH " + _PAIRS_SQL + r""",
side AS (SELECT conv_id, turn, 1 AS sd, pred AS txt FROM pr UNION ALL SELECT conv_id, turn, 2, ref FROM pr),
cs AS (SELECT conv_id, turn, sd, regexp_replace(txt, '[\s\p{Z}]+', '', 'g') AS s FROM side),
cg AS (SELECT conv_id, turn, sd, k AS o, substring(s, i, k) AS g
       FROM cs, range(1, 7) kk(k), LATERAL (SELECT unnest(generate_series(1, length(s) - k + 1)) AS i) WHERE length(s) >= k),
wt AS (SELECT conv_id, turn, sd, unnest(list_filter(regexp_split_to_array(txt, '[\s\p{Z}]+'), lambda x: x <> '')) AS w
       FROM side),
wt2 AS (SELECT conv_id, turn, sd, list(p ORDER BY pos) AS toks FROM (
          SELECT conv_id, turn, sd, row_number() OVER () AS pos0, w,
                 CASE WHEN length(w) = 1 THEN [w]
                      WHEN contains('{P}', right(w, 1)) THEN [left(w, length(w) - 1), right(w, 1)]
                      WHEN contains('{P}', left(w, 1)) THEN [left(w, 1), substring(w, 2)]
                      ELSE [w] END AS parts FROM wt) x, LATERAL (SELECT unnest(parts) AS p,
                      pos0 * 10 + generate_subscripts(parts, 1) AS pos)
        GROUP BY conv_id, turn, sd),
wg AS (SELECT conv_id, turn, sd, 100 + k AS o, array_to_string(toks[i:i + k - 1], ' ') AS g
       FROM wt2, range(1, 3) kk(k), LATERAL (SELECT unnest(generate_series(1, len(toks) - k + 1)) AS i)
       WHERE len(toks) >= k),
allg AS (SELECT * FROM cg UNION ALL SELECT * FROM wg),
cnt AS (SELECT conv_id, turn, o, g, CAST(count_if(sd = 1) AS BIGINT) AS cp, CAST(count_if(sd = 2) AS BIGINT) AS cr FROM allg GROUP BY ALL),
po AS (SELECT conv_id, turn, o, sum(cp) AS np, sum(cr) AS nr, sum(least(cp, cr)) AS m FROM cnt GROUP BY ALL),
av AS (SELECT conv_id, turn, avg(m / np) AS P, avg(m / nr) AS R FROM po WHERE np > 0 AND nr > 0 GROUP BY ALL),
ch AS (SELECT pr.conv_id, pr.turn, pr.curr_role, CASE WHEN coalesce(P + R, 0) > 0 THEN 5 * P * R / (4 * P + R) ELSE 0.0 END AS chrf
       FROM pr LEFT JOIN av ON pr.conv_id = av.conv_id AND pr.turn = av.turn)
""".replace("{P}", _SQL_PUNCT)


def _chrf_rows(spark, sf_dir):
    pairs = _turn_pairs(spark, sf_dir).withColumn("id", F.concat_ws(":", F.col("conv_id").cast("string"),
                                                                    F.col("turn").cast("string")))
    return sc.chrf(pairs, "id", "pred", "ref")


@register("chrf", _CHRF_SQL + "SELECT conv_id, turn, round(chrf, 6) AS chrf FROM ch")
def q_chrf(spark, sf_dir):
    """Sentence chrF++ of each turn against the next one."""
    return _chrf_rows(spark, sf_dir).select("conv_id", "turn", r6(F.col("chrf")).alias("chrf"))


# the longest common subsequence row by row: a word's matches raise the row behind them, and a running maximum carries it on
_ROUGE_SQL = """
rt AS (SELECT *, list_filter(string_split(regexp_replace(lower(pred), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS a,
              list_filter(string_split(regexp_replace(lower(ref), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS b FROM pr),
lc AS (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE list_max(list_reduce(
              list_prepend(list_transform(b, lambda y: 0), list_transform(a, lambda x: list_transform(b, lambda y: CASE WHEN x = y THEN 1 ELSE 0 END))),
              lambda row, hit: list_transform(range(1, len(row) + 1), lambda j: greatest(list_max(row[1:j]), coalesce(list_max(list_transform(
                  range(1, j + 1), lambda i: CASE WHEN hit[i] = 1 THEN 1 + CASE WHEN i > 1 THEN list_max(row[1:i - 1]) ELSE 0 END ELSE 0 END)), 0))))) END AS l
       FROM rt),
rl AS (SELECT conv_id, turn, curr_role, CASE WHEN l = 0 THEN 0.0 ELSE 2.0 * (l / len(a)) * (l / len(b)) / (l / len(a) + l / len(b)) END AS rouge_l
       FROM lc)
"""


@register("rouge_l", "WITH " + _PAIRS_SQL + "," + _ROUGE_SQL + "SELECT conv_id, turn, round(rouge_l, 6) AS rouge_l FROM rl")
def q_rouge_l(spark, sf_dir):
    """ROUGE-L F of each turn against the next one."""
    out = sc.rouge_l(_turn_pairs(spark, sf_dir))
    return out.select("conv_id", "turn", r6(F.col("rouge_l")).alias("rouge_l"))


@register("score_report", _CHRF_SQL + "," + _DIST_SQL + """,
m AS (SELECT curr_role AS source, 'chrf' AS metric, avg(chrf) AS value FROM ch GROUP BY curr_role
      UNION ALL SELECT curr_role, 'chrf_std', stddev_pop(chrf) FROM ch GROUP BY curr_role
      UNION ALL SELECT role, 'dist1', dist1 FROM dn UNION ALL SELECT role, 'dist2', dist2 FROM dn)
SELECT source, source || '/' || metric AS metric, round(value, 6) AS value FROM m
""")
def q_score_report(spark, sf_dir):
    """T6 (+ P22): per-source metric report as long rows ``source/metric``."""
    ch_rows = _chrf_rows(spark, sf_dir).withColumnRenamed("curr_role", "source")
    cm = ch_rows.groupBy("source").agg(F.avg("chrf").alias("chrf_mean"), F.stddev_pop("chrf").alias("chrf_std"))
    conv = read_driver_table(spark, sf_dir, "conversations", ["role", "text"]).withColumnRenamed("role", "source")
    dn = sc.dist_n(conv, "source", "text")
    rep = sc.score_report([cm, dn], "source")
    return rep.select("source", "metric", r6(F.col("value")).alias("value"))


@register("vec_collapse", """
WITH e AS (SELECT label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS nrm
           FROM embeddings),
d AS (SELECT label, nrm, unnest(embedding)::DOUBLE AS x, unnest(generate_series(1, len(embedding))) AS dim FROM e),
pd AS (SELECT label, dim, stddev_samp(x) AS sd, sum(CASE WHEN nrm > 0 THEN x / nrm ELSE 0.0 END) AS su
       FROM d GROUP BY label, dim),
g1 AS (SELECT label, avg(sd) AS vec_std, sum(su * su) AS s2 FROM pd GROUP BY label),
g2 AS (SELECT label, count(*) AS n, stddev_samp(nrm) / avg(nrm) AS cv,
              sum(CASE WHEN nrm > 0 THEN 1.0 ELSE 0.0 END) AS self FROM e GROUP BY label)
SELECT g2.label, g2.n, round(vec_std, 6) AS vec_std, round(cv, 6) AS vec_norm_cv,
       round(CASE WHEN n >= 2 THEN (s2 - self) / (n * (n - 1)) END, 6) AS mean_cosine_sim
FROM g2 JOIN g1 ON g1.label = g2.label
""")
def q_vec_collapse(spark, sf_dir):
    """A33 + J13 (+ T4): collapse diagnostics of embeddings per label, no pairs formed."""
    emb = read_driver_table(spark, sf_dir, "embeddings", ["label", "embedding"]) \
        .withColumn("embedding", F.col("embedding").cast("array<double>"))
    v = sc.vector_collapse(emb, "label", "embedding")
    return v.select("label", "n", *[r6(F.col(c)).alias(c) for c in ["vec_std", "vec_norm_cv", "mean_cosine_sim"]])


# ---------------------------------------------------------------------------
# run analysis: events as metric series (user = run), lineitem as run records


_W = 1.0 - 2.0 / (rn.SMOOTH_SPAN + 1.0)
_EWM_SQL = """
s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step
      FROM events WHERE value IS NOT NULL),
e AS (SELECT user_id, step, sum(value * pow({w}, -step)) OVER (PARTITION BY user_id ORDER BY step
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * pow({w}, step) / ((1 - pow({w}, step + 1)) / (1 - {w}))
             AS ewm FROM s)
""".replace("{w}", repr(_W))


def _ewm(spark, sf_dir):
    ev = read_driver_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value"])
    pos = rn.series_positions(ev, ["user_id"], ["ts", "event_id"], "value", out="step")
    return rn.ewm_mean(pos, ["user_id"], "step", "value", span=rn.SMOOTH_SPAN)


@register("ewm_by_user", "WITH " + _EWM_SQL + "SELECT user_id, CAST(step AS BIGINT) AS step, round(ewm, 6) AS ewm FROM e")
def q_ewm_by_user(spark, sf_dir):
    """EWM (span 10, adjust=True) of event values per user in time order."""
    return _ewm(spark, sf_dir).select("user_id", "step", r6(F.col("ewm")).alias("ewm"))


@register("aligned_mean", "WITH " + _EWM_SQL + """,
lv AS (SELECT user_id, arg_max(ewm, step) AS last_v, max(step) AS last_step FROM e GROUP BY user_id),
st AS (SELECT range AS step FROM range(0, (SELECT max(last_step) + 1 FROM lv))),
g AS (SELECT st.step, coalesce(e.ewm, lv.last_v) AS v FROM st CROSS JOIN lv
      LEFT JOIN e ON e.user_id = lv.user_id AND e.step = st.step)
SELECT CAST(step AS BIGINT) AS step, round(avg(v), 6) AS mean FROM g GROUP BY step
""")
def q_aligned_mean(spark, sf_dir):
    """Smoothed series aligned to the longest run (last value held), mean per step."""
    m = rn.aligned_mean(_ewm(spark, sf_dir), ["user_id"], "step", "ewm")
    return m.select(F.col("step").cast("bigint"), r6(F.col("mean")).alias("mean"))


@register("step_mean", "WITH " + _EWM_SQL + """
SELECT CAST(step AS BIGINT) AS step, round(avg(ewm), 6) AS mean FROM e GROUP BY step
""")
def q_step_mean(spark, sf_dir):
    """Mean per step without hold."""
    return rn.step_mean(_ewm(spark, sf_dir), "step", "ewm").select(
        F.col("step").cast("bigint"), r6(F.col("mean")).alias("mean"))


_LI_LONG_SQL = """
li AS (SELECT l_orderkey, l_linenumber, l_returnflag AS dataset, l_linestatus AS grp, l_quantity, l_extendedprice,
              l_discount, l_tax FROM lineitem),
lg AS (SELECT dataset, grp, 'quantity' AS metric, l_quantity AS value FROM li
       UNION ALL SELECT dataset, grp, 'extendedprice', l_extendedprice FROM li
       UNION ALL SELECT dataset, grp, 'discount', l_discount FROM li
       UNION ALL SELECT dataset, grp, 'tax', l_tax FROM li),
ms AS (SELECT dataset, grp, metric, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std
       FROM lg GROUP BY dataset, grp, metric)
"""


def _lineitem_long(spark, sf_dir):
    li = read_driver_table(spark, sf_dir, "lineitem", ["l_returnflag", "l_linestatus", "l_quantity",
                                                       "l_extendedprice", "l_discount", "l_tax"])
    return li.select(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("grp"),
                     F.stack(F.lit(4), F.lit("quantity"), F.col("l_quantity"), F.lit("extendedprice"),
                             F.col("l_extendedprice"), F.lit("discount"), F.col("l_discount"),
                             F.lit("tax"), F.col("l_tax")).alias("metric", "value"))


@register("metric_summary", "WITH " + _LI_LONG_SQL + "SELECT dataset, grp, metric, mean, std FROM ms")
def q_metric_summary(spark, sf_dir):
    """Mean / std of every metric per (dataset, group), 4 places."""
    return rn.metric_summary(_lineitem_long(spark, sf_dir), ["dataset", "grp"])


@register("best_metric", "WITH " + _LI_LONG_SQL + """,
b AS (SELECT *, CASE WHEN metric IN ('discount', 'tax') THEN min(mean) OVER (PARTITION BY dataset, metric)
                     ELSE max(mean) OVER (PARTITION BY dataset, metric) END AS best FROM ms)
SELECT dataset, grp, metric, abs(mean - best) < 1e-6 AS is_best,
       CAST(round(CAST(mean AS DECIMAL(38, 10)), 3) AS DECIMAL(38, 3))::VARCHAR || ' ± ' ||
       CAST(round(CAST(coalesce(std, 0.0) AS DECIMAL(38, 10)), 3) AS DECIMAL(38, 3))::VARCHAR AS cell FROM b
""")
def q_best_metric(spark, sf_dir):
    """Best group per (dataset, metric); discount and tax are lower-is-better."""
    s = rn.metric_summary(_lineitem_long(spark, sf_dir), ["dataset", "grp"])
    b = rn.best_per_metric(s, "dataset", lower_is_better=["discount", "tax"])
    return b.select("dataset", "grp", "metric", "is_best", "cell")


@register("config_corr", """
WITH li AS (SELECT l_quantity, l_discount, l_tax, l_extendedprice AS loss FROM lineitem)
SELECT 'l_quantity' AS field, round(corr(l_quantity, loss), 6) AS corr FROM li
UNION ALL SELECT 'l_discount', round(corr(l_discount, loss), 6) FROM li
UNION ALL SELECT 'l_tax', round(corr(l_tax, loss), 6) FROM li
""")
def q_config_corr(spark, sf_dir):
    """A29 (+ P19, P20): Pearson correlation of config fields with the loss."""
    li = read_driver_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount",
                                                       "l_tax", "l_extendedprice"])
    runs = li.select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
                     .alias("run_name"),
                     F.create_map(F.lit("l_quantity"), F.col("l_quantity").cast("string"),
                                  F.lit("l_discount"), F.col("l_discount").cast("string"),
                                  F.lit("l_tax"), F.col("l_tax").cast("string")).alias("config"),
                     F.col("l_extendedprice").alias("loss"))
    long = rn.flatten_config(runs, "config", "run_name", keep=["loss"])
    c = rn.config_correlation(long)
    return c.select("field", r6(F.col("corr")).alias("corr"))


@register("topk_runs", """
WITH r AS (SELECT l_returnflag AS dataset, l_discount, row_number() OVER (PARTITION BY l_returnflag
             ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_discount) AS rn FROM lineitem)
SELECT dataset, round(avg(l_discount), 6) AS mean, round(stddev_samp(l_discount), 6) AS std FROM r
WHERE rn <= 5 GROUP BY dataset
""")
def q_topk_runs(spark, sf_dir):
    """F2 + A35: the 5 cheapest line items per return flag, mean +- std of their discount."""
    li = read_driver_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag",
                                                       "l_extendedprice", "l_discount"])
    top = top_k_per_group_runs(li)
    return top.groupBy(F.col("l_returnflag").alias("dataset")).agg(
        r6(F.avg("l_discount")).alias("mean"), r6(F.stddev_samp("l_discount")).alias("std"))


def top_k_per_group_runs(li):
    # (orderkey, linenumber) repeats in the driver data: the discount breaks remaining ties
    return top_k_per_group(li, ["l_returnflag"], ["l_extendedprice", "l_orderkey", "l_linenumber", "l_discount"], 5)


_FOLD_SQL = """
fb AS (SELECT l_orderkey, list_reduce(list({'e': l_linenumber - 1, 'l': l_discount} ORDER BY l_linenumber, l_discount),
                                     lambda acc, x: CASE WHEN x.l < acc.l - 0.005 THEN x ELSE acc END) AS b
       FROM lineitem GROUP BY l_orderkey)
"""


def _fold_best(spark, sf_dir):
    li = read_driver_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_discount"])
    hist = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("epoch"), F.col("l_discount").alias("val_loss"))
    return rn.fold_best(hist, ["l_orderkey"], min_delta=0.005)


@register("fold_best", "WITH " + _FOLD_SQL + """
SELECT l_orderkey, round(b.l, 6) AS best_val_loss, CAST(b.e AS BIGINT) AS best_epoch FROM fb
""")
def q_fold_best(spark, sf_dir):
    """Best loss / epoch with min-delta 0.005 (order = fold, line number = epoch)."""
    return _fold_best(spark, sf_dir).select("l_orderkey", r6(F.col("best_val_loss")).alias("best_val_loss"),
                                            "best_epoch")


@register("cv_summary", "WITH " + _FOLD_SQL + """,
j AS (SELECT o.o_orderpriority AS run, fb.b.l AS loss, fb.b.e AS epoch FROM fb JOIN orders o ON o.o_orderkey = fb.l_orderkey)
SELECT run, round(avg(loss), 6) AS mean_val_loss, round(stddev_pop(loss), 6) AS std_val_loss,
       round(avg(epoch), 6) AS mean_best_epoch, round(stddev_pop(epoch), 6) AS std_best_epoch,
       CAST(round_even(avg(epoch), 0) AS BIGINT) AS rounded_best_epoch FROM j GROUP BY run
""")
def q_cv_summary(spark, sf_dir):
    """Fold summary per run (order priority)."""
    orders = read_driver_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority"])
    fb = _fold_best(spark, sf_dir).join(orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    s = rn.cv_summary(fb.withColumnRenamed("o_orderpriority", "run"), ["run"])
    return s.select("run", *[r6(F.col(c)).alias(c) for c in ["mean_val_loss", "std_val_loss", "mean_best_epoch",
                                                              "std_best_epoch"]], "rounded_best_epoch")


@register("props_tidy", """
SELECT event_type AS run_name, k AS metric, round(avg(CAST(json_extract(props, '$.' || k) AS DOUBLE)), 6) AS value
FROM events, unnest(json_keys(props)) t(k) GROUP BY event_type, k
""")
def q_props_tidy(spark, sf_dir):
    """S14 (+ P22): JSON property maps exploded to tidy (run, metric, value) rows."""
    ev = read_driver_table(spark, sf_dir, "events", ["event_type", "props"])
    runs = ev.select(F.col("event_type").alias("run_name"),
                     F.from_json("props", "map<string,double>").alias("summary"))
    t = rn.tidy_summary(runs)
    return t.groupBy("run_name", "metric").agg(r6(F.avg("value")).alias("value"))


@register("wide_results", """
WITH a AS (SELECT l_orderkey, l_returnflag, avg(l_quantity) AS quantity, avg(l_discount) AS discount,
           avg(CASE WHEN l_linestatus = 'O' THEN l_tax END) AS tax FROM lineitem GROUP BY ALL),
t AS (SELECT l_orderkey, avg(l_extendedprice) AS price, max(l_discount) AS discount FROM lineitem GROUP BY l_orderkey)
SELECT a.l_orderkey AS run_name, l_returnflag AS test_datasource, round(coalesce(a.discount, t.discount), 6) AS discount,
       round(price, 6) AS price, round(quantity, 6) AS quantity, round(tax, 6) AS tax
FROM a JOIN t ON a.l_orderkey = t.l_orderkey
""")
def q_wide_results(spark, sf_dir):
    """Run summaries (``test/datasource/metric``, ``trial/metric`` keys) as one row per run and datasource."""
    li = read_driver_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount",
                                                       "l_tax", "l_extendedprice"])
    own = li.groupBy("l_orderkey", "l_returnflag").agg(
        F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"),
        F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_tax"))).alias("tax"))
    whole = li.groupBy("l_orderkey").agg(F.avg("l_extendedprice").alias("price"), F.max("l_discount").alias("discount"))
    entries = own.select("l_orderkey", F.explode(F.array(*[F.struct(
        F.concat(F.lit("test/"), "l_returnflag", F.lit(f"/{m}")).alias("k"), F.col(m).cast("double").alias("v")) for m in ("quantity", "discount", "tax")])).alias("e")) \
        .where("e.v IS NOT NULL").unionByName(whole.select("l_orderkey", F.explode(F.array(*[F.struct(
            F.lit(k).alias("k"), v.cast("double").alias("v")) for k, v in (("trial/price", F.col("price")), ("trial/discount", F.col("discount")),
                                                                         ("_step", F.lit(1.0)), ("loss", F.lit(0.5)))])).alias("e")))
    runs = entries.groupBy(F.col("l_orderkey").alias("run_name")).agg(F.map_from_entries(F.collect_list("e")).alias("summary"))
    w = rn.wide_results(runs)
    return w.select("run_name", "test_datasource", *[r6(F.col(c)).alias(c) for c in ("discount", "price", "quantity", "tax")])


# ---------------------------------------------------------------------------
# H9-H12 prompts, X6 / J14 few-shot pairs


_STRIP_SQL = r"regexp_replace({x}, '^[\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}]+|[\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}]+$', '', 'g')"


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _turn_sql(t: str, i: str, style: str | None) -> str:
    head = ("'[Turn ' || CAST({i} AS VARCHAR) || ']' || chr(10) || '  Transcription: \"' || "
            + _STRIP_SQL.replace("{x}", "coalesce({t}, '')") + " || '\"' || chr(10) || '  Speaking style:'")
    head = head.replace("{i}", i).replace("{t}", t)
    return head if style is None else head + " || ' ' || " + style


def _style_sql(t: str) -> str:
    return _STRIP_SQL.replace("{x}", f"coalesce(nullif({t}, ''), 'unknown')")


_USER_PROMPT_SQL = (_sql_lit(tx.USER_QUESTION) + " || array_to_string(list_transform(texts, lambda t, i: CASE WHEN i = len(texts) THEN "
                    + _turn_sql("t", "i", None) + " ELSE " + _turn_sql("t", "i", _style_sql("t"))
                    + " END), chr(10)) || chr(10)")
_EXAMPLE_SQL = ("array_to_string(list_transform(texts, lambda t, i: " + _turn_sql("t", "i", _style_sql("t"))
                + "), chr(10))")
_DIALOGUE_SQL = ("array_to_string(list_filter(list_transform(texts, lambda t: " + _STRIP_SQL.replace("{x}", "t")
                 + "), lambda t: t IS NOT NULL AND t <> ''), ' | ')")


@register("prompt_rows", "WITH " + _UTT_SQL + "," + chains_sql(3) + """
SELECT conv_id, anchor_turn, """ + _USER_PROMPT_SQL + """ AS user_prompt, """ + _DIALOGUE_SQL + """ AS dialogue
FROM chains
""")
def q_prompt_rows(spark, sf_dir):
    """H9 + H11 (user prompt) + H12 for every 3-turn chain."""
    c = conversation_chains(spark, sf_dir, 3)
    return c.select(F.col("part_id").alias("conv_id"), "anchor_turn", tx.user_prompt("chain").alias("user_prompt"),
                    tx.joined_dialogue("chain").alias("dialogue"))


def _feistel_sql(rounds: int = 10) -> str:
    """The rounds of ``plans.permute`` over ``wk (x, k, a, b)``, one subquery each."""
    sql = "(SELECT *, x // b AS l, x % b AS r FROM wk WHERE NOT done)"
    for i in range(1, rounds + 1):
        to, of, side = ("l", "r", "a") if i % 2 else ("r", "l", "b")
        sql = f"""(SELECT * REPLACE (({to} + ('0x' || substr(md5(k || ':{i}:' || {of}), 1, 12))::BIGINT % {side}) % {side} AS {to}) FROM {sql})"""
    return sql


_FEISTEL_SQL = _feistel_sql()
_FEWSHOT_SQL = "WITH RECURSIVE " + _UTT_SQL + "," + chains_sql(3) + "," + _IDS_SQL.format(seed=7) + """,
ho AS (SELECT conv_id, CASE WHEN pos < greatest(1, CAST(floor(n * 0.1) AS BIGINT)) THEN 'test' ELSE 'pool' END AS split
       FROM sh, n),
ck AS (SELECT CAST(c.conv_id AS VARCHAR) || ':' || CAST(c.anchor_turn AS VARCHAR) AS key, c.texts, ho.split
       FROM chains c JOIN ho ON c.conv_id = ho.conv_id),
pr AS (SELECT key AS pkey, texts, row_number() OVER (ORDER BY md5('7:' || key), key) - 1 AS ppos FROM ck WHERE split = 'pool'),
np AS (SELECT count(*) AS P FROM pr),
-- every query's own permutation of the pool: a Feistel network over a x b cells, walked until under P
rt AS (SELECT P, CAST(ceil(sqrt(P)) AS BIGINT) AS root FROM np WHERE P > 0),
sd AS (SELECT P, a, CAST(ceil(P / a) AS BIGINT) AS b FROM (SELECT P, unnest(range(root - least(1000, root // 8 + 1) + 1, root + 1)) AS a FROM rt)
       ORDER BY a * CAST(ceil(P / a) AS BIGINT) - P, a DESC LIMIT 1),
wk AS (SELECT key AS qkey, md5('7:q:' || key) AS k, shot, CAST(shot AS BIGINT) AS x, false AS done, P, a, b
       FROM ck, sd, range(0, 2) t(shot) WHERE split = 'test' AND shot < P
       UNION ALL
       SELECT qkey, k, shot, l * b + r, l * b + r < P, P, a, b FROM """ + _FEISTEL_SQL + """ z),
qs AS (SELECT qkey, shot, x AS ppos FROM wk WHERE done),
ex AS (SELECT qs.qkey, qs.shot, pr.pkey, pr.texts FROM qs JOIN pr ON qs.ppos = pr.ppos)
"""


def _fewshot(spark, sf_dir):
    c = conversation_chains(spark, sf_dir, 3).withColumnRenamed("part_id", "conv_id")
    ho = sp.holdout(_conv_ids(spark, sf_dir), "conv_id", 0.1, 7)
    ck = c.join(ho.select("conv_id", "split"), "conv_id").withColumn(
        "key", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("anchor_turn").cast("string")))
    queries = ck.where(F.col("split") == "test").select(F.col("key").alias("qkey"))
    pool = ck.where(F.col("split") == "pool").select(F.col("key").alias("pkey"), "chain")
    return sp.few_shot_pairs(queries, pool, query_key="qkey", pool_key="pkey", k=2, seed=7)


@register("fewshot_pairs", _FEWSHOT_SQL + "SELECT qkey, CAST(shot AS INT) AS shot, pkey FROM ex")
def q_fewshot_pairs(spark, sf_dir):
    """Two seeded few-shot chains from the pool for every held-out chain."""
    return _fewshot(spark, sf_dir).select("qkey", F.col("shot").cast("int"), "pkey")


@register("system_prompts", _FEWSHOT_SQL + """
SELECT qkey, """ + _sql_lit(tx.TASK_DESCRIPTION) + """ || chr(10) || 'Here are ' || CAST(count(*) AS VARCHAR) ||
       ' examples:' || chr(10) || chr(10) ||
       string_agg('Example ' || CAST(shot + 1 AS VARCHAR) || ':' || chr(10) || """ + _EXAMPLE_SQL + """,
                  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY shot) AS system_prompt
FROM ex GROUP BY qkey
""")
def q_system_prompts(spark, sf_dir):
    """H10 + H11: system prompt with the numbered few-shot examples of each query."""
    fs = _fewshot(spark, sf_dir)
    ex = fs.groupBy("qkey").agg(F.collect_list(F.struct(F.col("shot").alias("rank"),
                                                        tx.few_shot_example("chain").alias("text"))).alias("ex"))
    return ex.select("qkey", tx.system_prompt(F.col("ex")).alias("system_prompt"))


# ---------------------------------------------------------------------------
# Signal steps on the embedding vectors (64 samples each)



@register("pad_trim", """
SELECT vec_id, 48 AS n, round(list_sum(list_transform(embedding[1:48], lambda x: x::DOUBLE)), 6) AS total
FROM embeddings
UNION ALL
SELECT vec_id, 80, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) FROM embeddings
""")
def q_pad_trim(spark, sf_dir):
    """Cut to 48 and zero-pad to 80 samples; checks size and sum."""
    emb = read_driver_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    outs = []
    for n in (48, 80):
        v = sg.pad_or_trim("embedding", n)
        outs.append(emb.select("vec_id", F.size(v).alias("n"),
                               r6(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))).alias("total")))
    return outs[0].unionByName(outs[1])


@register("peak_norm", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS s FROM embeddings),
p AS (SELECT vec_id, s, list_max(list_transform(s, lambda x: abs(x))) AS peak FROM e),
o AS (SELECT vec_id, CASE WHEN peak > 0 THEN list_transform(s, lambda x: x * pow(10, -0.1 / 20.0) / peak) ELSE s END AS y
      FROM p)
SELECT vec_id, round(list_sum(y), 6) AS total, round(list_max(list_transform(y, lambda x: abs(x))), 6) AS peak FROM o
""")
def q_peak_norm(spark, sf_dir):
    """Peak-normalise every vector to -0.1 dBFS."""
    emb = read_driver_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    y = emb.select("vec_id", sg.peak_normalize("embedding").alias("y"))
    return y.select("vec_id", r6(F.aggregate("y", F.lit(0.0), lambda a, x: a + x)).alias("total"),
                    r6(F.array_max(F.transform("y", lambda x: F.abs(x)))).alias("peak"))


@register("frame_snr", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS s FROM embeddings),
f AS (SELECT vec_id, sqrt(list_sum(list_transform(s[i + 1:i + 16], lambda x: x * x)) / 16) AS rms
      FROM e, LATERAL (SELECT unnest(generate_series(0, len(s) - 16 - 1, 8)) AS i) WHERE len(s) > 16),
t AS (SELECT vec_id, quantile_cont(rms, 0.3) AS thr FROM f GROUP BY vec_id),
a AS (SELECT f.vec_id, avg(CASE WHEN rms <= thr THEN rms * rms END) AS noise,
             avg(CASE WHEN rms > thr THEN rms * rms END) AS sig FROM f JOIN t ON f.vec_id = t.vec_id GROUP BY f.vec_id)
SELECT e.vec_id, round(CASE WHEN noise > 0 AND sig IS NOT NULL THEN 10 * log10(sig / noise) END, 6) AS snr
FROM e LEFT JOIN a ON e.vec_id = a.vec_id
""")
def q_frame_snr(spark, sf_dir):
    """H17 with frame 16 / hop 8 on the 64-sample vectors."""
    emb = read_driver_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return sg.frame_snr(emb, "vec_id", "embedding", frame=16, hop=8).select("vec_id", r6(F.col("snr")).alias("snr"))


# ---------------------------------------------------------------------------
# more run / profile / sampling / join queries


@register("baseline_mean", """
WITH li AS (SELECT * FROM lineitem WHERE l_linestatus = 'F')
SELECT 'quantity' AS metric, round(avg(l_quantity), 6) AS baseline_mean FROM li
UNION ALL SELECT 'discount', round(avg(l_discount), 6) FROM li
UNION ALL SELECT 'tax', round(avg(l_tax), 6) FROM li
""")
def q_baseline_mean(spark, sf_dir):
    """Metric means over the finished runs (line status F)."""
    li = read_driver_table(spark, sf_dir, "lineitem", ["l_linestatus", "l_quantity", "l_discount", "l_tax"]) \
        .where(F.col("l_linestatus") == "F")
    long = li.select(F.stack(F.lit(3), F.lit("quantity"), F.col("l_quantity"), F.lit("discount"), F.col("l_discount"),
                             F.lit("tax"), F.col("l_tax")).alias("metric", "value"))
    return rn.baseline_mean(long).select("metric", r6(F.col("baseline_mean")).alias("baseline_mean"))


@register("flagged_groups", _PAIR_F1_SQL + """,
g2 AS (SELECT conv_id, role FROM cr GROUP BY conv_id, role HAVING count(*) >= 2),
lc AS (SELECT conv_id, role, label, count(*) AS c FROM cr WHERE label IS NOT NULL GROUP BY conv_id, role, label),
m AS (SELECT conv_id, role, max(c) AS top, sum(c) AS tot FROM lc GROUP BY conv_id, role),
j AS (SELECT res.conv_id, res.role, m.top / m.tot AS consistency, m.top = m.tot AS unanimous, res.mean_f1
      FROM res JOIN m ON res.conv_id = m.conv_id AND res.role = m.role)
SELECT conv_id, role, round(consistency, 6) AS consistency, round(mean_f1, 6) AS mean_f1 FROM j
WHERE unanimous = false OR mean_f1 < 0.5
""")
def q_flagged_groups(spark, sf_dir):
    """(conversation, role) groups that are not unanimous or have mean F1 below 0.5."""
    rows = _cons_rows(spark, sf_dir)
    lc = pf.label_consistency(rows, ["conv_id", "role"], "label")
    f1 = pf.pairwise_set_f1(rows, ["conv_id", "role"], "toks").drop("n_rows")
    fl = pf.flagged_groups(lc.join(f1, ["conv_id", "role"]))
    return fl.select("conv_id", "role", r6(F.col("consistency")).alias("consistency"),
                     r6(F.col("mean_f1")).alias("mean_f1"))


@register("seeded_sample", """
SELECT doc_id, CAST(rn - 1 AS BIGINT) AS sample_rank FROM (
  SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents)
WHERE rn <= 25
""")
def q_seeded_sample(spark, sf_dir):
    """25 documents in the seeded order (the sample size is the feature)."""
    return sp.seeded_sample(_docs(spark, sf_dir, ["doc_id"]), 25, "doc_id", 42).select("doc_id", "sample_rank")


@register("turn_features", r"""
WITH f AS (SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS audio_id, length(text) AS n_chars,
                  len(list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda t: t <> '')) AS n_tokens
           FROM conversations),
p AS (SELECT a.conv_id, a.turn, CAST(a.conv_id AS VARCHAR) || '/' || CAST(a.turn AS VARCHAR) AS curr_audio_id,
             CAST(b.conv_id AS VARCHAR) || '/' || CAST(b.turn AS VARCHAR) AS res_audio_id
      FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT p.conv_id, p.turn, c.n_chars AS curr_n_chars, c.n_tokens AS curr_n_tokens, r.n_chars AS res_n_chars,
       r.n_tokens AS res_n_tokens
FROM p LEFT JOIN f c ON c.audio_id = p.curr_audio_id LEFT JOIN f r ON r.audio_id = p.res_audio_id
""")
def q_turn_features(spark, sf_dir):
    """Per-utterance features attached to (current, response) pairs once per role."""
    conv = read_driver_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    path = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    feats = conv.select(path.alias("audio_id"), F.length("text").alias("n_chars"),
                        sc.ws_token_count("text").alias("n_tokens"))
    pairs = _turn_pairs(spark, sf_dir).select(
        "conv_id", "turn", F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
        .alias("curr_audio_id"),
        F.concat(F.col("conv_id").cast("string"), F.lit("/"), (F.col("turn") + 1).cast("string")).alias("res_audio_id"))
    out = attach_features(pairs, feats)
    return out.select("conv_id", "turn", F.col("curr_n_chars").cast("bigint"), F.col("curr_n_tokens").cast("bigint"),
                      F.col("res_n_chars").cast("bigint"), F.col("res_n_tokens").cast("bigint"))


@register("label_crosstab", """
SELECT d.lang, CAST(l.quality AS VARCHAR) AS quality, count(*) AS count
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
WHERE d.lang IS NOT NULL AND l.quality IS NOT NULL GROUP BY d.lang, l.quality
""")
def q_label_crosstab(spark, sf_dir):
    """Quality label given the language (documents x labels)."""
    docs = _docs(spark, sf_dir, ["doc_id", "lang"])
    labels = read_driver_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    j = docs.join(labels, "doc_id").withColumn("quality", F.col("quality").cast("string"))
    return pf.crosstab(j, "lang", "quality")


@register("dense_dist", """
WITH j AS (SELECT l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
s AS (SELECT CAST(quality AS VARCHAR) AS label, 'curr' AS side FROM j WHERE quality IS NOT NULL
      UNION ALL SELECT CAST(toxic AS VARCHAR), 'res' FROM j WHERE toxic IS NOT NULL)
SELECT label, CAST(count_if(side = 'curr') AS BIGINT) AS curr, CAST(count_if(side = 'res') AS BIGINT) AS res FROM s GROUP BY label
""")
def q_dense_dist(spark, sf_dir):
    """A8 + J12: quality and toxicity label distributions on their label union (missing = 0)."""
    docs = _docs(spark, sf_dir, ["doc_id"])
    labels = read_driver_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    j = docs.join(labels, "doc_id").select(F.col("quality").cast("string").alias("quality"),
                                           F.col("toxic").cast("string").alias("toxic"))
    x = pf.side_by_side(j, "quality", "toxic")
    return x.select("label", F.col("curr").cast("bigint").alias("curr"), F.col("res").cast("bigint").alias("res"))


@register("chains_second_corpus", "WITH " + _UTT_SQL + """,
lk AS (
  SELECT *, coalesce(prev_filename = lag(relative_audio_path) OVER (PARTITION BY part_id ORDER BY turn_index), false)
         AS linked FROM utt2 WHERE audio_idx >= -1),
fr AS (
  SELECT *, count(*) OVER f AS n_in,
    min(CAST(linked AS INT)) OVER (PARTITION BY part_id ORDER BY turn_index ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)
      AS links_ok,
    first_value(prev_filename IS NULL OR linked) OVER f AS head_ok,
    max(CASE WHEN audio_idx = -1 AND turn_index >= 3 THEN 1 ELSE 0 END) OVER f AS any_bad,
    list(speakerid) OVER f AS speakers
  FROM lk WINDOW f AS (PARTITION BY part_id ORDER BY turn_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT part_id AS conv_id, turn_index AS anchor_turn, array_to_string(speakers, '>') AS roles FROM fr
WHERE audio_idx >= 0 AND turn_index = 4 AND n_in = 5 AND links_ok = 1 AND head_ok AND any_bad = 0
""")
def q_chains_second_corpus(spark, sf_dir):
    """W8 with the second-corpus rules (Q3): every conversation read as that
    corpus, anchors only at turn 4 with audio, text-only (system) turns allowed
    only before turn 3."""
    utt = _utterances(spark, sf_dir).withColumn("source", F.lit(ch.STYLETALK))
    c = ch.build_chains(utt, 5)
    return c.select(F.col("part_id").alias("conv_id"), "anchor_turn",
                    F.array_join(F.transform("chain", lambda u: u["speakerid"]), ">").alias("roles"))


@register("value_percentiles", """
WITH q AS (SELECT event_type, quantile_cont(value, [0.5, 0.9, 0.99]) AS v FROM events WHERE value IS NOT NULL
           GROUP BY event_type)
SELECT event_type, CAST(p AS DOUBLE) AS pct, round(v[i], 6) AS value
FROM q, (VALUES (1, 50), (2, 90), (3, 99)) t(i, p)
""")
def q_value_percentiles(spark, sf_dir):
    """Exact percentiles of a continuous column per group by radix selection, no
    group's values gathered in one task."""
    ev = read_driver_table(spark, sf_dir, "events", ["event_type", "value"])
    p = pf.exact_percentiles(ev, "value", [50, 90, 99], by=["event_type"])
    return p.select("event_type", "pct", r6(F.col("value")).alias("value"))


_SYSTEM_SQL = (_sql_lit(tx.TASK_DESCRIPTION) + """ || chr(10) || 'Here are ' || CAST(count(*) AS VARCHAR) ||
       ' examples:' || chr(10) || chr(10) ||
       string_agg('Example ' || CAST(shot + 1 AS VARCHAR) || ':' || chr(10) || """ + _EXAMPLE_SQL + """,
                  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY shot)""")


@register("full_prompts", _FEWSHOT_SQL + """,
sy AS (SELECT qkey, """ + _SYSTEM_SQL + """ AS system_prompt FROM ex GROUP BY qkey),
q AS (SELECT key AS qkey, """ + _USER_PROMPT_SQL + """ AS user_prompt,
             """ + _STRIP_SQL.replace("{x}", "coalesce(texts[len(texts)], '')") + """ AS ground_truth
      FROM ck WHERE split = 'test')
SELECT q.qkey, sy.system_prompt, q.user_prompt,
       sy.system_prompt || chr(10) || chr(10) || '---' || chr(10) || chr(10) || q.user_prompt AS full_prompt,
       q.ground_truth
FROM q JOIN sy ON q.qkey = sy.qkey
""")
def q_full_prompts(spark, sf_dir):
    """H11 (full prompt) + the inference record shape (S13): system prompt with two
    seeded few-shot examples, user prompt of the held-out chain, and its target."""
    fs = _fewshot(spark, sf_dir)
    sysp = fs.groupBy("qkey").agg(F.collect_list(F.struct(F.col("shot").alias("rank"),
                                                          tx.few_shot_example("chain").alias("text"))).alias("ex")) \
        .select("qkey", tx.system_prompt(F.col("ex")).alias("system_prompt"))
    c = conversation_chains(spark, sf_dir, 3).withColumnRenamed("part_id", "conv_id")
    q = c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("anchor_turn").cast("string")).alias("qkey"),
                 "chain")
    j = q.join(sysp, "qkey", "inner").withColumn("user_prompt", tx.user_prompt("chain"))
    return j.select("qkey", "system_prompt", "user_prompt",
                    tx.full_prompt("system_prompt", "user_prompt").alias("full_prompt"),
                    tx.ground_truth("chain").alias("ground_truth"))


# Tags of one to three words that occur in the turns, per role and category.
TURN_TAGS = {
    "user": {"article": ["the", "la", "le", "el", "die", "der"], "phrase": ["of the", "de la", "in die", "de la que", "the"]},
    "assistant": {"article": ["the", "les", "los", "das"], "link": ["and", "et", "und", "y", "in the", "and the of"]},
    "system": {"article": ["the", "un", "une"]},
}


def _tag_regex(tags):
    """SQL: every match of a category's tags, longest first, in a text whose separators are doubled."""
    alts = "|".join(t.replace(" ", "  ") for t in sorted(tags, key=lambda t: (-len(t), t)))
    return f"(?i)(?:^|[^\\pL\\pN_])({alts})(?:[^\\pL\\pN_]|$)"


_TAG_ROWS = ",\n".join(f"('{s}', '{c}', '{_tag_regex(tags)}')" for s, cats in TURN_TAGS.items() for c, tags in cats.items())


_TURN_TAG_SQL = r"""
pz AS (SELECT curr_role AS source, conv_id, turn, regexp_replace(lower(pred), '([^\pL\pN_])', '\1\1', 'g') AS p,
              regexp_replace(lower(ref), '([^\pL\pN_])', '\1\1', 'g') AS r FROM pr),
voc(source, category, re) AS (VALUES """ + _TAG_ROWS + r"""),
f AS (SELECT pz.source, conv_id, turn, category, list_distinct(regexp_extract_all(p, re, 1)) AS P, list_distinct(regexp_extract_all(r, re, 1)) AS R
      FROM pz JOIN voc ON voc.source = pz.source),
a AS (SELECT source, category, P, R FROM f
      UNION ALL SELECT source, 'overall', list_distinct(flatten(list(P))), list_distinct(flatten(list(R))) FROM f GROUP BY source, conv_id, turn),
t AS (SELECT source, category, len(P) AS np, len(R) AS nr, len(list_intersect(P, R)) AS tp FROM a),
g AS (SELECT source, category, CASE WHEN np = 0 AND nr = 0 THEN 1.0 WHEN np = 0 OR nr = 0 OR tp = 0 THEN 0.0
             ELSE 2.0 * (tp / np) * (tp / nr) / ((tp / np) + (tp / nr)) END AS f1 FROM t)
"""


@register("tag_f1_phrases", "WITH " + _PAIRS_SQL + "," + _TURN_TAG_SQL + """
SELECT source, category, round(avg(f1), 6) AS tag_f1_mean, round(stddev_pop(f1), 6) AS tag_f1_std FROM g GROUP BY source, category
""")
def q_tag_f1_phrases(spark, sf_dir):
    """T1 (+ H8): tag-F1 of turns with each role's own categories and tags of up to three words."""
    from colloquy.functions.tags import vocabulary_frame
    out = sc.tag_f1(_scored_turns(spark, sf_dir), vocabulary_frame(spark, vocab=TURN_TAGS))
    return out.select("source", "category", r6(F.col("tag_f1_mean")).alias("tag_f1_mean"), r6(F.col("tag_f1_std")).alias("tag_f1_std"))


def _scored_turns(spark, sf_dir):
    return _turn_pairs(spark, sf_dir).select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("curr_role").alias("source"), "pred", "ref")


_EVAL_SQL = _CHRF_SQL + "," + _ROUGE_SQL + "," + _TURN_TAG_SQL + r""",
ut AS (SELECT curr_role AS source, list_filter(regexp_split_to_array(lower(pred), '[\s\p{Z}]+'), lambda x: x <> '') AS t FROM pr),
un AS (SELECT source, unnest(t) AS w FROM ut),
bg AS (SELECT source, unnest(list_transform(range(1, len(t)), lambda i: t[i] || chr(1) || t[i + 1])) AS w FROM ut),
lv AS (SELECT curr_role AS source, list_transform(['a', 'e', 'i', 'o'], lambda x: (length(pred) - length(replace(pred, x, ''))) / greatest(length(pred), 1)) AS v
       FROM pr),
ln AS (SELECT source, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM lv),
ld AS (SELECT source, d, stddev_samp(v[d]) AS sd, sum(CASE WHEN nrm > 0 THEN v[d] / nrm ELSE 0.0 END) AS su FROM ln, range(1, 5) r(d) GROUP BY source, d),
l1 AS (SELECT source, avg(sd) AS vec_std, sum(su * su) AS s2 FROM ld GROUP BY source),
l2 AS (SELECT source, count(*) AS n, CASE WHEN avg(nrm) > 0 THEN stddev_samp(nrm) / avg(nrm) END AS cv,
              CAST(count_if(nrm > 0) AS BIGINT) AS self FROM ln GROUP BY source),
ev AS (SELECT curr_role AS source, 'chrf' AS metric, avg(chrf) AS value FROM ch GROUP BY curr_role
       UNION ALL SELECT curr_role, 'chrf_std', stddev_pop(chrf) FROM ch GROUP BY curr_role
       UNION ALL SELECT curr_role, 'rougeL', avg(rouge_l) FROM rl GROUP BY curr_role
       UNION ALL SELECT curr_role, 'rougeL_std', stddev_pop(rouge_l) FROM rl GROUP BY curr_role
       UNION ALL SELECT source, 'dist1', coalesce((SELECT count(DISTINCT w) * 1.0 / nullif(count(w), 0) FROM un WHERE un.source = s.source), 0.0)
                 FROM (SELECT DISTINCT source FROM ut) s
       UNION ALL SELECT source, 'dist2', coalesce((SELECT count(DISTINCT w) * 1.0 / nullif(count(w), 0) FROM bg WHERE bg.source = s.source), 0.0)
                 FROM (SELECT DISTINCT source FROM ut) s
       UNION ALL SELECT source, 'pred_vec_std', vec_std FROM l1
       UNION ALL SELECT source, 'vec_norm_cv', cv FROM l2
       UNION ALL SELECT l2.source, 'mean_cosine_sim', CASE WHEN n >= 2 THEN (s2 - self) / (n * (n - 1)) END FROM l1 JOIN l2 ON l1.source = l2.source
       UNION ALL SELECT source, 'tag_f1_' || category, avg(f1) FROM g GROUP BY source, category
       UNION ALL SELECT source, 'tag_f1_' || category || '_std', stddev_pop(f1) FROM g GROUP BY source, category)
SELECT source, source || '/' || metric AS metric, round(value, 6) AS value FROM ev
"""


@register("eval_report", _EVAL_SQL)
def q_eval_report(spark, sf_dir):
    """T6 with every metric (each role's own tags, ROUGE-L, chrF++, Dist-n, and the collapse of a vector
    per turn: its shares of four letters) for each turn scored against the next, per role."""
    from colloquy.functions.tags import vocabulary_frame
    letters = F.array(*[(F.length("pred") - F.length(F.replace("pred", F.lit(x)))) / F.greatest(F.length("pred"), F.lit(1)) for x in "aeio"])
    rep = sc.evaluate(_scored_turns(spark, sf_dir).withColumn("vec", letters), vocabulary_frame(spark, vocab=TURN_TAGS), vec_col="vec")
    return rep.select("source", "metric", r6(F.col("value")).alias("value"))


from colloquy.plans import suite_rows  # noqa: E402, F401  (registers more queries)
