"""Conversation reconstruction: P1-P7, P16, P23, J1, J2, W1-W7, W15, U1, U4, H1-H4.

Every function is DataFrame -> DataFrame.  Positions inside a conversation
come from ``plans.rank`` (range-partitioned, so one huge conversation is cut
into many tasks); running counts come from ``plans.blocks.running_agg``;
per-conversation facts (first failure, ...) are aggregated with map-side
combine and joined back, where AQE splits a skewed key at runtime.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import build_style_desc, build_tags, strip_ws
from colloquy.plans.blocks import running_agg, running_aggs
from colloquy.plans.rank import lag_within, rank_within

# Path patterns of the first corpus (Python ``re`` forms, made
# Java-compatible by the caller's (?U) flag where \w matters).
SPEAKERS_RE = r"(ex\d+-ex\d+)"
STYLE_RE = r"ex\d+-ex\d+/([\w-]+)/"
CONV_NUM_RE = r"_(\d+)_channel"
START_RE = r"_segment_(\d+\.\d+)_"
END_RE = r"_segment_\d+\.\d+_(\d+\.\d+)\.wav"
FILE_CONV_RE = r"(ex\d+-ex\d+)_([\w-]+)_(\d+)_channel"
SPEAKER_LABEL_RE = r"(?<!\w)([A-Z])\s*:"
CURR_PREFIX_RE = r"^([AB])\s*:\s*"

TEXT_ONLY = -1
FAILED = -2
BLOCK = 4096


def _nullif_empty(c: Column) -> Column:
    return F.when(c == F.lit(""), F.lit(None).cast("string")).otherwise(c)


def extract(col: Column | str, pattern: str, group: int = 1) -> Column:
    """``regexp_extract`` with no-match -> NULL (pandas ``str.extract``)."""
    c = F.col(col) if isinstance(col, str) else col
    return _nullif_empty(F.regexp_extract(c, "(?U)" + pattern, group))


def parse_seconds(col: Column | str, pattern: str) -> Column:
    """Seconds from a file name, +inf when the pattern does not match."""
    c = F.col(col) if isinstance(col, str) else col
    v = F.regexp_extract(c, pattern, 1)
    return F.coalesce(F.when(v != "", v.cast("double")), F.lit(float("inf")))


def path_parts(df: DataFrame, path_col: str = "relative_audio_path") -> DataFrame:
    """Speakers, style, conversation number, start/end and ``conv_id``.

    ``conv_id`` uses null-propagating ``concat`` (any missing part -> NULL).
    """
    p = F.col(path_col)
    return (df.withColumn("speakers", extract(p, SPEAKERS_RE))
            .withColumn("high_lvl_style", extract(p, STYLE_RE))
            .withColumn("conv_num", extract(p, CONV_NUM_RE))
            .withColumn("start_time", parse_seconds(p, START_RE))
            .withColumn("end_time", parse_seconds(p, END_RE))
            .withColumn("conv_id", F.concat(F.col("speakers"), F.lit("_"), F.col("high_lvl_style"),
                                            F.lit("_"), F.col("conv_num"))))


def assign_turns(df: DataFrame, conv_col: str = "conv_id", order: Sequence[str] = ("start_time",),
                 path_col: str = "relative_audio_path", turn_col: str = "turn_index",
                 prev_col: str = "prev_filename") -> DataFrame:
    """W1 + W2: 0-based turn index by start time (path breaks ties) and the
    previous utterance's path, per conversation.  NULL ``conv_id`` rows each
    form their own conversation (Q13: no giant NULL group)."""
    key = F.coalesce(F.col(conv_col).cast("string"), F.concat(F.lit("\u0000"), F.col(path_col)))
    tmp = df.withColumn("__ck", key)
    # paths are unique: only (key, order, path) is range-shuffled and numbered
    out = lag_within(tmp, ["__ck"], [*order, path_col], [path_col], pos=turn_col, prefix="__prev_",
                     row_key=path_col)
    return out.withColumnRenamed("__prev_" + path_col, prev_col).drop("__ck")


def find_missing(files: DataFrame, ann: DataFrame, *, file_path: str = "path",
                 ann_path: str = "relative_audio_path", style_col: str = "high_lvl_style",
                 file_style: Column | None = None) -> DataFrame:
    """Listed files with no annotation row, only under style folders present
    in the annotations (files with no style folder are kept)."""
    f = files.withColumn("__style", file_style if file_style is not None
                         else extract(F.col(file_path), r"conversational_vad_segmented/[^/]+/([\w-]+)"))
    styles = ann.select(F.col(style_col).alias("__style")).where(F.col("__style").isNotNull()).distinct()
    no_style = f.where(F.col("__style").isNull())
    with_style = f.join(styles, "__style", "left_semi")
    cand = no_style.unionByName(with_style).drop("__style")
    return cand.join(ann.select(F.col(ann_path).alias(file_path)), file_path, "left_anti")


def mark_split_points(rows: DataFrame, missing: DataFrame, *, conv_col: str = "conv_id",
                      start_col: str = "start_time", path_col: str = "relative_audio_path",
                      missing_conv: str = "conv_id", missing_start: str = "start_time") -> DataFrame:
    """Flag the first annotated row of a conversation at or after each
    missing file's start (several missing files in one gap flag one row; a
    missing file after the last row flags nothing).

    As-of join without a range join: stack rows and missing files, order by
    ``(start, kind)`` with files first, and flag a row whose predecessor in that
    order is a missing file.
    """
    r = rows.select(F.col(conv_col).alias("__c"), F.col(start_col).alias("__s"),
                    F.col(path_col).alias("__p"), F.lit(1).alias("__kind"))
    m = missing.select(F.col(missing_conv).alias("__c"), F.col(missing_start).alias("__s"),
                       F.lit(None).cast("string").alias("__p"), F.lit(0).alias("__kind")) \
        .where(F.col("__c").isNotNull())
    stacked = r.unionByName(m).withColumn("__pk", F.coalesce("__p", F.lit("")))
    lagged = lag_within(stacked, ["__c"], ["__s", "__kind", "__pk"], ["__kind"], pos="__upos")
    flags = lagged.where((F.col("__kind") == 1) & (F.col("prev___kind") == 0)) \
        .select(F.col("__p").alias(path_col)).distinct()
    return rows.join(flags.withColumn("_is_split_point", F.lit(True)), path_col, "left") \
        .withColumn("_is_split_point", F.coalesce("_is_split_point", F.lit(False)))


def split_parts(rows: DataFrame, *, conv_col: str = "conv_id", start_col: str = "start_time",
                path_col: str = "relative_audio_path") -> DataFrame:
    """W3 + W4: ``conv_id_split = conv_id || '_part' || running count of split
    flags``; turn index and previous path recomputed inside each part."""
    pos = rank_within(rows, [conv_col], [start_col, path_col], out="__pos")
    counted = running_agg(pos, [conv_col], F.floor(F.col("__pos") / BLOCK), ["__pos"],
                          F.col("_is_split_point").cast("int"), "__k", how="sum")
    parts = counted.withColumn("conv_id_split", F.concat(F.col(conv_col), F.lit("_part"),
                                                         F.col("__k").cast("string")))
    out = lag_within(parts.drop("__pos", "__k"), ["conv_id_split"], [start_col, path_col], [path_col],
                     pos="turn_index", prefix="__prev_")
    return out.withColumnRenamed("__prev_" + path_col, "prev_filename")


def split_at_gaps(rows: DataFrame, missing: DataFrame, *, conv_col: str = "conv_id",
                  start_col: str = "start_time", path_col: str = "relative_audio_path",
                  missing_conv: str = "conv_id", missing_start: str = "start_time") -> DataFrame:
    """J2 + W3 + W4 in one ranking: split points, ``conv_id_split``, and the
    turn index / previous path inside each part.

    Rows and missing files are stacked and ranked once per conversation
    (``rank_within``, hot conversations spread over many tasks).  A row is a
    split point when the item before it is a missing file (equi-join on the
    previous position).  One two-level running pass gives the part number
    (running count of split points) and the number of annotated rows before
    each row; the part's first row comes from a ``min`` aggregate, the previous
    path from an equi-join on the previous annotated position.  Same results as
    ``mark_split_points`` + ``split_parts``.
    """
    # paths are unique: only (conversation, start, path) is ranked, the other columns come back at the end
    r = rows.select(conv_col, start_col, path_col, F.lit(1).alias("__kind"), F.col(path_col).alias("__pk"))
    m = missing.where(F.col(missing_conv).isNotNull()).select(
        F.col(missing_conv).alias(conv_col), F.col(missing_start).alias(start_col),
        F.lit(0).alias("__kind"), F.lit("").alias("__pk"))
    u = r.unionByName(m, allowMissingColumns=True)
    ranked = rank_within(u, [conv_col], [start_col, "__kind", "__pk"], out="__upos")
    prev = ranked.select(F.col(conv_col).alias("__pc"), (F.col("__upos") + 1).alias("__nextpos"),
                         F.col("__kind").alias("__prevkind"))
    j = ranked.join(prev, (F.col(conv_col) == F.col("__pc")) & (F.col("__upos") == F.col("__nextpos")), "left") \
        .drop("__pc", "__nextpos")
    flag = (F.col("__kind") == 1) & F.coalesce(F.col("__prevkind") == 0, F.lit(False))
    j = j.withColumn("_is_split_point", flag)
    run = running_aggs(j, [conv_col], F.floor(F.col("__upos") / BLOCK), ["__upos"], [
        (F.col("_is_split_point").cast("int"), "__k", "sum", False),
        ((F.col("__kind") == 1).cast("int"), "__apos", "sum", True)])
    ann = run.where(F.col("__kind") == 1).withColumn("__apos", F.coalesce("__apos", F.lit(0)))
    starts = ann.groupBy(conv_col, "__k").agg(F.min("__apos").alias("__a0"))
    ann = ann.join(starts, [conv_col, "__k"], "inner")
    prevs = ann.select(F.col(conv_col).alias("__pc"), (F.col("__apos") + 1).alias("__an"),
                       F.col(path_col).alias("__prev"), F.col("__k").alias("__pk2"))
    out = ann.join(prevs, (F.col(conv_col) == F.col("__pc")) & (F.col("__apos") == F.col("__an")), "left")
    out = (out.withColumn("conv_id_split", F.concat(F.col(conv_col), F.lit("_part"), F.col("__k").cast("string")))
            .withColumn("turn_index", (F.col("__apos") - F.col("__a0")).cast("bigint"))
            .withColumn("prev_filename", F.when(F.col("__pk2") == F.col("__k"), F.col("__prev")))
            .drop("__kind", "__pk", "__upos", "__prevkind", "__k", "__apos", "__a0", "__pc", "__an", "__prev",
                  "__pk2"))
    return rows.join(out.drop(conv_col, start_col), path_col)


def add_conversation_index(ann: DataFrame, files: DataFrame, *, file_path: str = "path",
                           path_col: str = "relative_audio_path") -> DataFrame:
    """J1 + J2 + W1-W4 for the first corpus.

    The final ``conv_id`` stays unsplit; ``turn_index``/``prev_filename`` are
    per part.  A missing file's conversation id comes from its *name*, a row's
    from its *directory* (Q14).
    """
    parsed = path_parts(ann, path_col)
    missing = find_missing(files, parsed, file_path=file_path, ann_path=path_col)
    mparts = missing.select(
        F.concat_ws("_", extract(F.col(file_path), FILE_CONV_RE, 1), extract(F.col(file_path), FILE_CONV_RE, 2),
                    extract(F.col(file_path), FILE_CONV_RE, 3)).alias("conv_id"),
        extract(F.col(file_path), FILE_CONV_RE, 1).alias("__ok"),
        parse_seconds(F.col(file_path), START_RE).alias("start_time"),
    ).where(F.col("__ok").isNotNull()).drop("__ok")
    split = split_at_gaps(parsed.where(F.col("conv_id").isNotNull()), mparts)
    rejects = parsed.where(F.col("conv_id").isNull()) \
        .withColumn("_is_split_point", F.lit(False)) \
        .withColumn("conv_id_split", F.lit(None).cast("string")) \
        .withColumn("turn_index", F.lit(None).cast("bigint")) \
        .withColumn("prev_filename", F.lit(None).cast("string"))
    out = split.unionByName(rejects)
    return out.drop("speakers", "high_lvl_style", "conv_num", "start_time", "end_time")


def initialize_first_corpus(splits: list[DataFrame], *, source: str = "expresso",
                            path_col: str = "relative_audio_path",
                            path_must_contain: str = "conversational_vad_segmented",
                            desc_col: str = "text_description", ordinal_col: str = "ord") -> DataFrame:
    """S4 + P4 + W5 + P5: stack the first corpus's splits, keep
    one source and the segmented-conversation paths, keep per path the row
    with the longest description list (first ordinal wins ties), then reduce
    the list to its first element (an empty list becomes NULL).

    ``ordinal_col`` must give the stacked row order (e.g. split index and row
    number written at ingest)."""
    from colloquy.sources.tables import stack_splits
    df = stack_splits(splits)
    df = df.where((F.col("source") == source) & F.col(path_col).contains(path_must_contain))
    best = dedup_longest(df, path_col, F.size(desc_col), ordinal_col, digest_key=False)
    dt = best.schema[desc_col].dataType.simpleString()
    first = F.try_element_at(F.col(desc_col), F.lit(1)) if dt.startswith("array") else F.col(desc_col)
    return best.withColumn(desc_col, first)


def dedup_longest(df: DataFrame, key_col: str, size: Column, ordinal_col: str,
                  digest_key: bool = True) -> DataFrame:
    """One row per key, the largest ``size`` wins, the smallest ordinal breaks ties.

    ``max(struct(size, -ordinal))`` per key is a narrow aggregate with map-side
    combine, so a key shared by a third of all rows is reduced in every map
    task before the shuffle; the rows come back by key and ordinal, which must
    be unique.  With ``digest_key`` long keys are shuffled as their SHA-256
    digest.
    """
    k = F.sha2(F.col(key_col).cast("string"), 256) if digest_key else F.col(key_col)
    rows = df.withColumn("__key", k)
    best = rows.groupBy("__key").agg(F.max(F.struct(F.coalesce(size, F.lit(-1)).alias("__size"),
                                                    (-F.col(ordinal_col)).alias("__neg_ord"))).alias("__best")) \
        .select(F.col("__key").alias("__best_key"), (-F.col("__best.__neg_ord")).alias("__best_ord"))
    return rows.join(best, F.col("__key").eqNullSafe(F.col("__best_key")) & (F.col(ordinal_col) == F.col("__best_ord"))) \
        .select(*df.columns)


def duplicate_report(df: DataFrame, key_col: str) -> DataFrame:
    """Rows whose key occurs more than once, and the number of such keys."""
    counts = df.groupBy(F.sha2(F.col(key_col).cast("string"), 256).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    return counts.where(F.col("__n") > 1).agg(
        F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias("dup_rows"),
        F.count(F.lit(1)).cast("bigint").alias("dup_keys"))


def propagate_failures(df: DataFrame, *, conv_col: str = "conv_id", ord_col: str = "ord",
                       text_only: Column, fails: Column, scope: str = "later") -> DataFrame:
    """Row state codes.  Text-only rows are -1 first; once an audio row of
    a conversation fails, it and (``scope='later'``) every later audio row of
    that conversation are -2, earlier rows keep success; ``scope='all'`` fails
    every audio row of the conversation.  NULL conversation ids are
    independent rows (Q9).  Adds ``state`` (0 / -1 / -2) and ``first_failure``.

    Per-conversation first failure = ``min(ord)`` aggregate (map-side
    combined) joined back; no window over a conversation.
    """
    tagged = df.withColumn("__to", text_only).withColumn("__fails", fails & ~F.col("__to"))
    first = tagged.where(F.col("__fails") & F.col(conv_col).isNotNull()) \
        .groupBy(conv_col).agg(F.min(ord_col).alias("__first_fail"))
    # rows without a conversation match nothing: they go round the join, not all into one of its tasks
    alone = tagged.where(F.col(conv_col).isNull()).withColumn("__first_fail", F.lit(None).cast(first.schema["__first_fail"].dataType))
    joined = tagged.where(F.col(conv_col).isNotNull()).join(first, conv_col, "left").unionByName(alone)
    if scope == "later":
        conv_failed = F.col("__first_fail").isNotNull() & (F.col(ord_col) >= F.col("__first_fail"))
    elif scope == "all":
        conv_failed = F.col("__first_fail").isNotNull()
    else:
        raise ValueError("scope must be 'later' or 'all'")
    state = F.when(F.col("__to"), F.lit(TEXT_ONLY)).when(conv_failed | F.col("__fails"), F.lit(FAILED)) \
        .otherwise(F.lit(0))
    first_failure = F.col("__fails") & (F.col(conv_col).isNull() | (F.col(ord_col) == F.col("__first_fail")))
    return joined.withColumn("state", state).withColumn("first_failure", first_failure) \
        .drop("__to", "__fails", "__first_fail")


def dense_audio_index(df: DataFrame, order: Sequence[str], state_col: str = "state",
                      out: str = "audio_idx", row_key: str | None = None) -> DataFrame:
    """Dense 0-based index over successful rows in table order; other rows
    keep their state code.  A global rank without a one-task window; with a
    unique ``row_key`` only the narrow projection is ranked."""
    ok = rank_within(df.where(F.col(state_col) == 0), [], list(order), out=out, row_key=row_key)
    rest = df.where(F.col(state_col) != 0).withColumn(out, F.col(state_col).cast("bigint"))
    return ok.unionByName(rest)


# ---------------------------------------------------------------------------
# second corpus (dialogue pairs, wide) -> utterance rows


def parse_context(df: DataFrame, context_col: str = "context", id_col: str = "diag_id") -> DataFrame:
    """Dialogue string ``"A: .. B: .."`` -> rows ``(id, speaker_label, transcription, turn_index)``.

    Labels are single capitals followed by optional spaces and ``:`` not
    preceded by a word character; text before the first label and blank turns
    are dropped; indexes count kept turns only.  Native ``split`` +
    ``regexp_extract_all`` + ``posexplode``; no UDTF.
    """
    ctx = strip_ws(F.col(context_col))
    labels = F.regexp_extract_all(ctx, F.lit("(?U)" + SPEAKER_LABEL_RE), 1)
    bodies = F.slice(F.split(ctx, "(?U)" + SPEAKER_LABEL_RE, -1), 2, 1 << 30)
    pairs = F.arrays_zip(labels.alias("speaker_label"), bodies.alias("body"))
    kept = F.filter(F.transform(pairs, lambda p: F.struct(
        strip_ws(p["speaker_label"]).alias("speaker_label"), strip_ws(p["body"]).alias("transcription"))),
        lambda p: (p["speaker_label"] != "") & (p["transcription"] != ""))
    valid = F.col(context_col).isNotNull() & (F.lower(F.col(context_col)) != F.lit("nan"))
    return df.where(valid).select(F.col(id_col), F.posexplode(kept).alias("turn_index", "t")) \
        .select(id_col, "t.speaker_label", "t.transcription", F.col("turn_index").cast("bigint"))


def second_corpus_rows(pairs: DataFrame, seed: int = 0) -> DataFrame:
    """P7 + W15 + H1-H4: wide dialogue-pair rows -> unified utterance rows.

    Context turns are text-only rows 0..n-1; the current utterance is turn n;
    the response is n + 1 (n when the current one is missing).  Previous path:
    last context row for the current one, the current one for the response
    (NULL when it is missing, even with context).  Context paths fall back to
    the dialogue id when the current audio id is NULL (Q12).
    """
    # feature columns come from the audio step (J8) and may be absent
    for role in ("curr", "res"):
        for feat in ("duration", "utterance_pitch_mean", "snr"):
            if f"{role}_{feat}" not in pairs.columns:
                pairs = pairs.withColumn(f"{role}_{feat}", F.lit(None).cast("double"))
    base = pairs
    ctx = parse_context(pairs.select("diag_id", "context", "curr_audio_id"), "context", "diag_id")
    ctx = ctx.join(pairs.select("diag_id", "curr_audio_id"), "diag_id", "left")
    ctx_rows = ctx.select(
        F.lit("styletalk").alias("source"), F.col("diag_id").cast("string").alias("conv_id"),
        F.col("turn_index"),
        F.concat(F.coalesce(F.col("curr_audio_id"), F.col("diag_id").cast("string")), F.lit("_turn_"),
                 F.col("turn_index").cast("string")).alias("relative_audio_path"),
        F.col("transcription"), F.col("speaker_label").alias("speakerid"),
        F.when(F.col("turn_index") > 0, F.concat(
            F.coalesce(F.col("curr_audio_id"), F.col("diag_id").cast("string")), F.lit("_turn_"),
            (F.col("turn_index") - 1).cast("string"))).alias("prev_filename"),
        F.lit("text_only").alias("record_type"))
    n_ctx = ctx.groupBy("diag_id").agg(F.count(F.lit(1)).alias("__n"))
    wide = base.join(n_ctx, "diag_id", "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    last_ctx = F.when(F.col("__n") > 0, F.concat(F.coalesce(F.col("curr_audio_id"), F.col("diag_id").cast("string")),
                                                  F.lit("_turn_"), (F.col("__n") - 1).cast("string")))
    curr_label = extract(F.col("curr_text"), CURR_PREFIX_RE)
    curr_text = F.regexp_replace(F.col("curr_text"), CURR_PREFIX_RE, "")
    curr = wide.where(F.col("curr_audio_id").isNotNull()).select(
        F.lit("styletalk").alias("source"), F.col("diag_id").cast("string").alias("conv_id"),
        F.col("__n").cast("bigint").alias("turn_index"), F.col("curr_audio_id").alias("relative_audio_path"),
        curr_text.alias("transcription"), curr_label.alias("speakerid"), last_ctx.alias("prev_filename"),
        F.lit("audio").alias("record_type"),
        F.col("curr_duration").alias("duration"), F.col("curr_utterance_pitch_mean").alias("utterance_pitch_mean"),
        F.col("curr_snr").alias("snr"), F.col("curr_speed").alias("speaking_rate"),
        F.col("curr_emotion").alias("emotion"), F.col("curr_volume").alias("volume"),
        build_tags("curr_emotion", "curr_speed", "curr_volume").alias("basic_tags"),
        build_style_desc("curr_emotion", "curr_speed", "curr_volume", seed,
                         F.col("curr_audio_id")).alias("text_description"))
    res_label = F.when(F.col("res_text").contains("A:"), F.lit("A")) \
        .when(F.col("res_text").contains("B:"), F.lit("B"))
    res_text = F.when(res_label.isNotNull(), F.replace(F.col("res_text"), F.concat(res_label, F.lit(":")), F.lit(""))) \
        .otherwise(F.col("res_text"))
    opposite = F.when(curr_label == "B", F.lit("A")).when(curr_label.isNotNull(), F.lit("B"))
    res = wide.where(F.col("res_audio_id").isNotNull()).select(
        F.lit("styletalk").alias("source"), F.col("diag_id").cast("string").alias("conv_id"),
        (F.col("__n") + F.when(F.col("curr_audio_id").isNotNull(), 1).otherwise(0)).cast("bigint").alias("turn_index"),
        F.col("res_audio_id").alias("relative_audio_path"), res_text.alias("transcription"),
        F.coalesce(res_label, opposite).alias("speakerid"), F.col("curr_audio_id").alias("prev_filename"),
        F.lit("audio").alias("record_type"),
        F.col("res_duration").alias("duration"), F.col("res_utterance_pitch_mean").alias("utterance_pitch_mean"),
        F.col("res_snr").alias("snr"), F.col("res_speed").alias("speaking_rate"),
        F.col("res_emotion").alias("emotion"), F.col("res_volume").alias("volume"),
        build_tags("res_emotion", "res_speed", "res_volume").alias("basic_tags"),
        build_style_desc("res_emotion", "res_speed", "res_volume", seed,
                         F.col("res_audio_id")).alias("text_description"))
    out = ctx_rows.unionByName(curr, allowMissingColumns=True).unionByName(res, allowMissingColumns=True)
    return out.withColumn("all_tags", F.col("basic_tags"))


def merge_corpora(first: DataFrame, second: DataFrame) -> DataFrame:
    """G1 + P9: union by name (missing -> NULL), first corpus marked ``audio``,
    first table's columns first, others appended."""
    a = first.withColumn("record_type", F.lit("audio")) if "record_type" not in first.columns else first
    merged = a.unionByName(second, allowMissingColumns=True)
    order = list(a.columns) + [c for c in merged.columns if c not in a.columns]
    return merged.select(*order)


# ---------------------------------------------------------------------------
# adapter for plain turn tables (conv_id, turn, role, text)


def utterances_from_turns(conv: DataFrame, source: str = "dialogue") -> DataFrame:
    """Turn table -> utterance rows: ``path = conv_id/turn``, speaker = role,
    system turns are text-only (-1), every row is one conversation part.
    ``turn_index`` is the row's place in its conversation (W1; turn numbers may
    skip), ``prev_filename`` W2 (previous turn's path)."""
    from colloquy.plans.blocks import DEFAULT_BLOCK, running_agg
    conv = running_agg(conv.where(F.col("turn").isNotNull()), ["conv_id"], F.floor(F.col("turn") / F.lit(DEFAULT_BLOCK)).cast("bigint"),
                       ["turn"], F.lit(1), "__place")
    path = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    base = conv.select(
        F.lit(source).alias("source"), F.col("conv_id"), F.col("conv_id").alias("part_id"),
        (F.col("__place") - 1).cast("bigint").alias("turn_index"), path.alias("relative_audio_path"),
        F.col("role").alias("speakerid"), F.col("text").alias("transcription"),
        F.col("text").alias("text_description"),
        F.when(F.col("role") == "system", F.lit(TEXT_ONLY)).otherwise(F.lit(0)).alias("audio_idx"))
    return previous_path(base, "part_id", "turn_index", "relative_audio_path", "prev_filename")


def previous_path(df: DataFrame, part_col: str, turn_col: str, path_col: str, out: str) -> DataFrame:
    """W2 for a dense turn index (see ``assign_turns``): ``lag(path)`` over a halo-blocked window, so a
    huge conversation is cut into bounded tasks (one shuffle)."""
    from colloquy.plans.blocks import drop_halo, halo_window, with_halo
    blocked = with_halo(df, turn_col, halo=1)
    return drop_halo(blocked.withColumn(out, F.lag(path_col, 1).over(halo_window([part_col], [turn_col]))))
