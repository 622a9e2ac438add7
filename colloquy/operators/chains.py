"""Dialogue windows ("chains") and what is derived from them: W8, W13, J3-J5, J11, P14, H14, H21.

A chain is ``num_turns`` consecutive utterances of one conversation part that
end at an anchor row, oldest first.  Rules (kept from the reference):

* rows with ``audio_idx = -2`` are removed *before* linking, so they break links;
* every row after the oldest must link to its predecessor
  (``prev_filename = lag(path)``); a NULL link there drops the chain;
* the oldest row's own link must be NULL or resolvable, so a complete chain
  whose oldest row dangles is dropped;
* anchors: the second corpus (``source = 'styletalk'``) only at turn 4 with
  audio; every other source at every turn ``>= num_turns - 1`` with audio;
* text-only rows (``-1``): the second corpus allows them only at turns < 3,
  other sources nowhere.

Plan: one shuffle by ``(part, block)`` where blocks of turn indexes carry a
halo of ``num_turns`` rows (``plans.blocks``), so a huge conversation is cut
into bounded tasks; all checks are frame aggregates over
``rows num_turns-1 preceding .. current``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.plans.blocks import DEFAULT_BLOCK, drop_halo, halo_window, with_halo

# Fixed values from the reference's dataset rules.
STYLETALK = "styletalk"
STYLETALK_FINAL_TURN_INDEX = 4
STYLETALK_TEXT_ONLY_TURNS = 3
TEXT_ONLY = -1
FAILED = -2

DEFAULT_ITEM_COLS = ("turn_index", "relative_audio_path", "audio_idx", "speakerid",
                     "transcription", "text_description")


def build_chains(utt: DataFrame, num_turns: int = 5, *,
                 part_col: str = "part_id", turn_col: str = "turn_index",
                 path_col: str = "relative_audio_path", prev_col: str = "prev_filename",
                 state_col: str = "audio_idx", source_col: str = "source",
                 item_cols: Sequence[str] = DEFAULT_ITEM_COLS,
                 keep_cols: Sequence[str] = (),
                 block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """Every valid chain as one row ``(part, anchor_turn, source, chain, keep_cols...)``.

    ``chain`` is ``ARRAY<STRUCT<item_cols>>`` oldest first.  ``keep_cols`` are
    copied from the anchor row.
    """
    n = int(num_turns)
    if n < 1:
        raise ValueError("num_turns must be >= 1")
    # Hard failures leave before linking; rejects without a part or a turn are in no chain
    rows = utt.where((F.col(state_col) >= TEXT_ONLY) & F.col(part_col).isNotNull() & F.col(turn_col).isNotNull())
    blocked = with_halo(rows, turn_col, halo=n, block_size=max(block_size, 2 * n))
    w = halo_window([part_col], [turn_col])
    frame = w.rowsBetween(-(n - 1), 0)
    linked = F.coalesce(F.col(prev_col) == F.lag(path_col, 1).over(w), F.lit(False))
    blocked = blocked.withColumn("__linked", linked)

    src = F.lower(F.col(source_col))
    is_st = src == F.lit(STYLETALK)
    bad_text_only = F.when(
        (F.col(state_col) == TEXT_ONLY)
        & (~F.col("__st") | (F.col(turn_col) >= STYLETALK_TEXT_ONLY_TURNS)), 1).otherwise(0)
    blocked = blocked.withColumn("__st", is_st).withColumn("__bad", bad_text_only)

    item = F.struct(*[F.col(c) for c in item_cols])
    newer_links = (F.min(F.col("__linked").cast("int")).over(w.rowsBetween(-(n - 2), 0))
                   if n > 1 else F.lit(1))
    head_ok = F.first(F.col(prev_col).isNull() | F.col("__linked")).over(frame)
    framed = blocked.select(
        "*",
        F.collect_list(item).over(frame).alias("chain"),
        newer_links.alias("__links_ok"),
        head_ok.alias("__head_ok"),
        F.max("__bad").over(frame).alias("__any_bad"),
    )
    framed = drop_halo(framed)
    anchor_ok = (F.col(state_col) >= 0) & F.when(
        F.col("__st"), F.col(turn_col) == STYLETALK_FINAL_TURN_INDEX
    ).otherwise(F.col(turn_col) >= n - 1)
    valid = (anchor_ok & (F.size("chain") == n) & (F.col("__links_ok") == 1)
             & F.col("__head_ok") & (F.col("__any_bad") == 0))
    return framed.where(valid).select(
        F.col(part_col), F.col(turn_col).alias("anchor_turn"), F.col(source_col),
        *[F.col(c) for c in keep_cols], "chain")


def has_valid_target(chain: Column | str = "chain", target_field: str = "text_description") -> Column:
    """Only the last turn's target must be present and non-empty."""
    c = F.col(chain) if isinstance(chain, str) else chain
    last = F.element_at(c, -1).getField(target_field)
    return last.isNotNull() & (last != F.lit(""))


def last_turns(chain: Column | str, k: int) -> Column:
    """Last ``k`` items of a chain (all of it when shorter)."""
    c = F.col(chain) if isinstance(chain, str) else chain
    return F.when(F.size(c) <= F.lit(k), c).otherwise(F.slice(c, -k, k))


def speaker_edges(chains: DataFrame, id_cols: Sequence[str], speaker_field: str = "speakerid",
                  chain_col: str = "chain") -> DataFrame:
    """Speaker-aware context edges inside each chain.

    For every turn ``a`` and every earlier-or-same turn ``b`` of the same chain:
    ``intra`` when both have the same speaker (the self edge included), else
    ``inter``; the self edge is also emitted as ``inter`` (a turn attends to
    itself in both masks).  A chain has at most ``num_turns`` items, so the
    pairs per chain are bounded by the parameter, not by the data.
    """
    a = chains.select(*id_cols, F.posexplode(chain_col).alias("a_pos", "a_item"), F.col(chain_col))
    b = a.select("*", F.posexplode(chain_col).alias("b_pos", "b_item")).where(F.col("b_pos") <= F.col("a_pos"))
    same = F.col("a_item").getField(speaker_field).eqNullSafe(F.col("b_item").getField(speaker_field))
    edges = b.select(*id_cols, "a_pos", "b_pos",
                     F.when(same, F.lit("intra")).otherwise(F.lit("inter")).alias("edge"))
    self_inter = b.where((F.col("a_pos") == F.col("b_pos"))).select(
        *id_cols, "a_pos", "b_pos", F.lit("inter").alias("edge"))
    return edges.unionByName(self_inter)


def pad_batch(items: DataFrame, batch_col: str, signal_col: str, max_len: int | None = None) -> DataFrame:
    """Pad every signal of a batch to the batch maximum; lengths and mask.

    Text-only items (NULL signal) become zeros of the batch length.
    """
    length = F.greatest(F.coalesce(F.size(signal_col), F.lit(0)), F.lit(0))
    # only lengths are grouped; the signals meet one number a batch
    tops = items.groupBy(F.col(batch_col).alias("__batch")).agg(F.max(length).alias("__t"))
    if max_len is not None:
        tops = tops.withColumn("__t", F.least(F.col("__t"), F.lit(int(max_len))))
    joined = items.join(tops, F.col(batch_col).eqNullSafe(F.col("__batch"))).drop("__batch")
    out = joined.withColumn("length", F.least(length, F.col("__t")))
    sig = F.coalesce(F.col(signal_col), F.array().cast("array<float>"))
    padded = F.when(F.size(sig) >= F.col("__t"), F.slice(sig, 1, F.col("__t"))).otherwise(
        F.concat(sig, F.array_repeat(F.lit(0.0).cast("float"), F.col("__t") - F.size(sig))))
    mask = F.transform(F.sequence(F.lit(1), F.greatest(F.col("__t"), F.lit(1))),
                       lambda i: i <= F.col("length"))
    return out.withColumn(signal_col, padded) \
        .withColumn("mask", F.when(F.col("__t") > 0, mask).otherwise(F.array().cast("array<boolean>"))) \
        .withColumn("text_only", F.col("length") == 0).drop("__t")


def mask_target(chain: Column | str, signal_field: str = "waveform", length_field: str = "length",
                text_only_field: str = "text_only") -> Column:
    """Zero the last turn's signal, set its length to 0 and flag it text-only."""
    c = F.col(chain) if isinstance(chain, str) else chain

    def fix(u, i):
        return F.when(i == F.size(c) - 1,
                      u.withField(signal_field, F.array().cast("array<float>"))
                      .withField(length_field, F.lit(0))
                      .withField(text_only_field, F.lit(True))).otherwise(u)
    return F.transform(c, fix)


def walk_links(utt: DataFrame, anchors: DataFrame, num_turns: int, *, path_col: str = "relative_audio_path",
               prev_col: str = "prev_filename", strict: bool = True) -> DataFrame:
    """Follow ``prev_filename`` back from anchors with equi self-joins.

    The general form for tables whose links do not follow turn order.  With
    ``strict`` (dataset rule) a missing predecessor, a chain shorter than
    ``num_turns`` or a dangling link on the oldest row drops the chain; without
    it (sampler rule) a missing predecessor only ends the walk.  ``anchors``
    must carry ``path_col``; the result has ``anchor_path``, the reached path and
    ``hop`` (0 = anchor).  Each hop joins on the unique path key, so no group is
    skewed; the number of joins is the parameter ``num_turns``.
    """
    n = int(num_turns)
    lookup = utt.select(F.col(path_col).alias("__q"), F.col(prev_col).alias("__next"))

    def follow(frame: DataFrame, link: Column, hop: int) -> DataFrame:
        # ends of walks get keys of their own, so that they don't meet in one task
        key = F.coalesce(link, F.concat(F.lit("\u0000"), F.col("anchor_path")))
        return frame.withColumn("__key", key).join(lookup, F.col("__key") == F.col("__q"), "left").drop("__key") \
            .withColumnsRenamed({"__q": f"__p{hop}", "__next": f"__prev{hop}"})

    # one frame with a column per hop: the plan grows by one join a hop
    frame = follow(anchors.select(F.col(path_col).alias("anchor_path")), F.col("anchor_path"), 0).where("__p0 is not null")
    for h in range(1, n):
        frame = follow(frame, F.col(f"__prev{h - 1}"), h)
    if strict:
        # the oldest row's link must not dangle either
        frame = follow(frame, F.col(f"__prev{n - 1}"), n) \
            .where(F.col(f"__p{n - 1}").isNotNull() & (F.col(f"__prev{n - 1}").isNull() | F.col(f"__p{n}").isNotNull()))
    hops = F.array(*[F.struct(F.col(f"__p{h}").alias(path_col), F.lit(h).alias("hop")) for h in range(n)])
    return frame.select("anchor_path", F.explode(hops).alias("__x")).select("anchor_path", f"__x.{path_col}", "__x.hop") \
        .where(F.col(path_col).isNotNull())
