"""Scoring generated text against references: T1-T6, A33, J13.

Input rows are ``(id, group, pred, ref)``; outputs are per-row scores and
grouped ``mean`` / population ``std`` (ddof 0, as the reference uses).
Tag and Dist-n counts are map-side combined aggregations keyed by row id, so no
group is collected into one task.  ROUGE-L and chrF++ score each pair in its
row with small helpers in Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.tags import WORD, set_f1_metric, tag_mentions
from colloquy.functions.text import WS

WS_SPLIT = WS + "+"
# Python's string.punctuation (chrF++ word tokenisation).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CHAR_ORDER = 6
WORD_ORDER = 2
#: Characters of pairs whose n-grams are counted together.
CHRF_CHARS = 200_000
BETA = 2


# ---------------------------------------------------------------------------
# T1 tag F1


def tag_f1(pairs: DataFrame, vocab: DataFrame, *, id_col: str = "id", group_col: str = "source",
           pred_col: str = "pred", ref_col: str = "ref") -> DataFrame:
    """Per group, mean / std of tag-F1 per vocabulary category and overall.

    A vocabulary with a ``source`` column gives each group its own categories
    and tags; without one all groups share them.
    Rows without tags on both sides score 1 (H7) and are counted without being
    materialised per category: ``mean = (sum over tagged rows + untagged) / N``.
    Output: ``(group, category, tag_f1_mean, tag_f1_std)``; ``category =
    'overall'`` is the union of categories.
    """
    # a candidate is a run of word pieces: "high-pitched" has two
    max_words = int(vocab.select(F.max(F.size(F.regexp_extract_all("tag", F.lit(WORD), 0)))).first()[0] or 1)
    own = "source" in vocab.columns
    # the category of a source travels as one name, so that each source's scan is its own
    named = vocab.select(F.to_json(F.array(F.col("source").cast("string"), F.col("category"))).alias("category"), "tag") if own else vocab
    base = pairs.select(id_col, group_col, pred_col, ref_col)
    # one pass over both sides: (id, side, text) rows
    sides = base.select(id_col, group_col, F.explode(F.array(
        F.struct(F.lit(1).alias("__side"), F.col(pred_col).alias("__text")),
        F.struct(F.lit(2).alias("__side"), F.col(ref_col).alias("__text")))).alias("__x")) \
        .select(id_col, group_col, "__x.__side", "__x.__text")
    m = tag_mentions(sides, [id_col, group_col, "__side"], "__text", named, max_words)
    if own:
        parts = F.from_json("category", "array<string>")
        m = m.where(parts[0].eqNullSafe(F.col(group_col).cast("string"))).withColumn("category", parts[1])
    # every mention counts for its category and for 'overall' (union of categories)
    m = m.select(id_col, "__side", "tag", F.explode(F.array(F.col("category"), F.lit("overall"))).alias("category"))
    per_tag = m.groupBy(id_col, "category", "tag").agg(
        F.max((F.col("__side") == 1).cast("int")).alias("__p"), F.max((F.col("__side") == 2).cast("int")).alias("__r"))
    sets = per_tag.groupBy(id_col, "category").agg(
        F.sum("__p").alias("__np"), F.sum("__r").alias("__nr"), F.sum(F.col("__p") * F.col("__r")).alias("__tp"))
    scored = sets.withColumn("__f1", set_f1_metric(F.col("__np"), F.col("__nr"), F.col("__tp"))) \
        .join(base.select(id_col, group_col), id_col, "inner")
    sums = scored.groupBy(group_col, "category").agg(
        F.count(F.lit(1)).alias("__k"), F.sum("__f1").alias("__s"), F.sum(F.col("__f1") ** 2).alias("__s2"))
    totals = base.groupBy(group_col).agg(F.count(F.lit(1)).alias("__n"))
    # groups x their categories is the output grid; the category names of the
    # vocabulary (a parameter table of a few categories) become one array
    every = F.array_sort(F.collect_set("category"))
    if own:
        names = vocab.groupBy(F.col("source").cast("string").alias("__src")).agg(every.alias("__names"))
        left = totals.join(names, F.col(group_col).cast("string") == F.col("__src"), "left")
    else:
        left = totals.withColumn("__names", vocab.agg(every).scalar())
    grid = left.select(group_col, "__n", F.explode(F.concat(
        F.coalesce("__names", F.array().cast("array<string>")), F.array(F.lit("overall")))).alias("category"))
    full = grid.join(sums, [group_col, "category"], "left").fillna(0, ["__k", "__s", "__s2"])
    mean = (F.col("__s") + (F.col("__n") - F.col("__k"))) / F.col("__n")
    ex2 = (F.col("__s2") + (F.col("__n") - F.col("__k"))) / F.col("__n")
    return full.select(group_col, "category", mean.alias("tag_f1_mean"),
                       F.sqrt(F.greatest(ex2 - mean * mean, F.lit(0.0))).alias("tag_f1_std"))


# ---------------------------------------------------------------------------
# T5 distinct n-grams


def ws_tokens(col: Column | str, lower: bool = True) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    c = F.lower(c) if lower else c
    return F.filter(F.split(c, WS_SPLIT), lambda t: t != "")


def ws_token_count(col: Column | str) -> Column:
    """Number of whitespace-separated tokens (Python ``len(s.split())``) without
    building a filtered token list: ``split`` keeps one empty piece for a
    leading and one for a trailing separator run, which are subtracted."""
    c = F.col(col) if isinstance(col, str) else col
    pieces = F.size(F.split(c, WS_SPLIT))
    lead = F.substring(c, 1, 1).rlike("^" + WS_SPLIT).cast("int")
    trail = F.substring(c, -1, 1).rlike("^" + WS_SPLIT).cast("int")
    return F.when(F.length(c) == 0, F.lit(0)).otherwise(pieces - lead - trail)


def dist_n(df: DataFrame, group_col: str, pred_col: str = "pred") -> DataFrame:
    """T5: Dist-1 / Dist-2 per group: distinct / total uni- and bigrams of the
    lowercased whitespace tokens; bigrams do not cross rows; 0 when none.

    Bigram positions are exploded as integers and joined in a generated
    projection; distinct counting is Spark's two-phase distinct aggregate."""
    toks = df.select(group_col, ws_tokens(pred_col).alias("__t"))
    uni = toks.select(group_col, F.explode("__t").alias("__g"))
    bi = toks.where(F.size("__t") >= 2) \
        .select(group_col, "__t", F.explode(F.sequence(F.lit(1), F.size("__t") - 1)).alias("__i")) \
        .select(group_col, F.concat_ws("\u0001", F.element_at("__t", F.col("__i")),
                                       F.element_at("__t", F.col("__i") + 1)).alias("__g"))
    u = uni.groupBy(group_col).agg(F.countDistinct("__g").alias("__du"), F.count("__g").alias("__nu"))
    b = bi.groupBy(group_col).agg(F.countDistinct("__g").alias("__db"), F.count("__g").alias("__nb"))
    groups = df.select(group_col).distinct()
    out = groups.join(u, group_col, "left").join(b, group_col, "left")
    return out.select(group_col,
                      F.coalesce(F.col("__du") / F.col("__nu"), F.lit(0.0)).alias("dist1"),
                      F.coalesce(F.col("__db") / F.col("__nb"), F.lit(0.0)).alias("dist2"))


# ---------------------------------------------------------------------------
# T2 ROUGE-L


def rouge_tokens(col: Column | str) -> Column:
    """Tokenizer of the ROUGE scorer: lowercase, non ``[a-z0-9]`` runs -> space, split."""
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda t: t != "")


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence (bit-parallel, Hyyrö 2004)."""
    if len(a) == 0 or len(b) == 0:
        return 0
    masks: dict[str, int] = {}
    for i, t in enumerate(b):
        masks[t] = masks.get(t, 0) | (1 << i)
    full = (1 << len(b)) - 1
    v = full
    for t in a:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


@F.pandas_udf(T.LongType())
def _lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x) if x is not None else [], list(y) if y is not None else [])
                      for x, y in zip(a, b)], dtype="int64")


def rouge_l(df: DataFrame, pred_col: str = "pred", ref_col: str = "ref", out: str = "rouge_l") -> DataFrame:
    """ROUGE-L F-measure per row (no stemming): ``P = L/|pred|``,
    ``R = L/|ref|``, ``F = 2PR/(P+R)``, 0 when either side has no tokens."""
    t = df.withColumn("__pt", rouge_tokens(pred_col)).withColumn("__rt", rouge_tokens(ref_col))
    t = t.withColumn("__l", _lcs_udf("__pt", "__rt"))
    p = F.col("__l") / F.size("__pt")
    r = F.col("__l") / F.size("__rt")
    f = F.when((F.size("__pt") == 0) | (F.size("__rt") == 0) | (F.col("__l") == 0), F.lit(0.0)) \
        .otherwise(2 * p * r / (p + r))
    return t.withColumn(out, f).drop("__pt", "__rt", "__l")


# ---------------------------------------------------------------------------
# T3 chrF++


_SPACE = re.compile(r"\s+")


def chrf_words(text: str) -> list[str]:
    """Whitespace tokens with one trailing (else leading) punctuation mark split off."""
    out = []
    for w in text.split():
        if len(w) > 1 and w[-1] in PUNCTUATION:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in PUNCTUATION:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def _shares(sides: list[list[np.ndarray]], orders: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per pair, over the orders with n-grams on both sides: sums of the shares of matched n-grams of
    either side, and how many orders there were.

    ``sides``: the symbols of each pair's two sequences.  All pairs are counted together: a gram is the
    number of the gram before it and one more symbol, numbered anew with one sort per order; gram numbers
    start from the pair, so grams of different pairs never meet."""
    pairs = len(sides[0])
    symbols = np.concatenate([*sides[0], *sides[1], np.zeros(0, np.int64)])
    length = np.array([len(x) for side in sides for x in side], np.int64)
    owner = np.repeat(np.arange(2 * pairs), length)  # of every symbol: pair, or pair + pairs for the second side
    left = np.repeat(np.cumsum(length), length) - np.arange(len(symbols))  # symbols from here to the end
    many = int(symbols.max(initial=0)) + 1
    at, grams = np.arange(len(symbols)), owner % max(pairs, 1)
    first, second, used = np.zeros(pairs), np.zeros(pairs), np.zeros(pairs, np.int64)
    for n in range(1, orders + 1):
        keep = left[at] >= n
        at = at[keep]
        found, start, grams = np.unique(grams[keep] * many + symbols[at + n - 1], return_index=True, return_inverse=True)
        one = owner[at] < pairs
        hits = np.minimum(np.bincount(grams[one], minlength=len(found)), np.bincount(grams[~one], minlength=len(found)))
        hits = np.bincount(owner[at[start]] % max(pairs, 1), weights=hits, minlength=pairs)
        a, b = (np.maximum(x - n + 1, 0) for x in (length[:pairs], length[pairs:]))
        both = (a > 0) & (b > 0)
        first[both] += hits[both] / a[both]
        second[both] += hits[both] / b[both]
        used += both
    return first, second, used


def chrf_scores(preds: Sequence[str], refs: Sequence[str]) -> np.ndarray:
    """chrF++ of pairs that are counted together."""
    chars = [[np.frombuffer(_SPACE.sub("", t).encode("utf-32-le"), np.uint32).astype(np.int64) for t in side] for side in (preds, refs)]
    numbers: dict[str, int] = {}
    words = [[np.array([numbers.setdefault(w, len(numbers)) for w in chrf_words(t)], np.int64) for t in side] for side in (preds, refs)]
    parts = [_shares(chars, CHAR_ORDER), _shares(words, WORD_ORDER)]
    first, second, used = (sum(x) for x in zip(*parts))
    p, r = (x / np.maximum(used, 1) for x in (first, second))
    return np.where(p + r > 0, (1 + BETA ** 2) * p * r / np.where(p + r > 0, BETA ** 2 * p + r, 1), 0.0)


@F.pandas_udf(T.DoubleType())
def _chrf_udf(pred: pd.Series, ref: pd.Series) -> pd.Series:
    preds, refs = [x or "" for x in pred], [x or "" for x in ref]
    # groups of pairs of about CHRF_CHARS characters (or one pair) are counted together
    upto = np.cumsum([len(a) + len(b) for a, b in zip(preds, refs)])
    cuts = np.flatnonzero(np.diff(upto // CHRF_CHARS, prepend=-1)).tolist() + [len(preds)] if len(preds) else []
    scores = [chrf_scores(preds[i:j], refs[i:j]) for i, j in zip(cuts, cuts[1:])]
    return pd.Series(np.concatenate([*scores, np.zeros(0)]))


def chrf(df: DataFrame, id_col: str = "id", pred_col: str = "pred", ref_col: str = "ref",
         out: str = "chrf") -> DataFrame:
    """Sentence chrF++ / 100 (char order 6, word order 2, beta 2).

    Per order ``match = sum(min(count_pred, count_ref))``; precision and recall
    are averaged over the orders with n-grams on both sides; ``score =
    5PR / (4P + R)``.  Pairs are scored where they are: n-grams are never rows;
    those of a batch are integer codes counted together, one numpy sort per
    order.  NULL texts count as empty.
    """
    return df.withColumn(out, _chrf_udf(F.col(pred_col), F.col(ref_col)))


# ---------------------------------------------------------------------------
# J13 / A33 vector collapse diagnostics


def vector_collapse(df: DataFrame, group_col: str, vec_col: str) -> DataFrame:
    """A33 + J13 per group: mean over dimensions of the sample std, coefficient
    of variation of the norms (sample std / mean), and the mean off-diagonal
    cosine ``(|sum u|^2 - sum |u|^2) / (n (n - 1))`` of the unit vectors.
    O(N * d); no pairs are formed.  ``n < 2`` gives NULL cosine."""
    norm = F.sqrt(F.aggregate(vec_col, F.lit(0.0), lambda a, x: a + x * x))
    base = df.select(group_col, vec_col, norm.alias("__norm"))
    dims = base.select(group_col, "__norm", F.posexplode(vec_col).alias("__d", "__x"))
    unit = F.when(F.col("__norm") > 0, F.col("__x") / F.col("__norm")).otherwise(F.lit(0.0))
    per_dim = dims.groupBy(group_col, "__d").agg(F.stddev_samp("__x").alias("__sd"), F.sum(unit).alias("__su"))
    g1 = per_dim.groupBy(group_col).agg(F.avg("__sd").alias("vec_std"), F.sum(F.col("__su") ** 2).alias("__s2"))
    g2 = base.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.avg("__norm") > 0, F.stddev_samp("__norm") / F.avg("__norm")).alias("vec_norm_cv"),
        F.sum(F.when(F.col("__norm") > 0, 1.0).otherwise(0.0)).alias("__self"))
    out = g2.join(g1, group_col, "inner")
    cos = F.when(F.col("n") >= 2, (F.col("__s2") - F.col("__self")) / (F.col("n") * (F.col("n") - 1)))
    return out.select(group_col, F.col("n").cast("bigint"), "vec_std", "vec_norm_cv", cos.alias("mean_cosine_sim"))


def evaluate(pairs: DataFrame, vocab: DataFrame, *, id_col: str = "id", group_col: str = "source",
             pred_col: str = "pred", ref_col: str = "ref", vec_col: str | None = None) -> DataFrame:
    """T6 over all metrics: per group, tag-F1 per category and overall, ROUGE-L
    and chrF++ mean / population std, Dist-1 / Dist-2 and, with ``vec_col``, the
    collapse diagnostics of predicted vectors (T4), as long rows ``(source,
    metric, value)`` named ``source/metric`` (``_mean`` dropped)."""
    tf = tag_f1(pairs, vocab, id_col=id_col, group_col=group_col, pred_col=pred_col, ref_col=ref_col)
    tf_long = tf.select(group_col, F.explode(F.array(
        F.struct(F.concat(F.lit("tag_f1_"), F.col("category"), F.lit("_mean")).alias("metric"),
                 F.col("tag_f1_mean").alias("value")),
        F.struct(F.concat(F.lit("tag_f1_"), F.col("category"), F.lit("_std")).alias("metric"),
                 F.col("tag_f1_std").alias("value")))).alias("kv")).select(group_col, "kv.*")
    base = pairs.select(id_col, group_col, pred_col, ref_col)
    # both row scores in one pass over the pairs
    scored = chrf(rouge_l(base, pred_col, ref_col, "__rl"), id_col, pred_col, ref_col, "__cf").groupBy(group_col).agg(
        F.avg("__rl").alias("rougeL_mean"), F.stddev_pop("__rl").alias("rougeL_std"),
        F.avg("__cf").alias("chrf_mean"), F.stddev_pop("__cf").alias("chrf_std"))
    frames = [scored, dist_n(base, group_col, pred_col)]
    if vec_col is not None:
        frames.append(vector_collapse(pairs, group_col, vec_col).withColumnRenamed("vec_std", "pred_vec_std").drop("n"))
    wide = score_report(frames, group_col)
    tagged = tf_long.withColumn("metric", F.concat_ws("/", F.col(group_col).cast("string"),
                                                      F.regexp_replace("metric", "_mean$", "")))
    return wide.unionByName(tagged.select(group_col, "metric", F.col("value").cast("double")))


def score_report(metric_frames: Sequence[DataFrame], group_col: str = "source") -> DataFrame:
    """Union of wide per-group metric frames into long rows
    ``(source, metric, value)`` with ``source/metric`` names and ``_mean``
    suffixes removed (P22)."""
    longs = []
    for f in metric_frames:
        cols = [c for c in f.columns if c != group_col]
        longs.append(f.select(group_col, F.explode(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])).alias("kv"))
            .select(group_col, "kv.metric", "kv.value"))
    out = longs[0]
    for f in longs[1:]:
        out = out.unionByName(f)
    return out.withColumn("metric", F.concat_ws("/", F.col(group_col).cast("string"),
                                                F.regexp_replace("metric", "_mean$", "")))
