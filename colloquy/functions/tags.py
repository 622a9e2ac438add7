"""Tag sets and tag matching: H6, H7, H8.

Word characters are ``[\\pL\\pN_]`` in every pattern (Python's Unicode ``\\w``,
also understood by RE2, so SQL oracles use the same classes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.plans.small import if_small
from colloquy.session import ensure_checkpoint_dir

WORD = r"[\pL\pN_]+"
PIECE = r"[\pL\pN_]+|[^\pL\pN_]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def set_f1_eda(a: Column | str, b: Column | str) -> Column:
    """H6: set-F1 with the EDA edge rules: both lists missing/empty -> NULL,
    one missing -> 0, else ``2|A∩B| / (|A|+|B|)`` over distinct elements."""
    A, B = F.array_distinct(_c(a)), F.array_distinct(_c(b))
    a_ok = F.coalesce(F.size(_c(a)) > 0, F.lit(False))
    b_ok = F.coalesce(F.size(_c(b)) > 0, F.lit(False))
    inter = F.size(F.array_intersect(A, B))
    f1 = F.when(inter == 0, F.lit(0.0)).otherwise(2.0 * inter / (F.size(A) + F.size(B)))
    return F.when(~a_ok & ~b_ok, F.lit(None).cast("double")).when(~a_ok | ~b_ok, F.lit(0.0)).otherwise(f1)


def set_f1_metric(pred_n: Column, ref_n: Column, tp: Column) -> Column:
    """H7: set-F1 with the metric edge rules from set sizes: both empty -> 1,
    one empty -> 0, else ``2PR/(P+R)`` (0 when no overlap)."""
    p = tp / pred_n
    r = tp / ref_n
    return (F.when((pred_n == 0) & (ref_n == 0), F.lit(1.0))
            .when((pred_n == 0) | (ref_n == 0), F.lit(0.0))
            .when(tp == 0, F.lit(0.0))
            .otherwise(2 * p * r / (p + r)))


def tag_trie(vocab: DataFrame) -> DataFrame:
    """H8: the vocabulary (``category, tag``) as a trie over words: one row per
    prefix ``(depth, prefix, ends)``.  A prefix is the lowercase text of the first
    ``depth`` words with the separators between them, ``ends`` the ``(category,
    tag)`` that are complete there.  Tags that don't begin and end with a word
    can't stand between word boundaries and are left out."""
    tags = vocab.select("category", F.lower("tag").alias("tag")).distinct() \
        .withColumn("__pcs", F.transform(F.regexp_extract_all("tag", F.lit(PIECE), 0), F.lower)) \
        .withColumn("__n", ((F.size("__pcs") + 1) / 2).cast("int")) \
        .where((F.size("__pcs") % 2 == 1) & F.try_element_at("__pcs", F.lit(1)).rlike("^" + WORD))
    steps = F.transform(F.sequence(F.lit(1), F.col("__n")), lambda k: F.struct(
        k.alias("depth"), F.array_join(F.slice("__pcs", F.lit(1), 2 * k - 1), "").alias("prefix")))
    nodes = tags.select("category", "tag", "__n", F.explode(steps).alias("__x"))
    return nodes.groupBy(F.col("__x.depth").alias("depth"), F.col("__x.prefix").alias("prefix")).agg(
        F.collect_list(F.when(F.col("__n") == F.col("__x.depth"), F.struct("category", "tag"))).alias("ends"))


def _walk_trie(df: DataFrame, ids: list[str], text_col: str, vocab: DataFrame, depth: int) -> DataFrame:
    """One row per word of a text that begins a tag's path in the trie, with
    the tags that end after its first, second, ... word as ``__e1, __e2, ...``
    (NULL from where the path breaks off).  One join per depth; every prefix is one
    row of the trie, so the rows never multiply.  The trie is made and counted first:
    one within the limits of ``if_small`` is sent to every task, so that the words stay
    where they are; whether AQE knows its size before it moves the words is up to chance."""
    ensure_checkpoint_dir(df.sparkSession)
    trie = tag_trie(vocab).checkpoint()
    text = F.aggregate("ends", F.lit(0), lambda n, x: n + F.octet_length(x["category"]) + F.octet_length(x["tag"]))
    nodes, size = trie.agg(F.count("*"), F.sum(F.octet_length("prefix") + F.coalesce(text, F.lit(0)))).first()
    pieces = F.regexp_extract_all(_c(text_col), F.lit(PIECE), 0)
    words = df.select(*ids, pieces.alias("__pcs")).select(*ids, "__pcs", F.posexplode("__pcs").alias("__p", "__w")) \
        .where(F.col("__w").rlike("^" + WORD))
    walk = words.select(*ids, "__p", F.lower("__w").alias("__g"),
                        F.slice("__pcs", F.col("__p") + 2, max(2 * (depth - 1), 1)).alias("__tail"))
    for d in range(1, depth + 1):
        node = trie.where(F.col("depth") == d).select(F.col("prefix").alias("__g"), F.col("ends").alias(f"__e{d}"))
        if d > 1:
            longer = F.concat("__g", F.lower(F.try_element_at("__tail", F.lit(2 * d - 3))),
                              F.lower(F.try_element_at("__tail", F.lit(2 * d - 2))))
            # broken paths get keys of their own, so that they don't meet in one task
            walk = walk.withColumn("__g", F.coalesce(F.when(F.col(f"__e{d - 1}").isNotNull(), longer),
                                                     F.concat(F.lit("\u0000"), F.col("__p").cast("string"))))
        walk = walk.join(if_small(node, nodes, size or 0), "__g", "inner" if d == 1 else "left")
    return walk


def tag_mentions(df: DataFrame, id_col: str | list[str], text_col: str, vocab: DataFrame,
                 max_words: int | None = None) -> DataFrame:
    """H8: distinct ``(id..., category, tag)`` found by ``\\b(tag1|tag2|...)\\b``
    (IGNORECASE, alternatives longest first) scanned per category, without a
    regex built on the driver.

    The text is cut into alternating word / non-word pieces.  The vocabulary
    (``category, tag``) is a trie; a word is a candidate only if it begins a tag,
    and a candidate grows by its next separator and word only while the trie
    holds the longer prefix (``_walk_trie``; ``max_words`` = the trie's depth, read
    from the vocabulary if not given).  The
    regex scan is then replayed per ``(id, category)``: matches ordered by start,
    the longest at each start wins and a match starting inside an accepted one
    is skipped.  The replay folds the matches of one text only.
    """
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    if max_words is None:
        max_words = tag_trie(vocab).agg(F.max("depth")).first()[0]
    depth = max(int(max_words or 1), 1)
    walk = _walk_trie(df, ids, text_col, vocab, depth)

    def ended(d: int) -> Column:
        return F.transform(F.coalesce(F.col(f"__e{d}"), F.array()), lambda x: F.struct(
            x["category"].alias("category"), (-F.length(x["tag"])).alias("nl"),
            (F.col("__p") + 2 * d - 2).alias("e"), x["tag"].alias("t")))
    hits = walk.select(*ids, "__p", F.explode(F.concat(*[ended(d) for d in range(1, depth + 1)])).alias("__x"))
    per = hits.select(*ids, "__p", "__x.*").groupBy(*ids, "category").agg(F.array_sort(F.collect_list(F.struct(
        F.col("__p").alias("p"), "nl", "e", "t"))).alias("__m"))
    init = F.struct(F.lit(-1).cast("int").alias("end"), F.array().cast("array<string>").alias("tags"))
    scan = F.aggregate("__m", init, lambda acc, x: F.when(
        x["p"] > acc["end"], F.struct(x["e"].cast("int").alias("end"),
                                      F.array_union(acc["tags"], F.array(x["t"])).alias("tags"))).otherwise(acc))
    return per.select(*ids, "category", F.explode(scan["tags"]).alias("tag"))


# The scoring vocabulary per source and category (tag-F1, T1).
SCORING_VOCABULARY = {
    "expresso": {
        "accent": ["american"],
        "gender": ["female", "male"],
        "intrinsic_tags": ["authoritative", "booming", "crisp", "enunciated", "flowing", "loud", "nasal", "shrill",
                           "silky", "singsong"],
        "situational_tags": ["angry", "animated", "awed", "bored", "calm", "confused", "desirous", "disgusted",
                             "enunciated", "happy", "laughing", "loud", "passive", "saddened", "sarcastic", "scared",
                             "sleepy", "sympathetic", "whispered"],
        "noise": ["clean environment", "noisy environment", "environment balanced"],
        "pitch": ["high-pitched"],
        "speaking_rate": ["fast speed", "measured speed", "slow speed"],
    },
    "styletalk": {
        "emotion": ["cheerful tone", "excited tone", "friendly tone", "hopeful tone", "neutral tone", "sad tone",
                    "unfriendly tone"],
        "speaking_rate": ["fast speed", "normal speed", "slow speed"],
        "volume": ["loud volume", "normal volume", "quiet volume"],
    },
}


def vocabulary_frame(spark, source: str | None = None, vocab: dict | None = None) -> DataFrame:
    """The scoring vocabulary as a ``(source, category, tag)`` table (one source
    when ``source`` is given); a parameter table of a few dozen rows."""
    v = vocab if vocab is not None else SCORING_VOCABULARY
    rows = [(s, c, t) for s, cats in v.items() if source is None or s == source
            for c, tags in cats.items() for t in tags]
    return spark.createDataFrame(rows, "source string, category string, tag string")
