"""Splits, sampling and leak checks: X1-X10, F4-F6, P10, P13, J6, J7, J14, G3, G4.

Contract (Q5): numpy / ``random`` draws cannot be reproduced on Spark, so every
shuffle is the order of ``md5(concat_ws(':', seed, key))``: deterministic by
seed, the same sizes as the reference, disjoint parts.  Global positions come
from ``plans.rank.rank_within`` (range-partitioned, no single-task window);
per-group picks from ``plans.topk`` (salted two-stage ranking).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.plans.hashing import seeded_key
from colloquy.plans.permute import permuted
from colloquy.plans.rank import rank_within
from colloquy.plans.topk import top_k_per_group

# Fixed values of the held-out test set.
TEST_SEED = 999
TEST_NUM_TURNS = 5
TEST_N_CHAINS_PER_SOURCE = 200


def shuffled_ids(df: DataFrame, id_col: str, seed: int, out: str = "pos") -> DataFrame:
    """Distinct ids with their 0-based position in the seeded shuffle."""
    ids = df.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    return rank_within(ids.withColumn("__h", seeded_key(seed, id_col)), [], ["__h", id_col], out=out) \
        .drop("__h")


def _count(df: DataFrame) -> int:
    return int(df.count())


def train_val_split(df: DataFrame, id_col: str = "conv_id", val_split: float = 0.1,
                    seed: int = 42) -> DataFrame:
    """``(id, split)``: the first ``int(n * (1 - val_split))`` shuffled ids
    are ``train``, the rest ``val``."""
    ids = shuffled_ids(df, id_col, seed)
    n = _count(ids)
    cut = int(n * (1 - val_split))
    return ids.select(id_col, "pos", F.when(F.col("pos") < cut, F.lit("train")).otherwise(F.lit("val"))
                      .alias("split"))


def fold_of(pos: Column, n: int, k: int) -> Column:
    """``np.array_split`` chunk of position ``pos``: the first ``n mod k``
    chunks have one extra element."""
    q, rem = divmod(n, k)
    big = rem * (q + 1)
    if q == 0:
        return pos.cast("int")
    return F.when(pos < big, F.floor(pos / (q + 1))).otherwise(
        F.lit(rem) + F.floor((pos - big) / q)).cast("int")


def k_folds(df: DataFrame, id_col: str = "conv_id", n_folds: int = 5, seed: int = 42) -> DataFrame:
    """``(id, fold)`` for ``n_folds`` near-equal folds; ``n_folds <= 1``
    gives one fold with the first 80 % as train (``fold = -1`` marks train)."""
    ids = shuffled_ids(df, id_col, seed)
    n = _count(ids)
    if n_folds <= 1:
        cut = int(n * 0.8)
        return ids.select(id_col, "pos", F.when(F.col("pos") < cut, F.lit(-1)).otherwise(F.lit(0)).alias("fold"))
    return ids.select(id_col, "pos", fold_of(F.col("pos"), n, n_folds).alias("fold"))


def fold_pairs(folds: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Expand ``(id, fold)`` to ``(fold_idx, id, role)`` with role train / val;
    rows grow by the parameter ``n_folds`` only."""
    n_folds = folds.agg(F.max("fold")).first()[0] + 1
    all_f = F.array(*[F.lit(i) for i in range(int(n_folds))])
    return folds.select(id_col, F.explode(all_f).alias("fold_idx"), "fold") \
        .select("fold_idx", id_col, F.when(F.col("fold") == F.col("fold_idx"), "val").otherwise("train")
                .alias("role"))


def fixed_test_chains(chains: DataFrame, *, source_col: str = "source", key_cols: Sequence[str],
                      num_turns: int = TEST_NUM_TURNS, per_source: int = TEST_N_CHAINS_PER_SOURCE,
                      seed: int = TEST_SEED, chain_col: str = "chain") -> DataFrame:
    """Per source up to ``per_source`` chains in the seeded order, each
    sliced to its last ``num_turns`` turns.  ``chains`` must be built at
    ``TEST_NUM_TURNS``."""
    keyed = chains.withColumn("__h", seeded_key(seed, F.lower(F.col(source_col)), *key_cols))
    picked = top_k_per_group(keyed.withColumn("__src", F.lower(F.col(source_col))), ["__src"],
                             ["__h", *key_cols], per_source, out="test_rank")
    k = int(num_turns)
    sliced = F.when(F.size(chain_col) <= k, F.col(chain_col)).otherwise(F.slice(chain_col, -k, k))
    return picked.withColumn(chain_col, sliced).drop("__h", "__src")


def holdout(df: DataFrame, id_col: str = "conv_id", fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """``(id, split)`` with ``max(1, int(n * fraction))`` shuffled ids as test."""
    ids = shuffled_ids(df, id_col, seed)
    n = _count(ids)
    m = max(1, int(n * fraction))
    return ids.select(id_col, "pos", F.when(F.col("pos") < m, F.lit("test")).otherwise(F.lit("pool"))
                      .alias("split"))


def cross_source_holdout(df: DataFrame, source_col: str, pool_source: str) -> DataFrame:
    """X5 cross-source form: pool = one source, test = the others."""
    return df.withColumn("split", F.when(F.lower(F.col(source_col)) == pool_source.lower(), "pool")
                         .otherwise("test"))


def few_shot_pairs(queries: DataFrame, pool: DataFrame, *, query_key: str, pool_key: str,
                   k: int, seed: int = 42, max_queries: int | None = None) -> DataFrame:
    """Per query ``min(k, |pool|)`` distinct pool rows, drawn for each query by itself;
    with ``max_queries`` only that many query rows are first drawn in the seeded
    order (the evaluation sample size is the feature).

    The pool gets one global seeded order (positions 0..P-1).  Every query has its own
    permutation of the positions (``plans.permute``, keyed by seed and query key); shot ``j``
    is its place ``j``, computed in the query's row.  ``|queries| * k`` rows, an equi-join on
    position; no cross product of queries and pool, no order of the pool per query.
    """
    if max_queries is not None:
        queries = seeded_sample(queries, int(max_queries), query_key, seed).drop("sample_rank")
    # only (hash, key) is ranked and checkpointed; the pool rows join by their unique key
    ranked = rank_within(pool.withColumn("__h", seeded_key(seed, pool_key)), [], ["__h", pool_key],
                         out="__ppos", row_key=pool_key).drop("__h")
    p = _count(ranked)
    kk = min(int(k), p)
    if kk == 0:
        from pyspark.sql import types as T
        fields = queries.select(query_key).schema.fields + [T.StructField("shot", T.IntegerType())] + \
            [f for f in ranked.schema.fields if f.name != "__ppos"]
        return queries.sparkSession.createDataFrame([], T.StructType(fields))
    q = queries.select(query_key, F.explode(F.sequence(F.lit(0), F.lit(kk - 1))).alias("shot")) \
        .withColumn("__ppos", permuted(F.col("shot"), p, seeded_key(seed, F.lit("q"), query_key)))
    return q.join(ranked, "__ppos", "inner").drop("__ppos")


def proportional_allocation(counts: DataFrame, k: int, source_col: str = "source",
                            n_col: str = "n") -> DataFrame:
    """X7 allocation: per source (name order) ``round_half_even(k * n / total)``
    capped by ``n``; the last source takes ``max(0, k - allocated)`` capped by
    ``n``.  ``counts`` has one row per source (bounded by #sources)."""
    w_all = Window.orderBy(source_col).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w_prev = Window.orderBy(source_col).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(n_col).over(w_all)
    base = F.least(F.bround(F.lit(float(k)) * F.col(n_col) / total, 0).cast("bigint"), F.col(n_col))
    c = counts.withColumn("__base", base) \
        .withColumn("__last", F.row_number().over(Window.orderBy(F.col(source_col).desc())) == 1)
    c = c.withColumn("__before", F.coalesce(F.sum("__base").over(w_prev), F.lit(0)))
    alloc = F.when(F.col("__last"), F.least(F.greatest(F.lit(k) - F.col("__before"), F.lit(0)), F.col(n_col))) \
        .otherwise(F.col("__base"))
    return c.select(source_col, n_col, alloc.cast("bigint").alias("alloc"))


def proportional_few_shot(pool: DataFrame, k: int, *, source_col: str, key_cols: Sequence[str],
                          seed: int = 42) -> DataFrame:
    """Proportional few-shot set; picks inside a source follow the seeded order."""
    src = pool.withColumn("__src", F.lower(F.coalesce(F.col(source_col).cast("string"), F.lit("unknown"))))
    counts = src.groupBy("__src").agg(F.count(F.lit(1)).alias("n"))
    alloc = proportional_allocation(counts, k, "__src", "n")
    keyed = src.withColumn("__h", seeded_key(seed, "__src", *key_cols)).join(
        alloc.select("__src", "alloc"), "__src", "inner")
    picked = top_k_per_group(keyed, ["__src"], ["__h", *key_cols], F.col("alloc"), out="shot_rank")
    return picked.drop("__h", "alloc", "__src")


def capped_rows(max_rows: int, max_turns: int) -> int:
    """a row cap rounded down to a multiple of the turns per conversation."""
    if max_rows >= 0 and max_turns > 0 and max_rows % max_turns:
        return (max_rows // max_turns) * max_turns
    return max_rows


def sample_conversations(rows: DataFrame, *, max_rows: int, max_turns: int, shares: Mapping[str, float],
                         source_col: str = "source", turn_col: str = "turn_index",
                         path_col: str = "relative_audio_path", prev_col: str = "prev_filename",
                         seed: int = 42) -> DataFrame:
    """X8 (+ F5, Q10, J3, J5): sample whole conversations for a small build.

    Rows beyond ``turn_index <= max_turns - 1`` are dropped; the row cap is
    rounded down to whole conversations (``n = max_rows // max_turns``); per
    source (in the given order) ``round_half_even(n * share)`` anchors, the last
    source taking the remainder, are drawn in the seeded order among rows at
    ``turn_index = max_turns - 1``; every anchor is walked back through
    ``prev_filename`` (a missing link ends the walk) and the reached rows kept.
    """
    from colloquy.operators.chains import walk_links
    r = rows.where(F.col(turn_col) <= int(max_turns) - 1)
    if max_rows < 0:
        return r
    n = capped_rows(int(max_rows), int(max_turns)) // int(max_turns)
    names = list(shares)
    alloc, used = {}, 0
    for i, s in enumerate(names):
        alloc[s] = (n - used) if i == len(names) - 1 else int(round(n * shares[s]))
        used += alloc[s]
    kcol = reduce(lambda acc, s: acc.when(F.col(source_col) == s, F.lit(alloc[s])), names[1:],
                  F.when(F.col(source_col) == names[0], F.lit(alloc[names[0]]))).otherwise(F.lit(0))
    anchors = r.where(F.col(turn_col) == int(max_turns) - 1) \
        .withColumn("__h", seeded_key(seed, path_col)).withColumn("__k", kcol)
    picked = top_k_per_group(anchors, [source_col], ["__h", path_col], F.col("__k"), out="__r").select(path_col)
    reached = walk_links(r, picked, int(max_turns), path_col=path_col, prev_col=prev_col, strict=False)
    return r.join(reached.select(path_col).distinct(), path_col, "left_semi")


def first_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """the first ``n`` rows in an explicit order (a row cap is the feature)."""
    return df.orderBy(*order).limit(int(n))


def matches_all(criteria: Mapping[str, object]) -> Column:
    """Row equals every ``column = value`` criterion."""
    return reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in criteria.items()], F.lit(True))


def balance_majority(df: DataFrame, criteria: Mapping[str, object], n_remove: int, key_col: str,
                     seed: int = 42) -> DataFrame:
    """Remove up to ``n_remove`` seeded rows matching ``criteria``; the rest stay."""
    cand = df.where(matches_all(criteria)).select(key_col, seeded_key(seed, key_col).alias("__h")) \
        .withColumn("__b", F.substring("__h", 1, 4))
    # counts of the 65,536 hash prefixes say which prefixes go whole and which one holds the cut
    upto = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefixes = cand.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")).withColumn("__upto", F.sum("__n").over(upto))
    went = cand.join(prefixes.where(F.col("__upto") - F.col("__n") < int(n_remove)), "__b")
    whole = went.where(F.col("__upto") <= int(n_remove)).select(key_col)
    # one prefix at most: a 65,536th of the rows
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key_col))
    cut = went.where(F.col("__upto") > int(n_remove)).withColumn("__r", place) \
        .where(F.col("__r") <= int(n_remove) - (F.col("__upto") - F.col("__n"))).select(key_col)
    return df.join(whole.unionByName(cut), key_col, "left_anti")


def keep_allowed(df: DataFrame, ids: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Keep rows whose id is in ``ids`` (left semi join)."""
    return df.join(ids.select(id_col), id_col, "left_semi")


def remove_ids(df: DataFrame, ids: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Drop rows whose id is in ``ids`` (left anti join)."""
    return df.join(ids.select(id_col), id_col, "left_anti")


def leak_check(a: DataFrame, b: DataFrame, id_col: str = "conv_id", examples: int = 5) -> DataFrame:
    """Ids on both sides; one row ``(n_overlap, examples)``."""
    both = a.select(id_col).distinct().intersect(b.select(id_col).distinct())
    # examples: at most ``examples`` ids (top-k), stacked under the full overlap and
    # reduced in one aggregation, so the collected list never holds the whole overlap
    ex = top_k_per_group(both.withColumn("__g", F.lit(0)), ["__g"], [id_col], int(examples), out="__r") \
        .select(id_col, F.lit(True).alias("__ex"))
    rows = both.select(id_col, F.lit(False).alias("__ex")).unionByName(ex)
    return rows.agg(F.count_if(~F.col("__ex")).cast("bigint").alias("n_overlap"),
                    F.array_sort(F.collect_list(F.when(F.col("__ex"), F.col(id_col).cast("string"))))
                    .alias("examples"))


def assert_no_leak(a: DataFrame, b: DataFrame, id_col: str = "conv_id") -> None:
    """Raise with up to five examples when the sides share ids."""
    both = a.select(id_col).intersect(b.select(id_col)).limit(6).collect()
    if both:
        raise AssertionError(f"{len(both)}+ ids leak between splits, e.g. {[r[0] for r in both[:5]]}")


def train_pool(all_ids: DataFrame, test_ids: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Train ids = every id not in the test set (checked for leaks)."""
    pool = remove_ids(all_ids.select(id_col).distinct(), test_ids, id_col)
    return pool


def seeded_sample(df: DataFrame, n: int, key_col: str, seed: int = 42) -> DataFrame:
    """``n`` rows in the seeded order (a sampling operator: the limit is the feature)."""
    g = df.withColumn("__h", seeded_key(seed, key_col)).withColumn("__g", F.lit(0))
    return top_k_per_group(g, ["__g"], ["__h", key_col], int(n), out="sample_rank").drop("__h", "__g")
