"""Corpus profiling: A1-A26, A34, A36, J10, J12, W9, W14, P12, P17, P24, F1, F3, G5, G6.

All aggregations are map-side combined ``groupBy``s (a hot group is reduced
in every map task before the shuffle).  Exact percentiles are computed from
global positions (``plans.rank``) instead of buffering a group's values.
Running totals over ordered aggregates use ``plans.blocks.running_agg``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.plans.select import order_statistics
from colloquy.plans.blocks import running_agg
from colloquy.plans.rank import rank_within


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total_hours(df: DataFrame, dur_col: str = "duration", by: Sequence[str] = ()) -> DataFrame:
    """A1 / A2: ``sum(duration) / 3600`` overall or per group."""
    agg = F.sum(dur_col) / 3600.0
    return df.groupBy(*by).agg(agg.alias("hours")) if by else df.agg(agg.alias("hours"))


def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """A3: counts per value (NULL kept unless ``dropna``)."""
    d = df.where(F.col(col).isNotNull()) if dropna else df
    return d.groupBy(col).agg(F.count(F.lit(1)).cast("bigint").alias("count"))


def tag_category(intrinsic: Column | str, situational: Column | str,
                 names: Sequence[str] = ("both", "intrinsic_only", "situational_only", "neither")) -> Column:
    """Both / intrinsic_only / situational_only / neither from two "populated" flags."""
    i, s = _c(intrinsic), _c(situational)
    both, first, second, neither = names
    return F.when(i & s, both).when(i, first).when(s, second).otherwise(neither)


def pivot_counts(df: DataFrame, row: str, col: str, values: Sequence | None = None) -> DataFrame:
    """A4: counts pivoted ``row x col``, missing cells 0."""
    p = df.groupBy(row).pivot(col, list(values) if values is not None else None).count()
    return p.fillna(0)


def pivot_hours(df: DataFrame, row: str, col: str, dur_col: str = "duration",
                values: Sequence | None = None) -> DataFrame:
    """A5: ``sum(duration)/3600`` pivoted, missing cells 0."""
    p = df.groupBy(row).pivot(col, list(values) if values is not None else None).agg(F.sum(dur_col) / 3600.0)
    return p.fillna(0.0)


def densify(domain: DataFrame, counts: DataFrame, key: str | Sequence[str], fill: dict | int = 0) -> DataFrame:
    """Put a distribution on a fixed / unioned label domain, missing = 0."""
    keys = [key] if isinstance(key, str) else list(key)
    out = domain.select(*keys).distinct().join(counts, keys, "left")
    return out.fillna(fill)


def crosstab_forced(df: DataFrame, row: str, col: str, row_domain: DataFrame,
                    col_values: Sequence[str]) -> DataFrame:
    """Crosstab with every row bin and every listed column value present."""
    counts = df.where(F.col(row).isNotNull() & F.col(col).isin(list(col_values))) \
        .groupBy(row).pivot(col, list(col_values)).count()
    return densify(row_domain, counts, row, 0)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long crosstab ``(a, b, count)``; NULL on either side dropped."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b) \
        .agg(F.count(F.lit(1)).cast("bigint").alias("count"))


def side_by_side(df: DataFrame, curr: str, res: str, label: str = "label") -> DataFrame:
    """Distributions of two columns on the union of their labels,
    missing = 0: ``(label, curr, res)``."""
    stacked = df.select(F.stack(F.lit(2), F.lit("curr"), F.col(curr), F.lit("res"), F.col(res))
                        .alias("role", label)).where(F.col(label).isNotNull())
    counts = stacked.groupBy(label).pivot("role", ["curr", "res"]).count()
    return counts.fillna(0)


def exact_percentiles(df: DataFrame, col: str, pcts: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated percentiles (numpy default) per group.

    The two ranks beside each percentile are found by radix selection (``plans.select``): histograms
    of an order-preserving key, narrowed round by round; no sort and no group's values in one task.
    Output ``(by..., pct, value)`` with ``pct`` in percent.
    """
    found = order_statistics(df, col, pcts, by)
    share = F.col("at") - F.floor("at")
    value = F.when(F.col("below") == F.col("above"), F.col("below")).otherwise(
        F.col("below") + share * (F.col("above") - F.col("below")))
    return found.select(*by, "pct", value.alias("value"))


def cutoff_shares(df: DataFrame, col: str, cutoffs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """For each cutoff, the count and percent of rows strictly above it (one pass)."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cutoffs):
        aggs.append(F.count_if(F.col(col) > F.lit(c)).alias(f"__a{i}"))
    g = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"__a{i}").alias("n_above"))
                     for i, c in enumerate(cutoffs)])
    return g.select(*by, "__n", F.explode(rows).alias("r")).select(
        *by, "r.cutoff", F.col("r.n_above").cast("bigint").alias("n_above"),
        (F.col("r.n_above") * 100.0 / F.col("__n")).alias("pct_above"))


def _percentile(found: DataFrame, pct: float) -> Column:
    """One percentile of a whole column as a scalar subquery (null of no values)."""
    return found.where(F.col("pct") == float(pct)).select("value").scalar()


def summary(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean / median / min / max / count; the median is exact, by radix
    selection (no group's values gathered in one task)."""
    aggs = [F.avg(col).alias("mean"), F.min(col).alias("min"), F.max(col).alias("max"),
            F.count(col).cast("bigint").alias("count")]
    if by:
        base = df.groupBy(*by).agg(*aggs)
        med = exact_percentiles(df, col, [50], by=by).select(*[F.col(c).alias("__m_" + c) for c in by], F.col("value").alias("median"))
        out = base.join(med, [F.col(c).eqNullSafe(F.col("__m_" + c)) for c in by], "left")
    else:
        one = df.select(col).checkpoint(eager=True)     # both passes read one frozen column
        out = one.agg(*aggs).withColumn("median", _percentile(exact_percentiles(one, col, [50]), 50))
    return out.select(*by, "mean", "median", "min", "max", "count")


def describe(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, std (sample), min, exact quartiles, max."""
    df = df.select(col).checkpoint(eager=True)            # both passes read one frozen column
    found = exact_percentiles(df, col, [25, 50, 75]).checkpoint()
    base = df.agg(F.count(col).cast("bigint").alias("count"), F.avg(col).alias("mean"),
                  F.stddev_samp(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"))
    return base.select("count", "mean", "std", "min", *[_percentile(found, p).alias(f"p{p}") for p in (25, 50, 75)], "max")


def conversation_lengths(df: DataFrame, conv_col: str, turn_col: str, audio: Column | None = None) -> DataFrame:
    """length = ``max(turn) + 1`` per conversation, and over audio rows."""
    aggs = [(F.max(turn_col) + 1).cast("bigint").alias("conv_len")]
    if audio is not None:
        aggs.append((F.max(F.when(audio, F.col(turn_col))) + 1).cast("bigint").alias("audio_len"))
    return df.groupBy(conv_col).agg(*aggs)


def histogram_fixed(df: DataFrame, col: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """``bins`` equal-width bins over the global min..max, half-open, the
    last bin closed.  Output ``(by..., bin, lo, hi, count)``; empty bins kept."""
    stats = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi")).first()
    # no value: bins of width 1 from 0, all empty
    lo, hi = float(stats["__lo"] or 0.0), float(stats["__hi"] or 0.0)
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, b.alias("bin")).agg(
        F.count(F.lit(1)).cast("bigint").alias("count"))
    spark = df.sparkSession
    dom = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if by:
        # groups x bins: the bin numbers (the parameter ``bins``) exploded into every group row
        dom = df.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = densify(dom, counts, [*by, "bin"], {"count": 0})
    return out.withColumn("lo", F.lit(lo) + F.col("bin") * F.lit(width)) \
        .withColumn("hi", F.lit(lo) + (F.col("bin") + 1) * F.lit(width))


def histogram_edges(df: DataFrame, col: str, edges: Sequence[float]) -> DataFrame:
    """A16 with explicit edges: bin i = [e_i, e_{i+1}), the last bin closed;
    values outside the edges are not counted."""
    e = [float(x) for x in edges]
    x = F.col(col)
    expr = None
    for i in range(len(e) - 1):
        cond = (x >= e[i]) & ((x < e[i + 1]) if i < len(e) - 2 else (x <= e[i + 1]))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    counts = df.select(expr.alias("bin")).where(F.col("bin").isNotNull()).groupBy("bin") \
        .agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    dom = df.sparkSession.createDataFrame([(i, e[i], e[i + 1]) for i in range(len(e) - 1)], "bin int, lo double, hi double")
    return densify(dom.select("bin"), counts, "bin", {"count": 0}).join(dom, "bin")


def percent_within(df: DataFrame, group: Sequence[str], count_col: str = "count", out: str = "pct") -> DataFrame:
    """``count / sum(count) over (partition by group) * 100`` on an
    aggregated table (one row per bin).  Without groups the total is one
    scalar aggregate (no single-partition window over all bins)."""
    if not group:
        total = df.agg(F.sum(count_col)).first()[0]
        return df.withColumn(out, F.col(count_col) * 100.0 / F.lit(total))
    return df.withColumn(out, F.col(count_col) * 100.0 / F.sum(count_col).over(Window.partitionBy(*group)))


def cumulative_share(df: DataFrame, order: Sequence[str], value: str, out_prefix: str = "cum") -> DataFrame:
    """Cumulative sum and percent in ``order`` on an aggregated table, in two
    levels (``running_agg``) so a long table is not windowed in one task."""
    ranked = rank_within(df, [], order, out="__pos")
    total = df.agg(F.sum(value)).first()[0] or 0
    run = running_agg(ranked.withColumn("__g", F.lit(0)), ["__g"], F.floor(F.col("__pos") / 4096),
                      ["__pos"], value, f"{out_prefix}_sum", how="sum")
    pct = F.col(f"{out_prefix}_sum") * 100.0 / F.lit(total) if total else F.lit(None).cast("double")
    return run.withColumn(f"{out_prefix}_pct", pct).drop("__g")


def first_crossing(cum: DataFrame, pct_col: str, order_col: str, thresholds: Sequence[float]) -> DataFrame:
    """For each threshold, the first row (in ``order_col``) whose cumulative
    percent reaches it."""
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"),
                              F.min(F.when(F.col(pct_col) >= t - 1e-9, F.col(order_col))).alias("first"))
                     for t in thresholds])
    return cum.agg(rows.alias("r")).select(F.explode("r").alias("x")).select("x.threshold", "x.first")


def null_target_report(df: DataFrame, target: str, by: str = "source") -> DataFrame:
    """Rows with a NULL target per group."""
    return df.where(F.col(target).isNull()).groupBy(by).agg(F.count(F.lit(1)).cast("bigint").alias("n_null"))


def vocabulary_rows(df: DataFrame, source_col: str, category_cols: Sequence[str]) -> DataFrame:
    """The distinct ``(source, category, tag)`` rows of a corpus; list
    columns are exploded, NULL tags dropped.  No list is gathered, so a category
    may hold any number of tags."""
    parts = []
    for c in category_cols:
        dt = df.schema[c].dataType.simpleString()
        v = F.explode_outer(F.col(c)) if dt.startswith("array") else F.col(c)
        parts.append(df.select(F.col(source_col).alias("source"), F.lit(c).alias("category"), v.alias("tag")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.where(F.col("tag").isNotNull()).distinct()


def vocabulary(df: DataFrame, source_col: str, category_cols: Sequence[str]) -> DataFrame:
    """A19 with one row per source and category: ``(source, category, tags
    ARRAY<STRING>)``, sorted.  The list is one cell, so this form is for
    vocabularies that are read by people; ``vocabulary_rows`` has no such bound."""
    return vocabulary_rows(df, source_col, category_cols).groupBy("source", "category") \
        .agg(F.array_sort(F.collect_list("tag")).alias("tags"))


def _json_string(c: Column | str) -> Column:
    return F.regexp_replace(F.to_json(F.array(_c(c))), r"^\[|\]$", "")


def vocabulary_lines(rows: DataFrame) -> DataFrame:
    """The document ``{source: {category: [tags]}}`` with sorted keys and tags
    as lines ``(pos, value)``; the values in order of ``pos`` make up the JSON
    text, one tag a line.

    ``rows`` are ``vocabulary_rows``.  Which brackets a tag opens or closes follows
    from the first and last key of its category, source and the whole (three
    grouped minima and maxima); nothing is gathered.  A NULL source is written
    under ``"null"``.  An empty vocabulary has no lines.
    """
    rows = rows.select(F.coalesce("source", F.lit("null")).alias("source"), "category", "tag").distinct()
    placed = rank_within(rows, [], ["source", "category", "tag"], out="pos")
    cats = rows.groupBy("source", "category").agg(F.min("tag").alias("__t0"), F.max("tag").alias("__t1"))
    srcs = cats.groupBy("source").agg(F.min("category").alias("__c0"), F.max("category").alias("__c1"))
    last = srcs.agg(F.max("source")).scalar()
    x = placed.join(cats, ["source", "category"]).join(srcs, "source")
    opens_cat = F.col("tag") == F.col("__t0")
    opens_src = opens_cat & (F.col("category") == F.col("__c0"))
    ends_cat = F.col("tag") == F.col("__t1")
    ends_src = ends_cat & (F.col("category") == F.col("__c1"))
    head = F.concat(F.when(F.col("pos") == 0, "{").otherwise(""),
                    F.when(opens_src, F.concat(_json_string("source"), F.lit(":{"))).otherwise(""),
                    F.when(opens_cat, F.concat(_json_string("category"), F.lit(":["))).otherwise(""))
    tail = F.when(ends_src & (F.col("source") == last), "]}}").when(ends_src, "]},").when(ends_cat, "],").otherwise(",")
    return x.select("pos", F.concat(head, _json_string("tag"), tail).alias("value"))


def write_vocabulary_json(rows: DataFrame, path: str) -> None:
    """``vocabulary_lines`` as text files; the part files in name order, one
    after the other, are the JSON document (``{}`` for an empty vocabulary)."""
    lines = vocabulary_lines(rows)
    if lines.isEmpty():
        lines = rows.sparkSession.createDataFrame([(0, "{}")], "pos long, value string")
    lines.repartitionByRange("pos").sortWithinPartitions("pos").select("value").write.mode("overwrite").text(path)


def vocabulary_json(vocab: DataFrame) -> DataFrame:
    """The same document as one string, from ``vocabulary``'s lists; for small
    vocabularies (the whole text is one cell)."""
    per_source = vocab.groupBy("source").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "tags")))).alias("m"))
    item = F.struct(F.col("source").alias("k"), F.concat(_json_string("source"), F.lit(":"), F.to_json("m")).alias("v"))
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda e: e["v"])     # sorted by key, like sort_keys
    return per_source.agg(F.concat(F.lit("{"), F.array_join(ordered, ","), F.lit("}")).alias("value"))


def tag_frequency(df: DataFrame, tags_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Tag counts and percent of all tag occurrences."""
    t = df.select(*by, F.explode(tags_col).alias("tag")).where(F.col("tag").isNotNull())
    c = t.groupBy(*by, "tag").agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    return percent_within(c, list(by), "count", "pct")


def tag_cooccurrence(df: DataFrame, first: str, second: str, keep_self: bool = True) -> DataFrame:
    """Unordered tag pairs over the concatenation of two tag lists, rows
    with fewer than two tags skipped; canonical ``(least, greatest)`` counts
    (Q8).  Pairs are formed inside one row's list (bounded by its length).
    Output ``(tag_a, tag_b, count, self_pair)``."""
    both = df.select(F.concat(F.coalesce(first, F.array().cast("array<string>")),
                              F.coalesce(second, F.array().cast("array<string>"))).alias("__t")) \
        .where(F.size("__t") >= 2)
    a = both.select("__t", F.posexplode("__t").alias("__i", "__a"))
    b = a.select("__i", "__a", F.posexplode("__t").alias("__j", "__b")).where(F.col("__i") < F.col("__j"))
    pairs = b.select(F.least("__a", "__b").alias("tag_a"), F.greatest("__a", "__b").alias("tag_b"))
    out = pairs.groupBy("tag_a", "tag_b").agg(F.count(F.lit(1)).cast("bigint").alias("count")) \
        .withColumn("self_pair", F.col("tag_a") == F.col("tag_b"))
    return out if keep_self else out.where(~F.col("self_pair"))


def tag_totals(cooc: DataFrame) -> DataFrame:
    """A21 ordering: per tag, the sum of its co-occurrence row (symmetric matrix)."""
    a = cooc.select(F.col("tag_a").alias("tag"), "count")
    b = cooc.where(~F.col("self_pair")).select(F.col("tag_b").alias("tag"), "count")
    return a.unionByName(b).groupBy("tag").agg(F.sum("count").cast("bigint").alias("total"))


def state_breakdown(df: DataFrame, state_col: str = "audio_idx") -> DataFrame:
    """Rows with audio (>= 0), text only (-1) and failed (-2)."""
    s = F.col(state_col)
    return df.agg(F.count_if(s >= 0).cast("bigint").alias("n_audio"),
                  F.count_if(s == -1).cast("bigint").alias("n_text_only"),
                  F.count_if(s == -2).cast("bigint").alias("n_failed"),
                  F.count(F.lit(1)).cast("bigint").alias("n_rows"))


def label_consistency(df: DataFrame, group: Sequence[str], label: str, min_rows: int = 2) -> DataFrame:
    """Per group (of at least ``min_rows`` rows) the share of non-null
    labels equal to the majority label and the unanimous flag (NULL when the
    group has no label).  Two aggregations, no per-group list."""
    g = list(group)
    sizes = df.groupBy(*g).agg(F.count(F.lit(1)).alias("n_rows"))
    lab = df.where(F.col(label).isNotNull()).groupBy(*g, label).agg(F.count(F.lit(1)).alias("__c"))
    per = lab.groupBy(*g).agg(F.max("__c").alias("__top"), F.sum("__c").alias("__tot"))
    out = sizes.where(F.col("n_rows") >= min_rows).join(per, g, "left")
    share = F.col("__top") / F.col("__tot")
    return out.select(*g, F.col("n_rows").cast("bigint"), share.alias("consistency"),
                      F.when(share.isNotNull(), share == 1.0).alias("unanimous"))


#: Up to this many distinct set sizes a token's pairs of sizes are summed one by one.
FEW_SIZES = 256
#: Step of the exponential sum for ``1 / v`` (relative error below 1e-12).
SPECTRUM_STEP = 0.3


def _reciprocal_nodes(largest: float = 2.0 ** 32) -> list[tuple[float, float]]:
    """``(t, w)`` with ``1 / v = sum w * exp(-t * v)`` for ``2 <= v <= largest``:
    the trapezoidal rule for ``int exp(-v e^u + u) du``."""
    low = math.floor((-math.log(largest) - 32) / SPECTRUM_STEP)
    high = math.ceil(math.log(20) / SPECTRUM_STEP)
    rates = [math.exp(SPECTRUM_STEP * i) for i in range(low, high + 1)]
    return [(t, SPECTRUM_STEP * t) for t in rates]


def _size_pair_sums(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Sum over unordered row pairs that share a token of ``2 / (s + s')``, in
    parts per group, from ``(group, __t, __k size, __c rows)``.

    Where a token has few sizes, its pairs of sizes are summed.  Beyond that,
    ``1 / (s + s')`` is written as a short sum of ``w exp(-t s) exp(-t s')``, which
    separates: ``sum_{s,s'} c c' / (s + s') = sum_t w P(t)^2`` with ``P(t) = sum_s
    c_s exp(-t s)``, less the rows paired with themselves.  ``P`` is an ordinary
    grouped sum, so the work is linear in the number of sizes and no list of
    sizes is gathered.
    """
    g = list(group)
    spread = [F.struct(F.lit(i).alias("j"), F.lit(t).alias("t"), F.lit(w).alias("w"))
              for i, (t, w) in enumerate(_reciprocal_nodes())]
    itself = F.struct(F.lit(-1).alias("j"), F.lit(0.0).alias("t"), F.lit(0.0).alias("w"))
    direct = F.struct(F.lit(-2).alias("j"), F.lit(0.0).alias("t"), F.lit(0.0).alias("w"))
    known = counts.withColumn("__d", F.count(F.lit(1)).over(Window.partitionBy(*g, "__t")))
    terms = known.select(*g, "__t", "__k", "__c", F.explode(
        F.when(F.col("__d") > FEW_SIZES, F.array(itself, *spread)).otherwise(F.array(direct))).alias("__n"))
    j = F.col("__n.j")
    part = F.when(j == -1, F.col("__c") / (2.0 * F.col("__k"))) \
        .when(j >= 0, F.col("__c") * F.exp(-F.col("__n.t") * F.col("__k")))
    sums = terms.groupBy(*g, "__t", "__n").agg(
        F.sum(part).alias("__p"),
        F.collect_list(F.when(j == -2, F.struct(F.col("__k").alias("s"), F.col("__c").alias("c")))).alias("__sc"))

    def pair_sum(arr):
        same = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x["c"] * (x["c"] - 1) / 2.0 / x["s"])
        cross = F.aggregate(arr, F.lit(0.0), lambda a, x: a + F.aggregate(
            F.filter(arr, lambda y: y["s"] > x["s"]), F.lit(0.0),
            lambda b, y: b + 2.0 * x["c"] * y["c"] / (x["s"] + y["s"])))
        return same + cross
    return sums.select(*g, F.when(j == -2, pair_sum(F.col("__sc"))).when(j == -1, -F.col("__p"))
                       .otherwise(F.col("__n.w") * F.col("__p") * F.col("__p")).alias("__f"))


def pairwise_set_f1(df: DataFrame, group: Sequence[str], tags_col: str, min_rows: int = 2) -> DataFrame:
    """A25 (+ J10, H6): mean set-F1 over all unordered row pairs of a group,
    pairs where both sets are missing skipped, one missing = 0.

    Without forming row pairs: for a token ``t`` shared by rows ``i, j``
    the pair earns ``2 / (s_i + s_j)`` (``s`` = set size), so
    ``sum F1 = sum_t [sum_s C(c_s,2)/s + sum_{s<s'} 2 c_s c_s' / (s+s')]``
    where ``c_s`` counts rows of size ``s`` holding ``t`` (``_size_pair_sums``).
    Valid pairs: ``C(n,2) - C(e,2)`` with ``e`` rows without tags.
    """
    g = list(group)
    rows = df.select(*g, F.array_distinct(F.coalesce(tags_col, F.array().cast("array<string>"))).alias("__s"))
    rows = rows.withColumn("__k", F.size("__s"))
    sizes = rows.groupBy(*g).agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col("__k") == 0).alias("__e"))
    tok = rows.where(F.col("__k") > 0).select(*g, "__k", F.explode("__s").alias("__t"))
    c = tok.groupBy(*g, "__t", "__k").agg(F.count(F.lit(1)).alias("__c"))
    tot = _size_pair_sums(c, g).groupBy(*g).agg(F.sum("__f").alias("__sum"))
    out = sizes.where(F.col("__n") >= min_rows).join(tot, g, "left")
    valid = F.col("__n") * (F.col("__n") - 1) / 2 - F.col("__e") * (F.col("__e") - 1) / 2
    mean = F.when(valid > 0, F.coalesce(F.col("__sum"), F.lit(0.0)) / valid)
    return out.select(*g, F.col("__n").cast("bigint").alias("n_rows"), mean.alias("mean_f1"))


def consistency_summary(groups: DataFrame, f1_col: str = "mean_f1") -> DataFrame:
    """Mean, median, sample std, perfect count and non-null count of the
    per-group F1 (median exact, by radix selection)."""
    groups = groups.select(f1_col).checkpoint(eager=True)  # the per-group table, computed once
    found = exact_percentiles(groups, f1_col, [50])
    base = groups.agg(F.avg(f1_col).alias("mean"), F.stddev_samp(f1_col).alias("std"),
                      F.count_if(F.col(f1_col) == 1.0).cast("bigint").alias("n_perfect"),
                      F.count(f1_col).cast("bigint").alias("n_valid"))
    return base.select("mean", _percentile(found, 50).alias("median"), "std", "n_perfect", "n_valid")


def per_speaker_summary(groups: DataFrame, speaker_col: str, conv_col: str,
                        consistency_col: str = "consistency", f1_col: str = "mean_f1") -> DataFrame:
    """Per speaker, the number of conversations and the mean label
    consistency and mean pairwise F1 of its groups."""
    return groups.groupBy(speaker_col).agg(F.count(conv_col).cast("bigint").alias("n_convs"),
                                           F.avg(consistency_col).alias("mean_consistency"),
                                           F.avg(f1_col).alias("mean_f1"))


def flagged_groups(groups: DataFrame, f1_col: str = "mean_f1", unanimous_col: str = "unanimous",
                   threshold: float = 0.5) -> DataFrame:
    """Groups that are not unanimous or whose F1 is below ``threshold``, by F1."""
    return groups.where((F.col(unanimous_col) == F.lit(False)) | (F.col(f1_col) < threshold)).orderBy(f1_col)


def nth_path_component(col: Column | str, n: int, sep: str = "/") -> Column:
    """``n``-th (0-based) component of a path, NULL when absent."""
    return F.try_element_at(F.split(_c(col), sep), F.lit(n + 1))
