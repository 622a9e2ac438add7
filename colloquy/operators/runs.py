"""Experiment-run analysis: S14, A27-A32, A35, F2, W10-W12, P15, P20, P22.

Run tables are ordinary DataFrames (``run, state, summary MAP, config MAP`` or
long ``(run, step, metric, value)`` histories).  Per-run series are indexed
with ``plans.rank`` and smoothed with bounded, halo-blocked windows, so one
very long run is not processed by one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.plans.blocks import BLOCK, running_agg
from colloquy.plans.rank import rank_within
from colloquy.plans.topk import top_k_per_group

TIE_TOLERANCE = 1e-6
SMOOTH_SPAN = 10
#: Rows of a history that become one step function, and the stand-in for a missing epoch.
PIECE_ROWS, NO_EPOCH = 65_536, -(1 << 63)


def tidy_summary(runs: DataFrame, run_col: str = "run_name", summary_col: str = "summary",
                 prefix: str | None = None) -> DataFrame:
    """Explode ``a/b/c`` summary keys into ``(run, kind, datasource, metric, value)``;
    keys starting with ``_`` are skipped; ``prefix`` keeps one kind (``test``,
    ``baseline``, ``trial``)."""
    kv = runs.select(run_col, F.explode(summary_col).alias("key", "value")).where(~F.col("key").startswith("_"))
    parts = F.split("key", "/")
    out = kv.select(run_col, parts.getItem(0).alias("kind"),
                    F.when(F.size(parts) >= 3, parts.getItem(1)).alias("datasource"),
                    F.element_at(parts, -1).alias("metric"), F.col("value").cast("double").alias("value"))
    return out.where(F.col("kind") == prefix) if prefix else out


def wide_results(runs: DataFrame, run_col: str = "run_name", summary_col: str = "summary", kind: str = "test",
                 trial: str | None = "trial", keep: Sequence[str] = (), datasource_col: str = "test_datasource") -> DataFrame:
    """S14 wide form: one row per run and datasource, a column per metric.

    ``kind/datasource/metric`` keys give the rows; ``trial/metric`` keys of the run stand beside them (a
    metric of the datasource before one of the same name); ``keep`` columns of the run are carried.
    Other keys, keys without three parts and keys starting with ``_`` are skipped; what a row has not
    is null; a run without ``kind`` keys gives no row.

    The columns are the metric names that occur, found in a first pass (names only: as many as
    ``spark.sql.pivotMaxValues`` allows); with them given, the pivot is one partial aggregation."""
    parts = F.split("key", "/")
    kv = runs.select(run_col, F.explode(summary_col).alias("key", "__value")).where(~F.col("key").startswith("_")) \
        .select(run_col, parts.alias("__p"), F.col("__value").cast("double").alias("__value"))
    own = kv.where((F.col("__p")[0] == kind) & (F.size("__p") >= 3)).select(
        run_col, F.col("__p")[1].alias("__source"), F.col("__p")[2].alias("__metric"), "__value")
    whole = kv.where((F.col("__p")[0] == (trial or "")) & (F.size("__p") >= 2)).select(run_col, F.col("__p")[1].alias("__metric"), "__value")
    most = int(runs.sparkSession.conf.get("spark.sql.pivotMaxValues"))

    def names(frame: DataFrame) -> list[str]:
        found = sorted(r[0] for r in frame.select("__metric").distinct().limit(most + 1).collect())
        if len(found) > most:
            raise ValueError(f"more than {most} metrics (spark.sql.pivotMaxValues)")
        return found

    own_names, trial_names = names(own), names(whole) if trial else []
    rows = own.groupBy(run_col, "__source").agg(*[
        F.max(F.when(F.col("__metric") == m, F.col("__value"))).alias(f"__o{i}") for i, m in enumerate(own_names)] or [F.lit(0).alias("__o")])
    if trial_names:
        beside = whole.groupBy(F.col(run_col).alias("__run")).agg(*[
            F.max(F.when(F.col("__metric") == m, F.col("__value"))).alias(f"__t{i}") for i, m in enumerate(trial_names)])
        rows = rows.join(beside, F.col(run_col).eqNullSafe(F.col("__run")), "left")
    for c in keep:
        one = runs.select(F.col(run_col).alias(f"__r_{c}"), F.col(c).alias(f"__k_{c}")).dropDuplicates([f"__r_{c}"])
        rows = rows.join(one, F.col(run_col).eqNullSafe(F.col(f"__r_{c}")), "left")
    place = {m: [f"__o{i}"] for i, m in enumerate(own_names)}
    for i, m in enumerate(trial_names):
        place.setdefault(m, []).append(f"__t{i}")
    return rows.select(run_col, F.col("__source").alias(datasource_col), *[F.col(f"__k_{c}").alias(c) for c in keep],
                       *[F.coalesce(*cols).alias(m) for m, cols in sorted(place.items())])


def finished_runs(runs: DataFrame, pattern: str, run_col: str = "run_name", state_col: str = "state") -> DataFrame:
    """Finished runs whose name matches ``pattern`` (e.g. ``^test_trial\\d+$``)."""
    return runs.where((F.col(state_col) == "finished") & F.col(run_col).rlike(pattern))


def flatten_config(runs: DataFrame, config_col: str = "config", run_col: str = "run_name",
                   keep: Sequence[str] = ()) -> DataFrame:
    """P20 (+ P19): config map -> long ``(run, keep..., field, raw, value)`` with numeric coercion."""
    return runs.select(run_col, *keep, F.explode(config_col).alias("field", "raw")) \
        .withColumn("value", F.col("raw").cast("string").try_cast("double"))


def strip_metric_name(col: Column | str, prefix: str | None = None) -> Column:
    """Drop a ``prefix/`` and a ``_mean`` suffix from metric names."""
    c = F.col(col) if isinstance(col, str) else col
    if prefix:
        c = F.regexp_replace(c, "^" + prefix + "/", "")
    return F.regexp_replace(c, "_mean$", "")


def metric_summary(long: DataFrame, group_cols: Sequence[str], metric_col: str = "metric",
                   value_col: str = "value") -> DataFrame:
    """Mean and sample std of every metric per group, ``*_std`` metrics
    excluded, rounded to 4 places."""
    d = long.where(~F.col(metric_col).endswith("_std"))
    return d.groupBy(*group_cols, metric_col).agg(F.round(F.avg(value_col), 4).alias("mean"),
                                                   F.round(F.stddev_samp(value_col), 4).alias("std"))


def best_per_metric(summary: DataFrame, dataset_col: str, metric_col: str = "metric",
                    lower_is_better: Sequence[str] = (), tol: float = TIE_TOLERANCE) -> DataFrame:
    """Flag the best mean per ``(dataset, metric)`` (max, or min for the
    lower-is-better metrics) within ``tol``; ``cell = 'mean ± std'`` to 3 places."""
    w = Window.partitionBy(dataset_col, metric_col)
    low = F.col(metric_col).isin(list(lower_is_better)) if lower_is_better else F.lit(False)
    best = F.when(low, F.min("mean").over(w)).otherwise(F.max("mean").over(w))
    out = summary.withColumn("is_best", F.abs(F.col("mean") - best) < tol)
    return out.withColumn("cell", mean_std_cell("mean", "std"))


def mean_std_cell(mean: Column | str, std: Column | str, places: int = 3) -> Column:
    """``'mean ± std'`` with ``places`` decimals, rounded half away from zero on
    the decimal value (engine-independent; a NULL std prints as 0)."""
    def fmt(c):
        c = F.col(c) if isinstance(c, str) else c
        return F.round(c.cast("decimal(38,10)"), places).cast(f"decimal(38,{places})").cast("string")
    return F.concat(fmt(mean), F.lit(" ± "), fmt(F.coalesce(F.col(std) if isinstance(std, str) else std, F.lit(0.0))))


def config_correlation(config_long: DataFrame, field_col: str = "field", value_col: str = "value",
                       loss_col: str = "loss") -> DataFrame:
    """Pearson correlation of each numeric config field with the loss
    (carried on the long rows), pairwise complete, sorted by correlation."""
    j = config_long.where(F.col(value_col).isNotNull() & F.col(loss_col).isNotNull())
    return j.groupBy(field_col).agg(F.corr(value_col, loss_col).alias("corr")).orderBy(F.col("corr").desc_nulls_last())


def baseline_mean(long: DataFrame, metric_col: str = "metric", value_col: str = "value") -> DataFrame:
    """Mean of every metric over (already filtered) finished baseline runs."""
    return long.groupBy(metric_col).agg(F.avg(value_col).alias("baseline_mean"))


def _steps_of(losses: list[float], epochs: list[int], min_delta: float) -> tuple[list[float], list[float], list[int]]:
    """What a piece of history makes of the best that comes in: a step function ``(below, loss, epoch)``.

    The first loss under ``incoming - min_delta`` is taken, and from there the rule runs on; all that it
    can take are losses below every earlier one.  So the outcome is followed back from the last of
    these.  Entry ``i`` holds for the first ``below[i] < incoming - min_delta``; of entries with one outcome the
    last stays."""
    low: list[float] = []
    at: list[int] = []
    for x, e in zip(losses, epochs):
        if x == x and (not low or x < low[-1]):
            low.append(x)
            at.append(e)
    end = [0] * len(low)  # which of them the rule ends with
    j = len(low)
    for i in range(len(low) - 1, -1, -1):
        # the first one under low[i] - min_delta moves left as low[i] grows
        while j > i + 1 and low[j - 1] < low[i] - min_delta:
            j -= 1
        while j < len(low) and not low[j] < low[i] - min_delta:
            j += 1
        end[i] = end[j] if j < len(low) else i
    keep = [i for i in range(len(low)) if i + 1 == len(low) or end[i + 1] != end[i]]
    return [low[i] for i in keep], [low[end[i]] for i in keep], [at[end[i]] for i in keep]


def fold_best(history: DataFrame, fold_cols: Sequence[str], epoch_col: str = "epoch",
              loss_col: str = "val_loss", min_delta: float = 1e-4) -> DataFrame:
    """Per fold, the best loss and epoch under the min-delta rule: a value
    is taken only if it is below the current best minus ``min_delta``.

    The rule is sequential, but a piece of a history acts on the best so far as a step function
    (``_steps_of``).  The sorted history is cut into pieces of ``PIECE_ROWS`` (a range shuffle: a long fold
    spans many tasks), each piece becomes its few steps, and only those meet per fold, applied one
    after another.  Null and NaN losses are never taken; a fold without any has an infinite loss and no epoch.
    """
    if min_delta < 0:
        raise ValueError("min_delta must not be negative")
    # the fold as one text, and a null epoch as the least number (both sort and compare in Python as here)
    fold = F.struct(*fold_cols)
    rows = history.select(F.to_json(fold).alias("__fold"), F.coalesce(F.col(epoch_col).cast("long"), F.lit(NO_EPOCH)).alias("__e"),
                          F.col(loss_col).cast("double").alias("__l"))
    parts = max(1, int(history.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    order = ["__fold", "__e", "__l"]
    names = ["__fold", "part", "piece", "below", "loss", "epoch"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, piece, now = TaskContext.get().partitionId(), 0, None
        losses: list[float] = []
        epochs: list[int] = []
        out: list[tuple] = []

        def close() -> None:
            nonlocal piece
            if losses:
                out.append((now, part, piece, *_steps_of(losses, epochs, min_delta)))
                piece += 1
                losses.clear()
                epochs.clear()

        for b in batches:
            of, loss, epoch = b["__fold"].tolist(), b["__l"].to_numpy(float).tolist(), b["__e"].tolist()
            for f, x, e in zip(of, loss, epoch):
                if f != now or len(losses) >= PIECE_ROWS:
                    close()
                    now = f
                losses.append(x)
                epochs.append(e)
            yield pd.DataFrame(out, columns=names)
            out.clear()
        close()
        yield pd.DataFrame(out, columns=names)

    schema = "__fold string, part long, piece long, below array<double>, loss array<double>, epoch array<long>"
    steps = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(run, schema)
    # a fold's pieces: its rows / PIECE_ROWS (and one more per task), each with its steps
    per = steps.groupBy("__fold").agg(F.array_sort(F.collect_list(F.struct("part", "piece", "below", "loss", "epoch"))).alias("__s"))
    start = F.struct(F.lit(float("inf")).alias("loss"), F.lit(None).cast("long").alias("epoch"))

    def apply(best: Column, s: Column) -> Column:
        # entries fall, so this many are not under it
        i = F.size(F.filter(s["below"], lambda x: x >= best["loss"] - F.lit(float(min_delta))))
        return F.when(i < F.size(s["below"]), F.struct(F.get(s["loss"], i).alias("loss"), F.get(s["epoch"], i).alias("epoch"))).otherwise(best)

    best = F.aggregate("__s", start, apply)
    kinds = history.select(fold.alias("f")).schema["f"].dataType
    return per.select(F.from_json("__fold", kinds).alias("f"), best.alias("b")).select(
        "f.*", F.col("b.loss").alias("best_val_loss"), F.nullif(F.col("b.epoch"), F.lit(NO_EPOCH)).alias("best_epoch"))


def cv_summary(folds: DataFrame, by: Sequence[str], loss_col: str = "best_val_loss",
               epoch_col: str = "best_epoch") -> DataFrame:
    """Mean / population std of fold loss and best epoch, and the mean
    epoch rounded half-to-even."""
    return folds.groupBy(*by).agg(
        F.avg(loss_col).alias("mean_val_loss"), F.stddev_pop(loss_col).alias("std_val_loss"),
        F.avg(epoch_col).alias("mean_best_epoch"), F.stddev_pop(epoch_col).alias("std_best_epoch"),
        F.bround(F.avg(epoch_col), 0).cast("bigint").alias("rounded_best_epoch"))


def top_k_runs(runs: DataFrame, dataset_col: str, order_col: str, k: int, run_col: str) -> DataFrame:
    """The ``k`` runs with the smallest ``order_col`` per dataset."""
    return top_k_per_group(runs, [dataset_col], [F.col(order_col), F.col(run_col)], k, out="rank")


def series_positions(long: DataFrame, run_cols: Sequence[str], order: Sequence[str], value_col: str,
                     out: str = "step") -> DataFrame:
    """Drop NULL values and renumber positions 0.. per run (W10's first step)."""
    return rank_within(long.where(F.col(value_col).isNotNull()), list(run_cols), list(order), out=out)


def ewm_mean(series: DataFrame, run_cols: Sequence[str], step_col: str, value_col: str,
             span: float = SMOOTH_SPAN, out: str = "ewm") -> DataFrame:
    """Exponentially weighted mean (``adjust=True``) per run over dense
    positions ``step`` (see ``series_positions``).

    ``y_t = sum_i w^(t-i) x_i / sum_i w^i`` with ``w = 1 - 2/(span+1)``, over all
    earlier rows.  Positions are cut into blocks of about ``300 * span`` rows,
    the most for which ``w^-block`` stays finite.  Each block has a decayed
    total; a total reaches the next blocks as ``w^distance * total`` (explode
    and sum, no window over a run) until ``w^distance`` times the largest
    double is zero; a row adds the window sum inside its own block.
    """
    w = 1.0 - 2.0 / (span + 1.0)
    if w <= 0:
        return series.withColumn(out, F.col(value_col).cast("double"))
    lnw = -math.log(w)
    block = max(1, int(600 / lnw))
    reach = int(math.ceil(1500 / (lnw * block))) + 1     # e^-1500 * 1e308 is zero
    data = series.withColumn(BLOCK, F.floor(F.col(step_col) / F.lit(block)).cast("bigint")) \
        .withColumn("__x", F.col(value_col).cast("double"))
    local = F.col(step_col) - F.col(BLOCK) * F.lit(block)            # 0 .. block - 1
    ends = data.groupBy(*run_cols, BLOCK).agg(F.sum(F.col("__x") * F.pow(F.lit(w), F.lit(block - 1) - local)).alias("__t"))
    # the power is taken in three parts, so that a large total meets a small weight without underflow
    far = (F.col("__k") - 1) * F.lit(block / 3.0)
    step = F.pow(F.lit(w), far)
    carry = ends.select(*run_cols, BLOCK, "__t", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("__k")) \
        .select(*[F.col(c).alias("__c_" + c) for c in run_cols], (F.col(BLOCK) + F.col("__k")).alias("__c_blk"),
                (F.col("__t") * step * step * step).alias("__t")) \
        .groupBy(*["__c_" + c for c in run_cols], "__c_blk").agg(F.sum("__t").alias("__carry"))
    win = Window.partitionBy(*run_cols, BLOCK).orderBy(step_col).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.sum(F.col("__x") * F.pow(F.lit(w), -local)).over(win) * F.pow(F.lit(w), local)
    cond = [F.col(BLOCK) == F.col("__c_blk")] + [F.col(c).eqNullSafe(F.col("__c_" + c)) for c in run_cols]
    joined = data.withColumn("__in", inside).join(carry, cond, "left")
    num = F.col("__in") + F.coalesce(F.col("__carry") * F.pow(F.lit(w), local + 1), F.lit(0.0))
    den = -F.expm1((F.col(step_col) + 1) * F.lit(-lnw)) / F.lit(1 - w)
    return joined.withColumn(out, num / den).drop(BLOCK, "__x", "__in", "__carry", "__c_blk", *["__c_" + c for c in run_cols])


def aligned_mean(series: DataFrame, run_cols: Sequence[str], step_col: str, value_col: str) -> DataFrame:
    """Align runs to the longest, hold each run's last value past its end,
    mean per step over all runs.

    ``mean(s) = (sum of runs still running at s + sum of last values of runs
    that ended before s) / #runs``; the second term is a running sum over run
    end positions (``running_agg``), so the step x run grid is never built.
    """
    r = series.select(*run_cols, step_col, F.col(value_col).cast("double").alias("__v"))
    per_step = r.groupBy(step_col).agg(F.sum("__v").alias("__alive"))
    lasts = r.groupBy(*run_cols).agg(F.max(F.struct(step_col, "__v")).alias("__last"))
    runs = lasts.agg(F.count(F.lit(1)).cast("double")).scalar()
    ended = lasts.select((F.col("__last").getField(step_col) + 1).alias(step_col),
                         F.col("__last").getField("__v").alias("__held")) \
        .groupBy(step_col).agg(F.sum("__held").alias("__held"))
    u = per_step.select(step_col, "__alive", F.lit(None).cast("double").alias("__held"), F.lit(1).alias("__kind")) \
        .unionByName(ended.select(step_col, F.lit(None).cast("double").alias("__alive"), "__held",
                                  F.lit(0).alias("__kind")))
    u = u.withColumn("__g", F.lit(0))
    run = running_agg(u, ["__g"], F.floor(F.col(step_col) / 4096), [step_col, "__kind"],
                      F.coalesce("__held", F.lit(0.0)), "__held_sum", how="sum")
    return run.where(F.col("__kind") == 1).select(step_col, ((F.col("__alive") + F.col("__held_sum")) / runs).alias("mean"))


def step_mean(series: DataFrame, step_col: str, value_col: str) -> DataFrame:
    """Mean per step without hold."""
    return series.groupBy(step_col).agg(F.avg(value_col).alias("mean"))
