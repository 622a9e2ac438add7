"""Exact order statistics by radix selection: no sort, no ranks, no group in one task.

A value becomes a 64-bit key of the same order (whole numbers are their own key, of a double the bits).
For every wanted rank there is an interval of keys that holds it and the number of keys below.  A
round counts the keys of each interval in ``BINS`` equal bins (partial counts before the shuffle, at most
``BINS`` rows for an interval), and the bin that the rank falls into becomes the interval, narrowed to
the keys that occur in it.  Each round divides the width by ``BINS``, so six are enough for 64 bits;
few distinct values, or few rows, end earlier.

The narrow ``(group, key)`` rows are checkpointed once and scanned by every round.  Intervals are a small
table (ranks x groups), joined on the group; what reaches the driver is whether a round is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.session import ensure_checkpoint_dir

BINS = 4096
#: Fixed: a double has 52 bits of fraction, exponents from -1022 on (below: multiples of 2^-1074).
_FRACTION, _LEAST_EXPONENT = 1 << 52, -1022
_INFINITE = 2047 * _FRACTION


def _long(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("bigint")


def double_key(x: Column) -> Column:
    """A bigint of the same order as the double; NaN above all, -0.0 as 0.0."""
    size = F.abs(x)
    rough = F.floor(F.log2(size))
    # the logarithm is rounded: the exponent may be one off beside a power of two
    exponent = rough - (F.pow(F.lit(2.0), rough) > size).cast("int") + (F.pow(F.lit(2.0), rough + 1) <= size).cast("int")
    power = F.pow(F.lit(2.0), exponent)
    normal = _long(exponent - _LEAST_EXPONENT + 1) * _long(_FRACTION) + _long((size / power - 1.0) * float(_FRACTION))
    low = _long(size * F.pow(F.lit(2.0), F.lit(537.0)) * F.pow(F.lit(2.0), F.lit(537.0)))
    key = F.when(F.isnan(x), _long(_INFINITE + 1)).when(size == float("inf"), _long(_INFINITE)) \
        .when(size < 2.0 ** _LEAST_EXPONENT, low).otherwise(normal)
    return F.when(x < 0, -key).otherwise(key)


def double_of(key: Column) -> Column:
    """The double of a key."""
    size = F.abs(key)
    exponent = F.shiftright(size, 52)
    fraction = F.pmod(size, _long(_FRACTION)).cast("double") / float(_FRACTION)
    normal = (fraction + 1.0) * F.pow(F.lit(2.0), exponent + (_LEAST_EXPONENT - 1))
    low = size.cast("double") / F.pow(F.lit(2.0), F.lit(537.0)) / F.pow(F.lit(2.0), F.lit(537.0))
    value = F.when(size > _INFINITE, F.lit(float("nan"))).when(size == _INFINITE, F.lit(float("inf"))) \
        .when(size < _FRACTION, low).otherwise(normal)
    return F.when(key < 0, -value).otherwise(value)


def order_statistics(df: DataFrame, col: str, pcts: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., pct, at, below, above)``: for each percent ``p`` of each group the place ``at = (n - 1) * p / 100``
    and the values at the ranks ``floor(at)`` and ``ceil(at)``, as doubles.  Nulls have no rank; a null
    group is a group; groups without values give no rows."""
    ensure_checkpoint_dir(df.sparkSession)
    by, names = list(by), [f"__g{i}" for i in range(max(1, len(by)))]
    whole = isinstance(df.schema[col].dataType, T.IntegralType)
    key = _long(F.col(col)) if whole else double_key(F.col(col).cast("double"))
    # without groups every row is in group 0 (of the key, so that it stays a column to join on)
    groups = [F.col(c) for c in by] or [F.pmod(F.hash(F.col(col)), F.lit(1))]
    data = df.where(F.col(col).isNotNull()).select(*[g.alias(n) for g, n in zip(groups, names)], key.alias("__k")).checkpoint()
    g = [F.col(n) for n in names]
    low, high = F.when(F.col("__k") < 0, F.col("__k")), F.when(F.col("__k") >= 0, F.col("__k"))
    spans = data.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.count(low).alias("__neg"), F.min(low).alias("__a"),
                                     F.max(low).alias("__b"), F.min(high).alias("__c"), F.max(high).alias("__d"))
    wanted = spans.select(*names, "__neg", "__a", "__b", "__c", "__d", "n", F.explode(F.array(*[F.lit(float(p)) for p in pcts])).alias("pct")) \
        .withColumn("at", (F.col("n") - 1) * F.col("pct") / 100.0).checkpoint()
    ranks = wanted.select(*names, "__neg", "__a", "__b", "__c", "__d", F.explode(F.array(
        _long(F.floor("at")), F.least(_long(F.ceil("at")), F.col("n") - 1))).alias("__rank")).distinct()
    # keys of one sign, so that widths fit
    negative = F.col("__rank") < F.col("__neg")
    state = ranks.select(*names, "__rank", F.when(negative, F.col("__a")).otherwise(F.col("__c")).alias("__lo"),
                         F.when(negative, F.col("__b")).otherwise(F.col("__d")).alias("__hi"),
                         F.when(negative, F.lit(0)).otherwise(F.col("__neg")).cast("bigint").alias("__below")).checkpoint()
    while not state.where(F.col("__lo") < F.col("__hi")).isEmpty():
        width = F.expr(f"(__hi - __lo) div {BINS} + 1")
        open_ = state.where(F.col("__lo") < F.col("__hi"))
        intervals = open_.select(*[F.col(n).alias(f"__i{n}") for n in names], "__lo", "__hi", width.alias("__w")).distinct()
        same = [F.col(n).eqNullSafe(F.col(f"__i{n}")) for n in names]
        inside = data.join(intervals, [*same, F.col("__k") >= F.col("__lo"), F.col("__k") <= F.col("__hi")])
        bins = inside.groupBy(*names, "__lo", F.expr("(__k - __lo) div __w").alias("__bin")).agg(
            F.count(F.lit(1)).alias("__n"), F.min("__k").alias("__least"), F.max("__k").alias("__most"))
        # BINS rows at most for each interval
        upto = F.sum("__n").over(Window.partitionBy(*names, "__lo").orderBy("__bin"))
        bins = bins.select(*[F.col(n).alias(f"__i{n}") for n in names], F.col("__lo").alias("__ilo"), "__least", "__most",
                           (upto - F.col("__n")).alias("__before"), upto.alias("__upto"))
        place = F.col("__rank") - F.col("__below")
        found = open_.join(bins, [*same, F.col("__lo") == F.col("__ilo"), place >= F.col("__before"), place < F.col("__upto")]) \
            .select(*names, "__rank", F.col("__least").alias("__lo"), F.col("__most").alias("__hi"),
                    (F.col("__below") + F.col("__before")).alias("__below"))
        state = state.where(F.col("__lo") >= F.col("__hi")).unionByName(found).checkpoint()
    value = F.col("__lo").cast("double") if whole else double_of(F.col("__lo"))
    values = state.select(*[F.col(n).alias(f"__i{n}") for n in names], "__rank", value.alias("__v"))
    same = [F.col(n).eqNullSafe(F.col(f"__i{n}")) for n in names]
    ends = wanted.select(*names, "pct", "at", F.explode(F.array(_long(F.floor("at")), F.least(_long(F.ceil("at")), F.col("n") - 1))).alias("__r")) \
        .join(values, [*same, F.col("__r") == F.col("__rank")])
    out = ends.groupBy(*names, "pct", "at").agg(F.min(F.struct("__r", "__v")).alias("__f"), F.max(F.struct("__r", "__v")).alias("__c"))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, by)], "pct", "at", F.col("__f.__v").alias("below"),
                      F.col("__c.__v").alias("above"))
