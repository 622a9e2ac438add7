"""Null handling: P8, P11, P19 (four kinds of missing -> one NULL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.text import strip_ws


def is_populated(df: DataFrame, col: str) -> Column:
    """P11: "populated" test by type.  Strings: not NULL, not ``'None'``, not
    blank; arrays: non-empty; doubles: not NULL and not NaN; else not NULL."""
    dt = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dt, T.StringType):
        return F.coalesce(c.isNotNull() & (c != "None") & (strip_ws(c) != ""), F.lit(False))
    if isinstance(dt, T.ArrayType):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def nan_to_null(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def safe_attr(col: Column | str) -> Column:
    """Null-safe attribute value: NULL / NaN -> ``''``, else the string form."""
    c = F.col(col) if isinstance(col, str) else col
    text = c.cast("string")     # of a NaN double or float: 'NaN'
    number = F.when(F.typeof(c).isin("double", "float"), text == "NaN").otherwise(F.lit(False))
    return F.when(text.isNull() | number, F.lit("")).otherwise(text).alias("attr")


def to_number(col: Column | str) -> Column:
    """Coerce to DOUBLE, bad values -> NULL (``pd.to_numeric(errors='coerce')``)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("string").try_cast("double")
