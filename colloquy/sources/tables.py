"""Table sources and sinks.

Readers return lazy DataFrames; Catalyst prunes columns and pushes filters
into the Parquet scan, so callers select only what they use.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None,
                 schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan, optionally pruned to ``columns``."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    paths = [path] if isinstance(path, str) else list(path)
    df = reader.parquet(*paths)
    return df.select(*columns) if columns else df


def read_driver_table(spark: SparkSession, sf_dir: str, name: str,
                      columns: Sequence[str] | None = None) -> DataFrame:
    return read_parquet(spark, table_path(sf_dir, name), columns)


def read_csv_table(spark: SparkSession, path: str | Sequence[str],
                   schema: T.StructType | None = None,
                   null_tokens: Sequence[str] = ("NA", ""), multi_line: bool = True) -> DataFrame:
    """S3: CSV with header, UTF-8; every token in ``null_tokens`` becomes NULL.

    With ``multi_line`` quoted cells may hold line breaks and a file is one
    task; without it a row is a line and large files are split over tasks.
    Spark's ``nullValue`` takes a single token, so the rest are mapped with a
    projection (string columns only).
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", multi_line)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", False)
    paths = [path] if isinstance(path, str) else list(path)
    df = reader.csv(paths)
    tokens = list(null_tokens)
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType) and tokens:
            cols.append(F.when(F.col(f.name).isin(tokens), F.lit(None).cast("string"))
                        .otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def read_table(spark: SparkSession, path: str, **kwargs) -> DataFrame:
    """Choose the reader by suffix (``.parquet`` else CSV)."""
    if path.rstrip("/").endswith(".parquet"):
        return read_parquet(spark, path, kwargs.get("columns"), kwargs.get("schema"))
    return read_csv_table(spark, path, kwargs.get("schema"), multi_line=kwargs.get("multi_line", True))


def stack_splits(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack several splits by column name, missing columns as NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_keyed_json(spark: SparkSession, path: str, value_schema: T.DataType,
                    key_name: str = "key") -> DataFrame:
    """One JSON object keyed by id -> one row per key, key as a column.

    The file is read as whole text per file (one task per file), parsed as a
    map and exploded; a directory of such files spreads over many tasks.
    """
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", T.MapType(T.StringType(), value_schema)).alias("m"))
    return parsed.select(F.explode("m").alias(key_name, "value")).select(key_name, "value.*") \
        if isinstance(value_schema, T.StructType) else \
        parsed.select(F.explode("m").alias(key_name, "value"))


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] | None = None,
                  mode: str = "overwrite") -> None:
    """Parquet sink."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_json_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON-lines records (one object per row)."""
    df.write.mode(mode).json(path)


def skip_existing(df: DataFrame, existing: DataFrame | None, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not yet in an existing output table (a re-run only
    does the missing work); ``existing=None`` keeps every row."""
    if existing is None:
        return df
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(existing.select(*keys).distinct(), keys, "left_anti")


def read_existing(spark: SparkSession, path: str) -> DataFrame | None:
    """An existing Parquet output table, or ``None`` when nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001 - Spark raises AnalysisException for a missing path
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return None
        raise
