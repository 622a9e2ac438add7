"""Audio files as tables: S7-S10, S12, J8, J9.

Files are listed and read with Spark's ``binaryFile`` source (one row per file,
content pruned when not selected).  The only Python that runs in workers is
the PCM WAV header parse / decode in ``mapInPandas`` (Arrow batches); every
other step is a DataFrame expression or join.  Unreadable files become rows
with an ``error`` reason, never a failed stage.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("length", T.LongType()),
    T.StructField("sample_rate", T.IntegerType()), T.StructField("channels", T.IntegerType()),
    T.StructField("sample_width", T.IntegerType()), T.StructField("n_frames", T.LongType()),
    T.StructField("duration", T.DoubleType()), T.StructField("error", T.StringType()),
])

DECODED_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("sample_rate", T.IntegerType()),
    T.StructField("channels", T.IntegerType()), T.StructField("waveform", T.ArrayType(T.FloatType())),
    T.StructField("error", T.StringType()),
])


def list_files(spark: SparkSession, root: str, suffix: str = "*.wav", strip_prefix: str | None = None) -> DataFrame:
    """Recursive listing ``(path, rel_path, length)``; file content is not read."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
          .option("pathGlobFilter", suffix).load(root).select("path", "length"))
    prefix = strip_prefix if strip_prefix is not None else root.rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", "^file:", ""), "^" + _re_escape(prefix), "")
    return df.withColumn("rel_path", rel)


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)


def _read_files(spark: SparkSession, root: str, suffix: str = "*.wav", max_bytes: int | None = None) -> DataFrame:
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
          .option("pathGlobFilter", suffix).load(root))
    # a file over the limit is not read into a task, but stays as a row with an error
    content = F.col("content") if max_bytes is None else F.when(F.col("length") <= max_bytes, F.col("content"))
    return df.select("path", "length", content.alias("content"))


def _parse_header(content: bytes) -> tuple[int, int, int, int]:
    with wave.open(io.BytesIO(content), "rb") as w:
        return w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()


def _manifest_batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        rows = []
        for path, length, content in zip(pdf["path"], pdf["length"], pdf["content"]):
            if content is None:
                rows.append((path, int(length), None, None, None, None, None, "too_large"))
                continue
            try:
                sr, ch, sw, nf = _parse_header(bytes(content))
                rows.append((path, int(length), sr, ch, sw, nf, nf / sr if sr else None, None))
            except (wave.Error, EOFError, struct.error, ValueError) as e:
                rows.append((path, int(length), None, None, None, None, None, f"unreadable: {type(e).__name__}"))
        yield pd.DataFrame(rows, columns=[f.name for f in MANIFEST_SCHEMA.fields])


def audio_manifest(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """Sample rate, channels, frames and duration per WAV; unreadable
    files are rows with ``error`` set (counted, not raised)."""
    return _read_files(spark, root, max_bytes=max_bytes).mapInPandas(_manifest_batches, MANIFEST_SCHEMA)


def _decode(content: bytes) -> tuple[int, int, np.ndarray]:
    with wave.open(io.BytesIO(content), "rb") as w:
        sr, ch, sw, nf = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()
        raw = w.readframes(nf)
    if sw == 2:
        x = np.frombuffer(raw, dtype="<i2").astype(np.float32) / 32768.0
    elif sw == 4:
        x = np.frombuffer(raw, dtype="<i4").astype(np.float32) / 2147483648.0
    elif sw == 1:
        x = (np.frombuffer(raw, dtype=np.uint8).astype(np.float32) - 128.0) / 128.0
    else:
        raise ValueError(f"unsupported sample width {sw}")
    x = x.reshape(-1, ch).mean(axis=1).astype(np.float32) if ch > 1 else x
    return sr, ch, x


def _decode_batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                sr, ch, x = _decode(bytes(content)) if content is not None else (None, None, None)
                row = (path, sr, ch, x, None if content is not None else "too_large")
            except (wave.Error, EOFError, struct.error, ValueError) as e:
                row = (path, None, None, None, f"unreadable: {type(e).__name__}")
            # a file at a time: one decoded clip in memory
            yield pd.DataFrame([row], columns=[f.name for f in DECODED_SCHEMA.fields])


def decode_audio(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """PCM WAV -> mono float32 ``waveform`` (channels averaged)."""
    return _read_files(spark, root, max_bytes=max_bytes).mapInPandas(_decode_batches, DECODED_SCHEMA)


def sample_rate_report(manifest: DataFrame) -> DataFrame:
    """A10: sample-rate histogram plus min / max rate and unreadable files.

    One aggregation by rate (unreadable files form the NULL-rate group); the
    totals are windows over that table, which has one row per distinct rate."""
    g = manifest.groupBy("sample_rate").agg(
        F.count_if(F.col("error").isNull()).cast("bigint").alias("n_files"),
        F.count_if(F.col("error").isNotNull()).cast("bigint").alias("__bad"))
    w = Window.partitionBy(F.lit(0))
    out = g.select("sample_rate", "n_files", F.min("sample_rate").over(w).alias("min_rate"),
                   F.max("sample_rate").over(w).alias("max_rate"),
                   F.sum("__bad").over(w).cast("bigint").alias("n_unreadable"))
    # files that are all unreadable leave one row without a rate
    return out.where((F.col("sample_rate").isNotNull() & (F.col("n_files") > 0)) | F.col("min_rate").isNull())


def write_waveform_store(rows: DataFrame, path: str, partition_by: str = "source") -> DataFrame:
    """The rows with a waveform as Parquet partitioned by ``source``; returns the one-row totals
    table ``(n_rows, seconds, n_failed, n_text_only)``.

    A row whose ``error`` (if there is such a column) is set has failed; one without error and
    waveform is text only.  Neither is stored.  The totals are observed by the write itself: the
    store is not read again and the rows are computed once."""
    failed = F.col("error").isNotNull() if "error" in rows.columns else F.lit(False)
    stored = ~failed & F.col("waveform").isNotNull()
    seen = Observation()
    rows.observe(seen, F.count_if(stored).alias("n_rows"),
                 F.sum(F.when(stored, F.size("waveform") / F.col("sample_rate"))).alias("seconds"),
                 F.count_if(failed).alias("n_failed"), F.count_if(~failed & F.col("waveform").isNull()).alias("n_text_only")) \
        .where(stored).write.mode("overwrite").partitionBy(partition_by).parquet(path)
    got = seen.get
    return rows.sparkSession.createDataFrame([tuple(got[c] for c in ("n_rows", "seconds", "n_failed", "n_text_only"))],
                                             "n_rows long, seconds double, n_failed long, n_text_only long")


def route_source_root(source_col: str, roots: dict[str, str]) -> Column:
    """Audio root for a row's source; NULL for an unknown source (the
    caller turns it into the ``unknown_source`` failure reason, H19)."""
    pairs = []
    for k, v in roots.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), F.col(source_col))


def attach_features(pairs: DataFrame, features: DataFrame, key: str = "audio_id",
                    roles: tuple[str, ...] = ("curr", "res")) -> DataFrame:
    """Join per-file features to the wide pair rows once per role, columns
    prefixed ``<role>_``; a failed / missing file gives NULLs."""
    out = pairs
    feats = [c for c in features.columns if c != key]
    for r in roles:
        f = features.select(F.col(key).alias(f"{r}_audio_id"), *[F.col(c).alias(f"{r}_{c}") for c in feats])
        out = out.join(f, f"{r}_audio_id", "left")
    return out


# ---------------------------------------------------------------------------
# Segment lists

SEGMENT_RE = r"\(([^,]+), ([^)]+)\)"


def read_segment_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of segment files with their order: ``(value, line)``.

    Spark packs files into tasks by size and may cut a large file, so a running id does not follow the
    files; ``line`` is (file, start of the block in it, place in the task), which does."""
    return spark.read.text(path).select("value", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place")).alias("line"))


def parse_segment_lines(lines: DataFrame, value_col: str = "value", line_col: str | None = None) -> DataFrame:
    """``name/channel<TAB>(a, b) (c, d)`` lines -> ``(file, channel, seg, start, end)``.

    ``#`` comments, blank lines and ``longform`` lines are skipped; when a
    ``(file, channel)`` appears twice the first line wins.  ``line_col`` gives the
    order of lines (``read_segment_lines`` makes one for files); without it lines
    are taken in the order of the frame's partitions.
    """
    from colloquy.functions.text import strip_ws
    v = strip_ws(F.col(value_col))
    kept = lines.select(v.alias("v"), (F.col(line_col) if line_col else F.monotonically_increasing_id()).alias("__line")) \
        .where(~F.col("v").startswith("#") & (F.col("v") != "") & ~F.col("v").contains("longform"))
    parts = kept.select("__line", F.split("v", "\t", 2).alias("p")).where(F.size("p") == 2)
    key = F.split(F.trim(F.col("p")[0]), "/", 2)
    rows = parts.select("__line", key[0].alias("file"), key[1].alias("channel"),
                        F.regexp_extract_all(F.col("p")[1], F.lit(SEGMENT_RE), 1).alias("a"),
                        F.regexp_extract_all(F.col("p")[1], F.lit(SEGMENT_RE), 2).alias("b"))
    first = rows.groupBy("file", "channel").agg(F.min("__line").alias("__line"))
    rows = rows.join(first, ["file", "channel", "__line"], "left_semi")
    return rows.select("file", "channel", F.posexplode(F.arrays_zip("a", "b")).alias("seg", "z")) \
        .select("file", "channel", "seg", F.col("z.a").cast("double").alias("start"),
                F.col("z.b").cast("double").alias("end"))


def match_segments(files: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files x segments by ``(file, channel)``; returns ``(matched, rejects)``
    where rejects are channels without any segment."""
    j = files.join(segments, ["file", "channel"], "left")
    return j.where(F.col("start").isNotNull()), j.where(F.col("start").isNull()).select(*files.columns)
