"""Signal expressions on ``ARRAY<FLOAT|DOUBLE>`` columns: H13, H15-H20, U2.

All native array expressions; framing (H17) keeps one number per frame inside
the signal's row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the audio steps.
PEAK_DB = -0.1
SNR_FRAME = 512
SNR_HOP = 256
SNR_NOISE_PERCENTILE = 0.30


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pad_or_trim(signal: Column | str, n: int) -> Column:
    """Zero-pad or cut a vector to ``n`` elements."""
    s = _c(signal)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(n) - F.size(s), F.lit(0)))
    return F.when(F.size(s) >= n, F.slice(s, 1, n)).otherwise(F.concat(s.cast("array<float>"), zeros))


def peak_normalize(signal: Column | str, peak_db: float = PEAK_DB) -> Column:
    """Scale so the absolute peak sits at ``peak_db`` dBFS; an all-zero
    signal is returned unchanged."""
    s = _c(signal).cast("array<double>")
    peak = F.array_max(F.transform(s, lambda x: F.abs(x)))
    target = 10 ** (peak_db / 20.0)
    return F.when(peak > 0, F.transform(s, lambda x: x * F.lit(target) / peak)).otherwise(s)


def duration_seconds(signal: Column | str, sample_rate: Column | str) -> Column:
    """Samples / rate (NULL for a missing or zero rate)."""
    sr = _c(sample_rate).cast("double")
    return F.when(sr > 0, F.size(_c(signal)) / sr)


def slice_seconds(signal: Column | str, sample_rate: Column | str, start_s: Column | str,
                  end_s: Column | str) -> Column:
    """``signal[start_ms : end_ms]`` on a millisecond grid (``int(s * 1000)``,
    as the segmenter does), converted to samples at ``sample_rate``; NULL when
    the segment starts past the end."""
    sr = _c(sample_rate).cast("long")
    start_ms = F.floor(_c(start_s) * 1000).cast("long")
    end_ms = F.floor(_c(end_s) * 1000).cast("long")
    a = (start_ms * sr / 1000).cast("int")
    b = F.least((end_ms * sr / 1000).cast("int"), F.size(_c(signal)))
    return F.when(a < F.size(_c(signal)), F.slice(_c(signal), a + 1, F.greatest(b - a, F.lit(0))))


def segment_name(file_col: Column | str, channel_col: Column | str, start_col: Column | str,
                 end_col: Column | str) -> Column:
    """``{file}_{channel}_segment_{start}_{end}.wav``."""
    return F.concat(_c(file_col), F.lit("_"), _c(channel_col), F.lit("_segment_"), _c(start_col).cast("string"),
                    F.lit("_"), _c(end_col).cast("string"), F.lit(".wav"))


def failure_reason(*, present: Column, readable: Column, channels: Column | None = None,
                   n_samples: Column | None = None, sample_rate: Column | None = None,
                   target_rate: int | None = None, known_source: Column | None = None) -> Column:
    """First failing audio check as a reason code, NULL when the file is usable."""
    r = F.when(known_source.isNotNull() & ~known_source, F.lit("unknown_source")) if known_source is not None else None

    def chain(prev, cond, code):
        return F.when(cond, F.lit(code)) if prev is None else prev.when(cond, F.lit(code))
    r = chain(r, ~present, "missing")
    r = chain(r, ~readable, "unreadable")
    if n_samples is not None:
        r = chain(r, n_samples <= 0, "empty")
    if channels is not None:
        r = chain(r, channels < 2, "mono")
    if sample_rate is not None and target_rate is not None:
        r = chain(r, sample_rate < target_rate, "rate_below_target")
    return r


def apply_transform(signal: Column | str, fn: Callable[[Column], Column] | None) -> Column:
    """User hook applied to each signal before padding (``Column -> Column``)."""
    return _c(signal) if fn is None else fn(_c(signal))


def frame_snr(df: DataFrame, id_col: str, signal_col: str, frame: int = SNR_FRAME, hop: int = SNR_HOP,
              noise_q: float = SNR_NOISE_PERCENTILE) -> DataFrame:
    """Blind SNR per signal.  Frames start at ``0, hop, ...`` strictly
    below ``n - frame``; RMS per frame; frames at or below the 30th
    percentile (linear) are noise, the rest signal;
    ``10 log10(mean(rms^2 signal) / mean(rms^2 noise))``.  NULL when the clip
    has no frame (``n <= frame``), no signal frame, or no noise power."""
    s = F.col(signal_col).cast("array<double>")
    n_frames = F.ceil((F.size(s) - frame) / F.lit(float(hop))).cast("int")

    def mean_square(i: Column) -> Column:
        return F.aggregate(F.slice(s, i * hop + 1, frame), F.lit(0.0), lambda a, x: a + x * x) / frame

    # everything stays in the signal's row: one number per frame, no copy of the signal
    rms = df.select(id_col, F.when(F.size(s) > frame, F.transform(
        F.sequence(F.lit(0), n_frames - 1), lambda i: F.sqrt(mean_square(i)))).alias("__rms"))
    ordered = rms.withColumn("__sorted", F.array_sort("__rms")).withColumn("__at", (F.size("__rms") - 1) * F.lit(float(noise_q)))
    low = F.element_at("__sorted", F.floor("__at").cast("int") + 1)
    high = F.element_at("__sorted", F.ceil("__at").cast("int") + 1)
    thr = F.when(low == high, low).otherwise((F.ceil("__at") - F.col("__at")) * low + (F.col("__at") - F.floor("__at")) * high)
    cut = ordered.where("__rms is not null").withColumn("__thr", thr)

    def power(rows: Column) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda a, x: a + x * x) / F.nullif(F.size(rows), F.lit(0))

    noise = power(F.filter("__rms", lambda x: x <= F.col("__thr")))
    sig = power(F.filter("__rms", lambda x: x > F.col("__thr")))
    none = ordered.where("__rms is null").select(id_col, F.lit(None).cast("double").alias("snr"))
    return cut.select(id_col, F.when((noise > 0) & sig.isNotNull(), 10 * F.log10(sig / noise)).alias("snr")).unionByName(none)
