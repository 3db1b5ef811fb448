"""Waveforms and codec ids as arrays: expressions, and an Arrow function where samples are decoded or framed."""

from __future__ import annotations

import io
import math
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from quern.operators.ordering import ranks

#: Entries of a codebook, and codebooks interleaved in a frame.
CODEBOOK, FRAME = 4096, 7
_SAMPLES = StructField("samples", ArrayType(FloatType()))


@F.pandas_udf(StructType([_SAMPLES, StructField("rate", IntegerType())]))
def decode_wav(content: pd.Series) -> pd.DataFrame:
    """WAV bytes as one channel from -1 to 1 with its rate: 8, 16 or 32 bits, channels averaged. Null for what can't be decoded."""

    def one(data):
        try:
            with wave.open(io.BytesIO(data)) as w:
                channels, width, rate, raw = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(w.getnframes())
        except (wave.Error, EOFError, TypeError):
            return None, None
        if width == 1:
            x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
        elif width in (2, 4):
            x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / 2.0 ** (8 * width - 1)
        else:
            return None, None
        return x.reshape(-1, channels).mean(axis=1, dtype=np.float32), rate

    return pd.DataFrame([one(d) for d in content], columns=["samples", "rate"]).astype({"rate": "Int32"})


def finite(samples: Column) -> Column:
    return F.filter(F.transform(samples, lambda v: v.cast("double")), lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))


def levels(samples: Column, rate: Column) -> Column:
    """struct(lo, hi, peak, rms, seconds) of the finite samples; null levels without one."""
    x = finite(samples)
    n = F.size(x)
    rms = F.when(n > 0, F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / n))
    return F.struct(F.array_min(x).alias("lo"), F.array_max(x).alias("hi"), F.array_max(F.transform(x, F.abs)).alias("peak"), rms.alias("rms"), F.try_divide(F.size(samples), rate).alias("seconds"))


def scaled(samples: Column) -> Column:
    """struct(samples, policy): up to 1 as it is, up to 65536 divided by that, else scaled to a peak of 0.98; zeros without a finite sample."""
    peak = F.array_max(F.transform(finite(samples), F.abs))
    out = lambda f, name: F.struct(F.transform(samples, lambda v: f(v).cast("float")).alias("samples"), F.lit(name).alias("policy"))
    return (
        F.when(peak.isNull(), out(lambda v: F.lit(0.0), "silent_or_non_finite"))
        .when(peak == 0, out(lambda v: v, "zero_peak"))
        .when(peak <= 1, out(lambda v: v, "already_float_minus1_to_1"))
        .when(peak <= 65536, out(lambda v: v / 65536, "integer_like_divide_by_65536"))
        .otherwise(out(lambda v: F.try_divide(v, peak) * 0.98, "peak_normalized_to_0p98"))
    )


def resampled(samples: Column, rate: int, target: int) -> Column:
    """Linear interpolation at int(n / rate * target) places spread evenly from the first sample to the last."""
    if rate == target:
        return samples
    n = F.size(samples)
    m = F.floor(n / F.lit(float(rate)) * target).cast("int")
    step = F.coalesce(F.try_divide((n - 1).cast("double"), m - 1), F.lit(0.0))

    def at(i: Column) -> Column:
        place = i * step
        low = F.least(F.floor(place), n - 1).cast("int")
        a, b = F.get(samples, low), F.get(samples, F.least(low + 1, n - 1))
        return (a + (place - low) * (b - a)).cast("float")

    return F.when(m > 0, F.transform(F.sequence(F.lit(0), F.greatest(m, F.lit(1)) - 1), at)).otherwise(F.array().cast("array<float>"))


#: Zero crossings of the low-pass on either side, and the share of the lower rate's band that it keeps.
CROSSINGS, ROLLOFF = 6, 0.99
#: Output samples that are made at a time.
SLICE = 1 << 15


def sinc_resampled(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """ceil(n * target / rate) samples at the target's rate, each a sum of its neighbours under a sinc with a cosine-squared window, which also keeps out what the lower rate can't hold. Samples beyond the ends are 0."""
    shared = math.gcd(rate, target)
    rate, target = rate // shared, target // shared
    if rate == target or not len(x):
        return np.asarray(x, dtype=np.float64)
    band = min(rate, target) * ROLLOFF
    reach = math.ceil(CROSSINGS * rate / band)
    padded = np.pad(np.asarray(x, dtype=np.float64), (reach, reach + 1))
    out = np.empty(-(-len(x) * target // rate))
    offset = np.arange(-reach, reach + 1)
    for a in range(0, len(out), SLICE):
        k = np.arange(a, min(a + SLICE, len(out)), dtype=np.int64)
        whole, part = k * rate // target, (k * rate % target) / target
        t = np.clip((offset - part[:, None]) * band / rate, -CROSSINGS, CROSSINGS)
        weights = np.sinc(t) * np.cos(t * np.pi / CROSSINGS / 2) ** 2 * band / rate
        out[k] = (padded[whole[:, None] + offset + reach] * weights).sum(axis=1)
    return out


def sped(samples: Column, rate: int, factor: float) -> Column:
    """The samples played so many times as fast, at the same rate: as if taken at int(rate * factor), they are brought back to rate. Tones are as many times as high. Null stays null."""
    source = int(rate * factor)
    if source < 1:
        raise ValueError("the factor leaves no rate")

    @F.pandas_udf(ArrayType(DoubleType()))
    def resample(rows: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else sinc_resampled(x, source, rate) for x in rows])

    return resample(samples)


def collated(df: DataFrame, key: str, samples: str, labels: str, size: int) -> DataFrame:
    """(batch, keys, waveforms, lengths, targets, target_lengths, mask): rows of about equal length in batches of `size`, the longest first within each.

    Rows are placed by length, then key, over stored ranges, so that padding is small and no task sorts all of them. Waveforms and targets are filled with zeros up to the longest of the batch; mask has true for each sample.
    Null arrays count as empty.
    """
    kind = dict(df.dtypes)[samples].removeprefix("array<").removesuffix(">")
    x = df.select(F.col(key).alias("_key"), F.coalesce(samples, F.array().cast(f"array<{kind}>")).alias("_x"), F.coalesce(labels, F.array().cast("array<int>")).cast("array<int>").alias("_y"))
    x = ranks(x.withColumn("_n", F.size("_x")), ["_n", "_key"], "_place")
    row = F.struct((-F.col("_n")).alias("o"), F.col("_key").alias("key"), F.col("_x").alias("x"), F.col("_y").alias("y"))
    b = x.groupBy(F.floor((F.col("_place") - 1) / size).alias("batch")).agg(F.sort_array(F.collect_list(row)).alias("r"))  # `size` rows
    part = lambda f: F.transform("r", lambda r: r[f])
    b = b.select("batch", part("key").alias("keys"), part("x").alias("_x"), part("y").alias("_y"))
    most = lambda c: F.array_max(F.transform(c, F.size))
    filled = lambda c, zero: F.transform(c, lambda v: F.concat(v, F.array_repeat(zero, most(c) - F.size(v))))
    mask = F.transform("_x", lambda v: F.concat(F.array_repeat(F.lit(True), F.size(v)), F.array_repeat(F.lit(False), most("_x") - F.size(v))))
    return b.select("batch", "keys", filled("_x", F.lit(0).cast(kind)).alias("waveforms"), F.transform("_x", F.size).alias("lengths"), filled("_y", F.lit(0)).alias("targets"), F.transform("_y", F.size).alias("target_lengths"), mask.alias("mask"))


def at_peak(samples: Column, peak: float = 0.95) -> Column:
    top = F.array_max(F.transform(samples, F.abs))
    return F.when(top > 0, F.transform(samples, lambda v: v * F.try_divide(F.lit(peak), top))).otherwise(samples)


def truncated(samples: Column, most: int) -> Column:
    """At most `most` samples: the limit is the feature."""
    return F.slice(samples, 1, most)


@F.pandas_udf(StructType([_SAMPLES, StructField("snr_db", DoubleType())]))
def trimmed(samples: pd.Series) -> pd.DataFrame:
    """Without quiet frames at both ends (25 dB below the loudest of 2048 samples, every 512), and the ratio of the level to the fifth percentile of magnitudes."""

    def one(x):
        x = np.asarray(x if x is not None else [], dtype=np.float32)
        if not len(x):
            return x, None
        padded = np.pad(x.astype(np.float64), 1024)
        frames = np.lib.stride_tricks.sliding_window_view(padded, 2048)[::512]
        power = (frames**2).mean(axis=1)
        loud = np.flatnonzero(10 * np.log10(np.maximum(power, 1e-10)) > 10 * np.log10(max(power.max(), 1e-10)) - 25)
        y = x[loud[0] * 512 : min(len(x), (loud[-1] + 1) * 512)] if len(loud) else x[:0]
        if not len(y):
            return y, None
        rms = float(np.sqrt((y.astype(np.float64) ** 2).mean()))
        return y, round(20 * float(np.log10(max(rms, 1e-10) / max(float(np.percentile(np.abs(y), 5)), 1e-10))), 1)

    return pd.DataFrame([one(x) for x in samples], columns=["samples", "snr_db"]).astype({"snr_db": "float64"})


def code(v: Column, scale: int) -> Column:
    """The magnitude of a sample in whole parts of 1 / scale. The product has single precision, as samples have: one in double precision stays below whole numbers that are meant (0.29 * 100)."""
    return F.floor(F.abs(v) * F.lit(scale).cast("float")).cast("int")


def interleaved(coarse: Column, middle: Column, fine: Column, first: int = 0) -> Column:
    """Codes of three levels (one, two and four a step) as frames of seven, each place with its own range of ids from `first` on."""
    code = lambda level, k, place: F.get(level, k) + first + place * CODEBOOK
    frame = lambda i: F.array(code(coarse, i, 0), code(middle, 2 * i, 1), code(fine, 4 * i, 2), code(fine, 4 * i + 1, 3), code(middle, 2 * i + 1, 4), code(fine, 4 * i + 2, 5), code(fine, 4 * i + 3, 6))
    return F.when(F.size(coarse) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(coarse), F.lit(1)) - 1), frame))).otherwise(F.array().cast("array<int>"))


def levels_of(flat: Column, first: int = 0) -> Column:
    """struct(coarse, middle, fine): the inverse of interleaved."""
    pick = lambda places: F.transform(F.filter(F.transform(flat, lambda v, i: F.struct(v.alias("v"), (i % FRAME).alias("p"))), lambda s: s["p"].isin(*places)), lambda s: (s["v"] - first - s["p"] * CODEBOOK).cast("int"))
    return F.struct(pick((0,)).alias("coarse"), pick((1, 4)).alias("middle"), pick((2, 3, 5, 6)).alias("fine"))


def without_repeats(flat: Column) -> Column:
    """Frames of seven without those whose first code is that of the last frame kept; an error for a part of a frame."""
    checked = F.when(F.size(flat) % FRAME == 0, flat).otherwise(F.raise_error(F.lit("codes don't fill whole frames")).cast("array<int>"))
    heads = F.filter(checked, lambda v, i: i % FRAME == 0)
    kept = F.filter(F.transform(heads, lambda v, i: F.when((i == 0) | (v != F.get(heads, i - 1)), i)), lambda i: i.isNotNull())
    return F.flatten(F.transform(kept, lambda i: F.slice(checked, i * FRAME + 1, FRAME)))
