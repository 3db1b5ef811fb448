"""Similarity metrics and statistics. Corpus scores are ratios of sums, so partial aggregation does the work before the exchange."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quern.functions.text import for_word_errors, strip, strip_markers, tokens
from quern.operators.ordering import few
from quern.scratch import materialize


def character_edits(ref: Column, hyp: Column) -> Column:
    return F.levenshtein(ref, hyp).cast("long")


@F.pandas_udf(StructType([StructField("ref", StringType()), StructField("hyp", StringType())]))
def _word_codes(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Both word sequences with each distinct word of the pair as one character, surrogates left out."""
    refs, hyps = [], []
    for r, h in zip(ref, hyp):
        number: dict[str, str] = {}
        code = lambda words: "".join(number.setdefault(w, chr(0x100 + len(number) + 0x800 * (len(number) >= 0xD700))) for w in words)  # noqa: B023, E731
        refs.append(code(r))
        hyps.append(code(h))
    return pd.DataFrame({"ref": refs, "hyp": hyps})


def word_edits(ref: Column, hyp: Column) -> Column:
    """Edits between word sequences: each distinct word of the pair stands as one character, which the built-in distance then counts."""
    codes = _word_codes(tokens(ref), tokens(hyp))
    return F.levenshtein(codes["ref"], codes["hyp"]).cast("long")


def error_rates(pairs: DataFrame, ref: str, hyp: str, keys: list[str]) -> DataFrame:
    """Corpus CER and WER in percent by keys; null where references are empty."""
    rows = pairs.select(*keys, character_edits(strip(F.col(ref)), strip(F.col(hyp))).alias("ce"), F.length(strip(F.col(ref))).alias("c"), word_edits(F.col(ref), F.col(hyp)).alias("we"), F.size(tokens(F.col(ref))).alias("w"))
    rate = lambda e, n: F.round(100 * F.sum(e) / F.nullif(F.sum(n), F.lit(0)), 4)
    return rows.groupBy(*keys).agg(F.sum("ce").alias("char_edits"), rate("ce", "c").alias("cer"), F.sum("we").alias("word_edits"), rate("we", "w").alias("wer"))


def grams(items: Column, n: int) -> Column:
    return F.when(F.size(items) >= n, F.transform(F.sequence(F.lit(1), F.size(items) - n + 1), lambda i: F.array_join(F.slice(items, i, n), "\u0001"))).otherwise(F.array().cast("array<string>"))


#: Rows of a batch whose words are Python objects at a time.
SLICE = 200
_CLIPPED = StructType([StructField(c, LongType()) for c in ("match", "hyp_n", "ref_n")])


def _row_grams(items: list[str | None] | None, n: int) -> Counter:
    """As grams() makes them: a null item leaves nothing."""
    items = items or []
    if n == 1:
        return Counter("" if x is None else x for x in items)
    return Counter("\u0001".join(x for x in items[i : i + n] if x is not None) for i in range(len(items) - n + 1))


def _clipped_row(n: int) -> Callable[[Column, Column], Column]:
    """(match, hyp_n, ref_n) of a row's own arrays of words: no gram crosses an exchange."""

    @F.arrow_udf(_CLIPPED)
    def run(refs: pa.Array, hyps: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(refs), SLICE):
            for r, h in zip(refs.slice(at, SLICE).to_pylist(), hyps.slice(at, SLICE).to_pylist()):
                x, y = _row_grams(r, n), _row_grams(h, n)
                out.append((sum(min(k, y[g]) for g, k in x.items() if g in y), y.total(), x.total()))
        return pa.StructArray.from_arrays([pa.array([row[k] for row in out], pa.int64()) for k in range(3)], _CLIPPED.names)

    return run


def clipped(pairs: DataFrame, key: str, ref: Column, hyp: Column, n: int) -> DataFrame:
    """(key, match, hyp_n, ref_n) over n-grams: shared ones count as often as the rarer side has them. Keys without grams have no row.

    A key that stands once is counted within its row; grams of repeated keys are counted over all rows of the key.
    """
    repeated = materialize(pairs.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_key"), "repeated")
    is_in = lambda how: pairs.join(few(repeated), pairs[key].eqNullSafe(repeated["_key"]), how)
    names = _CLIPPED.names
    once = is_in("left_anti").select(key, _clipped_row(n)(ref, hyp).alias("_c")).select(key, *[F.col(f"_c.{c}") for c in names]).filter("hyp_n + ref_n > 0")
    if repeated.isEmpty():
        return once
    several = is_in("left_semi")
    side = lambda items, a, b: several.select(key, F.explode(grams(items, n)).alias("g"), F.lit(a).alias("r"), F.lit(b).alias("h"))
    both = side(ref, 1, 0).unionByName(side(hyp, 0, 1)).groupBy(key, "g").agg(F.sum("r").alias("r"), F.sum("h").alias("h"))
    return once.unionByName(both.groupBy(key).agg(F.sum(F.least("r", "h")).alias("match"), F.sum("h").alias("hyp_n"), F.sum("r").alias("ref_n")))


def effect_sizes(scores: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Paired Cohen's d (population deviation of the differences, 0 where they don't vary) and the pooled one."""
    d = F.col(a) - F.col(b)
    pooled = F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2)
    ratio = lambda top, bottom: F.round(F.when(bottom > 0, top / bottom).otherwise(0.0), 6)
    return scores.groupBy(*keys).agg(F.count("*").alias("n"), ratio(F.avg(d), F.stddev_pop(d)).alias("d_paired"), ratio(F.avg(a) - F.avg(b), pooled).alias("d_pooled"))


#: 2^32 times the probability that a Poisson variable of mean 1 is at most 0, 1, 2, ... 11.
POISSON = tuple(round(2**32 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(12))


def poisson_weight(number: Column) -> Column:
    """How often a row is drawn, by inversion from a number of 32 bits. Weights over 12 have a probability of 10^-10."""
    return sum((F.when(number >= p, 1).otherwise(0) for p in POISSON[1:]), F.when(number >= POISSON[0], 1).otherwise(0))


def bootstrap_wins(scores: DataFrame, key: str, a: str, b: str, resamples: int, seed: int = 1) -> DataFrame:
    """One row: share of resamples in which b's mean isn't above a's, a one-sided p value, from a Poisson bootstrap: each row is drawn Poisson(1) times in each resample.

    Draws are hashed, so a lost task draws the same; sums are combined before the exchange.
    """
    from quern.operators.ordering import spread
    from quern.operators.sampling import draw_number

    drawn = spread(scores.select(key, a, b), resamples).withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    weight = poisson_weight(draw_number(seed, F.concat_ws("|", "resample", F.col(key).cast("string"))))
    means = drawn.groupBy("resample").agg(F.sum(weight * (F.col(b) - F.col(a))).alias("gain"))
    return means.agg((1 - F.avg((F.col("gain") > 0).cast("double"))).alias("p_value"), F.count("*").alias("resamples"))


def utterance_rates(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """df with wer and cer of each row in percent, raw and of the normal forms (wer_norm, cer_norm), two digits; 0 for an empty reference. Markers are taken out of the candidate first; null is empty."""
    heard = strip(strip_markers(F.coalesce(F.col(hyp), F.lit(""))))
    said = strip(F.coalesce(F.col(ref), F.lit("")))
    out = df.withColumns({"_said": said, "_heard": heard, "_said_norm": for_word_errors(said), "_heard_norm": for_word_errors(heard)})
    for form in ("", "_norm"):
        r, h = F.col(f"_said{form}"), F.col(f"_heard{form}")
        out = out.withColumns({f"_we{form}": word_edits(r, h), f"_wn{form}": F.size(tokens(r)), f"_ce{form}": character_edits(r, h), f"_cn{form}": F.length(r)})
        rate = lambda e, n: F.coalesce(F.round(100 * F.try_divide(F.col(e), F.col(n)), 2), F.lit(0.0))
        out = out.withColumns({f"wer{form}": rate(f"_we{form}", f"_wn{form}"), f"cer{form}": rate(f"_ce{form}", f"_cn{form}")})
    return out


def error_report(df: DataFrame, ref: str, hyp: str, keys: list[str], error: Column) -> DataFrame:
    """n, corpus rates raw and normalised, medians and mean of the rows' normalised rates, and rows with an error, by keys.

    Rates have two digits, so a median is taken over counts of equal rates; no buffer holds all rows.
    """
    rows = utterance_rates(df, ref, hyp).withColumn("_bad", F.coalesce(error, F.lit(False)).cast("long"))
    total = lambda e, n: F.coalesce(F.round(100 * F.try_divide(F.sum(e), F.sum(n)), 2), F.lit(0.0))
    rates = [total(f"_{k}e{form}", f"_{k}n{form}").alias(f"{name}{form or '_raw'}") for form in ("", "_norm") for k, name in (("w", "wer"), ("c", "cer"))]
    middle = [F.round(F.percentile(f"{m}_norm", 0.5), 2).alias(f"median_{m}") for m in ("wer", "cer")]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *rates, *middle, F.round(F.avg("wer_norm"), 2).alias("mean_wer"), F.sum("_bad").alias("errors"))


def unclamped_rates(df: DataFrame, ref: str, hyp: str, keys: list[str]) -> DataFrame:
    """Corpus wer and cer in percent of texts as they are, with a denominator of 1 at least."""
    r, h = F.coalesce(F.col(ref), F.lit("")), F.coalesce(F.col(hyp), F.lit(""))
    rows = df.select(*keys, word_edits(r, h).alias("we"), F.size(tokens(r)).alias("wn"), character_edits(r, h).alias("ce"), F.length(r).alias("cn"))
    rate = lambda e, n: F.round(100 * F.sum(e) / F.greatest(F.sum(n), F.lit(1)), 2)
    return rows.groupBy(*keys).agg(rate("we", "wn").alias("wer"), rate("ce", "cn").alias("cer"))
