"""Agreement between annotators and tests of counts, from sums alone: no pairs of ratings are made."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quern.operators.ordering import grouped_few, running_sums, same
from quern.scratch import materialize


def _spread(n: Column, first: Column, second: Column) -> Column:
    """Sum of squared differences over all ordered pairs of n numbers, from their sum and the sum of their squares."""
    return 2 * (n * second - first * first)


def krippendorff(ratings: DataFrame, unit: str, value: str, level: str = "nominal", keys: list[str] | None = None) -> DataFrame:
    """(keys, n, alpha): 1 - observed by expected disagreement among the ratings of units that have two or more; n counts those ratings. Null ratings are left out; alpha is null where no other value could be had.

    level: nominal counts unequal pairs, interval squared differences, ordinal those of mid-ranks. A pair within a unit of m ratings weighs 1 / (m - 1); sums over pairs come from counts or moments of each unit.
    """
    keys = list(keys or [])
    if level not in ("nominal", "ordinal", "interval"):
        raise ValueError(f"no level {level}")
    base = ratings.select(*keys, F.col(unit).alias("_u"), F.col(value).alias("_v")).filter("_v IS NOT NULL")
    k, m = F.col("_k"), F.col("_m")
    if level != "interval":
        # values of units of one rating are told apart, as they count nowhere
        x = base.groupBy(*keys, "_u", "_v").agg(F.count("*").alias("_k"))
        units = x.groupBy(*keys, "_u").agg(F.sum("_k").alias("_m"), F.sum(k * k).alias("_kk"), F.min("_v").alias("_v"))
        units = units.withColumn("_alone", F.when(m == 1, F.col("_v")))
        sums = materialize(units.groupBy(*keys, "_alone").agg(F.sum(F.when(m > 1, (m * m - F.col("_kk")) / (m - 1))).alias("_o"), F.sum(F.when(m > 1, m)).alias("n"), F.count_if(m == 1).alias("_k")), "units")
        alone = sums.filter("_alone IS NOT NULL").select(*keys, F.col("_alone").alias("_v"), (-k).alias("_k"))
        values = base.groupBy(*keys, "_v").agg(F.count("*").alias("_k")).unionByName(alone).groupBy(*keys, "_v").agg(F.sum("_k").alias("_c")).filter("_c > 0")
    if level == "nominal":
        observed = sums.filter("_alone IS NULL AND n IS NOT NULL").select(*keys, "_o", "n")
        of_all = values.groupBy(*keys).agg((F.sum("_c") * F.sum("_c") - F.sum(F.col("_c") * F.col("_c"))).cast("double").alias("_e"))
    else:
        if level == "ordinal":
            ranked = running_sums(values, keys, ["_v"], "_c", "_upto").select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate([*keys, "_v"])], (F.col("_upto") - F.col("_c") / 2).alias("_x"))
            ranked = grouped_few(ranked)
            # a value that only units of one rating have has no rank, and its units go below
            base = base.join(ranked, same(base, ranked, [*keys, "_v"], [f"_r{i}" for i in range(len(keys) + 1)]))
        else:
            base = base.withColumn("_x", F.col("_v").cast("double"))
        moments = [F.sum("_x").alias("_s"), F.sum(F.col("_x") * F.col("_x")).alias("_ss")]
        units = base.groupBy(*keys, "_u").agg(F.count("*").alias("_m"), *moments).filter("_m > 1")
        spread = _spread(m, F.col("_s"), F.col("_ss")) / (m - 1)
        sums = materialize(units.groupBy(*keys).agg(F.sum(spread).alias("_o"), F.sum("_m").alias("n"), _spread(F.sum("_m"), F.sum("_s"), F.sum("_ss")).alias("_e")), "units")
        observed, of_all = sums.select(*keys, "_o", "n"), sums.select(*keys, "_e")
    of_all = of_all.select(*[F.col(c).alias(f"_e{k}") for k, c in enumerate(keys)], "_e")
    j = observed.join(of_all, same(observed, of_all, keys, [f"_e{k}" for k in range(len(keys))]))
    return j.select(*keys, "n", (1 - F.try_divide(F.col("_o") * (F.col("n") - 1), F.col("_e"))).alias("alpha"))


def cohen_kappa(pairs: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, agreed, kappa) of two raters' columns: the share of equal ratings, and how far it is beyond that of raters who draw by their own shares. Rows with a null rating are left out; kappa is null where chance agrees always."""
    keys = list(keys or [])
    x = pairs.select(*keys, F.col(a).cast("string").alias("_a"), F.col(b).cast("string").alias("_b")).filter("_a IS NOT NULL AND _b IS NOT NULL").groupBy(*keys, "_a", "_b").agg(F.count("*").alias("_k"))
    # a row for each key and pair of categories from here on
    said = x.select(*keys, F.col("_k"), F.explode(F.array(F.struct(F.col("_a").alias("c"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.col("_b").alias("c"), F.lit(0).alias("a"), F.lit(1).alias("b")))).alias("s"))
    chance = said.groupBy(*keys, "s.c").agg(F.sum(F.col("_k") * F.col("s.a")).alias("_na"), F.sum(F.col("_k") * F.col("s.b")).alias("_nb")).groupBy(*keys).agg(F.sum(F.col("_na").cast("double") * F.col("_nb")).alias("_e"))
    chance = chance.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(keys)], "_e")
    whole = x.groupBy(*keys).agg(F.sum("_k").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_k")).otherwise(0)).alias("_same"))
    j = whole.join(chance, same(whole, chance, keys, [f"_g{k}" for k in range(len(keys))]))
    p, e = F.col("_same") / F.col("n"), F.col("_e") / (F.col("n").cast("double") * F.col("n"))
    return j.select(*keys, "n", p.alias("agreed"), F.try_divide(p - e, 1 - e).alias("kappa"))


def gamma_tail(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function Q(a, x): a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    b, tiny = x + 1 - a, 1e-300
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        step = -i * (i - a)
        b += 2
        d = 1 / ((step * d + b) or tiny)
        c = b + step / c or tiny
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return h * scale


@F.pandas_udf(DoubleType())
def chi_square_tail(statistic: pd.Series, freedom: pd.Series) -> pd.Series:
    """The probability of a chi-square of so many degrees of freedom above the statistic; null without a degree."""
    return pd.Series([gamma_tail(f / 2, s / 2) if s == s and f and f > 0 else None for s, f in zip(statistic, freedom)], dtype="float64")


def chi_square(rows: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, chi_square, freedom, p_value): whether two columns go together, from the counts of their values. Rows with a null are left out."""
    keys = list(keys or [])
    x = rows.select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).filter("_a IS NOT NULL AND _b IS NOT NULL").groupBy(*keys, "_a", "_b").agg(F.count("*").alias("_k"))
    named = lambda side, total: x.groupBy(*keys, side).agg(F.sum("_k").alias(total)).select(*[F.col(c).alias(f"{total}{k}") for k, c in enumerate([*keys, side])], total)
    ra, rb = named("_a", "_ra"), named("_b", "_rb")
    j = x.join(ra, same(x, ra, [*keys, "_a"], [f"_ra{k}" for k in range(len(keys) + 1)])).join(rb, same(x, rb, [*keys, "_b"], [f"_rb{k}" for k in range(len(keys) + 1)]))
    s = j.groupBy(*keys).agg(F.sum("_k").alias("n"), F.sum(F.col("_k") * F.col("_k") / (F.col("_ra").cast("double") * F.col("_rb"))).alias("_s"), ((F.count_distinct("_a") - 1) * (F.count_distinct("_b") - 1)).alias("freedom"))
    s = s.withColumn("chi_square", F.greatest(F.lit(0.0), F.col("n") * (F.col("_s") - 1)))
    return s.select(*keys, "n", "chi_square", "freedom", chi_square_tail("chi_square", F.col("freedom").cast("double")).alias("p_value"))
